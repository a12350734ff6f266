import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from .helpers import by_id, documents, empty
from kolot.llm import class_lm, language_id, quality_classifier, toxicity
from kolot.llm.common import fold

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out(docs, labels, score, column, part):
    return docs.where(part).join(labels, "doc_id").select(score.alias("s"), column).collect()


def test_quality(spark, tables):
    docs, labels = tables
    part = fold("doc_id", 5) == 0
    model = quality_classifier.fit(docs, labels.where(~part))
    rows = held_out(docs, labels, quality_classifier.score(F.col("text"), model, spark), "quality", part)
    assert np.mean([(r["s"] >= 0.3) == r["quality"] for r in rows]) > 0.95
    got = [r[0] for r in documents(spark, ["x"]).select(quality_classifier.score(F.col("text"), model, spark)).collect()]
    assert all(0 <= s <= 1 for s in got) and got[1:4] == [0, 0, 0]
    assert empty(spark).select(quality_classifier.score(F.col("text"), model, spark)).count() == 0
    assert quality_classifier.fit(docs, labels.limit(0)) is None
    assert documents(spark, ["x"]).select(quality_classifier.score(F.col("text"), None, spark)).first()[0] == 0.5


def test_quality_neighbours_are_exact(spark, tables):
    docs, labels = tables
    model = quality_classifier.fit(docs, labels, most_labelled=100)
    texts = [r["text"] for r in docs.limit(40).collect()]
    vectors = model.project(quality_classifier._raw(texts))
    for text, v, got in zip(texts, vectors, model.scores(texts), strict=True):
        cosines = [float(v @ w) for w in model.vectors]
        near = sorted(range(len(cosines)), key=lambda k: -cosines[k])[: model.k]
        weights = [max(cosines[k], 1e-6) ** 16 for k in near]
        assert got == pytest.approx(sum(w * model.labels[k] for w, k in zip(weights, near, strict=True)) / sum(weights), abs=1e-3)


def test_quality_comes_from_the_words(spark, tables):
    """Without the word terms the model loses what it knows; the axes are those of a full decomposition."""
    docs, labels = tables
    part = fold("doc_id", 5) == 0
    rows = docs.where(part).join(labels, "doc_id").collect()
    known = docs.join(labels, "doc_id").where(~part).orderBy("doc_id").collect()
    right = {}
    for kept in ("all", "characters"):
        mask = np.ones(quality_classifier.DIMS, np.float32)
        mask[: quality_classifier.WORDS] = kept == "all"
        raw, y = quality_classifier._raw([r["text"] or "" for r in known]) * mask, np.array([r["quality"] for r in known], float)
        idf = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))) + 1).astype(np.float32)
        weighted = quality_classifier._weighted(raw, idf)
        axes = quality_classifier.latent_axes(weighted, 48)
        exact = np.linalg.svd(weighted, full_matrices=False)[2][:10]
        assert np.allclose(np.abs((exact @ axes)[:, :10].diagonal()), 1, atol=0.02)
        model = quality_classifier.Model(idf, axes, np.zeros(0), y)
        model.vectors = model.project(raw)
        cosines = model.project(quality_classifier._raw([r["text"] or "" for r in rows]) * mask) @ model.vectors.T
        near = model.nearest(cosines)
        weight = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6).astype(float) ** 16
        low = (weight * y[near]).sum(1) / weight.sum(1) < 0.3
        bad = np.array([r["quality"] == 0 for r in rows])
        right[kept] = low[bad].mean()
    assert right["characters"] < 0.85 < right["all"]


def test_quality_ties_go_by_identifier():
    model = quality_classifier.Model(np.ones(1), np.ones((1, 1)), np.ones((5, 1)), np.arange(5.0), k=2)
    assert model.nearest(np.array([[0.5, 0.5, 0.9, 0.5, 0.1]])).tolist() == [[0, 2]]


def test_toxicity(spark, tables):
    docs, labels = tables
    part = fold("doc_id", 3) == 1
    model = toxicity.fit(docs, labels.where(~part))
    rows = held_out(docs, labels, toxicity.score(F.col("text"), model, spark), "toxic", part)
    assert np.mean([(r["s"] >= 0.7) == r["toxic"] for r in rows]) > 0.92
    assert not [r for r in rows if r["s"] >= 0.9 and not r["toxic"]]
    got = [r[0] for r in documents(spark, ["x"]).select(toxicity.score(F.col("text"), model, spark)).collect()]
    assert all(0 <= s < 0.7 for s in got)
    assert toxicity.fit(docs, labels.limit(0)).score("any") == pytest.approx(0.5)


def test_toxicity_learns_pairs():
    """Neither word alone is toxic, both together are: no additive weights can tell."""
    texts = (["red"] * 40 + ["fox"] * 40 + ["red fox"] * 40 + ["sun"] * 40) * 2
    labels = np.array(([0] * 80 + [1] * 40 + [0] * 40) * 2, float)
    model = toxicity.train([toxicity.text_terms(t) for t in texts], labels)
    assert model.score("red fox") > 0.9 and max(map(model.score, ("red", "fox", "sun"))) < 0.3
    v, w = model.v[model.present("red fox")], model.w[model.present("red fox")]
    pairs = sum(float(v[i] @ v[j]) for i in range(len(v)) for j in range(i))
    assert model.score("red fox") == pytest.approx(1 / (1 + math.exp(-(model.bias + w.sum() + pairs))))


def test_toxicity_learns_one_text_of_an_identifier(spark):
    """Many rows share an identifier: the least of their texts counts, wherever the rows lie."""
    texts = ["red fox", "red", "fox", "sun"] * 30
    rows = [(i, t) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(t == "red fox"), 0) for i, t in rows], "doc_id long, toxic int, quality int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    again = spark.createDataFrame([(0, f"zebra {k}") for k in range(50)] + rows + rows, "doc_id long, text string").withColumn("label", F.lit("x"))
    one, two = (toxicity.fit(docs, labels) for docs in (once, again.repartition(3)))
    assert one.index and one.index == two.index and one.bias == two.bias
    assert np.array_equal(one.w, two.w) and np.array_equal(one.v, two.v)


def test_terms_that_tell_beside_another_are_screened_in():
    """A group mention stands in as many clean texts as toxic ones; beside the insult it tells."""
    words = ["bad group", "bad group", "bad", "group", "group", "other", "other", "group"] * 60
    labels = np.array([1, 1, 0, 0, 0, 0, 0, 0] * 60, float)
    terms = [toxicity.text_terms(t) for t in words]
    term = lambda w: toxicity.word_terms(w)[0]
    assert term("bad") in toxicity.screened(terms, labels, least_chi2=100)
    only = [t for t in toxicity.screened(terms, labels, least_chi2=150, least_pair_chi2=1e9)]
    assert term("bad") in only and term("group") not in only
    assert term("group") in toxicity.screened(terms, labels, least_chi2=150)


def test_language(spark, tables):
    docs, _ = tables
    part = fold("doc_id", 4) == 2
    model = language_id.fit(docs.where(~part))
    rows = docs.where(part).select("lang", language_id.predict(F.col("text"), model, spark).alias("p")).collect()
    assert np.mean([r["lang"] == r["p"]["lang_pred"] for r in rows]) > 0.99
    got = [tuple(r["p"]) for r in documents(spark, ["12 !", "xyz"]).select(language_id.predict(F.col("text"), model, spark).alias("p")).collect()]
    assert [got[k] for k in (0, 2, 3, 4)] == [("und", 0.0)] * 4 and got[1][0] in model.languages
    nothing = language_id.fit(empty(spark))
    assert nothing.predict("some text") == ("und", 0.0)


def test_language_grams_and_distance():
    codes, counts = language_id.grams("Ab-a")
    got = dict(zip(codes.tolist(), counts.tolist(), strict=True))
    pack = lambda s: int("".join(f"{ord(c):021b}" for c in s), 2)
    assert got == Counter(map(pack, ["a", "b", "a", " a", "ab", "b ", " a", "a ", " ab", "ab ", " a "]))
    model = language_id.Model(["x", "y"], np.sort(codes), np.array([[k, 400] for k in range(len(codes))]))
    ranked = language_id.ranked(codes, counts).tolist()
    rank = {c: k for k, c in enumerate(np.sort(codes).tolist())}
    places = sum(abs(k - rank[c]) for k, c in enumerate(ranked))
    assert model.predict("Ab-a") == ("x", pytest.approx(1 - places / (400 * len(ranked))))


def test_class_lm(spark, tables):
    docs, _ = tables
    part = fold("doc_id", 7) == 2
    rows = docs.withColumn("held", part).select("doc_id", "text", "held").unionByName(documents(spark, ["the of", "zzz the"]).selectExpr("doc_id + 1000000 AS doc_id", "text", "true AS held"))
    got = class_lm.score_texts(rows, ~F.col("held")).collect()
    assert len(got) == rows.count()
    plain = rows.collect()
    counts, n = Counter(), 0
    for r in plain:
        if not r["held"]:
            words = [*class_lm.tokens(r["text"]), None]
            counts.update(words)
            n += len(words)
    texts = {r["doc_id"]: r for r in plain}
    for r in got:
        words = [*class_lm.tokens(texts[r["doc_id"]]["text"] or ""), None]
        base = sum(math.log10((counts[w] + 1) / (n + len(counts) + 1)) for w in words)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
    fresh = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000000 and texts[r["doc_id"]]["held"]]
    assert sum(r["score"] for r in fresh) > sum(r["base_score"] for r in fresh)
    assert class_lm.score_texts(empty(spark).withColumn("held", F.lit(False)), ~F.col("held")).count() == 0


@pytest.mark.parametrize("head", [4, 40, 100_000])
def test_class_lm_by_the_definition(spark, tables, head):
    """Every text's score from the tables in plain Python; after each context, chances over all training words, the end and the words never seen sum to one."""
    from kolot.llm.common import Workspace, word_hashes

    docs = tables[0].limit(60).select("doc_id", "text").unionByName(documents(spark, ["zzz the of zzz", "the of"]).selectExpr("doc_id + 1000000 AS doc_id", "text"))
    docs = docs.withColumn("training", F.col("doc_id") < 1000000)
    model, others = class_lm.class_model(docs.where("training").selectExpr("coalesce(text, '') AS text"), Workspace(spark, "test"), clustered=4, head=head, classes=3)
    plain = docs.collect()
    counts, ends = Counter(), 0
    for r in plain:
        if r["training"]:
            counts.update(class_lm.tokens(r["text"] or ""))
            ends += 1
    hashed = lambda w: int(word_hashes([w])[0])
    kinds = dict(zip(model.words.hashes.tolist(), model.words.kinds.tolist(), strict=True))
    found = {r["hash"] % 2**64: r for r in others.collect()}
    every = kinds | {h: r["kind"] for h, r in found.items()}
    assert set(every) == {hashed(w) for w in counts} and len(found) == len(counts) - 4
    assert all(found[h]["n"] == n for w, n in counts.items() if (h := hashed(w)) in found)
    assert len(kinds) <= head and model.distinct == len(counts) + 1 and model.n == sum(counts.values()) + ends
    end = model.words.end
    totals, moves = Counter(), Counter()
    after = lambda w: end if w is None else kinds.get(hashed(w), end + 1)
    for r in plain:
        if r["training"]:
            line = [None, *class_lm.tokens(r["text"] or ""), None]
            for a, b in zip(line, line[1:], strict=False):
                kind = end if b is None else every[hashed(b)]
                moves[after(a), kind] += 1
                totals[kind] += 1
    share = {k: n / model.n for k, n in totals.items()}
    once = sum(n == 1 for n in counts.values())
    unseen = (once + 0.5) / (model.n + 1)
    leaving = {c: sum(n for (a, _), n in moves.items() if a == c) for c in range(end + 2)}

    def chance(context, word):
        kind, c = (end, ends) if word is None else (every.get(hashed(word)), counts[word])
        if not c:
            return (0.9 * unseen + 0.1 / model.uniform) / (once + 1)
        follows = (moves[context, kind] + 5 * share[kind]) / (leaving[context] + 5)
        return 0.9 * (1 - unseen) * follows * c / totals[kind] + 0.1 * (c + 1) / model.uniform

    for context in range(end + 2):
        assert sum(chance(context, w) for w in [*counts, None]) + (once + 1) * chance(context, b"never seen") == pytest.approx(1, abs=1e-9)
    got = {(r["doc_id"], r["n_tokens"]): r for r in class_lm.score_texts(docs, F.col("training"), clustered=4, head=head, classes=3).collect()}
    for r in plain:
        line = [None, *class_lm.tokens(r["text"] or ""), None]
        if len(line) < 400:
            want = sum(math.log10(chance(after(a), b)) for a, b in zip(line, line[1:], strict=False))
            assert got[r["doc_id"], len(line) - 1]["score"] == pytest.approx(want, abs=1e-6)


def test_words_join_the_class_of_their_neighbours():
    """The weighted votes are the likelihood of the word in each class, up to what is the same for all."""
    joint = np.array([[1.0, 9, 2, 3], [8, 2, 3, 2], [5, 6, 0, 1], [2, 3, 1, 4]])
    w = class_lm.class_weights(joint)
    assert w.shape == (8, 2)
    before_one, after_one = w[0] - w[0][0], w[4] - w[4][0]
    share = (joint.sum(0) + 1) / (joint.sum() + 4)
    p = (joint + 5 * share) / (joint.sum(1, keepdims=True) + 5)
    assert before_one[1] == pytest.approx(math.log(p[0, 1] / (joint.sum(0)[1] + 1)) - math.log(p[0, 0] / (joint.sum(0)[0] + 1)))
    assert after_one[1] == pytest.approx(math.log(p[1, 0]) - math.log(p[0, 0]))


def test_classes_are_summed_across_batches():
    import pyarrow as pa

    w = np.array([[1.0, 0], [0, 1], [0, 0], [0, 0]])
    pack = lambda code, n: code << class_lm.COUNT_BITS | n
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["hash", "codes"])
    got = class_lm._classified(w)(iter([batch([(1, [pack(0, 2)]), (5, [pack(1, 1), pack(2, 9)])]), batch([(5, [pack(0, 3)])]), batch([(5, [pack(1, 4)]), (9, [pack(1, 1)])])]))
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [(1, 0, 2), (5, 1, 8), (9, 1, 1)]


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    pairs = np.zeros((42, 42))
    kind = np.append(np.arange(40) % 2, [2, 3])
    for i in range(40):
        for j in range(40):
            pairs[i, j] = rng.poisson(8 if kind[i] != kind[j] else 0.2)

    def likelihood(at):
        one = np.eye(at.max() + 1)[at]
        joint = one.T @ pairs @ one
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(joint) - f(joint.sum(0)) - f(joint.sum(1))

    rng.shuffle(order := np.arange(40))
    pairs = pairs[np.append(order, [40, 41])][:, np.append(order, [40, 41])]
    at = class_lm.exchange(pairs, 2, rounds=10)
    start = np.append(np.arange(40) % 2, [2, 3])
    assert likelihood(at) > likelihood(start)
    assert len({(a, kind[order[i]]) for i, a in enumerate(at[:40])}) == 2
