"""Language-model scoring by Brown's class-based bigrams with exchange clustering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolot.llm.common import Workspace, text_or_empty, word_hashes

#: Words clustered by exchange; words whose counts and classes are broadcast; classes.
CLUSTERED, HEAD, CLASSES = 1500, 500_000, 64
#: Weight of the class model against the smoothed unigram.
WEIGHT = 0.9
#: Tokens that a task sums up before it hands them on, and texts that it looks at together.
MOST_HELD, SLICE = 3_000_000, 256
#: Stands for the end of a text among the hashes of words.
END = np.uint64(0)
#: A context's code and how often it occurs are packed in one integer.
COUNT_BITS = 23


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def flow(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' words, one text after another, END closing each; and the places of those ends."""
    words = [tokens(t) for t in texts]
    hashes = word_hashes(list(chain.from_iterable(words)))
    hashes[hashes == END] = 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return np.insert(hashes, ends, END), ends + np.arange(len(words))


def _flows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            part = batch.slice(at, SLICE)
            yield part, *flow(part["text"].to_pylist())


@dataclass
class Words:
    """Hashes of words in order, with the class and count of each."""

    hashes: np.ndarray
    kinds: np.ndarray
    counts: np.ndarray
    end: int  # the class of ends; end + 1 is that of all other words

    @classmethod
    def of(cls, hashes: np.ndarray, kinds: np.ndarray, counts: np.ndarray, end: int) -> Words:
        order = np.argsort(hashes)
        return cls(hashes[order], kinds[order].astype(np.int16), counts[order].astype(np.int64), end)

    def find(self, flow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each token, and its count; 0 for ends and other words."""
        at = np.minimum(np.searchsorted(self.hashes, flow), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == flow if len(self.hashes) else np.zeros(len(flow), bool)
        kinds = np.full(len(flow), self.end + 1, np.int64)
        counts = np.zeros(len(flow), np.int64)
        kinds[known], counts[known] = self.kinds[at[known]], self.counts[at[known]]
        kinds[flow == END] = self.end
        return kinds, counts


def before(kinds: np.ndarray, end: int) -> np.ndarray:
    """The class before each token; the first of a slice stands after an end."""
    return np.concatenate([[end], kinds[:-1]])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def rows() -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["hash", "n"])

    for _, line, ends in _flows(batches):
        held.append(np.delete(line, ends))
        if sum(map(len, held)) > MOST_HELD:
            yield rows()
            held = []
    if held:
        yield rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """(hash, n) of all words of all texts, without ends."""
    return docs.select("text").mapInArrow(_counted, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame, most: int) -> int:
    """The least count that at most `most` words reach. A histogram with eight steps an octave goes to the driver, never the words."""
    step = F.ceil(F.log2("n") * 8).cast("int")
    total, least = 0, 0
    for row in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        total += row["words"]
        if total > most:
            return least or row["n"] + 1
        least = row["n"]
    return 1


def _pairs(ranks: Words):
    """Counts of (previous, next) among clustered words by rank, END and OTHER; a text starts after END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = ranks.end + 2
        sums = np.zeros(size**2, np.int64)
        for _, line, _ in _flows(batches):
            ids, _ = ranks.find(line)
            sums += np.bincount(before(ids, ranks.end) * size + ids, minlength=len(sums))
        at = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["pair", "n"])

    return run


def exchange(pairs: np.ndarray, classes: int, rounds: int = 4) -> np.ndarray:
    """Classes of words: each word in turn moves to the class that raises the bigram likelihood most.

    pairs[i, j] counts word i before word j. The last two, END and OTHER, keep classes of
    their own. Words start by rank modulo the number of classes. The likelihood is
    sum f(class pairs) - sum f(left of class) - sum f(right of class), f(x) = x log x.
    """
    n = len(pairs)
    free = n - 2
    classes = max(1, min(classes, free)) if free else 0
    at = np.concatenate([np.arange(free) % max(classes, 1), [classes, classes + 1]])
    k = classes + 2
    f = lambda x: x * np.log(np.maximum(x, 1))
    one = np.zeros((n, k))
    one[np.arange(n), at] = 1
    right, left = pairs @ one, pairs.T @ one  # of word i: followers by class; predecessors by class
    joint = one.T @ right
    for _ in range(rounds):
        moved = 0
        for i in range(free):
            c, same = at[i], pairs[i, i]
            r, l = right[i].copy(), left[i].copy()  # noqa: E741
            r[c] -= same
            l[c] -= same
            joint[c] -= r
            joint[:, c] -= l
            joint[c, c] -= same
            rows, cols = joint.sum(1), joint.sum(0)
            out, into = r.sum() + same, l.sum() + same
            # row d gains r and column d gains l; the corner (d, d) gains both and the pairs of the word with itself
            gain = (f(joint + r) - f(joint)).sum(1) + (f(joint + l[:, None]) - f(joint)).sum(0)
            d = np.diag(joint)
            gain += f(d + r + l + same) - f(d + r) - f(d + l) + f(d)
            gain -= f(rows + out) - f(rows) + f(cols + into) - f(cols)
            # the sums of other rows and columns grow alike wherever the word goes
            best = int(gain[:classes].argmax())
            if gain[best] <= gain[c] + 1e-9:
                best = c
            joint[best] += r
            joint[:, best] += l
            joint[best, best] += same
            if best != c:
                moved += 1
                at[i] = best
                right[:, c] -= pairs[:, i]
                right[:, best] += pairs[:, i]
                left[:, c] -= pairs[i]
                left[:, best] += pairs[i]
        if not moved:
            break
    return at


def _contexts(first: Words):
    """(hash, codes) of words that exchange has not clustered: the classes before and after them, each with its number, packed."""
    kinds_ = first.end + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            words, left, right = map(np.concatenate, zip(*held, strict=True))
            words, which = np.unique(words, return_inverse=True)
            which = which * (2 * kinds_)
            pairs, n = np.unique(np.concatenate([which + left, which + kinds_ + right]), return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(len(words) + 1) * (2 * kinds_))
            codes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array((pairs % (2 * kinds_) << COUNT_BITS | n).astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), codes], ["hash", "codes"])

        for _, line, _ in _flows(batches):
            kinds, _ = first.find(line)
            other = np.nonzero(kinds == first.end + 1)[0]
            if len(other):
                held.append((line[other], before(kinds, first.end)[other], kinds[other + 1]))  # an end follows the last word
            if sum(len(h[0]) for h in held) > MOST_HELD:
                yield rows()
                held = []
        if held:
            yield rows()

    return run


def class_weights(joint: np.ndarray) -> np.ndarray:
    """What one more neighbour of each class, before (first half) and after a word, says for each class of the word: log P(class | before) - log of the class's tokens, and log P(after | class)."""
    k = len(joint) - 2
    share = (joint.sum(0) + 1) / (joint.sum() + len(joint))
    chances = (joint + 5 * share) / (joint.sum(1, keepdims=True) + 5)
    return np.concatenate([np.log(chances[:, :k]) - np.log(joint.sum(0)[:k] + 1), np.log(chances[:k]).T])


def _classified(weights: np.ndarray):
    """(hash, kind, n) from rows (hash, codes) in order of the hash: a word's rows are summed as they pass, however many there are."""
    half = len(weights) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None

        def rows(hashes, votes, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(votes.argmax(1), pa.int32()), pa.array(n, pa.int64())], ["hash", "kind", "n"])

        for batch in batches:
            if not len(batch):
                continue
            hashes, flat = batch["hash"].to_numpy(), batch["codes"].flatten().to_numpy()
            offsets = np.concatenate([[0], np.cumsum(batch["codes"].value_lengths().to_numpy())])
            starts = np.nonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))[0]
            code, n = flat >> COUNT_BITS, flat & ((1 << COUNT_BITS) - 1)
            votes = np.add.reduceat(weights[code] * n[:, None], offsets[starts], axis=0)
            counts = np.add.reduceat(np.where(code < half, n, 0).astype(np.int64), offsets[starts])
            hashes = hashes[starts]
            if last and last[0][0] == hashes[0]:
                votes[0] += last[1][0]
                counts[0] += last[2][0]
            elif last:
                yield rows(*last)
            yield rows(hashes[:-1], votes[:-1], counts[:-1])
            last = hashes[-1:], votes[-1:], counts[-1:]
        if last:
            yield rows(*last)

    return run


def _moves(words: Words):
    """(hash, before, kind, n): how often each class follows each; of words outside the head (kind null) how often they follow each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = words.end + 2
        sums = np.zeros(size * size, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def tail() -> pa.RecordBatch:
            rare, left = map(np.concatenate, zip(*held, strict=True))
            rare, which = np.unique(rare, return_inverse=True)
            pairs, n = np.unique(which * size + left, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(rare[pairs // size].view(np.int64)), pa.array((pairs % size).astype(np.int32)), pa.nulls(len(pairs), pa.int32()), pa.array(n)], ["hash", "before", "kind", "n"])

        for _, line, _ in _flows(batches):
            kinds, _ = words.find(line)
            left = before(kinds, words.end)
            other = kinds > words.end
            sums += np.bincount((left * size + kinds)[~other], minlength=len(sums))
            if other.any():
                held.append((line[other], left[other]))
            if sum(len(h[0]) for h in held) > MOST_HELD:
                yield tail()
                held = []
        if held:
            yield tail()
        at = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), pa.array(sums[at])], ["hash", "before", "kind", "n"])

    return run


@dataclass
class Model:
    """Broadcast parts: no more than HEAD words with classes and counts, and a class table of CLASSES + 2 by CLASSES + 1."""

    words: Words  # the head
    chances: np.ndarray  # of the next class, after each class, ends, and words outside the head
    totals: np.ndarray  # tokens of each class, and ends
    n: int  # training tokens with ends
    distinct: int  # distinct training tokens with the end
    once: int  # words that occur once

    @property
    def uniform(self) -> int:
        return self.n + self.distinct + 1

    @property
    def weight(self) -> float:
        return WEIGHT if self.n else 0.0

    @property
    def unseen(self) -> float:
        """The share of the class model that words never seen get: that of words seen once."""
        return (self.once + 0.5) / (self.n + 1)

    def chance(self, left: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of tokens that occur in training, with their counts, after each class."""
        inside = counts / np.maximum(self.totals[kinds], 1)
        return self.weight * (1 - self.unseen) * self.chances[left, kinds] * inside + (1 - self.weight) * (counts + 1) / self.uniform

    def never(self) -> float:
        """Of a word that does not occur in training: one of as many as occur once, and one more."""
        return (self.weight * self.unseen + (1 - self.weight) / self.uniform) / (self.once + 1 if self.n else 1)


def class_model(docs: DataFrame, workspace: Workspace, clustered: int = CLUSTERED, head: int = HEAD, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """Learns from all texts of docs; the model and the table (hash, kind, n) of every word that is not clustered by exchange.

    The `clustered` most frequent words are put into classes by exchange. Every other word
    joins the class for which its neighbours, before and after, speak most. What class
    follows which is then counted over all texts. As a context, a word outside the `head` most
    frequent ones is one of a class of their own.
    """
    docs = docs.select("text")
    counts = workspace.write(word_counts(docs), "counts")
    ends = docs.count()
    totals = counts.agg(F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") == 1)).first()
    n, distinct = (totals[0] or 0) + ends, totals[1] + (ends > 0)
    top = counts.orderBy(F.desc("n"), "hash").limit(clustered).toPandas()
    hashes, frequent = top["hash"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    end = len(top)
    ranks = Words.of(hashes, np.arange(end), frequent, end)
    sums = docs.mapInArrow(_pairs(ranks), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros((end + 2) ** 2)
    pairs[sums["pair"].to_numpy(np.int64)] = sums["n"]
    del sums
    pairs = pairs.reshape(end + 2, end + 2)
    at = exchange(pairs, classes)
    k = int(at[-1]) - 1
    one = np.zeros((end + 2, k + 2))
    one[np.arange(end + 2), at] = 1
    joint = one.T @ pairs @ one
    del pairs
    first = Words.of(hashes, at[:end], frequent, k)
    contexts = docs.mapInArrow(_contexts(first), "hash long, codes array<int>").repartition("hash").sortWithinPartitions("hash")
    others = workspace.write(contexts.mapInArrow(_classified(class_weights(joint)), "hash long, kind int, n long"), "classes")
    more = others.where(F.col("n") >= least_count(others, max(head - end, 0))).toPandas() if end else top.assign(kind=0)
    words = Words.of(np.concatenate([hashes, more["hash"].to_numpy(np.int64).view(np.uint64)]), np.concatenate([at[:end], more["kind"].to_numpy(np.int64)]), np.concatenate([frequent, more["n"].to_numpy(np.int64)]), k)
    del more
    moves = workspace.write(docs.mapInArrow(_moves(words), "hash long, before int, kind int, n long"), "moves")
    known = moves.where("hash IS NULL").select("before", "kind", "n")
    rare = moves.where("hash IS NOT NULL").drop("kind").join(others.select("hash", "kind"), "hash").select("before", "kind", "n")
    joint = np.zeros((k + 2, k + 1))
    for row in known.unionByName(rare).groupBy("before", "kind").agg(F.sum("n").alias("n")).collect():  # a row for each pair of classes
        joint[row["before"], row["kind"]] = row["n"]
    in_class = joint.sum(0)
    share = in_class / max(in_class.sum(), 1)
    chances = (joint + 5 * share) / (joint.sum(1, keepdims=True) + 5)
    return Model(words, chances, in_class, int(n), int(distinct), int(totals[2])), others


PARTS = "doc_id long, row long, n_tokens long, n_known long, base_score double, score double, tail array<struct<hash: long, before: int>>"


def _parts(model: Model):
    """For each row the sums over tokens of the head, and its other tokens with the class before each, whose counts are joined later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, line, ends in _flows(batches):
            kinds, counts = model.words.find(line)
            left = before(kinds, model.words.end)
            counts[ends] = int(model.totals[model.words.end])
            other = kinds > model.words.end
            base = np.log10((counts + 1) / model.uniform)
            score = np.zeros(len(line))
            score[~other] = np.log10(model.chance(left[~other], kinds[~other], counts[~other]))
            starts = np.concatenate([[0], ends[:-1] + 1])
            held = np.concatenate([[0], np.cumsum(other)])[np.append(starts, len(line))]
            tail = pa.StructArray.from_arrays([pa.array(line[other].view(np.int64)), pa.array(left[other].astype(np.int32))], ["hash", "before"])
            sums = lambda x: pa.array(np.add.reduceat(x, starts))  # noqa: B023,E731
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["row"], pa.array(ends - starts + 1), sums((counts > 0).astype(np.int64)), sums(base), sums(score), pa.ListArray.from_arrays(pa.array(held, pa.int32()), tail)], ["doc_id", "row", "n_tokens", "n_known", "base_score", "score", "tail"])

    return run


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", clustered: int = CLUSTERED, head: int = HEAD, classes: int = CLASSES) -> DataFrame:
    """For each row: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Words are cut at ``[\\x20\\x09-\\x0D]`` after A-Z are lower-cased; an end closes each text
    and counts as a token, so null, empty and blank texts have one token. The model is learned
    from all rows where `training` holds (see `class_model`). base_score: log10 probability under add-one
    unigrams. score: log10 probability under class bigrams, WEIGHT, and add-one unigrams, the
    rest, which sum to one over words seen and words never seen, as many as were seen once and one more. Ties in counts: words by
    their hash. Without a training row every token has probability 1. Repeated rows, and
    those with a null identifier, give one output row each. An empty table gives an empty
    result. Other columns are ignored. Words are told apart by 64-bit hashes.

    Counts and classes are gathered of all training words. Those of the `head` most frequent are broadcast;
    a document's other words are joined with theirs by a shuffle, in which no word is
    frequent, having missed the head.
    """
    spark = docs.sparkSession
    workspace = Workspace(spark, "class-lm")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    model, others = class_model(docs.where("training"), workspace, clustered, head, classes)
    # rows are told apart by hash of identifier and text, so repeated rows can share their sums
    parts = workspace.write(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(_parts(model), PARTS), "parts")
    tail = parts.where(F.size("tail") > 0).dropDuplicates(["row"]).select("row", F.explode("tail").alias("t")).select("row", "t.hash", "t.before")
    ctx, kind = np.indices(model.chances.shape)
    factor = model.weight * (1 - model.unseen) * model.chances / np.maximum(model.totals, 1)
    table = spark.createDataFrame([(int(a), int(b), float(f)) for a, b, f in zip(ctx.ravel(), kind.ravel(), factor.ravel(), strict=True)], "before int, kind int, factor double")
    n = F.coalesce("n", F.lit(0))
    chance = F.when(F.col("n").isNull(), model.never()).otherwise(F.col("factor") * n + (1 - model.weight) * (n + 1) / model.uniform)
    found = tail.join(others, "hash", "left").join(F.broadcast(table), ["before", "kind"], "left")
    found = found.groupBy("row").agg(F.count("n").alias("known"), F.sum(F.log10(n + 1)).alias("base"), F.sum(F.log10(chance)).alias("more"))
    out = parts.drop("tail").join(found, "row", "left")
    plus = lambda a, b, zero: F.col(a) + F.coalesce(b, F.lit(zero))
    out = out.select("doc_id", "n_tokens", plus("n_known", "known", 0).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), plus("base_score", "base", 0.0).alias("base_score"), plus("score", "more", 0.0).alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
