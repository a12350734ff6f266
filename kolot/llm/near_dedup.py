"""Near-duplicate groups by min-max hashing of word shingles, banding and exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolot.llm.common import HOT, Workspace, bit_filter, joined_salted, known_id, maybe_in, mixed, null_back, text_or_empty, window_hashes, word_hashes

#: Multipliers and offsets of the permutations h -> a * h + b mod 2**64, a odd.
PERMUTATIONS, BANDS, ROWS = 64, 32, 4
A = np.random.default_rng(20240229).integers(0, 1 << 64, PERMUTATIONS, np.uint64) | np.uint64(1)
B = np.random.default_rng(20240301).integers(0, 1 << 64, PERMUTATIONS, np.uint64)
#: Members of a bucket that are compared with others at once.
CHUNK = 256


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's windows of `size` words, A-Z lower-cased; of all words where there are fewer."""
    return np.unique(window_hashes(word_hashes(text.encode("utf-8", "surrogatepass").lower().split()), size))


def min_max(hashes: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation: two values for one evaluation."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for k in range(0, len(hashes), 2048):
        values = hashes[k : k + 2048, None] * A + B
        low, high = np.minimum(low, values.min(0)), np.maximum(high, values.max(0))
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A key for each band of ROWS values; half the bands are of minima, half of maxima."""
    rows = signature.reshape(BANDS, ROWS)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        acc = mixed(acc + rows[:, k])
    return acc.view(np.int64)


def _signatures(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, counts, highs, lows, keys, sketches = [], [], [], [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingles(text, size)
                ids.append(doc_id)
                counts.append(len(s))
                if not len(s):
                    highs.append(0), lows.append(0), keys.append(None), sketches.append(None)
                    continue
                with np.errstate(over="ignore"):
                    high, low = s.sum(), mixed(s).sum()
                signature = min_max(s)
                highs.append(high.view(np.int64)), lows.append(low.view(np.int64))
                keys.append(band_keys(signature))
                sketches.append((signature >> np.uint64(48)).astype(np.uint16).tobytes())
            yield pd.DataFrame({"doc_id": ids, "n_shingles": counts, "high": highs, "low": lows, "keys": keys, "sketch": sketches})

    return run


def signatures(docs: DataFrame, size: int = 5) -> DataFrame:
    """Rows (doc_id, n_shingles, high, low, keys, sketch): the set's hash in two halves, its band keys, 16 bits of each signature value."""
    return docs.select("doc_id", "text").mapInPandas(_signatures(size), "doc_id long, n_shingles long, high long, low long, keys array<long>, sketch binary")


def _confirmer(size: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch["a"], batch["text_a"], batch["text_b"], strict=True):
                if a != last:
                    last, held = a, shingles(x, size)
                s = shingles(y, size)
                both = len(np.intersect1d(held, s, assume_unique=True))
                keep.append(100 * both >= percent * (len(held) + len(s) - both))
            yield batch.loc[keep, ["a", "b"]]

    return run


def confirmed(workspace: Workspace, pairs: DataFrame, docs: DataFrame, name: str, size: int = 5, percent: int = 75) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough. Only the texts of candidates are shuffled, and the pairs of a document with many partners are dealt over several tasks."""
    pairs = workspace.write(pairs, f"{name}-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    bits = workspace.write(bit_filter(ids, "doc_id"), f"{name}-bits")
    texts = maybe_in(docs, "doc_id", bits).select("doc_id", "text")
    hot = workspace.write(bit_filter(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "a"), f"{name}-hot")
    joined = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    joined = joined_salted(joined, texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a", hot, "b")
    return workspace.write(joined.select("a", "b", "text_a", "text_b").mapInPandas(_confirmer(size, percent), "a long, b long"), f"{name}-links")


def components(workspace: Workspace, links: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for all nodes of the links; component is the smallest node reachable.

    Alternating large and small stars: each node points its neighbours at the least of them.
    A node's least neighbour is aggregated before its shuffle, and a hub's links are dealt over
    several tasks where they meet it.
    """
    edges = workspace.write(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), f"{name}-0")
    state = None
    for turn in range(1, most_rounds):
        # large star: all larger neighbours of a node move to its least neighbour
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = workspace.write(both.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n")).select("x", F.least("x", "m").alias("m"), "n"), f"{name}-{turn}-least")
        hubs = bit_filter(least.where(F.col("n") > HOT), "x")
        large = joined_salted(both.where("y > x"), least.drop("n"), "x", hubs, "y").select(F.col("y").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        # small star: all smaller neighbours of a node, and itself, move to its least neighbour
        floor = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(floor, "v").select(F.explode(F.array("u", "v")).alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        edges = workspace.write(small, f"{name}-{turn}")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "set": [shingles(t, size).tobytes() for t in batch["text"]]})

    return run


def _cross(percent: int):
    """Links between members of two chunks of a bucket that lie in different components.

    A pair is looked at in its first common band only. Sizes and signatures rule most pairs
    out: the signature's standard error at 75 % is under 4 points for 128 values, and a pair
    must come within 17 points of the limit, over four standard errors. The others are
    confirmed on full sets. A link unites two components, whose members then need no further
    look in this task: so links are fewer than components, not as many as pairs.
    """
    empty = pd.DataFrame({"a": [], "b": []}, dtype="int64")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("doc_id")
        left, right = rows[rows["chunk"] == rows["i"]], rows[rows["chunk"] == rows["j"]]
        if left.empty or right.empty:
            return empty
        band = int(rows["band"].iloc[0])
        x, y = (np.frombuffer(b"".join(d["sketch"]), np.uint16).reshape(len(d), -1) for d in (left, right))
        keys, others = (np.stack(d["keys"].to_list()) for d in (left, right))
        n, m = left["n_shingles"].to_numpy(), right["n_shingles"].to_numpy()
        mine, theirs = left["component"].to_numpy().copy(), right["component"].to_numpy().copy()
        ids, other_ids = left["doc_id"].to_numpy(), right["doc_id"].to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in right["set"]]
        same = rows["i"].iloc[0] == rows["j"].iloc[0]
        a, b = [], []
        for k in range(len(left)):
            at = np.nonzero((mine[k] != theirs) & (100 * np.minimum(n[k], m) >= percent * np.maximum(n[k], m)))[0]
            at = at[(x[k] == y[at]).mean(1) >= percent / 100 - 0.17]
            at = at[(keys[k] == others[at]).argmax(1) == band]
            if same:
                at = at[other_ids[at] > ids[k]]
            if not len(at):
                continue
            own = np.frombuffer(left["set"].iloc[k], np.uint64)
            for j in at:
                if mine[k] == theirs[j]:
                    continue
                both = int((own[np.minimum(np.searchsorted(own, sets[j]), len(own) - 1)] == sets[j]).sum())
                if 100 * both >= percent * (n[k] + m[j] - both):
                    a.append(min(ids[k], other_ids[j]))
                    b.append(max(ids[k], other_ids[j]))
                    one, two = mine[k], theirs[j]
                    for side in (mine, theirs):
                        side[side == two] = one
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id, kept.

    A text's set holds its distinct windows of `size` words (A-Z lower-cased, words cut at
    ``[\\x20\\x09-\\x0D]``), or its whole sequence where it has fewer words. Texts are linked
    with ``100 * intersection >= percent * union``. Null, empty and blank texts have an empty
    set and no link. component_id is the smallest identifier reachable by links; the row with
    that identifier is kept. Repeated rows give one output row each. An empty table gives an
    empty result. Other columns are ignored. Identifiers must be distinct integers, but for
    repeated rows; a null one counts as the smallest, and as one document.

    1. Documents with equal sets collapse to their smallest identifier (a copy is never paired).
    2. Min-max signatures, 64 permutations with 128 values, in 32 bands of 4: at the limit of
       75 % a pair shares no band once in 190,000. In each bucket all are compared, on full
       sets, with the bucket's smallest identifier.
    3. Buckets whose members then lie in several components are searched whole, chunk by
       chunk in as many tasks: members of different components whose sizes and signatures allow
       a link are compared on full sets too, and only links leave the task. Members of one
       component need no comparison, so large groups of copies cost nothing here, and no
       bucket is capped.
    """
    workspace = Workspace(docs.sparkSession, "near-dedup")
    docs = docs.select(known_id(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    made = workspace.write(signatures(docs, size), "signatures")
    filled = made.where("n_shingles > 0")
    own_set = ["high", "low", "n_shingles"]
    classes = workspace.write(filled.groupBy(*own_set).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    hot = workspace.write(bit_filter(classes.where(F.col("n") > HOT), own_set), "classes-hot")
    member = workspace.write(joined_salted(filled.select("doc_id", *own_set), classes.drop("n"), own_set, hot, "doc_id").select("doc_id", "n_shingles", "rep"), "members")
    # repeated rows have one representative row
    reps = member.where("doc_id = rep").select(F.col("rep").alias("doc_id")).distinct()
    bands = filled.join(reps, "doc_id", "left_semi").select("doc_id", F.posexplode("keys").alias("band", "key"))
    sizes = workspace.write(bands.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"), F.count(F.lit(1)).alias("n")).where("least < greatest"), "sizes")
    hot = workspace.write(bit_filter(sizes.where(F.col("n") > HOT), "key"), "sizes-hot")
    shared = workspace.write(joined_salted(bands, sizes.drop("greatest", "n"), "key", hot, "doc_id").select("key", "band", "doc_id", "least").distinct(), "buckets")
    stars = shared.where("doc_id > least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = confirmed(workspace, stars, docs, "stars", size, percent)
    first = workspace.write(components(workspace, links, "first"), "first")
    placed = workspace.write(shared.select("key", "band", "doc_id").join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "band", "doc_id", F.coalesce("component", "doc_id").alias("component")), "placed")
    # a bucket of two was compared by its star; larger ones need a look where components differ, and of those with the same members the first band's
    mark = F.xxhash64("doc_id")
    mixed_up = placed.groupBy("key", "band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 20)).alias("y"), F.min("component").alias("low"), F.max("component").alias("high")).where("n > 2 and low < high")
    looked_at = mixed_up.groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("first")).select("first.key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    rest = workspace.write(joined_salted(placed, looked_at, "key", hot, "doc_id").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), "chunks").cast("int")), "rest")
    final = first
    if not rest.isEmpty():
        ids = rest.select("doc_id").distinct()
        bits = workspace.write(bit_filter(ids, "doc_id"), "rest-bits")
        sets = maybe_in(docs, "doc_id", bits).select("doc_id", "text").mapInPandas(_sets(size), "doc_id long, set binary")
        features = made.select("doc_id", "n_shingles", "keys", "sketch").join(sets, "doc_id")
        own = F.col("chunk")
        pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
        met = rest.withColumn("pair", F.explode(pairs)).select("key", "band", "chunk", "pair.*", "doc_id", "component").join(features, "doc_id")
        more = workspace.write(met.groupBy("key", "i", "j").applyInPandas(_cross(percent), "a long, b long"), "rest-links")
        if not more.isEmpty():
            final = components(workspace, links.unionByName(more), "last")
    out = member.select("doc_id", "n_shingles", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = out.unionByName(made.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return null_back(out.withColumn("kept", F.col("doc_id") == F.col("component_id")), "doc_id", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM sh x JOIN sh y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS r FROM w UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.r)
SELECT reach.a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id, reach.a = min(r) AS kept FROM reach LEFT JOIN n ON n.doc_id = reach.a GROUP BY reach.a
"""
