"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kolot.llm.common import WORD, Workspace, joined_small, text_or_empty

#: Documents, or residuals, that one node of the reduction tree rounds.
FAN_IN = 256
EPS = 1e-9


def source_targets(sizes: DataFrame, workspace: Workspace, most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Rows (source, source_size, target): shares of all sizes by weight, none above `most` times its source.

    Sources by code point, null last, get the weights in turn: they are sorted by ranges, and
    a range's ranks start from the number of sources before it. The level that fills the
    others rises as sources get full; each turn sums over all sources, and the last one
    finds none above its bound. So any number of sources is shared out, hosts too.
    """
    order = F.col("source").asc_nulls_last()
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = workspace.write(by.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id()), "sources")
    # one row for each range: no more than there are partitions
    starts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    by = ranged.join(F.broadcast(starts), "part").withColumn("rank", rank).withColumn("weight", weight).withColumn("bound", F.lit(float(most)) * F.col("source_size"))
    by = workspace.write(by.select("source", "source_size", "weight", "bound"), "weighed")
    level, before = 0.0, None
    while level != before:
        full = F.col("bound") < F.lit(level) * F.col("weight")
        row = by.agg(F.sum("source_size").cast("double"), F.sum(F.when(full, F.col("bound")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        before, level = level, (row[0] - row[1]) / row[2] if row[2] else level
    return by.select("source", "source_size", F.least("bound", F.lit(level) * F.col("weight")).alias("target"))


def uniform(seed: Column | str | int, *columns: str) -> Column:
    """A number in (0, 1) that depends on the columns and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed) if not isinstance(seed, Column) else seed, *columns), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


UNIT = "struct<doc_id: bigint, size: bigint, base: bigint, p: double, v: double>"
DONE = "struct<doc_id: bigint, size: bigint, copies: bigint>"


def let(name: str, value: str, body: str) -> str:
    """SQL that computes a value once and uses it by name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def paired(first: str, second: str, u: str, then: str) -> str:
    """The pivotal step: words move between two fractional units until one's p is 0 or 1; `then` has both as the array `two`.

    `up` words at most can go to the first, `down` to the second; the first gains with the
    chance down / (up + down). So each p keeps its expectation, and the sum of p * size stays.
    """
    moved = lambda unit, sign: f"named_struct('doc_id', {unit}.doc_id, 'size', {unit}.size, 'base', {unit}.base, 'p', {unit}.p {sign} d / {unit}.size, 'v', {unit}.v)"
    room = f"named_struct('up', least((1 - {first}.p) * {first}.size, {second}.p * {second}.size), 'down', least({first}.p * {first}.size, (1 - {second}.p) * {second}.size))"
    return let("m", room, let("d", f"if({u} * (m.up + m.down) < m.down, m.up, -m.down)", let("two", f"array({moved(first, '+')}, {moved(second, '-')})", then)))


DECIDED = f"transform(filter(two, y -> y.p < {EPS} OR y.p > 1 - {EPS}), y -> named_struct('doc_id', y.doc_id, 'size', y.size, 'copies', y.base + cast(round(y.p) AS bigint)))"
OPEN = f"get(filter(two, y -> y.p >= {EPS} AND y.p <= 1 - {EPS}), 0)"

#: Folds `units`, an array of (size, doc_id, base, p, u, v), into (done: decided documents with their copies, left: the unit still fractional, or null).
ROUNDED = f"""
aggregate(
  units,
  named_struct('done', cast(array() AS array<{DONE}>), 'left', cast(null AS {UNIT})),
  (s, x) -> if(s.left IS NULL,
    named_struct('done', s.done, 'left', named_struct('doc_id', x.doc_id, 'size', x.size, 'base', x.base, 'p', x.p, 'v', x.v)),
    {paired("s.left", "x", "x.u", f"named_struct('done', concat(s.done, {DECIDED}), 'left', {OPEN})")}))
"""


def settled(s: str) -> str:
    """The state with its fractional unit rounded by its own chance; the pool, all documents still to come, takes up what that added or left."""
    after = f"""named_struct(
      'target', {s}.target + ({s}.left.base + {s}.left.p - c) * {s}.left.size, 'size', {s}.size,
      'left', cast(null AS {UNIT}), 'done', concat({s}.done, array(named_struct('doc_id', {s}.left.doc_id, 'size', {s}.left.size, 'copies', c))))"""
    return f"if({s}.left IS NULL, {s}, {let('c', f'{s}.left.base + if({s}.left.v < {s}.left.p, 1L, 0L)', after)})"


def large_rounded(most: float) -> str:
    """SQL that folds a source's `large` documents, from the largest on, into (target, size: of the pool that remains, left: null, done).

    A document comes with the pool's rate. Pairs meet in the pivotal step as long as one is at
    most twice as long as the other; a fractional unit longer than that has no partner of its
    kind left and is settled against the pool.
    """
    unit = "named_struct('doc_id', x.doc_id, 'size', x.size, 'base', base, 'p', rate - base, 'v', x.v)"
    state = lambda left, done: f"named_struct('target', f.target - rate * x.size, 'size', f.size - x.size, 'left', {left}, 'done', {done})"
    none = "array(named_struct('doc_id', x.doc_id, 'size', x.size, 'copies', base))"
    step = f"""if(rate - base < {EPS}, {state("f.left", f"concat(f.done, {none})")},
      if(f.left IS NULL, {state(unit, "f.done")},
        {let("own", unit, paired("f.left", "own", "x.u", state(OPEN, f"concat(f.done, {DECIDED})")))}))"""
    rate = f"least({float(most)}D, greatest(0D, f.target / f.size))"
    body = let("f", f"if(s.left.size > 2 * x.size, {settled('s')}, s)", let("rate", rate, let("base", f"cast(floor(rate + {EPS}) AS bigint)", step)))
    zero = f"named_struct('target', target, 'size', cast(source_size AS bigint), 'left', cast(null AS {UNIT}), 'done', cast(array() AS array<{DONE}>))"
    return f"aggregate(large, {zero}, (s, x) -> {body}, s -> {settled('s')})"


def rounded(units: DataFrame, *by: str) -> DataFrame:
    """Rows (by, r): the units of each group, larger ones first, folded by ROUNDED; so what is left is small."""
    element = F.struct("size", "doc_id", "base", "p", "u", "v")
    return units.groupBy(*by).agg(F.sort_array(F.collect_list(element), asc=False).alias("units")).select(*by, F.expr(ROUNDED).alias("r"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: int = 0) -> DataFrame:
    """For each row: doc_id, size, source_size, target, taken, source, copies.

    size is the number of words ``[^\\x20\\x09-\\x0D]+`` (null or empty text: 0, taken 0). A
    source's rows share the rate target / source_size; its whole part is copied as it is, and
    its fraction is rounded to 0 or 1 by the pivotal method, weighted by size: what a source
    takes differs from its target by the last unit's share only. All chances come from hashes of identifier and seed: reruns agree on any cluster.
    A null source is a source. Repeated rows are rounded each on its own. An empty table
    gives an empty result. Other columns are ignored.

    Every document goes through pivotal steps. First each source's large documents meet from
    the largest on, in pairs of like size; the rate of all shorter ones makes up for a
    residual that has no partner. Then blocks of about FAN_IN documents of a source and like
    sizes, dealt by a hash, are rounded each in one task; each leaves at most one fractional
    unit. The residuals of FAN_IN blocks meet in the next level of the tree, and at its root
    those of all size classes of the source.
    """
    spark = docs.sparkSession
    workspace = Workspace(spark, "mixing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"))
    sizes = workspace.write(rows, "sizes")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    targets = workspace.write(source_targets(sizes, workspace, most, weights).withColumn("key", key).withColumn("bar", F.greatest(F.least("source_size", "target") / 256, F.col("source_size") / 4096)), "targets")
    units = sizes.select("doc_id", key.alias("key"), "size")

    # large: 4096 documents of a source at most, since each holds more than that share of its words
    large = joined_small(units, targets, "key", "doc_id").where("size > bar").withColumns({"u": uniform(seed, "doc_id"), "v": uniform(seed + 2, "doc_id")})
    large = large.groupBy("key", "target", "source_size").agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "u", "v")), asc=False).alias("large"))
    large = workspace.write(large.select("key", F.expr(large_rounded(most)).alias("r")), "large")
    pool = targets.join(large.select("key", F.col("r.target").alias("pool_target"), F.col("r.size").alias("pool_size")), "key", "left")
    rate = F.try_divide(F.coalesce("pool_target", "target"), F.coalesce("pool_size", "source_size"))
    rate = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.coalesce(rate, F.lit(0.0))))
    base = F.floor(rate + EPS)
    pool = workspace.write(pool.select("key", "bar", base.alias("base"), F.when(rate - base <= EPS, 0.0).otherwise(rate - base).alias("p")), "pool")
    classes = F.floor(F.log2(F.col("size") + 1) * 8).cast("int")
    small = joined_small(units, pool, "key", "doc_id").where("size <= bar").withColumn("class", classes)
    counts = workspace.write(small.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / FAN_IN)), "classes")
    most_blocks = counts.agg(F.max("blocks")).first()[0] or 1
    levels = ceil(log(most_blocks, FAN_IN) - EPS)

    # the number of blocks of a class depends on its count, so rows meet their class's count first
    open_ = joined_small(small.where("p > 0 and size > 0"), counts.select("key", "class", "blocks"), ["key", "class"], "doc_id")
    open_ = open_.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "blocks"))
    node = rounded(open_.withColumns({"u": uniform(seed + 1, "doc_id"), "v": uniform(seed + 2, "doc_id")}), "key", "class", "block")
    parts = [large.select("key", F.explode("r.done").alias("x")).select("key", "x.*")]
    for level in range(levels + 2):
        node = workspace.write(node, f"level-{level}")
        parts.append(node.select("key", F.explode("r.done").alias("x")).select("key", "x.*"))
        residual = node.where("r.left IS NOT NULL").select("key", "class", F.floor(F.col("block") / FAN_IN).alias("block"), "r.left.*")
        if level > levels:
            parts.append(residual.select("key", "doc_id", "size", (F.col("base") + (F.col("v") < F.col("p")).cast("int")).alias("copies")))
            break
        residual = residual.withColumn("u", uniform(seed + 3 + level, "doc_id"))
        if level < levels:
            node = rounded(residual, "key", "class", "block")
        else:  # the root of each source
            node = rounded(residual, "key").select("key", F.lit(0).alias("class"), F.lit(0).cast("long").alias("block"), "r")
    parts.append(small.where("p = 0 or size = 0").select("key", "doc_id", "size", F.when(F.col("size") > 0, F.col("base")).otherwise(0).alias("copies")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = joined_small(out, targets.select("key", "source", "source_size", "target"), "key", "doc_id")
    copies = F.col("copies").cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.alias("copies"))
