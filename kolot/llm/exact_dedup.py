"""Exact deduplication by a log-structured merge index of text digests, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolot.llm.common import HOT, Workspace, bit_filter, joined_salted, maybe_in, tested, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
#: The filter over digests has 2 ** FILTER slots, whatever the input.
FILTER = 24


def sha256(normalised: Column) -> Column:
    return F.sha2(normalised.cast("binary"), 256)


def better(n_points: str = "n_points", doc_id: str = "doc_id") -> Column:
    """Orders rows of one digest: the least has the most code points, then the smallest identifier, null last."""
    return F.struct((-F.col(n_points)).alias("fewer"), F.col(doc_id).isNull().alias("unknown"), F.col(doc_id).alias("doc_id"))


class DigestIndex:
    """Memtables, sorted runs with a filter, and a compacted level of (digest -> row that stays, copies).

    * A memtable is what one task has read. `flush` sorts it by digest and writes it as run
      files of at most `memtable_rows`, each with its range and a Bloom filter of its digests
      for `lookup`.
    * The runs' filter has a bit for each slot of digests that more than one entry falls into.
      An entry whose slot has none is alone in all runs: it stays, and needs no merge.
    * `compact` merges the others only: of each digest the longest original text stays, then
      the smallest identifier. Each task first merges what its sorted runs hold of a digest, so
      a digest shared by a third of all rows costs no more than others.
    """

    def __init__(self, workspace: Workspace, memtable_rows: int = 50_000):
        self.workspace = workspace
        self.options = {"maxRecordsPerFile": str(memtable_rows), "parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(memtable_rows)}
        self.runs: list[DataFrame] = []

    def flush(self, entries: DataFrame) -> None:
        """Rows (doc_id, n_points, digest, ...) become sorted run files."""
        self.runs.append(self.workspace.write(entries.sortWithinPartitions("digest"), f"runs-{len(self.runs)}", **self.options))

    def entries(self) -> DataFrame:
        out = self.runs[0]
        for run in self.runs[1:]:
            out = out.unionByName(run)
        return out

    def lookup(self, digests: list[str]) -> DataFrame:
        """Entries of a few digests; the runs' filters and ranges are pushed to the scan."""
        return self.entries().where(F.col("digest").isin(digests))

    def filter(self) -> DataFrame:
        """The bits of slots with more than one entry: small integers are counted, no digest is shuffled."""
        slot = F.xxhash64("digest").bitwiseAND((1 << FILTER) - 1).cast("int")
        full = self.entries().groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(63))
        return self.workspace.write(full.groupBy(F.shiftright("slot", 6).alias("_block")).agg(F.bit_or(bit).alias("_word")), "filter")

    def probed(self) -> DataFrame:
        """Entries with `shared`: whether the filter leaves it possible that another entry has the digest."""
        return tested(self.entries(), "digest", self.filter(), "shared", FILTER)

    def compact(self, probed: DataFrame) -> DataFrame:
        """One row (digest, keep_id, group_size) for each digest that more than one entry has."""
        merged = probed.where("shared").groupBy("digest").agg(F.min(better()).alias("best"), F.count(F.lit(1)).alias("group_size"))
        return self.workspace.write(merged.where("group_size > 1").select("digest", F.col("best.doc_id").alias("keep_id"), "group_size"), "level-1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256 (of the text without white space).

    Texts are equal when identical without the characters of ``[\\x20\\x09-\\x0D]``; null
    counts as empty, so null, empty and blank texts form one group. Of equal texts the one
    with most code points stays, then the smallest identifier, of whatever type that can be
    ordered. Each input row gives one output row; rows repeated with their identifier are all
    marked kept if that identifier stays. An empty table gives an empty result. Other columns
    are ignored, whatever their names. Of equal texts of one length a null identifier comes
    last; it can stay, as null.

    Digests that occur more than once are hits: their rows' texts are compared byte for
    byte (least against greatest of each digest, aggregated before the shuffle). Where a
    digest has several texts, its rows are grouped anew by digest and text. Rows of a digest
    with many copies are dealt over several tasks for the last join.
    """
    workspace = Workspace(docs.sparkSession, "exact-dedup")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    normalised = F.regexp_replace("text", SPACE, "")
    index = DigestIndex(workspace)
    same = digest is sha256
    # the lambda binds the normalised text once, so that it is not computed for each digest
    index.flush(
        rows.select("doc_id", F.char_length("text").cast("long").alias("n_points"), F.transform(F.array(normalised), lambda x: F.struct(digest(x).alias("digest"), (F.lit(None).cast("string") if same else sha256(x)).alias("sha")))[0].alias("d"))
        .select("doc_id", "n_points", F.col("d.digest").alias("digest"), F.col("d.sha").alias("sha"))
    )
    entries = index.probed()
    level = index.compact(entries)
    hot = workspace.write(bit_filter(level.where(F.col("group_size") > HOT), "digest"), "hot")
    found = joined_salted(entries.where("shared"), level, "digest", hot, "doc_id", "n_points", how="left")
    sha = F.col("digest") if same else F.col("sha")
    alone = F.col("group_size").isNull()
    columns = ["doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), sha.alias("text_sha256"), "digest"]
    merged = workspace.write(found.select(*columns), "merged")
    out = entries.where("NOT shared").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), sha.alias("text_sha256"), "digest").unionByName(merged)

    hit_bits = workspace.write(bit_filter(merged.where("group_size > 1"), "doc_id"), "hits")
    texts = maybe_in(rows, "doc_id", hit_bits).select("doc_id", F.char_length("text").cast("long").alias("n_points"), normalised.alias("normalised")).select("*", digest(F.col("normalised")).alias("digest"))
    differ = texts.groupBy("digest").agg(F.min("normalised").alias("least"), F.max("normalised").alias("greatest")).where("least < greatest")
    collided = workspace.write(differ.select("digest"), "collided")
    if not collided.isEmpty():
        again = texts.join(collided, "digest", "left_semi")
        split = again.groupBy("digest", "normalised").agg(F.min(better()).alias("best"), F.count(F.lit(1)).alias("group_size"))
        regrouped = again.join(split, ["digest", "normalised"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", sha256(F.col("normalised")).alias("text_sha256"), "digest")
        out = out.join(collided, "digest", "left_anti").unionByName(regrouped)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS n FROM documents),
g AS (SELECT doc_id, n, row_number() OVER (PARTITION BY n ORDER BY length(text) DESC, doc_id) AS k, count(*) OVER (PARTITION BY n) AS group_size,
      first_value(doc_id) OVER (PARTITION BY n ORDER BY length(text) DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g
"""
