"""The corpus pipeline: toxic documents go, copies and near copies leave one document each, sources are mixed, texts become ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of documents. Decisions are joined by identifier and text, so documents without an
identifier, or with the same one, are each decided on their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kolot.llm import exact_dedup, mixing, near_dedup, pieces, toxicity
from kolot.llm.common import HOT, Workspace, bit_filter, joined_salted, known_id, scratch, table, tested

#: Documents that score this or more are rejected.
TOXIC = 0.7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under TOXIC; null and empty texts have none and stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(F.col("text"), model, spark) < TOXIC)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Rows (key, row): a hash of these columns, which unlike an identifier is never null nor shared by different documents."""
    return docs.select(F.xxhash64(*(F.col(f"`{c}`") for c in columns)).alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays, the longest as written, then that with the smallest identifier, null last; null, empty and blank texts are equal. Only rows that have a copy are shuffled."""
    workspace = Workspace(spark, "drop-copies")
    rows = keyed(docs, *docs.columns)
    own = F.struct(F.col("row.doc_id").isNull().alias("unknown"), F.col("row.doc_id").alias("doc_id"), "key")
    found = exact_dedup.exact_dedup(rows.select(own.alias("id"), "row.text"), id_col="id")
    found = workspace.write(found.where("group_size > 1").select("doc_id.key", "kept").distinct(), "copies")
    rows = tested(rows, "key", workspace.write(bit_filter(found, "key"), "bits"), "copied")
    once = rows.where("copied").join(found, "key", "left").where("coalesce(kept, true)").dropDuplicates(["key"])  # equal rows have one key
    return rows.where("NOT copied").select("row.*").unionByName(once.select("row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest identifier stays, null first. Only rows of groups are shuffled."""
    workspace = Workspace(spark, "drop-near-copies")
    rows = keyed(docs, "doc_id", "text")
    groups = near_dedup.near_groups(rows.select("key", "row.text"), id_col="key").select(F.col("doc_id").alias("key"), "component_id").distinct()
    ids = rows.select("key", known_id("row.doc_id").alias("id")).distinct()
    groups = workspace.write(groups.join(ids, "key"), "groups")
    least = groups.groupBy("component_id").agg(F.min(F.struct("id", "key"))["key"].alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # the members of a group are rows of three numbers, and a hot group's are dealt out
    hot = workspace.write(bit_filter(least.where(F.col("n") > HOT), "component_id"), "hot")
    others = workspace.write(joined_salted(groups, least, "component_id", hot, "key").where("key <> least").select("key"), "others")
    rows = tested(rows, "key", workspace.write(bit_filter(others, "key"), "bits"), "grouped")
    return rows.where("NOT grouped").select("row.*").unionByName(rows.where("grouped").join(others, "key", "left_anti").select("row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those taken 0 times go. Rows equal in all columns are one row that is taken as often as they are together."""
    rows = keyed(docs, *docs.columns)
    taken = mixing.mix_sources(rows.select("key", "row.text", "row.source"), id_col="key").where("copies > 0").groupBy(F.col("doc_id").alias("key")).agg(F.sum("copies").alias("times"))
    return rows.dropDuplicates(["key"]).join(taken, "key").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document; copies that the mix made give a row each."""
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", reject_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix), ("sentencepiece", encode)]

#: A learned model, hashed rounding and a tokenizer can't be stated in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written before the next reads it, and what its operators wrote on the way is removed. An empty table gives an empty result."""
    workspace = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = workspace.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
