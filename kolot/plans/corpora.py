"""Mining several corpora in their order: lines, one of each skeleton across all of them, a sample of each, and the papers that go with it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kolot.plans import mining
from kolot.sources import corpus as C


@dataclass(frozen=True)
class Corpus:
    """A corpus of lines: plain or gzip files, of which the first `cap_bytes` are read where that is set, and how many sentences are wanted of it."""

    key: str
    path: str
    target: int
    cap_bytes: int | None = None
    title: str = ""
    collection: str = ""
    version: str = ""
    url: str = ""
    licence: str = ""
    cite: str = ""


@dataclass(frozen=True)
class Mined:
    """What `mine_corpora` gives: sampled (corpus, category, text), and (corpus, candidates) before sampling."""

    sampled: DataFrame
    candidates: DataFrame


def lines(spark: SparkSession, corpora: list[Corpus]) -> DataFrame:
    """(corpus, corpus_order, line_no, text) of all corpora; gzip files may break off."""

    def read(order: int, c: Corpus) -> DataFrame:
        if c.cap_bytes is not None or c.path.endswith(".gz"):
            return C.read_cut_gzip(spark, c.path, c.key, order, c.cap_bytes)
        return C.read_lines(spark, c.path, c.key, order)

    return reduce(DataFrame.unionByName, [read(k, c) for k, c in enumerate(corpora)])


def mine_corpora(spark: SparkSession, corpora: list[Corpus], seed: int = 0, limits: mining.Limits = mining.Limits()) -> Mined:
    """One skeleton is kept once across every corpus, in the order given; of each corpus its target is sampled in turns over categories."""
    mined = mining.mine(lines(spark, corpora), limits)
    return Mined(mining.sample(mined, {c.key: c.target for c in corpora}, seed), mined.groupBy("corpus").agg(F.count(F.lit(1)).alias("candidates")))


def sources(spark: SparkSession, corpora: list[Corpus], mined: Mined) -> DataFrame:
    """A row for each corpus as `manifest` wants it: digest and bytes of what was read, and where it comes from."""
    own = spark.createDataFrame([(c.key, c.collection, c.version, c.url, c.licence, c.cap_bytes is not None) for c in corpora], "corpus string, opus string, version string, url string, licence string, capped boolean")
    found = reduce(DataFrame.unionByName, [C.digests(spark, c.path, c.cap_bytes).groupBy().agg(F.min("sha256").alias("sha256"), F.sum("bytes").alias("bytes")).withColumn("corpus", F.lit(c.key)) for c in corpora])
    return own.join(found, "corpus").join(mined.candidates, "corpus", "left").fillna(0, ["candidates"])


def attribution(corpora: list[Corpus]) -> str:
    """Markdown that names each corpus, its licence and how it asks to be cited."""
    rows = [f"| `{c.key}.txt` | {c.title} | {c.licence} | [{c.collection} {c.version}]({c.url}) |" for c in corpora]
    return "\n".join(["# Corpora", "", "Samples of sentences, without readings, each under the licence of its corpus.", "", "| File | Corpus | Licence | Source |", "|---|---|---|---|", *rows, "", "Citations:", "", *(f"- {c.title}: {c.cite}" for c in corpora), ""])
