"""Readers and writers: golden rows, sectioned sentences, gzip lines, digests and manifests.

Text files are read one record for each file where line numbers matter: such files are made
by hand and small. Corpora are read by lines.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kolot.config import Config

COLUMNS = ["input", "expected", "config", "note"]


class CorpusError(ValueError):
    """A malformed file; the message begins with file:line."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, lineno, line) of whole text files, without a carriage return at the end."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value"))
    return files.select("file", F.posexplode(F.split("value", "\n")).alias("at", "line")).select("file", (F.col("at") + 1).alias("lineno"), F.regexp_replace("line", "\r$", "").alias("line"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(file, lineno, input, expected, config, note) of TSV files: blank lines and those with # are left out, cells trimmed, no quoting.

    A row `problem` tells of lines with a wrong number of cells, an empty input or a wrong
    header; `checked` raises for it.
    """
    rows = _lines(spark, path).where("trim(line) <> '' AND NOT startswith(line, '#')")
    cells = F.transform(F.split("line", "\t"), lambda c: F.trim(c))
    rows = rows.withColumn("cells", cells).withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("lineno")))
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    problem = (
        F.when((F.col("n") == 1) & (F.array_join("cells", ",") != ",".join(COLUMNS)), "wrong header")
        .when((F.size("cells") < 2) | (F.size("cells") > 4), "2 to 4 cells are needed")
        .when(cell(0) == "", "the input is empty")
    )
    return rows.withColumn("problem", problem).where("n > 1 OR problem IS NOT NULL").select("file", "lineno", *(cell(i).alias(c) for i, c in enumerate(COLUMNS)), "problem")


def checked(golden: DataFrame) -> DataFrame:
    """Golden rows without problems; CorpusError names the first by file and line. Settings are parsed too."""
    first = golden.where("problem IS NOT NULL").orderBy("file", "lineno").first()
    if first:
        raise CorpusError(f"{first['file']}:{first['lineno']}: {first['problem']}")
    for row in golden.select("config").distinct().collect():  # a handful of settings, whatever the rows
        Config.from_spec(row["config"])
    return golden.drop("problem")


def read_sectioned(spark: SparkSession, path: str) -> DataFrame:
    """(file, lineno, category, text): a line "# category: x (n)" names the category of those that follow it."""
    rows = _lines(spark, path)
    name = F.nullif(F.regexp_extract("line", r"^# category: (\S+)", 1), F.lit(""))
    rows = rows.withColumn("category", F.last(name, ignorenulls=True).over(Window.partitionBy("file").orderBy("lineno")))
    return rows.where("trim(line) <> '' AND NOT startswith(line, '#')").select("file", "lineno", "category", F.trim("line").alias("text"))


def read_lines(spark: SparkSession, path: str, corpus: str, order: int = 0) -> DataFrame:
    """(corpus, corpus_order, line_no, text) of plain or gzip text; bytes that are no UTF-8 become U+FFFD. line_no rises within a file and is not dense."""
    return spark.read.text(path).select(F.lit(corpus).alias("corpus"), F.lit(order).alias("corpus_order"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("text"))


def read_cut_gzip(spark: SparkSession, path: str, corpus: str, order: int = 0, cap_bytes: int | None = None) -> DataFrame:
    """`read_lines` of gzip files that may break off, or of the first `cap_bytes` of each: the whole lines before the cut, numbered from 0.

    A file without one readable line is a CorpusError. A file is one record of a task, which a
    cap bounds; a gzip stream can't be split anyway.
    """
    content = F.substring("content", 1, cap_bytes) if cap_bytes is not None else F.col("content")
    files = spark.read.format("binaryFile").load(path).select("path", content.alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                text, cut = _inflated(data)
                found = re.split("\r\n|\r|\n", text.decode("utf-8", "replace"))
                if cut or not found[-1]:
                    found.pop()
                if cut and not found:
                    raise CorpusError(f"{name}: not readable as gzip")
                yield pa.RecordBatch.from_arrays([pa.array(range(len(found)), pa.int64()), pa.array(found, pa.string())], ["line_no", "text"])

    rows = files.mapInArrow(run, "line_no long, text string")
    return rows.select(F.lit(corpus).alias("corpus"), F.lit(order).alias("corpus_order"), "line_no", "text")


def _inflated(data: bytes) -> tuple[bytes, bool]:
    """What can be unpacked of gzip members one after another, and whether the last breaks off."""
    out = []
    while data:
        one = zlib.decompressobj(31)
        try:
            out.append(one.decompress(data))
        except zlib.error:
            return b"".join(out), True
        if not one.eof:
            return b"".join(out), True
        data = one.unused_data
    return b"".join(out), not out


def digests(spark: SparkSession, path: str, cap_bytes: int | None = None) -> DataFrame:
    """(path, sha256, bytes) of files, or of the first `cap_bytes` of each."""
    files = spark.read.format("binaryFile").load(path)
    content = F.substring("content", 1, cap_bytes) if cap_bytes is not None else F.col("content")
    return files.select("path", F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("bytes"))


def write_sectioned(sampled: DataFrame, path: str) -> None:
    """(corpus, category, text) as one text file for each corpus, sections by category."""
    counted = sampled.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("corpus", "category")))
    first = F.row_number().over(Window.partitionBy("corpus", "category").orderBy("text")) == 1
    lines = counted.withColumn("value", F.when(first, F.concat(F.lit("\n# category: "), "category", F.lit(" ("), "n", F.lit(")\n"), "text")).otherwise(F.col("text")))
    lines.repartition("corpus").sortWithinPartitions("corpus", "category", "text").select("corpus", "value").write.partitionBy("corpus").text(path)


def manifest(sampled: DataFrame, sources: DataFrame, seed: int, generated: str | None = None, note: str = "") -> str:
    """JSON with the day, seed, note and, for each corpus, all columns of sources and the counts of its sample.

    sources is a row for each corpus: (corpus, sha256, bytes), and what is known of opus,
    version, url, licence, capped and candidates.
    """
    by = sampled.groupBy("corpus", "category").agg(F.count(F.lit(1)).alias("n")).groupBy("corpus").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("categories"), F.sum("n").alias("sampled"))
    rows = sources.join(by, "corpus", "left").orderBy("corpus").collect()
    own = [c for c in sources.columns if c not in ("corpus", "bytes")]
    corpora = {r["corpus"]: {c: r[c] for c in own} | {"fetched_bytes": r["bytes"], "sampled": r["sampled"] or 0, "categories": r["categories"] or {}} for r in rows}
    return json.dumps({"generated": generated or date.today().isoformat(), "seed": seed, "note": note, "corpora": corpora}, ensure_ascii=False, indent=1)


def verify(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Corpora of a manifest (corpus, sha256, bytes) whose file is missing or differs."""
    found = found.select("corpus", F.col("sha256").alias("found_sha256"), F.col("bytes").alias("found_bytes"))
    return recorded.join(found, "corpus", "left").where("found_sha256 IS NULL OR found_sha256 <> sha256 OR found_bytes <> bytes")
