"""What the operators of this subpackage share: the word pattern, the shared folder, text columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in Java's and Python's syntax alike; ``bytes.split()`` cuts UTF-8 at the same places.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own on a local master (one machine, tests); elsewhere an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            folder = tempfile.mkdtemp(prefix="kolot-")
            spark.sparkContext.setCheckpointDir(folder)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder.rstrip("/")


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs inside hands Python workers at most so many rows at once: a bound on the memory of whole texts there and in the JVM."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_open: list[Workspace] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the workspaces that operators make inside it: results must be consumed (written, collected) before it ends."""
    before = len(_open)
    try:
        yield
    finally:
        for workspace in _open[before:]:
            workspace.remove()


class Workspace:
    """A new subfolder of the shared folder, in which an operator's intermediate tables are written.

    A written table cuts lineage and outlives any executor. The tables stay until the
    caller has consumed the result: `scratch` removes them then, or `remove` one by one.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _open.append(self)

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.path}/{name}"
        with arrow_rows(self.spark, 1000):
            df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if self in _open:
            _open.remove(self)


def fold(id_col: str | Column, n: int) -> Column:
    """crc32 of the identifier as text, mod n."""
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(id_col.cast("string").cast("binary")) % n


#: Stands for a null identifier where rows pass through pandas, which has no null integer, or are joined. There, in op3, op5 and op10, this least of all identifiers counts as null.
NO_ID = -(2**63)


def known_id(id_col: str) -> Column:
    """The identifier as a 64-bit integer, NO_ID for null; `null_back` turns it round."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))


def null_back(df: DataFrame, *columns: str) -> DataFrame:
    """NO_ID as null again."""
    return df.withColumns({c: F.when(F.col(c) != NO_ID, F.col(c)) for c in columns})


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of `size` consecutive words; for fewer words one of them all; none for none."""
    size = min(size, len(hashes))
    if not size:
        return hashes
    n = len(hashes) - size + 1
    acc = np.full(n, size, np.uint64)
    for k in range(size):
        acc = mixed(acc + hashes[k : k + n])
    return acc


def joined_small(rows: DataFrame, side: DataFrame, key: str | list[str], spread: str, most: int = 50_000, salts: int = 32) -> DataFrame:
    """rows joined with a side of one row for each key, without gathering a frequent key in one task.

    The side is counted: up to `most` rows it is broadcast. A larger one is repeated for each
    salt, and a key's rows are dealt over the salts by a hash of the column `spread`.
    """
    keys = [key] if isinstance(key, str) else key
    if side.count() <= most:
        return rows.join(F.broadcast(side), keys)
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


#: A key with more rows than this is dealt over several tasks by `joined_salted`.
HOT = 5_000


def joined_salted(rows: DataFrame, side: DataFrame, key: str | list[str], bits: DataFrame, *spread: str, salts: int = 64, how: str = "inner") -> DataFrame:
    """rows joined with a large side of one row for each key, the rows of hot keys dealt over `salts` tasks by a hash of the columns `spread`.

    bits is a `bit_filter` of the hot keys. Both sides look a key up in it, so a false
    positive is dealt out on both.
    """
    keys = [key] if isinstance(key, str) else key
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(0).cast("int")
    dealt = tested(rows, keys, bits, "_hot").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(tested(side, keys, bits, "_hot").withColumn("_salt", F.explode(copies)).drop("_hot"), [*keys, "_salt"], how).drop("_salt")


def _slot(column: str | list[str], bits_log2: int) -> Column:
    return F.xxhash64(*([column] if isinstance(column, str) else column)).bitwiseAND((1 << bits_log2) - 1)


def bit_filter(keys: DataFrame, column: str | list[str], bits_log2: int = 22) -> DataFrame:
    """Rows (block, word) of a bitmap over hashes of a column, or several: never more than 2 ** (bits_log2 - 6), whatever the input.

    A test against it has false positives, no false negatives. Past its capacity it lets all
    rows pass, so it only ever saves work.
    """
    slot = _slot(column, bits_log2)
    return keys.select(F.shiftright(slot, 6).cast("int").alias("_block"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int")).alias("_bit")).groupBy("_block").agg(F.bit_or("_bit").alias("_word"))


def tested(df: DataFrame, column: str | list[str], bits: DataFrame, name: str, bits_log2: int = 22) -> DataFrame:
    """df with a boolean column: whether a column's value may be among the keys of a `bit_filter`, which is broadcast: its size is bounded."""
    hit = F.expr("coalesce(shiftright(_word, cast(_slot & 63 as int)) & 1, 0)") == 1
    return df.withColumn("_slot", _slot(column, bits_log2)).withColumn("_block", F.shiftright("_slot", 6).cast("int")).join(F.broadcast(bits), "_block", "left").withColumn(name, hit).drop("_slot", "_block", "_word")


def maybe_in(df: DataFrame, column: str, bits: DataFrame, bits_log2: int = 22) -> DataFrame:
    """Rows whose column may be among the keys of a `bit_filter`."""
    return tested(df, column, bits, "_maybe", bits_log2).where("_maybe").drop("_maybe")
