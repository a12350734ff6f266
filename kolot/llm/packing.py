"""Token ids in binary rows of one length, packed best fit decreasing."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kolot.llm.common import NO_ID, arrow_rows, known_id, text_or_empty


@lru_cache(maxsize=4)
def encoder(data: bytes, pattern: str):
    """A byte-level BPE encoder from a ranks file's content; one for each worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class CapacityTree:
    """Open rows by what they have free, over a segment tree of the capacities 0 to `length`.

    A node tells whether any row below it has that capacity, so the least sufficient one is
    found in a walk up and down the tree.
    """

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.any = np.zeros(2 * self.size, np.int64).tolist()
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        at = free + self.size
        while at:
            self.any[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least capacity of `need` or more, and that capacity; taken out of the tree."""
        at = need + self.size
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        free = at - self.size
        row = self.rows[free].pop()
        while at:
            self.any[at] -= 1
            at >>= 1
        return row, free


def best_fit_decreasing(lengths: list[int], length: int) -> list[list[int]]:
    """Indices of pieces for each row; no piece is longer than `length`. Equal pieces keep their order."""
    tree, rows = CapacityTree(length), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        row, free = found or (len(rows), length)
        if found is None:
            rows.append([])
        rows[row].append(i)
        tree.add(free - lengths[i], row)
    return rows


def pack(texts: DataFrame, ranks: bytes, pattern: str, length: int = 2048, window_tokens: int = 4_000_000) -> DataFrame:
    """Packed rows of the table (doc_id, text): see `pack_documents`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks, pattern).encode_ordinary
        kind = np.uint16 if len(ranks.splitlines()) <= 1 << 16 else np.uint32
        pieces: list[tuple[int, int, np.ndarray]] = []
        held = 0

        def flush() -> Iterator[pd.DataFrame]:
            out = []
            for row in best_fit_decreasing([len(p[2]) for p in pieces], length):
                own = [pieces[i] for i in row]
                lengths = [len(p[2]) for p in own]
                ids = np.concatenate([p[2] for p in own])
                ends = np.cumsum([0, *lengths])
                positions = np.arange(len(ids)) - np.repeat(ends[:-1], lengths)
                data = ids.astype(kind).tobytes()
                out.append((hashlib.blake2b(data + repr([p[:2] for p in own]).encode(), digest_size=12).hexdigest(), len(ids), [p[0] for p in own], [p[1] for p in own], ends.tolist(), np.nonzero(positions == 0)[0].tolist(), data))
                if len(out) == 500:
                    yield pd.DataFrame(out, columns=COLUMNS)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=COLUMNS)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array(encode(text), kind)
                for at in range(0, len(ids), length):
                    pieces.append((doc_id, at, ids[at : at + length]))
                held += len(ids)
                if held >= window_tokens:
                    yield from flush()
                    pieces, held = [], 0
        if pieces:
            yield from flush()

    return texts.mapInPandas(run, SCHEMA)


COLUMNS = ["pack_id", "n_tokens", "doc_ids", "offsets", "cu_seqlens", "position_resets", "ids"]
SCHEMA = "pack_id string, n_tokens int, doc_ids array<long>, offsets array<int>, cu_seqlens array<int>, position_resets array<int>, ids binary"


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, length: int = 2048, window_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each packed row of at most `length` ids.

    pack_id: hash of its content; n_tokens; doc_ids and offsets: document and place in that
    document's ids of each segment; cu_seqlens: 0 and the segments' cumulative lengths;
    position_resets: where positions start again from 0; ids: little-endian, two bytes each up
    to 65,536 ids, else four.

    Documents longer than `length` are cut into full pieces and a remainder, each a segment
    with its offset, so nothing is lost. Null and empty texts have no ids and are in no row.
    Each task packs what it reads, in windows of `window_tokens` ids that bound its memory:
    no shuffle, and a lost task is simply run again. Repeated rows, and those with a null
    identifier, are packed each. An empty
    table gives an empty result. Other columns are ignored.
    """
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    texts = docs.select(known_id(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).where("text <> ''")
    packed = pack(texts, ranks, pattern, length, window_tokens)
    return packed.withColumn("doc_ids", F.transform("doc_ids", lambda i: F.when(i != NO_ID, i)))


def write_matrices(packed: DataFrame, path: str, length: int = 2048, pad_id: int = 0, rows_per_matrix: int = 256) -> DataFrame:
    """Writes packed rows as Parquet of id matrices and returns it read again; an empty input writes an empty table.

    A row is one matrix: `rows`, `length` and `width` (bytes of an id), ids of rows x length
    little-endian and filled up with pad_id, and for each of its rows pack_ids, n_tokens,
    doc_ids, offsets, cu_seqlens (0 and the cumulative lengths of the segments) and
    position_resets. A task writes matrices of up to `rows_per_matrix` rows of what it has packed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def matrix(rows: list[dict]) -> pa.RecordBatch:
            width = len(rows[0]["ids"]) // rows[0]["n_tokens"]
            pad = pad_id.to_bytes(width, "little")
            ids = b"".join(r["ids"] + pad * (length - r["n_tokens"]) for r in rows)
            one = {"rows": len(rows), "length": length, "width": width, "pack_ids": [r["pack_id"] for r in rows], "ids": ids} | {c: [r[c] for r in rows] for c in ROW_COLUMNS}
            return pa.RecordBatch.from_pylist([one], schema)

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == rows_per_matrix:
                    yield matrix(held)
                    held = []
        if held:
            yield matrix(held)

    ints = pa.list_(pa.list_(pa.int32()))
    schema = pa.schema([("rows", pa.int32()), ("length", pa.int32()), ("width", pa.int32()), ("pack_ids", pa.list_(pa.string())), ("n_tokens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.list_(pa.int64()))), ("offsets", ints), ("cu_seqlens", ints), ("position_resets", ints), ("ids", pa.binary())])
    fields = "rows int, length int, width int, pack_ids array<string>, n_tokens array<int>, doc_ids array<array<long>>, offsets array<array<int>>, cu_seqlens array<array<int>>, position_resets array<array<int>>, ids binary"
    spark = packed.sparkSession
    with arrow_rows(spark, 1000):
        packed.mapInArrow(run, fields).write.parquet(path)
    return spark.read.schema(fields).parquet(path)


ROW_COLUMNS = ["n_tokens", "doc_ids", "offsets", "cu_seqlens", "position_resets"]


def rows_of(matrices: DataFrame) -> DataFrame:
    """The rows of written matrices, without their padding: pack_id and the columns of `pack_documents`."""
    one = matrices.select("length", "width", "ids", *ROW_COLUMNS, F.posexplode("pack_ids").alias("at", "pack_id"))
    cell = {c: F.get(c, F.col("at")) for c in ROW_COLUMNS}
    ids = F.substring("ids", F.col("at") * F.col("length") * F.col("width") + 1, cell["n_tokens"] * F.col("width"))
    return one.select("pack_id", *(cell[c].alias(c) for c in ROW_COLUMNS), ids.alias("ids"))
