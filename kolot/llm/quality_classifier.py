"""Quality by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolot.llm.common import mixed, text_or_empty, word_hashes

#: Buckets of words, the last of which counts words that repeat the one before them; buckets of three characters.
WORDS, TRIGRAMS = 2048, 2048
DIMS = WORDS + TRIGRAMS
#: Documents whose vectors are held at once.
BLOCK = 256


def _terms(text: str) -> np.ndarray:
    """Counts of a text's terms: hashed words as they are written, and hashed runs of three characters over words one blank apart.

    Of a word that comes several times in a row, the repetitions count as one term of their
    own, whatever the word: text that stammers shares it, as it shares no word.
    """
    out = np.zeros(DIMS, np.float32)
    words = text.encode("utf-8", "replace").split()
    if words:
        hashes = word_hashes(words)
        buckets = (hashes % np.uint64(WORDS - 1)).astype(np.int64)
        buckets[1:][hashes[1:] == hashes[:-1]] = WORDS - 1
        out[:WORDS] = np.bincount(buckets, minlength=WORDS)
        points = np.frombuffer(f" {b' '.join(words).decode()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        three = mixed(points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:])
        out[WORDS:] = np.bincount((three % np.uint64(TRIGRAMS)).astype(np.int64), minlength=TRIGRAMS)
    return out


def _raw(texts: list[str]) -> np.ndarray:
    return np.stack([_terms(t) for t in texts]) if texts else np.zeros((0, DIMS), np.float32)


def _weighted(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped and weighed by rarity; words and characters each scaled to a length of one."""
    both = np.sqrt(raw) * idf
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return np.concatenate([unit(both[:, :WORDS]), unit(both[:, WORDS:])], axis=1).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    k: int = 15

    def project(self, raw: np.ndarray) -> np.ndarray:
        out = _weighted(raw, self.idf) @ self.axes
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def nearest(self, cosines: np.ndarray) -> np.ndarray:
        """Places of the k greatest cosines of each row; of equal ones the first, by identifier."""
        k = min(self.k, cosines.shape[1])
        least = np.partition(cosines, -k, axis=1)[:, -k, None]
        sure, tied = cosines > least, cosines == least
        take = sure | tied & (np.cumsum(tied, axis=1) <= k - sure.sum(1, keepdims=True))
        return np.nonzero(take)[1].reshape(len(cosines), k)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for at in range(0, len(texts), BLOCK):
            raw = _raw(texts[at : at + BLOCK])
            cosines = self.project(raw) @ self.vectors.T
            near = self.nearest(cosines)
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 1e-6).astype(np.float64) ** 16
            vote = (weight * self.labels[near]).sum(1) / weight.sum(1)
            out[at : at + BLOCK] = np.where(raw[:, :WORDS].any(1), np.clip(vote, 0, 1), 0)
        return out


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "terms": [_packed(_terms(t)) for t in batch["text"]]})


def _packed(counts: np.ndarray) -> bytes:
    """The buckets that occur and their counts, as 32-bit integers."""
    at = np.nonzero(counts)[0]
    return np.concatenate([at, counts[at]]).astype(np.uint32).tobytes()


def _unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), DIMS), np.float32)
    for row, data in zip(out, rows, strict=True):
        at, counts = np.frombuffer(data, np.uint32).reshape(2, -1)
        row[at] = counts
    return out


def latent_axes(weighted: np.ndarray, dims: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """The first right singular vectors, by subspace iteration: only thin matrices besides the given one."""
    dims = min(dims, *weighted.shape)
    basis = np.random.default_rng(seed).normal(size=(weighted.shape[1], min(2 * dims, *weighted.shape))).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    _, _, axes = np.linalg.svd(weighted @ basis, full_matrices=False)
    return np.ascontiguousarray((basis @ axes.T)[:, :dims])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labelled: int = 4000, dims: int = 48) -> Model | None:
    """Learns from at most `most_labelled` labelled rows, those of the least hashes of their identifiers; None without any.

    Null labels and identifiers are left out; of repeated labels of an identifier the least
    holds, of repeated documents any one, and other columns are ignored. Texts count whole,
    however long; a null text is an empty one. Every document is later compared with every
    labelled vector, so the bound fixes the broadcast (most_labelled * dims * 4 bytes) and
    the work for each document.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # repeated identifiers: one text
    rows = texts.mapInPandas(_rows, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, label double, terms binary").toPandas().sort_values("doc_id", kind="stable")
    if rows.empty:
        return None
    terms, labels_ = rows["terms"].tolist(), rows["label"].to_numpy()
    held = np.bincount(np.concatenate([np.frombuffer(t, np.uint32)[: len(t) // 8] for t in terms]).astype(np.int64), minlength=DIMS)
    idf = (np.log((1 + len(terms)) / (1 + held)) + 1).astype(np.float32)
    weighted = np.concatenate([_weighted(_unpacked(terms[k : k + BLOCK]), idf) for k in range(0, len(terms), BLOCK)])
    axes = latent_axes(weighted, dims)
    vectors = weighted @ axes
    return Model(idf, axes, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9), labels_)


def score(text: Column, model: Model | None, spark) -> Column:
    """0 to 1, higher where label 1 is likelier. Null, empty and blank texts: 0. Without a model: 0.5. Repeated rows score alike."""
    if model is None:
        return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0, 0.5).otherwise(0.0)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(held.value.scores(texts.fillna("").tolist()))

    return scored(text)
