"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolot.llm.common import text_or_empty

LETTERS = re.compile(r"[^\W\d_]+")
BUCKETS_LOG2 = 22
MOST_CACHED = 100_000


def word_terms(word: str) -> list[int]:
    """Buckets of a lower-case word and of its beginnings of 4 and 5 letters, by which inflected forms share."""
    names = ["w" + word]
    if len(word) > 4:
        names.append("4" + word[:4])
    if len(word) > 5:
        names.append("5" + word[:5])
    return [xxhash.xxh3_64_intdigest(x) >> (64 - BUCKETS_LOG2) for x in names]


def text_terms(text: str) -> np.ndarray:
    return np.unique(np.fromiter((t for w in set(LETTERS.findall(text.lower())) for t in word_terms(w)), np.int32))


@dataclass
class Model:
    """score = sigmoid(bias + sum w_i + sum of <v_i, v_j> over pairs) over the terms present."""

    index: dict[int, int]
    bias: float
    w: np.ndarray
    v: np.ndarray
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def present(self, text: str) -> list[int]:
        out: set[int] = set()
        for word in set(LETTERS.findall(text.lower())):
            known = self.cache.get(word)
            if known is None:
                if len(self.cache) >= MOST_CACHED:
                    self.cache.clear()
                known = self.cache[word] = tuple(self.index[t] for t in word_terms(word) if t in self.index)
            if known:
                out.update(known)
        return sorted(out)

    def score(self, text: str) -> float:
        ids = self.present(text)
        v = self.v[ids]
        y = self.bias + self.w[ids].sum() + 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum()
        return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))


def _chi2(hits: np.ndarray, total: np.ndarray, rows: int, pos: float, least_docs: int) -> np.ndarray:
    """How much each term depends on the label among `rows` rows; 0 for terms of too few."""
    expected = total * pos / rows
    chi2 = (hits - expected) ** 2 * rows / np.maximum(expected * (rows - pos) * (1 - total / (rows + 1)), 1e-9)
    return np.where(total >= least_docs, chi2, 0)


def screened(terms: list[np.ndarray], labels: np.ndarray, least_docs: int = 3, least_chi2: float = 24.0, least_pair_chi2: float = 40.0, most: int = 1024) -> list[int]:
    """The terms that depend most on the label, by chi-square; ties by bucket; `most` at most.

    At 24, one term in a million passes by chance. After those come terms that tell only beside
    one of them, among the rows that hold it: there are as many tests as pairs, so at 40 one
    in four billion passes by chance.
    """
    n, pos = len(labels), labels.sum()
    if not 0 < pos < n:
        return []
    every, where = np.unique(np.concatenate(terms), return_inverse=True)
    row = np.repeat(np.arange(n), [len(t) for t in terms])
    strength = _chi2(np.bincount(where, labels[row], len(every)), np.bincount(where, minlength=len(every)), n, pos, least_docs)
    alone = np.nonzero(strength >= least_chi2)[0]
    alone = alone[np.lexsort((every[alone], -strength[alone]))][:most]
    beside = np.zeros(len(every))
    for k in alone:
        has = np.zeros(n, bool)
        has[row[where == k]] = True
        rows, hit = has.sum(), labels[has].sum()
        if 0 < hit < rows:
            here = has[row]
            beside = np.maximum(beside, _chi2(np.bincount(where[here], labels[row[here]], len(every)), np.bincount(where[here], minlength=len(every)), rows, hit, least_docs))
    beside[alone] = 0
    paired = np.nonzero(beside >= least_pair_chi2)[0]
    paired = paired[np.lexsort((every[paired], -beside[paired]))]
    return [int(every[k]) for k in [*alone, *paired][:most]]


def train(terms: list[np.ndarray], labels: np.ndarray, factors: int = 8, steps: int = 300, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Model:
    """Logistic loss by Adam over all rows at once; weight decay on w and v."""
    chosen = screened(terms, labels)
    index = {t: k for k, t in enumerate(chosen)}
    x = np.zeros((len(terms), len(chosen)), np.float32)
    for row, t in zip(x, terms, strict=True):
        row[[index[i] for i in t.tolist() if i in index]] = 1
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    p = [np.array([np.log(share / (1 - share))]), np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), factors))]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, steps + 1) if chosen else ():
        bias, w, v = p
        xv = x @ v.astype(np.float32)
        y = bias + x @ w.astype(np.float32) + 0.5 * ((xv**2).sum(1) - x @ (v**2).sum(1).astype(np.float32))
        e = ((1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels) / len(labels)).astype(np.float32)
        xe = e @ x
        grads = [np.array([e.sum()]), xe + decay * w, x.T @ (e[:, None] * xv) - xe[:, None] * v + decay * v]
        for k, g in enumerate(grads):
            m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.99 * s[k] + 0.01 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    return Model(index, float(p[0][0]), p[1], p[2])


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "terms": [text_terms(t).tobytes() for t in batch["text"]]})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_of_label: int = 3000) -> Model:
    """Learns from at most `most_of_label` rows of each label, those of the least hashes of their identifiers.

    Null labels and identifiers are left out; of repeated labels of an identifier the
    greatest holds, of different texts of one the least, and other columns are ignored. Texts
    count whole, however long; a null text is an empty one. Without rows of both labels only
    the bias is learned (0.5 without any row).
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("label = 1").orderBy(*order).limit(most_of_label).unionByName(known.where("label = 0").orderBy(*order).limit(most_of_label))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # repeated identifiers: one text, however many rows share it
    rows = texts.mapInPandas(_rows, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, label int, terms binary").toPandas().sort_values("doc_id", kind="stable")
    return train([np.frombuffer(t, np.int32) for t in rows["terms"]], rows["label"].to_numpy(np.float64))


def score(text: Column, model: Model, spark) -> Column:
    """0 to 1, higher where label 1 is likelier. Null, empty and blank texts have no terms and get the bias alone."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([held.value.score(t.as_py() or "") for t in batch], pa.float64())

    return scored(text)
