"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: N-grams in a profile.
TOP = 400
#: Parts of a language's n-grams that are ranked side by side.
SHARES = 64


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of 1 to 3 letters of a text in lower case, words padded with a blank.

    A code packs three code points of 21 bits. Everything but letters separates words.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(_is_letter()[points], points, 32)
    points = np.concatenate([[32], points, [32]])
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = (points[:-1] << 21) | points[1:]
    three = (two[:-1] << 21) | points[2:]
    return np.unique(np.concatenate([points[points != 32], two, three[points[1:-1] != 32]]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The TOP most frequent codes, in that order; ties by code."""
    return codes[np.lexsort((codes, -counts))[:TOP]]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, gram, n), summed over what the task has read."""
    sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    held: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            part = grams(text)
            sums.setdefault(lang, []).append(part)
            held[lang] = held.get(lang, 0) + len(part[0])
            if held[lang] > 2_000_000:
                sums[lang] = [_merged(sums[lang])]
                held[lang] = 0
    for lang, parts in sums.items():
        codes, counts = _merged(parts)
        yield pd.DataFrame({"lang": lang, "gram": codes, "n": counts})


@dataclass
class Model:
    """Languages, all their profiles' codes in order, and the rank of each code in each language (TOP: absent)."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray

    def predict(self, text: str) -> tuple[str, float]:
        codes = ranked(*grams(text))
        if not len(codes) or not self.languages:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        ranks = np.where((self.codes[at] == codes)[:, None], self.ranks[at], TOP)
        places = np.where(ranks < TOP, np.abs(ranks - np.arange(len(codes))[:, None]), TOP).sum(0)
        best = int(places.argmin())  # ties: the first language by code point
        return self.languages[best], float(1 - places[best] / (TOP * len(codes)))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Profiles of all languages over all rows given; rows without text or language are left out."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInPandas(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a language's n-grams are ranked in shares first, so no task sorts them all
    share = F.pmod(F.xxhash64("gram"), F.lit(SHARES))
    order = (F.desc("n"), F.asc("gram"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    first = counts.withColumn("share", share).withColumn("place", place("lang", "share")).where(F.col("place") <= TOP)
    top = first.withColumn("place", place("lang")).where(F.col("place") <= TOP).select("lang", "gram", (F.col("place") - 1).alias("rank")).toPandas()  # TOP rows for each language
    languages = sorted(top["lang"].unique())
    codes = np.unique(top["gram"].to_numpy(np.int64))
    ranks = np.full((len(codes), len(languages)), TOP, np.int64)
    ranks[np.searchsorted(codes, top["gram"]), [languages.index(x) for x in top["lang"]]] = top["rank"]
    return Model(languages, codes, ranks)


def predict(text: Column, model: Model, spark) -> Column:
    """Struct (lang_pred, score): the language with the least out-of-place distance, and 1 - distance / greatest distance.

    Texts that are null, empty or without a letter, and all texts where no language was
    learned, get `und` and 0. Equal distances: the first language by code point.
    """
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([held.value.predict(t) for t in texts.fillna("")], columns=["lang_pred", "score"])

    return predicted(text)


#: crc32 of a text, in SQL without such a function.
CRC32 = "xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split({0}, ''), lambda c: ord(c)::UBIGINT), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)"

ORACLE = rf"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS steps),
d AS (SELECT doc_id, lang, text IS NOT NULL AS has_text, {CRC32.format("doc_id::VARCHAR")} % 4 = 2 AS held_out, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g')) AS words FROM documents, crc),
l AS (SELECT doc_id, lang, has_text, held_out, string_split(' ' || words || ' ', '') AS c FROM d WHERE words <> ''),
g AS (SELECT doc_id, lang, has_text, held_out, c[i] || CASE WHEN n > 1 THEN c[i + 1] ELSE '' END || CASE WHEN n > 2 THEN c[i + 2] ELSE '' END AS gram
      FROM (SELECT *, unnest(range(1, len(c) - n + 2)) AS i FROM l, range(1, 4) r(n)) WHERE (n > 1 OR c[i] <> ' ') AND (n < 3 OR c[i + 1] <> ' ')),
counted AS (SELECT doc_id, lang, has_text, held_out, gram, count(*) AS n FROM g GROUP BY ALL),
own AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(gram), gram) - 1 AS place FROM counted QUALIFY place < {TOP}),
profile AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(gram), gram) - 1 AS place FROM counted WHERE NOT held_out AND lang IS NOT NULL AND has_text GROUP BY lang, gram QUALIFY place < {TOP}),
far AS (SELECT doc_id, k.lang, sum(coalesce(abs(own.place - p.place), {TOP})) AS places, count(*) AS grams FROM own CROSS JOIN (SELECT DISTINCT lang FROM profile) k LEFT JOIN profile p ON p.lang = k.lang AND p.gram = own.gram GROUP BY ALL),
best AS (SELECT doc_id, lang, 1 - places / ({TOP} * grams) AS score FROM far QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY places, lang) = 1)
SELECT d.doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(best.score, 0.0)::DOUBLE AS score FROM d LEFT JOIN best USING (doc_id)
"""
