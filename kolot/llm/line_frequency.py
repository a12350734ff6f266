"""Quality rules: lines that many documents of a host share are removed, and documents depleted by that rejected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolot.llm.common import HOT, Workspace, bit_filter, joined_salted, known_id, maybe_in, null_back, text_or_empty, window_hashes, word_hashes

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
DIGITS = bytes.maketrans(b"123456789", b"000000000")


def line_key(line: str) -> bytes:
    """A line's words in lower case (A-Z) with single blanks; digits count as equal."""
    return b" ".join(line.encode("utf-8", "surrogatepass").lower().translate(DIGITS).split())


def measures(text: str) -> tuple[int, int, int, int, int, int, list[dict[str, int]]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, hash of the whole content, its distinct lines with the words that they hold in all."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    repeats = 0
    if n >= 3:
        _, where, counts = np.unique(window_hashes(word_hashes(words), 3), return_inverse=True, return_counts=True)
        again = counts[where] > 1
        marked = np.zeros(n, bool)
        for k in range(3):
            marked[k : n - 2 + k] |= again
        repeats = int(marked.sum())
    seen: set[str] = set()
    dups, held, content = 0, {}, xxhash.xxh3_64()
    for line in text.split("\n"):
        key = line_key(line)
        if not key:
            continue
        dups += line in seen
        seen.add(line)
        content.update(key + b"\n")
        h = xxhash.xxh3_64_intdigest(key) - (1 << 63)
        held[h] = held.get(h, 0) + key.count(b" ") + 1
    chars = len(text) - sum(map(text.count, SPACES))
    return n, chars, sum(map(text.count, SYMBOLS)), dups, repeats, content.intdigest() - (1 << 63), [{"hash": h, "words": w} for h, w in held.items()]


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content", "lines"]


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.concat([batch[["doc_id", "row", "host"]], pd.DataFrame([measures(t) for t in batch["text"]], columns=COLUMNS, index=batch.index)], axis=1)


def without_lines(text: str, hashes: set[int]) -> tuple[str, int]:
    """The text without the lines of these hashes, and how many words went with them."""
    left, words = [], 0
    for line in text.split("\n"):
        key = line_key(line)
        if key and xxhash.xxh3_64_intdigest(key) - (1 << 63) in hashes:
            words += key.count(b" ") + 1
        else:
            left.append(line)
    return "\n".join(left), words


def _cleaned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [without_lines(t, set(h.tolist())) for t, h in zip(batch["text"], batch["hashes"], strict=True)]
        yield pd.concat([batch[["doc_id", "row"]], pd.DataFrame(rows, columns=["cleaned", "removed_words"], index=batch.index)], axis=1)


def _rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> list[Column]:
    """doc_id, host, text and row, a hash of the latter two that tells apart documents with one identifier."""
    host = F.coalesce(F.concat(F.lit("s"), docs[host_col].cast("string")), F.lit("-"))
    return [known_id(id_col).alias("doc_id"), host.alias("host"), text_or_empty(text_col).alias("text"), F.xxhash64(host, text_or_empty(text_col)).alias("row")]


def _cleaned_texts(docs: DataFrame, id_col: str, text_col: str, host_col: str, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """Each row's measures, and (doc_id, row, cleaned, removed_words) of the distinct documents that hold a common line."""
    workspace = Workspace(docs.sparkSession, "line-rules")
    rows = docs.select(*_rows(docs, id_col, text_col, host_col))
    fields = ", ".join(f"{c} long" for c in COLUMNS[:-1])
    made = workspace.write(rows.mapInPandas(_measured, f"doc_id long, row long, host string, {fields}, lines array<struct<hash: long, words: long>>"), "measures")
    same = F.xxhash64("host", "content").alias("same")
    groups = workspace.write(made.groupBy("host", "content").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "contents")
    hot = workspace.write(bit_filter(groups.where(F.col("n") > HOT).select(same), "same"), "hot")
    one = groups.drop("n")
    distinct = made.join(one, ["host", "content", "doc_id"], "left_semi").dropDuplicates(["host", "content"])
    lines = distinct.select("host", "content", F.explode("lines.hash").alias("hash")).withColumn("key", F.xxhash64("host", "hash"))
    common = workspace.write(lines.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least_docs).select("key"), "common")
    bits = workspace.write(bit_filter(common, "key"), "common-bits")
    removed = maybe_in(lines, "key", bits).join(common, "key", "left_semi").groupBy("host", "content").agg(F.collect_list("hash").alias("hashes"))
    # copies of one content are many rows
    hits = workspace.write(joined_salted(made.select("doc_id", "row", same), removed.select(same, "hashes"), "same", hot, "doc_id", "row").select("doc_id", "row", "hashes").dropDuplicates(["doc_id", "row"]), "hits")
    hit_bits = workspace.write(bit_filter(hits, "row"), "hit-bits")
    # only the texts that lose a line are shuffled and written
    texts = maybe_in(rows, "row", hit_bits).select("doc_id", "row", "text").dropDuplicates(["doc_id", "row"])
    return made, workspace.write(texts.join(hits, ["doc_id", "row"]).mapInPandas(_cleaned, "doc_id long, row long, cleaned string, removed_words long"), "cleaned")


def remove_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_docs: int = 10) -> DataFrame:
    """The rows of docs with all their columns, the text without its host's common lines (see `line_rules`); other lines, and null, stay as they are."""
    _, cleaned = _cleaned_texts(docs, id_col, text_col, host_col, least_docs)
    doc_id, _, _, row = _rows(docs, id_col, text_col, host_col)
    out = docs.select(doc_id, row, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all")).join(cleaned, ["doc_id", "row"], "left")
    return out.select(*(F.coalesce("cleaned", F.col("all")[c]).alias(c) if c == text_col else F.col("all")[c].alias(c) for c in docs.columns))


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_docs: int = 10, least_left: float = 0.3) -> DataFrame:
    """For each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words.

    A line (see `line_key`) is common on a host if more than `least_docs` of its distinct
    documents hold it, however many the host has; a null host is a host of its own.
    Documents with the same lines count as one, so copies make no line common. A document is
    depleted if removing its common lines leaves less than `least_left` of its words;
    removed_words counts what its text lost in that, which `remove_common_lines` gives.
    base_failed: fewer than 50 words, or over half of them in repeated windows of three; null,
    empty and blank texts have no words and fail. kept: neither. Repeated rows give one output
    row each, as do rows with a null identifier. An empty table gives an empty result. Other columns are ignored. Lines and
    contents are held as 64-bit hashes.
    """
    made, cleaned = _cleaned_texts(docs, id_col, text_col, host_col, least_docs)
    out = made.drop("lines").join(cleaned.drop("cleaned"), ["doc_id", "row"], "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("removed_words") < least_left * F.col("n_words")
    return null_back(out, "doc_id").select("doc_id", *COLUMNS[:5], failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "removed_words")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce('s' || source, '-') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, host, pos, line, array_to_string(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000')), ' ') AS key
  FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, string_agg(key, chr(10) ORDER BY pos) AS content FROM lines GROUP BY doc_id),
one AS (SELECT host, content, min(doc_id) AS doc_id FROM d LEFT JOIN dups USING (doc_id) GROUP BY ALL),
n_host AS (SELECT host, count(*) AS docs FROM one GROUP BY host),
held AS (SELECT l.host, l.doc_id, key, sum(length(key) - length(replace(key, ' ', '')) + 1) AS words FROM lines l JOIN one USING (doc_id) GROUP BY ALL),
common AS (SELECT host, key FROM held JOIN n_host USING (host) GROUP BY host, key, docs HAVING count(*) > 10 AND count(*) > 0.01 * docs),
removed AS (SELECT one.host, content, sum(words) AS removed_words FROM held JOIN common USING (host, key) JOIN one USING (doc_id) GROUP BY ALL),
win AS (SELECT doc_id, i, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
reps AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(3) r(k) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN reps USING (doc_id) LEFT JOIN removed r ON r.host = d.host AND r.content = dups.content)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - removed_words < 0.3 * n_words) AS kept, removed_words FROM m
"""
