"""The registered queries on a small table: rows, columns, folds, thresholds, and their SQL."""

import zlib

import duckdb
import pytest

from kolot.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality": ["doc_id", "held_out", "score", "predicted"],
    "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_class_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op5_line_frequency": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op6_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op7_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_sentencepiece": ["doc_id", "n_ids", "n_unknown", "ids", "round_trip"],
    "op9_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op10_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
}
FOLDS = {"op1_quality": (5, 0), "op2_toxicity": (3, 1), "op4_class_lm": (7, 2), "op7_language_id": (4, 2)}
BARS = {"op1_quality": 0.3, "op2_toxicity": 0.7}


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(str).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    if name == "op3_packing":
        assert (got["n_tokens"] <= 2048).all() and (got["ids"].str.len() == 2 * got["n_tokens"]).all()
        return
    ids = sorted(spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()["doc_id"])
    assert sorted(got["doc_id"]) == ids
    assert list(got.columns)[: len(COLUMNS[name])] == COLUMNS[name]
    if name in FOLDS:
        n, part = FOLDS[name]
        assert (got["held_out"] == [zlib.crc32(str(i).encode()) % n == part for i in got["doc_id"]]).all()
    if name in BARS:
        assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= BARS[name])).all()
    if name in queries.ORACLES:
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
        want = con.sql(queries.ORACLES[name]).df()
        exact = [c for c in got.columns if c != "score"]
        assert rows(got[exact]) == rows(want[exact])
