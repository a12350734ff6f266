"""The stages, each against what its decisions should be on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline as C
from kolot.llm import exact_dedup, near_dedup

from .helpers import documents

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("copies", F.lit(1)).unionByName(documents(spark, ["x y"]).selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "length(text) AS n_chars", "1 AS copies"))
    assert [name for name, _ in C.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "sentencepiece"]
    ids = lambda df: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda i: (i is None, i or 0))
    for _, stage in C.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == before.columns
        assert set(ids(docs)) <= set(ids(before))
        if stage is C.drop_copies:
            kept = {r["doc_id"] for r in exact_dedup.exact_dedup(before).where("kept").collect()}
            assert set(ids(docs)) == kept
        if stage is C.drop_near_copies:
            assert set(ids(docs)) == {r["doc_id"] for r in near_dedup.near_groups(before).where("kept").collect()}
    last = C.STAGES[-1][1](spark, docs, SF)
    assert ids(last) == ids(docs)
    assert last.where("NOT round_trip").count() == 0


def test_run(spark, tmp_path):
    """What operators write on the way is removed; columns with clashing names and an empty table pass through all stages."""
    import os

    from kolot.llm.common import shared_folder

    before = set(os.listdir(shared_folder(spark)))
    assert C.run(spark, SF).count() > 0
    assert [n.split("-")[0] for n in set(os.listdir(shared_folder(spark))) - before] == ["pipeline"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, docs in (("clash", documents(spark, ["x y", "ab c", "x  y"])), ("empty", documents(spark, ["x"]).limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        got = C.run(spark, str(tmp_path / name)).collect()
        assert bool(got) == (name == "clash") and {r["doc_id"] for r in got} <= {None, *range(20)}


def test_hashed_rounding_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    once, again = (sorted(map(tuple, C.mix(spark, d, SF).select("doc_id").collect())) for d in (docs, docs.repartition(5)))
    assert once == again


def test_documents_without_an_identifier_of_their_own(spark):
    """Null and shared identifiers: each document is decided on its own, by its text."""
    words = lambda c, n=60: " ".join(f"{c}{k}" for k in range(n))
    rows = [(None, words("a")), (None, words("b")), (None, words("b") + " \n"), (5, words("b")), (7, words("c")), (7, words("d")), (7, words("d")), (8, words("e")), (7, words("e") + " more")]
    docs = spark.createDataFrame([(i, t, "en", "one", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    exact = C.drop_copies(spark, docs, SF)
    want = [rows[k] for k in (0, 2, 4, 5, 7, 8)]
    assert exact.columns == docs.columns and got(exact) == sorted(want, key=str)
    near = C.drop_near_copies(spark, exact, SF)
    assert near.columns == docs.columns and got(near) == sorted([w for w in want if w[0] != 8], key=str)
    # the mix of one source takes each document once, rows that repeat too
    assert got(C.mix(spark, docs, SF)) == sorted(rows, key=str)
