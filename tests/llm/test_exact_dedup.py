import hashlib
import re

import pytest
from pyspark.sql import functions as F

from .helpers import by_id, documents, empty
from kolot.llm import exact_dedup as E

TEXTS = ["a b", "ab", "a  b ", "c", "d", "ab", "ç", "c ", "A b", "c "]


def brute(rows):
    groups = {}
    for r in rows:
        t = r["text"] or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), r["doc_id"]))
    return {(d, min(g)[1], len(g), min(g)[1] == d, hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, d in g}


@pytest.mark.parametrize("weak", [False, True])
def test_groups(spark, weak):
    """With a digest of two bits nearly all texts collide, and bytes decide."""
    docs = documents(spark, TEXTS)
    digest = (lambda c: (F.crc32(c.cast("binary")) % 4).cast("string")) if weak else E.sha256
    got = E.exact_dedup(docs, digest=digest).collect()
    assert len(got) == docs.count()
    assert {tuple(r) for r in got} == brute(docs.collect())


def test_empty(spark):
    assert E.exact_dedup(empty(spark)).count() == 0


def test_lookup_reads_runs(spark):
    from kolot.llm.common import Workspace

    index = E.DigestIndex(Workspace(spark, "test"))
    index.flush(spark.createDataFrame([(1, 5, "aa"), (2, 6, "bb")], "doc_id long, n_points long, digest string"))
    index.flush(spark.createDataFrame([(3, 6, "aa")], "doc_id long, n_points long, digest string"))
    assert {r["doc_id"] for r in index.lookup(["aa"]).collect()} == {1, 3}
    probed = index.probed()
    assert {r["doc_id"] for r in probed.where("shared").collect()} == {1, 3}
    assert {tuple(r) for r in index.compact(probed).collect()} == {("aa", 3, 2)}
    assert by_id(index.entries()).keys() == {1, 2, 3}


def test_rows_alone_in_the_filter_are_not_merged(spark):
    """The plan of the merge reads the filter before its shuffle, and nearly all rows stop there."""
    from kolot.llm.common import Workspace

    index = E.DigestIndex(Workspace(spark, "test"), memtable_rows=100)
    index.flush(spark.range(2000).selectExpr("id AS doc_id", "1L AS n_points", "sha2(cast(id AS string), 256) AS digest"))
    index.flush(spark.range(5).selectExpr("id + 5000 AS doc_id", "2L AS n_points", "sha2(cast(id AS string), 256) AS digest"))
    probed = index.probed()
    assert "BroadcastHashJoin" in probed._jdf.queryExecution().toString()
    assert 10 <= probed.where("shared").count() <= 20
    assert sorted(tuple(r)[1:] for r in index.compact(probed).collect()) == [(5000 + k, 2) for k in range(5)]


@pytest.mark.parametrize(("kind", "ids"), [("long", [-(2**63), 2**63 - 1, 0]), ("string", ["b", "a", "c"]), ("decimal(38,0)", [10**30, 5, 7])])
def test_identifiers_of_any_type(spark, kind, ids):
    from decimal import Decimal

    cast = Decimal if kind[0] == "d" else (lambda x: x)
    docs = spark.createDataFrame([(cast(i), "x y") for i in ids], f"doc_id {kind}, text string")
    got = E.exact_dedup(docs).collect()
    assert {r["keep_id"] for r in got} == {cast(min(ids))} and [r["kept"] for r in got].count(True) == 1


def test_hot_digest_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(E, "HOT", 3)
    docs = documents(spark, ["x y"] * 30 + ["z"] * 2)
    assert {tuple(r) for r in E.exact_dedup(docs).collect()} == brute(docs.collect())
