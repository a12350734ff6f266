"""Readers, writers, and the mining pipeline on Hebrew lines."""

import gzip
import json

import pytest

from kolot.plans import mining
from kolot.sources import corpus

GOLDEN = "# note\ninput\texpected\tconfig\tnote\n\n3 הילדים \tשלושת הילדים\t\t\n\"a\tb\tclock=24\tkeeps-digit: why\r\n"


def test_golden(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(GOLDEN, encoding="utf-8")
    got = corpus.checked(corpus.read_golden(spark, str(tmp_path / "*.tsv"))).orderBy("lineno").collect()
    assert [tuple(r) for r in got] == [("a.tsv", 4, "3 הילדים", "שלושת הילדים", "", ""), ("a.tsv", 5, '"a', "b", "clock=24", "keeps-digit: why")]
    for bad, line in (("input\texpected\n", 1), ("input\texpected\tconfig\tnote\nx\n", 2), ("input\texpected\tconfig\tnote\n\ty\n", 2)):
        (tmp_path / "a.tsv").write_text(bad, encoding="utf-8")
        with pytest.raises(corpus.CorpusError, match=f"a.tsv:{line}:"):
            corpus.checked(corpus.read_golden(spark, str(tmp_path / "*.tsv")))


def test_sections(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# T\n\n# category: time (2)\nאחת\nשתיים\n# category: unit (1)\nשלוש\n", encoding="utf-8")
    got = corpus.read_sectioned(spark, str(tmp_path / "s.txt")).orderBy("lineno").collect()
    assert [(r["category"], r["text"]) for r in got] == [("time", "אחת"), ("time", "שתיים"), ("unit", "שלוש")]


LINES = ["- המחיר הוא 25 שקלים בלבד", "המחיר הוא 30 שקלים, בלבד!", "נפגשנו בשעה 14:30 ליד הבית", "שלום לכולם וברוכים הבאים", "קצר 5", "see https://x.il with 5 שקלים לילדים", "הוא אמר 3 פעמים כי ה"]


def test_mining(spark, tmp_path):
    with gzip.open(tmp_path / "c.txt.gz", "wt", encoding="utf-8") as f:
        f.write("\n".join(LINES))
    lines = corpus.read_lines(spark, str(tmp_path / "c.txt.gz"), "c").unionByName(corpus.read_lines(spark, str(tmp_path / "c.txt.gz"), "d", 1))
    mined = mining.mine(lines)
    assert {(r["corpus"], r["category"], r["text"]) for r in mined.collect()} == {("c", "currency", "המחיר הוא 25 שקלים בלבד"), ("c", "time", "נפגשנו בשעה 14:30 ליד הבית")}
    assert mining.sample(mined, 1).count() == 1
    sampled = mining.sample(mined, 10)
    assert sampled.count() == 2
    corpus.write_sectioned(sampled, str(tmp_path / "out"))
    back = corpus.read_sectioned(spark, str(tmp_path / "out" / "corpus=c"))
    assert {(r["category"], r["text"]) for r in back.collect()} == {(r["category"], r["text"]) for r in sampled.collect()}
    files = corpus.digests(spark, str(tmp_path / "*.gz")).selectExpr("'c' AS corpus", "sha256", "bytes")
    made = json.loads(corpus.manifest(sampled, files, 7))
    assert made["corpora"]["c"]["categories"] == {"currency": 1, "time": 1}
    assert corpus.verify(files, files).count() == 0
    assert corpus.verify(files.selectExpr("corpus", "'x' AS sha256", "bytes"), files).count() == 1


def test_gzip_that_breaks_off(spark, tmp_path):
    """Whole lines before the cut are read; a file of which nothing can be read is an error."""
    import random

    rng = random.Random(1)
    text = "".join(f"line {k} {rng.random()}\r\n" for k in range(3000))
    data = gzip.compress(text.encode())
    (tmp_path / "whole.gz").write_bytes(data)
    (tmp_path / "cut.gz").write_bytes(data[: len(data) // 2])
    (tmp_path / "none.gz").write_bytes(b"no gzip")
    read = lambda name, **more: [r["text"] for r in corpus.read_cut_gzip(spark, str(tmp_path / name), "c", **more).orderBy("line_no").collect()]
    every = text.split("\r\n")[:-1]
    assert read("whole.gz") == every
    cut = read("cut.gz")
    assert 500 < len(cut) < 2500 and cut == every[: len(cut)] and cut == read("whole.gz", cap_bytes=len(data) // 2)
    with pytest.raises(Exception, match="not readable as gzip"):
        read("none.gz")


def test_corpus_loop(spark, tmp_path):
    """Two corpora share lines: the first has them; each is sampled to its target; manifest and attribution name both."""
    import hashlib

    from kolot.plans import corpora

    shared = [f"- אפשר לקנות כאן {n} תפוחים אדומים ו{w}" for n, w in ((3, "גדולים"), (4, "קטנים"), (5, "יפים"))]
    own = [f"המחיר הוא {n} ₪ {w}" for n, w in ((10, "לאדם מבוגר"), (20, "לכל הקבוצה"), (30, "לילד קטן"))]
    data = gzip.compress("\n".join([*shared, *own[:1]]).encode())
    (tmp_path / "a.gz").write_bytes(data)
    (tmp_path / "b.txt").write_text("\n".join([*own, *shared]), "utf-8")
    made = [corpora.Corpus("a", str(tmp_path / "a.gz"), 2, title="A", collection="O", version="v1", url="https://x.il/a", licence="CC0", cite="A. 2020"), corpora.Corpus("b", str(tmp_path / "b.txt"), 9, title="B")]
    mined = corpora.mine_corpora(spark, made, seed=5)
    assert {r["corpus"]: r["candidates"] for r in mined.candidates.collect()} == {"a": 4, "b": 2}
    got = [tuple(r) for r in mined.sampled.collect()]
    assert sorted(c for c, _, _ in got) == ["a", "a", "b", "b"] and {t for c, _, t in got if c == "b"} == set(own[1:])
    assert {k for c, k, _ in got if c == "a"} == {"currency", "integer"}
    written = json.loads(corpus.manifest(mined.sampled, corpora.sources(spark, made, mined), 5, "2026-01-01", "n"))
    assert written["generated"] == "2026-01-01" and written["note"] == "n"
    assert written["corpora"]["a"] == {"opus": "O", "version": "v1", "url": "https://x.il/a", "licence": "CC0", "capped": False, "sha256": hashlib.sha256(data).hexdigest(), "candidates": 4, "fetched_bytes": len(data), "sampled": 2, "categories": {"currency": 1, "integer": 1}}
    assert "| `a.txt` | A | CC0 | [O v1](https://x.il/a) |" in corpora.attribution(made)


def test_package_root():
    import kolot

    assert kolot.normalize("3 הילדים") == "שלושת הילדים" and kolot.normalize("14:30", kolot.Config(clock=kolot.Clock.H24)) == "ארבע עשרה שלושים"
    assert kolot.version() == kolot.__version__ and issubclass(kolot.ConfigError, kolot.NormalizerError)
    with pytest.raises(TypeError):
        kolot.normalize(3)
