from pyspark.sql import functions as F

from .helpers import by_id, documents, empty
from kolot.llm import line_frequency as L

WORDS = " ".join(f"w{i}" for i in range(60))


def test_measures():
    n, chars, symbols, dups, repeats, _, lines = L.measures("a b c\na b c\n\n#x é a b c")
    assert (n, chars, symbols, dups, repeats) == (11, 12, 1, 1, 9)
    assert sorted(x["words"] for x in lines) == [5, 6]
    assert L.measures("")[:5] == (0, 0, 0, 0, 0)


def test_rules(spark):
    common = "this Line stands in 12 documents of the host " * 8
    texts = [f"{common}\nown{i} " + " ".join(f"o{i}x{k}" for k in range(10)) for i in range(60)]
    clean = [" ".join(f"c{i}x{k}" for k in range(80)) for i in range(20)]
    copies = [WORDS] * 40
    docs = documents(spark, [*texts, *clean, *copies, "one two three " * 40])
    got = by_id(L.line_rules(docs))
    assert all(got[i]["base_failed"] for i in (120, 121, 122, 123, 124))
    assert all(got[i]["kept"] for i in range(60, 120))
    # sources src0, src1, src2 and null hold at least 10 of the 60 documents each
    assert all(not got[i]["kept"] and got[i]["removed_words"] == 72 for i in range(60) if not got[i]["base_failed"])
    assert L.line_rules(docs).count() == docs.count()


def test_empty(spark):
    assert L.line_rules(empty(spark)).count() == 0


def spelled(i: int) -> str:
    """A number in letters: digits count as equal."""
    return "".join(chr(97 + int(c)) for c in str(i))


def test_size_of_the_host_does_not_matter(spark):
    """Twelve documents share a line, on a host of 12 and on one of 1500 distinct documents."""
    common = "this line stands in twelve documents " * 20
    texts = [(h, f"{common}\n" + " ".join(f"{h}{spelled(i)}x{spelled(k)}" for k in range(10))) for h in ("small", "large") for i in range(12)]
    texts += [("large", " ".join(f"c{spelled(i)}x{spelled(k)}" for k in range(60))) for i in range(1488)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(texts)], "doc_id long, text string, source string")
    got = by_id(L.line_rules(docs))
    assert [got[i]["removed_words"] for i in range(24)] == [120] * 24
    assert not any(got[i]["kept"] for i in range(24)) and all(got[i]["kept"] for i in range(24, 1512))


def test_cleaned_text(spark):
    """Common lines are gone from the text, in each copy and spelling; the others stay as they are."""
    texts = [f"  Shared LINE {i % 10}\n\nown {spelled(i)}\tline \n shared  line 7\nlast {spelled(i)}" for i in range(12)]
    docs = documents(spark, [*texts, texts[0]]).withColumn("source", F.lit("one"))
    cleaned, rules = L.remove_common_lines(docs), by_id(L.line_rules(docs))
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    got = by_id(cleaned)
    for i in range(13):
        assert (got[i]["text"], rules[i]["removed_words"]) == (f"\nown {spelled(i % 12)}\tline \nlast {spelled(i % 12)}", 6)
    assert [got[i]["text"] for i in (13, 14, 15, None)] == [None, "", " \n\t ", "a text without an identifier"]
    for i, r in rules.items():
        assert len((got[i]["text"] or "").split()) == r["n_words"] - r["removed_words"]


def test_documents_with_one_identifier_are_cleaned_apart(spark):
    rows = [(7 if i < 2 else i, f"shared line\nown {spelled(i)}", "one") for i in range(12)] + [(7, "other text", "one"), (7, "shared line\nalone", "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(r["text"] for r in L.remove_common_lines(docs).where("doc_id = 7").collect())
    assert got == ["other text", "own a", "own b", "own h", "shared line\nalone"]
