"""Columns say what the scalar forms say."""

import random

import pytest
from pyspark.sql import functions as F
from test_reading import READINGS

from kolot.config import Config
from kolot.functions import numerals as N
from kolot.functions import text as T
from kolot.functions import verbalise as V
from kolot.operators import normalize as Z
from kolot.operators import passes, spoken
from kolot.plans import quality
from kolot.streaming.normalize import normalize_stream, start

TEXTS = [t for t, _, _ in READINGS] + [
    "a\n \n \nb",
    "# כותרת ##\n- פריט\n| a | b |\n|---|---|\n> > ציטוט\n***\n~~~\nx\n~~~\n[א]: http://x\n![i](u) [l](u) [r][s] <tel:1>",
    "1\\. x \\\\* y ~~z~~ __b__ _i_ *s* ***t***",
    "  tab\t\tspace  , and odd ones ‏!\r\nnext ",
    "café שׁ 74' ב\"ה",
]


@pytest.mark.parametrize("gender", "mf")
@pytest.mark.parametrize("bound", [False, True])
def test_cardinals(spark, gender, bound):
    rng = random.Random(5)
    numbers = [0, 1, 2, 3, 10, 11, 19, 20, 100, 101, 1000, 1001, 2000, 3000, 11000, 10**6, 10**6 + 1, 10**9, 2 * 10**9 + 5, 10**12, 5 * 10**18 + 3 * 10**9, 2**63 - 1, -(2**63), -7]
    numbers += [rng.randrange(10**k) for k in range(1, 19) for _ in range(8)]
    df = spark.createDataFrame([(n,) for n in numbers] + [(None,)], "n long")
    for n, words in df.select("n", N.cardinal(F.col("n"), gender, bound)).collect():
        assert words == (None if n is None else spoken.cardinal(n, gender, bound))


def test_agreement(spark):
    words = ["ילד", "הילדים", "נשים", "מים", "הבית", "שבועות", "ובשנים", "כיסא", "ספריות", "אב", "ה"]
    cfg = Config.from_spec("gender_overrides=כיסא:f")
    df = spark.createDataFrame([(n, w) for n in (0, 1, 2, 3, 10, 11) for w in words], "n long, w string")
    for n, w, phrase, gender in df.select("n", "w", N.count_phrase(F.col("n"), F.col("w"), cfg), N.noun_gender(F.col("w"), cfg)).collect():
        assert (phrase, gender) == (spoken.count_phrase(n, w, cfg), spoken.noun_gender(w, cfg))


def test_nulls_stay_null(spark):
    df = spark.sql("SELECT cast(null AS timestamp) t, cast(null AS double) v, cast(null AS string) s, cast(null AS long) n")
    v, t, s, n = F.col("v"), F.col("t"), F.col("s"), F.col("n")
    said = [V.date_words(t), V.time_words(t), V.time_words(t, seconds=True), V.currency_words(v), V.percent_words(v), V.unit_words(v, "km"), V.number_words(v), V.range_words(n, n), V.ip_words(s), N.digits(s), N.ordinal(n), T.clean(s), T.finalize(s), Z.normalize("s"), Z.clean_text(s)]
    assert set(df.select(*said).first()) == {None}


def test_money_and_minus(spark):
    df = spark.sql("SELECT explode(array(-0.5, 0.0, 1.0, 2.02, -3.1, 0.01)) v")
    assert [r[0] for r in df.select(V.currency_words(F.col("v"))).collect()] == ["מינוס חמישים אגורות", "אפס שקלים", "שקל אחד", "שני שקלים ושתי אגורות", "מינוס שלושה שקלים ועשר אגורות", "אגורה אחת"]


def test_passes_and_normalize(spark):
    cfg = Config()
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    columns = [Z.clean_text(F.col("t"), cfg), T.finalize(F.col("t"), cfg), T.strip_markdown(F.col("t")), Z.normalize("t", cfg)]
    for row in df.select("t", *columns).collect():
        t = row[0]
        assert list(row)[1:] == [passes.clean(t, cfg), passes.finalize(t, cfg), passes.strip_markdown(t), Z.normalize_text(t, cfg)]


def test_gate_changes_nothing(spark):
    """Texts that stay in the JVM read as they do in the scan."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for text, said in df.select("text", Z.normalize("text")).collect():
        assert said == Z.normalize_text(text)


def test_explain_and_sql(spark):
    df = spark.createDataFrame([(1, "ו-25₪", 5), (2, None, 5), (3, "אין", 5)], "id int, text string, start int")
    rows = Z.explain(df).collect()
    assert [(r["id"], r["start"], r["end"], r["rule"], r["spoken"]) for r in rows] == [(1, 0, 2, "number-prefix", "ו"), (1, 2, 5, "currency-suffix", "עשרים וחמישה שקלים")]
    Z.register(spark)
    assert spark.sql("SELECT normalize_hebrew('3 הילדים')").first()[0] == "שלושת הילדים"
    assert spark.sql("SELECT count(*) FROM explain_spans('3 הילדים')").first()[0] == 1


def test_stream_equals_batch(spark, tmp_path):
    spark.createDataFrame([(1, "3 הילדים"), (2, None), (3, "**שלום** ,")], "id int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))
    start(normalize_stream(stream), str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "said").collect()} == {(1, "שלושת הילדים"), (2, None), (3, "שלום,")}


def test_quality(spark):
    df = spark.createDataFrame([("a", "3 ילדים", "שלושה ילדים"), ("a", "GPT-4", "GPT-4"), ("b", "x 5", "x 5"), (None, "שלום", "שלום")], "category string, text string, said string")
    got = {(r["category"], r["total"], r["unchanged"], r["digit_kept"]) for r in quality.measure(df).collect()}
    assert got == {("a", 2, 1, 0), ("b", 1, 1, 1), (None, 1, 1, 0), (None, 4, 3, 1)}
    assert df.select(quality.prose(F.lit("אחת שתי 3 שלוש ארבע")), quality.points_in(F.lit("שָׁלוֹם־")), quality.digits_in(F.lit("1٢"))).first()[:] == ("אחת שתי שלוש ארבע", 3, 2)


def test_numbers_beyond_the_bound_are_errors(spark):
    """No number is read wrong because a shorter expression was asked for."""
    from kolot.functions import numerals as N

    df = spark.createDataFrame([(999,), (1000,)], "n long")
    assert df.where("n < 1000").select(N.cardinal(F.col("n"), most=999)).first()[0].startswith("תשע מאות")
    with pytest.raises(Exception, match="beyond 999"):
        df.select(N.cardinal(F.col("n"), most=999)).collect()


def test_texts_without_a_mark_are_left_alone(spark):
    """The gates of the passes let through whatever the single-value passes would change."""
    from kolot.config import Config
    from kolot.functions import text as T
    from kolot.operators import passes

    texts = ["plain", "a  b", " a", "a ", "a\nb ", "a\n\n\nb", "a ,b", "x\n- y", "٣) y", "12. z", "+ p", "\ue02ax", "a\u00a0b", "a\u200bb", "~~s~~", "a\t\tb", "q\n b", "\u3000x", "> q", "a|", "\\*a\\*", "<https://a.b>", "[r]: x\ny", "---", "_i_", 'צה"ל', "ד'", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.finalize(T.clean(F.col("t"))).alias("said")).collect()
    for r in rows:
        assert r["said"] == passes.finalize(passes.clean(r["t"], Config()), Config()), r["t"]


def test_texts_that_occur_again_are_read_once(spark):
    """Of a batch each text is scanned once; rows keep their order, and nulls stay."""
    import pandas as pd

    asked = []
    got = Z.each_once(pd.Series(["ב", None, "א", "ב", "", "א"], dtype=object), lambda t: asked.append(t) or t + "!")
    assert list(got) == ["ב!", None, "א!", "ב!", "!", "א!"]
    assert asked == ["ב", "א", ""]
    assert list(Z.each_once(pd.Series([None, None], dtype=object), str)) == [None, None]
    rows = [(i, [None, "3 ילדים", "", "5%", "אין"][i % 5]) for i in range(40)]
    said = [None, "שלושה ילדים", "", "חמישה אחוזים", "אין"]
    assert {tuple(r) for r in spark.createDataFrame(rows, "n int, t string").select("n", Z.normalize("t")).collect()} == {(i, said[i % 5]) for i in range(40)}
