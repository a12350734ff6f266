"""Queries of the rule scan: texts made of typed columns go through `normalize`, and SQL says the same from the columns themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolot import lexicon as L
from kolot import oracles as O
from kolot.config import Clock, Config, DateOrder, HebrewDateStyle
from kolot.functions import text as T
from kolot.functions.numerals import lit_of
from kolot.operators import normalize as Z
from kolot.plans import mining, quality
from kolot.registry import query, table
from kolot.sources import lexicon


def dealt(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as a shuffle has: else a file's row group is one, and its texts take far longer than its bytes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def read(df: DataFrame, keys: list[str], texts: dict[str, Column], cfg: Config = Config()) -> DataFrame:
    """A row (keys, kind, said) for each of the texts of a row."""
    rows = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), text.alias("text")) for kind, text in texts.items()))).alias("x")
    return dealt(df).select(*keys, rows).select(*keys, "x.kind", "x.text").select(*keys, "kind", Z.normalize("text", cfg).alias("said"))


def said(keys: str, kinds: dict[str, str], source: str) -> str:
    return f"SELECT {keys}, unnest({O.words(list(kinds))}) AS kind, unnest([{', '.join(kinds.values())}]) AS said FROM {source}"


def _number(column: str) -> Column:
    return F.col(column).cast("long").cast("string")


_DATE = O.date("day(o_orderdate)", "month(o_orderdate)", "year(o_orderdate)")
_MONTH_YEAR = f"{O.words(L.MONTHS)}[month(o_orderdate)::INT] || ' ' || {O.cardinal('year(o_orderdate)', most=9999)}"


def _date_texts() -> dict[str, Column]:
    d = F.col("o_orderdate")
    named = F.concat(F.date_format(d, "d"), F.lit(" ב"), lit_of(L.MONTHS, F.month(d) - 1))
    return {"date-numeric": F.date_format(d, "d.M.yyyy"), "date-iso": F.date_format(d, "yyyy-MM-dd"), "date-textual": F.concat(named, F.lit(" "), F.date_format(d, "yyyy")), "no-year": named, "date-month-year": F.date_format(d, "M/yyyy")}


@query(said("o_orderkey", {"date-numeric": _DATE, "date-iso": _DATE, "date-textual": _DATE, "no-year": O.day_month("day(o_orderdate)", "month(o_orderdate)"), "date-month-year": _MONTH_YEAR}, "orders"))
def read_dates(spark, sf_dir):
    return read(table(spark, sf_dir, "orders"), ["o_orderkey"], _date_texts())


@query(said("o_orderkey", {"mdy": _DATE, "two-digits": _DATE}, "orders"))
def read_dates_mdy(spark, sf_dir):
    """The month first; years of two digits."""
    d = F.col("o_orderdate")
    return read(table(spark, sf_dir, "orders"), ["o_orderkey"], {"mdy": F.date_format(d, "M/d/yyyy"), "two-digits": F.date_format(d, "M-d-yy")}, Config(date_order=DateOrder.MDY))


_FACE = "((hour(ts) + 11) % 12 + 1)"


@query(said("event_id", {"time-clock": O.time12("hour(ts)", "minute(ts)"), "time-spoken-hour": f"{O.cardinal(_FACE, most=12)} || ' ' || {O.words(L.DAYPARTS)}[(event_id % 5 + 1)::INT]", "written-part": f"CASE WHEN hour(ts) = 0 AND minute(ts) = 0 THEN '{L.MIDNIGHT}' ELSE {O.on_face('hour(ts)', 'minute(ts)')} END || ' {L.EVENING}'"}, "events"))
def read_times(spark, sf_dir):
    ts = F.col("ts")
    hour = ((F.hour(ts) + 11) % 12 + 1).cast("string")
    texts = {"time-clock": F.date_format(ts, "HH:mm"), "time-spoken-hour": F.concat(hour, F.lit(" "), lit_of(L.DAYPARTS, F.col("event_id") % 5)), "written-part": F.concat(F.date_format(ts, "H:mm"), F.lit(f" {L.EVENING}"))}
    return read(table(spark, sf_dir, "events"), ["event_id"], texts)


@query(said("event_id", {"clock": f"{O.cardinal('hour(ts)', most=23)} || ' ' || {O.minute('minute(ts)')}", "seconds": f"{O.cardinal('hour(ts)', most=23)} || ' ' || {O.minute('minute(ts)')} || ' ' || {O.minute('second(ts)')}"}, "events"))
def read_times_24(spark, sf_dir):
    ts = F.col("ts")
    return read(table(spark, sf_dir, "events"), ["event_id"], {"clock": F.date_format(ts, "HH:mm"), "seconds": F.date_format(ts, "HH:mm:ss")}, Config(clock=Clock.H24))


#: A day from 1 to 50 in letters, and a month or the Omer.
_DAY = "(SELECT p_partkey, p_size AS day, CASE WHEN p_size IN (15, 16) THEN ['ט', CASE p_size WHEN 15 THEN 'ו' ELSE 'ז' END] ELSE list_filter([" + O.words(list("יכלמנ")) + "[p_size // 10], " + O.words(list("אבגדהוזחט")) + "[p_size % 10]], lambda x: x IS NOT NULL) END AS letters, " + O.words([*L.HEBREW_MONTHS, L.OMER]) + "[(p_partkey % 13 + 1)::INT] AS month FROM part)"
_WRITTEN = "CASE WHEN len(letters) = 1 THEN letters[1] || '׳' ELSE letters[1] || '״' || letters[2] END || ' ב' || month"
_NAMED = "CASE " + " ".join(f"WHEN day = {d} AND month = {O.q(m)} THEN {O.q(words)}" for (d, m), words in L.NAMED_DAYS.items())


def _hebrew_said(number: str) -> str:
    return f"CASE WHEN day > CASE month WHEN {O.q(L.OMER)} THEN 49 ELSE 30 END THEN {_WRITTEN} ELSE {_NAMED} ELSE {number} || ' ב' || month END END"


def _hebrew_dates(spark, sf_dir) -> tuple[DataFrame, dict[str, Column]]:
    day = F.col("p_size")
    tens, ones = lit_of(list("יכלמנ"), (day / 10).cast("int") - 1), lit_of(list("אבגדהוזחט"), day % 10 - 1)
    letters = F.when(day == 15, "ט״ו").when(day == 16, "ט״ז").when(day < 10, F.concat(ones, F.lit("׳"))).when(day % 10 == 0, F.concat(tens, F.lit("׳"))).otherwise(F.concat(tens, F.lit("״"), ones))
    return table(spark, sf_dir, "part"), {"date-hebrew": F.concat(letters, F.lit(" ב"), lit_of([*L.HEBREW_MONTHS, L.OMER], F.col("p_partkey") % 13))}


@query(said("p_partkey", {"date-hebrew": _hebrew_said("array_to_string(list_transform(letters, lambda x: x || '׳'), ' ')")}, _DAY))
def read_hebrew_dates(spark, sf_dir):
    df, texts = _hebrew_dates(spark, sf_dir)
    return read(df, ["p_partkey"], texts)


@query(said("p_partkey", {"date-hebrew": _hebrew_said(O.cardinal("day", "m", most=99))}, _DAY))
def read_hebrew_dates_in_numbers(spark, sf_dir):
    df, texts = _hebrew_dates(spark, sf_dir)
    return read(df, ["p_partkey"], texts, Config(hebrew_date_style=HebrewDateStyle.NUMBERS))


#: Seven digits and others that differ by customer.
_DIALLED = "(SELECT c_custkey, lpad((c_custkey * 7919 % 10000000)::VARCHAR, 7, '0') AS n, (c_custkey % 10)::VARCHAR AS k FROM customer)"


@query(
    said(
        "c_custkey",
        {
            "phone-local": O.digits("'05' || k || n"),
            "landline": O.digits("'03' || n"),
            "phone-intl": f"'{L.PLUS} ' || {O.digits(O.q('972'))} || ' ' || {O.digits(chr(39) + '5' + chr(39) + ' || k || n')}",
            "phone-service": O.digits("'1800' || n[2:7]"),
            "phone-star": f"'{L.STAR} ' || {O.digits('n[3:7]')}",
            "phone-card": O.digits("n || '5' || n || '7'"),
            "phone-ip": " || ' נקודה ' || ".join(O.digits(x) for x in ("'10'", "(c_custkey % 256)::VARCHAR", "(c_custkey * 7 % 256)::VARCHAR", "k")),
            "phone-id": f"'ת״ז ' || {O.digits(chr(39) + '31' + chr(39) + ' || n')}",
            "phone-emergency": f"'חייגו ' || {O.digits(chr(39) + '10' + chr(39) + ' || k')}",
            "no-cue": O.cardinal("(c_custkey % 10 + 100)", most=999),
        },
        _DIALLED,
    )
)
def read_phones(spark, sf_dir):
    n, k = F.lpad((F.col("c_custkey") * 7919 % 10**7).cast("string"), 7, "0"), (F.col("c_custkey") % 10).cast("string")
    part = lambda a, b: F.substring(n, a, b - a + 1)
    octet = lambda by: (F.col("c_custkey") * by % 256).cast("string")
    texts = {
        "phone-local": F.concat(F.lit("05"), k, F.lit("-"), n),
        "landline": F.concat(F.lit("03-"), part(1, 3), F.lit("-"), part(4, 7)),
        "phone-intl": F.concat(F.lit("+972-05"), k, F.lit("-"), n),
        "phone-service": F.concat(F.lit("1-800-"), part(2, 4), F.lit("-"), part(5, 7)),
        "phone-star": F.concat(F.lit("*"), part(3, 7)),
        "phone-card": F.concat(part(1, 4), F.lit("-"), part(5, 7), F.lit("5-"), part(1, 4), F.lit("-"), part(5, 7), F.lit("7")),
        "phone-ip": F.concat(F.lit("10."), octet(1), F.lit("."), octet(7), F.lit("."), k),
        "phone-id": F.concat(F.lit("ת״ז 31"), n),
        "phone-emergency": F.concat(F.lit("חייגו 10"), k),
        "no-cue": F.concat(F.lit("10"), k),
    }
    return read(table(spark, sf_dir, "customer"), ["c_custkey"], texts)


_CENTS = f"({O.in_cents('o_orderkey', 'o_totalprice', 'orders')})"


@query(said("o_orderkey", {"currency-suffix": O.money("ILS"), "commas": O.money("ILS"), "currency-prefix": O.money("USD"), "euro": O.money("EUR"), "attached": f"'{L.AND}' || {O.money('GBP')}"}, _CENTS))
def read_money(spark, sf_dir):
    plain, commas = F.format_string("%.2f", "o_totalprice"), F.format_number("o_totalprice", 2)
    texts = {"currency-suffix": F.concat(plain, F.lit(" ₪")), "commas": F.concat(commas, F.lit(" שקלים")), "currency-prefix": F.concat(F.lit("$"), plain), "euro": F.concat(F.lit("€"), commas), "attached": F.concat(F.lit("ו-"), plain, F.lit("£"))}
    return read(table(spark, sf_dir, "orders"), ["o_orderkey"], texts)


_N = O.cardinal("p_size", "m", most=99)


@query(
    said(
        "p_partkey",
        {
            **{f"{scale} {code}": f"CASE p_size WHEN 1 THEN '{scale}' WHEN 2 THEN '{L.BOUND['m'][2]} {scale}' ELSE {_N} || ' {scale}' END || ' {many}'" for scale in L.MONEY_SCALES for code, _, many, *_ in L.CURRENCIES},
            "percent-sign": f"CASE p_size WHEN 1 THEN '{L.PERCENT} {L.ONES['m'][1]}' WHEN 2 THEN '{L.BOUND['m'][2]} {L.PERCENTS}' ELSE {_N} || ' {L.PERCENTS}' END",
            "fraction": f"{_N} || ' נקודה {L.ONES['f'][5]} {L.PERCENTS}'",
            "permille": O.amount("p_size", O.q(L.PERMILLE), O.q(L.PERMILLE), "m", 99),
            "percent-word": O.amount("p_size", O.q(L.PERCENTS), O.q(L.PERCENTS), "m", 99),
        },
        "part",
    )
)
def read_scales_and_percents(spark, sf_dir):
    n = _number("p_size")
    texts = {f"{scale} {code}": F.concat(n, F.lit(f" {scale} {spellings[0]}")) for scale in L.MONEY_SCALES for code, *_, spellings in L.CURRENCIES}
    texts |= {"percent-sign": F.concat(n, F.lit("%")), "fraction": F.concat(n, F.lit(".5%")), "permille": F.concat(n, F.lit("‰")), "percent-word": F.concat(n, F.lit(f" {L.PERCENTS}"))}
    return read(table(spark, sf_dir, "part"), ["p_partkey"], texts)


_UNITS = [(s, one, many, g) for spellings, one, many, g in L.UNITS for s in spellings]
_UNIT_ROWS = "(VALUES " + ", ".join(f"({', '.join(map(O.q, row))})" for row in _UNITS) + ") u(spelling, one, many, gender)"
_UNIT_SAID = f"CASE gender WHEN 'm' THEN {O.amount('n', 'one', 'many', 'm', 99)} ELSE {O.amount('n', 'one', 'many', 'f', 99)} END"


@query(f"SELECT n, spelling, {_UNIT_SAID} AS said, '{L.MINUS} ' || {_UNIT_SAID} AS negative FROM (SELECT DISTINCT p_size AS n FROM part), {_UNIT_ROWS}")
def read_units(spark, sf_dir):
    """Each spelling of each unit with each size."""
    spellings = F.explode(F.array(*(F.lit(row[0]) for row in _UNITS))).alias("spelling")
    df = table(spark, sf_dir, "part").select(F.col("p_size").alias("n")).distinct().select("n", spellings)
    texts = df.select("n", "spelling", F.explode(F.array(F.struct(F.lit("said").alias("kind"), F.concat(_number("n"), F.lit(" "), "spelling").alias("text")), F.struct(F.lit("negative").alias("kind"), F.concat(F.lit("-"), _number("n"), F.lit(" "), "spelling").alias("text")))).alias("x"))
    rows = texts.select("n", "spelling", "x.kind", "x.text").select("n", "spelling", "kind", Z.normalize("text").alias("said"))
    return rows.groupBy("n", "spelling").pivot("kind", ["said", "negative"]).agg(F.first("said"))


_DEGREES = O.amount("p_size", O.q(L.DEGREE), O.q(L.DEGREES), "f", 99)


@query(said("p_partkey", {"degree": _DEGREES} | {f"degree {s}": f"{_DEGREES} || ' {name}'" for s, name in L.DEGREE_SCALES.items()} | {"below": f"'{L.MINUS} ' || {O.cardinal('p_size', most=99)} || ' נקודה {L.ONES['f'][5]} {L.DEGREES} {L.DEGREE_SCALES['C']}'"}, "part"))
def read_degrees(spark, sf_dir):
    n = _number("p_size")
    texts = {"degree": F.concat(n, F.lit("°"))} | {f"degree {s}": F.concat(n, F.lit(f"°{s}")) for s in L.DEGREE_SCALES} | {"below": F.concat(F.lit("-"), n, F.lit(".5 °C"))}
    return read(table(spark, sf_dir, "part"), ["p_partkey"], texts)


_ENDS = "(SELECT l_orderkey, min(l_quantity)::BIGINT AS a, max(l_quantity)::BIGINT AS b FROM lineitem GROUP BY l_orderkey)"


def _until(gender: str) -> str:
    return f"{O.cardinal('a', gender, most=99)} || ' {L.UNTIL} ' || {O.cardinal('b', gender, most=99)}"


@query(said("l_orderkey", {"range": _until("f"), "range-with-tail": f"{_until('m')} || ' ילדים'", "unit": f"{_until('m')} || ' {L.UNIT_OF['ק״ג'][1]}'", "money": f"{_until('f')} || ' דקות'", "no-tail": f"{_until('f')} || ' בלבד'"}, _ENDS))
def read_ranges(spark, sf_dir):
    ends = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b"))
    text = lambda dash, tail="": F.concat(_number("a"), F.lit(dash), _number("b"), F.lit(tail))
    return read(ends, ["l_orderkey"], {"range": text("-"), "range-with-tail": text("–", " ילדים"), "unit": text("-", " ק״ג"), "money": text(" - ", " דקות"), "no-tail": text("-", " בלבד")})


#: Nouns in the plural and singular, definite, with attached letters, in the bound form, and a word that is none.
_COUNTED = ["ילדים", "ילדות", "הילדים", "נשים", "מקומות", "ספרים", "חברי", "ילד", "שולחנות", "ובערים", "של"]
_KNOWN = O.words([w for w in _COUNTED if w in L.NOUNS])
_LOOKS = "(noun LIKE '%ים' OR noun LIKE '%ות' OR (noun LIKE '%י' AND length(noun) > 2))"


@query(f"SELECT p_partkey, noun, CASE WHEN noun <> 'של' AND CASE p_size WHEN 1 THEN list_contains({_KNOWN}, noun) ELSE {_LOOKS} END THEN {O.count_phrase('p_size', 'noun')} ELSE {O.cardinal('p_size', most=99)} || ' ' || noun END AS said FROM part, (SELECT unnest({O.words(_COUNTED)}) AS noun)")
def read_counts(spark, sf_dir):
    nouns = F.explode(F.array(*map(F.lit, _COUNTED))).alias("noun")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", nouns)
    return rows.select("p_partkey", "noun", Z.normalize(F.concat(_number("p_size"), F.lit(" "), "noun")).alias("said"))


_KEY = O.cardinal("o_orderkey", most=10**9)


@query(
    said(
        "o_orderkey",
        {"number": _KEY, "commas": _KEY, "minus": f"'{L.MINUS} ' || {_KEY}", "plus": f"'{L.PLUS} ' || {_KEY}", "number-prefix": f"'ב' || {_KEY}", "two letters": f"'וב' || {_KEY}", "times": f"'{L.TIMES} ' || {O.cardinal('o_orderkey', 'm', most=10**9)}", "decimal": f"{_KEY} || ' נקודה {L.ONES['f'][0]} {L.ONES['f'][7]}'", "ordinal": O.ordinal("(o_orderkey % 999 + 1)", "m", True), "clock-like": "o_orderkey::VARCHAR || '/7'"},
        "orders",
    )
)
def read_numbers(spark, sf_dir):
    n = _number("o_orderkey")
    texts = {"number": n, "commas": F.format_number("o_orderkey", 0), "minus": F.concat(F.lit("-"), n), "plus": F.concat(F.lit("+"), n), "number-prefix": F.concat(F.lit("ב-"), n), "two letters": F.concat(F.lit("וב-"), n), "times": F.concat(F.lit(f"{L.TIMES} "), n), "decimal": F.concat(n, F.lit(".07")), "ordinal": F.concat(F.lit("ה-"), (F.col("o_orderkey") % 999 + 1).cast("string")), "clock-like": F.concat(n, F.lit("/7"))}
    return read(table(spark, sf_dir, "orders"), ["o_orderkey"], texts)


_SHORT = L.EXPANSIONS | L.READ_AS_WORDS
_PREFIXES = ["", "ו", "ב"]


@query("SELECT prefix, short, prefix || long AS said, prefix || long AS ascii, CASE WHEN word THEN prefix || long ELSE prefix || short END AS kept FROM (VALUES " + ", ".join(f"({O.q(s)}, {O.q(w)}, {s in L.READ_AS_WORDS})" for s, w in _SHORT.items()) + f") a(short, long, word), (SELECT unnest({O.words(_PREFIXES)}) AS prefix)")
def read_abbreviations(spark, sf_dir):
    """Each abbreviation, with letters attached, with ASCII quotes for its marks, and with expansion switched off."""
    rows = spark.createDataFrame([(p, s) for s in _SHORT for p in _PREFIXES], "prefix string, short string").withColumn("text", F.concat("prefix", "short"))
    typed = F.translate("text", L.GERESH + L.GERSHAYIM, "'\"")
    return rows.select("prefix", "short", Z.normalize("text").alias("said"), Z.normalize(typed).alias("ascii"), Z.normalize("text", Config(expand_abbreviations=False)).alias("kept"))


@query(
    f"SELECT o_orderkey, 'שולמו ' || {O.money('ILS')} || ' ב' || {_DATE} || ' בשעה ' || {O.time12('(o_orderkey % 24)', '(o_orderkey % 60)')} || ' עבור ' || {O.count_phrase('n', O.q('ילדים'))} || ', בדקו את https://x.il/' || o_orderkey::VARCHAR || ' או GPT-4. ארצות הברית, ' || {O.cardinal('n', 'f', most=99)} || ' עד ' || {O.cardinal('(n + 2)', 'f', most=99)} || ' ו' || {O.amount('n', O.q(L.PERCENT), O.q(L.PERCENTS), 'm', 99)} AS said"
    " FROM (SELECT *, o_orderkey % 49 + 2 AS n, round(abs(o_totalprice) * 100)::BIGINT AS cents, false AS negative FROM orders)"
)
def read_sentences(spark, sf_dir):
    """Sentences in which rules of every priority stand side by side, next to spans that are kept."""
    key = F.col("o_orderkey")
    n = F.col("n").cast("string")
    text = F.concat(
        F.lit("שולמו "), F.format_string("%.2f", "o_totalprice"), F.lit(" ₪ ב-"), F.date_format("o_orderdate", "d/M/yyyy"), F.lit(" בשעה "), F.format_string("%02d:%02d", key % 24, key % 60), F.lit(" עבור "), n, F.lit(" ילדים, בדקו את https://x.il/"),
        key.cast("string"), F.lit(" או GPT-4. ארה״ב, "), n, F.lit("-"), (F.col("n") + 2).cast("string"), F.lit(" ו-"), n, F.lit("%"),
    )
    return table(spark, sf_dir, "orders").withColumn("n", key % 49 + 2).select("o_orderkey", text.alias("text")).select("o_orderkey", Z.normalize("text").alias("said"))


_DAY_TEXT = "day(o_orderdate)::VARCHAR || '/' || month(o_orderdate)::VARCHAR || '/' || year(o_orderdate)::VARCHAR"


@query(
    "SELECT o_orderkey, unnest([5, 7 + d, 9 + d, 10 + d + t]) AS span_start, unnest([6 + d, 9 + d, 9 + d + t, 15 + d + t]) AS span_end, unnest(['percent-sign', 'number-prefix', 'date-numeric', 'protect']) AS rule,"
    f" unnest([n::VARCHAR || '%', 'ב-', written, 'GPT-4']) AS matched, unnest([{O.amount('n', O.q(L.PERCENT), O.q(L.PERCENTS), 'm', 99)}, 'ב', {_DATE}, 'GPT-4']) AS spoken"
    f" FROM (SELECT *, length(n::VARCHAR) AS d, length(written) AS t FROM (SELECT *, o_orderkey % 49 + 2 AS n, {_DAY_TEXT} AS written FROM orders))"
)
def explain_sentences(spark, sf_dir):
    """Where each span of a sentence stands, which rule claims it and what is said for it."""
    n = (F.col("o_orderkey") % 49 + 2).cast("string")
    text = F.concat(F.lit("שולם "), n, F.lit("% ב-"), F.date_format("o_orderdate", "d/M/yyyy"), F.lit(" GPT-4"))
    found = Z.explain(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")))
    return found.withColumnRenamed("start", "span_start").withColumnRenamed("end", "span_end")


#: (text before the name, after it) and what is left of a line.
MARKED = {
    "heading": ("## ", " ##", ""), "quote": ("> ", "", ""), "item": ("- ", "", "."), "numbered": ("12) ", "", "."), "closed item": ("* ", "!", "!"), "code": ("`", "`", ""), "code of two": ("``", "``", ""), "strong": ("**", "**", ""),
    "emphasis": ("*", "*", ""), "underlined": ("__", "__", ""), "struck": ("~~", "~~", ""), "low line": ("_", "_", ""), "link": ("[", "](https://x.il/a)", ""), "by reference": ("[", "][1]", ""), "row": ("| ", " |", "."), "fence": ("```sh\nrm\n```\n", "", ""), "lone fence": ("~~~\n", "", ""),
    "image": ("![a](b.png)", "", ""), "address": ("<https://x.il/a>", "", ""), "definition": ("[1]: https://x.il\n", "", ""), "break": ("---\n", "", ""), "divider": ("|---|:-:|\n", "", ""), "plain": ("", "", ""),
}
_NAME = "replace(p_name, '_', ' ')"
_LEFT = {kind: (f"chr(10) || {_NAME}" if kind in ("break", "divider") else f"{_NAME} || {O.q(after)}" if after else _NAME) for kind, (_, _, after) in MARKED.items()}


@query(said("p_partkey", _LEFT | {"escaped": f"{_NAME} || ' #' || '[x]'", "cells": f"{_NAME} || ', 2.'"}, "part"))
def strip_marks(spark, sf_dir):
    """Each kind of Markdown around a part's name."""
    name = F.replace("p_name", F.lit("_"), F.lit(" "))
    texts = {kind: F.concat(F.lit(before), name, F.lit(after)) for kind, (before, after, _) in MARKED.items()}
    texts |= {"escaped": F.concat(F.lit("\\*"), name, F.lit("\\* \\#\\[x\\]")), "cells": F.concat(F.lit("| "), name, F.lit(" | | 2 |"))}
    rows = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), text.alias("text")) for kind, text in texts.items()))).alias("x")
    return table(spark, sf_dir, "part").select("p_partkey", rows).select("p_partkey", "x.kind", T.strip_markdown(F.col("x.text")).alias("said"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '[0-9\\x{{0660}}-\\x{{0669}}]'))::INT AS digits, 0 AS points, CASE WHEN len(w) >= 3 THEN array_to_string(w, ' ') END AS prose FROM (SELECT doc_id, text, list_filter(regexp_extract_all(text, '[^{O.unescaped(O.P.WHITE)}\\x{{1c}}-\\x{{1f}}]+'), lambda t: NOT regexp_matches(t, '[0-9\\x{{0660}}-\\x{{0669}}₪$€£%‰°׳״''\"A-Za-z#@]')) AS w FROM documents)")
def text_measures(spark, sf_dir):
    """Digits, pointing marks and the words that can start no rule, of documents."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", quality.digits_in(t).alias("digits"), quality.points_in(t).alias("points"), quality.prose(t).alias("prose"))


_KINDS = "CASE p_partkey % 4 WHEN 0 THEN 'count' WHEN 1 THEN 'words' WHEN 2 THEN 'script' ELSE 'kept' END"


@query(f"SELECT {_KINDS} AS category, count(*) AS total, count(*) FILTER (p_partkey % 4 IN (1, 2)) AS unchanged, count(*) FILTER (p_partkey % 4 = 2) AS digit_kept FROM part GROUP BY ROLLUP (1)")
def reading_metrics(spark, sf_dir):
    """Counts, words, digits of another script, and a name with a digit: which readings differ, and which keep a digit without a reason."""
    return quality.measure(_four_kinds(spark, sf_dir))


@query("SELECT NULL::VARCHAR AS category, count(*) AS total, count(*) FILTER (p_partkey % 4 IN (1, 2)) AS unchanged, count(*) FILTER (p_partkey % 4 = 2) AS digit_kept FROM part")
def reading_over_budget(spark, sf_dir):
    return quality.over_budget(quality.measure(_four_kinds(spark, sf_dir)), 1, 10**9)


def _four_kinds(spark, sf_dir) -> DataFrame:
    kind, n = F.col("p_partkey") % 4, _number("p_size")
    text = F.when(kind == 0, F.concat(n, F.lit(" ילדים"))).when(kind == 1, "שלום לכל הילדים").when(kind == 2, F.concat(F.lit("שורה "), F.translate(n, "0123456789", "٠١٢٣٤٥٦٧٨٩"))).otherwise(F.concat(F.lit("GPT-4 ו-"), n))
    category = F.when(kind == 0, "count").when(kind == 1, "words").when(kind == 2, "script").otherwise("kept")
    return table(spark, sf_dir, "part").select(category.alias("category"), text.alias("text")).withColumn("said", Z.normalize("text"))


#: A sentence of each trigger class around a number, one of none, and ones that are not accepted.
SENTENCES = {
    "permille": "מליחות המים כאן היא {} ‰ בממוצע", "degree": "בחוץ יש היום {} °C בצל העצים", "hebrew_date": "החג חל בתאריך כ״ה כסלו לפי הלוח {}", "phone": "אפשר להתקשר אלינו אל *12{} בכל יום", "time": "הרכבת יוצאת בשעה 10:{} מהתחנה",
    "date_numeric": "הפגישה נקבעה ליום 3.{} בשבוע הבא", "month_name": "נולדתי אי שם סביב {} ינואר הקר", "currency": "הכרטיס עולה {} ₪ לאדם מבוגר", "percent": "קיבלתם הנחה של {}% על הכל", "unit": "הלכנו ברגל {} ק״מ ביום אחד",
    "range": "ילדים בגילאי {} עד 99 מוזמנים", "large_number": "גרים כאן {},000 תושבים בערך", "fraction": "נשארה בערך 1/3{} מן העוגה", "decimal": "המדד עלה אל 7.{}5 נקודות היום", "signed": "המספר הוא (-{}) בלי שום ספק", "abbrev": "פגשנו את ד״ר כהן ואת בתו{}",
    "gershayim": "זה סיפור על רס״ר אחד בצבא{}", "integer": "היו שם {} ילדים וגם הורים", "": "אין כאן שום דבר מעניין באמת", "too short": "{} ילדים", "link": "ראו גם www.example.org/{} לפרטים", "cut": "הגענו אל {} והלכנו הביתה ב",
}
_WORDLESS = ("abbrev", "gershayim", "")


def _sentence_lines(spark, sf_dir) -> DataFrame:
    n = F.lpad((F.col("p_size") % 40 + 10).cast("string"), 2, "0")
    texts = [F.concat(F.lit("- " + s.split("{}")[0]), *([] if kind in _WORDLESS else [n]), F.lit(s.split("{}")[-1] if "{}" in s else "")) for kind, s in SENTENCES.items()]
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.array(*texts)).alias("at", "text"))
    return rows.select(F.lit("made").alias("corpus"), F.lit(0).alias("corpus_order"), (F.col("p_partkey") * 100 + F.col("at")).alias("line_no"), "text")


_ACCEPTED = list(SENTENCES)[: len(mining.CATEGORIES)]


@query(f"SELECT p_partkey * 100 + k AS line_no, category FROM part, (SELECT unnest(range({len(_ACCEPTED)})) AS k, unnest({O.words(_ACCEPTED)}) AS category)")
def mine_triggers(spark, sf_dir):
    """The trigger classes as they are, over sentences made for each; the others have none or are not accepted."""
    return mining.filed(_sentence_lines(spark, sf_dir)).select("line_no", "category")


@query(f"SELECT unnest({O.words(_ACCEPTED)}) AS category, 1 AS n")
def mine_trigger_counts(spark, sf_dir):
    """Numbers count as equal in a skeleton: one sentence of each class is left."""
    return mining.category_counts(mining.mine(_sentence_lines(spark, sf_dir))).select("category", "n")


def _rows_sql(columns: str, rows: list[tuple]) -> str:
    value = lambda x: str(x).lower() if isinstance(x, bool) else O.q(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(value, row)) + ')' for row in rows)}) t({columns})"


@query(_rows_sql("spelling, one, many, gender", _UNITS))
def lexicon_units(spark, sf_dir):
    return lexicon.units(spark)


@query(_rows_sql("spelling, code, one, many, gender, cent, cents, cent_gender", [(s, *row) for *row, spellings in L.CURRENCIES for s in spellings]))
def lexicon_currencies(spark, sf_dir):
    return lexicon.currencies(spark)


@query(_rows_sql("noun, gender", list(L.NOUNS.items())))
def lexicon_nouns(spark, sf_dir):
    return lexicon.nouns(spark)


@query(_rows_sql("short, said, is_word", [(s, w, s in L.READ_AS_WORDS) for s, w in _SHORT.items()]))
def lexicon_abbreviations(spark, sf_dir):
    return lexicon.abbreviations(spark)
