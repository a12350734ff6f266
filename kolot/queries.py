"""Queries over the driver's tables and their SQL. The tables hold no Hebrew: numbers, dates and money are read from typed columns, and the passes run on documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kolot import lexicon as L
from kolot import oracles as O
from kolot.config import Clock, Config, DateOrder
from kolot.functions import numerals as N
from kolot.functions import text as T
from kolot.functions import verbalise as V
from kolot.operators import normalize as Z
from kolot import readings  # noqa: F401  registers its queries
from kolot.plans import mining, quality
from kolot.registry import ORACLES, QUERIES, query, table  # noqa: F401

#: Numbers that the tables don't hold.
LITERALS = [0, 1, 2, 10, 11, 100, 1000, 2000, 3000, 11000, 10**6, 2 * 10**6, 10**6 + 1, 10**9, 2 * 10**9, 123_456_789_012, -1, -25]
NOUNS = ["ילד", "ילדות", "הילדים", "שנים", "מקומות", "דלת", "לילה", "ספר", "ספריות", "ובשנים", "מים"]
LETTERS = ["א", "ט״ו", "ל״ג", "כ״ז", "תשפ״ו", "ך"]
#: Document lines are accepted as sentences of Latin letters.
LATIN = mining.Limits(letters="A-Za-zÀ-ɏ", least_chars=14, most_chars=400, other_letters=None, categories=(("address", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"), ("percent", r"\d\s*%"), ("decimal", r"\d+\.\d+"), ("integer", r"\d"), ("comma", ","), ("plain", ".")))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n")).unionAll(spark.createDataFrame([(n,) for n in LITERALS], "n long"))


NUMBERS = f"(SELECT o_orderkey::BIGINT AS n FROM orders UNION ALL SELECT unnest([{', '.join(map(str, LITERALS))}]::BIGINT[]))"


@query(f"SELECT n, {O.cardinal('n', 'f')} AS words FROM {NUMBERS}")
def cardinal_words_f(spark, sf_dir):
    return _numbers(spark, sf_dir).select("n", N.cardinal(F.col("n"), "f").alias("words"))


@query(f"SELECT n, {O.cardinal('n', 'm')} AS words FROM {NUMBERS}")
def cardinal_words_m(spark, sf_dir):
    return _numbers(spark, sf_dir).select("n", N.cardinal(F.col("n"), "m").alias("words"))


@query(f"SELECT l_orderkey, l_linenumber, {O.cardinal('n', 'm')} AS words FROM (SELECT l_orderkey, l_linenumber, trunc(l_extendedprice)::BIGINT AS n FROM lineitem)")
def price_words(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.cardinal(F.col("l_extendedprice").cast("long"), "m").alias("words"))


@query(f"SELECT n_nationkey, {O.cardinal('n_nationkey', 'm', bound=True, most=99)} AS bound_m, {O.cardinal('n_nationkey', 'f', bound=True, most=99)} AS bound_f FROM nation")
def construct_words(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", N.cardinal(n, "m", bound=True).alias("bound_m"), N.cardinal(n, "f", bound=True).alias("bound_f"))


@query(f"SELECT p_partkey, {O.ordinal('p_size', 'm', True)} AS nth_m, {O.ordinal('p_size', 'f', False)} AS nth_f FROM part")
def ordinal_words(spark, sf_dir):
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", N.ordinal(n, "m", True, 50).alias("nth_m"), N.ordinal(n, "f", most=50).alias("nth_f"))


@query(f"SELECT o_orderkey, {O.digits('o_orderkey::VARCHAR')} AS words FROM orders")
def digit_words(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", N.digits(F.col("o_orderkey").cast("string")).alias("words"))


@query(f"SELECT event_id, {O.number()} AS words FROM ({O.in_cents('event_id', 'value', 'events')})")
def decimal_words(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", V.number_words(F.col("value")).alias("words"))


def _day_month_year(column: str) -> str:
    return O.date(f"day({column})", f"month({column})", f"year({column})")


@query(f"SELECT o_orderkey, {_day_month_year('o_orderdate')} AS words FROM orders")
def date_words(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", V.date_words(F.col("o_orderdate")).alias("words"))


@query(f"SELECT o_orderkey, {O.words(L.MONTHS)}[month(o_orderdate)::INT] || ' ' || {O.cardinal('year(o_orderdate)', most=9999)} AS words FROM orders")
def month_year_words(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", V.month_year_words(F.col("o_orderdate")).alias("words"))


def _in_order(spark, sf_dir, order: DateOrder) -> DataFrame:
    """Day and month as two numbers, read in an order; the other where that is no date."""
    day, d = F.dayofmonth("l_shipdate"), F.col("l_shipdate")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.numeric_date_words(day, F.month(d), F.year(d), Config(date_order=order)).alias("words"))


def _ordered_sql(first: str, second: str, column: str = "l_shipdate") -> str:
    said = lambda d, m: f"CASE WHEN {m} <= 12 AND try_cast(printf('%d-%d-%d', year({column}), {m}, {d}) AS DATE) IS NOT NULL THEN {O.date(d, m, f'year({column})')} END"
    return f"coalesce({said(first, second)}, {said(second, first)})"


@query(f"SELECT l_orderkey, l_linenumber, {_ordered_sql('day(l_shipdate)', 'month(l_shipdate)')} AS words FROM lineitem")
def date_words_dmy(spark, sf_dir):
    return _in_order(spark, sf_dir, DateOrder.DMY)


@query(f"SELECT l_orderkey, l_linenumber, {_ordered_sql('month(l_shipdate)', 'day(l_shipdate)')} AS words FROM lineitem")
def date_words_mdy(spark, sf_dir):
    return _in_order(spark, sf_dir, DateOrder.MDY)


@query(f"SELECT event_id, {O.time12('hour(ts)', 'minute(ts)')} AS words FROM events")
def time_words_12(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", V.time_words(F.col("ts")).alias("words"))


@query(f"SELECT event_id, {O.cardinal('hour(ts)', most=23)} || ' ' || {O.minute('minute(ts)')} AS words, {O.cardinal('hour(ts)', most=23)} || ' ' || {O.minute('minute(ts)')} || ' ' || {O.minute('second(ts)')} AS with_seconds FROM events")
def time_words_24(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", V.time_words(ts, Config(clock=Clock.H24)).alias("words"), V.time_words(ts, seconds=True).alias("with_seconds"))


@query(f"SELECT o_orderkey, {O.money('ILS')} AS words FROM ({O.in_cents('o_orderkey', 'o_totalprice', 'orders')})")
def currency_words(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", V.currency_words(F.col("o_totalprice"), most=10**9).alias("words"))


@query(f"SELECT c_custkey, {O.money('USD')} AS usd, {O.money('EUR')} AS eur, {O.money('GBP')} AS gbp FROM ({O.in_cents('c_custkey', 'c_acctbal', 'customer')})")
def currency_words_usd(spark, sf_dir):
    v = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", *(V.currency_words(v, code, most=10**9).alias(code.lower()) for code in ("USD", "EUR", "GBP")))


@query(f"SELECT l_orderkey, l_linenumber, {O.number(' ' + L.PERCENTS, O.amount('(cents // 100)', O.q(L.PERCENT), O.q(L.PERCENTS), 'm', 99), 'm', 99)} AS words FROM ({O.in_cents('l_orderkey, l_linenumber', 'l_discount', 'lineitem', 100)})")
def percent_words(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.percent_words(F.col("l_discount") * 100, most=999).alias("words"))


def _unit_sql(unit: str, most: int) -> str:
    one, many, g = L.UNIT_OF[unit]
    after = " " + (many if one == L.DEGREE else one)
    whole = O.amount("(cents // 100)", O.q(one), O.q(many), g, most)
    return f"CASE WHEN cents % 100 = 0 THEN {whole} ELSE {O.decimal('f', most)} || {O.q(after)} END"


@query(f"SELECT event_id, {_unit_sql('ק״מ', 10**9)} AS km, {_unit_sql('דקות', 10**9)} AS minutes FROM ({O.in_cents('event_id', 'value', 'events')})")
def unit_words(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", V.unit_words(v, "ק״מ").alias("km"), V.unit_words(v, "דקות").alias("minutes"))


@query(f"SELECT event_id, {_unit_sql('מעלות', 10**9)} || ' {L.DEGREE_SCALES['C']}' AS words FROM ({O.in_cents('event_id', 'value', 'events')})")
def degree_words(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", V.degree_words(F.col("value"), "C").alias("words"))


def _nouns(spark) -> DataFrame:
    return spark.createDataFrame([(w,) for w in NOUNS], "noun string")


@query(f"SELECT noun, {O.gender('noun')} AS gender FROM (SELECT unnest({O.words(NOUNS)}) AS noun)")
def noun_gender(spark, sf_dir):
    return _nouns(spark).select("noun", N.noun_gender(F.col("noun")).alias("gender"))


@query(f"SELECT p_partkey, noun, {O.count_phrase('p_size', 'noun')} AS phrase FROM part, (SELECT unnest({O.words(NOUNS)}) AS noun)")
def count_phrase(spark, sf_dir):
    """Each part's size with each of a fixed list of nouns."""
    nouns = F.explode(F.array(*map(F.lit, NOUNS))).alias("noun")
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", nouns).select("p_partkey", "noun", N.count_phrase(F.col("p_size").cast("long"), F.col("noun"), most=99).alias("phrase"))


@query(f"SELECT letters, list_sum(list_transform(string_split(letters, ''), lambda c: {O.case_of('c', L.LETTER_VALUES, '0')}))::BIGINT AS value FROM (SELECT unnest({O.words(LETTERS)}) AS letters)")
def gematria_value(spark, sf_dir):
    return spark.createDataFrame([(w,) for w in LETTERS], "letters string").select("letters", N.gematria(F.col("letters")).alias("value"))


@query(f"SELECT l_orderkey, {O.cardinal('a', most=99)} || ' {L.UNTIL} ' || {O.cardinal('b', most=99)} AS words, {O.cardinal('a', 'm', most=99)} || ' {L.UNTIL} ' || {O.cardinal('b', 'm', most=99)} || ' {L.UNIT_OF['ק״ג'][1]}' AS kilograms FROM (SELECT l_orderkey, min(l_quantity)::BIGINT AS a, max(l_quantity)::BIGINT AS b FROM lineitem GROUP BY l_orderkey)")
def range_words(spark, sf_dir):
    ends = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").cast("long").alias("a"), F.max("l_quantity").cast("long").alias("b"))
    return ends.select("l_orderkey", V.range_words(F.col("a"), F.col("b"), most=99).alias("words"), V.range_words(F.col("a"), F.col("b"), "ק״ג", most=99).alias("kilograms"))


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


_OCTETS = "regexp_extract(text, '" + O.ASCII_ADDRESS + "', ['before', 'a', 'b', 'c', 'd', 'after'])"


@query(f"SELECT doc_id, CASE WHEN o.a <> '' AND greatest(o.a::INT, o.b::INT, o.c::INT, o.d::INT) <= 255 THEN concat_ws(' נקודה ', {', '.join(O.digits(f'o.{x}') for x in 'abcd')}) END AS words FROM (SELECT doc_id, {_OCTETS} AS o FROM documents)")
def ip_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", V.ip_words(F.col("text")).alias("words"))


@query("SELECT doc_id, CASE WHEN found <> '' THEN " + O.digits("found") + r""" END AS words FROM (SELECT doc_id, regexp_extract(text, '(^|[^0-9])([0-9]{4}[-– ][0-9]{4}[-– ][0-9]{4}[-– ][0-9]{4}|[0-9]{4}[-– ][0-9]{6}[-– ][0-9]{5})($|[^0-9])', 2) AS found FROM documents)""")
def card_digits(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", V.card_words(F.col("text")).alias("words"))


@query(f"SELECT doc_id, array_to_string({O.protected('text')}, ' ') AS spans FROM documents")
def protected_spans(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(quality.protected_spans(F.col("text")), " ").alias("spans"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(nfc_normalize(text), '[\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]', '', 'g'), '[\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g') AS words FROM documents")
def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", Z.clean_text(F.col("text"), Config(strip_markdown=False)).alias("words"))


@query(f"SELECT doc_id, {O.finalized('text')} AS words FROM documents")
def finalize_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.finalize(F.col("text")).alias("words"))


@query(f"SELECT doc_id, {O.unmarked('text')} AS words FROM documents")
def strip_markdown(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.strip_markdown(F.col("text")).alias("words"))


@query()
def normalize_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", Z.normalize("text").alias("said"))


@query()
def normalize_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", Z.normalize("text").alias("said"))


@query()
def explain_spans(spark, sf_dir):
    return Z.explain(_docs(spark, sf_dir)).withColumnRenamed("start", "span_start").withColumnRenamed("end", "span_end")


def _sentences(spark, sf_dir) -> DataFrame:
    """Document lines as the lines of corpora, one for each language."""
    lines = table(spark, sf_dir, "documents").select("lang", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    order = N.lookup({"en": 0, "de": 1, "fr": 2, "es": 3}, F.col("lang"))
    return lines.select(F.col("lang").alias("corpus"), order.alias("corpus_order"), (F.col("doc_id") * 1_000_000 + F.col("at")).alias("line_no"), "text")


_TIDY = r"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(text, '\x{00A0}', ' ', 'g'), '[\p{Cc}\p{Zl}\p{Zp}]', '', 'g'), '[ \x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), '^[-–—]\s*', '')"
_LETTERS = r"A-Za-z\x{00C0}-\x{024F}"
_MINED = rf"""
WITH lines AS (SELECT lang AS corpus, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 END AS corpus_order, doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
tidied AS (SELECT corpus, corpus_order, doc_id * 1000000 + pos AS line_no, {_TIDY} AS text FROM lines),
accepted AS (SELECT * FROM tidied WHERE length(text) BETWEEN 14 AND 400 AND NOT regexp_matches(text, '[♪♫<>{{}}\[\]|]|https?://|www\.|@[A-Za-z]|\.(com|net|org|co\.il)([^0-9A-Za-z_\x{{00C0}}-\x{{024F}}]|$)') AND len(regexp_extract_all(text, '[{_LETTERS}]')) >= 6),
filed AS (SELECT *, CASE WHEN regexp_matches(text, '\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}') THEN 'address' WHEN regexp_matches(text, '\d\s*%') THEN 'percent' WHEN regexp_matches(text, '\d+\.\d+') THEN 'decimal' WHEN regexp_matches(text, '\d') THEN 'integer' WHEN contains(text, ',') THEN 'comma' ELSE 'plain' END AS category,
  lower(regexp_replace(regexp_replace(text, '\d+', '#', 'g'), '[^{_LETTERS}#]+', '', 'g')) AS skeleton FROM accepted),
mined AS (SELECT * EXCLUDE place FROM (SELECT *, row_number() OVER (PARTITION BY skeleton ORDER BY corpus_order, line_no) AS place FROM filed) WHERE place = 1)
""".replace("[{_LETTERS}]", f"[{_LETTERS}]")


@query(_MINED + "SELECT corpus, line_no, text FROM tidied")
def mine_tidy(spark, sf_dir):
    return _sentences(spark, sf_dir).select("corpus", "line_no", mining.tidy(F.col("text")).alias("text"))


@query(_MINED + "SELECT corpus, line_no FROM accepted")
def mine_acceptable(spark, sf_dir):
    return _filed(spark, sf_dir).select("corpus", "line_no")


@query(_MINED + "SELECT corpus, line_no, category FROM filed")
def mine_categorize(spark, sf_dir):
    return _filed(spark, sf_dir).select("corpus", "line_no", "category")


@query(_MINED + "SELECT corpus, line_no, skeleton FROM filed")
def mine_skeleton(spark, sf_dir):
    return _filed(spark, sf_dir).select("corpus", "line_no", mining.skeleton(F.col("text"), LATIN).alias("skeleton"))


def _filed(spark, sf_dir) -> DataFrame:
    """The last class takes every line, so these are all the accepted ones."""
    return mining.filed(_sentences(spark, sf_dir), LATIN)


def _mined(spark, sf_dir) -> DataFrame:
    return mining.mine(_sentences(spark, sf_dir), LATIN)


@query(_MINED + "SELECT corpus, line_no, text, category, skeleton FROM mined")
def mine_dedup(spark, sf_dir):
    return _mined(spark, sf_dir).select("corpus", "line_no", "text", "category", "skeleton")


@query(
    _MINED
    + ", turns AS (SELECT corpus, category, text, row_number() OVER (PARTITION BY corpus, category ORDER BY text) AS turn FROM (SELECT DISTINCT corpus, category, text FROM mined)) "
    + "SELECT corpus, category, text FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY turn, category) AS place FROM turns) WHERE place <= 200"
)
def mine_sample(spark, sf_dir):
    return mining.sample(_mined(spark, sf_dir), 200, by_code_point=True)


_TARGETS = {"en": 40, "de": 7, "fr": 150}


@query(
    _MINED
    + ", turns AS (SELECT corpus, category, text, row_number() OVER (PARTITION BY corpus, category ORDER BY text) AS turn FROM (SELECT DISTINCT corpus, category, text FROM mined)) "
    + f"SELECT corpus, category, text FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY turn, category) AS place FROM turns) WHERE place <= {O.case_of('corpus', _TARGETS, '0')}"
)
def mine_targets(spark, sf_dir):
    """Each corpus has a target of its own; one without gets none."""
    return mining.sample(_mined(spark, sf_dir), _TARGETS, by_code_point=True)


@query(_MINED + "SELECT corpus, category, count(*) AS n FROM mined GROUP BY ALL")
def mine_category_counts(spark, sf_dir):
    return mining.category_counts(_mined(spark, sf_dir))


@query()
def quality_metrics(spark, sf_dir):
    """Readings of documents, measured by language."""
    read = table(spark, sf_dir, "documents").select("lang", "text").withColumn("said", Z.normalize("text"))
    return quality.measure(read, category="lang")
