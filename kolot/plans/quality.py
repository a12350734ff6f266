"""How much of a corpus a reading leaves as it was: counts by category, with a total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolot.operators.rules import protect

# Digits of any script that count as unread, pointing marks, and characters that may start a rule.
ANY_DIGIT = "[0-9\u0660-\u0669]"
POINTS = "[\u0591-\u05bd\u05bf\u05c1\u05c2\u05c4\u05c5\u05c7]"
TRIGGER = "[0-9\u0660-\u0669₪$€£%‰°׳״'\"A-Za-z#@]"


def digits_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ANY_DIGIT))


def points_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(POINTS))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def prose(text: Column) -> Column:
    """The words of a text that can start no rule; null where fewer than three are left."""
    left = F.filter(tokens(text), lambda t: ~t.rlike(TRIGGER))
    return F.when(F.size(left) >= 3, F.array_join(left, " "))


def protected_spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + protect.PATTERN), F.lit(0))


def unexplained(text: Column, said: Column) -> Column:
    """Tokens of the reading that keep a digit and lie in no protected span of the text, and hold none."""

    def explained(token: Column, spans: Column) -> Column:
        bare = F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", "")
        return F.exists(spans, lambda s: s.contains(bare) | bare.contains(s))

    kept = lambda t, spans: t.rlike(ANY_DIGIT) & ~explained(t, spans)
    # spans are looked for once, and in texts whose reading has a digit only
    found = F.transform(F.array(protected_spans(text)), lambda spans: F.filter(tokens(said), lambda t: kept(t, spans)))[0]
    return F.when(said.rlike(ANY_DIGIT), found).otherwise(F.array().cast("array<string>"))


def measure(read: DataFrame, text: str = "text", said: str = "said", category: str = "category") -> DataFrame:
    """(category, total, unchanged, digit_kept) for each category and, with a null category, for all: one pass, aggregated before its shuffle."""
    kept = F.size(unexplained(F.col(text), F.col(said))) > 0
    rows = read.select(F.col(category).alias("category"), (F.col(text) == F.col(said)).alias("same"), kept.alias("kept"))
    return rows.rollup("category").agg(F.count(F.lit(1)).alias("total"), F.count_if("same").alias("unchanged"), F.count_if("kept").alias("digit_kept"))


def over_budget(measured: DataFrame, digit_kept: int, unchanged: int) -> DataFrame:
    """The total row if it is over either budget."""
    return measured.where(F.col("category").isNull() & ((F.col("digit_kept") > digit_kept) | (F.col("unchanged") > unchanged)))


