"""Text as it is said: a column expression that goes through Python only where the rule scan is needed."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kolot import lexicon as L
from kolot.config import Config
from kolot.functions import text as T
from kolot.operators import passes, rules
from kolot.operators.scanner import Rule, Rules, Span, scan, spans

#: Characters that NFC leaves alone, alone and side by side: Latin with its composed letters, Hebrew letters and marks, general punctuation, currency signs.
STABLE = "\\u0000-\\u02ff\\u05d0-\\u05ea\\u05f3\\u05f4\\u2010-\\u2027\\u20a0-\\u20cf"
#: A digit or Hebrew mark, or a quote that becomes one, may start a built-in rule; other characters may need NFC.
NEEDS_SCAN = rf"""[0-9׳״]|[{L.HEBREW_BLOCK}]["']|[^{STABLE}]"""

MAY_SCAN = re.compile(NEEDS_SCAN)


def ordered(extra: Sequence[Rule] = ()) -> Rules:
    """Built-in rules and others, by priority; others come after built-in ones of theirs."""
    return Rules(sorted([*rules.built_in(), *extra], key=lambda r: -r.priority))


def normalize_text(text: str, cfg: Config = Config(), extra_rules: Sequence[Rule] = ()) -> str:
    """One text, without Spark. Anything but a text is a TypeError."""
    if not isinstance(text, str):
        raise TypeError(f"text must be str, not {type(text).__name__}")
    return passes.finalize(scan(passes.clean(text, cfg), ordered(extra_rules), cfg), cfg)


def each_once(batch: pd.Series, read: Callable[[str], str]) -> pd.Series:
    """read of each text, computed once for texts that occur again in the batch. None stays None."""
    texts = batch.tolist()
    known = {t: read(t) for t in dict.fromkeys(texts) if t is not None}
    return pd.Series([known.get(t) for t in texts], dtype=object)


def normalize(text: Column | str, cfg: Config = Config(), extra_rules: Sequence[Rule] = ()) -> Column:
    """The text as it is said. Null stays null; empty and blank texts become empty.

    Texts without a digit, a Hebrew mark or a character that NFC could change stay in the JVM:
    no built-in rule changes them, but for spans that are kept. The others are masked into one
    Arrow UDF. With extra rules all texts go through it.
    """
    text = F.col(text) if isinstance(text, str) else text
    extra = list(extra_rules)

    @F.pandas_udf("string")
    def said(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        all_rules = ordered(extra)
        for batch in batches:
            yield each_once(batch, lambda t: passes.finalize(scan(passes.clean(t, cfg), all_rules, cfg), cfg))

    if extra:
        return said(text)
    return F.coalesce(said(F.when(text.rlike(NEEDS_SCAN), text)), T.finalize(T.clean(text, cfg), cfg))


def clean_text(text: Column, cfg: Config = Config()) -> Column:
    """`clean` with NFC, which only texts with unstable characters go to Python for."""

    @F.pandas_udf("string")
    def composed(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return T.clean(F.coalesce(composed(F.when(text.rlike(f"[^{STABLE}]"), text)), text), cfg)


SPAN = "start int, end int, rule string, matched string, spoken string"


def explain(df: DataFrame, text_col: str = "text", cfg: Config = Config(), extra_rules: Sequence[Rule] = ()) -> DataFrame:
    """A row for each span that the scan claims: the table's other columns, then start, end, rule, matched and spoken.

    Places are those in the cleaned text. Columns of the table with these names are left out.
    Null texts and texts without a span give no row.
    """
    own = [f.split()[0] for f in SPAN.split(", ")]
    kept = [c for c in df.columns if c != text_col and c not in own]
    extra = list(extra_rules)

    @F.pandas_udf(f"array<struct<{SPAN.replace(' ', ': ').replace(',:', ',')}>>")
    def found(batch: pd.Series) -> pd.Series:
        all_rules = ordered(extra)
        return batch.map(lambda t: None if t is None else [vars(s) for s in spans(passes.clean(t, cfg), all_rules, cfg)])

    text = F.col(text_col)
    masked = text if extra else F.when(text.rlike(NEEDS_SCAN + r"|[#@]|://|www\.|\.[a-z]"), text)
    return df.select(*kept, F.explode(found(masked)).alias("span")).select(*kept, "span.*")


class ExplainSpans:
    """A table function: SELECT * FROM explain_spans('...')."""

    def eval(self, text: str):
        if text is not None:
            for s in spans(passes.clean(text, Config()), ordered(), Config()):
                yield s.start, s.end, s.rule, s.matched, s.spoken


def register(spark: SparkSession, cfg: Config = Config()) -> None:
    """SQL names: normalize_hebrew(text) and the table function explain_spans(text)."""

    @F.pandas_udf("string")
    def said(batch: pd.Series) -> pd.Series:
        all_rules = ordered()
        return batch.map(lambda t: None if t is None else passes.finalize(scan(passes.clean(t, cfg), all_rules, cfg) if MAY_SCAN.search(t) else passes.clean(t, cfg), cfg))

    spark.udf.register("normalize_hebrew", said)
    spark.udtf.register("explain_spans", F.udtf(ExplainSpans, returnType=SPAN))


__all__ = ["Rule", "Span", "clean_text", "explain", "normalize", "normalize_text", "ordered", "register"]
