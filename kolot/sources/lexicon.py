"""The word tables as DataFrames, for joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kolot import lexicon as L


def units(spark: SparkSession) -> DataFrame:
    """(spelling, one, many, gender), a row for each spelling."""
    return spark.createDataFrame([(s, one, many, g) for spellings, one, many, g in L.UNITS for s in spellings], "spelling string, one string, many string, gender string")


def currencies(spark: SparkSession) -> DataFrame:
    """(spelling, code, one, many, gender, cent, cents, cent_gender), a row for each spelling."""
    return spark.createDataFrame([(s, *row) for *row, spellings in L.CURRENCIES for s in spellings], "spelling string, code string, one string, many string, gender string, cent string, cents string, cent_gender string")


def nouns(spark: SparkSession) -> DataFrame:
    """(noun, gender)."""
    return spark.createDataFrame(list(L.NOUNS.items()), "noun string, gender string")


def abbreviations(spark: SparkSession) -> DataFrame:
    """(short, said, is_word): what is read out, and acronyms that are read as words."""
    return spark.createDataFrame([(s, w, False) for s, w in L.EXPANSIONS.items()] + [(s, w, True) for s, w in L.READ_AS_WORDS.items()], "short string, said string, is_word boolean")
