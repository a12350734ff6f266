"""Small tables with the cases that every operator must bear."""

from pyspark.sql import DataFrame, SparkSession

LONG = "der lange text " * 4000


def documents(spark: SparkSession, texts: list, repeat: bool = True) -> DataFrame:
    """Documents with these texts, a null, empty, blank and very long text, repeated rows, and columns with clashing names."""
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else None) for i, t in enumerate([*texts, None, "", " \n\t ", LONG])]
    rows.append((None, "a text without an identifier", None, None))
    if repeat:
        rows += [rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", *(f"'x' AS `{c}`" for c in ("score", "key", "size", "digest", "component", "label", "raw", "host", "row", "copies", "n", "word", "training")))


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, ["x"]).limit(0)


def by_id(df: DataFrame) -> dict:
    return {r["doc_id"]: r for r in df.collect()}
