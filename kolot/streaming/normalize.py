"""The transform on streams: stateless, so append mode without a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kolot.config import Config
from kolot.operators.normalize import normalize
from kolot.operators.scanner import Rule


def normalize_stream(stream: DataFrame, text_col: str = "text", out_col: str = "said", cfg: Config = Config(), extra_rules: Sequence[Rule] = ()) -> DataFrame:
    """The stream with a column of the text as it is said."""
    return stream.withColumn(out_col, normalize(text_col, cfg, extra_rules))


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream as Parquet, exactly once by its checkpoint, until what is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
