"""The dialect over streams: a SELECT is lowered to the same plan, which Spark then runs incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.engine import Engine


def stream_select(engine: Engine, name: str, stream: DataFrame, sql: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """A streaming DataFrame of a SELECT that reads ``stream`` under ``name`` (and static tables by theirs)."""
    if not stream.isStreaming:
        raise ValueError(f"{name} is no stream")
    rows = stream.withWatermark(*watermark) if watermark else stream
    return engine.register(name, rows).sql(sql).df


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends a stream's results to Parquet; what the checkpoint has seen isn't written again."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
