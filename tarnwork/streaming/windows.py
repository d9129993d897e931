"""Windows over a stream in event time, with a watermark: tumbling, sliding and session windows, late rows dropped by rule.

State lives in Spark's state store under the checkpoint folder, so a query that is started again goes on where it stopped. A batch's watermark is
the latest time in all earlier batches less the delay; a row whose window has ended by then is dropped, and a window is given out once
the watermark has passed its end. A time without zone is taken as it stands, whatever the session's zone, and so are the bounds then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..written import new_path


def read_rows(spark: SparkSession, path: str, schema, files_at_once: int | None = None) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder, or under a pattern."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)


_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _marked(stream: DataFrame, time: str, delay: str) -> tuple[DataFrame, bool]:
    """The stream with a watermark on ``time``, and whether that had no zone: such a time counts as UTC while it is in state."""
    plain = dict(stream.dtypes)[time] == "timestamp_ntz"
    if plain:
        stream = stream.withColumn(time, F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {_EPOCH}, `{time}`))"))
    return stream.withWatermark(time, delay), plain


def _bounds(grouped: DataFrame, keys: list[str], plain: bool) -> DataFrame:
    rest = [c for c in grouped.columns if c not in ("window", *keys)]
    bound = lambda c: F.expr(f"timestampadd(MICROSECOND, unix_micros(window.{c}), {_EPOCH})") if plain else F.col(f"window.{c}")
    return grouped.select(bound("start").alias("window_start"), bound("end").alias("window_end"), *keys, *rest)


def windowed(stream: DataFrame, time: str, width: str, delay: str, aggregates: list[Column], keys: list[str] | None = None, slide: str | None = None) -> DataFrame:
    """(window_start, window_end, keys, aggregates) over windows of ``width``, each ``slide`` a new one (by default: without overlap).

    Defined cases: a row without a time is in no window; null keys are a group of their own; a window without rows isn't given out.
    """
    marked, plain = _marked(stream, time, delay)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return _bounds(marked.groupBy(window.alias("window"), *(keys or [])).agg(*aggregates), keys or [], plain)


def sessions(stream: DataFrame, time: str, gap: str, delay: str, aggregates: list[Column], keys: list[str]) -> DataFrame:
    """(window_start, window_end, keys, aggregates) over sessions of each key: rows closer than ``gap`` belong together; a session ends ``gap`` after its last row."""
    marked, plain = _marked(stream, time, delay)
    return _bounds(marked.groupBy(F.session_window(time, gap).alias("window"), *keys).agg(*aggregates), keys, plain)


def run_available(result: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What the query gives for all that has arrived, appended to a Parquet table at ``path``; the whole table so far is returned.

    Run again with the same folders, it takes what came since, and what was given out before is not given out twice.
    """
    query = result.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(path)


def in_arrivals(rows: DataFrame, arrival: Column, arrivals: int, build, name: str) -> DataFrame:
    """``build(stream)`` over rows that arrive in so many lots (``arrival``: the lot of a row, from 0), the query being stopped and started again between them."""
    spark = rows.sparkSession
    base = new_path(spark, name)
    out = None
    for lot in range(arrivals):
        rows.filter(arrival == lot).write.mode("append").parquet(f"{base}/in")
        out = run_available(build(read_rows(spark, f"{base}/in", rows.schema)), f"{base}/out", f"{base}/state")
    return out
