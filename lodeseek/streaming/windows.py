"""Aggregates of event streams by time: tumbling, sliding and session windows with watermarks, and repeats dropped."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def windowed(events: DataFrame, aggregates: dict[str, Column], length: str, slide: str | None = None, by: tuple[str, ...] = (), time_col: str = "ts", late: str = LATE) -> DataFrame:
    """since, until, the columns of by, and aggregates of each window; windows overlap if slide is shorter than length.

    Works on tables and streams alike. On a stream, state is kept until the watermark has passed a window by
    `late`; events that come later still are dropped (in append and update mode).
    """
    at = F.window(time_col, length, slide) if slide else F.window(time_col, length)
    rows = events.withWatermark(time_col, late).groupBy(at.alias("w"), *by).agg(*[a.alias(n) for n, a in aggregates.items()])
    return rows.select(F.col("w.start").alias("since"), F.col("w.end").alias("until"), *by, *aggregates)


def sessions(events: DataFrame, aggregates: dict[str, Column], gap: str, by: tuple[str, ...], time_col: str = "ts", late: str = LATE) -> DataFrame:
    """since, until, by and aggregates of sessions: runs of events of one key that are less than gap apart."""
    rows = events.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("w"), *by).agg(*[a.alias(n) for n, a in aggregates.items()])
    return rows.select(F.col("w.start").alias("since"), F.col("w.end").alias("until"), *by, *aggregates)


def without_repeats(events: DataFrame, keys: list[str], time_col: str = "ts", late: str = LATE) -> DataFrame:
    """The first event of each key within the watermark; state of older keys is dropped."""
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def run_once(rows: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now, in one batch after another, and returns the table that it leaves.

    In complete mode each batch replaces the table. In append mode a batch is a folder of its own number, so a
    batch that is run again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        to = path if mode == "complete" else f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(to)

    query = rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
