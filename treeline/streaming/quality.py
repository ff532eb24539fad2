"""Model quality per event-time window once labels arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from treeline.operators.confusion import class_metrics


def window_confusion(rows: DataFrame, window: str, late: str, time: str = "ts", label: str = "label", pred: str = "pred") -> DataFrame:
    """``start, label, pred, n`` per window; on a stream the state is classes squared per open window."""
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    counts = rows.groupBy(F.window(time, window).alias("w"), F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("pred"))
    return counts.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "label", "pred", "n")


def stream_confusion(rows: DataFrame, window: str, path: str, late: str, time: str = "ts", label: str = "label", pred: str = "pred"):
    """Starts a query that keeps the counts of all windows, open ones included, under ``path``.

    Each batch writes the counts it changed to its own folder, so a repeated batch replaces itself; the checkpoint lies
    beside them, so a query started again goes on where it stopped. ``late`` says how far behind the latest event a row
    may be: state of older windows is dropped, and so are rows that are later.
    """
    counts = window_confusion(rows, window, late, time, label, pred)

    def store(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/counts/number={batch}")

    writer = counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(availableNow=True).start()


def stored_confusion(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of every ``start, label, pred`` that ``stream_confusion`` has kept."""
    rows = spark.read.schema("start timestamp, label int, pred int, n long, batch long").parquet(f"{path}/counts")
    return rows.groupBy("start", "label", "pred").agg(F.max_by("n", "batch").alias("n"))


def stream_metric_report(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Class metrics per window from stored confusion counts."""
    return class_metrics(counts, list(names), ["start"])
