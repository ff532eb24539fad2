"""Continuous requests scored by the same plan as a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from treeline.plans.model import Model
from treeline.plans.transform import score_rows


def request_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Requests arriving as Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def stream_score(
    requests: DataFrame, model: Model | Sequence[Model], path: str, content_type: str = "csv", keys: Sequence[str] | None = None, checkpoint: str | None = None
):
    """Starts a query that scores new requests into Parquet files at ``path``; exactly once through its checkpoint.

    All requests available now are processed, then the query stops; start it again for later arrivals. Unless another
    one is given, the checkpoint lies in the target, hidden from readers, so a new start goes on where the last one ended.
    """
    scored = score_rows(requests, model, content_type, keys)
    checkpoint = checkpoint or f"{path.rstrip('/')}/_checkpoint"
    return scored.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
