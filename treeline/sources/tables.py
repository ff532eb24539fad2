"""Parquet files, single-folder reads and combined channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from treeline.sources.manifest import read_channel, usable_files
from treeline.sources.text import labelled, read_csv_labelled


def scan_parquet_labeled(spark: SparkSession, roots: str | Sequence[str], weight_col: bool = False) -> DataFrame:
    """``label, weight, features`` by position: column 0 is the label, the rest features."""
    first = usable_files(spark, roots).orderBy("name", "path").select("path").first()
    if first is None:
        raise FileNotFoundError(f"no usable files in {roots}")
    schema = spark.read.parquet(first["path"]).schema
    df = read_channel(spark, roots, spark.read.schema(schema).option("recursiveFileLookup", True).parquet)
    return labelled(df, schema.names, weight_col)


def scan_channel_glob(spark: SparkSession, folder: str, content_type: str) -> DataFrame:
    """Only ``*.csv`` (no header) or ``*.parquet`` directly in the folder; other types are rejected."""
    if content_type == "csv":
        return read_csv_labelled(spark, folder, glob="*.csv")
    if content_type == "parquet":
        df = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", False).parquet(folder)
        return labelled(df, df.columns)
    raise ValueError(f"unexpected content type {content_type}: use csv or parquet")


def union_channels(train: DataFrame, validation: DataFrame | None) -> DataFrame:
    """Train and validation as one data set for k-fold, tagged by ``channel``."""
    out = train.withColumn("channel", F.lit("train"))
    if validation is None:
        return out
    return out.unionByName(validation.withColumn("channel", F.lit("validation")))
