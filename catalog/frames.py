"""Labelled frames derived from the tables, each with the same text for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.registry import table

# A fixed linear expression that plays the part of a model's margin.
MARGIN = "((l_quantity - 25.0D) / 10.0D + (l_discount * 100.0D - 5.0D) / 5.0D - (l_tax * 100.0D - 4.0D) / 8.0D)"
MARGIN_SQL = MARGIN.replace("D", "::DOUBLE")


def binary_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``label, score, weight, price, guess, slice, group_id`` from lineitem."""
    df = table(spark, sf, "lineitem")
    return df.select(
        F.expr("cast(l_returnflag = 'R' as int)").alias("label"),
        F.expr(MARGIN).alias("score"),
        F.expr("cast(1 + l_linenumber % 3 as double)").alias("weight"),
        F.expr("l_extendedprice / 100000.0D").alias("price"),
        F.expr("l_quantity / 50.0D + 0.1D").alias("guess"),
        F.col("l_linestatus").alias("slice"),
        F.col("l_orderkey").alias("group_id"),
        F.expr("l_linenumber % 4").alias("grade"),
    )


LINES_SQL = f"""lines AS (SELECT CAST(l_returnflag = 'R' AS INT) AS label, {MARGIN_SQL} AS score,
  CAST(1 + l_linenumber % 3 AS DOUBLE) AS weight, l_extendedprice / 100000.0::DOUBLE AS price,
  l_quantity / 50.0::DOUBLE + 0.1::DOUBLE AS guess, l_linestatus AS slice, l_orderkey AS group_id,
  l_linenumber % 4 AS grade FROM lineitem)"""


def class_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``row_id, label, scores`` with the first ten dimensions as class scores."""
    df = table(spark, sf, "embeddings")
    scores = F.transform(F.slice("embedding", 1, 10), lambda v: v.cast("double"))
    return df.select(F.col("vec_id").alias("row_id"), F.col("label"), scores.alias("scores"))


VECTORS_SQL = """vectors AS (SELECT vec_id AS row_id, label,
  list_transform(embedding[1:10], lambda v: v::DOUBLE) AS scores FROM embeddings)"""


def labelled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``row_id, label, features`` with every dimension as a feature."""
    df = table(spark, sf, "embeddings")
    return df.select(F.col("vec_id").alias("row_id"), "label", F.col("embedding").cast("array<double>").alias("features"))


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``row_id, label, score, weight, features`` from events; score is a probability."""
    df = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return df.select(
        F.col("event_id").alias("row_id"),
        F.expr("cast(event_type = 'purchase' as int)").alias("label"),
        F.expr("(event_id % 97) / 97.0D").alias("score"),
        F.expr("cast(1 + user_id % 3 as double)").alias("weight"),
        F.array(F.col("value"), k, F.expr("cast(user_id % 24 as double)")).alias("features"),
        F.col("user_id"), F.col("ts"),
    )


EVENTS_SQL = """evs AS (SELECT event_id AS row_id, CAST(event_type = 'purchase' AS INT) AS label,
  (event_id % 97) / 97.0::DOUBLE AS score, CAST(1 + user_id % 3 AS DOUBLE) AS weight,
  [value, CAST(json_extract_string(props, '$.k') AS DOUBLE), CAST(user_id % 24 AS DOUBLE)] AS features,
  user_id, ts FROM events)"""


def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``row_id, label, features`` for price regression: orders with their customer."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select(
        F.col("o_orderkey").alias("row_id"),
        F.expr("o_totalprice / 100000.0D").alias("label"),
        F.array(
            F.expr("cast(substring(o_orderpriority, 1, 1) as double)"),
            F.expr("cast(o_custkey % 100 as double)"),
            F.expr("c_acctbal / 1000.0D"),
            F.expr("cast(c_nationkey as double)"),
        ).alias("features"),
        F.col("o_custkey").alias("group_id"),
        F.expr("cast(substring(o_orderpriority, 1, 1) as int)").alias("grade"),
    )


ORDERS_SQL = """ords AS (SELECT o_orderkey AS row_id, o_totalprice / 100000.0::DOUBLE AS label,
  [CAST(substr(o_orderpriority, 1, 1) AS DOUBLE), CAST(o_custkey % 100 AS DOUBLE), c_acctbal / 1000.0::DOUBLE,
   CAST(c_nationkey AS DOUBLE)] AS features, o_custkey AS group_id,
  CAST(substr(o_orderpriority, 1, 1) AS INT) AS grade FROM orders JOIN customer ON o_custkey = c_custkey)"""
