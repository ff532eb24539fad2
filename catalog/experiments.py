"""Training logs, trials and windowed quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.frames import EVENTS_SQL, event_rows
from catalog.registry import query, table
from treeline.operators import experiments as X
from treeline.session import scratch_path
from treeline.streaming.quality import stored_confusion, stream_confusion, stream_metric_report

METRICS = ("rmse", "auc", "f1_macro", "poisson-nloglik")


def _lines(spark, sf):
    """One log line per event: round and four validation metrics."""
    df = table(spark, sf, "events")
    parts = [F.concat(F.lit(f"#011train-{m}:0.5#011validation-{m}:"), (F.col("value") + float(i)).cast("string")) for i, m in enumerate(METRICS)]
    return df.select("event_id", F.concat(F.lit("INFO ["), (F.col("event_id") % 100).cast("string"), F.lit("]"), *parts).alias("line"))


@query("extract_metrics_from_logs", "WITH v AS (SELECT event_id, CAST(event_id % 100 AS INT) AS round, value FROM events) " + " UNION ALL ".join(
    f"SELECT event_id, round, '{m}' AS metric, value + {i}.0::DOUBLE AS value FROM v" for i, m in enumerate(METRICS)
))
def _extract(spark, sf):
    return X.extract_metrics_from_logs(_lines(spark, sf), keys=("event_id",))


@query("best_trial", """WITH t AS (SELECT 'validation:' || CASE WHEN event_type = 'purchase' THEN 'auc' ELSE 'rmse' END AS metric, user_id AS trial, max(value) AS value
  FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'validation:auc' THEN -value ELSE value END, trial) AS r FROM t)
SELECT metric, CASE WHEN metric = 'validation:auc' THEN 'Maximize' ELSE 'Minimize' END AS direction, trial, value FROM r WHERE r = 1""")
def _best(spark, sf):
    metric = F.concat(F.lit("validation:"), F.when(F.col("event_type") == "purchase", "auc").otherwise("rmse"))
    trials = table(spark, sf, "events").groupBy(metric.alias("metric"), F.col("user_id").alias("trial")).agg(F.max("value").alias("value"))
    return X.best_trial(trials)


@query("trial_parameter_report", """WITH o AS (SELECT o_orderkey AS trial, CAST(substr(o_orderpriority, 1, 1) AS INT) AS g, o_orderstatus AS s FROM orders),
p AS (SELECT trial, 'num_round' AS name, CASE WHEN g = 1 THEN 'out of range' WHEN g = 2 THEN 'unparsable' END AS problem FROM o WHERE s <> 'P'
  UNION ALL SELECT trial, 'num_round', 'missing' FROM o WHERE s = 'P'
  UNION ALL SELECT trial, 'eta', CASE WHEN g > 3 THEN 'out of range' END FROM o
  UNION ALL SELECT trial, 'booster', CASE WHEN g = 3 THEN 'out of range' END FROM o
  UNION ALL SELECT trial, 'colour', 'unknown' FROM o WHERE s = 'F')
SELECT trial, name, problem FROM p WHERE problem IS NOT NULL""")
def _report(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("trial"), F.substring("o_orderpriority", 1, 1).cast("int").alias("g"), F.col("o_orderstatus").alias("s")
    )
    rounds = F.when(F.col("g") == 1, "0").when(F.col("g") == 2, "ten").otherwise("10")
    entries = F.array(
        F.when(F.col("s") != "P", F.struct(F.lit("num_round").alias("name"), rounds.alias("value"))),
        F.struct(F.lit("learning_rate").alias("name"), (F.col("g") / 3.0).cast("string").alias("value")),
        F.struct(F.lit("booster").alias("name"), F.when(F.col("g") == 3, "forest").otherwise("dart").alias("value")),
        F.when(F.col("s") == "F", F.struct(F.lit("colour").alias("name"), F.lit("red").alias("value"))),
    )
    trials = o.select("trial", F.explode(F.array_compact(entries)).alias("e")).select("trial", "e.name", "e.value")
    return X.trial_parameter_report(trials)


QUALITY_SQL = f"""WITH {EVENTS_SQL}, c AS (SELECT date_trunc('day', ts) AS start, label, CAST(score > 0.5 AS INT) AS pred FROM evs)
SELECT start, round(avg(CAST(label = pred AS INT)), 6) AS accuracy,
  round(count(*) FILTER (WHERE label = 1 AND pred = 1)::DOUBLE / greatest(count(*) FILTER (WHERE label = 1), 1), 6) AS recall FROM c
  GROUP BY start"""


@query("stream_metric_report", QUALITY_SQL)
def _quality(spark, sf):
    source, target = scratch_path(spark, "labelled"), scratch_path(spark, "quality")
    instant = "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz)))"
    rows = event_rows(spark, sf).select(F.expr(instant).alias("ts"), "label", F.expr("cast(score > 0.5 as int)").alias("pred"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    stream_confusion(stream, "1 day", target, late="40 days").awaitTermination()
    report = stream_metric_report(stored_confusion(spark, target), ["accuracy", "recall"])
    start = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_seconds(start))").alias("start")
    return report.select(start, F.round("accuracy", 6).alias("accuracy"), F.round("recall", 6).alias("recall"))
