"""Folds, out-of-fold predictions and stopping rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.frames import EVENTS_SQL, VECTORS_SQL, class_vectors, event_rows
from catalog.registry import query, table
from treeline.operators import crossval as V
from treeline.operators import encoding
from treeline.operators.folds import kfold_assign, stratified_kfold_assign


@query("kfold_assign", f"""WITH {EVENTS_SQL}, r AS (SELECT row_id, unnest([0, 1, 2]) AS repeat FROM evs)
SELECT row_id, repeat, CAST((row_number() OVER (PARTITION BY repeat ORDER BY md5('42|' || repeat || '|' || row_id), row_id) - 1) % 5 AS INT) AS fold FROM r""")
def _kfold(spark, sf):
    return kfold_assign(event_rows(spark, sf).select("row_id"), "row_id", 5, repeats=3, seed=42).select("row_id", "repeat", "fold")


@query("stratified_kfold_assign", f"""WITH {VECTORS_SQL}, r AS (SELECT row_id, label, unnest([0, 1]) AS repeat FROM vectors)
SELECT row_id, label, repeat, CAST((row_number() OVER (PARTITION BY repeat ORDER BY label, md5('42|' || repeat || '|' || row_id), row_id) - 1) % 5 AS INT) AS fold FROM r""")
def _stratified(spark, sf):
    df = class_vectors(spark, sf).select("row_id", "label")
    return stratified_kfold_assign(df, "row_id", "label", 5, repeats=2, seed=42).select("row_id", "label", "repeat", "fold")


def predictions(spark, sf):
    """Three repeats of invented out-of-fold probabilities; error events miss their last repeat."""
    df = event_rows(spark, sf).join(table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "event_type"), "row_id")
    df = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return df.where("not (event_type = 'error' and repeat = 2)").select(
        "row_id", "label", "repeat", F.expr("cast((row_id + repeat) % 5 as int)").alias("fold"),
        F.expr("(row_id * 7 + repeat * 31) % 101 / 101.0D").alias("prob"),
        F.expr("cast((row_id * 7 + repeat * 31) % 101 > 50 as double)").alias("pred"),
    )


PREDICTIONS_SQL = f"""{EVENTS_SQL}, oof AS (SELECT row_id, label, repeat, CAST((row_id + repeat) % 5 AS INT) AS fold,
  (row_id * 7 + repeat * 31) % 101 / 101.0::DOUBLE AS prob, CAST((row_id * 7 + repeat * 31) % 101 > 50 AS INT)::DOUBLE AS pred
  FROM (SELECT *, unnest([0, 1, 2]) AS repeat FROM evs JOIN (SELECT event_id AS row_id, event_type FROM events) USING (row_id))
  WHERE NOT (event_type = 'error' AND repeat = 2))"""


@query("cv_repeat_index", f"""WITH {PREDICTIONS_SQL} SELECT row_id, repeat, fold,
  CAST(row_number() OVER (PARTITION BY row_id ORDER BY repeat, fold) AS INT) AS n FROM oof""")
def _index(spark, sf):
    return V.cv_repeat_index(predictions(spark, sf)).select("row_id", "repeat", "fold", "n")


@query("cv_incomplete_rows", f"WITH {PREDICTIONS_SQL} SELECT row_id, count(*) AS n FROM oof GROUP BY row_id HAVING count(*) <> 3")
def _incomplete(spark, sf):
    return V.cv_incomplete_rows(event_rows(spark, sf), predictions(spark, sf), 3)


@query("cv_aggregate_predictions", f"""WITH {PREDICTIONS_SQL}, c AS (SELECT row_id, pred, count(*) AS n FROM oof GROUP BY ALL),
m AS (SELECT row_id, pred FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, pred) AS r FROM c) WHERE r = 1)
SELECT row_id, label, prob, pred FROM (SELECT row_id, min(label) AS label, round(avg(prob), 6) AS prob FROM oof GROUP BY row_id) JOIN m USING (row_id)""")
def _aggregate(spark, sf):
    out = V.cv_aggregate_predictions(predictions(spark, sf), True)
    return out.select("row_id", "label", F.round("prob", 6).alias("prob"), "pred")


@query("write_cv_predictions", f"""WITH {PREDICTIONS_SQL}, c AS (SELECT row_id, pred, count(*) AS n FROM oof GROUP BY ALL),
m AS (SELECT row_id, pred FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, pred) AS r FROM c) WHERE r = 1)
SELECT printf('%f,%f,%f', label::DOUBLE, prob, pred) AS line FROM
  (SELECT row_id, min(label) AS label, avg(prob) AS prob FROM oof GROUP BY row_id) JOIN m USING (row_id)""")
def _write(spark, sf):
    from treeline.session import scratch_path

    path = scratch_path(spark, "predictions")
    encoding.write_cv_predictions(V.cv_aggregate_predictions(predictions(spark, sf), True), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def metric_log(spark, sf):
    """A log with a round per day, a fold per five users, and the largest event value as its metric."""
    return table(spark, sf, "events").groupBy(
        F.dayofmonth("ts").alias("round"), F.expr("cast(user_id % 5 as int)").alias("fold"), F.col("event_type").alias("data_name"),
        F.lit("rmse").alias("metric"),
    ).agg(F.max("value").alias("value"))


LOG_SQL = """log AS (SELECT CAST(day(ts) AS INT) AS round, CAST(user_id % 5 AS INT) AS fold, event_type AS data_name, 'rmse' AS metric,
  max(value) AS value FROM events GROUP BY ALL)"""


@query("cv_metric_summary", f"""WITH {LOG_SQL} SELECT data_name, metric, round(avg(v), 5) AS value FROM
  (SELECT data_name, metric, fold, arg_max(value, round) AS v FROM log GROUP BY ALL) GROUP BY ALL""")
def _summary(spark, sf):
    return V.cv_metric_summary(metric_log(spark, sf))


@query("early_stopping_round", f"""WITH RECURSIVE {LOG_SQL}, o AS (SELECT *, row_number() OVER w AS i,
  min(value) OVER (PARTITION BY fold, data_name, metric ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
  FROM log WINDOW w AS (PARTITION BY fold, data_name, metric ORDER BY round)),
b AS (SELECT *, max(CASE WHEN prior IS NULL OR value < prior THEN round END) OVER (PARTITION BY fold, data_name, metric ORDER BY round
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM o),
s AS (SELECT fold, data_name, metric, coalesce(min(round) FILTER (WHERE round - best >= 4), max(round)) AS stop_round FROM b GROUP BY ALL),
k AS (SELECT fold, data_name, metric, stop_round, max(best) AS best_round FROM b JOIN s USING (fold, data_name, metric) WHERE round <= stop_round GROUP BY ALL)
SELECT fold, data_name, metric, best_round, value AS best_value, stop_round FROM k JOIN log USING (fold, data_name, metric) WHERE round = best_round""")
def _stopping(spark, sf):
    return V.early_stopping_round(metric_log(spark, sf), 4, maximize=False)
