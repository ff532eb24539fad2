"""Confusion-based and regression metrics over lineitem and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.frames import LINES_SQL, VECTORS_SQL, binary_lines, class_vectors
from catalog.registry import query
from treeline.functions.scores import margin_to_label, sigmoid_probability
from treeline.operators import confusion as C
from treeline.operators.batch_metrics import BatchMetric

BINARY = "accuracy balanced_accuracy f1 f1_binary precision recall".split()
MULTI = "f1_macro precision_macro precision_micro recall_macro recall_micro".split()
VALUES = "mae mse rmse r2".split()


def _binary(spark, sf):
    df = binary_lines(spark, sf)
    return df.withColumn("pred", margin_to_label(F.col("score")))


def _multi(spark, sf):
    return class_vectors(spark, sf).withColumn("pred", margin_to_label(F.col("scores"), is_array=True))


def _values(spark, sf):
    return binary_lines(spark, sf).select(F.col("price").alias("label"), F.col("guess").alias("pred"), "slice")


BIN_SQL = f"{LINES_SQL}, rows_ AS (SELECT label, CAST(score > 0 AS INT) AS pred, slice FROM lines)"
MULTI_SQL = f"""{VECTORS_SQL}, rows_ AS (SELECT label,
  CAST(list_position(scores, list_max(scores)) - 1 AS INT) AS pred FROM vectors)"""
PER_CLASS = """classes AS (SELECT label AS c FROM rows_ UNION SELECT pred FROM rows_),
per AS (SELECT c, (SELECT count(*) FROM rows_ WHERE label = c AND pred = c) AS tp,
  (SELECT count(*) FROM rows_ WHERE label = c) AS a, (SELECT count(*) FROM rows_ WHERE pred = c) AS p FROM classes)"""
SQL_OF = {
    "accuracy": "SELECT avg(CAST(label = pred AS INT)) FROM rows_",
    "balanced_accuracy": "SELECT avg(tp::DOUBLE / a) FROM per WHERE a > 0",
    "f1": "SELECT avg(2.0 * tp / (a + p)) FROM per",
    "f1_macro": "SELECT avg(2.0 * tp / (a + p)) FROM per",
    "f1_binary": "SELECT 2.0 * tp / (a + p) FROM per WHERE c = 1",
    "precision": "SELECT tp::DOUBLE / p FROM per WHERE c = 1",
    "recall": "SELECT tp::DOUBLE / a FROM per WHERE c = 1",
    "precision_macro": "SELECT avg(CASE WHEN p > 0 THEN tp::DOUBLE / p ELSE 0 END) FROM per",
    "recall_macro": "SELECT avg(CASE WHEN a > 0 THEN tp::DOUBLE / a ELSE 0 END) FROM per",
    "precision_micro": "SELECT sum(tp)::DOUBLE / sum(p) FROM per",
    "recall_micro": "SELECT sum(tp)::DOUBLE / sum(a) FROM per",
    "mae": "SELECT avg(abs(price - guess)) FROM lines",
    "mse": "SELECT avg((price - guess) * (price - guess)) FROM lines",
    "rmse": "SELECT sqrt(avg((price - guess) * (price - guess))) FROM lines",
    "r2": "SELECT 1.0 - sum((price - guess) * (price - guess)) / (var_pop(price) * count(*)) FROM lines",
}


def _register(name, frame, base):
    column = f"metric_{name}"
    if name in VALUES:
        text = f"WITH {LINES_SQL} SELECT round(({SQL_OF[name]}), 6) AS value"

        def run(spark, sf):
            out = C.value_metrics(frame(spark, sf), [name])
            return out.select(F.round(name, 6).alias("value"))
    else:
        text = f"WITH {base}, {PER_CLASS} SELECT round(({SQL_OF[name]})::DOUBLE, 6) AS value"

        def run(spark, sf):
            out = C.class_metrics(C.confusion_counts(frame(spark, sf)), [name])
            return out.select(F.round(name, 6).alias("value"))

    query(column, text)(run)


for _name in BINARY:
    _register(_name, _binary, BIN_SQL)
for _name in MULTI:
    _register(_name, _multi, MULTI_SQL)
for _name in VALUES:
    _register(_name, _values, "")


@query("confusion_counts", f"WITH {BIN_SQL} SELECT label, pred, count(*) AS n FROM rows_ GROUP BY ALL")
def _confusion(spark, sf):
    return C.confusion_counts(_binary(spark, sf))


@query("margin_to_label", f"""WITH {VECTORS_SQL} SELECT row_id,
  CAST(list_position(scores, list_max(scores)) - 1 AS INT) AS class_label, CAST(scores[1] > 0 AS INT) AS sign_label
  FROM vectors""")
def _margin_to_label(spark, sf):
    df = class_vectors(spark, sf)
    return df.select(
        "row_id",
        margin_to_label(F.col("scores"), is_array=True).alias("class_label"),
        margin_to_label(F.get("scores", F.lit(0))).alias("sign_label"),
    )


@query("sigmoid_probability", f"""WITH {LINES_SQL} SELECT group_id,
  round(0.5 * (1 + tanh(0.5 * score)), 6) AS probability FROM lines""")
def _sigmoid(spark, sf):
    return binary_lines(spark, sf).select("group_id", F.round(sigmoid_probability(F.col("score")), 6).alias("probability"))


_ALL_BINARY = [*BINARY, *[m for m in MULTI if m != "f1"]]
_REPORT_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS metric, round(({SQL_OF[n]})::DOUBLE, 6) AS value" for n in _ALL_BINARY
)


@query("metric_report", f"WITH {BIN_SQL}, {PER_CLASS} {_REPORT_SQL}")
def metric_report(spark, sf):
    out = C.metric_report(_binary(spark, sf), _ALL_BINARY)
    return out.select("metric", F.round("value", 6).alias("value"))


@query("metric_report_grouped", f"""WITH {LINES_SQL} SELECT slice, m.metric, m.value FROM (SELECT slice, unnest([
  {{'metric': 'mae', 'value': round(avg(abs(price - guess)), 6)}},
  {{'metric': 'mse', 'value': round(avg((price - guess) * (price - guess)), 6)}},
  {{'metric': 'rmse', 'value': round(sqrt(avg((price - guess) * (price - guess))), 6)}},
  {{'metric': 'r2', 'value': round(1 - sum((price - guess) * (price - guess)) / (var_pop(price) * count(*)), 6)}}]) AS m
  FROM lines GROUP BY slice)""")
def _grouped(spark, sf):
    out = C.metric_report_grouped(_values(spark, sf), ["slice"], VALUES)
    return out.select("slice", "metric", F.round("value", 6).alias("value"))


@query("user_metric", f"""WITH {LINES_SQL} SELECT m.metric, m.value FROM (SELECT unnest([
  {{'metric': 'within_half', 'value': round(avg(CAST(abs(price - guess) <= 0.5 AS DOUBLE)), 6)}},
  {{'metric': 'bias', 'value': round(avg(guess - price), 6)}}]) AS m FROM lines)""")
def _user(spark, sf):
    metrics = {
        "within_half": F.avg((F.abs(F.col("label") - F.col("pred")) <= 0.5).cast("double")),
        "bias": F.avg(F.col("pred") - F.col("label")),
    }
    return C.user_metric(_values(spark, sf), metrics).select("metric", F.round("value", 6).alias("value"))


def _with_totals(kind):
    return f"""WITH {LINES_SQL}, r AS (SELECT slice, grade AS fold, label, CAST(score > 0 AS INT) AS pred, guess FROM lines)
SELECT slice, fold, grouping_id, m.metric, m.value FROM (SELECT slice, fold, CAST(grouping(slice) * 2 + grouping(fold) AS INT) AS grouping_id, unnest([
  {{'metric': 'accuracy', 'value': round(avg(CAST(label = pred AS INT)), 6)}},
  {{'metric': 'precision', 'value': round(sum(label * pred)::DOUBLE / sum(pred), 6)}},
  {{'metric': 'recall', 'value': round(sum(label * pred)::DOUBLE / sum(label), 6)}},
  {{'metric': 'mae', 'value': round(avg(abs(label - guess)), 6)}},
  {{'metric': 'r2', 'value': round(1 - sum((label - guess) * (label - guess)) / (var_pop(label) * count(*)), 6)}}]) AS m
  FROM r GROUP BY {kind}(slice, fold))"""


def _report_with_totals(kind):
    def run(spark, sf):
        df = _binary(spark, sf).withColumnRenamed("grade", "fold")
        out = C.metric_report_grouped(df, ["slice", "fold"], ["accuracy", "precision", "recall", "mae", "r2"], totals=kind, value="guess")
        return out.select("slice", "fold", "grouping_id", "metric", F.round("value", 6).alias("value"))

    query(f"metric_report_{kind}", _with_totals(kind))(run)


_report_with_totals("rollup")
_report_with_totals("cube")


@query("user_metric_python", f"""WITH {BIN_SQL.replace('pred, slice', 'pred, weight, slice')}, c AS (SELECT slice, avg(pred) AS rate,
  sum(label * pred)::DOUBLE AS tp, sum((1 - label) * (1 - pred))::DOUBLE AS tn, sum((1 - label) * pred)::DOUBLE AS fp, sum(label * (1 - pred))::DOUBLE AS fn,
  sum(weight * label * pred) / sum(weight * label) AS wr FROM rows_ GROUP BY slice)
SELECT slice, 'positive_rate' AS metric, round(rate, 6) AS value FROM c UNION ALL SELECT slice, 'weighted_recall', round(wr, 6) FROM c
UNION ALL SELECT slice, 'matthews', round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) FROM c""")
def _user_python(spark, sf):
    def cells(label, pred):
        return [((label == a) & (pred == b)).sum() for a, b in ((1, 1), (0, 0), (0, 1), (1, 0))]

    def matthews(sums):
        tp, tn, fp, fn = sums
        return (tp * tn - fp * fn) / ((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ** 0.5

    metrics = {
        "positive_rate": F.avg("pred"),
        "matthews": BatchMetric(["label", "pred"], cells, matthews),
        "weighted_recall": BatchMetric(
            ["label", "pred", "weight"], lambda y, p, w: [(w * y * p).sum(), (w * y).sum()], lambda sums: sums[0] / sums[1]
        ),
    }
    return C.user_metric(_binary(spark, sf), metrics, ["slice"]).select("slice", "metric", F.round("value", 6).alias("value"))
