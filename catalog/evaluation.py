"""Built-in evaluation metrics by name, weighted, over lineitem, embeddings and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.frames import LINES_SQL, VECTORS_SQL, binary_lines, class_vectors
from catalog.registry import query
from treeline.functions.scores import ERFC_FIT, sigmoid_probability, softmax
from treeline.operators import ranking as R
from treeline.operators.evaluation import evaluate_rows


def _probabilities(spark, sf):
    return binary_lines(spark, sf).withColumn("pred", sigmoid_probability(F.col("score")))


def _prices(spark, sf):
    return binary_lines(spark, sf).select(F.col("price").alias("label"), F.col("guess").alias("pred"), "weight")


def _grades(spark, sf):
    return binary_lines(spark, sf).select(
        F.col("grade").cast("double").alias("label"), F.col("guess").alias("pred"), "weight"
    )


def _class_probabilities(spark, sf):
    df = class_vectors(spark, sf)
    return df.withColumn("pred", F.array(*softmax([F.col("scores")[i] for i in range(10)])))


PROB = f"{LINES_SQL}, r AS (SELECT label::DOUBLE AS y, 0.5 * (1 + tanh(0.5 * score)) AS p, weight AS w FROM lines)"
PRICE = f"{LINES_SQL}, r AS (SELECT price AS y, guess AS p, weight AS w FROM lines)"
GRADE = f"{LINES_SQL}, r AS (SELECT grade::DOUBLE AS y, guess AS p, weight AS w FROM lines)"
CLASSES = f"""{VECTORS_SQL}, e AS (SELECT label, list_transform(scores, lambda v: exp(v - list_max(scores))) AS q FROM vectors),
r AS (SELECT label AS y, list_transform(q, lambda v: v / list_sum(q)) AS p, 1.0 AS w FROM e)"""


def _register(key, metric, frame, base, term, root=False, weight="weight", **options):
    mean = f"sum(w * ({term})) / sum(w)"
    text = f"WITH {base} SELECT round({'sqrt(' + mean + ')' if root else mean}, 6) AS value FROM r"

    def run(spark, sf):
        return evaluate_rows(frame(spark, sf), [metric], weight=weight, **options).select(F.round("value", 6).alias("value"))

    query(key, text)(run)


_register("eval_logloss", "logloss", _probabilities, PROB, "-(y * ln(p) + (1 - y) * ln(1 - p))")
_register("eval_error", "error", _probabilities, PROB, "CAST(CAST(p > 0.5 AS INT) <> y AS INT)")
_register("eval_error_at", "error@0.7", _probabilities, PROB, "CAST(CAST(p > 0.7 AS INT) <> y AS INT)")
_register("eval_merror", "merror", _class_probabilities, CLASSES, "CAST(list_position(p, list_max(p)) - 1 <> y AS INT)", weight=None)
_register("eval_mlogloss", "mlogloss", _class_probabilities, CLASSES, "-ln(p[y + 1])", weight=None)
_register("eval_rmse", "rmse", _prices, PRICE, "(y - p) * (y - p)", root=True)
_register("eval_mae", "mae", _prices, PRICE, "abs(y - p)")
_register("eval_mape", "mape", _prices, PRICE, "abs((y - p) / y)")
_register("eval_mphe", "mphe", _prices, PRICE, "sqrt(1 + (y - p) * (y - p)) - 1")
_register("eval_rmsle", "rmsle", _prices, PRICE, "(ln(1 + p) - ln(1 + y)) * (ln(1 + p) - ln(1 + y))", root=True)
_register("eval_poisson_nloglik", "poisson-nloglik", _grades, GRADE, "p - y * ln(p) + lgamma(y + 1)")
_register("eval_gamma_nloglik", "gamma-nloglik", _prices, PRICE, "y / p + ln(p)")
_register("eval_gamma_deviance", "gamma-deviance", _prices, PRICE, "2 * (y / p - ln(y / p) - 1)")
_register("eval_tweedie_nloglik", "tweedie-nloglik", _prices, PRICE,
          "-y * pow(p, -0.5) / -0.5 + pow(p, 0.5) / 0.5", tweedie_variance_power=1.5)


def _intervals(spark, sf):
    """Interval labels: every third line is right censored, every fourth has an exact time."""
    return binary_lines(spark, sf).select(
        F.col("price").alias("label"),
        F.col("price").alias("label_lower"),
        F.expr("case when grade = 0 then price when weight = 3.0D then cast(null as double) else price * 1.5D end").alias("label_upper"),
        F.col("guess").alias("pred"),
    )


INTERVALS = f"""{LINES_SQL}, r AS (SELECT price AS lo, CASE WHEN grade = 0 THEN price WHEN weight = 3 THEN NULL
  ELSE price * 1.5::DOUBLE END AS up, guess AS p, 1.0 AS w FROM lines)"""
_poly = repr(ERFC_FIT[-1])
for _c in reversed(ERFC_FIT[:-1]):
    _poly = f"({_poly}) * t + ({_c!r})"
AFT_NORMAL = f"""WITH {INTERVALS}, z AS (SELECT *, ln(lo) - ln(p) AS zl, ln(up) - ln(p) AS zu FROM r),
side AS (SELECT *, 1 / (1 + 0.5 * abs(zl / sqrt(2))) AS tl, 1 / (1 + 0.5 * abs(zu / sqrt(2))) AS tu FROM z),
tails AS (SELECT *, tl * exp(({_poly.replace('t +', 'tl +')}) - zl * zl / 2) AS el,
  tu * exp(({_poly.replace('t +', 'tu +')}) - zu * zu / 2) AS eu FROM side),
cdf AS (SELECT *, CASE WHEN zl >= 0 THEN 1 - 0.5 * el ELSE 0.5 * el END AS cl,
  CASE WHEN up IS NULL THEN 1.0 WHEN zu >= 0 THEN 1 - 0.5 * eu ELSE 0.5 * eu END AS cu FROM tails)
SELECT round(avg(-ln(greatest(CASE WHEN up IS NOT NULL AND lo = up THEN exp(-0.5 * zl * zl) / sqrt(2 * pi()) / lo
  ELSE cu - cl END, 1e-12))), 6) AS value FROM cdf"""


@query("eval_aft_nloglik", AFT_NORMAL)
def _aft(spark, sf):
    out = evaluate_rows(_intervals(spark, sf), ["aft-nloglik"], aft_loss_distribution="normal")
    return out.select(F.round("value", 6).alias("value"))


@query("eval_aft_nloglik_logistic", f"""WITH {INTERVALS},
z AS (SELECT *, 0.5 * (1 + tanh(0.5 * (ln(lo) - ln(p)))) AS cl, 0.5 * (1 + tanh(0.5 * (ln(up) - ln(p)))) AS cu FROM r)
SELECT round(avg(-ln(greatest(CASE WHEN up IS NOT NULL AND lo = up THEN cl * (1 - cl) / lo
  ELSE coalesce(cu, 1) - cl END, 1e-12))), 6) AS value FROM z""")
def _aft_logistic(spark, sf):
    out = evaluate_rows(_intervals(spark, sf), ["aft-nloglik"], aft_loss_distribution="logistic")
    return out.select(F.round("value", 6).alias("value"))


@query("eval_interval_accuracy", f"""WITH {INTERVALS} SELECT
  round(avg(CAST(p >= lo AND (up IS NULL OR p <= up) AS INT)), 6) AS value FROM r""")
def _interval(spark, sf):
    return evaluate_rows(_intervals(spark, sf), ["interval-regression-accuracy"]).select(F.round("value", 6).alias("value"))


@query("eval_auc", f"""WITH {LINES_SQL}, g AS (SELECT score, sum(weight * label) AS pos, sum(weight * (1 - label)) AS neg
  FROM lines GROUP BY score),
c AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM g)
SELECT round(sum(neg * (above + 0.5 * pos)) / (sum(pos) * sum(neg)), 6) AS value FROM c""")
def _auc(spark, sf):
    out = R.eval_auc(binary_lines(spark, sf), weight="weight")
    return out.select(F.round("auc", 6).alias("value"))


@query("eval_aucpr", f"""WITH {LINES_SQL}, g AS (SELECT score, sum(weight * label) AS pos, sum(weight * (1 - label)) AS neg
  FROM lines GROUP BY score),
c AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS t0, coalesce(sum(neg) OVER w, 0) AS f0 FROM g
  WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, 1 + neg / pos AS a, f0 - neg / pos * t0 AS b FROM c WHERE pos > 0)
SELECT round(sum(CASE WHEN b <> 0 THEN (pos - b / a * (ln(a * (t0 + pos) + b) - ln(a * t0 + b))) / a ELSE pos / a END)
  / sum(pos), 6) AS value FROM s""")
def _aucpr(spark, sf):
    out = R.eval_aucpr(binary_lines(spark, sf), weight="weight")
    return out.select(F.round("aucpr", 6).alias("value"))


def _rank_sql(top):
    limit = f"AND rn <= {top}" if top else ""
    ideal = f"AND best <= {top}" if top else ""
    return f"""WITH {LINES_SQL}, o AS (SELECT group_id, grade,
  row_number() OVER (PARTITION BY group_id ORDER BY score DESC, grade) AS rn,
  row_number() OVER (PARTITION BY group_id ORDER BY grade DESC) AS best,
  sum(CAST(grade > 0 AS INT)) OVER (PARTITION BY group_id ORDER BY score DESC, grade
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM lines),
g AS (SELECT group_id, coalesce(sum((pow(2, grade) - 1) / log2(rn + 1)) FILTER (WHERE true {limit}), 0) AS dcg,
  sum((pow(2, grade) - 1) / log2(best + 1)) FILTER (WHERE true {ideal}) AS idcg,
  coalesce(sum(hits::DOUBLE / rn) FILTER (WHERE grade > 0 {limit}), 0) AS found,
  sum(CAST(grade > 0 AS INT)) AS relevant FROM o GROUP BY group_id)"""


def _ndcg_sql(top):
    return _rank_sql(top) + " SELECT round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 1 END), 6) AS value FROM g"


def _map_sql(top):
    den = f"least(relevant, {top})" if top else "relevant"
    return _rank_sql(top) + f" SELECT round(avg(CASE WHEN relevant > 0 THEN found / {den} ELSE 1 END), 6) AS value FROM g"


def _ranked(name, fn, sql, top):
    def run(spark, sf):
        out = fn(binary_lines(spark, sf), "group_id", "score", "grade", top)
        return out.select(F.round(out.columns[0], 6).alias("value"))

    query(name, sql(top))(run)


_ranked("eval_ndcg", R.eval_ndcg, _ndcg_sql, None)
_ranked("eval_ndcg_at", R.eval_ndcg, _ndcg_sql, 3)
_ranked("eval_map", R.eval_map, _map_sql, None)
_ranked("eval_map_at", R.eval_map, _map_sql, 3)


@query("eval_cox_nloglik", f"""WITH {LINES_SQL}, r AS (SELECT price AS t, grade > 0 AS event, score / 10.0::DOUBLE AS m FROM lines),
g AS (SELECT t, sum(exp(m)) AS e, sum(CAST(event AS INT)) AS d, sum(CASE WHEN event THEN m ELSE 0 END) AS em FROM r GROUP BY t),
c AS (SELECT *, sum(e) OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS risk FROM g)
SELECT round(sum(CASE WHEN d > 0 THEN d * ln(risk) - em ELSE 0 END) / sum(d), 6) AS value FROM c""")
def _cox(spark, sf):
    df = binary_lines(spark, sf).select(
        F.expr("case when grade > 0 then price else -price end").alias("label"), F.expr("score / 10.0D").alias("margin")
    )
    return R.eval_cox_nloglik(df).select(F.round("cox_nloglik", 6).alias("value"))
