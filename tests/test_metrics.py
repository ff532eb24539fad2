"""Fixed labels and scores with exact fractions."""

import math

import pytest
from pyspark.sql import functions as F

from treeline.functions.scores import lgamma, margin_to_label, normal_cdf
from treeline.operators import confusion as C
from treeline.operators import ordering, ranking
from treeline.operators.batch_metrics import BatchMetric

BINARY = [1.0] * 5 + [0.0] * 5
MULTI = [0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0]


def scored(spark, labels, score):
    df = spark.createDataFrame([(y, score) for y in labels], "label double, score double")
    return df.withColumn("pred", margin_to_label(F.col("score")))


def values(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_binary(spark):
    got = values(C.metric_report(scored(spark, BINARY, math.log(0.7 / 0.3) - 0.5), ["accuracy", "balanced_accuracy", "f1", "f1_binary", "precision", "recall"]))
    assert got == pytest.approx({"accuracy": 0.5, "balanced_accuracy": 0.5, "f1": 1 / 3, "f1_binary": 2 / 3, "precision": 0.5, "recall": 1.0})


def test_multiclass(spark):
    names = ["accuracy", "balanced_accuracy", "f1", "f1_macro", "precision_macro", "precision_micro", "recall_macro", "recall_micro"]
    got = values(C.metric_report(scored(spark, MULTI, 1.0), names))
    want = [1 / 2, 1 / 3, 2 / 9, 2 / 9, 1 / 6, 1 / 2, 1 / 3, 1 / 2]
    assert got == pytest.approx(dict(zip(names, want)))


def test_binary_metric_on_three_classes_is_an_error(spark):
    with pytest.raises(Exception, match="multiclass"):
        C.metric_report(scored(spark, MULTI, 1.0), ["f1_binary"]).collect()


def test_regression(spark):
    df = spark.createDataFrame([(y, 1.0) for y in BINARY], "label double, pred double")
    assert values(C.metric_report(df, ["mse", "rmse", "mae", "r2"])) == pytest.approx({"mse": 0.5, "rmse": math.sqrt(0.5), "mae": 0.5, "r2": -1.0})


def test_constant_label_r2_and_empty_input(spark):
    same = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "label double, pred double")
    assert values(C.metric_report(same, ["r2"])) == {"r2": 1.0}
    assert values(C.metric_report(same.limit(0), ["accuracy", "mae"])) == {"accuracy": 0.0, "mae": 0.0}


def test_special_functions(spark):
    row = spark.range(1).select(lgamma(F.lit(0.5)).alias("a"), lgamma(F.lit(40.0)).alias("b"), normal_cdf(F.lit(-1.5)).alias("c")).first()
    assert row["a"] == pytest.approx(math.lgamma(0.5), abs=1e-10)
    assert row["b"] == pytest.approx(math.lgamma(40), abs=1e-9)
    assert row["c"] == pytest.approx(0.5 * math.erfc(1.5 / math.sqrt(2)), rel=1e-6)


def skewed(spark, n=600):
    """One group holds a third of the rows; scores repeat."""
    rows = [(0 if i % 3 == 0 else i, (i * 37 % 50) / 10.0, i * 7 % 4) for i in range(n)]
    return spark.createDataFrame(rows, "g int, score double, label int"), rows


def brute(rows, top=None):
    groups = {}
    for g, s, y in rows:
        groups.setdefault(g, []).append((s, y))
    ndcg, ap = [], []
    for members in groups.values():
        order = sorted(members, key=lambda r: (-r[0], r[1]))
        k = top or len(order)
        dcg = sum((2**y - 1) / math.log2(i + 2) for i, (_, y) in enumerate(order[:k]))
        best = sum((2**y - 1) / math.log2(i + 2) for i, y in enumerate(sorted((y for _, y in order), reverse=True)[:k]))
        ndcg.append(dcg / best if best else 1.0)
        hits, found = 0, 0.0
        for i, (_, y) in enumerate(order[:k]):
            if y > 0:
                hits += 1
                found += hits / (i + 1)
        relevant = sum(y > 0 for _, y in order)
        ap.append(found / (min(relevant, top) if top else relevant) if relevant else 1.0)
    return sum(ndcg) / len(ndcg), sum(ap) / len(ap)


@pytest.mark.parametrize("rows_per_range", [10**9, 40])
@pytest.mark.parametrize("top", [None, 2])
def test_ranking_against_brute_force(spark, monkeypatch, rows_per_range, top):
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", rows_per_range)
    df, rows = skewed(spark)
    ndcg, ap = brute(rows, top)
    assert ranking.eval_ndcg(df, "g", top=top).first()[0] == pytest.approx(ndcg)
    assert ranking.eval_map(df, "g", top=top).first()[0] == pytest.approx(ap)


@pytest.mark.parametrize("rows_per_range", [10**9, 40])
def test_auc_against_brute_force(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", rows_per_range)
    df, rows = skewed(spark)
    df = df.withColumn("label", (F.col("label") > 1).cast("int"))
    pos = [s for _, s, y in rows if y > 1]
    neg = [s for _, s, y in rows if y <= 1]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert ranking.eval_auc(df).first()[0] == pytest.approx(wins / (len(pos) * len(neg)))


@pytest.mark.parametrize("rows_per_range", [10**9, 40])
def test_cox_against_brute_force(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", rows_per_range)
    df, rows = skewed(spark)
    df = df.select(F.when(F.col("label") > 0, F.col("score") + 1).otherwise(-F.col("score") - 1).alias("label"), (F.col("g") % 5 / 5.0).alias("margin"))
    data = [(s + 1, y > 0, g % 5 / 5.0) for g, s, y in rows]
    loss = sum(math.log(sum(math.exp(m2) for t2, _, m2 in data if t2 >= t)) - m for t, e, m in data if e)
    assert ranking.eval_cox_nloglik(df).first()[0] == pytest.approx(loss / sum(e for _, e, _ in data))


def test_one_class_auc_is_an_error(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")
    with pytest.raises(Exception, match="only contains"):
        ranking.eval_auc(df).collect()


def test_long_tie_runs_are_cut_into_chunks(spark, monkeypatch):
    df = spark.createDataFrame([(1, 25)], "above int, n int")
    pieces = ordering.explode_run(df, F.col("above") + 1, F.col("n"), chunk=10)
    total = pieces.agg(F.sum(ordering.sum_over_run(lambda i: 1.0 / i)).alias("s"), F.count("*").alias("c")).first()
    assert total["c"] == 3 and total["s"] == pytest.approx(sum(1 / i for i in range(2, 27)))


def test_totals_keep_null_keys_apart(spark):
    rows = [("a", 0, 1, 1, 0.9), ("a", 1, 0, 1, 0.4), (None, 0, 1, 0, 0.2), (None, 1, 1, 1, 0.7), ("b", None, 0, 0, 0.1), ("b", 1, 1, 0, 0.3)]
    df = spark.createDataFrame(rows, "slice string, fold int, label int, pred int, guess double").repartition(3)
    names = ["accuracy", "f1", "recall", "mae", "r2"]
    for totals, sets in (("rollup", [["slice", "fold"], ["slice"], []]), ("cube", [["slice", "fold"], ["slice"], ["fold"], []])):
        out = C.metric_report_grouped(df, ["slice", "fold"], names, totals=totals, value="guess").collect()
        got = {(r["grouping_id"], r["slice"], r["fold"], r["metric"]): r["value"] for r in out}
        wanted = {}
        for keys in sets:
            bits = sum(bit for bit, k in ((2, "slice"), (1, "fold")) if k not in keys)
            for r in C.metric_report(df, names, value="guess", keys=keys).collect():
                wanted[bits, r["slice"] if "slice" in keys else None, r["fold"] if "fold" in keys else None, r["metric"]] = r["value"]
        assert len(out) == len(got) and got == pytest.approx(wanted)
    with pytest.raises(ValueError, match="rollup or cube"):
        C.metric_report_grouped(df, ["slice"], totals="all")


def test_python_metrics_add_up_over_pieces(spark):
    spread = BatchMetric(["label", "pred"], lambda y, p: [len(y), ((y - p) ** 2).sum()], lambda s: (s[1] / s[0]) ** 0.5)
    most = BatchMetric(["pred"], lambda p: [p.sum(), 1.0], lambda s: float(s[0] > 3))
    rows = spark.range(1000).selectExpr("nullif(id % 3, 2) AS fold", "nullif(concat('s', id % 2), 's1') AS slice", "id % 7 AS label", "id % 5 / 2D AS pred")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        out = C.user_metric(rows.repartition(7), {"rmse": spread, "large": most, "mean": F.avg("pred")}, ["fold", "slice"]).collect()
        whole = C.user_metric(rows, {"rmse": spread}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    same = rows.groupBy("fold", "slice").agg(F.sqrt(F.avg((F.col("label") - F.col("pred")) ** 2)).alias("v"), F.avg("pred").alias("m")).collect()
    assert len(out) == 18
    for r in same:
        got = {o["metric"]: o["value"] for o in out if (o["fold"], o["slice"]) == (r["fold"], r["slice"])}
        assert got == pytest.approx({"rmse": r["v"], "large": 1.0, "mean": r["m"]})
    assert [r["value"] for r in whole] == pytest.approx([rows.agg(F.sqrt(F.avg((F.col("label") - F.col("pred")) ** 2))).first()[0]])
    assert C.user_metric(rows.limit(0), {"rmse": spread}, ["fold"]).count() == 0
