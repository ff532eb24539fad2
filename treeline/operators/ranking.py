"""Order-based evaluation metrics: area under curves, ranking per group, Cox likelihood."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from treeline.operators.ordering import (
    explode_run, range_bounds, running_totals, sum_over_run, with_range,
)


def score_runs(df: DataFrame, score: str, label: str, weight: str | None, keys: Sequence[str] = ()) -> DataFrame:
    """Weight of positives and negatives per distinct score, with what ranks strictly above it."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y = F.col(label).cast("double")
    rows = df.select(*keys, F.col(score).cast("double").alias("score"), (w * y).alias("pw"), (w * (1.0 - y)).alias("nw"))
    runs = rows.groupBy(*keys, "score").agg(F.sum("pw").alias("pos"), F.sum("nw").alias("neg"))
    bounds = range_bounds(rows, "score", keys)
    runs = with_range(runs, "score", bounds, descending=True)
    return running_totals(runs, keys, [F.col("score").desc()], "range_id", {"pos_above": "pos", "neg_above": "neg"}, single=not bounds)


def _grouped(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


def eval_auc(df: DataFrame, score: str = "score", label: str = "label", weight: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; tied scores count half. One class only is an error."""
    runs = score_runs(df, score, label, weight, keys)
    wins = F.sum(F.col("neg") * (F.col("pos_above") + 0.5 * F.col("pos")))
    pairs = F.sum("pos") * F.sum("neg")
    error = F.raise_error(F.lit("the dataset only contains pos or neg samples")).cast("double")
    return _grouped(runs, keys, F.when(pairs > 0, wins / pairs).otherwise(error).alias("auc"))


def eval_aucpr(df: DataFrame, score: str = "score", label: str = "label", weight: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Area under precision-recall with the interpolation of Davis and Goadrich (2006)."""
    runs = score_runs(df, score, label, weight, keys)
    slope = F.col("neg") / F.col("pos")
    a = 1.0 + slope
    b = F.col("neg_above") - slope * F.col("pos_above")
    t0, t1 = F.col("pos_above"), F.col("pos_above") + F.col("pos")
    curved = (F.col("pos") - b / a * (F.log(a * t1 + b) - F.log(a * t0 + b))) / a
    area = F.when(F.col("pos") <= 0, F.lit(0.0)).when(b != 0, curved).otherwise(F.col("pos") / a)
    return _grouped(runs, keys, (F.sum(area) / F.sum("pos")).alias("aucpr"))


def rank_runs(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """Rows of a group that share score and label, as one run ``n`` starting after ``above`` positions.

    Order: score descending, then label ascending (the pessimistic tie rule, so the result does not
    depend on row order). ``hits_above`` counts relevant rows before the run.
    """
    rows = df.select(
        F.col(group).alias("group"), F.col(score).cast("double").alias("score"), F.col(label).cast("double").alias("label")
    )
    runs = rows.groupBy("group", "score", "label").agg(F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("hits", F.when(F.col("label") > 0, F.col("n")).otherwise(F.lit(0)))
    bounds = range_bounds(rows, "score", ["group"])
    runs = with_range(runs, "score", bounds, descending=True)
    order = [F.col("score").desc(), F.col("label").asc()]
    return running_totals(runs, ["group"], order, "range_id", {"above": "n", "hits_above": "hits"}, single=not bounds)


def _within(top: int | None) -> Column:
    """How many of the run's positions lie in the first ``top``."""
    n = F.col("n")
    return n if top is None else F.greatest(F.least(n, F.lit(top) - F.col("above")), F.lit(0))


def eval_ndcg(df: DataFrame, group: str, score: str = "score", label: str = "label", top: int | None = None, empty: float = 1.0) -> DataFrame:
    """Mean over groups of DCG / ideal DCG with gain ``2**label - 1``; a group without relevant rows counts ``empty``."""
    def discount(i):
        return 1.0 / F.log2(i.cast("double") + 1.0)

    def gains(runs: DataFrame, dcg: Column, ideal: Column) -> DataFrame:
        kept = runs.withColumn("k", _within(top)).where((F.col("k") > 0) & (F.col("label") > 0))
        return explode_run(kept, F.col("above") + 1, F.col("k")).select("group", dcg.alias("dcg"), ideal.alias("ideal"))

    gain = (F.pow(F.lit(2.0), F.col("label")) - 1.0) * sum_over_run(discount)
    none = F.lit(0.0)
    grades = df.groupBy(F.col(group).alias("group"), F.col(label).cast("double").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    best_first = W.partitionBy("group").orderBy(F.col("label").desc()).rowsBetween(W.unboundedPreceding, -1)
    ideal = grades.withColumn("above", F.coalesce(F.sum("n").over(best_first), F.lit(0)))
    parts = gains(rank_runs(df, group, score, label), gain, none).unionByName(gains(ideal, none, gain))
    parts = parts.unionByName(grades.select("group", none.alias("dcg"), none.alias("ideal")))
    each = parts.groupBy("group").agg(F.sum("dcg").alias("dcg"), F.sum("ideal").alias("ideal"))
    value = F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(F.lit(float(empty)))
    return each.agg(F.avg(value).alias("ndcg"))


def eval_map(df: DataFrame, group: str, score: str = "score", label: str = "label", top: int | None = None, empty: float = 1.0) -> DataFrame:
    """Mean over groups of average precision (relevant = label above 0)."""
    runs = rank_runs(df, group, score, label)
    kept = runs.withColumn("k", _within(top)).where((F.col("k") > 0) & (F.col("hits") > 0))
    precision = sum_over_run(lambda i: (F.col("hits_above") + (i - F.col("above"))).cast("double") / i)
    found = explode_run(kept, F.col("above") + 1, F.col("k")).select("group", precision.alias("found"), F.lit(0).cast("bigint").alias("relevant"))
    y = F.col(label).cast("double")
    counts = df.groupBy(F.col(group).alias("group")).agg(F.count_if(y > 0).alias("relevant"))
    parts = found.unionByName(counts.select("group", F.lit(0.0).alias("found"), "relevant"))
    each = parts.groupBy("group").agg(F.sum("found").alias("found"), F.sum("relevant").alias("relevant"))
    denominator = F.col("relevant") if top is None else F.least(F.col("relevant"), F.lit(top))
    value = F.when(F.col("relevant") > 0, F.col("found") / denominator).otherwise(F.lit(float(empty)))
    return each.agg(F.avg(value).alias("map"))


def event_time(df: DataFrame, label: str = "label") -> Column:
    """The time of each row; rows that lie together by ``time`` have it as a column."""
    return F.col("time") if "time" in df.columns else F.abs(F.col(label).cast("double"))


def risk_sets(df: DataFrame, margin: str = "margin", label: str = "label", bounds: Sequence[float] | None = None) -> tuple[DataFrame, bool]:
    """Whether one range is enough, and per distinct time: events, their margins, and the sum of exp(margin) over rows still at risk."""
    rows = df.select(
        event_time(df, label).alias("time"),
        (F.col(label) > 0).alias("event"),
        F.col(margin).cast("double").alias("m"),
    )
    times = rows.groupBy("time").agg(
        F.sum(F.exp("m")).alias("weight"),
        F.sum(F.when(F.col("event"), 1).otherwise(0)).alias("events"),
        F.sum(F.when(F.col("event"), F.col("m")).otherwise(0.0)).alias("event_margin"),
    )
    bounds = range_bounds(rows, "time") if bounds is None else bounds
    times = with_range(times, "time", bounds, descending=True)
    times = running_totals(times, [], [F.col("time").desc()], "range_id", {"later": "weight"}, single=not bounds)
    return times.withColumn("at_risk", F.col("later") + F.col("weight")), not bounds


def eval_cox_nloglik(df: DataFrame, margin: str = "margin", label: str = "label", bounds: Sequence[float] | None = None) -> DataFrame:
    """Negative partial log likelihood per event; a negative label is a censored time."""
    loss = F.sum(F.when(F.col("events") > 0, F.col("events") * F.log("at_risk") - F.col("event_margin")).otherwise(0.0))
    return risk_sets(df, margin, label, bounds)[0].agg((loss / F.sum("events")).alias("cox_nloglik"))
