"""Whole-table checks made before training and before scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LOGISTIC = ("reg:logistic", "binary:logistic", "binary:logitraw")


def require_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """``rows, labels``; raises when rows were read but none carries a label."""
    out = df.agg(F.count(F.lit(1)).alias("rows"), F.count(label).alias("labels"))
    row = out.first()
    if row["rows"] > 0 and row["labels"] == 0:
        raise ValueError("got input data without labels, please check the input data set")
    return out


def label_rules(objective: str, num_class: int | None, label: str = "label") -> dict[str, Column]:
    """Count of labels outside the objective's domain, per rule that applies."""
    y = F.col(label)
    rules: dict[str, Column] = {}
    if objective in LOGISTIC:
        rules["label must be in [0,1] for logistic regression"] = F.count_if((y < 0) | (y > 1))
    if objective.startswith("multi:"):
        rules["label must be in [0, num_class)"] = F.count_if((y < 0) | (y >= int(num_class)))
    if objective == "count:poisson":
        rules["PoissonRegression: label must be nonnegative"] = F.count_if(y < 0)
    if objective == "reg:tweedie":
        rules["TweedieRegression: label must be nonnegative"] = F.count_if(y < 0)
    return rules


def label_range_check(df: DataFrame, objective: str, num_class: int | None = None, label: str = "label", auc: bool = False) -> DataFrame:
    """``rule, violations`` for the rules that apply to the objective, in one aggregate."""
    y = F.col(label)
    rules = label_rules(objective, num_class, label)
    if auc:
        one_sided = (F.count_if(y > 0) == 0) | (F.count_if(y <= 0) == 0)
        rules["AUC: the dataset only contains pos or neg samples"] = one_sided.cast("bigint")
    if not rules:
        rules["label must not be missing"] = F.count_if(y.isNull())
    pairs = [F.struct(F.lit(name).alias("rule"), count.cast("bigint").alias("violations")) for name, count in rules.items()]
    return df.agg(F.array(*pairs).alias("all")).select(F.explode("all").alias("r")).select("r.rule", "r.violations")


def prediction_size_check(rows: DataFrame, predictions: DataFrame, row_id: str = "row_id") -> DataFrame:
    """``missing, extra``: rows without a prediction, and predictions without a row."""
    a = rows.select(row_id).withColumn("__in_rows", F.lit(1))
    b = predictions.select(row_id).withColumn("__in_preds", F.lit(1))
    both = a.join(b, row_id, "full")
    return both.agg(F.count_if(F.col("__in_preds").isNull()).alias("missing"), F.count_if(F.col("__in_rows").isNull()).alias("extra"))


def width_check(df: DataFrame, model_width: int, content_type: str, features: str = "features") -> DataFrame:
    """``width, ok``: LIBSVM data may have one column more than the model, others the same or one less."""
    out = dataset_shape(df, features).select(F.col("columns").alias("width"))
    w = F.col("width")
    ok = w <= model_width + 1 if content_type == "libsvm" else w.isin(model_width, model_width - 1)
    return out.select("width", ok.alias("ok"))


def dataset_shape(df: DataFrame, features: str = "features") -> DataFrame:
    """``rows, columns`` of dense or map features."""
    is_map = dict(df.dtypes)[features].startswith("map")
    width = F.array_max(F.map_keys(features)) + 1 if is_map else F.size(features)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.max(width).cast("int").alias("columns"))


def partition_balance(df: DataFrame) -> DataFrame:
    """``partition, rows``, empty partitions included."""
    parts = df.rdd.getNumPartitions()
    counts = df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))
    every = df.sparkSession.range(parts).select(F.col("id").cast("int").alias("partition"))
    return every.join(counts, "partition", "left").select("partition", F.coalesce("rows", F.lit(0)).alias("rows"))


def duplicate_rows(train: DataFrame, validation: DataFrame) -> DataFrame:
    """Rows of ``validation`` that also stand in ``train``, with ``n``: how often they stand in ``validation``.

    Compared over all columns of ``validation`` with NULL equal to NULL. Both sides are counted before they meet, so a
    row that is repeated very often is one row of the join.
    """
    columns = validation.columns
    left = validation.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    right = train.select(*[F.col(c).alias(f"__{c}") for c in columns]).distinct()
    same = F.xxhash64(*[left[c] for c in columns]) == F.xxhash64(*[right[f"__{c}"] for c in columns])
    for c in columns:
        same = same & left[c].eqNullSafe(right[f"__{c}"])
    return left.join(right, same, "left_semi")
