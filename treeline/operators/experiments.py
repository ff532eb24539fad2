"""Training logs and trial tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treeline.operators.evaluation import MAXIMIZE, MINIMIZE
from treeline.plans.parameters import ALIASES, REQUIRED, RULES

TAB = "#011"


def extract_metrics_from_logs(lines: DataFrame, line: str = "line", keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, round, metric, value`` from lines such as ``[3]#011validation-rmse:0.41``."""
    known = "|".join(sorted((*MAXIMIZE, *MINIMIZE), key=len, reverse=True))
    pattern = f"{TAB}validation-({known}):(\\S+)"
    round_number = F.regexp_extract(line, r"\[([0-9]+)\]", 1)
    body = F.regexp_replace(F.col(line), TAB, f" {TAB}")
    found = F.arrays_zip(
        F.regexp_extract_all(body, F.lit(pattern), 1).alias("metric"), F.regexp_extract_all(body, F.lit(pattern), 2).alias("value")
    )
    rows = lines.where(F.col(line).rlike(r"\[[0-9]+\].*" + TAB + "validation-")).select(*keys, round_number.cast("int").alias("round"), F.explode(found).alias("m"))
    return rows.select(*keys, "round", "m.metric", F.col("m.value").try_cast("double").alias("value"))


def best_trial(trials: DataFrame, metric: str = "metric", value: str = "value", trial: str = "trial") -> DataFrame:
    """Per tuning metric ``validation:<name>``: the trial with the best value (ties: the first by name)."""
    name = F.split(F.split(F.col(metric), ":")[1], ",")[0]
    up = F.split(name, "@")[0].isin(list(MAXIMIZE))
    score = F.when(up, F.col(value)).otherwise(-F.col(value))
    best = trials.where(F.col(value).isNotNull()).groupBy(F.col(metric).alias("metric")).agg(
        F.min(F.struct((-score).alias("s"), F.col(trial).alias("trial"), F.col(value).alias("value"))).alias("b"),
        F.first(F.when(up, F.lit("Maximize")).otherwise(F.lit("Minimize"))).alias("direction"),
    )
    return best.select("metric", "direction", F.col("b.trial").alias("trial"), F.col("b.value").alias("value"))


def trial_parameter_report(trials: DataFrame, trial: str = "trial", name: str = "name", value: str = "value") -> DataFrame:
    """``trial, name, problem`` for missing, unknown, unparsable and out-of-range parameters."""
    spark = trials.sparkSession
    rules = spark.createDataFrame(
        [(r[0], r[1], None if r[2] is None else float(r[2]), r[3], None if r[4] is None else float(r[4]), r[5], r[6]) for r in RULES],
        "name string, kind string, low double, low_open boolean, high double, high_open boolean, words string",
    )
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    given = trials.select(
        F.col(trial).alias("trial"), F.coalesce(F.try_element_at(aliases, F.col(name)), F.col(name)).alias("name"), F.trim(value).alias("value")
    )
    joined = given.join(F.broadcast(rules), "name", "left")
    text = F.col("value")
    numeric = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    whole = text.rlike(r"^[+-]?[0-9]+$")
    words = F.split("words", ",")
    entries = F.transform(F.split(text, ","), F.trim)
    base = F.transform(entries, lambda e: F.split(e, "@")[0])
    listed = F.when(F.col("kind") == "words", F.size(F.array_except(base, words)) == 0).otherwise(F.array_contains(words, text))
    below = F.when(F.col("low_open"), numeric <= F.col("low")).otherwise(numeric < F.col("low"))
    above = F.when(F.col("high_open"), numeric >= F.col("high")).otherwise(numeric > F.col("high"))
    problem = (
        F.when(F.col("kind").isNull(), "unknown")
        .when((F.col("kind") == "int") & ~whole, "unparsable")
        .when((F.col("kind") == "float") & numeric.isNull(), "unparsable")
        .when(F.col("kind").isin("int", "float") & (F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False))), "out of range")
        .when(F.col("kind").isin("word", "words") & ~listed, "out of range")
    )
    wrong = joined.withColumn("problem", problem).where("problem is not null").select("trial", "name", "problem")
    needed = given.select("trial").distinct().withColumn("name", F.explode(F.array(*[F.lit(r) for r in REQUIRED])))
    missing = needed.join(given, ["trial", "name"], "left_anti").withColumn("problem", F.lit("missing"))
    return wrong.unionByName(missing)


def log_lines(log: DataFrame) -> DataFrame:
    """Evaluation log rows as text lines, one line per fold and round."""
    part = F.concat(F.lit(TAB), F.col("data_name"), F.lit("-"), F.col("metric"), F.lit(":"), F.col("value").cast("string"))
    per = log.groupBy("fold", "round").agg(F.array_join(F.array_sort(F.collect_list(part)), "").alias("t"))
    return per.select("fold", "round", F.concat(F.lit("["), F.col("round"), F.lit("]"), F.col("t")).alias("line"))


