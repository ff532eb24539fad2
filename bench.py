"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "metric_report", "metric_report_grouped", "eval_logloss", "eval_auc", "eval_aucpr", "eval_ndcg", "eval_map",
    "eval_cox_nloglik", "kfold_assign", "stratified_kfold_assign", "rank_pairs", "feature_bins", "gradient_pairs",
    "node_histogram", "best_split", "predict_trees", "predict_contribs", "ensemble_mean", "scan_csv_labeled",
    "scan_libsvm", "scan_recordio_protobuf", "payload_rows_csv", "batch_transform", "fit_with_weights",
)


def train_lineitem(spark, sf_dir):
    """Five rounds of depth four on every line item; the rows need no key because margins live on them."""
    from pyspark.sql import functions as F

    from treeline.plans.boosting import fit_boosted_trees

    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.expr("l_extendedprice / 100000.0D").alias("label"),
        F.array("l_quantity", "l_discount", "l_tax", F.expr("cast(l_partkey % 100 as double)")).alias("features"),
    )
    model = fit_boosted_trees(df, {"num_round": 5, "max_depth": 4, "max_bin": 64})
    return model.log_frame(spark)


def main() -> None:
    from catalog import QUERIES
    from treeline import build_session

    spark = build_session(
        "bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = {name: QUERIES[name] for name in HEADLINE}
    todo["fit_lineitem_5x4"] = train_lineitem
    seconds = {}
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    for name, run in todo.items():
        started = time.time()
        run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
