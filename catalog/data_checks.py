"""Checks over whole tables and files, sampling, and joins by row id."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.frames import EVENTS_SQL, ORDERS_SQL, event_rows, order_rows
from catalog.registry import query, table
from treeline.operators import checks, folds, pairs, sampling
from treeline.operators.crossval import attach_predictions
from treeline.operators.gradients import scale_positive_weight
from treeline.session import scratch_path
from treeline.sources import manifest, text


@query("validate_csv_files", "SELECT DISTINCT o_orderstatus AS status, o_orderstatus <> 'P' AS ok FROM orders")
def _csv(spark, sf):
    path = scratch_path(spark, "check-csv")
    rows = table(spark, sf, "orders")
    rows.where("o_orderstatus <> 'P'").select("o_orderstatus", "o_orderkey", "o_custkey").write.partitionBy("o_orderstatus").csv(f"{path}/a")
    rows.where("o_orderstatus = 'P'").select("o_orderstatus", "o_orderkey").write.partitionBy("o_orderstatus").csv(f"{path}/b")
    found = text.validate_csv_files(spark, path)
    return found.select(F.regexp_extract("path", "o_orderstatus=(.)", 1).alias("status"), "ok").distinct()


@query("validate_libsvm_files", """SELECT DISTINCT event_type, event_type <> 'error' AS ok, event_type <> 'error' AS has_features FROM events""")
def _libsvm(spark, sf):
    path = scratch_path(spark, "check-libsvm")
    rows = table(spark, sf, "events")
    line = F.when(F.col("event_type") == "error", F.concat_ws(" ", F.lit("1"), F.lit("value"), F.col("value").cast("string"))).otherwise(
        F.concat_ws(" ", F.lit("1:0.5"), F.concat(F.lit("1:"), F.col("value").cast("string")), F.lit("2:3"))
    )
    rows.select("event_type", line.alias("value")).write.partitionBy("event_type").text(path)
    found = text.validate_libsvm_files(spark, path)
    return found.select(F.regexp_extract("path", "event_type=([^/]+)", 1).alias("event_type"), "ok", "has_features").distinct()


@query("duplicate_files", "SELECT DISTINCT o_orderstatus AS status, true AS all_found FROM orders")
def _files(spark, sf):
    path = scratch_path(spark, "duplicates")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    out = None
    for status in ("F", "O", "P"):
        folder = f"{path}/o_orderstatus={status}"
        same = manifest.duplicate_files(spark, folder, folder).agg(F.count(F.lit(1)).alias("n"))
        files = manifest.channel_manifest(spark, folder).agg(F.count(F.lit(1)).alias("m"))
        part = same.join(F.broadcast(files), F.col("n") == F.col("m")).select(F.lit(status).alias("status"), (F.col("n") > 0).alias("all_found"))
        out = part if out is None else out.unionByName(part)
    return out


@query("require_labels", """SELECT count(*) AS rows, count(quality) AS labels FROM documents LEFT JOIN labels USING (doc_id)""")
def _labels(spark, sf):
    df = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return checks.require_labels(df, "quality")


@query("label_range_check", f"""WITH {ORDERS_SQL} SELECT 'label must be in [0,1] for logistic regression' AS rule,
  count(*) FILTER (WHERE label < 0 OR label > 1) AS violations FROM ords
  UNION ALL SELECT 'label must be in [0, num_class)', count(*) FILTER (WHERE grade < 0 OR grade >= 5) FROM ords
  UNION ALL SELECT 'PoissonRegression: label must be nonnegative', count(*) FILTER (WHERE label < 0) FROM ords""")
def _ranges(spark, sf):
    df = order_rows(spark, sf)
    out = checks.label_range_check(df, "binary:logistic")
    out = out.unionByName(checks.label_range_check(df, "multi:softprob", 5, label="grade"))
    return out.unionByName(checks.label_range_check(df, "count:poisson"))


@query("prediction_size_check", """SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) FILTER (WHERE d.doc_id IS NULL) AS extra
  FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def _sizes(spark, sf):
    return checks.prediction_size_check(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("width_check", f"""WITH {ORDERS_SQL} SELECT CAST(max(len(features)) AS INT) AS width, max(len(features)) IN (5, 4) AS ok FROM ords""")
def _width(spark, sf):
    return checks.width_check(order_rows(spark, sf), 5, "csv")


@query("dataset_shape", f"WITH {ORDERS_SQL} SELECT count(*) AS rows, CAST(max(len(features)) AS INT) AS columns FROM ords")
def _shape(spark, sf):
    return checks.dataset_shape(order_rows(spark, sf))


@query("partition_balance", "SELECT count(*) AS rows, CAST(7 AS BIGINT) AS partitions, true AS even FROM lineitem")
def _balance(spark, sf):
    balance = checks.partition_balance(table(spark, sf, "lineitem").repartition(7))
    even = F.max("rows") - F.min("rows") <= 64
    return balance.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("partitions"), even.alias("even"))


@query("row_subsample", f"""WITH {EVENTS_SQL} SELECT row_id FROM evs
  WHERE ('0x' || substr(md5('7|3|0|' || row_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.6""")
def _subsample(spark, sf):
    return sampling.row_subsample(event_rows(spark, sf), "row_id", 0.6, seed=7, round_number=3).select("row_id")


@query("column_subsample", """WITH f AS (SELECT DISTINCT label AS tree, unnest(range(len(embedding))) AS feature FROM embeddings),
r AS (SELECT tree, feature, row_number() OVER (PARTITION BY tree
  ORDER BY ('0x' || substr(md5('7|' || tree || '|-|-|' || feature), 1, 8))::BIGINT, feature) AS r, count(*) OVER (PARTITION BY tree) AS n FROM f)
SELECT tree, CAST(feature AS INT) AS feature FROM r WHERE r <= ceil(n * 0.3::DOUBLE)""")
def _columns(spark, sf):
    df = table(spark, sf, "embeddings").select(F.col("label").alias("tree"), F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("feature"))
    return sampling.column_subsample(df.distinct(), 0.3, seed=7)


@query("scale_positive_weight", f"WITH {EVENTS_SQL} SELECT row_id, CASE WHEN label = 1 THEN weight * 4.5 ELSE weight END AS weight FROM evs")
def _positive(spark, sf):
    df = event_rows(spark, sf)
    return df.select("row_id", scale_positive_weight(F.col("label"), F.col("weight"), 4.5).alias("weight"))


@query("fold_slice", f"""WITH {EVENTS_SQL}, f AS (SELECT row_id, (row_number() OVER (ORDER BY md5('5|0|' || row_id), row_id) - 1) % 4 AS fold FROM evs)
SELECT row_id, CASE WHEN fold = 2 THEN 'held_out' ELSE 'train' END AS part FROM f""")
def _slice(spark, sf):
    assigned = folds.kfold_assign(event_rows(spark, sf).select("row_id"), "row_id", 4, seed=5)
    train, held = folds.fold_slice(assigned, 2)
    return train.select("row_id", F.lit("train").alias("part")).unionByName(held.select("row_id", F.lit("held_out").alias("part")))


@query("attach_predictions", "SELECT doc_id AS row_id, n_chars, quality AS prediction FROM documents LEFT JOIN labels USING (doc_id)")
def _attach(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "n_chars")
    preds = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("prediction"))
    return attach_predictions(rows, preds)


@query("rank_pairs", f"""WITH {ORDERS_SQL}, p AS (SELECT group_id, row_id, grade,
  row_number() OVER (PARTITION BY group_id ORDER BY grade, md5('3|' || row_id), row_id) - 1 AS pos FROM ords),
b AS (SELECT group_id, grade, count(*) AS same FROM ords GROUP BY ALL),
c AS (SELECT *, coalesce(sum(same) OVER (PARTITION BY group_id ORDER BY grade ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  sum(same) OVER (PARTITION BY group_id) AS size FROM b),
d AS (SELECT p.*, start, same, ('0x' || substr(md5('3|0|' || row_id || '|' || pair), 1, 8))::BIGINT % (size - same) AS r
  FROM p JOIN c USING (group_id, grade) CROSS JOIN (SELECT unnest([0, 1]) AS pair) WHERE size > same),
j AS (SELECT d.group_id, d.row_id AS a, d.grade AS ga, o.row_id AS b, o.grade AS gb FROM d JOIN p o
  ON o.group_id = d.group_id AND o.pos = CASE WHEN r < start THEN r ELSE r + same END)
SELECT group_id AS "group", CASE WHEN ga > gb THEN a ELSE b END AS high_id, CASE WHEN ga > gb THEN b ELSE a END AS low_id,
  greatest(ga, gb) AS high_label, least(ga, gb) AS low_label FROM j""")
def _pairs(spark, sf):
    return pairs.rank_pairs(order_rows(spark, sf), label="grade", pairs_per_row=2, seed=3)


@query("duplicate_rows", """WITH c AS (SELECT c_custkey % 2 AS side, c_nationkey AS nation, c_mktsegment AS segment,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(floor(c_acctbal / 250) AS BIGINT) END AS step FROM customer)
SELECT nation, segment, step, count(*) AS n FROM c a WHERE side = 1 AND EXISTS (SELECT 1 FROM c b
  WHERE b.side = 0 AND b.nation = a.nation AND b.segment = a.segment AND b.step IS NOT DISTINCT FROM a.step) GROUP BY ALL""")
def _duplicate_rows(spark, sf):
    step = F.expr("CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 250) AS BIGINT) END").alias("step")
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), step)
    train, validation = (rows.where(F.col("c_custkey") % 2 == side).drop("c_custkey") for side in (0, 1))
    return checks.duplicate_rows(train, validation)
