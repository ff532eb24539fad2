"""Readers: each query writes files derived from a table, reads them back and returns what was read."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.frames import EVENTS_SQL, ORDERS_SQL, event_rows, order_rows
from catalog.registry import query, table
from treeline.session import scratch_path
from treeline.sources import content_types, manifest, payloads, recordio, tables, text

ROWS_SQL = f"""WITH {ORDERS_SQL} SELECT label, CAST(grade AS DOUBLE) AS weight, features[1] AS f0, features[2] AS f1,
  features[3] AS f2, features[4] AS f3 FROM ords"""


def _flat(spark, sf):
    df = order_rows(spark, sf)
    return df.select("label", F.col("grade").cast("double").alias("weight"), *[F.col("features")[i].alias(f"f{i}") for i in range(4)])


def _wide(df, n=4):
    return df.select("label", "weight", *[F.col("features")[i].alias(f"f{i}") for i in range(n)])


@query("scan_csv_labeled", ROWS_SQL)
def _csv(spark, sf):
    path = scratch_path(spark, "csv")
    _flat(spark, sf).write.csv(path)
    return _wide(text.scan_csv_labeled(spark, path, weight_col=True))


@query("scan_parquet_labeled", ROWS_SQL)
def _parquet(spark, sf):
    path = scratch_path(spark, "parquet")
    _flat(spark, sf).write.parquet(path)
    return _wide(tables.scan_parquet_labeled(spark, path, weight_col=True))


@query("scan_channel_glob", f"""WITH {ORDERS_SQL} SELECT label, 1.0::DOUBLE AS weight, features[1] AS f0, features[2] AS f1,
  features[3] AS f2, features[4] AS f3 FROM ords""")
def _glob(spark, sf):
    path = scratch_path(spark, "glob")
    _flat(spark, sf).drop("weight").write.csv(path)
    return _wide(tables.scan_channel_glob(spark, path, "csv"))


SEPARATORS = {"F": ",", "O": ";", "P": "|"}


@query("sniff_csv_delimiter", """SELECT DISTINCT o_orderstatus AS status,
  CASE o_orderstatus WHEN 'F' THEN ',' WHEN 'O' THEN ';' ELSE '|' END AS delimiter FROM orders""")
def _sniff(spark, sf):
    path = scratch_path(spark, "sniff")
    rows = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_custkey", "o_totalprice")
    for status, sep in SEPARATORS.items():
        rows.where(F.col("o_orderstatus") == status).drop("o_orderstatus").write.option("sep", sep).csv(f"{path}/status={status}")
    found = text.sniff_csv_delimiter(spark, path)
    return found.select(F.regexp_extract("path", "status=(.)", 1).alias("status"), "delimiter").distinct()


@query("scan_libsvm", f"""WITH {EVENTS_SQL} SELECT CAST(label AS DOUBLE) AS label, weight, features[1] AS f1, features[2] AS f2,
  features[3] AS f3 FROM evs""")
def _libsvm(spark, sf):
    path = scratch_path(spark, "libsvm")
    line = F.concat_ws(
        " ", F.concat_ws(":", F.col("label").cast("string"), F.col("weight").cast("string")),
        *[F.concat(F.lit(f"{i + 1}:"), F.col("features")[i].cast("string")) for i in range(3)],
    )
    event_rows(spark, sf).select(line.alias("value")).write.text(path)
    df = text.scan_libsvm(spark, path)
    return df.select("label", "weight", *[F.try_element_at("features", F.lit(i)).alias(f"f{i}") for i in (1, 2, 3)])


def _records(spark, sf):
    df = event_rows(spark, sf)
    return df.select("row_id", recordio.encode_rows(F.col("label"), F.col("features")).alias("record"))


RECORDS_SQL = f"""WITH {EVENTS_SQL} SELECT CAST(label AS DOUBLE) AS label, round(CAST(CAST(features[1] AS FLOAT) AS DOUBLE), 4) AS f0,
  features[2] AS f1, features[3] AS f2, CAST(3 AS BIGINT) AS width FROM evs"""


@query("scan_recordio_protobuf", RECORDS_SQL)
def _recordio(spark, sf):
    path = scratch_path(spark, "recordio")
    recordio.write_records(_records(spark, sf), "record", path)
    df = recordio.with_features(recordio.scan_recordio_protobuf(spark, path))
    return df.select("label", F.round(F.col("features")[0], 4).alias("f0"), F.col("features")[1].alias("f1"), F.col("features")[2].alias("f2"), "width")


@query("payload_rows_recordio", f"""WITH {EVENTS_SQL} SELECT row_id // 50 AS request_id,
  row_number() OVER (PARTITION BY row_id // 50 ORDER BY row_id) - 1 AS row_idx, CAST(label AS DOUBLE) AS label,
  features[2] AS f1 FROM evs""")
def _payload_recordio(spark, sf):
    grouped = _records(spark, sf).groupBy(F.expr("row_id div 50").alias("request_id")).agg(
        F.array_sort(F.collect_list(F.struct("row_id", "record"))).alias("all")
    )
    bodies = grouped.select("request_id", F.aggregate("all", F.lit(b""), lambda a, e: F.concat(a, e["record"])).alias("body"))
    df = recordio.with_features(payloads.payload_rows_recordio(bodies))
    return df.select("request_id", "row_idx", "label", F.col("features")[1].alias("f1"))


@query("channel_manifest", """SELECT DISTINCT 'o_orderstatus=' || o_orderstatus AS folder, CAST(2 AS INT) AS depth, true AS usable,
  CAST(NULL AS VARCHAR) AS reason FROM orders
  UNION ALL SELECT '' AS folder, CAST(1 AS INT), false, 'name starts with underscore' FROM region WHERE r_regionkey = 0""")
def _manifest(spark, sf):
    path = scratch_path(spark, "manifest")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    files = manifest.channel_manifest(spark, path)
    return files.select(F.regexp_extract("path", "(o_orderstatus=.)/", 1).alias("folder"), "depth", "usable", "reason").distinct()


@query("union_channels", """SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'P' THEN 'validation' ELSE 'train' END AS channel FROM orders""")
def _union(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus")
    return tables.union_channels(df.where("o_orderstatus <> 'P'"), df.where("o_orderstatus = 'P'")).select("row_id", "channel")


def _bodies(spark, sf, line):
    """Requests of fifty events each."""
    rows = event_rows(spark, sf).select(F.expr("row_id div 50").alias("request_id"), "row_id", line.alias("line"))
    grouped = rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("row_id", "line"))).alias("all"))
    return grouped.select("request_id", F.array_join(F.transform("all", lambda e: e["line"]), "\n").alias("body"))


def csv_bodies(spark, sf):
    return _bodies(spark, sf, F.array_join(F.transform("features", lambda v: v.cast("string")), ","))


@query("payload_rows_csv", f"""WITH {EVENTS_SQL} SELECT row_id // 50 AS request_id,
  CAST(row_number() OVER (PARTITION BY row_id // 50 ORDER BY row_id) - 1 AS INT) AS row_idx,
  features[1] AS f0, features[2] AS f1, features[3] AS f2 FROM evs""")
def _payload_csv(spark, sf):
    df = payloads.payload_rows_csv(csv_bodies(spark, sf))
    return df.select("request_id", "row_idx", *[F.col("features")[i].alias(f"f{i}") for i in range(3)])


@query("payload_rows_libsvm", f"""WITH {EVENTS_SQL} SELECT row_id // 50 AS request_id,
  CAST(row_number() OVER (PARTITION BY row_id // 50 ORDER BY row_id) - 1 AS INT) AS row_idx,
  features[1] AS f0, features[2] AS f1, features[3] + 1 AS f2 FROM evs""")
def _payload_libsvm(spark, sf):
    line = F.concat_ws(" ", F.col("label").cast("string"), *[F.concat(F.lit(f"{i + 1}:"), F.col("features")[i].cast("string")) for i in range(3)], F.lit("3:1.0"))
    df = payloads.payload_rows_libsvm(_bodies(spark, sf, line))
    return df.select("request_id", "row_idx", *[F.try_element_at("features", F.lit(i)).alias(f"f{i}") for i in range(3)])


TYPES = [
    ("text/csv; label_size=1", "csv"), ("text/csv;label_size = 1", "csv"), ("TEXT/LIBSVM ;charset=utf8", "libsvm"), (None, "libsvm"),
    ("application/x-parquet", "parquet"), ("text/csv; label_size=5", None), ("text/csv; label_size=1; label_size=2", None),
    ("application/x-recordio-protobuf", "recordio-protobuf"), ("label_size=1; text/csv", None), ("incorrect_format", None),
]


def _case(column, values):
    text_of = lambda v: "NULL" if v is None else f"'{v}'"
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN {text_of(v)}" for i, v in enumerate(values)) + " END"


@query("content_type_report", f"""WITH t AS (SELECT CAST({_case('c_nationkey % 10', [e for _, e in TYPES])} AS VARCHAR) AS format FROM customer)
SELECT format, format IS NOT NULL AS accepted, count(*) AS n FROM t GROUP BY ALL""")
def _types(spark, sf):
    df = table(spark, sf, "customer").select(F.expr(_case("c_nationkey % 10", [t for t, _ in TYPES])).alias("content_type"))
    return content_types.content_type_report(df)
