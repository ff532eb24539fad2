"""A table of request bodies to feature rows; every body is parsed inside its own row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treeline.sources.text import guess_delimiter, is_number, number, sparse_map


def payload_rows_csv(requests: DataFrame, request_id: str = "request_id", body: str = "body") -> DataFrame:
    """``request_id, row_idx, features, error``: one row per line; an empty field is missing.

    A field that is not a number sets ``error`` on its row; ``rejected_requests`` lists their requests.
    """
    text = F.regexp_replace(F.col(body).cast("string"), r"^\s+|\s+$", "")
    lines = requests.select(F.col(request_id), text.alias("t"))
    found = guess_delimiter(F.split("t", "\n")[0])
    lines = lines.withColumn("d", F.coalesce(found, F.lit(","))).select(request_id, "d", F.posexplode(F.split("t", "\n")).alias("row_idx", "line"))
    fields = F.split("line", F.concat(F.lit(r"\Q"), F.col("d"), F.lit(r"\E")))
    wrong = F.filter(fields, lambda f: (f != "") & ~is_number(f))
    return lines.select(
        request_id, "row_idx", F.transform(fields, number).alias("features"),
        F.when(F.size(wrong) > 0, F.concat(F.lit("not a number: "), wrong[0])).alias("error"),
    )


def rejected_requests(rows: DataFrame, request_id: str = "request_id") -> DataFrame:
    """Requests with at least one bad row; the whole request is refused."""
    return rows.where("error is not null").groupBy(request_id).agg(F.min("error").alias("error"))


def payload_rows_libsvm(
    requests: DataFrame, request_id: str = "request_id", body: str = "body", has_label: bool = False, repeated: str = "add"
) -> DataFrame:
    """``request_id, row_idx, features map<int, double>``.

    Tokens without a colon (labels) are skipped. When the smallest index of the body is 1 or more, all its
    indices move down by one. Repeated indices of a row add up, or the last wins (``repeated='last'``). A row with a
    token that is no ``index:value`` pair of numbers has NULL features; other rows and requests are not harmed.
    """
    text = F.regexp_replace(F.col(body).cast("string"), r"^\s+|\s+$", "")

    def entries(line):
        tokens = F.split(line, r"\s+")
        tokens = F.slice(tokens, 2, 1_000_000_000) if has_label else tokens
        pairs = F.transform(F.filter(tokens, lambda t: F.contains(t, F.lit(":"))), lambda t: F.split(t, ":"))
        return F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("int").alias("k"), F.get(p, F.lit(1)).try_cast("double").alias("v")))

    parsed = requests.select(F.col(request_id), F.transform(F.split(text, "\n"), entries).alias("rows"))
    smallest = F.array_min(F.transform(F.flatten("rows"), lambda e: e["k"]))
    parsed = parsed.withColumn("shift", F.when(smallest >= 1, F.lit(1)).otherwise(F.lit(0)))
    rows = parsed.select(request_id, "shift", F.posexplode("rows").alias("row_idx", "entries"))
    bad = F.exists("entries", lambda e: e["k"].isNull() | e["v"].isNull())
    rows = rows.withColumn("entries", F.when(~bad, F.col("entries")))
    moved = F.transform("entries", lambda e: F.struct((e["k"] - F.col("shift")).alias("k"), e["v"].alias("v")))
    rows = rows.select(request_id, "row_idx", moved.alias("entries"))
    if repeated == "last":
        last = F.map_from_entries(F.filter("entries", lambda e, i: ~F.exists(F.slice("entries", i + 2, F.lit(1_000_000_000)), lambda o: o["k"] == e["k"])))
        return rows.select(request_id, "row_idx", last.alias("features"))
    return rows.select(request_id, "row_idx", sparse_map(F.col("entries")).alias("features"))


def payload_rows_recordio(requests: DataFrame, request_id: str = "request_id", body: str = "body") -> DataFrame:
    """``request_id, row_idx, label, keys, values, width`` from binary bodies."""
    from treeline.sources.recordio import decode_records

    return decode_records(requests.select(F.col(request_id), F.col(body).alias("content")), request_id).withColumnRenamed("seq", "row_idx")
