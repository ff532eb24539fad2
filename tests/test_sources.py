"""Readers and payload parsers on small fixed inputs."""

import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.sources import content_types, manifest, payloads, recordio, tables, text

CSV = "0,1,0,0,0,0\r\n" * 4 + "1,0,1,0,0,0"
WEIGHTED = "0,0.2,1,0,0,0,0\r\n" * 4 + "1,0.2,0,1,0,0,0"
DENSE_INT = b"\n#\xd7\xce\x13\x00\x00\x00\n\x11\n\x06values\x12\x07:\x05\n\x03*\x06\t\x00"
DENSE_DOUBLE = (
    b"\n#\xd7\xce(\x00\x00\x00\n&\n\x06values\x12\x1c\x1a\x1a\n\x18\x00\x00\x00"
    b'\x00\x00\x00E@\x00\x00\x00\x00\x00\x00\x18@\x00\x00\x00\x00\x00\x00"@'
)
SPARSE_INT = b"\n#\xd7\xce\x19\x00\x00\x00\n\x17\n\x06values\x12\r:\x0b\n\x02\x01\x01\x12\x02\x00\x05\x1a\x01\x06\x00\x00\x00"


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_csv(spark, tmp_path):
    put(tmp_path, "plain/train.csv", CSV)
    put(tmp_path, "weights/train.csv.weights", WEIGHTED)
    plain = text.scan_csv_labeled(spark, str(tmp_path / "plain"))
    assert plain.count() == 5 and plain.first()["features"] == [1.0, 0.0, 0.0, 0.0, 0.0]
    weighted = text.scan_csv_labeled(spark, str(tmp_path / "weights"), weight_col=True)
    assert {r["weight"] for r in weighted.collect()} == {0.2} and len(weighted.first()["features"]) == 5


def csv_rows(df):
    return sorted(((r["label"], r["weight"], r["features"]) for r in df.collect()), key=str)


def test_each_csv_file_has_its_own_delimiter(spark, tmp_path):
    put(tmp_path, "c/a b.csv", "\n1,2,3\n4,,6\n")
    put(tmp_path, "c/b.csv", "7;8;9\n")
    put(tmp_path, "c/c.csv", f"{'0' * 600}1|nan|-inf\n")
    want = [(1.0, 1.0, [2.0, 3.0]), (1.0, 1.0, [None, float("-inf")]), (4.0, 1.0, [None, 6.0]), (7.0, 1.0, [8.0, 9.0])]
    for df in (text.scan_csv_labeled(spark, str(tmp_path / "c")), tables.scan_channel_glob(spark, str(tmp_path / "c"), "csv")):
        assert csv_rows(df) == want and df.count() == 4
    weighted = text.scan_csv_labeled(spark, str(tmp_path / "c/b.csv"), weight_col=True)
    assert csv_rows(weighted) == [(7.0, 8.0, [9.0])]


@pytest.mark.parametrize("second", ["4,5\n", "4,5,6,7\n", "1,2,3\n4,5,6,7\n", "1,2,3\n4,5\n", "1,2,3\n4,five,6\n", "1;2;3;4\n", "1,2,3\n4;5;6\n"])
def test_csv_rows_that_differ_are_errors(spark, tmp_path, second):
    put(tmp_path, "c/a.csv", "1,2,3\n")
    put(tmp_path, "c/b.csv", second)
    for scan in (lambda p: text.scan_csv_labeled(spark, p), lambda p: tables.scan_channel_glob(spark, p, "csv")):
        with pytest.raises(Exception, match="differ in width|no number|MALFORMED|Malformed"):
            scan(str(tmp_path / "c")).collect()


def test_libsvm(spark, tmp_path):
    put(tmp_path, "a/train.libsvm", "1 2:1\n" * 4 + "0 4:1")
    put(tmp_path, "b/train.libsvm", "1:0.2 2:1\n" * 4 + "0:0.2 4:1")
    df = text.scan_libsvm(spark, str(tmp_path / "a"))
    assert df.count() == 5 and text.sparse_width(df) == 5
    assert {r["weight"] for r in text.scan_libsvm(spark, str(tmp_path / "b")).collect()} == {0.2}
    dense = text.dense_features(df.where("label = 0"), 5).first()["features"]
    assert dense == [None, None, None, None, 1.0]


def test_parquet_and_glob(spark, tmp_path):
    df = spark.createDataFrame([(0.0, 1.0, 2.0), (1.0, 3.0, None)], "y double, a double, b double")
    df.write.parquet(str(tmp_path / "p"))
    rows = sorted(tables.scan_parquet_labeled(spark, str(tmp_path / "p")).collect(), key=lambda r: r["label"])
    assert [r["features"] for r in rows] == [[1.0, 2.0], [3.0, None]]
    for i in (1, 2):
        put(tmp_path, f"g/train_{i}.csv", CSV)
    put(tmp_path, "g/notes.txt", "skip me")
    assert tables.scan_channel_glob(spark, str(tmp_path / "g"), "csv").count() == 10
    with pytest.raises(ValueError):
        tables.scan_channel_glob(spark, str(tmp_path / "g"), "libsvm")


def test_manifest(spark, tmp_path):
    put(tmp_path, "c/a.csv", CSV)
    put(tmp_path, "c/d2/d3/ok.csv", CSV)
    put(tmp_path, "c/d2/d3/d4/deep.csv", CSV)
    put(tmp_path, "c/_meta", "x")
    put(tmp_path, "c/x.dtrain.cache", "x")
    rows = {r["name"]: r for r in manifest.channel_manifest(spark, str(tmp_path / "c")).collect()}
    assert [n for n in sorted(rows) if rows[n]["usable"]] == ["a.csv", "ok.csv"]
    assert rows["deep.csv"]["depth"] == 4 and rows["deep.csv"]["reason"] == "folder too deep"
    assert manifest.channel_size(spark, str(tmp_path / "c")) == 3 * len(CSV) + 2
    assert manifest.channel_size(spark, str(tmp_path / "none")) == 0
    put(tmp_path, "c/.hidden", "x")
    with pytest.raises(ValueError, match="hidden"):
        manifest.channel_size(spark, str(tmp_path / "c"))
    put(tmp_path, "deep/a/b/c/d.csv", CSV)
    with pytest.raises(FileNotFoundError):
        manifest.usable_paths(spark, str(tmp_path / "deep"))


def test_duplicate_files(spark, tmp_path):
    put(tmp_path, "t/a.csv", CSV)
    put(tmp_path, "v/a.csv", CSV)
    put(tmp_path, "t/b.csv", CSV)
    put(tmp_path, "v/b.csv", CSV + "\n")
    assert [r["name"] for r in manifest.duplicate_files(spark, str(tmp_path / "t"), str(tmp_path / "v")).collect()] == ["a.csv"]


def test_format_checks(spark, tmp_path):
    put(tmp_path, "csv/good.csv", CSV)
    put(tmp_path, "csv/bad.csv", "abc\n1,2\n")
    got = {os.path.basename(r["path"]): r["ok"] for r in text.validate_csv_files(spark, str(tmp_path / "csv")).collect()}
    assert got == {"good.csv": True, "bad.csv": False}
    put(tmp_path, "svm/good", "1 1:2\n0:0.5 1:2 3:4\nbroken\n")
    put(tmp_path, "svm/bad", "1 1:2\nbroken\n0 1:2 3:4\n")
    put(tmp_path, "svm/empty", "1\n0\n")
    put(tmp_path, "svm/three", "1:2:3 1:2 2:3\n")
    got = {os.path.basename(r["path"]): (r["ok"], r["snippet"]) for r in text.validate_libsvm_files(spark, str(tmp_path / "svm")).collect()}
    assert got == {"good": (True, None), "bad": (False, "broken"), "empty": (True, None), "three": (False, "1:2:3 1:2 2:3")}


ACCEPTED = {
    "libsvm": "libsvm", "text/libsvm": "libsvm", "text/x-libsvm": "libsvm", "csv": "csv", "text/csv": "csv",
    "text/csv; label_size=1": "csv", "text/csv;label_size = 1": "csv", "text/csv; charset=utf-8": "csv",
    "text/csv; label_size=1; charset=utf-8": "csv", "parquet": "parquet", "application/x-parquet": "parquet",
    "recordio-protobuf": "recordio-protobuf", "application/x-recordio-protobuf": "recordio-protobuf",
}
REJECTED = [
    "incorrect_format", "text/csv; label_size=5", "text/csv; label_size=1=1", "text/csv; label_size=1; label_size=2", "label_size=1; text/csv",
]


def test_content_types(spark):
    df = spark.createDataFrame([(t,) for t in [*ACCEPTED, *REJECTED]], "t string")
    got = {r["t"]: r["k"] for r in df.select("t", content_types.normalized_type(F.col("t")).alias("k")).collect()}
    assert got == {**ACCEPTED, **{t: None for t in REJECTED}}


@pytest.mark.parametrize("body,rows", [("42,6,9", [[42.0, 6.0, 9.0]]), ("42\n6\n9\n", [[42.0], [6.0], [9.0]]), ("1;;3", [[1.0, None, 3.0]])])
def test_csv_payload(spark, body, rows):
    df = payloads.payload_rows_csv(spark.createDataFrame([(1, body)], "request_id int, body string"))
    got = sorted(df.collect(), key=lambda r: r["row_idx"])
    assert [r["features"] for r in got] == rows and all(r["error"] is None for r in got)


@pytest.mark.parametrize("body", ["1,2,3,12:12:12", "1,2,3,2019-1-1", "1,2,3,-14 days", "1,2,3\n1,2,c", "1,2,1d"])
def test_csv_payload_errors(spark, body):
    df = payloads.payload_rows_csv(spark.createDataFrame([(1, body)], "request_id int, body string"))
    assert payloads.rejected_requests(df).count() == 1


def test_libsvm_payload(spark):
    df = spark.createDataFrame([(1, "0 0:1 5:1"), (2, "0:1 5:1"), (3, "1 1:2 3:4\n0 2:1 2:2")], "request_id int, body string")
    got = {(r["request_id"], r["row_idx"]): r["features"] for r in payloads.payload_rows_libsvm(df).collect()}
    assert got == {(1, 0): {0: 1.0, 5: 1.0}, (2, 0): {0: 1.0, 5: 1.0}, (3, 0): {0: 2.0, 2: 4.0}, (3, 1): {1: 3.0}}
    last = {(r["request_id"], r["row_idx"]): r["features"] for r in payloads.payload_rows_libsvm(df, repeated="last").collect()}
    assert last[(3, 1)] == {1: 2.0}


def test_recordio_bytes(spark, tmp_path):
    for name, content in (("a.pb", DENSE_INT), ("b.pb", DENSE_DOUBLE), ("c.pb", SPARSE_INT)):
        put(tmp_path, f"r/{name}", content)
    df = recordio.with_features(recordio.scan_recordio_protobuf(spark, str(tmp_path / "r")))
    got = {os.path.basename(r["path"]): r["features"] for r in df.collect()}
    assert got == {"a.pb": [42.0, 6.0, 9.0], "b.pb": [42.0, 6.0, 9.0], "c.pb": [1.0, None, None, None, None, 1.0]}
    with pytest.raises(ValueError, match="marker"):
        list(recordio.frames(b"\0" * 12))
    with pytest.raises(ValueError, match="truncated"):
        list(recordio.frames(DENSE_INT[:20]))


def test_manifest_is_listed_in_tasks(spark, tmp_path):
    for name, content in (("c/a b.csv", CSV), ("c/_d/x+y.csv", CSV), ("c/_d/.e/z%.csv", CSV), ("c/k=1/b.csv", CSV), ("c/d/e/f/wide.csv", "1,2,3,4\n"), ("c/d/empty.csv", "")):
        put(tmp_path, name, content)
    root = str(tmp_path / "c")
    rows = channel = {r["name"]: r for r in manifest.channel_manifest(spark, root).collect()}
    assert {n: (r["depth"], r["length"], r["usable"]) for n, r in rows.items()} == {
        "a b.csv": (1, len(CSV), True), "x+y.csv": (2, len(CSV), True), "z%.csv": (3, len(CSV), True), "b.csv": (2, len(CSV), True),
        "wide.csv": (4, 8, False), "empty.csv": (2, 0, True),
    }
    assert all(r["path"].startswith("file:/") and r["root"] == root for r in channel.values())
    with pytest.warns(UserWarning, match="1 files"):
        df = text.scan_csv_labeled(spark, root)
    assert df.count() == 4 * len(CSV.strip().splitlines())
    lines = text.text_lines(spark, root)
    assert {os.path.basename(r["path"]) for r in lines.select("path").distinct().collect()} == {"a b.csv", "x+y.csv", "z%.csv", "b.csv"}
    one = {r["name"]: r["depth"] for r in manifest.channel_manifest(spark, f"{root}/a b.csv").collect()}
    assert one == {"a b.csv": 1} and text.scan_csv_labeled(spark, f"{root}/a b.csv").count() == len(CSV.strip().splitlines())
    assert manifest.channel_manifest(spark, str(tmp_path / "none")).count() == 0


def test_plan_of_a_channel_names_folders(spark, tmp_path):
    for i in range(30):
        put(tmp_path, f"p/f{i}.csv", CSV)
    df = text.scan_csv_labeled(spark, str(tmp_path / "p"))
    assert df.count() == 30 * len(CSV.strip().splitlines())
    plan = df._jdf.queryExecution().toString()
    assert "f7.csv" not in plan and "Exchange" not in plan


def test_csv_of_several_kinds(spark, tmp_path):
    put(tmp_path, "m/a.csv", "1,2,3\n\n4,5,6\n")
    put(tmp_path, "m/b.csv", "\n7;8;9\r\n10;11;12")
    got = sorted((r["label"], r["features"]) for r in text.scan_csv_labeled(spark, str(tmp_path / "m")).collect())
    assert got == [(1.0, [2.0, 3.0]), (4.0, [5.0, 6.0]), (7.0, [8.0, 9.0]), (10.0, [11.0, 12.0])]
    put(tmp_path, "q/a.csv", '1,"2",3\n')
    put(tmp_path, "q/b.csv", '"4","5","6"\n')
    assert text.scan_csv_labeled(spark, str(tmp_path / "q")).count() == 2
    put(tmp_path, "g/x.csv", "1,2\n")
    put(tmp_path, "g/deeper/y.csv", "1,2,3\n")
    assert tables.scan_channel_glob(spark, str(tmp_path / "g"), "csv").count() == 1


def test_a_store_that_only_spark_opens(spark, tmp_path, monkeypatch):
    put(tmp_path, "s/a.csv", CSV)
    put(tmp_path, "s/d/b.csv", CSV)
    put(tmp_path, "s/_c.csv", CSV)
    monkeypatch.setattr(manifest, "open_to_tasks", lambda uri: False)
    monkeypatch.setattr(text, "open_to_tasks", lambda uri: False)
    rows = {r["name"]: (r["depth"], r["length"]) for r in manifest.channel_manifest(spark, str(tmp_path / "s")).collect()}
    assert rows == {"a.csv": (1, len(CSV)), "b.csv": (2, len(CSV))}
    assert text.scan_csv_labeled(spark, str(tmp_path / "s")).count() == 2 * len(CSV.strip().splitlines())


def test_one_record_file_is_read_by_many_tasks(spark, tmp_path):
    rows = spark.range(700).select(
        F.col("id").cast("double").alias("label"), F.when(F.col("id") % 50 == 7, F.array(*[F.lit(2.0)] * 90)).otherwise(F.array((F.col("id") / 4).cast("double"), F.lit(-1.5))).alias("features")
    )
    path = str(tmp_path / "r")
    framed = rows.coalesce(1).select(recordio.encode_rows(F.col("label"), F.col("features")).alias("record"))
    assert recordio.write_records(framed, "record", path) == 700
    assert [n for n in os.listdir(path) if n.endswith(".pb")] and not os.path.exists(f"{path}/_temporary")
    want = sorted((r["label"], list(r["features"])) for r in rows.collect())
    for size in (1 << 25, 4000, 1500):
        df = recordio.scan_recordio_protobuf(spark, path, size)
        assert df.rdd.getNumPartitions() > 10 or size > 4000
        got = df.orderBy("start", "seq").collect()
        assert [(r["label"], r["values"]) for r in got] == want
    assert recordio.write_records(framed.limit(0), "record", str(tmp_path / "none")) == 0


def test_broken_record_files_stop_the_query(spark, tmp_path):
    one = recordio._frame(recordio._map_entry(recordio.FEATURES, "values", [1.0, 2.0]))
    for k, content in enumerate((one * 20 + b"junkjunk" + one * 20, one * 39 + one[:-4], one * 20 + b"\1" * len(one) + one * 20)):
        put(tmp_path, f"b{k}/x.pb", content)
        for size in (4, len(one), 3 * len(one) - 4, 1 << 20):
            with pytest.raises(ValueError, match="marker|truncated"):
                for start in range(0, len(content), size):
                    list(recordio.range_frames(lambda at, n: content[at : at + n], start, min(start + size, len(content)), len(content)))
        with pytest.raises(Exception) as error:
            recordio.scan_recordio_protobuf(spark, str(tmp_path / f"b{k}"), 400).count()
        assert "marker" in str(error.value) or "truncated" in str(error.value)
    # a marker inside a body is no frame
    fake = recordio._frame(b"\x0a\x02\x0a\x00" + recordio._map_entry(recordio.FEATURES, "values", [*np.frombuffer(recordio._frame(b"12345678"), "<f4"), 1.0]))
    put(tmp_path, "f/x.pb", (one + fake) * 20)
    assert recordio.scan_recordio_protobuf(spark, str(tmp_path / "f"), 200).count() == 40


def test_record_bodies_that_are_none(spark):
    one = recordio._frame(recordio._map_entry(recordio.FEATURES, "values", [1.0, 2.0]))
    empty = recordio._frame(recordio._map_entry(recordio.LABEL, "values", [1.0]))
    bodies = [(1, one * 3), (2, b"garbage!"), (3, b""), (4, None), (5, one + b"x"), (6, one[:-2]), (7, empty), (8, recordio._frame(b"\xff\xff\xff"))]
    got = payloads.payload_rows_recordio(spark.createDataFrame(bodies, "request_id int, body binary")).collect()
    assert sorted((r["request_id"], r["row_idx"], r["error"] is None) for r in got) == [(1, 0, True), (1, 1, True), (1, 2, True), *[(k, 0, False) for k in range(2, 9)]]


def test_varints_of_any_length():
    r = random.Random(2)
    numbers = [r.choice([0, 1, 127, 128, 2**31, 2**63 - 1, -1, -(2**63), r.randrange(2**40)]) for _ in range(200)]
    packed = b"".join(recordio._raw_varint(n % (1 << 64)) for n in numbers)
    assert recordio.varints(packed).tolist() == numbers and recordio.varints(recordio._raw_varint(300)).tolist() == [300]
    with pytest.raises(ValueError):
        recordio.varints(packed + b"\x80")


def test_a_range_is_read_in_windows(monkeypatch):
    bodies = [bytes([i % 251]) * (i * 37 % 90) for i in range(400)] + [b"x" * 700, struct.pack("<II", recordio.MAGIC, 12) + b"no frame"]
    file = b"".join(recordio._frame(b) for b in bodies)
    asked = []

    def read(at, n):
        asked.append(n)
        return file[at : at + n]

    monkeypatch.setattr(recordio, "WINDOW", 128)
    for size in (250, 4_000, len(file)):
        found = [b for lo in range(0, len(file), size) for b in recordio.range_frames(read, lo, min(lo + size, len(file)), len(file))]
        assert found == bodies
    assert max(asked) <= 700 and sorted(asked)[-10] <= 128
