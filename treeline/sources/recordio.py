"""RecordIO files of protobuf records: a small codec run on Arrow batches.

Files are cut into byte ranges that tasks read side by side. A frame belongs to the range in which its marker lies; a
task finds the first one at a marker from which lengths lead to further markers. A file must be one chain of frames: a
task looks some frames beyond its range, and where a chain ends early the query stops. (Files whose bodies end with
whole frames of their own need ``range_bytes`` above their length: from the middle they look like two chains.)
"""

from __future__ import annotations

import json
import struct
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from treeline.sources.manifest import open_system, open_to_tasks, qualified, read_channel, usable_files

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Frame marker, and the field numbers of record, value and tensor messages.
MAGIC = 0xCED7230A
FEATURES, LABEL = 1, 2
TENSOR_TYPES = {2: "<f4", 3: "<f8", 7: "varint"}
FLOAT32 = 2
VALUES, KEYS, SHAPE = 1, 2, 3
RECORD_ROWS = 4_096
RANGE_BYTES = 32 << 20
WINDOW = 2 << 20  # bytes of a range held at once
FRAMES_AHEAD = 4
SHORT_VARINTS = 24
ROW = "label double, keys array<long>, values array<double>, width long"


# -- frames


def _frame_end(header: bytes, at: int) -> int:
    """Where the frame ends whose eight bytes of header stand at ``at``."""
    magic, length = struct.unpack("<II", header)
    if magic != MAGIC:
        raise ValueError(f"invalid record marker at offset {at}")
    return at + 8 + length + (-length) % 4


def frames(buffer: bytes) -> Iterator[bytes]:
    """Record bytes of each frame: marker, length, body padded to four."""
    at = 0
    while at + 8 <= len(buffer):
        end = _frame_end(buffer[at : at + 8], at)
        if end > len(buffer):
            raise ValueError(f"truncated record at offset {at}")
        yield buffer[at + 8 : at + 8 + struct.unpack_from("<I", buffer, at + 4)[0]]
        at = end


def _follow(read: Callable[[int, int], bytes], at: int, size: int) -> None:
    """Raises unless some frames from ``at`` on are whole."""
    for _ in range(FRAMES_AHEAD):
        if size - at < 8:
            return
        end = _frame_end(read(at, 8), at)
        if end > size:
            raise ValueError(f"truncated record at offset {at}")
        at = end


def _windowed(read: Callable[[int, int], bytes], stop: int) -> Callable[[int, int], bytes]:
    """``read`` that fetches up to ``WINDOW`` bytes at a time, those before ``stop``, and keeps the last fetch."""
    begin, held = 0, b""

    def get(at: int, n: int) -> bytes:
        nonlocal begin, held
        if not begin <= at <= at + n <= begin + len(held):
            begin, held = at, b""  # the old bytes go before new ones come
            held = read(at, max(n, min(WINDOW, stop - at)))
        return held[at - begin : at - begin + n]

    return get


def _marks(read: Callable[[int, int], bytes], start: int, stop: int, size: int) -> Iterator[int]:
    """Places in ``start..stop`` at which a marker stands."""
    for low in range(start + -start % 4, stop, WINDOW):
        data = read(low, min(WINDOW, stop - low + 3, size - low))
        words = np.frombuffer(data, dtype="<u4", count=len(data) // 4)
        for place in np.flatnonzero(words == MAGIC).tolist():
            yield low + 4 * place


def first_frame(read: Callable[[int, int], bytes], start: int, stop: int, size: int) -> int | None:
    """Place of the first frame that starts in ``start..stop``, None if there is none."""
    for place in _marks(read, start, stop, size):
        at, chained, ahead = place, 0, 0
        try:
            # a marker inside a body leads nowhere; a longer chain that breaks is a broken file, which reading it shows
            while size - at >= 8 and ahead < FRAMES_AHEAD and chained <= 2:
                ahead += at + 8 > stop
                at, chained = _frame_end(read(at, 8), at), chained + 1
                if at > size:
                    chained -= 1
                    raise ValueError("truncated")
            return place
        except ValueError:
            if chained > 2:
                raise
    return None


def range_frames(read: Callable[[int, int], bytes], start: int, stop: int, size: int) -> Iterator[bytes]:
    """Record bytes of the frames that start in ``start..stop`` of a file of ``size`` bytes; ``read(at, n)`` gives bytes.

    Of the range one window is held at a time, or one frame if that is longer.
    """
    at = 0 if start == 0 else first_frame(read, start, stop, size)
    get = _windowed(read, stop)
    while at is not None and at < stop and size - at >= 8:
        header = get(at, 8)
        end = _frame_end(header, at)
        if end > size:
            raise ValueError(f"truncated record at offset {at}")
        yield get(at + 8, struct.unpack_from("<I", header, 4)[0])
        at = end
    if at is not None:
        _follow(read, at, size)


# -- records


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return value, at
        shift += 7


def _places(data: bytes, at: int, stop: int) -> Iterator[tuple[int, object]]:
    """(field number, place of the bytes or int) of one message inside ``data``."""
    while at < stop:
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 2, 5):
            size, at = _varint(data, at) if wire == 2 else (8 if wire == 1 else 4, at)
            value, at = (at, at + size), at + size
        else:
            raise ValueError(f"a record with wire type {wire}")
        if at > stop:
            raise ValueError("a record that ends inside a field")
        yield number, value


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, bytes or int) of one message."""
    for number, value in _places(data, 0, len(data)):
        yield number, value if isinstance(value, int) else data[slice(*value)]


def varints(data: bytes) -> np.ndarray:
    """Packed variable-length integers, signed by their 64 bits."""
    if len(data) <= SHORT_VARINTS:
        out, at = [], 0
        while at < len(data):
            value, at = _varint(data, at)
            out.append(value)
        return np.array(out, dtype=np.uint64).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    last = np.flatnonzero(raw < 0x80)
    if not len(last) or last[-1] != len(raw) - 1:
        raise ValueError("a record that ends inside a number")
    starts = np.append(0, last[:-1] + 1)
    shift = (np.arange(len(raw)) - np.repeat(starts, last - starts + 1)).astype(np.uint64) * np.uint64(7)
    return np.add.reduceat((raw & 0x7F).astype(np.uint64) << shift, starts).astype(np.int64)


def _numbers(data: bytes, value: object) -> np.ndarray:
    return np.array([value], dtype=np.uint64).astype(np.int64) if isinstance(value, int) else varints(data[slice(*value)])


def _tensor(data: bytes, place: tuple[int, int], kind: str) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, list]:
    """Values, keys, shape, and the places of values of fixed size."""
    values, keys, shape, places = [], [], [np.empty(0, dtype=np.int64)], []
    for number, value in _places(data, *place):
        if number == VALUES:
            if kind == "varint":
                values.append(_numbers(data, value).astype(float))
            else:
                places.append(value)
                values.append(np.frombuffer(data[slice(*value)], kind).astype(float))
        elif number == KEYS:
            keys.append(_numbers(data, value))
        elif number == SHAPE:
            shape.append(_numbers(data, value))
    return np.concatenate([np.empty(0), *values]), np.concatenate(keys) if keys else None, np.concatenate(shape), places


def _named(data: bytes, place: tuple[int, int]) -> tuple[str, tuple | None, str | None]:
    """Key, tensor and kind of one entry of a map."""
    key, tensor, found = "", None, None
    for part, inner in _places(data, *place):
        if part == 1:
            key = data[slice(*inner)].decode()
        else:
            for kind, body in _places(data, *inner):
                if kind in TENSOR_TYPES:
                    tensor, found = _tensor(data, body, TENSOR_TYPES[kind]), TENSOR_TYPES[kind]
    return key, tensor, found


def _entry(data: bytes) -> tuple[str, tuple | None]:
    """Key and tensor of the bytes of one entry."""
    return _named(data, (0, len(data)))[:2]


def _parse(data: bytes) -> tuple[dict, dict]:
    """Tensor and kind under the key ``values``, by field number."""
    found: dict[int, tuple] = {}
    kinds: dict[int, str] = {}
    for number, value in _places(data, 0, len(data)):
        if number not in (FEATURES, LABEL) or isinstance(value, int):
            continue
        key, tensor, kind = _named(data, value)
        if kind is not None:
            kinds[number] = kind
        if key == "values" and tensor is not None:
            found[number] = tensor
    return found, kinds


def read_record(data: bytes) -> tuple | None:
    """(label, keys, values, width) of one record, None for a record without feature values."""
    return _row(_parse(data)[0])


def _row(found: dict) -> tuple | None:
    if FEATURES not in found:
        return None
    values, keys, shape, _ = found[FEATURES]
    label = found[LABEL][0] if LABEL in found else ()
    width = shape[0] if len(shape) else (keys.max() + 1 if keys is not None and len(keys) else len(values))
    return (float(label[0]) if len(label) else None), keys, values, int(width)


def read_records(records: Sequence[bytes]) -> list[tuple | None]:
    """``read_record`` of each. Records that differ from the first of their length in values alone are read together."""
    out: list[tuple | None] = [None] * len(records)
    by_length: dict[int, list[int]] = {}
    for i, r in enumerate(records):
        by_length.setdefault(len(r), []).append(i)
    for length, places in by_length.items():
        found, kinds = _parse(records[places[0]])
        first = _row(found)
        spots = {n: found[n][3] for n in found if len(found[n][3]) == 1}
        if first is None or len(places) < 8 or len(spots) < len(found):
            for i in places:
                out[i] = read_record(records[i])
            continue
        raw = np.frombuffer(b"".join([records[i] for i in places]), dtype=np.uint8).reshape(len(places), length)
        fixed = np.ones(length, dtype=bool)
        for ((lo, hi),) in spots.values():
            fixed[lo:hi] = False
        same = (raw[:, fixed] == raw[0, fixed]).all(axis=1)
        table = {n: np.ascontiguousarray(raw[:, lo:hi]).view(kinds[n]).astype(float) for n, ((lo, hi),) in spots.items()}
        labels = table[LABEL] if LABEL in table else np.empty((len(places), 0))
        for k, i in enumerate(places):
            if same[k]:
                out[i] = ((float(labels[k, 0]) if labels.shape[1] else None), first[1], table[FEATURES][k], first[3])
            else:
                out[i] = read_record(records[i])
    return out


def _lists(arrays: Sequence[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0] + [0 if a is None else len(a) for a in arrays]).astype(np.int32)
    flat = np.concatenate([np.empty(0), *[a for a in arrays if a is not None]]) if kind == pa.float64() else np.concatenate([np.empty(0, dtype=np.int64), *[a for a in arrays if a is not None]])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind), mask=pa.array([a is None for a in arrays], pa.bool_()))


def _batch(fixed: list[tuple[str, pa.Array]], rows: Sequence[tuple]) -> pa.RecordBatch:
    label, keys, values, width = zip(*rows)
    columns = [*fixed, ("label", pa.array(label, pa.float64())), ("keys", _lists(keys, pa.int64())), ("values", _lists(values, pa.float64())), ("width", pa.array(width, pa.int64()))]
    return pa.RecordBatch.from_arrays([c for _, c in columns], [n for n, _ in columns])


def _chunks(records: Iterator[bytes]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    for record in records:
        held.append(record)
        if len(held) >= RECORD_ROWS:
            yield held
            held = []
    if held:
        yield held


def decode_records(df: DataFrame, key: str) -> DataFrame:
    """``key, seq, label, keys, values, width, error`` from a binary ``content`` column.

    A content that is not a whole chain of records with feature values, or has none, is one row with an error.
    """
    kind = df.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column(1).to_pylist()):
                error, chunks = None, []
                try:
                    chunks = [read_records(held) for held in _chunks(frames(content or b""))]
                    if len(content or b"") % 4 or not chunks:
                        error = "no records" if not chunks else "bytes after the last record"
                    elif any(row is None for rows in chunks for row in rows):
                        error = "a record without feature values"
                except (ValueError, IndexError, UnicodeDecodeError, struct.error, OverflowError) as e:
                    error = f"not RecordIO protobuf: {e}"
                name = batch.column(0).slice(i, 1)
                at = 0
                for rows in chunks if error is None else [[(None, None, None, None)]]:
                    names = pa.concat_arrays([name] * len(rows))
                    made = _batch([(key, names), ("seq", pa.array(range(at, at + len(rows)), pa.int64()))], rows)
                    yield made.append_column("error", pa.array([error] * len(rows), pa.string()))
                    at += len(rows)

    return df.select(key, "content").mapInArrow(decode, f"{key} {kind}, seq long, {ROW}, error string")


def read_ranges(ranges: DataFrame) -> DataFrame:
    """``path, start, seq, label, keys, values, width`` over ``path, start, stop, length``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop, size in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = open_system(path)
                with system.open_input_file(name) as file:
                    at = 0
                    for held in _chunks(range_frames(lambda place, n: file.read_at(n, place), start, stop, size)):
                        numbered = [(at + i, row) for i, row in enumerate(read_records(held)) if row is not None]
                        at += len(held)
                        if numbered:
                            n = len(numbered)
                            fixed = [("path", pa.array([path] * n, pa.string())), ("start", pa.array([start] * n, pa.int64())), ("seq", pa.array([i for i, _ in numbered], pa.int64()))]
                            yield _batch(fixed, [row for _, row in numbered])

    return ranges.select("path", "start", "stop", "length").mapInArrow(decode, f"path string, start long, seq long, {ROW}")


def with_features(df: DataFrame) -> DataFrame:
    """Adds ``features array<double>``: dense values, or sparse ones placed by key with NULL elsewhere."""
    placed = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("width") - 1),
        lambda i: F.get("values", (F.array_position("keys", i) - 1).cast("int")),
    )
    return df.withColumn("features", F.when(F.col("keys").isNull(), F.col("values")).otherwise(placed))


def scan_recordio_protobuf(spark: SparkSession, roots: str | Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, start, seq, label, keys, values, width`` of every record; no records at all is an error.

    ``start, seq`` order the records of a file: its byte range, and the number in it. Records without feature values
    are left out. In a store that tasks cannot open a file is one range, read by Spark.
    """
    if not all(open_to_tasks(qualified(spark, r)[0]) for r in ([roots] if isinstance(roots, str) else roots)):
        files = read_channel(spark, roots, spark.read.format("binaryFile").option("recursiveFileLookup", True).load)
        bodies = decode_records(files.select("path", "content"), "path")
        bad = F.raise_error(F.concat("path", F.lit(": "), "error"))
        rows = bodies.withColumn("seq", F.when(F.col("error").isNull(), F.col("seq")).otherwise(bad.cast("long")))
        rows = rows.select("path", F.lit(0).cast("long").alias("start"), *rows.columns[1:-1])
    else:
        files = usable_files(spark, roots)
        number = files.agg(F.sum(F.ceil(F.col("length") / range_bytes))).first()[0]
        if not number:
            raise FileNotFoundError(f"no usable files in {roots}")
        starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start")
        ranges = files.select("path", "length", starts).withColumn("stop", F.least(F.col("start") + range_bytes, F.col("length")))
        rows = read_ranges(ranges.repartition(int(number), "path", "start"))
    if rows.isEmpty():
        raise ValueError("no records found in the RecordIO data")
    return rows


def _pack(number: int, body: bytes) -> bytes:
    return _raw_varint(number << 3 | 2) + _raw_varint(len(body)) + body


def _raw_varint(value: int) -> bytes:
    out = b""
    while value >= 0x80:
        out += bytes([value & 0x7F | 0x80])
        value >>= 7
    return out + bytes([value])


def _map_entry(field: int, key: str, values, keys=None, width=None) -> bytes:
    tensor = _pack(VALUES, np.asarray(values, "<f4").tobytes())
    if keys is not None:
        tensor += _pack(KEYS, b"".join(_raw_varint(int(k)) for k in keys)) + _pack(SHAPE, _raw_varint(int(width)))
    return _pack(field, _pack(1, key.encode()) + _pack(2, _pack(FLOAT32, tensor)))


def _frame(body: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(body)) + body + b"\0" * (-len(body) % 4)


def _same_width(y: np.ndarray, x: np.ndarray) -> list[bytes]:
    """Records of rows of one width: one is made, its values are filled in for the others."""
    mark = np.full(x.shape[1], np.float32(np.nan)), [np.float32(np.nan)]
    body = _map_entry(FEATURES, "values", mark[0]) + _map_entry(LABEL, "values", mark[1])
    found, _ = _parse(body)
    whole = np.frombuffer(_frame(body), dtype=np.uint8)
    out = np.tile(whole, (len(x), 1))
    for n, values in ((FEATURES, x), (LABEL, y[:, None])):
        if values.shape[1]:
            lo, hi = found[n][3][0]
            out[:, 8 + lo : 8 + hi] = np.ascontiguousarray(values, dtype="<f4").view(np.uint8)
    return [row.tobytes() for row in out]


def encode_rows(label: Column, features: Column) -> Column:
    """One training record per row: dense float32 features and a label."""

    @F.pandas_udf("binary")
    def encode(y: pd.Series, x: pd.Series) -> pd.Series:
        out: list[bytes | None] = [None] * len(x)
        widths = x.map(len).to_numpy() if len(x) else np.empty(0, dtype=int)
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            rows = np.array([np.asarray(x.iloc[i], dtype=float) for i in at], dtype="<f4").reshape(len(at), width)
            for i, record in zip(at, _same_width(y.to_numpy()[at], rows)):
                out[i] = record
        return pd.Series(out)

    return encode(label.cast("double"), features.cast("array<double>"))


def encode_recordio(df: DataFrame, keys: Sequence[str], output: str = "record") -> DataFrame:
    """Adds one framed record per row with each key as a float32 tensor of the label map."""

    @F.pandas_udf("binary")
    def encode(rows: pd.DataFrame) -> pd.Series:
        columns = [rows[k] for k in keys]
        return pd.Series([_frame(b"".join(_map_entry(LABEL, k, v) for k, v in zip(keys, row))) for row in zip(*columns)])

    def as_list(name: str) -> Column:
        kind = dict(df.dtypes)[name]
        none = F.array(F.lit(None).cast("double"))  # a list that isn't applicable is one NaN
        return F.coalesce(F.col(name).cast("array<double>"), none) if kind.startswith("array") else F.array(F.col(name).cast("double"))

    return df.withColumn(output, encode(F.struct(*[as_list(k).alias(k) for k in keys])))


class RecordSink(DataSource):
    """Framed records as ``part-*.pb`` files that appear when the whole write is committed."""

    @classmethod
    def name(cls) -> str:
        return "framed_records"

    def writer(self, schema, overwrite):
        return _RecordWriter(self.options["path"])


class _RecordWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = open_system(self.folder)
        name = f"part-{task.partitionId():05d}-{self.job}.pb"
        held = f"{folder}/_temporary/{self.job}/{task.taskAttemptId()}"
        system.create_dir(held, recursive=True)
        count = 0
        with system.open_output_stream(f"{held}/{name}") as out:
            for batch in iterator:
                for body in batch.column(0).to_pylist():
                    out.write(body)
                    count += 1
        return _Written(f"{held}/{name}", name, count)

    def commit(self, messages) -> None:
        system, folder = open_system(self.folder)
        for m in messages:
            if m is not None and m.count:
                system.move(m.held, f"{folder}/{m.name}")
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/_SUCCESS") as out:
            out.write(json.dumps({"records": sum(m.count for m in messages if m is not None)}).encode())
        self._clear(system, folder)

    def abort(self, messages) -> None:
        self._clear(*open_system(self.folder))

    def _clear(self, system, folder: str) -> None:
        try:
            system.delete_dir(f"{folder}/_temporary/{self.job}")
            if not system.get_file_info(_inside(f"{folder}/_temporary")):
                system.delete_dir(f"{folder}/_temporary")
        except FileNotFoundError:
            pass


def _inside(folder: str):
    from pyarrow import fs

    return fs.FileSelector(folder, allow_not_found=True)


class _Written(WriterCommitMessage):
    def __init__(self, held: str, name: str, count: int):
        self.held, self.name, self.count = held, name, count


def write_records(df: DataFrame, record: str, path: str) -> int:
    """Writes framed records as ``part-*.pb`` files, one per partition with rows; returns how many records.

    Each attempt of a task writes a file of its own, and those of the successful ones are moved into the folder at the
    end, so lost executors and repeated tasks leave no partial or double file.
    """
    spark = df.sparkSession
    folder, _ = qualified(spark, path)
    spark.dataSource.register(RecordSink)
    df.select(F.col(record).cast("binary").alias("record")).write.format("framed_records").option("path", folder).mode("append").save()
    system, name = open_system(folder)
    with system.open_input_stream(f"{name}/_SUCCESS") as done:
        return json.loads(done.read())["records"]
