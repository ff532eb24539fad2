"""Operator 9: token ids as length-delimited binary records, with a separate offset index for shuffled reads.

File layout. A folder holds ``data/part-NNNNN-*`` and ``index``. A data file is a run of frames, each followed by
``MARK``:

    length of the body      unsigned 64-bit
    masked CRC-32 of those 8 bytes   unsigned 32-bit
    body                    id, place of the frame in its file (bytes), ids before it in its file, bytes per id,
                            number of ids (five signed 64-bit), then the ids (2 bytes each if all of them are below
                            65,536 and the frame doesn't hold ``MARK`` then, else 4)
    masked CRC-32 of the body        unsigned 32-bit

all little-endian; a mask rotates the checksum right by 15 bits and adds a constant, so that a checksum stored inside
data isn't its own checksum. Frames are written by Spark's own committed writer, so a lost executor or a repeated task
leaves no partial file, on any file system Spark reaches. ``MARK`` lets Spark split large files; ids of 4 bytes can't spell
it, because the highest byte of each is 0 (an id of 2**24 or more can raise). A reader that has the index needs only place
and size. Files are in ascending order of id, by number and inside.

Cases: a null text is empty and still has its end id; a null id sorts first and is stored as the smallest integer;
repeated ids are all kept, in any order among themselves; an empty table gives an empty index; other columns are not
read. A frame with a wrong length or checksum, or out of its place, raises.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.tokens import library_encoder, slices

MARK = "\n--frame ends 5d41f0a3c7--\n"
_MARK = MARK.encode()
NULL_ID = -(2**63)
_SIZE = struct.Struct("<QI")
_BODY = struct.Struct("<qqqqq")
_CHECK = struct.Struct("<I")


def masked(data: bytes) -> int:
    """Checksum of ``data`` as it is stored."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc: int | None, place: int, before: int, ids: np.ndarray) -> bytes:
    for width in (2, 4) if not len(ids) or int(ids.max()) < 1 << 16 else (4,):
        body = _BODY.pack(NULL_ID if doc is None else doc, place, before, width, len(ids)) + ids.astype(f"<u{width}").tobytes()
        size = struct.pack("<Q", len(body))
        out = size + _CHECK.pack(masked(size)) + body + _CHECK.pack(masked(body))
        if _MARK not in out:
            return out
    raise ValueError(f"the ids of document {doc} hold the frame mark")


def parse(data: bytes) -> tuple[int | None, int, int, np.ndarray]:
    """Id, place, ids before and ids of one frame; raises if it isn't whole."""
    if len(data) < _SIZE.size + _CHECK.size:
        raise ValueError(f"a frame of {len(data)} bytes")
    length, check = _SIZE.unpack_from(data)
    body = data[_SIZE.size : -_CHECK.size]
    if check != masked(data[:8]) or length != len(body) or _CHECK.unpack_from(data, len(data) - 4)[0] != masked(body):
        raise ValueError("a frame with a wrong length or checksum")
    doc, place, before, width, n = _BODY.unpack_from(body)
    ids = np.frombuffer(body, dtype=f"<u{width}", offset=_BODY.size)
    if len(ids) != n:
        raise ValueError(f"document {doc}: {len(ids)} ids instead of {n}")
    return None if doc == NULL_ID else doc, place, before, ids


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text with the library and writes the frames in ascending order of id.

    The texts are ordered before they are encoded: one shuffle, and sampling for its ranges reads no token.
    """
    step = len(_MARK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        end = np.array([end_id], dtype="<u4")
        place = before = 0
        for part in slices(batches, "text"):
            frames = []
            coded = encoder.encode([t or "" for t in part.column(1).to_pylist()])
            for doc, ids in zip(part.column(0).to_pylist(), coded, strict=True):
                ids = np.concatenate([np.frombuffer(ids, dtype="<u4"), end])
                frames.append(frame(doc, place, before, ids))
                place, before = place + len(frames[-1]) + step, before + len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    ordered = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id")
    rows = ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    rows.write.option("lineSep", MARK).option("compression", "none").option("maxRecordsPerFile", 0).text(f"{folder}/data")


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.schema("value string").option("lineSep", MARK).text(f"{folder}/data")
    return lines.select(F.col("value").cast("binary").alias("frame"), F.col("_metadata.file_name").alias("file"))


def read_records(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, ids array<int>`` of every frame, checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(x) for x in batch.column(0).to_pylist()]
            ids = [x[3].astype(np.int32) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return _frames(spark, folder).mapInArrow(run, f"{id_col} bigint, ids array<int>")


def write_index(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Reads and checks all frames and writes ``index``; returns it.

    ``file, file_no, place, size`` say where a frame lies, ``before`` how many ids its file holds before it;
    ``n_tokens`` and ``ids_crc32`` (over unsigned 32-bit ids) tell what it holds.
    """
    columns = [id_col, "file", "place", "size", "before", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = batch.column(0).to_pylist()
            found = [parse(x) for x in frames]
            crc = [zlib.crc32(x[3].astype("<u4").tobytes()) for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int64()), batch.column(1)]
                + [pa.array(v, pa.int64()) for v in ([x[1] for x in found], map(len, frames), [x[2] for x in found], [len(x[3]) for x in found], crc)],
                columns,
            )

    index = _frames(spark, folder).mapInArrow(run, f"{id_col} bigint, file string, " + ", ".join(f"{c} bigint" for c in columns[2:]))
    index = index.withColumn("file_no", F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint"))
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def with_start(index: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all frames before, over all files. Only totals per file meet in one task."""
    totals = index.groupBy("file_no").agg(F.sum("n_tokens").alias("in_file"))
    earlier = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file_no", F.coalesce(F.sum("in_file").over(earlier), F.lit(0)).alias("base"))
    return index.join(bases, "file_no").withColumn("start", F.col("base") + F.col("before")).drop("base")


def read_at(spark: SparkSession, folder: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, ids`` of the index rows ``wanted`` only: each task opens the files it needs and reads those ranges.

    Frames come in the order of ``wanted`` within its partitions, so shuffled rows of the index give shuffled reads.
    """
    places = wanted.select("file", "place", "size")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/data")
    base = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base.replace("file:/", "file:///", 1) if base.startswith("file:/") and "://" not in base else base)
        for batch in batches:
            found = []
            for name, place, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    doc, at, _, ids = parse(f.read_at(size, place))
                if at != place:
                    raise ValueError(f"{name} holds at {place} the frame of {at}")
                found.append((doc, ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int32()))], [id_col, "ids"])

    return places.mapInArrow(run, f"{id_col} bigint, ids array<int>")
