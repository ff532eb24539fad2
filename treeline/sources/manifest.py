"""Input selection: which files of a channel are read, and why others are not.

Folders are listed inside tasks, breadth first: the root in one, its folders and theirs spread over many, each deeper
tree by the task that met it. Names and lengths are all that is read, and they stay a frame. Readers are given folders;
a condition on the file that Spark itself applies while it plans the scan leaves the others out.

A store that only Spark's readers can open is listed by Spark's own file index, which shows no hidden files.
"""

from __future__ import annotations

import re
import sys
import warnings
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Batch functions travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_FOLDER_DEPTH = 3
LISTING = "root string, base string, path string, depth int, length long, folder boolean"
HEAD_BYTES = 1 << 16


def qualified(spark: SparkSession, root: str) -> tuple[str, bool]:
    """The full name of a root, as its file system gives it, and whether it exists."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString().rstrip("/"), fs.exists(path)


def open_system(uri: str):
    """File system and path of a name like ``file:/a/b`` or ``s3://bucket/a`` for use inside a task."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")


def open_to_tasks(uri: str) -> bool:
    """Whether the store of ``uri`` can be opened without Spark's readers."""
    try:
        open_system(uri)
        return True
    except Exception:
        return False


def _children(base: str, folder: str) -> Iterator[tuple[str, int, bool]]:
    """``name, length, is folder`` of what lies in a folder, or of a file itself; without the checksum files that
    Hadoop keeps beside local files and never shows."""
    from pyarrow import fs

    system, path = open_system(folder)
    if folder == base and system.get_file_info(path).type == fs.FileType.File:
        yield "", system.get_file_info(path).size, False
        return
    for found in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        checksum = folder.startswith("file:") and found.base_name.startswith(".") and found.base_name.endswith(".crc")
        if found.type in (fs.FileType.File, fs.FileType.Directory) and not checksum:
            yield found.base_name, found.size or 0, found.type == fs.FileType.Directory


def _step(deeper: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists every folder among the rows, and with ``deeper`` the folders in it to the end; files pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["root", "base", "path", "depth", "length", "folder"]
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            rows: list[tuple] = []
            todo = list(zip(*(c.to_pylist() for c in batch.columns)))
            while todo:
                row = todo.pop()
                root, base, path, depth, _, folder = row
                if not folder:
                    rows.append(row)
                    continue
                for name, size, is_folder in _children(base, path):
                    child = (root, base, f"{path}/{name}" if name else path, depth + 1, size, is_folder)
                    (todo if is_folder and deeper else rows).append(child)
                    if len(rows) >= 4096:
                        yield made(rows)
                        rows = []
            if rows:
                yield made(rows)

    return run


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``root, base, path, depth, length`` of every file below ``root``; none if it does not exist."""
    base, there = qualified(spark, root)
    if there and not open_to_tasks(base):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
        depth = F.greatest(F.size(F.split("path", "/")) - F.lit(base.count("/") + 1), F.lit(1))
        return files.select(F.lit(root).alias("root"), F.lit(base).alias("base"), "path", depth.alias("depth"), "length")
    rows = spark.createDataFrame([(root, base, base, 0, 0, True)] if there else [], LISTING)
    tasks = spark.sparkContext.defaultParallelism
    for deeper in (False, False, True):
        rows = rows.mapInArrow(_step(deeper), LISTING)
        rows = rows if deeper else rows.repartition(tasks, "path")
    return rows.drop("folder")


def why_not(name: Column, depth: Column, deepest: int = MAX_FOLDER_DEPTH) -> Column:
    """Why a file of this name and depth is not read; NULL if it is."""
    cache = F.contains(name, F.lit(".cache")) & (F.contains(name, F.lit("dtrain")) | F.contains(name, F.lit("dval")))
    return (
        F.when(depth > deepest, "folder too deep")
        .when(F.startswith(name, F.lit(".")), "hidden file")
        .when(F.startswith(name, F.lit("_")), "name starts with underscore")
        .when(cache, "cache file")
    )


def channel_manifest(spark: SparkSession, roots: str | Sequence[str]) -> DataFrame:
    """``root, path, name, depth, length, usable, reason`` for one folder, one file, or a list of them."""
    files = None
    for root in [roots] if isinstance(roots, str) else roots:
        found = listing(spark, root)
        files = found if files is None else files.unionByName(found)
    files = files.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)).withColumn("reason", why_not(F.col("name"), F.col("depth")))
    return files.select("root", "path", "name", "depth", "length", F.col("reason").isNull().alias("usable"), "reason")


def channel_size(spark: SparkSession, roots: str | Sequence[str]) -> int:
    """Total bytes; 0 for a missing path; a file starting with a dot anywhere below is an error."""
    row = channel_manifest(spark, roots).agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count_if(F.startswith("name", F.lit("."))).alias("hidden")
    ).first()
    if row["hidden"]:
        raise ValueError("hidden file found in the data path, remove it before training")
    return row["bytes"]


def usable_paths(spark: SparkSession, roots: str | Sequence[str]) -> list[tuple[str, str]]:
    """``(root, folder)`` to read, of roots that hold at least one usable file together; files are only counted.

    Spark's readers pass over folders whose names start with a dot or an underscore, so those with usable files are
    folders of their own here.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    out: list[tuple[str, str]] = []
    usable = deep = 0
    for root in roots:
        base, _ = qualified(spark, root)
        inner = F.split(F.substring(F.col("path"), len(base) + 2, 1 << 30), "/")
        folders = F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0)))
        hidden = F.filter(F.sequence(F.lit(1), F.greatest(F.size(folders), F.lit(1))), lambda i: F.get(folders, i - 1).rlike(r"^(\.|_[^=]*$)"))
        hidden = F.transform(hidden, lambda i: F.array_join(F.slice(folders, 1, i), "/"))
        row = channel_manifest(spark, root).where("length > 0").agg(
            F.count_if("usable").alias("usable"), F.count_if(F.col("depth") > MAX_FOLDER_DEPTH).alias("deep"),
            F.flatten(F.collect_set(F.when(F.col("usable") & (F.size(hidden) > 0), hidden))).alias("hidden"),
        ).first()
        usable, deep = usable + row["usable"], deep + row["deep"]
        if row["usable"]:
            out += [(base, base), *((base, f"{base}/{folder}") for folder in sorted(set(row["hidden"])))]
    if deep:
        warnings.warn(f"{deep} files below folder depth {MAX_FOLDER_DEPTH} in {roots} are not read", stacklevel=2)
    if not usable:
        raise FileNotFoundError(f"no usable files at folder depth {MAX_FOLDER_DEPTH} or less in {roots}")
    return out


def read_channel(
    spark: SparkSession, roots: str | Sequence[str], read: Callable[[str], DataFrame], deepest: int = MAX_FOLDER_DEPTH, folders: list[tuple[str, str]] | None = None
) -> DataFrame:
    """What ``read`` makes of the channel's folders, without the files that are not usable.

    ``read`` must take a folder with all that is below it (``recursiveFileLookup``); the files are left out while the
    scan is planned, before any of them is opened. ``folders`` are the ``usable_paths`` if they are known.
    """
    out = None
    for base, folder in folders or usable_paths(spark, roots):
        inside = re.sub(r"^[A-Za-z0-9+.-]+:(//[^/]*)?", "", base)
        path = F.regexp_replace("_metadata.file_path", r"^[A-Za-z0-9+.-]+:(//[^/]*)?", "")
        depth = F.greatest(F.size(F.split(path, "/")) - F.lit(inside.count("/") + 1), F.lit(1))
        rows = read(folder).where(why_not(F.col("_metadata.file_name"), depth, deepest).isNull() & (F.col("_metadata.file_size") > 0))
        rows = rows.select("*", F.expr("try_url_decode(replace(_metadata.file_path, '+', '%2B'))").alias("__path"), F.col("_metadata.file_block_start").alias("__block"))
        out = rows if out is None else out.unionByName(rows)
    return out


def first_lines(files: DataFrame) -> DataFrame:
    """``path, first_line, line`` of each row of a manifest: the first line, and the first that is not blank.

    A task reads the head of a file, not the file; a file without lines has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                system, name = open_system(path)
                with system.open_input_stream(name) as stream:
                    head, ended = b"", False
                    while True:
                        more = stream.read(HEAD_BYTES)
                        head, ended = head + more, not more
                        lines = re.split(rb"\r\n|\r|\n", head)
                        whole = lines if ended else lines[:-1]
                        text = next((x for x in whole if x.strip()), None)
                        if ended or text is not None:
                            break
                rows.append((path, *(None if x is None else x.decode("utf-8", "replace") for x in (whole[0] if head else None, text))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 3, ["path", "first_line", "line"])

    return files.select("path").mapInArrow(run, "path string, first_line string, line string")


def usable_files(spark: SparkSession, roots: str | Sequence[str]) -> DataFrame:
    """The rows of the manifest that are read."""
    return channel_manifest(spark, roots).where("usable and length > 0")


def duplicate_files(spark: SparkSession, train: str, validation: str) -> DataFrame:
    """Files directly in both folders with the same name and the same size: suspected copies."""
    def top(root: str) -> DataFrame:
        files = channel_manifest(spark, root)
        if files.isEmpty():
            raise FileNotFoundError(f"{root} does not exist or is empty")
        return files.where("depth = 1").select("name", "length", F.col("path"))

    a = top(train).withColumnRenamed("path", "train_path")
    b = top(validation).withColumnRenamed("path", "validation_path")
    return a.join(b, ["name", "length"]).select("name", "length", "train_path", "validation_path")
