"""CSV and LIBSVM files as labelled rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F

from treeline.sources.manifest import MAX_FOLDER_DEPTH, first_lines, open_to_tasks, qualified, read_channel, usable_files, usable_paths

# Delimiters tried, in order of preference on ties.
DELIMITERS = (",", ";", "\t", "|", " ", ":")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SPECIAL = r"(?i)^[+-]?(nan|inf|infinity)$"
SNIFF_CHARS = 512
SNIPPET_CHARS = 50


def number(text: Column) -> Column:
    """Double from text, NULL for text that is not a plain number and for NaN."""
    clean = F.trim(text)
    value = F.when(clean.rlike(NUMBER), clean.try_cast("double"))
    infinite = F.when(clean.rlike(r"(?i)^[+]?inf(inity)?$"), F.lit(float("inf"))).when(clean.rlike(r"(?i)^-inf(inity)?$"), F.lit(float("-inf")))
    return F.coalesce(value, infinite)


def is_number(text: Column) -> Column:
    return F.trim(text).rlike(NUMBER) | F.trim(text).rlike(SPECIAL)


def guess_delimiter(line: Column, chars: int | None = SNIFF_CHARS) -> Column:
    """The most frequent candidate in the first characters of the line (None: in all of it), NULL if none occurs."""
    sample = line if chars is None else F.substring(line, 1, chars)
    counts = [F.length(sample) - F.length(F.replace(sample, F.lit(d), F.lit(""))) for d in DELIMITERS]
    top = F.greatest(*counts)
    out = F.lit(None).cast("string")
    for d, c in reversed(list(zip(DELIMITERS, counts))):
        out = F.when((c == top) & (top > 0), F.lit(d)).otherwise(out)
    return out


def text_lines(spark: SparkSession, roots: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """``path, block, seq, line``: seq orders lines inside a block of a file, block orders the blocks."""
    reader = spark.read.option("recursiveFileLookup", True)
    lines = read_channel(spark, roots, reader.option("pathGlobFilter", glob).text, 1) if glob else read_channel(spark, roots, reader.text)
    return lines.select(F.col("__path").alias("path"), F.col("__block").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


def heads(spark: SparkSession, roots: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """``path, first_line, line`` per usable file: its first line, and its first line that is not blank.

    Only the head of a file is read, where its store can be opened by tasks; else the file. With ``glob`` only files
    directly in the folder whose names match it.
    """
    if all(open_to_tasks(qualified(spark, r)[0]) for r in ([roots] if isinstance(roots, str) else roots)):
        files = usable_files(spark, roots)
        if glob:
            files = files.where((F.col("depth") == 1) & F.col("name").rlike("^" + re.escape(glob).replace(r"\*", ".*") + "$"))
        return first_lines(files.repartition(spark.sparkContext.defaultParallelism, "path"))
    lines = text_lines(spark, roots, glob)
    return lines.groupBy("path").agg(
        F.min_by("line", F.struct("block", "seq")).alias("first_line"), F.expr("min_by(line, struct(block, seq)) FILTER (WHERE trim(line) <> '')").alias("line")
    )


def sniff_csv_delimiter(spark: SparkSession, roots: str | Sequence[str]) -> DataFrame:
    """``path, first_line, delimiter`` per file; the delimiter is NULL when none can be found."""
    usable_paths(spark, roots)
    first = heads(spark, roots).select("path", "first_line").where("first_line IS NOT NULL")
    return first.withColumn("delimiter", guess_delimiter(F.col("first_line")))


def validate_csv_files(spark: SparkSession, roots: str | Sequence[str]) -> DataFrame:
    """``path, ok, snippet``: a CSV file is accepted when its first line shows a delimiter."""
    found = sniff_csv_delimiter(spark, roots)
    return found.select("path", F.col("delimiter").isNotNull().alias("ok"), F.substring("first_line", 1, SNIPPET_CHARS).alias("snippet"))


def scan_csv_labeled(
    spark: SparkSession, roots: str | Sequence[str], weight_col: bool = False, delimiter: str | None = None, recursive: bool = True
) -> DataFrame:
    """``label, weight, features`` from headerless files; column 0 is the label, column 1 the weight if asked.

    Every file's delimiter comes from its own first line, and all files must have as many columns. A row of another
    width, and a field that is neither a number nor empty, stop the query that reads it.
    """
    return read_csv_labelled(spark, roots, weight_col, delimiter)


def read_csv_labelled(
    spark: SparkSession, roots: str | Sequence[str], weight_col: bool = False, delimiter: str | None = None, glob: str | None = None
) -> DataFrame:
    """``label, weight, features`` of headerless files, each read with its own delimiter.

    Delimiters and widths come from the heads of the files; text in quotes does not count. With ``glob`` only files
    whose names match it and lie directly in the folder are read.
    """
    folders = usable_paths(spark, roots)
    reader, deepest = spark.read.option("recursiveFileLookup", True), MAX_FOLDER_DEPTH
    first = heads(spark, roots, glob).where("line IS NOT NULL")
    if glob:
        reader, deepest = reader.option("pathGlobFilter", glob), 1
    bare = F.regexp_replace("line", '"[^"]*"', "")
    sep = F.lit(delimiter) if delimiter else F.coalesce(guess_delimiter(bare, None), F.lit(","))
    width = F.size(F.split(bare, F.concat(F.lit("\\Q"), sep, F.lit("\\E")), -1))
    first = first.select("path", sep.alias("sep"), width.alias("width"))
    kinds = sorted(first.groupBy("sep", "width").agg(F.min("path").alias("example")).collect(), key=lambda r: (r["sep"], r["width"]))
    if len({r["width"] for r in kinds}) > 1:
        raise ValueError("CSV files differ in width: " + "; ".join(f"{r['width']} columns by {r['sep']!r} in {r['example']}" for r in kinds))
    names = [f"c{i}" for i in range(kinds[0]["width"] if kinds else 1 + weight_col)]
    seps = [r["sep"] for r in kinds] or [","]
    if len(seps) == 1:
        cells = read_channel(spark, roots, text_cells(reader, seps[0], names).csv, deepest, folders)
        return labelled(cells.select(*[strict_double(F.col(n), n).alias(n) for n in names]), names, weight_col)
    # files of several kinds: every line is parsed with the delimiter of its file
    lines = read_channel(spark, roots, reader.text, deepest, folders).where(F.trim("value") != "")
    plain = r"^[A-Za-z0-9+.-]+:(//[^/]*)?"
    lines = lines.withColumn("key", F.regexp_replace("__path", plain, "")).join(first.select(F.regexp_replace("path", plain, "").alias("key"), "sep"), "key")
    out = None
    for sep in seps:
        row = F.from_csv("value", ", ".join(f"{n} string" for n in names), {"sep": sep, "mode": "FAILFAST"})
        fields = lines.where(F.col("sep") == sep).select(row.alias("row"))
        cells = fields.select(*[strict_double(F.col(f"row.{n}"), n).alias(n) for n in names])
        out = cells if out is None else out.unionByName(cells)
    return labelled(out, names, weight_col)


def text_cells(reader: DataFrameReader, sep: str, names: Sequence[str]) -> DataFrameReader:
    """All cells as text; a row with another number of cells is an error, whichever columns are used."""
    reader = reader.option("sep", sep).option("header", False).option("mode", "FAILFAST").option("columnPruning", False)
    return reader.schema(", ".join(f"{n} string" for n in names))


def strict_double(text: Column, name: str) -> Column:
    """Double from text, NULL for an empty cell, an error for other text."""
    value = text.try_cast("double")
    empty = text.isNull() | (F.trim(text) == "")
    bad = F.raise_error(F.concat(F.lit(f"CSV column {name}: no number in '"), F.substring(text, 1, SNIPPET_CHARS), F.lit("'")))
    return F.when(value.isNotNull(), value).when(~empty, bad.cast("double"))


def missing_as_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def labelled(df: DataFrame, names: Sequence[str], weight_col: bool = False) -> DataFrame:
    """Positional columns to ``label, weight, features``."""
    start = 2 if weight_col else 1
    weight = F.col(names[1]).cast("double") if weight_col else F.lit(1.0)
    features = F.array(*[missing_as_null(F.col(n).cast("double")) for n in names[start:]]) if len(names) > start else F.array().cast("array<double>")
    return df.select(F.col(names[0]).cast("double").alias("label"), weight.alias("weight"), features.alias("features"))


def libsvm_columns(line: Column) -> dict[str, Column]:
    """``label, weight, features`` of a line ``label[:weight] idx:val ...``; indices kept as written."""
    tokens = F.split(F.trim(line), r"\s+")
    head = F.split(tokens[0], ":")
    pairs = F.transform(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: F.split(t, ":"))
    entries = F.transform(pairs, lambda p: F.struct(F.try_to_number(p[0], F.lit("9999999999")).cast("int").alias("k"), number(F.get(p, F.lit(1))).alias("v")))
    return {"label": number(F.get(head, F.lit(0))), "weight": F.coalesce(number(F.get(head, F.lit(1))), F.lit(1.0)), "features": sparse_map(entries)}


def sparse_map(entries: Column) -> Column:
    """Map from ``(k, v)`` entries; repeated keys add up."""
    keys = F.transform(entries, lambda e: e["k"])
    once = F.array_distinct(keys)
    summed = F.transform(once, lambda k: F.aggregate(entries, F.lit(0.0), lambda a, e: a + F.when(e["k"] == k, e["v"]).otherwise(0.0)))
    plain = F.map_from_arrays(keys, F.transform(entries, lambda e: e["v"]))
    return F.when(F.size(once) == F.size(keys), plain).otherwise(F.map_from_arrays(once, summed))


def scan_libsvm(spark: SparkSession, roots: str | Sequence[str]) -> DataFrame:
    """``label, weight, features map<int, double>``; an absent index is a missing value."""
    lines = read_channel(spark, roots, spark.read.option("recursiveFileLookup", True).text).where(F.trim("value") != "")
    return lines.select(*[c.alias(n) for n, c in libsvm_columns(F.col("value")).items()])


def sparse_width(df: DataFrame, features: str = "features") -> int:
    """Largest index plus one."""
    return (df.agg(F.max(F.array_max(F.map_keys(features))).alias("top")).first()["top"] or -1) + 1


def dense_features(df: DataFrame, width: int, features: str = "features", shift: int = 0, fill: str = "missing") -> DataFrame:
    """Map features to an array of ``width``; absent entries become NULL or zero."""
    values = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.try_element_at(F.col(features), i + shift))
    if fill == "zero":
        values = F.transform(values, lambda v: F.coalesce(v, F.lit(0.0)))
    return df.withColumn(features, values)


def libsvm_verdict(line: Column) -> Column:
    """-1 for a bad line, otherwise the number of features on it."""
    tokens = F.split(line, " ")
    head = F.split(tokens[0], ":")
    label_ok = (F.size(head) <= 2) & F.forall(head, is_number)
    rest = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs_ok = F.forall(rest, lambda t: F.size(F.split(t, ":")) == 2)
    return F.when(label_ok & pairs_ok, F.size(rest)).otherwise(F.lit(-1))


def validate_libsvm_files(spark: SparkSession, roots: str | Sequence[str]) -> DataFrame:
    """``path, ok, snippet, has_features``: the first line with more than one feature must come before any bad line."""
    lines = text_lines(spark, roots).withColumn("v", libsvm_verdict(F.col("line")))
    at = F.struct("block", "seq", F.substring("line", 1, SNIPPET_CHARS).alias("snippet"))
    per = lines.groupBy("path").agg(F.min(F.when(F.col("v") > 1, at)).alias("good"), F.min(F.when(F.col("v") < 0, at)).alias("bad"))
    ok = F.col("bad").isNull() | (F.col("good").isNotNull() & (F.struct("good.block", "good.seq") < F.struct("bad.block", "bad.seq")))
    return per.select("path", ok.alias("ok"), F.when(~ok, F.col("bad.snippet")).alias("snippet"), F.col("good").isNotNull().alias("has_features"))
