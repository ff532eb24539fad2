"""Operator 3: document fingerprints by threshold-scaled sketches, in DataFrame functions only.

Every run of five words is hashed; the sketch keeps all hashes below a fixed fraction (one in ``FRACTION``) of the hash
range, whatever the length of the text. So two sketches of very unequal documents hold comparable samples, and the union
of sketches is the sketch of the union. Likeness is the containment of the smaller sketch in the larger. A fingerprint
is the sketch after a digest of the whole set of hashes, which says only whether two whole sets are equal.

The estimate's error falls with the number of hashes kept: its deviation is at most 0.5 * sqrt((1 - 1 / FRACTION) / kept).

The document after each one in the order of ids comes from windows over ranges of ids: ranges are quantiles, cut
further by arithmetic so that a window holds about ``RANGE_ROWS`` rows. The last row of a range gets its neighbour from
a small table of range ends.

Cases: a null text is an empty one; texts without words have the empty set, alike (1.0) to one another and unlike (0.0)
to all others; texts with fewer than five words are one run; equal sets have likeness 1.0; a sketch of a short text can be
empty, and then the text is unlike (0.0) to all texts of another set; ids are integers, nulls stand before all others,
and rows of equal ids in any order; a single document is its own neighbour; an empty table gives an empty result.
Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
FRACTION = 4  # one hash in so many is below the threshold
RANGE_ROWS = 1000
QUANTILES = 64
BROADCAST_ROWS = 100_000  # range ends that may be sent to every executor (16 bytes each)
THRESHOLD = -(2**63) + 2**64 // FRACTION - 1


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def sketch(rows: DataFrame, text_col: str, kept: str, digest: str) -> DataFrame:
    """``rows`` with the sorted hashes below the threshold and a digest of all hashes."""
    words, hashes = f"__words_{kept}", f"__hashes_{kept}"
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(SHINGLE)]),
    )
    rows = rows.withColumn(words, F.transform(_words(F.col(text_col)), lambda w: F.xxhash64(w)))
    rows = rows.withColumn(hashes, F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.array_distinct(runs))))
    rows = rows.withColumn(kept, F.filter(hashes, lambda h: h <= F.lit(THRESHOLD))).withColumn(digest, F.xxhash64(hashes))
    return rows.drop(words, hashes)


def _hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def as_text(kept: str, digest: str) -> Column:
    """A fingerprint as text: digest and hashes, 16 hexadecimal digits each."""
    return F.concat(_hex(F.col(digest)), F.array_join(F.transform(kept, _hex), ""))


def likeness(a: str, a_digest: str, b: str, b_digest: str) -> Column:
    """Share of the smaller sketch that the other holds too."""
    least = F.least(F.size(a), F.size(b))
    share = F.size(F.array_intersect(a, b)) / least
    return F.when((F.col(a_digest) == F.col(b_digest)) & (F.col(a) == F.col(b)), F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(share)


def _ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` (``id``) with ``slot``, ascending with the ids; and ``slot, next_slot`` of the slots that have rows."""
    seen = docs.agg(
        F.count("id").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"),
        F.percentile_approx("id", [i / QUANTILES for i in range(1, QUANTILES)], 10_000).alias("cuts"),
    ).first()
    edges = sorted({seen["low"] or 0, *(seen["cuts"] or []), (seen["high"] or 0) + 1})
    pieces = max(1, -(-seen["n"] // (RANGE_ROWS * max(1, len(edges) - 1))))
    own = F.size(F.filter(F.array(*[F.lit(e).cast("bigint") for e in edges]), lambda e: e <= F.col("id")))
    table = F.array(*[F.lit(e).cast("bigint") for e in edges])
    low, high = F.get(table, own - 1), F.get(table, own)
    inside = F.floor((F.col("id") - low).cast("double") / (high - low).cast("double") * pieces)
    slot = (own.cast("bigint") * (pieces + 1) + F.least(inside, F.lit(pieces - 1))).cast("bigint")
    placed = docs.withColumn("slot", F.coalesce(slot, F.lit(-1).cast("bigint")))
    slots = placed.groupBy("slot").agg(F.min("id").alias("first_id"))
    order = Window.orderBy("slot")  # one row per range
    return placed, slots.select("slot", F.lead("slot").over(order).alias("next_slot"), F.row_number().over(order).alias("nth"))


def next_documents(docs: DataFrame, columns: Sequence[str], derive: Callable[[DataFrame], DataFrame] = lambda rows: rows, derived: Sequence[str] = ()) -> DataFrame:
    """``docs`` (``id`` and ``columns``) with ``next_<column>`` of the row after it in order of ids; after the last: the first.

    ``derive`` adds the columns ``derived``, once a row, after the shuffle; they get their ``next_`` too.
    """
    placed, slots = _ranges(docs.select("id", *columns))
    every = [*columns, *derived]
    inside = Window.partitionBy("slot").orderBy("id", *columns)
    ahead = derive(placed.repartition("slot")).select("*", *[F.lead(c).over(inside).alias(f"next_{c}") for c in every], F.lead(F.lit(1)).over(inside).alias("has_next"))
    main = ahead.where("has_next IS NOT NULL").drop("has_next", "slot")

    ends = placed.groupBy("slot").agg(F.min(F.struct(F.col("id").isNotNull().alias("x"), "id")).alias("f"), F.max(F.struct(F.col("id").isNotNull().alias("x"), "id")).alias("l"))
    ends = ends.select("slot", F.col("f.id").alias("first_id"), F.col("l.id").alias("last_id"))
    chain = slots.join(ends, "slot")
    small = slots.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda x: x)
    edge = hint(chain.select(F.col("slot").alias("at"), "first_id", "last_id"))
    rows = placed.join(edge, (placed["slot"] == edge["at"]) & (placed["id"].eqNullSafe(edge["first_id"]) | placed["id"].eqNullSafe(edge["last_id"])))
    order = Window.partitionBy("slot").orderBy("id", *columns)
    back = Window.partitionBy("slot").orderBy(F.desc("id"), *[F.desc(c) for c in columns])
    rows = rows.withColumn("from_first", F.row_number().over(order)).withColumn("from_last", F.row_number().over(back))
    lasts = derive(rows.where("from_last = 1").select("slot", "id", *columns))
    firsts = derive(rows.where("from_first = 1").select(F.col("slot").alias("next_slot"), *columns))
    firsts = firsts.select("next_slot", *[F.col(c).alias(f"next_{c}") for c in every])
    beginning = slots.where("nth = 1").select(F.col("slot").alias("first_slot"), F.lit(1).alias("one"))
    follow = slots.withColumn("one", F.lit(1)).join(F.broadcast(beginning), "one").select("slot", F.coalesce("next_slot", "first_slot").alias("next_slot"))
    edges = lasts.join(follow, "slot").join(firsts, "next_slot").select("id", *every, *[f"next_{c}" for c in every])
    return main.unionByName(edges)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness to it and to the next document's."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = next_documents(rows, ["text"], lambda x: sketch(x, "text", "kept", "digest"), ["kept", "digest"])
    n = F.char_length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next_text", F.lit(1), tail))
    rows = rows.select("id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "kept", "digest", "next_kept", "next_digest")
    rows = sketch(rows, "edited", "edited_kept", "edited_digest")
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("kept", "digest").alias("fingerprint"),
        as_text("edited_kept", "edited_digest").alias("edited_fingerprint"),
        likeness("kept", "digest", "edited_kept", "edited_digest").alias("near_edited"),
        likeness("kept", "digest", "next_kept", "next_digest").alias("near_next"),
    )
