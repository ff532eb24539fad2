"""Exact running totals over a global or per-group order without a one-task window.

A plain ordered window puts each whole group (or, without a group, the whole table) into one task.
Here rows are first cut into ranges of the order column by approximate quantiles. Totals per range
are small, so they are accumulated by a tiny window; rows then only need a window inside their own
(group, range). The quantiles only steer the load: any cut points give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

MAX_RANGES = 4_096
ROWS_PER_RANGE = 1_000_000
HOT_KEYS = 1_000
MAX_SLOT_DIGITS = 5
RUN_CHUNK = 100_000


def quantile_sketch(column: str, parts: int, accuracy: int) -> Column:
    """Aggregate: the ``parts - 1`` inner quantiles of a column (as SQL text, which is quick to build)."""
    fractions = ",".join(f"{i / parts!r}D" for i in range(1, parts))
    return F.expr(f"percentile_approx(cast({column} AS double), array({fractions}), {max(accuracy, 1_000)})")


def largest_key(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the most frequent key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0] or 0


def range_bounds(df: DataFrame, column: str, keys: Sequence[str] = ()) -> list[float]:
    """Ascending cut points that leave about ``ROWS_PER_RANGE`` rows per range; none for a small frame.

    A count decides how many are needed; the quantile sketch, combined on the map side, runs only then. Totals inside
    ``keys`` need no ranges either where no key has more than ``ROWS_PER_RANGE`` rows.
    """
    if keys and largest_key(df, keys) <= ROWS_PER_RANGE:
        return []
    ranges = min(MAX_RANGES, -(-df.count() // ROWS_PER_RANGE))
    if ranges <= 1:
        return []
    row = df.agg(quantile_sketch(column, ranges, 2 * ranges).alias("q")).first()
    return sorted(set(row["q"] or []))


def slot_digits(df: DataFrame, keys: Sequence[str] = ()) -> int:
    """Hex digits of hash slots that leave about ``ROWS_PER_RANGE`` rows per slot; 0 for a small frame or only small keys."""
    if keys and largest_key(df, keys) <= ROWS_PER_RANGE:
        return 0
    digits, slots = 0, df.count() / ROWS_PER_RANGE
    while slots > 1 and digits < MAX_SLOT_DIGITS:
        digits, slots = digits + 1, slots / 16
    return digits


def with_range(df: DataFrame, column: str, bounds: Sequence[float], out: str = "range_id", descending: bool = False) -> DataFrame:
    """Adds the range number; larger values get smaller numbers when ``descending``. NULL sorts as Spark sorts it."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    inf = float("inf")
    tmp = f"__{out}"
    cut = Bucketizer(splits=[-inf, *bounds, inf], inputCol=f"__{out}_in", outputCol=tmp, handleInvalid="keep")
    df = cut.transform(df.withColumn(f"__{out}_in", F.col(column).cast("double")))
    number = F.col(tmp).cast("int")
    placed = F.coalesce(-number, F.lit(1)) if descending else F.coalesce(number, F.lit(-1))
    return df.withColumn(out, placed).drop(tmp, f"__{out}_in")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    range_col: str,
    sums: dict[str, str],
    single: bool = False,
) -> DataFrame:
    """Adds, for each ``out: value`` in ``sums``, the sum of ``value`` over all earlier rows of the group.

    ``range_col`` must agree with ``order``: rows of a smaller range come first. ``single`` says that all rows
    are in one range (a frame of at most ``ROWS_PER_RANGE`` rows), where the plain window is enough.
    """
    if single:
        before = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(o) for o, v in sums.items()])
    cell = [*keys, range_col]
    totals = df.groupBy(*cell).agg(*[F.sum(v).alias(f"__t_{o}") for o, v in sums.items()])
    earlier = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(range_col).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*cell, *[F.coalesce(F.sum(f"__t_{o}").over(earlier), F.lit(0)).alias(f"__o_{o}") for o in sums])
    joined = df.join(offsets if keys else F.broadcast(offsets), cell)
    inside = W.partitionBy(*cell).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = [(F.col(f"__o_{o}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(o) for o, v in sums.items()]
    return joined.select(*df.columns, *out)


def hash_position(
    df: DataFrame, hash_col: str, order: Sequence[str], keys: Sequence[str] = (), lead: Sequence[str] = (), digits: int | None = None,
    blocks: bool = False,
) -> DataFrame:
    """Adds ``position`` (from 0) in the order ``lead, hash, order`` of each key.

    The first ``digits`` hex digits of the hash make 16**digits even ranges, so one label or key that
    holds most rows is still spread over all of them. The number of digits follows the row count. With
    ``blocks`` also: ``same`` rows of this key and lead, ``start`` of their block, ``size`` of the key.
    """
    digits = slot_digits(df, keys) if digits is None else digits
    by_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    block = W.partitionBy(*keys, *lead)
    if digits == 0:
        placed = df.withColumn("position", F.row_number().over(by_key.orderBy(*lead, hash_col, *order)) - 1)
        if not blocks:
            return placed
        return placed.select(
            "*", F.count(F.lit(1)).over(block).alias("same"), F.min("position").over(block).alias("start"),
            F.count(F.lit(1)).over(by_key).alias("size"),
        )
    df = df.withColumn("__slot", F.substring(hash_col, 1, digits))
    cell = [*keys, *lead, "__slot"]
    earlier = by_key.orderBy(*lead, "__slot").rowsBetween(W.unboundedPreceding, -1)
    counts = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(*cell, "__n", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    if blocks:
        offsets = offsets.select(
            *cell, "__n", "__before", F.sum("__n").over(block).alias("same"), F.min("__before").over(block).alias("start"),
            F.sum("__n").over(by_key).alias("size"),
        )
    inside = W.partitionBy(*cell).orderBy(hash_col, *order)
    return (
        df.join(offsets.drop("__n"), cell)
        .withColumn("position", F.col("__before") + F.row_number().over(inside) - 1)
        .drop("__slot", "__before")
    )


def explode_run(df: DataFrame, first: Column, count: Column, chunk: int = RUN_CHUNK) -> DataFrame:
    """Cuts a run of ``count`` consecutive positions into rows ``lo..hi`` of at most ``chunk`` positions."""
    last = first + count - 1
    starts = F.explode(F.sequence(first, last, F.lit(chunk).cast("bigint")))
    df = df.withColumn("__last", last).withColumn("lo", starts)
    return df.withColumn("hi", F.least(F.col("lo") + chunk - 1, F.col("__last"))).drop("__last")


def sum_over_run(term) -> Column:
    """Sum of ``term(position)`` for position in ``lo..hi``; a run of one skips the array."""
    many = F.aggregate(F.sequence("lo", "hi"), F.lit(0.0), lambda acc, i: acc + term(i))
    return F.when(F.col("lo") == F.col("hi"), term(F.col("lo"))).otherwise(many)


def salted_lookup(big: DataFrame, small: DataFrame, keys: Sequence[str], measured: DataFrame | None = None) -> DataFrame:
    """Equi-join of ``big`` with one row per key of ``small``, where a key may hold a large share of ``big``.

    Keys above ``limit`` rows, of which there are at most ``HOT_KEYS``, are spread over several tasks: their rows
    get a salt and their small-side row is repeated per salt. All other keys join as they are. ``measured`` is a
    cheaper frame with the same key frequencies.
    """
    measured = big if measured is None else measured
    rows = measured.count()
    if rows <= ROWS_PER_RANGE:
        return big.join(small, list(keys))
    limit = max(ROWS_PER_RANGE, rows // HOT_KEYS)
    counts = measured.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
    hot = F.broadcast(counts.select(*keys, F.ceil(F.col("__n") / limit).cast("int").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if c not in keys]), salts).cast("int")
    left = big.join(hot, list(keys), "left").withColumn("__salt", spread).drop("__salts")
    right = small.join(hot, list(keys), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return left.join(right, [*keys, "__salt"]).drop("__salt")
