"""Gradients that depend on other rows: ranking pairs and the Cox risk sets."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from treeline.functions.hashing import digest, hash_int
from treeline.functions.scores import sigmoid_probability
from treeline.operators import ordering
from treeline.operators.ordering import explode_run, hash_position, largest_key, range_bounds, running_totals, salted_lookup, sum_over_run, with_range
from treeline.operators.pairs import rank_pairs
from treeline.operators.ranking import event_time, risk_sets

# Batch functions travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUP_ROWS = 100_000  # rows of a group that one task holds at once


@dataclass
class Layout:
    """What stays the same in every round: where rows that depend on each other can lie together.

    ``key`` is the column to deal them by, None where a group is too large for a task. ``hot`` are the groups above
    ``GROUP_ROWS``, ``unique`` says that no row id is missing or repeats, ``bounds`` cut the range of event times.
    """

    key: str | None = None
    hot: DataFrame | None = None
    unique: bool = True
    bounds: list[float] | None = None


def layout(df: DataFrame, objective: str) -> Layout:
    """Measures rows with ``row_id, group_id``, or for survival:cox with ``label``."""
    if objective == "survival:cox":
        times = df.select(event_time(df).alias("time"))
        key = "time" if largest_key(times, ["time"]) <= ordering.ROWS_PER_RANGE else None
        return Layout(key, bounds=range_bounds(times, "time"))
    limit = min(GROUP_ROWS, ordering.ROWS_PER_RANGE)
    ids = df.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))
    if not ids.where("n > 1 OR row_id IS NULL").isEmpty():
        return Layout(unique=False)
    hot = df.groupBy(F.col("group_id").alias("__hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("__hot").persist()
    return Layout("group_id") if hot.isEmpty() else Layout(hot=hot)


def score_positions(df: DataFrame) -> DataFrame:
    """``group_id, row_id, label, m_0`` with rank by score and relevant rows up to it."""
    rows = df.select("group_id", "row_id", "label", "m_0").withColumn("one", F.lit(1))
    rows = rows.withColumn("hit", (F.col("label") > 0).cast("int"))
    bounds = range_bounds(rows, "m_0", ["group_id"])
    rows = with_range(rows, "m_0", bounds, descending=True)
    order = [F.col("m_0").desc(), F.col("label").asc(), F.col("row_id").asc()]
    ranked = running_totals(rows, ["group_id"], order, "range_id", {"above": "one", "hits_above": "hit"}, single=not bounds)
    ranked = ranked.withColumn("rank", F.col("above") + 1).withColumn("hits", F.col("hits_above") + F.col("hit"))
    ranked = ranked.withColumn("inverse", F.when(F.col("hit") == 1, 1.0 / F.col("rank")).otherwise(0.0))
    ranked = ranked.drop("above", "hits_above")
    return running_totals(ranked, ["group_id"], [F.col("rank").asc()], "range_id", {"inverse_before": "inverse"}, single=not bounds)


def group_totals(df: DataFrame) -> DataFrame:
    """Ideal DCG and relevant rows per group, from counts per grade."""
    grades = df.groupBy(F.col("group_id").alias("group"), "label").agg(F.count(F.lit(1)).alias("n"))
    best_first = W.partitionBy("group").orderBy(F.col("label").desc()).rowsBetween(W.unboundedPreceding, -1)
    placed = grades.withColumn("above", F.coalesce(F.sum("n").over(best_first), F.lit(0)))
    pieces = explode_run(placed, F.col("above") + 1, F.col("n"))
    discount = sum_over_run(lambda i: 1.0 / F.log2(i.cast("double") + 1.0))
    first = F.col("lo") == F.col("above") + 1
    return pieces.groupBy("group").agg(
        F.sum((F.pow(F.lit(2.0), F.col("label")) - 1.0) * discount).alias("ideal"),
        F.sum(F.when(first & (F.col("label") > 0), F.col("n")).otherwise(0)).alias("relevant"),
    )


def ranking_gradients(df: DataFrame, objective: str, params: dict, known: Layout | None = None) -> DataFrame:
    """Sums of the logistic pair loss over the sampled pairs, weighted by the change of the metric.

    Groups of up to ``GROUP_ROWS`` rows are finished where their rows lie, after one shuffle at most. Larger groups, and
    row ids that repeat, whose sums are shared, take joins that spread each group over many tasks.
    """
    known = known or layout(df, objective)
    if not known.unique:
        return _spread_gradients(df, objective, params)
    if known.hot is None:
        return _local_gradients(df, objective, params)
    hot = F.broadcast(known.hot)  # at most one in GROUP_ROWS rows
    large = F.col("group_id").eqNullSafe(F.col("__hot"))
    small = _local_gradients(df.join(hot, large, "left_anti"), objective, params)
    return small.unionByName(_spread_gradients(df.join(hot, large, "left_semi"), objective, params))


def _local_gradients(df: DataFrame, objective: str, params: dict) -> DataFrame:
    """Gradients of whole groups: windows place the rows, numpy looks up partners and adds up pairs, many groups at a time."""
    seed = params["seed"]
    hit = (F.col("label") > 0).cast("int")
    by_score = W.partitionBy("group_id").orderBy(F.col("m_0").desc(), F.col("label").asc(), F.col("row_id").asc())
    before = by_score.rowsBetween(W.unboundedPreceding, -1)
    rows = df
    if objective != "rank:pairwise":
        rows = rows.withColumn("__rank", F.row_number().over(by_score).cast("double"))
    if objective == "rank:map":
        rows = rows.withColumn("__hits", (F.coalesce(F.sum(hit).over(before), F.lit(0)) + hit).cast("double"))
        rows = rows.withColumn("__inverse", F.when(hit == 1, 1.0 / F.col("__rank")).otherwise(0.0))
        rows = rows.withColumn("__inverse_before", F.coalesce(F.sum("__inverse").over(before), F.lit(0.0)))
    rows = rows.withColumn("__hash", digest(seed, F.col("row_id")))
    rows = hash_position(rows, "__hash", ["row_id"], keys=["group_id"], lead=["label"], digits=0, blocks=True).drop("__hash")
    r = F.pmod(hash_int(seed, 0, F.col("row_id"), 0), F.col("size") - F.col("same"))
    partner = F.when(r < F.col("start"), r).otherwise(r + F.col("same"))
    rows = rows.withColumn("__partner", F.when((F.col("size") > F.col("same")) & F.col("group_id").isNotNull(), partner).cast("double"))
    carried = len(df.columns)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, needed = [], 0, 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < needed or not count:
                continue
            # rows of a group follow each other
            whole = pa.Table.from_batches(held).combine_chunks()
            sizes = whole["size"].to_numpy().tolist()
            starts, end = [], 0
            while end < count and end + sizes[end] <= count:
                starts.append(end)
                end += sizes[end]
            if end:
                ready = whole.slice(0, end)
                g, h = _pair_sums(ready, np.array(starts), objective)
                done = ready.select(list(range(carried))).append_column("__g", pa.array(g)).append_column("__h", pa.array(h))
                yield from done.to_batches()
            needed = sizes[end] if end < count else 0
            held, count = whole.slice(end).to_batches(), count - end

    fields = [*df.schema.fields, T.StructField("__g", T.DoubleType()), T.StructField("__h", T.DoubleType())]
    solved = rows.mapInArrow(solve, T.StructType(fields))
    w = F.col("w")
    return solved.select(*df.columns, (F.col("__g") * w).alias("g_0"), (F.col("__h") * w).alias("h_0"))


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].to_numpy().astype(float)  # NULL becomes NaN


def _pair_sums(rows: pa.Table, starts: np.ndarray, objective: str) -> tuple[np.ndarray, np.ndarray]:
    """Per row the sums over its pairs; ``rows`` are whole groups that begin at ``starts``."""
    n = rows.num_rows
    size, position = rows["size"].to_numpy(), rows["position"].to_numpy()
    group = np.repeat(np.arange(len(starts)), size[starts])
    first = starts[group]
    at = np.empty(n, dtype=np.int64)
    at[first + position] = np.arange(n)
    partner = _numbers(rows, "__partner")
    own = np.flatnonzero(~np.isnan(partner))
    other = at[first[own] + partner[own].astype(np.int64)]
    y, m = _numbers(rows, "label"), _numbers(rows, "m_0")
    up = y[own] > y[other]
    high, low = np.where(up, own, other), np.where(up, other, own)
    with np.errstate(all="ignore"):
        change = np.ones(len(own)) if objective == "rank:pairwise" else _change(rows, starts, group, high, low, y, size - position, objective)
        p = 0.5 * (1.0 + np.tanh(0.5 * (m[high] - m[low])))
        g, h = (p - 1.0) * change, np.fmax(2.0 * p * (1.0 - p) * change, 1e-16)
    g = np.where(np.isnan(g), 0.0, g)  # a missing label changes nothing
    if not len(own):
        return np.zeros(n), np.zeros(n)  # counts of nothing would be whole numbers
    return np.bincount(high, g, n) - np.bincount(low, g, n), np.bincount(high, h, n) + np.bincount(low, h, n)


def _change(rows: pa.Table, starts, group, high, low, y, best, objective: str) -> np.ndarray:
    """Change of the group's metric when both rows of a pair swap places; ``best`` is a row's rank by label."""
    rank = _numbers(rows, "__rank")
    group = group[high]
    if objective == "rank:ndcg":
        gains = np.where(np.isnan(y), 0.0, (np.power(2.0, y) - 1.0) / np.log2(best + 1.0))
        ideal = np.add.reduceat(gains, starts)[group]
        discount = 1.0 / np.log2(rank[high] + 1.0) - 1.0 / np.log2(rank[low] + 1.0)
        return np.where(ideal > 0, np.abs((np.power(2.0, y[high]) - np.power(2.0, y[low])) * discount) / ideal, 0.0)
    relevant = np.add.reduceat((y > 0).astype(float), starts)[group]
    hits, inverse, before = _numbers(rows, "__hits"), _numbers(rows, "__inverse"), _numbers(rows, "__inverse_before")
    moved_up = (hits[low] + 1.0) / rank[low] - hits[high] / rank[high] + (before[high] - before[low])
    moved_down = hits[low] / rank[low] - hits[high] / rank[high] - (before[low] - before[high] - inverse[high])
    moved = np.where(rank[low] < rank[high], moved_up, moved_down)
    return np.where((y[low] <= 0) & (relevant > 0), np.abs(moved) / relevant, 0.0)


def _spread_gradients(df: DataFrame, objective: str, params: dict) -> DataFrame:
    seed = params["seed"]
    if objective == "rank:pairwise":
        pairs = rank_pairs(df, carry=("m_0",), seed=seed).withColumn("change", F.lit(1.0))
    else:
        placed = score_positions(df)
        fields = ("m_0", "rank", "hits", "inverse_before", "inverse")
        pairs = rank_pairs(placed, carry=fields, seed=seed)
        pairs = salted_lookup(pairs, group_totals(df), ["group"], measured=df.select(F.col("group_id").alias("group")))
        if objective == "rank:ndcg":
            gain = F.pow(F.lit(2.0), "high_label") - F.pow(F.lit(2.0), "low_label")
            discount = 1.0 / F.log2(F.col("high_rank") + 1.0) - 1.0 / F.log2(F.col("low_rank") + 1.0)
            change = F.when(F.col("ideal") > 0, F.abs(gain * discount) / F.col("ideal")).otherwise(0.0)
        else:
            change = F.when((F.col("low_label") <= 0) & (F.col("relevant") > 0), F.abs(_precision_change()) / F.col("relevant")).otherwise(0.0)
        pairs = pairs.withColumn("change", change)
    p = sigmoid_probability(F.col("high_m_0") - F.col("low_m_0"))
    g = (p - 1.0) * F.col("change")
    h = F.greatest(2.0 * p * (1.0 - p) * F.col("change"), F.lit(1e-16))
    ends = F.explode(F.array(
        F.struct(F.col("high_id").alias("row_id"), g.alias("g"), h.alias("h")),
        F.struct(F.col("low_id").alias("row_id"), (-g).alias("g"), h.alias("h")),
    )).alias("e")
    sums = pairs.select(ends).groupBy("e.row_id").agg(F.sum("e.g").alias("pg"), F.sum("e.h").alias("ph"))
    joined = df.join(sums, "row_id", "left")
    w = F.col("w")
    return joined.select(*df.columns, (F.coalesce("pg", F.lit(0.0)) * w).alias("g_0"), (F.coalesce("ph", F.lit(0.0)) * w).alias("h_0"))


def _precision_change():
    """Change of summed precision when a relevant row (high) and an irrelevant row (low) swap places."""
    r_rel, r_irr = F.col("high_rank"), F.col("low_rank")
    moved_up = (
        (F.col("low_hits") + 1.0) / r_irr - F.col("high_hits") / r_rel
        + (F.col("high_inverse_before") - F.col("low_inverse_before"))
    )
    moved_down = (
        F.col("low_hits") / r_irr - F.col("high_hits") / r_rel
        - (F.col("low_inverse_before") - F.col("high_inverse_before") - F.col("high_inverse"))
    )
    return F.when(r_irr < r_rel, moved_up).otherwise(moved_down)


def cox_gradients(df: DataFrame, known: Layout | None = None) -> DataFrame:
    """Residuals of the partial likelihood: sums over the events at or before each row's time."""
    times, single = risk_sets(df, "m_0", "label", known.bounds if known else None)
    times = times.select(
        "time", (-F.col("range_id")).alias("range_id"),
        (F.col("events") / F.col("at_risk")).alias("a"), (F.col("events") / (F.col("at_risk") * F.col("at_risk"))).alias("b"),
    )
    summed = running_totals(times, [], [F.col("time").asc()], "range_id", {"a_before": "a", "b_before": "b"}, single=single)
    hazard = summed.select("time", (F.col("a_before") + F.col("a")).alias("hz"), (F.col("b_before") + F.col("b")).alias("hz2"))
    rows = df if "time" in df.columns else df.withColumn("time", event_time(df))
    if known and known.key:
        joined = rows.join(hazard, "time")
    else:
        joined = salted_lookup(rows, hazard, ["time"], measured=rows.select("time"))
    e, w = F.exp("m_0"), F.col("w")
    g = e * F.col("hz") - (F.col("label") > 0).cast("double")
    h = F.greatest(e * F.col("hz") - e * e * F.col("hz2"), F.lit(1e-16))
    return joined.select(*df.columns, (g * w).alias("g_0"), (h * w).alias("h_0"))


def group_gradients(df: DataFrame, objective: str, params: dict, known: Layout | None = None) -> DataFrame:
    """Adds ``g_0, h_0`` for rank:* (needs row_id, group_id) and survival:cox objectives."""
    if objective == "survival:cox":
        return cox_gradients(df, known)
    missing = {"row_id", "group_id"} - set(df.columns)
    if missing:
        raise ValueError(f"objective {objective} needs columns {sorted(missing)}")
    return ranking_gradients(df, objective, params, known)
