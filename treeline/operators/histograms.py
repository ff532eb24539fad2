"""Feature bins, gradient histograms and the best split of each node."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from treeline.operators.ordering import quantile_sketch
from treeline.operators.routing import is_sparse

# Batch functions travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIXED_POINT_BITS = 20
MISSING_BIN = 0
WHOLE_NODE = -1  # the feature under which sparse histograms hold a node's totals
MIN_GAIN = 1e-6
# A cell is packed as key number, feature + 1 and bin; the widths are those that routing allows.
PACKED_BIN, PACKED_FEATURE = 17, 23
CHUNK_ROWS = 1 << 16  # rows counted together; halves of their 63-bit values add up exactly in doubles
CHUNK_ENTRIES = 1 << 22
HELD_CELLS = 1 << 20  # cells a task keeps before it hands them on
LOW_BITS = 26


def feature_values(df: DataFrame, features: str = "features", extra: Sequence[str] = ()) -> DataFrame:
    """Long form ``feature, value``, missing values left out."""
    each = F.explode(features) if is_sparse(df, features) else F.posexplode(features)
    long = df.select(*extra, each.alias("feature", "value"))
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def feature_bins(df: DataFrame, max_bin: int = 256, features: str = "features", accuracy: int = 10_000) -> DataFrame:
    """``feature, cuts``: ascending distinct quantile cut points above the minimum.

    The quantile sketch combines on the map side, so one feature costs one sketch per task, not its values.
    """
    sketch = feature_values(df, features).groupBy("feature").agg(
        quantile_sketch("value", max(max_bin, 2), accuracy).alias("q"), F.min("value").alias("low")
    )
    above = F.filter(F.array_sort(F.array_distinct("q")), lambda v: v > F.col("low"))
    return sketch.select("feature", above.alias("cuts"))


def equal_width_bins(df: DataFrame, bins: int, features: str = "features") -> DataFrame:
    """``feature, bin, n`` for equal-width bins between each feature's extremes; bin 0 is missing."""
    long = df.select(F.posexplode(features).alias("feature", "value"))
    limits = long.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    scaled = F.floor((F.col("value") - F.col("low")) * float(bins) / (F.col("high") - F.col("low")))
    number = F.when(F.col("value").isNull(), F.lit(MISSING_BIN)).when(F.col("high") == F.col("low"), F.lit(1))
    number = number.otherwise(F.least(scaled, F.lit(bins - 1)) + 1).cast("int")
    return (
        long.join(F.broadcast(limits), "feature").groupBy("feature", number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )


def bin_features(df: DataFrame, cuts: Sequence[Sequence[float]], features: str = "features", out: str = "bins") -> DataFrame:
    """Replaces ``features`` by small integers: 0 missing, otherwise 1 + number of cuts at or below the value.

    A map of features stays a map, without its missing entries and with one for ``WHOLE_NODE``.
    """
    if is_sparse(df, features):
        keep = [c for c in df.columns if c != features]
        return df.select(*keep, bin_sparse(df, cuts)(features).alias(out))
    keep = [c for c in df.columns if c != features]
    return df.select(*keep, bin_dense(df, cuts)(features).alias(out))


def bin_dense(df: DataFrame, cuts: Sequence[Sequence[float]]):
    """Arrow function from an array of values to an array of bins, one per feature; absent entries are missing ones."""
    shared = df.sparkSession.sparkContext.broadcast([np.array(c, dtype=float) for c in cuts])
    kind = np.int16 if max(map(len, cuts), default=0) + 1 < 2**15 else np.int32

    @F.arrow_udf("array<short>" if kind is np.int16 else "array<int>")
    def binned(features: pa.Array) -> pa.Array:
        cuts, n = shared.value, len(features)
        width = len(cuts)
        lengths = np.asarray(features.value_lengths().fill_null(0), dtype=np.int64)
        flat = features.flatten().to_numpy(zero_copy_only=False).astype(float)
        if (lengths == width).all():
            x = flat.reshape(n, width)
        else:
            row = np.repeat(np.arange(n), lengths)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            x, inside = np.full((n, width), np.nan), at < width
            x[row[inside], at[inside]] = flat[inside]
        bins = np.empty((n, width), dtype=kind)
        for i, c in enumerate(cuts):
            bins[:, i] = np.where(np.isnan(x[:, i]), MISSING_BIN, np.searchsorted(c, x[:, i], side="right") + 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(bins.ravel()))

    return binned


def bin_sparse(df: DataFrame, cuts: Sequence[Sequence[float]]):
    """Arrow function from a map of values to a map of bins; work and memory follow the entries, not the width.

    The cut points it is sent are part of the model: at most ``max_bin`` numbers per feature.
    """
    starts = np.cumsum([0] + [len(c) for c in cuts])
    shared = df.sparkSession.sparkContext.broadcast((starts, np.array([x for c in cuts for x in c], dtype=float)))

    @F.arrow_udf("map<int,int>")
    def binned(features: pa.Array) -> pa.Array:
        starts, flat = shared.value
        n, ends = len(features), np.asarray(features.offsets, dtype=np.int64)
        inside = slice(ends[0], ends[-1])
        index = features.keys.to_numpy(zero_copy_only=False)[inside].astype(np.int64)
        value = features.items.to_numpy(zero_copy_only=False)[inside].astype(float)
        keep = ~np.isnan(value) & (index >= 0) & (index < len(starts) - 1)
        ends = np.append(0, np.cumsum(keep))[ends - ends[0]]
        index, value = index[keep], value[keep]
        low, high = starts[index], starts[index + 1]
        while (open_ := low < high).any():
            middle = (low + high) // 2
            right = open_ & (flat[np.minimum(middle, len(flat) - 1)] <= value)
            low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
        keys, bins = (np.empty(len(index) + n, dtype=np.int32) for _ in range(2))
        firsts = ends[:-1] + np.arange(n)
        keys[firsts], bins[firsts] = WHOLE_NODE, MISSING_BIN
        others = np.arange(len(index)) + np.repeat(np.arange(n), np.diff(ends)) + 1
        keys[others], bins[others] = index, low - starts[index] + 1
        return pa.MapArray.from_arrays(pa.array((ends + np.arange(n + 1)).astype(np.int32)), pa.array(keys), pa.array(bins))

    return binned


def fixed_point(value: Column, bits: int = FIXED_POINT_BITS) -> Column:
    """Integer with ``bits`` binary places; sums of these do not depend on the order of addition."""
    return F.floor(value * float(2**bits) + 0.5).cast("bigint")


def _codes(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 of the different tuples, one per row, and a row of each tuple."""
    code = np.zeros(columns.shape[1], dtype=np.int64)
    for values in columns:
        least, span = int(values.min()), int(values.max()) - int(values.min()) + 1
        at = values - least if span <= CHUNK_ROWS else np.unique(values, return_inverse=True)[1]
        code = code * (int(at.max()) + 1) + at
        if code.max() >= CHUNK_ROWS:
            code = np.unique(code, return_inverse=True)[1]
    row_of = np.full(int(code.max()) + 1, -1, dtype=np.int64)
    row_of[code] = np.arange(len(code))
    used = np.flatnonzero(row_of >= 0)
    return np.searchsorted(used, code), row_of[used]


def _exact_sums(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``values`` by ``index``; whole numbers are added in two halves, so that no bit is lost."""
    if values.dtype.kind == "f":
        return np.bincount(index, values, size)
    low = np.bincount(index, values & ((1 << LOW_BITS) - 1), size).astype(np.int64)
    return (np.bincount(index, values >> LOW_BITS, size).astype(np.int64) << LOW_BITS) + low


def _entries(bins: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and bin of every entry of an array or map column."""
    if isinstance(bins, pa.MapArray):
        ends = np.asarray(bins.offsets, dtype=np.int64)
        feature, number = (x.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] for x in (bins.keys, bins.items))
        lengths = np.diff(ends)
    else:
        lengths = np.asarray(bins.value_lengths().fill_null(0), dtype=np.int64)
        number = bins.flatten().to_numpy(zero_copy_only=False)
        feature = np.arange(len(number)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(np.arange(len(bins)), lengths), feature.astype(np.int64), number.astype(np.int64)


def _count_chunk(key: np.ndarray, keys: int, g: np.ndarray, h: np.ndarray, entries: tuple) -> tuple[np.ndarray, ...]:
    """Packed cells of some rows, ascending, and their sums of g, h and rows. ``key`` is below 0 for rows that don't count."""
    row, feature, number = entries
    if (key < 0).any():
        wanted = key[row] >= 0
        row, feature, number = row[wanted], feature[wanted], number[wanted]
    if not len(row):
        none = np.zeros(0, dtype=np.int64)
        return none, g[:0], h[:0], none
    features, bins = int(feature.max()) + 2, int(number.max()) + 1
    size = keys * features * bins
    if size <= 4 * len(row):
        index = (key[row] * features + feature + 1) * bins + number
        n = np.bincount(index, minlength=size)
        at = np.flatnonzero(n)
        cells = ((at // bins // features) << PACKED_FEATURE + PACKED_BIN) | ((at // bins % features) << PACKED_BIN) | at % bins
    else:
        packed = (key[row] << PACKED_FEATURE + PACKED_BIN) | ((feature + 1) << PACKED_BIN) | number
        cells, index = np.unique(packed, return_inverse=True)
        size, at = len(cells), slice(None)
        n = np.bincount(index, minlength=size)
    return cells, _exact_sums(index, g[row], size)[at], _exact_sums(index, h[row], size)[at], n[at].astype(np.int64)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Cells of several parts, each once."""
    if len(parts) == 1:
        return parts[0]
    cells, *sums = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, dtype=np.int64)
    return cells[first], *[np.add.reduceat(s[order], first) if len(cells) else s for s in sums]


def count_cells(
    df: DataFrame, members: Sequence[tuple[Sequence[Column], Column, Column, Column | None]], keys: Sequence[str], bins: str = "bins",
    bits: int | None = FIXED_POINT_BITS,
) -> DataFrame:
    """``keys, feature, bin, sg, sh, n`` over all ``members``: (integer key columns, g, h, condition) that share a row's bins.

    Tasks add up their rows in numpy, batch by batch, and hand on cells, at most ``HELD_CELLS`` at a time; the shuffle
    carries no rows. Its keys leave out the bin, so the windows of ``best_split`` need no shuffle of their own.
    """
    columns, any_wanted = [], F.lit(False)
    for m, (key, g, h, wanted) in enumerate(members):
        for j, k in enumerate(key):
            columns.append(k.cast("bigint").alias(f"__k{m}_{j}"))
        for name, value in (("g", g), ("h", h)):
            value = value.cast("double") if bits is None else fixed_point(value, bits)
            columns.append(F.coalesce(value, F.lit(0).cast("double" if bits is None else "bigint")).alias(f"__{name}{m}"))
        wanted = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
        columns.append(wanted.alias(f"__w{m}"))
        any_wanted = any_wanted | wanted
    width, number = len(keys), len(members)
    sent = df.where(any_wanted).select(*columns, F.col(bins).alias("__bins"))
    names = [*keys, "feature", "bin", "sg", "sh", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[int, ...], int] = {}
        held: list[tuple[np.ndarray, ...]] = []

        def out(parts) -> pa.RecordBatch:
            cells, sg, sh, n = _merged(parts)
            table = np.array(list(numbers), dtype=np.int64).reshape(-1, width)
            own = table[cells >> PACKED_FEATURE + PACKED_BIN]
            feature = (cells >> PACKED_BIN & (1 << PACKED_FEATURE) - 1) - 1
            made = [own[:, j].astype(np.int32) for j in range(width)] + [feature.astype(np.int32), (cells & (1 << PACKED_BIN) - 1).astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in [*made, sg, sh, n]], names)

        def chunks() -> Iterator[pa.RecordBatch]:
            waiting, rows, entries = [], 0, 0
            for batch in batches:
                for start in range(0, batch.num_rows, CHUNK_ROWS):
                    piece = batch.slice(start, CHUNK_ROWS)
                    ends = piece.column(piece.num_columns - 1).offsets
                    inside = ends[-1].as_py() - ends[0].as_py()
                    if waiting and (rows + piece.num_rows > CHUNK_ROWS or entries + inside > CHUNK_ENTRIES):
                        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                        waiting, rows, entries = [], 0, 0
                    waiting.append(piece)
                    rows, entries = rows + piece.num_rows, entries + inside
            if rows:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

        for chunk in chunks():
            entries = _entries(chunk.column(chunk.num_columns - 1))
            column = {f.name: chunk.column(i) for i, f in enumerate(chunk.schema)}
            for m in range(number):
                wanted = np.asarray(column[f"__w{m}"].to_numpy(zero_copy_only=False), dtype=bool)
                g, h = (column[f"__{c}{m}"].to_numpy(zero_copy_only=False) for c in "gh")
                stacked = np.stack([column[f"__k{m}_{j}"].fill_null(0).to_numpy(zero_copy_only=False) for j in range(width)])
                code, first = _codes(stacked)
                own = [numbers.setdefault(tuple(k), len(numbers)) for k in stacked[:, first].T.tolist()]
                key = np.where(wanted, np.array(own, dtype=np.int64)[code], -1)
                part = _count_chunk(key, len(numbers), g, h, entries)
                if len(part[0]):
                    held.append(part)
            if sum(len(x[0]) for x in held) > HELD_CELLS:
                held = [_merged(held)]
                if len(held[0][0]) > HELD_CELLS // 2:
                    yield out(held)
                    held = []
        if held:
            yield out(held)

    kind = "double" if bits is None else "bigint"
    partial = sent.mapInArrow(run, ", ".join([f"{k} int" for k in keys] + ["feature int, bin int", f"sg {kind}, sh {kind}, n bigint"]))
    return partial.repartition(*keys, "feature").groupBy(*keys, "feature", "bin").agg(F.sum("sg").alias("sg"), F.sum("sh").alias("sh"), F.sum("n").alias("n"))


def node_histogram(
    df: DataFrame, keys: Sequence[str] = ("tree", "node"), bins: str = "bins", g: str = "g", h: str = "h", bits: int | None = FIXED_POINT_BITS
) -> DataFrame:
    """``keys, feature, bin, sg, sh, n``: sums of g and h, in fixed point unless ``bits`` is None; keys are integers.

    Of sparse rows only present entries are counted; missing ones are the difference to the node's totals (feature
    ``WHOLE_NODE``).
    """
    return count_cells(df, [([F.col(k) for k in keys], F.col(g), F.col(h), None)], keys, bins, bits)


def threshold_sql(g: str, alpha: float) -> str:
    """Soft threshold of a gradient sum by the L1 penalty, as SQL text."""
    if alpha == 0:
        return g
    return f"(CASE WHEN {g} > {alpha!r}D THEN {g} - {alpha!r}D WHEN {g} < {-alpha!r}D THEN {g} + {alpha!r}D ELSE 0D END)"


def weight_sql(g: str, h: str, params: dict, low: str | None = None, high: str | None = None) -> str:
    """-T(G) / (H + lambda), clipped by ``max_delta_step`` and optional bounds, as SQL text."""
    lam, alpha, step = float(params["lambda"]), float(params["alpha"]), float(params.get("max_delta_step") or 0.0)
    w = f"(CASE WHEN {h} + {lam!r}D > 0 THEN -{threshold_sql(g, alpha)} / ({h} + {lam!r}D) ELSE 0D END)"
    if step > 0:
        w = f"greatest(least({w}, {step!r}D), {-step!r}D)"
    if low is not None:
        w = f"greatest(least({w}, {high}), {low})"
    return w


def _score_sql(g: str, h: str, w: str, params: dict, plain: bool) -> str:
    """Twice the loss reduction of a node with weight ``w``."""
    lam, alpha = float(params["lambda"]), float(params["alpha"])
    if plain:
        t = threshold_sql(g, alpha)
        return f"(CASE WHEN {h} + {lam!r}D > 0 THEN {t} * {t} / ({h} + {lam!r}D) ELSE 0D END)"
    return f"(-(2D * {g} * {w} + ({h} + {lam!r}D) * {w} * {w} + 2D * {alpha!r}D * abs({w})))"


def best_split(
    hist: DataFrame,
    params: dict,
    keys: Sequence[str] = ("tree", "node"),
    bits: int | None = FIXED_POINT_BITS,
    candidate: str | None = None,
    bounds: tuple[str, str] | None = None,
    direction: str | None = None,
    sparse: bool = False,
) -> DataFrame:
    """Per node its totals and the split with the largest gain, or NULLs when none is worth making.

    gain = 1/2 [GL^2/(HL+lambda) + GR^2/(HR+lambda) - G^2/(H+lambda)] - gamma. Every bin border is tried with
    missing values on either side. Ties go to the smaller feature, then bin, then missing to the right.
    Windows run per (node, feature), over at most ``max_bin`` rows. ``candidate``, ``bounds`` and ``direction``
    are SQL conditions over tree, node and feature (allowed features, weight limits, monotone sign). A ``sparse``
    histogram has no missing bins: they are what the features of a node lack of its totals, one small row per node.
    """
    scale = "1D" if bits is None else f"{float(2**bits)!r}D"
    keys = list(keys)
    part = ", ".join([*keys, "feature"])
    run = f"OVER (PARTITION BY {part} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    whole = f"OVER (PARTITION BY {part})"
    sums = []
    if sparse:
        whole_node = hist.where(F.col("feature") == WHOLE_NODE).select(*keys, *[F.col(c).alias(f"node_{c}") for c in ("sg", "sh", "n")])
        hist = hist.join(F.broadcast(whole_node), keys)
    for c in ("sg", "sh", "n"):
        present = f"sum(CASE WHEN bin <> {MISSING_BIN} THEN {c} ELSE 0 END)"
        sums.append(f"{present} {run} AS left_{c}")
        missing, every = f"sum(CASE WHEN bin = {MISSING_BIN} THEN {c} ELSE 0 END) {whole}", f"sum({c}) {whole}"
        if sparse:
            missing, every = f"node_{c} - {present} {whole}", f"node_{c}"
        sums += [f"{missing} AS miss_{c}", f"{every} AS all_{c}"]
    df = hist.selectExpr(*keys, "feature", "bin", *sums)
    df = df.selectExpr("*", "explode(CASE WHEN miss_n > 0 THEN array(0, 1) ELSE array(0) END) AS miss_left")
    sides = []
    for c, left, right, total in (("sg", "gl", "gr", "gt"), ("sh", "hl", "hr", "ht")):
        moved = f"(left_{c} + miss_left * miss_{c})"
        sides += [f"{moved} / {scale} AS {left}", f"(all_{c} - {moved}) / {scale} AS {right}", f"all_{c} / {scale} AS {total}"]
    sides += ["left_n + miss_left * miss_n AS nl", "all_n - left_n - miss_left * miss_n AS nr", "all_n AS nt"]
    df = df.selectExpr(*keys, "feature", "bin", "miss_left", *sides)
    plain = bounds is None and not float(params.get("max_delta_step") or 0.0)
    low, high = bounds if bounds else (None, None)
    df = df.selectExpr("*", *[f"{weight_sql('g' + x, 'h' + x, params, low, high)} AS w{x}" for x in "lrt"])
    left, right, total = (_score_sql("g" + x, "h" + x, "w" + x, params, plain) for x in "lrt")
    df = df.selectExpr("*", f"0.5D * ({left} + {right} - {total}) - {float(params['gamma'])!r}D AS raw_gain")
    mcw = float(params["min_child_weight"])
    ok = f"bin <> {MISSING_BIN} AND hl >= {mcw!r}D AND hr >= {mcw!r}D AND nl > 0 AND nr > 0 AND raw_gain > {MIN_GAIN!r}D"
    if candidate is not None:
        ok += f" AND ({candidate})"
    if direction is not None:
        ok += f" AND {direction} * (wr - wl) >= 0"
    choice = (
        "struct(raw_gain AS gain, -feature AS nf, -cast(bin AS int) AS nb, -miss_left AS nm, "
        "gl, hl, nl, gr, hr, nr, wl, wr)"
    )
    best = df.groupBy(*keys).agg(
        F.expr(f"max(CASE WHEN {ok} THEN {choice} END) AS b"),
        F.expr("max(gt) AS g"), F.expr("max(ht) AS h"), F.expr("max(nt) AS n"), F.expr("max(wt) AS weight"),
    )
    return best.selectExpr(
        *keys, "g", "h", "n", "weight", "-b.nf AS feature", "-b.nb AS bin", "b.nm = -1 AS default_left",
        "b.gain", "b.gl", "b.hl", "b.nl", "b.gr", "b.hr", "b.nr", "b.wl", "b.wr",
    )


def subtract_sibling(parent: DataFrame, built: DataFrame, family: str) -> DataFrame:
    """Histogram of the larger child = parent minus the smaller child that was counted.

    ``family`` is SQL text mapping a parent or small-child node to the larger child; exact with fixed point.
    """
    def renamed(df: DataFrame, sign: int) -> DataFrame:
        values = [f"{c} * {sign} AS {c}" for c in ("sg", "sh", "n")]
        return df.selectExpr("tree", f"{family} AS node", "feature", "bin", *values).where("node IS NOT NULL")

    both = renamed(parent, 1).unionByName(renamed(built, -1))
    summed = both.groupBy("tree", "node", "feature", "bin").agg(F.sum("sg").alias("sg"), F.sum("sh").alias("sh"), F.sum("n").alias("n"))
    return summed.where("n > 0")


def leaf_weights(df: DataFrame, params: dict, keys: Sequence[str] = ("tree", "node"), g: str = "g", h: str = "h") -> DataFrame:
    """``keys, g, h, n, weight``: weight already multiplied by ``eta``."""
    agg = df.groupBy(*keys).agg(F.sum(g).alias("g"), F.sum(h).alias("h"), F.count(F.lit(1)).alias("n"))
    return agg.withColumn("weight", F.expr(f"{weight_sql('g', 'h', params)} * {float(params['eta'])!r}D"))
