"""Operator 10: packing of token sequences by a configuration linear program.

The lengths of all pieces form a histogram of at most ``capacity`` bins, whatever the size of the corpus. A
configuration says how many pieces of each length share a sequence. The program asks for the fewest configurations
that cover the histogram; multiplicative weights solve it: every length has a price that falls as it gets covered, a
knapsack dynamic program over the capacity prices the best configurations, and those near the best are raised
together. Rounding takes configurations by weight, as often as their share and what is left of every length allow;
what stays is solved again, and a rest that is bounded by the number of configurations is placed by best fit, longest
first. The plan is a small table; the pieces themselves never leave the executors. Each piece gets its number among
pieces of its length by counts per bucket, and finds its sequence and place from that number.

Cases: a length over ``capacity`` raises (cut first), a length below 1 too; repeated rows are packed each; an empty
table gives an empty result; null ids are allowed.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.staging import stage
from treeline.llm.tokens import library_encoder, slices

Pattern = tuple[tuple[int, int], ...]  # (length, pieces of it), longest first

WORK = 8_000  # price updates per solution, times lengths: few lengths get a finer solution
LEAST_ROUNDS, MOST_ROUNDS = 16, 120
NEAR = 0.02  # configurations within this share of the best are raised together
SOLUTIONS = 3  # times the rest is solved again
BUCKET_ROWS = 100_000


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for every capacity, and the index of a length that attains it (-1: one token stays empty)."""
    value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        k = fit[c]
        values = value[c - lengths[:k]] + prices[:k]
        best = int(values.argmax())
        value[c] = value[c - 1]
        if values[best] > value[c]:
            value[c], pick[c] = values[best], best
    return value, pick


def _trace(first: int, lengths: list[int], left: list[float], fit: list[int], pick: list[int], capacity: int) -> Counter:
    """The configuration that starts with length ``first`` and goes on by the table, within what is left of each length.

    ``fit``: how many lengths fit each capacity.
    """
    counts: Counter = Counter({first: 1})
    c = capacity - lengths[first]
    while c >= lengths[0]:
        best = pick[c]
        if best < 0:
            c -= 1
            continue
        if counts[best] >= left[best]:  # used up: the longest other one that fits
            best = fit[c] - 1
            while best >= 0 and counts[best] >= left[best]:
                best -= 1
            if best < 0:
                break
        counts[best] += 1
        c -= lengths[best]
    return counts


def configuration_shares(lengths: np.ndarray, left: np.ndarray, capacity: int) -> dict[Pattern, float]:
    """How often each configuration is used in a fractional cover of ``left`` pieces of ``lengths`` (ascending)."""
    covered = np.zeros(len(lengths))
    shares: dict[Pattern, float] = {}
    sizes, most = lengths.tolist(), left.tolist()
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    rounds = max(LEAST_ROUNDS, min(MOST_ROUNDS, WORK // len(lengths)))
    fall = 8 / rounds  # by how much a full cover lowers a price
    goal = math.log(len(lengths) + 1) / fall + 1
    for _ in range(rounds):
        prices = lengths / capacity * np.exp(-fall * (covered - covered.min()))
        value, pick = _knapsack(lengths, prices, capacity)
        firsts = np.flatnonzero(prices + value[capacity - lengths] >= (1 - NEAR) * value[capacity])
        picks = pick.tolist()
        chosen = [_trace(i, sizes, most, fit, picks, capacity) for i in firsts.tolist()]
        chosen = list({tuple(sorted(p.items())): p for p in chosen}.values())
        used = np.zeros(len(lengths))
        for p in chosen:
            for i, n in p.items():
                used[i] += n
        step = 1 / np.max(used / left)
        for p in chosen:
            key = tuple((int(lengths[i]), n) for i, n in sorted(p.items(), reverse=True))
            shares[key] = shares.get(key, 0.0) + step
        covered += used * step / left
        if covered.min() >= goal:
            break
    scale = max(float(np.median(covered)), 1e-9)
    return {p: s / scale for p, s in shares.items()}


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Configurations and how many sequences each of them gets; together they use every piece exactly once."""
    if any(not 1 <= n <= capacity for n in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    left = {n: c for n, c in histogram.items() if c}
    plan: Counter = Counter()
    if capacity in left:
        plan[((capacity, 1),)] = left.pop(capacity)
    for _ in range(SOLUTIONS):
        if not left:
            break
        lengths = np.array(sorted(left), dtype=np.int64)
        shares = configuration_shares(lengths, np.array([left[n] for n in lengths.tolist()], dtype=np.float64), capacity)
        full = {p: sum(n * k for n, k in p) for p in shares}
        for pattern, share in sorted(shares.items(), key=lambda x: (-int(x[1]), -full[x[0]], -x[1])):
            if full[pattern] < capacity * (1 - NEAR):
                continue
            copies = min(math.ceil(share), *(left.get(n, 0) // k for n, k in pattern))
            if copies:
                plan[pattern] += copies
                for n, k in pattern:
                    left[n] -= k * copies
        left = {n: c for n, c in left.items() if c}
    plan.update(_best_fit(left, capacity))
    return list(plan.items())


def _best_fit(left: dict[int, int], capacity: int) -> Counter:
    """Longest first, each piece into the fullest sequence it fits; pieces of one length that would open sequences do so together."""
    open_: dict[int, list[list[Counter | int]]] = {}  # free tokens: groups of equal sequences, as [configuration, how many]
    free: list[int] = []

    def put(room: int, config: Counter, many: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(free, room)
        open_[room].append([config, many])

    for n in sorted(left, reverse=True):
        many = left[n]
        while many:
            at = bisect.bisect_left(free, n)
            if at == len(free):
                each = min(capacity // n, many)
                groups = many // each
                put(capacity - each * n, Counter({n: each}), groups)
                many -= each * groups
                continue
            room = free[at]
            config, count = open_[room].pop()
            if not open_[room]:
                del open_[room]
                free.pop(at)
            each = min(room // n, many)
            take = min(count, many // each)
            if take < count:
                put(room, config, count - take)
            put(room - each * n, config + Counter({n: each}), take)
            many -= each * take
    out: Counter = Counter()
    for groups in open_.values():
        for config, count in groups:
            out[tuple(sorted(config.items(), reverse=True))] += count
    return out


def _slots(plan: list[tuple[Pattern, int]]) -> tuple[np.ndarray, ...]:
    """Per length the runs of piece numbers: key (length, first number), pieces per sequence, first sequence, place."""
    rows, numbered, sequence = [], Counter(), 0
    for pattern, copies in plan:
        place = 0
        for n, k in pattern:
            rows.append(((n << 44) + numbered[n], numbered[n], k, sequence, place))
            numbered[n] += k * copies
            place += n * k
        sequence += copies
    rows.sort()
    return tuple(np.array([r[i] for r in rows], dtype=np.int64) for i in range(5))


def pack_best_fit(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: gapless from 0 in every sequence, at most ``capacity`` tokens.

    ``pieces`` is read three times (histogram, counts, numbering): pass a written table. Columns of these two names
    are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    histogram = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # at most `capacity` rows
    if None in histogram:
        raise ValueError("a piece without length")
    total = sum(histogram.values())
    slots = _slots(plan_sequences(histogram, capacity))
    buckets = max(16, -(-total // BUCKET_ROWS))
    keyed = pieces.select("*", F.pmod(F.xxhash64(*[c for c in pieces.columns if c != length_col]), F.lit(buckets)).alias("__bucket"))
    counts = keyed.groupBy(length_col, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(length_col).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(length_col, "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(length_col, "__bucket").orderBy(*[c for c in pieces.columns if c != length_col])
    numbered = keyed.withColumn("__row", F.row_number().over(inside)).join(bases, [length_col, "__bucket"])
    numbered = numbered.select(*pieces.columns, (F.col("__base") + F.col("__row") - 1).alias("__number"))
    names = pieces.columns
    at_length = names.index(length_col)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, each, sequence, offset = slots
        for batch in batches:
            length = np.asarray(batch.column(at_length), dtype=np.int64)
            number = np.asarray(batch.column(batch.num_columns - 1), dtype=np.int64)
            run = np.searchsorted(keys, (length << 44) + number, side="right") - 1
            nth = number - first[run]
            columns = [pa.array(sequence[run] + nth // each[run]), pa.array(offset[run] + nth % each[run] * length)]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + columns, [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text plus ``end_id``, cut only if longer than ``capacity``: one row per piece.

    ``id_col, piece, start, length, ids_crc32``. A null text is an empty one; only the two named columns are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        end = int(end_id).to_bytes(4, "little")
        for part in slices(batches, text_col):
            rows: list[tuple[int, int, int, int, int]] = []
            coded = encoder.encode([t or "" for t in part.column(1).to_pylist()])
            for row, ids in enumerate(coded):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((row, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            table = np.array(rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32))] + [pa.array(table[:, i]) for i in (2, 3, 4)],
                [id_col, "piece", "start", "length", "ids_crc32"],
            )

    frame = docs.select(id_col, text_col)
    kind = frame.schema[id_col].dataType.simpleString()
    return frame.mapInArrow(run, f"{id_col} {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts, writes the pieces (numbers only) to the shared folder once, and packs them."""
    pieces = stage(cut_documents(docs, vocabulary, end_id, capacity, id_col, text_col), "pieces")
    return pack_best_fit(pieces, capacity)
