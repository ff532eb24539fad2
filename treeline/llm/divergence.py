"""Operator 11: how far the sources of a language differ in their words, and in which.

Index. Each task reads its texts once and counts terms per (language, source) in memory: occurrences and documents.
When ``MOST_POSTINGS`` of them are held, they are spilled as one run: sorted by term, cut by hash shard into chunks that
do not overlap. A shard's task gets the chunks of all runs in order of their first term and merges them over a heap; a
chunk is opened when the heap has come to its first term, so only chunks that overlap are held. What leaves the heap are
the frequencies of every term, at once, and the terms in fewer than ``least_docs`` documents of their language go.

Pair corrections. With ``p`` the share of a term (a billion for 1) and ``p0`` the share of a term that does not occur,
the sum of ``f`` over all terms of two sources is ``V * f(p0, q0)``, plus a correction for each term that one of them
has, plus one for each term that both have. So only postings are read, never terms times sources. Sources are numbered
and cut into tiles of ``TILE``; the postings of two tiles stream, by term, past one matrix of corrections per task.
Salts by term spread a language over many tasks. All numbers are integers; a product that could pass 64 bits is
divided in steps.

Cases: null text, language and source are ''; a source without terms keeps its rows, with the shares of absent terms; a
language without kept terms has value 0 for all pairs and no terms; an only source has no pairs; repeated rows count as
often as they stand; an empty table gives no rows; other columns are not read. A task holds one term's sources, one
text and one chunk per overlapping run.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.staging import stage
from treeline.llm.tokens import slices

BILLION = 1_000_000_000
MOST_POSTINGS = 400_000  # (language, source, term) held by a task; about 60 MB
CHUNK = 4096  # postings of a run's chunk
SHARDS_PER_PARTITION = 2
TILE = 256  # sources per side of a matrix of corrections
SALTS = 48
PAIRS_AT_ONCE = 1 << 20
#: Letters of A to Z in either case, and everything beyond ASCII.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

RUN = pa.schema(
    [("shard", pa.int32()), ("lang", pa.string()), ("first", pa.binary()), ("sources", pa.list_(pa.string())), ("terms", pa.list_(pa.binary()))]
    + [("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]
)
RUN_SQL = (
    "shard int, lang string, first binary, sources array<string>, terms array<binary>, docs array<bigint>, sizes array<int>, codes array<int>, counts array<bigint>"
)


# -- the index


def _spilled(held: dict[str, dict[str, tuple[Counter, Counter]]], shards: int) -> Iterator[pa.RecordBatch]:
    """What a task holds, as one run: per shard and language, chunks of ascending terms with their postings."""
    rows = []
    for lang, by_source in held.items():
        sources = list(by_source)
        every = [t for counts, _ in by_source.values() for t in counts]
        terms = sorted(set(every))
        number = dict(zip(terms, range(len(terms)), strict=True))
        at = np.fromiter(map(number.__getitem__, every), dtype=np.int64, count=len(every))
        code = np.repeat(np.arange(len(sources), dtype=np.int32), [len(counts) for counts, _ in by_source.values()])
        count = np.concatenate([np.fromiter(counts.values(), dtype=np.int64) for counts, _ in by_source.values()])
        docs = np.concatenate([np.fromiter(map(docs.__getitem__, counts), dtype=np.int64) for counts, docs in by_source.values()])
        of_term = np.bincount(at, docs, len(terms)).astype(np.int64)
        shard = np.fromiter(map(xxhash.xxh32_intdigest, terms), dtype=np.uint32, count=len(terms)) % shards
        # postings by (shard, term, source), terms by (shard, term)
        by_posting, by_term = np.lexsort((code, at, shard[at])), np.lexsort((np.arange(len(terms)), shard))
        code, count = code[by_posting], count[by_posting]
        sizes = np.bincount(at, minlength=len(terms))[by_term]
        ends = np.append(0, np.cumsum(sizes))
        starts = np.append(np.searchsorted(shard[by_term], np.arange(shards)), len(terms))
        for s in range(shards):
            for lo in range(starts[s], starts[s + 1], CHUNK):
                hi = min(lo + CHUNK, starts[s + 1])
                names = [terms[k] for k in by_term[lo:hi]]
                inside = slice(ends[lo], ends[hi])
                rows.append((s, lang, names[0], sources, names, of_term[by_term[lo:hi]], sizes[lo:hi].astype(np.int32), code[inside], count[inside]))
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RUN.types, strict=True)], schema=RUN)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RUN.types, strict=True)], schema=RUN)


def runs(docs: DataFrame, shards: int, most: int = MOST_POSTINGS) -> DataFrame:
    """Term-sorted runs over ``lang, source, text`` without nulls, each spilled when a task's memory was full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, tuple[Counter, Counter]]] = {}
        size = 0
        for part in slices(batches, "text"):
            for lang, source, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = TERM.findall(text.encode().translate(LOWER))
                if not words:
                    continue
                counts, docs = held.setdefault(lang, {}).setdefault(source, (Counter(), Counter()))
                before = len(counts)
                counts.update(words)
                docs.update(set(words))
                size += len(counts) - before
                if size >= most:
                    yield from _spilled(held, shards)
                    held, size = {}, 0
        yield from _spilled(held, shards)

    return docs.select("lang", "source", "text").mapInArrow(run, RUN_SQL)


class _Merge:
    """Heap merge of the chunks of one shard and language, which come in order of their first term.

    The heap holds the next term of every open chunk. What it gives are numbers of merged terms per chunk; the postings
    behind them are summed together when many terms have left the heap.
    """

    def __init__(self) -> None:
        self.heap: list[tuple[bytes, int, int]] = []
        self.chunks: dict[int, tuple] = {}
        self.taken: dict[int, list[int]] = {}
        self.codes: dict[str, int] = {}
        self.terms: list[bytes] = []
        self.opened = self.ready = 0

    def add(self, sources: list[str], terms: list[bytes], docs: np.ndarray, sizes: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> None:
        own = np.array([self.codes.setdefault(s, len(self.codes)) for s in sources], dtype=np.int64)
        self.chunks[self.opened] = (terms, docs, np.append(0, np.cumsum(sizes)), own[codes], counts)
        self.taken[self.opened] = []
        heapq.heappush(self.heap, (terms[0], self.opened, 0))
        self.opened += 1

    def until(self, limit: bytes | None) -> None:
        """Takes all terms below ``limit``, or all."""
        heap, terms, chunks, taken = self.heap, self.terms, self.chunks, self.taken
        while heap and (limit is None or heap[0][0] < limit):
            term, chunk, i = heap[0]
            if not terms or terms[-1] != term:
                terms.append(term)
            taken[chunk].append(len(terms) - 1)
            of = chunks[chunk][0]
            if i + 1 < len(of):
                heapq.heapreplace(heap, (of[i + 1], chunk, i + 1))
            else:
                heapq.heappop(heap)

    def sums(self, least_docs: int) -> tuple[list[str], np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Term, number of the term, its sum, source and count of all postings taken since the last call.

        Call it only between terms, when no chunk can hold more of the last one.
        """
        at, docs, of, codes, counts = ([np.empty(0, dtype=np.int64)] for _ in range(5))
        going = {chunk: i for _, chunk, i in self.heap}
        for chunk, found in self.taken.items():
            stop = going.get(chunk, len(self.chunks[chunk][0]))
            lo, (_, d, ends, c, n) = stop - len(found), self.chunks[chunk]
            found = np.array(found, dtype=np.int64)
            inside = slice(ends[lo], ends[stop])
            for out, x in zip((at, docs, of, codes, counts), (found, d[lo:stop], np.repeat(found, np.diff(ends[lo : stop + 1])), c[inside], n[inside]), strict=True):
                out.append(x)
        at, docs, of, codes, counts = (np.concatenate(x) for x in (at, docs, of, codes, counts))
        in_docs = np.zeros(len(self.terms), dtype=np.int64)
        np.add.at(in_docs, at, docs)
        keep = in_docs[of] >= least_docs
        of, codes, counts = of[keep], codes[keep], counts[keep]
        order = np.lexsort((codes, of))
        of, codes, counts = of[order], codes[order], counts[order]
        new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (codes[1:] != codes[:-1]))) if len(of) else np.empty(0, dtype=np.int64)
        total = np.zeros(len(self.terms), dtype=np.int64)
        np.add.at(total, of, counts)
        counts = np.add.reduceat(counts, new) if len(of) else counts
        of, codes = of[new], codes[new]
        names, sources = self.terms, list(self.codes)
        self.terms, self.taken = [], {c: [] for c in going}
        self.chunks = {c: self.chunks[c] for c in going}
        self.ready += len(names)
        return [names[k].decode() for k in of], of + (self.ready - len(names)), total[of], [sources[k] for k in codes], counts


def frequencies(spilled: DataFrame, least_docs: int, at_once: int = 1 << 16) -> DataFrame:
    """``lang, term, term_id, in_lang, source, n, opens`` of every term in at least ``least_docs`` documents of its language.

    ``n`` counts its places in the source, ``in_lang`` in the language; ``term_id`` is a number of its own,
    and ``opens`` marks the first of its rows.
    """
    names = ["lang", "term", "term_id", "in_lang", "source", "n", "opens"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, cell, used = _Merge(), None, 0

        def batch() -> pa.RecordBatch:
            term, number, in_lang, source, n = merge.sums(least_docs)
            ids = (np.int64(cell[0]) << 40) + number + used
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([cell[1]] * len(term), term, ids, in_lang, source, n, np.diff(ids, prepend=-1) != 0), kinds, strict=True)], names)

        for part in batches:
            flat = [part.column(c) for c in range(part.num_columns)]
            for i in range(part.num_rows):
                shard, lang, first = (flat[c][i].as_py() for c in range(3))
                if cell != (shard, lang):
                    if cell is not None:
                        merge.until(None)
                        yield batch()
                        used = used + merge.ready if cell[0] == shard else 0
                    merge, cell = _Merge(), (shard, lang)
                else:
                    merge.until(first)
                    if len(merge.terms) >= at_once:
                        yield batch()
                merge.add(flat[3][i].as_py(), flat[4][i].as_py(), *(flat[c][i].values.to_numpy() for c in range(5, 9)))
        if cell is not None:
            merge.until(None)
            yield batch()

    dealt = spilled.repartition("shard").sortWithinPartitions("shard", "lang", "first")
    return dealt.mapInArrow(run, "lang string, term string, term_id bigint, in_lang bigint, source string, n bigint, opens boolean")


# -- shares and divergences


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(1e9 * (count + 2) / (total + 2 * terms))`` by three divisions whose products fit 64 bits."""
    below = total + 2 * terms

    def divided(c: Column, d: Column) -> tuple[Column, Column]:
        return F.call_function("div", c * 1000, d), c * 1000 % d

    whole, rest = F.call_function("div", count + 2, below), (count + 2) % below
    for _ in range(3):
        q, rest = divided(rest, below)
        whole = whole * 1000 + q
    return F.when(below > 0, whole + 1)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


class _Matrix:
    """Corrections of one pair of tiles; ``diagonal`` says that both are the same one."""

    def __init__(self, diagonal: bool):
        self.diagonal, self.first, self.terms = diagonal, (0, 0), 0
        self.p0: tuple[list[int], list[int]] = ([], [])
        self.sums: np.ndarray | None = None

    def source(self, side: int, number: int, p0: int, terms: int) -> None:
        """A source of one side; they come in order, before all postings."""
        self.p0[side].append(p0)
        if len(self.p0[side]) == 1:
            self.first = (number, self.first[1]) if side == 0 else (self.first[0], number)
        self.terms = terms

    def start(self, whole: bool) -> None:
        if self.diagonal:
            self.first, self.p0 = (self.first[0], self.first[0]), (self.p0[0], self.p0[0])
        self.a0, self.b0 = (np.array(x, dtype=np.int64) for x in self.p0)
        self.none = _f(self.a0[:, None], self.b0[None, :]) if self.terms else np.zeros((len(self.a0), len(self.b0)), dtype=np.int64)
        self.sums = self.none * self.terms if whole else np.zeros_like(self.none)

    def add(self, term: np.ndarray, side: np.ndarray, number: np.ndarray, p: np.ndarray) -> None:
        """Postings of whole terms, in order of term."""
        if self.diagonal:
            one = (term, number - self.first[0], p)
            sides = (one, one)
        else:
            sides = tuple((term[side == s], number[side == s] - self.first[s], p[side == s]) for s in (0, 1))
        (ta, a, pa_), (tb, b, pb) = sides
        # a term that one source has, against the share of an absent term in the other
        for rows, other, turned in (((a, pa_), self.b0, False), ((b, pb), self.a0, True)):
            kinds, times = np.unique(np.stack(rows, axis=1), axis=0, return_counts=True)
            for at in range(0, len(kinds), 2048):
                i, times_i = kinds[at : at + 2048, 0], times[at : at + 2048, None]
                none = (self.none.T if turned else self.none)[i]
                np.add.at(self.sums.T if turned else self.sums, i, (_f(kinds[at : at + 2048, 1][:, None], other[None, :]) - none) * times_i)
        # a term that both have
        starts, ends = np.searchsorted(tb, ta, "left"), np.searchsorted(tb, ta, "right")
        sizes = ends - starts
        bounds = np.cumsum(sizes)
        at = 0
        while at < len(ta):
            stop = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            n = sizes[at:stop]
            i = np.repeat(np.arange(at, stop), n)
            j = starts[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            x, y = a[i], b[j]
            both = _f(pa_[i], pb[j]) - _f(pa_[i], self.b0[y]) - _f(self.a0[x], pb[j]) + self.none[x, y]
            np.add.at(self.sums, (x, y), both)
            at = stop

    def rows(self, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = np.nonzero(np.ones_like(self.sums) if whole else self.sums)
        return x + self.first[0], y + self.first[1], self.sums[x, y]


def _corrections(stream: DataFrame) -> DataFrame:
    """``lang, a, b, value`` per task over ``lang, i, j, salt, term_id, side, number, p, terms``; sources have the term -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, matrix = None, None
        kept: list[tuple[np.ndarray, ...]] = []

        def flush() -> None:
            if matrix.sums is None:
                matrix.start(key[3] == 0)
            if kept:
                matrix.add(*(np.concatenate(c) for c in zip(*kept, strict=True)))
                kept.clear()

        def closed() -> pa.RecordBatch:
            flush()
            a, b, value = matrix.rows(key[3] == 0)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(a), pa.string()), *(pa.array(x, pa.int64()) for x in (a, b, value))], ["lang", "a", "b", "value"])

        for part in batches:
            langs = np.array(part.column(0).to_pylist(), dtype=object)
            i, j, salt, term, side, number, p, terms = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(1, 9))
            new = (langs[1:] != langs[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (salt[1:] != salt[:-1])
            bounds = [0, *(np.flatnonzero(new) + 1).tolist(), len(langs)]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                here = (langs[lo], i[lo], j[lo], salt[lo])
                if here != key:
                    if matrix is not None:
                        yield closed()
                    key, matrix = here, _Matrix(here[1] == here[2])
                first = lo + int(np.searchsorted(term[lo:hi], 0))
                for k in range(lo, first):
                    matrix.source(int(side[k]), int(number[k]), int(p[k]), int(terms[k]))
                if first == hi:
                    continue
                # a term whose postings go on in this batch stays whole
                if kept and term[first] != kept[-1][0][-1] and sum(len(x[0]) for x in kept) > PAIRS_AT_ONCE // 8:
                    flush()
                kept.append((term[first:hi], side[first:hi], number[first:hi], p[first:hi]))
        if matrix is not None:
            yield closed()

    return stream.mapInArrow(run, "lang string, a bigint, b bigint, value bigint")


def divergence_audit(docs: DataFrame, least_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: all other sources of the language by divergence, and the ``top`` terms
    that a source uses more than its language, by their share of the divergence."""
    spark = docs.sparkSession
    shards = max(64, SHARDS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    kept = stage(frequencies(runs(plain, shards), least_docs), "divergence-index")

    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("opens").cast("int")).alias("opened"))
    of_lang = of_source.groupBy("lang").agg(F.sum("opened").alias("terms"), F.sum("total").alias("lang_total"))
    of_source = of_source.drop("opened")
    groups = plain.select("lang", "source").distinct().join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    order = Window.partitionBy("lang").orderBy("source")
    groups = groups.select(
        "lang", "source", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"), F.coalesce("terms", F.lit(0)).cast("bigint").alias("terms"),
        F.coalesce("lang_total", F.lit(0)).cast("bigint").alias("lang_total"), (F.row_number().over(order) - 1).cast("bigint").alias("number"),
        F.floor((F.count(F.lit(1)).over(Window.partitionBy("lang")) - 1) / TILE).cast("bigint").alias("last_tile"),
    )
    groups = stage(groups.withColumn("p0", share(F.lit(0).cast("bigint"), F.col("total"), F.col("terms"))), "divergence-groups")

    found = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    q = share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    ranked = found.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # every posting and every source goes to the pairs of tiles it is in
    tile = F.floor(F.col("number") / TILE).cast("bigint")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last_tile")))
    place = [F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")]
    side = F.when(F.col("tile") > F.col("other"), 1).otherwise(0).alias("side")
    dealt = found.withColumn("tile", tile).withColumn("other", other).select(
        "lang", *place, F.pmod(F.xxhash64("term_id"), F.lit(SALTS)).cast("int").alias("salt"), "term_id", side, "number", "p", "terms"
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    sources = groups.withColumn("tile", tile).withColumn("other", other).select(
        "lang", *place, salts, F.lit(-1).cast("bigint").alias("term_id"), side, "number", F.coalesce("p0", F.lit(0)).alias("p"), "terms"
    )
    stream = sources.unionByName(dealt).repartition("lang", "i", "j", "salt").sortWithinPartitions("lang", "i", "j", "salt", "term_id", "side", "number")
    sums = _corrections(stream).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    # a tile against another one gives each pair once, a tile against itself both ways round
    turned = sums.where(F.floor(F.col("a") / TILE) != F.floor(F.col("b") / TILE)).select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    names = groups.select("lang", "number", "source")
    by_pair = sums.where("a <> b").unionByName(turned).join(names.withColumnRenamed("number", "a"), ["lang", "a"])
    by_pair = by_pair.join(names.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    by_pair = by_pair.withColumn("rank", F.row_number().over(best))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return by_pair.withColumn("part", F.lit("pair")).select(*columns).unionByName(by_term.withColumn("part", F.lit("term")).select(*columns))
