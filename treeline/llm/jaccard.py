"""Operator 4: n-gram Jaccard join over size-banded tiles with hashed bitmap signatures.

Two sets of sizes n and m whose Jaccard index reaches p / q differ in at most H = (n + m)(q - p) / (q + p) elements.
Sizes are cut into bands; in a band H is bounded by its largest size, so if the hashed elements are dealt to more
than H parts, two sets that link agree in at least one whole part. A tile is all sets of a band (and those just below it)
with the same content of one part: nothing but near copies meet there, whatever words or passages are frequent, and no
link is lost. Nearly all tiles hold one set, so keys travel packed, per chunk of sets and bucket of keys one row with 7 bytes
per key; a bucket finds its keys that occur twice, and only those of such tiles leave it. Inside tiles, sizes and bitmaps come first: a bit that one set has and the other lacks is an element the
other lacks, so bit counts bound the overlap from above. Only pairs that pass are compared by intersection of their
sorted arrays.

Equal sets are one class, named by its first row. Tiles with the same least class are one group, so two sets that share
many tiles meet once or twice, not in each of them. A group is compared by sizes and bits in chunk pairs of bounded
size and gives a forest of the pairs that pass, fewer rows than it has members. The edges are compared exactly. Trees
with an edge that is no link are compared once more by their arrays, across the components that the links have made,
and give a forest of links. So no table of pairs grows with the square of a group, and the result is exact.

Elements are 64-bit hashes of the n-gram's words. Cases: null and empty texts, and texts of white space, have no set
and link with nothing; texts shorter than the n-gram are one element; rows without id take part, but a component is
named by its smallest id (null if it has none); repeated rows are members of their class; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.components import connected_components
from treeline.llm.hashing import ODD, mix, run_hashes, word_hashes
from treeline.llm.staging import drop, stage
from treeline.llm.tokens import slices

BAND = 1.5  # sizes of a band, largest to smallest
DEALS = 4
KEPT_DIGESTS = 200_000  # of a task
BROADCAST_ROWS = 2_000_000  # rows of 8 or 16 bytes that may be sent to every executor
BUCKET_CHARS = 8 << 20  # characters of text per bucket of tile keys
LEAST_BUCKETS = 64
FLUSH_KEYS = 1 << 19  # packed together by a task
KEY_BYTES = 5  # kept of a key in its bucket; two that agree by chance make a tile without a link
LIST_ROWS = 1 << 16
CHUNK = 2048  # members of a group compared with as many others in one task
CHUNK_ELEMENTS = 2_000_000  # elements of their sets


def shingle_set(text: str, n: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text's words, A-Z lower-cased."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    return np.unique(run_hashes(word_hashes(words), min(n, len(words))))


def bands(most: int) -> list[int]:
    """Smallest sizes of the bands, up to one beyond ``most``."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return out


_BANDS = bands(1 << 40)


def _part_keys(sorted_set: np.ndarray, parts: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """A key per part, and the sizes of the parts; parts are ranges of the sorted hashes."""
    with np.errstate(over="ignore"):
        edges = (np.arange(1, parts, dtype=np.uint64) * np.uint64(2**64 // parts)) if parts > 1 else np.empty(0, dtype=np.uint64)
        ends = np.concatenate(([0], np.searchsorted(sorted_set, edges), [len(sorted_set)]))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(sorted_set * ODD[1]), dtype=np.uint64)))
        content = sums[ends[1:]] - sums[ends[:-1]]
        keys = mix(mix(content + np.uint64(tag) * ODD[2]) + np.arange(parts, dtype=np.uint64) * ODD[3])
    return keys, np.diff(ends)


@cache
def _parts(band: int, p: int, q: int) -> tuple[int, int]:
    """Into how many parts sets of a band are dealt, and how many of them may be empty without harm.

    With H differences and k parts, two sets that link agree in at least k - H parts, so in one that isn't empty if
    fewer than k - H parts of either are empty. k is H + 1 and what is usually empty for the smallest sets of the band.
    """
    low, high = max(1, p * _BANDS[band] // q), _BANDS[band + 1] - 1
    differ = 2 * high * (q - p) // (q + p)
    spare = 0
    while True:
        parts = differ + 1 + spare
        empty = parts * (1 - 1 / parts) ** low if parts > 1 else 0.0
        if spare + 1 > empty + 2 * empty**0.5 or spare > differ:
            return parts, spare
        spare += 1


def tile_keys(sorted_set: np.ndarray, p: int, q: int) -> np.ndarray:
    """Keys of all tiles a set belongs to: its parts that aren't empty.

    A set with too many empty parts is dealt anew by another hash, up to ``DEALS`` times, as is any set that it may
    have to meet there; at the last deal empty parts have keys too.
    """
    n = len(sorted_set)
    band = int(np.searchsorted(_BANDS, n, side="right")) - 1
    out = []
    b = band
    while b == band or n * q >= p * _BANDS[b]:  # a set large enough to link with one of the next band meets it there
        parts, spare = _parts(b, p, q)
        dealt = sorted_set
        for deal in range(DEALS):
            keys, sizes = _part_keys(dealt, parts, DEALS * b + deal)
            enough = int((sizes == 0).sum()) <= spare
            out.append(keys if deal == DEALS - 1 and not enough else keys[sizes > 0])
            if enough:
                break
            with np.errstate(over="ignore"):
                dealt = np.sort(mix(dealt * ODD[3]))
        b += 1
    return np.unique(np.concatenate(out))


def bitmap(sorted_set: np.ndarray) -> np.ndarray:
    """Bits of the hashed elements, in 64-bit words: 8 to 16 bits per element, a power of two.

    So dense that about one element in ten hides behind another: few pairs pass the bound without a link.
    """
    bits = max(64, 1 << (16 * max(len(sorted_set), 1) - 1).bit_length() - 1)
    at = sorted_set & np.uint64(bits - 1)
    out = np.zeros(bits // 64, dtype=np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def _folded(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (or rows of bitmaps) brought to ``size`` 64-bit words."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] | words[..., half:]
    return words


def overlap_bound(a: np.ndarray, n: np.ndarray | int, b: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """No pair of sets with these bitmaps and sizes shares more elements."""
    size = min(a.shape[-1], b.shape[-1])
    a, b = _folded(a, size), _folded(b, size)
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(n - only_a, m - only_b)


def reaches(shared: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int, p: int, q: int):
    """Whether ``shared`` of sizes ``n`` and ``m`` makes an index of at least p / q."""
    return q * shared >= p * (n + m - shared)


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _u64(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


def jaccard_components(docs: DataFrame, n: int = 3, p: int = 90, q: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` of every row; links are pairs with q * intersection >= p * union."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chars = source.agg(F.sum(F.length("text"))).first()[0] or 0
    keyed = stage(_keyed(source, n, p, q, max(LEAST_BUCKETS, -(-chars // BUCKET_CHARS))), "keyed")
    rows = stage(keyed.where("row IS NOT NULL").select("id", "n", "digest", "row", "entered"), "rows")
    links, spent = _links(source, rows, keyed, n, p, q)
    named = connected_components(links)
    drop(*spent)
    own = rows.where("n > 0").select("row", "digest", "id").join(named, F.col("row") == F.col("node"), "left")
    classes = own.groupBy("digest").agg(F.min("component").alias("component"), F.min("row").alias("row"), F.min("id").alias("id"))
    classes = classes.select("digest", "id", F.coalesce("component", "row").alias("component"))
    names = classes.groupBy("component").agg(F.min("id").alias("component_id"))
    of_digest = classes.join(names, "component").select("digest", "component_id")
    out = rows.select("id", "n", "digest").join(of_digest, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _pack_keys(keys: np.ndarray, rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket and page of 65,536 rows: the low bytes of its keys and the places of their rows in the page."""
    bucket, page = (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32), rows >> 16
    order = np.lexsort((page, bucket))
    bucket, page = bucket[order], page[order]
    low = keys[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
    places = (rows[order] & 0xFFFF).astype("<u2")
    at = np.flatnonzero(np.concatenate(([True], (np.diff(bucket) != 0) | (np.diff(page) != 0)))[: len(keys)])
    ends = np.append(at[1:], len(keys)).tolist()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[at]),
            pa.array(page[at]),
            pa.array([low[i:j].tobytes() for i, j in zip(at.tolist(), ends, strict=True)], pa.binary()),
            pa.array([places[i:j].tobytes() for i, j in zip(at.tolist(), ends, strict=True)], pa.binary()),
        ],
        ["bucket", "page", "keys", "places"],
    )


def _unpack_keys(packed: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Low bytes of the keys of a bucket, as integers, and their rows."""
    low = np.frombuffer(b"".join(packed.column("keys").to_pylist()), dtype=np.uint8).reshape(-1, KEY_BYTES)
    keys = np.zeros((len(low), 8), dtype=np.uint8)
    keys[:, :KEY_BYTES] = low
    places = packed.column("places").to_pylist()
    pages = np.repeat(np.asarray(packed.column("page"), dtype=np.int64), [len(x) // 2 for x in places])
    return keys.view("<u8").ravel(), (pages << 16) + np.frombuffer(b"".join(places), dtype="<u2")


def _shared(keys: np.ndarray, rows: np.ndarray) -> pa.Table:
    """``least, classes``: the distinct rows of tiles of several rows, by the least of the tile; long lists come in pieces."""
    order = np.lexsort((rows, keys))
    keys, rows = keys[order], rows[order]
    start = np.flatnonzero(np.concatenate(([True], np.diff(keys) != 0))[: len(keys)])
    size = np.diff(np.append(start, len(keys)))
    least, several = np.repeat(rows[start], size), np.repeat(size > 1, size)
    least, rows = least[several], rows[several]
    order = np.lexsort((rows, least))
    least, rows = least[order], rows[order]
    new = np.concatenate(([True], (np.diff(least) != 0) | (np.diff(rows) != 0)))[: len(rows)]
    least, rows = least[new], rows[new]
    at = np.flatnonzero(np.concatenate(([True], np.diff(least) != 0))[: len(rows)] | (np.arange(len(rows)) % LIST_ROWS == 0))
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(rows)).astype(np.int32)), pa.array(rows))
    return pa.table([pa.array(least[at]), lists], ["least", "classes"])


def _keyed(source: DataFrame, n: int, p: int, q: int, buckets: int) -> DataFrame:
    """``row, id, n, digest, entered`` of every row, and ``least, classes`` of the rows that share tiles, in one pass.

    Both must come from the same numbering of rows, so rows travel with the keys, to a bucket of their number.
    """
    id_type = source.schema["id"].dataType.simpleString()
    of_row, of_keys = f"row bigint, id {id_type}, n bigint, digest binary, entered boolean", "page bigint, keys binary, places binary"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held, owners, size, id_kind = [], [], 0, None

        def flush() -> pa.RecordBatch:
            packed = _pack_keys(np.concatenate(held), np.concatenate(owners), buckets)
            empty = [pa.nulls(packed.num_rows, kind) for kind in (pa.int64(), id_kind, pa.int64(), pa.binary(), pa.bool_())]
            return pa.RecordBatch.from_arrays([packed.column(0), *empty, *packed.columns[1:]], names)

        names = ["bucket", "row", "id", "n", "digest", "entered", "page", "keys", "places"]
        for part in slices(batches, "text"):
            found = [shingle_set(t or "", n) for t in part.column("text").to_pylist()]
            digests, entered, id_kind = [_digest(s) for s in found], [], part.column("id").type
            rows = np.asarray(part.column("row"))
            for s, digest, row in zip(found, digests, rows.tolist(), strict=True):
                entered.append(bool(len(s)) and digest not in seen)  # equal sets of a task are entered once
                seen.add(digest)
                if entered[-1]:
                    held.append(tile_keys(s, p, q))
                    owners.append(np.full(len(held[-1]), row, dtype=np.int64))
                    size += len(held[-1])
                    if size > FLUSH_KEYS:
                        yield flush()
                        held, owners, size = [], [], 0
            if len(seen) > KEPT_DIGESTS:
                seen.clear()
            empty = [pa.nulls(len(found), kind) for kind in (pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((rows % buckets).astype(np.int32)), part.column("row"), part.column("id"), pa.array([len(s) for s in found], pa.int64()),
                    pa.array(digests, pa.binary()), pa.array(entered, pa.bool_()), *empty,
                ],
                names,
            )
        if held:
            yield flush()

    def match(bucket: pa.Table) -> pa.Table:
        is_row = bucket.column("row").is_valid()
        rows = bucket.filter(is_row).select(["row", "id", "n", "digest", "entered"])
        tiles = _shared(*_unpack_keys(bucket.filter(pa.compute.invert(is_row))))
        lists = pa.list_(pa.int64())
        empty = [pa.nulls(tiles.num_rows, rows.schema.field(c).type) for c in rows.column_names]
        rows = rows.append_column("least", pa.nulls(rows.num_rows, pa.int64())).append_column("classes", pa.nulls(rows.num_rows, lists))
        return pa.concat_tables([rows, pa.table([*empty, *tiles.columns], rows.column_names)])

    numbered = source.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    packed = numbered.mapInArrow(sets, f"bucket int, {of_row}, {of_keys}")
    return packed.groupBy("bucket").applyInArrow(match, f"{of_row}, least bigint, classes array<bigint>")


def _few(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be sent to every executor if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _links(source: DataFrame, rows: DataFrame, keyed: DataFrame, n: int, p: int, q: int) -> tuple[DataFrame, list[DataFrame]]:
    """``a, b``: links between rows, enough to connect every two that a chain of links connects; and the tables they read.

    Every table is removed as soon as its last reader is written, ``keyed`` too.
    """
    # one row per set: the first, which has keys; copies in other tasks add nothing but repeated pairs
    entered = rows.where("entered").select("row", "digest")
    again = entered.groupBy("digest").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    copies = stage(entered.join(again, "digest").where("row <> first").select("row"), "copies")
    # a tile is named by its least class here, which is a first: tiles with the same one are the same group
    shared = keyed.where("least IS NOT NULL").select(F.col("least").alias("key"), F.explode("classes").alias("class"))
    members = stage(_members(shared.join(_few(copies.withColumnRenamed("row", "class")), "class", "left_anti")), "members")
    drop(keyed, copies)

    of_rows = rows.select(F.col("row").alias("class"), "digest", "n", "id")
    bits = _class_sets(source, of_rows, members.select("class"), n, "bits")
    edges = stage(_crossing(members, bits, p, q), "edges")
    drop(members, bits)
    pairs = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    hashes = _class_sets(source, of_rows, pairs.select(F.explode(F.array("a", "b")).alias("class")), n, "hashes")
    found = stage(_exact(pairs, hashes, p, q), "found")
    failed = stage(pairs.join(found, ["a", "b"], "left_anti"), "failed")
    drop(pairs)
    if failed.isEmpty():
        return found, [found, failed, edges, hashes]
    named = connected_components(found)
    rest = _rest(_open_trees(edges, failed, named), hashes, p, q)
    return found.unionByName(rest), [found, failed, edges, hashes]


def _members(places: DataFrame) -> DataFrame:
    """``least, class`` of the groups of all shared tiles, from ``class, key``.

    A key names a tile or several with the same least class. A table of keys in memory, before the shuffle or sent to the
    executors, would grow with the input. Rows are sorted by key instead, which spills; those of shared tiles are made distinct.
    """
    tile = Window.partitionBy("key")
    named = places.select("class", "key", F.min("class").over(tile).alias("least"), F.max("class").over(tile).alias("most"))
    return named.where("least < most").select("least", "class").distinct()


def _class_sets(source: DataFrame, of_rows: DataFrame, classes: DataFrame, n: int, kind: str) -> DataFrame:
    """``class, n`` and ``bits`` or ``hashes`` (by ``kind``) of the given classes, from the texts of their ids; some may come twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in slices(batches, "text"):
            by_digest = {_digest(s): s for s in (shingle_set(t or "", n) for t in part.column("text").to_pylist())}
            by_digest = {d: s for d, s in by_digest.items() if d not in seen}
            if len(seen) > KEPT_DIGESTS:
                seen.clear()
            seen.update(by_digest)
            found = [(bitmap(s) if kind == "bits" else s).tobytes() for s in by_digest.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(by_digest), pa.binary()), pa.array(found, pa.binary())], ["digest", kind])

    wanted = stage(of_rows.join(classes.distinct(), "class", "left_semi").withColumnRenamed("id", "of"), "wanted")
    ids = stage(wanted.select("of").distinct(), "ids")
    texts = source.join(_few(ids), F.col("id").eqNullSafe(F.col("of")), "left_semi").select("text")
    found = texts.mapInArrow(run, f"digest binary, {kind} binary")
    sets = stage(found.join(wanted.select("class", "digest", "n"), "digest").drop("digest"), "class-sets")
    drop(wanted, ids)
    return sets


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _exact(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs ``a, b`` of classes whose sorted arrays share enough."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            keep = []
            for s, t in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                s, t = _u64(s), _u64(t)
                keep.append(bool(reaches(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), p, q)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("class").alias(c), F.col("hashes").alias(x)) for c, x in (("a", "x"), ("b", "y")))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(exact, "a bigint, b bigint")


def _crossing(members: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """``least, i, j, tree, a, b``: per group and chunk pair a forest over the pairs of classes that pass sizes and bit counts."""

    def compare(batch: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(batch.column("n")), kind="stable")
        ids, sizes, sides = (np.asarray(batch.column(c))[order] for c in ("class", "n", "side"))
        maps = [_u64(x) for x in batch.column("bits").to_pylist()]
        words = min(len(x) for x in maps)  # bits of a tile differ by a factor of two or four at most
        maps = np.stack([_folded(maps[i], words) for i in order])
        group = [batch.column(c)[0].as_py() for c in ("least", "i", "j")]
        tree, a, b = ids.copy(), [], []
        for i in range(len(ids) - 1):
            last = int(np.searchsorted(sizes, sizes[i] * q // p, side="right"))  # no larger set can link
            at = i + 1 + np.flatnonzero(tree[i + 1 : last] != tree[i])
            if group[1] != group[2]:
                at = at[sides[at] != sides[i]]
            if len(at):
                at = at[reaches(overlap_bound(maps[i][None, :], sizes[i], maps[at], sizes[at]), sizes[i], sizes[at], p, q)]
            if len(at):
                others, one = np.unique(tree[at], return_index=True)
                a += [i] * len(one)
                b += at[one].tolist()
                tree[np.isin(tree, others)] = tree[i]
        named = [pa.array([x] * len(a), kind) for x, kind in zip(group, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        return pa.table([*named, pa.array(tree[a]), pa.array(ids[a]), pa.array(ids[b])], ["least", "i", "j", "tree", "a", "b"])

    sizes = members.join(sets.select("class", "n").distinct(), "class")
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)), F.ceil(F.sum("n") / F.lit(CHUNK_ELEMENTS))).cast("int")
    dealt = members.join(sizes.groupBy("least").agg(chunks.alias("chunks")), "least")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("class"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("least", "class", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    return dealt.join(sets, "class").groupBy("least", "i", "j").applyInArrow(compare, "least bigint, i int, j int, tree bigint, a bigint, b bigint")


_TREE = ["least", "i", "j", "tree"]


def _open_trees(edges: DataFrame, failed: DataFrame, named: DataFrame) -> DataFrame:
    """The classes, with their components, of the trees that have an edge without a link and still hold several components.

    In the other trees the links connect all classes. Trees with the same classes ask the same question; one stays.
    """
    ends = edges.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")})
    broken = ends.join(failed.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_semi").select(*_TREE).distinct()
    classes = edges.join(broken, _TREE, "left_semi").select(*_TREE, F.explode(F.array("a", "b")).alias("class")).distinct()
    classes = classes.join(named.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    open_ = classes.groupBy(*_TREE).agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"),
        F.min("class").alias("first"), F.max("class").alias("most"), F.bit_xor(F.xxhash64("class")).alias("who"),
    ).where("low < high")
    one = open_.groupBy("size", "first", "most", "who").agg(F.min(F.struct(*_TREE)).alias("one")).select("one.*")
    return classes.join(one, _TREE, "left_semi")


def _rest(trees: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """A forest of the links between components of a tree."""

    def compare(batch: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(batch.column("n")), kind="stable")
        ids, parts, sizes = (np.asarray(batch.column(c))[order] for c in ("class", "component", "n"))
        parts, hashes = parts.copy(), batch.column("hashes").to_pylist()
        known, codes = np.unique(np.concatenate([_u64(hashes[i]) for i in order]), return_inverse=True)
        starts, own = np.concatenate(([0], np.cumsum(sizes))), np.zeros(len(known), dtype=bool)
        a, b = [], []
        for i in range(len(ids) - 1):
            last = int(np.searchsorted(sizes, sizes[i] * q // p, side="right"))
            if (parts[i + 1 : last] == parts[i]).all():
                continue
            mine = codes[starts[i] : starts[i + 1]]
            own[mine] = True
            shared = np.add.reduceat(own[codes[starts[i + 1] : starts[last]]], starts[i + 1 : last] - starts[i + 1], dtype=np.int64)
            own[mine] = False
            at = i + 1 + np.flatnonzero(reaches(shared, sizes[i], sizes[i + 1 : last], p, q) & (parts[i + 1 : last] != parts[i]))
            if len(at):
                others, one = np.unique(parts[at], return_index=True)
                a += [ids[i]] * len(one)
                b += ids[at[one]].tolist()
                parts[np.isin(parts, others)] = parts[i]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return trees.join(sets, "class").groupBy(*_TREE).applyInArrow(compare, "a bigint, b bigint")


def keep_one(docs: DataFrame, components: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id names their component: one document of each group.

    Rows without id stay only where their whole component has none.
    """
    gone = components.where((F.col("n_shingles") > 0) & ~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__gone"]), "left_anti")
