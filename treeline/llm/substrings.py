"""Operator 6: removal of repeated word sequences over fixed-block anchors.

Every document is cut into blocks of half a window that don't overlap; their hashes are the index. Every rolling run
of the same length, of every document, probes it. A window that stands twice holds a whole block where it stands
first, so no repeat is missed. A hit that another place shares is an anchor: the windows around it are the candidates
for its extension, and exact windows are compared only there. Of equal windows the one that starts first stays; the
words covered by the others go, so overlapping windows extend to maximal repeats.

What travels. Probes leave a task packed: per chunk of texts and per bucket of hashes one row with 4 bytes and a place
per distinct run, so a passage that stands in a third of all documents is a single probe of a chunk. A row names only
the documents it has probes of, so the bytes per probe are bounded whatever the number of buckets. A bucket sees all
probes of its hashes; the number of buckets follows the size of the corpus. Hits go back to their documents, and only
documents with hits are compared by windows (64-bit hashes within buckets chosen by another hash). Texts are shuffled
once, plus those with hits a second time.

Cases: null and empty texts have no words; texts shorter than a window are left alone; repeated ids and ids that are no
integers are put in order once (equal ids in order of their texts), null ids first; only the named columns are read,
and ``carry`` may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.hashing import ODD, run_hashes, word_hashes
from treeline.llm.staging import stage
from treeline.llm.tokens import slices

BUCKET_CHARS = 16 << 20  # characters of text per bucket of probes
LEAST_BUCKETS = 64
CHUNK_CHARS = 2 << 20
BROADCAST_ROWS = 2_000_000  # numbers of documents with hits that may be sent to every executor
_PROBES = "bucket int, uids binary, starts binary, places binary, wide binary, keys binary, more binary"


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _pack_places(places: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending places as gaps of 1, 2 or 4 bytes, whichever is least; gaps beyond that are kept apart as (row, gap)."""
    gaps = np.diff(places, prepend=0)
    width = min((1, 2, 4), key=lambda w: len(gaps) * w + 8 * np.count_nonzero(gaps >= 1 << 8 * w))
    wide = np.flatnonzero(gaps >= 1 << 8 * width)
    return gaps.astype(f"<u{width}").tobytes(), bytes([width]) + np.stack([wide, gaps[wide]]).astype("<i8" if width == 4 else "<i4").tobytes()


def _unpack_places(places: bytes, wide: bytes) -> np.ndarray:
    width = wide[0]
    gaps = np.frombuffer(places, dtype=f"<u{width}").astype(np.int64)
    rows, values = np.frombuffer(wide[1:], dtype="<i8" if width == 4 else "<i4").reshape(2, -1)
    gaps[rows] = values
    return np.cumsum(gaps)


def _rows_by_bucket(buckets: np.ndarray, places: np.ndarray, keys: np.ndarray, more_buckets: np.ndarray, more: np.ndarray, uids: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """One row per bucket of a chunk, with the documents that have places in it.

    ``more`` are places that repeat an earlier place of the chunk; every bucket of one also has that earlier place.
    """
    order = np.lexsort((places, buckets))
    buckets, places, keys = buckets[order], places[order], keys[order]
    order = np.lexsort((more, more_buckets))
    more_buckets, more = more_buckets[order], more[order].astype("<u4")
    own = np.unique(buckets)
    at, end = np.searchsorted(buckets, own), np.searchsorted(buckets, own, side="right")
    more_at, more_end = np.searchsorted(more_buckets, own), np.searchsorted(more_buckets, own, side="right")
    packed = [_pack_places(places[i:j]) for i, j in zip(at, end, strict=True)]
    named = np.unique(
        np.concatenate([
            np.searchsorted(own, buckets) * len(uids) + np.searchsorted(starts, places, side="right") - 1,
            np.searchsorted(own, more_buckets) * len(uids) + np.searchsorted(starts, more, side="right") - 1,
        ])
    )  # (bucket, document), in the order of both
    ends = np.searchsorted(named, np.arange(1, len(own) + 1) * len(uids))
    row_uids, row_starts = uids[named % len(uids)].astype("<i8"), starts[named % len(uids)].astype("<u4")
    documents = list(zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True))
    binary = pa.binary()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(own.astype(np.int32)),
            pa.array([row_uids[i:j].tobytes() for i, j in documents], binary),
            pa.array([row_starts[i:j].tobytes() for i, j in documents], binary),
            pa.array([x[0] for x in packed], binary),
            pa.array([x[1] for x in packed], binary),
            pa.array([keys[i:j].tobytes() for i, j in zip(at, end, strict=True)], binary),
            pa.array([more[i:j].tobytes() for i, j in zip(more_at, more_end, strict=True)], binary),
        ],
        [f.split()[0] for f in _PROBES.split(", ")],
    )


def _by_document(uids: np.ndarray, places: np.ndarray, names: list[str]) -> pa.Table:
    """``uid, list of places`` from parallel arrays."""
    order = np.lexsort((places, uids))
    uids, places = uids[order], places[order].astype(np.int32)
    own, at = np.unique(uids, return_index=True)
    offsets = np.append(at, len(uids)).astype(np.int32)
    return pa.table([pa.array(own.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(places))], names)


def _documents_of(row_uids: bytes, row_starts: bytes, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and places inside their documents of places in a chunk, all of documents that the row names."""
    uids, starts = np.frombuffer(row_uids, dtype="<i8"), np.frombuffer(row_starts, dtype="<u4").astype(np.int64)
    at = np.searchsorted(starts, places, side="right") - 1
    return uids[at], places - starts[at]


def _chunk(texts: list[str | None], least: int) -> tuple[list[np.ndarray], list[int]]:
    """Word hashes of the texts that have at least ``least`` words, and their rows."""
    out, rows = [], []
    for row, text in enumerate(texts):
        words = _words(text)
        if len(words) >= least:
            out.append(word_hashes(words))
            rows.append(row)
    return out, rows


def _with_uid(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str]) -> tuple[DataFrame, int]:
    """``uid, id, text, rest`` with a unique integer per row in the order of ids, and the characters of all texts."""
    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("struct<x:int>")
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), rest.alias("rest"))
    whole = named.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    ids = named.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    seen = ids.agg(F.max("n"), F.max(F.col("id").isNull()), F.sum("chars")).first()
    if whole and (seen[0] or 0) <= 1 and not seen[1]:
        return named.select(F.col("id").cast("bigint").alias("uid"), "id", "text", "rest"), int(seen[2] or 0)
    ordered = named.repartitionByRange(F.col("id"), F.col("text")).sortWithinPartitions("id", "text")
    return stage(ordered.select(F.monotonically_increasing_id().alias("uid"), "id", "text", "rest"), "numbered"), int(seen[2] or 0)


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), with_text: bool = True) -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256`` of every row, with ``text`` and the ``carry`` columns if asked.

    ``text`` is the text itself where nothing is removed, else the words that stay, joined by one space.
    """
    if window < 2 or window % 2:
        raise ValueError("a window is an even number of words")
    source, chars = _with_uid(docs, id_col, text_col, carry)
    buckets = max(LEAST_BUCKETS, -(-chars // BUCKET_CHARS))
    hits = stage(_anchors(source, window, buckets), "hits")
    found = hits.select("uid")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    kind = {f.name: f.dataType.simpleString() for f in source.schema}

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, sha = [], []
            for text in part.column("text").to_pylist():
                words = _words(text)
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            texts = part.column("text") if with_text else pa.nulls(part.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([part.column("id"), texts, part.column("rest"), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["id", "text", "rest", "n_words", "kept_sha256"])

    alone = source.join(found, "uid", "left_anti").select("id", "text", "rest").mapInArrow(first, f"id {kind['id']}, text string, rest {kind['rest']}, n_words bigint, kept_sha256 string")
    alone = alone.select("id", "text", "rest", "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept_sha256")
    anchored = stage(source.join(found, "uid", "left_semi").join(hits, "uid").select("uid", "id", "text", "rest", "hits"), "anchored")
    later = _later_windows(anchored.select("uid", "text", "hits"), window, buckets)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts, n, removed, sha = [], [], [], []
            for text, starts in zip(part.column("text").to_pylist(), part.column("later").to_pylist(), strict=True):
                words = _words(text)
                n.append(len(words))
                if starts:
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                    starts = np.array(starts)
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + window, -1)
                    stays = np.cumsum(edges[:-1]) == 0
                    kept = b" ".join([w for w, s in zip(words, stays.tolist(), strict=True) if s])
                    removed.append(int(len(words) - stays.sum()))
                    texts.append(kept.decode() if with_text else None)
                else:
                    kept = b" ".join(words)
                    removed.append(0)
                    texts.append(text if with_text else None)
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(texts, pa.string()), part.column("rest"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                ["id", "text", "rest", "n_words", "n_removed", "kept_sha256"],
            )

    changed = anchored.drop("hits").join(later, "uid", "left").mapInArrow(second, f"id {kind['id']}, text string, rest {kind['rest']}, n_words bigint, n_removed bigint, kept_sha256 string")
    out = alone.unionByName(changed)
    extra = ([F.col("text")] if with_text else []) + [F.col("rest")[c].alias(c) for c in carry]
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *extra)


def _anchors(source: DataFrame, window: int, buckets: int) -> DataFrame:
    """``uid, hits``: where a run of half a window equals an indexed block and stands in another place too."""
    half = window // 2

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", CHUNK_CHARS):
            hashes, rows = _chunk(part.column("text").to_pylist(), window)
            if not rows:
                continue
            sizes = np.array([len(h) for h in hashes])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            uids = np.asarray(part.column("uid"))[rows]
            runs = np.concatenate([run_hashes(h, half) for h in hashes])
            inside = np.concatenate([np.arange(s - half + 1) for s in sizes])
            places = np.repeat(starts, sizes - half + 1) + inside
            values, at, number = np.unique(runs, return_index=True, return_inverse=True)
            block = np.zeros(len(values), dtype=bool)
            block[number[inside % half == 0]] = True
            later = np.ones(len(runs), dtype=bool)
            later[at] = False
            many = np.zeros(len(values), dtype=bool)
            many[number[later]] = True  # in this chunk it already stands twice
            bucket = ((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            key = ((values & np.uint64(0x3FFFFFFF)) << np.uint64(2)) | (many.astype(np.uint64) << np.uint64(1)) | block.astype(np.uint64)
            yield _rows_by_bucket(bucket, places[at], key.astype("<u4"), bucket[number[later]], places[later], uids, starts)

    def match(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in ("uids", "starts", "places", "wide", "keys", "more")}
        keys = [np.frombuffer(k, dtype="<u4") for k in cols["keys"]]
        sizes = [len(k) for k in keys]
        every = np.concatenate(keys)
        values, number, count = np.unique(every >> 2, return_inverse=True, return_counts=True)
        block = np.zeros(len(values), dtype=bool)
        block[number[(every & 1) == 1]] = True
        count[number[(every & 2) == 2]] += 1
        hit = (block & (count > 1))[number]
        uids, places = [], []
        for i, own in enumerate(np.split(hit, np.cumsum(sizes)[:-1])):
            found = [_unpack_places(cols["places"][i], cols["wide"][i])[own]] if own.any() else []
            if cols["more"][i]:
                found.append(np.frombuffer(cols["more"][i], dtype="<u4").astype(np.int64))
            if found:
                u, p = _documents_of(cols["uids"][i], cols["starts"][i], np.concatenate(found))
                uids.append(u)
                places.append(p)
        empty = np.empty(0, dtype=np.int64)
        return _by_document(np.concatenate([empty, *uids]), np.concatenate([empty, *places]), ["uid", "hits"])

    probes = source.select("uid", "text").mapInArrow(probe, _PROBES)
    hits = probes.groupBy("bucket").applyInArrow(match, "uid bigint, hits array<int>")
    return hits.groupBy("uid").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def _later_windows(anchored: DataFrame, window: int, buckets: int) -> DataFrame:
    """``uid, later``: starts of the windows around anchors that equal a window that starts earlier."""
    half = window // 2

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", CHUNK_CHARS):
            part = part.take(pa.compute.sort_indices(part.column("uid")))
            hashes, rows = _chunk(part.column("text").to_pylist(), window)
            if not rows:
                continue
            sizes = np.array([len(h) for h in hashes])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            uids, hits = np.asarray(part.column("uid"))[rows], part.column("hits")
            values, others, places = [], [], []
            for h, row, start in zip(hashes, rows, starts.tolist(), strict=True):
                edges = np.zeros(len(h) + 1, dtype=np.int64)
                at = np.asarray(hits[row].values, dtype=np.int64)
                np.add.at(edges, np.maximum(at - (window - half), 0), 1)
                np.add.at(edges, at + 1, -1)
                open_ = np.flatnonzero(np.cumsum(edges[: len(h) - window + 1]) > 0)
                values.append(run_hashes(h, window)[open_])
                others.append(run_hashes(h, window, ODD[1])[open_])
                places.append(start + open_)
            value, other, place = np.concatenate(values), np.concatenate(others), np.concatenate(places)
            bucket = ((other >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.lexsort((place, value, bucket))
            same = (np.diff(bucket[order]) == 0) & (np.diff(value[order]) == 0)
            first = np.concatenate(([True], ~same))
            yield _rows_by_bucket(bucket[order][first], place[order][first], value[order][first], bucket[order][~first], place[order][~first], uids, starts)

    def compare(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in ("uids", "starts", "places", "wide", "keys", "more")}
        uids, places, more_uids, more_places = [], [], [], []
        for i in range(table.num_rows):
            u, p = _documents_of(cols["uids"][i], cols["starts"][i], _unpack_places(cols["places"][i], cols["wide"][i]))
            uids.append(u)
            places.append(p)
            u, p = _documents_of(cols["uids"][i], cols["starts"][i], np.frombuffer(cols["more"][i], dtype="<u4").astype(np.int64))
            more_uids.append(u)
            more_places.append(p)
        value = np.concatenate([np.frombuffer(k, dtype=np.uint64) for k in cols["keys"]])
        uid, place = np.concatenate(uids), np.concatenate(places)
        order = np.lexsort((place, uid, value))
        later = order[1:][np.diff(value[order]) == 0]
        return _by_document(np.concatenate([uid[later], *more_uids]), np.concatenate([place[later], *more_places]), ["uid", "later"])

    packed = anchored.mapInArrow(windows, _PROBES)
    later = packed.groupBy("bucket").applyInArrow(compare, "uid bigint, later array<int>")
    return later.groupBy("uid").agg(F.flatten(F.collect_list("later")).alias("later"))
