"""Operator 12: byte-level BPE over length-bucketed, padded matrices of words.

A text is cut into words by a pattern and every distinct new word of a slice is encoded once. A word that is itself a
token is done. The others become rows of bytes, grouped into matrices by length and padded. In each round every row of
a matrix merges its leftmost pair of least rank: the ranks of all pairs come from one hash table of (left, right), the
row minimum gives the place, and the row is compacted by one. Rows without a pair left over leave the matrix.

Words above ``LONG`` bytes are rows of their own. There a round merges all places of the least rank, left to right,
if no pair that this makes has a lower rank still; then the single steps would have taken the same places one after
another. Otherwise the round takes the leftmost place only. So a word of a million letters costs as many rounds as it
has distinct ranks, not as many as it has letters.

Cases: a null text counts as empty and has no tokens; every row is encoded on its own, so repeated rows, rows without
id and other columns (which are not read) do no harm; strings of special tokens are ordinary text; an empty table gives
no rows. Decoding gives bytes, which need not be UTF-8; an id without a token raises.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treeline.llm.hashing import mix
from treeline.llm.pretokens import BYTE_LEVEL_PATTERN, find_words
from treeline.llm.tokens import slices

NO_RANK = np.int32(2**31 - 1)
LONG = 64  # bytes of the longest word that shares a matrix
CELLS = 1 << 20  # of one matrix
KEPT_WORDS = 200_000  # per generation of a worker's memory
LONGEST_KEPT = 48  # characters of a word that is kept


class PairTable:
    """Token made of (left, right), by open addressing in two numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.made = np.full(1 << bits, NO_RANK, dtype=np.int32)
        self.reach = 0
        todo, slots = np.arange(len(keys)), mix(keys) & self.mask
        while len(todo):
            free = self.keys[slots] == np.iinfo(np.uint64).max
            taken, first = np.unique(slots[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[taken], self.made[taken] = keys[todo[won]], made[todo[won]]
            lost = np.ones(len(todo), dtype=bool)
            lost[won] = False
            todo, slots = todo[lost], (slots[lost] + np.uint64(1)) & self.mask
            self.reach += 1

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token of each pair, which is also its rank; ``NO_RANK`` where there is none."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = mix(key) & self.mask
        out, todo = np.full(key.shape, NO_RANK, dtype=np.int32), np.arange(key.size)
        key, slot, flat = key.ravel(), slot.ravel(), out.ravel()
        for _ in range(self.reach):
            seen = self.keys[slot]
            hit = seen == key
            flat[todo[hit]] = self.made[slot[hit]]
            go = ~hit & (seen != np.iinfo(np.uint64).max)
            if not go.any():
                break
            todo, key, slot = todo[go], key[go], (slot[go] + np.uint64(1)) & self.mask
        return flat.reshape(out.shape)


class MatrixBpe:
    """Encoder and decoder over a file of ranks: base64 of a token and its rank on each line."""

    def __init__(self, path: str, pattern: str = BYTE_LEVEL_PATTERN):
        with open(path, "rb") as f:
            self.rank_of = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = pattern
        self.token_of = {r: t for t, r in self.rank_of.items()}
        self.byte_ids = np.array([self.rank_of[bytes([b])] for b in range(256)], dtype=np.int32)
        get, splits = self.rank_of.get, []
        for token, rank in self.rank_of.items():
            for i in range(1, len(token)):
                a = get(token[:i])
                if a is not None and (b := get(token[i:])) is not None:
                    splits.append((a, b, rank))
        self.table = PairTable(*np.array(splits, dtype=np.int64).reshape(-1, 3).T)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    # -- merging

    def _merge_rows(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Words of about the same length as rows of ``ids``; ``sizes`` are their bytes, the rest is padding."""
        n, width = ids.shape
        done, at, columns = [b""] * n, np.arange(n), np.arange(width)
        ranks = np.full((n, width), NO_RANK, dtype=np.int32)
        ranks[:, :-1] = self.table.find(ids[:, :-1], ids[:, 1:])
        ranks[columns >= sizes[:, None] - 1] = NO_RANK
        while len(at):
            rows, least = np.arange(len(at)), ranks.argmin(axis=1)
            go = ranks[rows, least] != NO_RANK
            if not go.all():
                for r in np.flatnonzero(~go):
                    done[at[r]] = ids[r, : sizes[r]].astype("<u4").tobytes()
                # rows that go on, without the columns that none of them needs
                width = int(sizes[go].max(initial=1))
                ids, ranks, sizes, at, least = ids[go, :width], ranks[go, :width], sizes[go], at[go], least[go]
                rows, columns = np.arange(len(at)), columns[:width]
                if not len(at):
                    break
            ids[rows, least] = ranks[rows, least]
            later = columns >= least[:, None]
            ids = np.take_along_axis(ids, np.minimum(columns + (columns > least[:, None]), width - 1), axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(columns + later, width - 1), axis=1)
            sizes = sizes - 1
            ranks[columns >= sizes[:, None] - 1] = NO_RANK
            right = rows[least < sizes - 1]
            ranks[right, least[right]] = self.table.find(ids[right, least[right]], ids[right, least[right] + 1])
            left = rows[least > 0]
            ranks[left, least[left] - 1] = self.table.find(ids[left, least[left] - 1], ids[left, least[left]])
        return done

    def _merge_long(self, word: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)]
        ranks = self.table.find(ids[:-1], ids[1:])
        while len(ranks) and (rank := ranks.min()) != NO_RANK:
            places = np.flatnonzero(ranks == rank)
            # places side by side overlap: of each run every second one is taken, from the left
            starts = np.flatnonzero(np.diff(places, prepend=-2) != 1)
            run = np.repeat(starts, np.diff(starts, append=len(places)))
            places = places[(np.arange(len(places)) - run) % 2 == 0]
            after, new = self._merged(ids, ranks, places, rank)
            if len(places) > 1 and new.min(initial=NO_RANK) < rank:
                after, _ = self._merged(ids, ranks, places[:1], rank)
            ids, ranks = after
        return ids.astype("<u4").tobytes()

    def _merged(self, ids: np.ndarray, ranks: np.ndarray, places: np.ndarray, rank: np.int32) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """``ids`` and their ranks with the pairs at ``places`` merged, and the ranks that this made."""
        keep = np.ones(len(ids), dtype=bool)
        keep[places + 1] = False
        out = np.where(np.isin(np.arange(len(ids)), places), rank, ids)[keep] if len(places) > 1 else ids[keep]
        now = places - np.arange(len(places))
        out[now] = rank
        fresh = np.full(len(out) - 1, NO_RANK, dtype=np.int32)
        # the rank at a part belongs to the pair it opens; a merged part opens a new one, as does the part before it
        fresh[:] = np.append(ranks, NO_RANK)[keep][:-1]
        touched = np.unique(np.concatenate([now, now - 1]))
        touched = touched[(touched >= 0) & (touched < len(fresh))]
        fresh[touched] = self.table.find(out[touched], out[touched + 1])
        return (out, fresh), fresh[touched]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of words that the pattern cuts no further."""
        raw = [w.encode("utf-8", "replace") for w in words]
        out: list[bytes] = [b""] * len(raw)
        rows = []
        for i, w in enumerate(raw):
            if (rank := self.rank_of.get(w)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(w) > LONG:
                out[i] = self._merge_long(w)
            elif w:
                rows.append(i)
        rows.sort(key=lambda i: len(raw[i]))
        start = 0
        while start < len(rows):
            # a bucket: words of at most a quarter more bytes than the shortest one
            widest, stop = len(raw[rows[start]]) * 5 // 4, start
            while stop < len(rows) and len(raw[rows[stop]]) <= widest and (stop - start) * widest < CELLS:
                stop += 1
            group = [raw[i] for i in rows[start:stop]]
            width = len(group[-1])
            table = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in group]), dtype=np.uint8).reshape(len(group), width)
            for i, ids in zip(rows[start:stop], self._merge_rows(self.byte_ids[table], np.array([len(w) for w in group])), strict=True):
                out[i] = ids
            start = stop
        return out

    # -- texts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        cuts = [find_words(self.pattern, t) if t else [] for t in texts]
        need = set().union(*cuts) - self.new.keys()
        fresh = []
        for word in need:
            if (ids := self.old.get(word)) is None:
                fresh.append(word)
            else:
                self.new[word] = ids
        self.new.update(zip(fresh, self.encode_words(fresh), strict=True))
        get = self.new.__getitem__
        out = [b"".join(map(get, cut)) for cut in cuts]
        for word in need:
            if len(word) > LONGEST_KEPT:
                del self.new[word]
        if len(self.new) > KEPT_WORDS:
            self.old, self.new = self.new, {}
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; an id that no token has raises."""
        return b"".join(map(self.token_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@cache
def matrix_bpe(path: str, pattern: str = BYTE_LEVEL_PATTERN) -> MatrixBpe:
    """One coder per worker process, file and pattern."""
    return MatrixBpe(path, pattern)


def byte_encode(docs: DataFrame, ranks: str, pattern: str = BYTE_LEVEL_PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids array<int>`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = matrix_bpe(ranks, pattern)
        for part in slices(batches, text_col):
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in coder.encode([t or "" for t in part.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    frame = docs.select(id_col, text_col)
    return frame.mapInArrow(run, f"{id_col} {frame.schema[id_col].dataType.simpleString()}, ids array<int>")


def byte_decode(encoded: DataFrame, ranks: str, pattern: str = BYTE_LEVEL_PATTERN, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``bytes binary`` of every row of ids; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = matrix_bpe(ranks, pattern)
        for batch in batches:
            found = [coder.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], [id_col, "bytes"])

    frame = encoded.select(id_col, ids_col)
    return frame.mapInArrow(run, f"{id_col} {frame.schema[id_col].dataType.simpleString()}, bytes binary")


def byte_round_trip(docs: DataFrame, ranks: str, pattern: str = BYTE_LEVEL_PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text; counts and digests instead of ids, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = matrix_bpe(ranks, pattern)
        for part in slices(batches, text_col):
            ids = coder.encode([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    frame = docs.select(id_col, text_col)
    kind = frame.schema[id_col].dataType.simpleString()
    return frame.mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
