"""Operator 1: byte-pair encoding and decoding over a contiguous rank array.

A word starts as its bytes. Two rows are held for it: the ids of its parts and, for every boundary, the rank of the
merge that would delete that boundary. The lowest rank is searched, its boundary deleted, and the two neighbouring
ranks are looked up anew, until no boundary has a rank. Short words of one batch lie side by side as rows of one array
and take these steps together; longer words take them over a heap, which gives the same merges.

Cases: a null text counts as empty and has no tokens; ties of rank go to the leftmost boundary; every row is encoded
on its own, so repeated rows, rows without id and any number of other columns (which are not read) do no harm. The
strings of added tokens found in a text become their ids, as the public library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treeline.llm.pretokens import BYTE_LEVEL_PATTERN, byte_letters, find_words
from treeline.llm.tokens import PieceEncoder, slices

NO_RANK = np.int32(2**31 - 1)
SHORT = 32  # bytes of a word that takes the array path
TOGETHER = 4096  # words in one array


class RankArrayBpe:
    """Encoder and decoder of a byte-level vocabulary file in the public JSON layout."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = (np.array([vocab[p[i]] for p in pairs], dtype=np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.width = np.int64(max(vocab.values()) + 1)
        order = np.argsort(left * self.width + right, kind="stable")
        self.keys, self.ranks, self.made = (left * self.width + right)[order], order.astype(np.int32), made
        self.rank_of = dict(zip((left * self.width + right).tolist(), range(len(pairs)), strict=True))
        letters = byte_letters()
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
        back = {c: b for b, c in letters.items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.added = added
        self.added_pattern = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.token_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items() if t not in added}
        self.token_bytes.update({i: t.encode() for t, i in added.items()})
        self.words = PieceEncoder(self.encode_words, lambda text: [text])
        self.texts = PieceEncoder(self._encode_pieces, lambda text: [text])

    # -- ranks

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def _merge_rows(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """``ids``: one word per row, ``sizes``: its parts. Runs the rank array of all rows to the end."""
        n, width = ids.shape
        done: list[bytes] = [b""] * n
        columns = np.arange(width)
        ranks = np.full((n, width), NO_RANK, dtype=np.int32)
        ranks[:, :-1] = self._lookup(ids[:, :-1], ids[:, 1:])
        ranks[columns[None, :] >= sizes[:, None] - 1] = NO_RANK
        at = np.arange(n)
        while len(at):
            rows = np.arange(len(at))
            least = ranks.argmin(axis=1)
            rank = ranks[rows, least]
            over = rank == NO_RANK
            if over.any():
                for r in np.flatnonzero(over):
                    done[at[r]] = ids[r, : sizes[r]].astype("<u4").tobytes()
                keep = ~over
                ids, ranks, sizes, at, least, rank = ids[keep], ranks[keep], sizes[keep], at[keep], least[keep], rank[keep]
                rows = np.arange(len(at))
                if not len(at):
                    break
            ids[rows, least] = self.made[rank]
            after = columns[None, :] > least[:, None]
            source = np.minimum(columns[None, :] + after, width - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(columns[None, :] + (columns[None, :] >= least[:, None]), width - 1), axis=1)
            ranks[:, -1] = NO_RANK
            sizes = sizes - 1
            has_right = least < sizes - 1
            ranks[rows, least] = np.where(has_right, self._lookup(ids[rows, least], ids[rows, np.minimum(least + 1, width - 1)]), NO_RANK)
            has_left = least > 0
            l = rows[has_left]
            ranks[l, least[has_left] - 1] = self._lookup(ids[l, least[has_left] - 1], ids[l, least[has_left]])
        return done

    def _merge_long(self, word: bytes) -> bytes:
        """One word of any length: boundaries in a heap by (rank, place), neighbours in two linked rows."""
        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        n, width, rank_of = len(ids), int(self.width), self.rank_of
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of.get(ids[i] * width + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.made[rank]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := rank_of.get(ids[i] * width + ids[after[j]])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[after[j]]))
            if before[i] >= 0 and (r := rank_of.get(ids[before[i]] * width + ids[i])) is not None:
                heapq.heappush(heap, (r, before[i], ids[before[i]], ids[i]))
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    # -- encoding

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that the pattern cuts no further."""
        raw = [w.encode("utf-8", "replace") for w in words]
        out: list[bytes] = [b""] * len(raw)
        short = sorted((i for i, w in enumerate(raw) if 0 < len(w) <= SHORT), key=lambda i: len(raw[i]))
        for start in range(0, len(short), TOGETHER):
            group = short[start : start + TOGETHER]
            width = len(raw[group[-1]])
            table = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in group), dtype=np.uint8).reshape(len(group), width)
            sizes = np.array([len(raw[i]) for i in group])
            for i, ids in zip(group, self._merge_rows(self.byte_ids[table], sizes), strict=True):
                out[i] = ids
        for i, w in enumerate(raw):
            if len(w) > SHORT:
                out[i] = self._merge_long(w)
        return out

    def _cut(self, text: str) -> list[str | int]:
        """Words of a text in order, and ids where an added token stands."""
        if self.added_pattern is None or not any(t in text for t in self.added):
            return find_words(BYTE_LEVEL_PATTERN, text)
        out: list[str | int] = []
        for part in self.added_pattern.split(text):
            out += [self.added[part]] if part in self.added else find_words(BYTE_LEVEL_PATTERN, part)
        return out

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        cuts = [self._cut(p) for p in pieces]
        words = list({w for c in cuts for w in c if isinstance(w, str)})
        ids = dict(zip(words, self.encode_words(words), strict=True))
        return [b"".join(ids[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in c) for c in cuts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        return self.texts.encode(texts)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become the replacement character, unknown ids nothing."""
        get = self.token_bytes.get
        return b"".join([get(i, b"") for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


@cache
def rank_array_bpe(path: str) -> RankArrayBpe:
    """One coder per worker process and vocabulary."""
    return RankArrayBpe(path)


def _plain(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids array<int>`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_array_bpe(vocabulary)
        for part in slices(batches, text_col):
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in coder.encode(_plain(part, text_col))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    frame = docs.select(id_col, text_col)
    return frame.mapInArrow(run, f"{id_col} {frame.schema[id_col].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` of every row of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_array_bpe(vocabulary)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    frame = encoded.select(id_col, ids_col)
    return frame.mapInArrow(run, f"{id_col} {frame.schema[id_col].dataType.simpleString()}, text string")


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text; returns counts and digests instead of ids, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_array_bpe(vocabulary)
        for part in slices(batches, text_col):
            ids = coder.encode(_plain(part, text_col))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(coder.decode(x).encode("utf-8")).hexdigest() for x in ids]),
                ],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    frame = docs.select(id_col, text_col)
    kind = frame.schema[id_col].dataType.simpleString()
    return frame.mapInArrow(run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
