"""Encoding by pieces: texts are cut where no token can cross, and each distinct piece is encoded once per worker.

A piece is a run up to the next space, with its leading space, or one newline. Both vocabularies used here cut there
too, so the ids of a text are the ids of its pieces in order. Texts where that is not certain (two white-space
characters in a row, white space other than space and newline) are encoded whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from treeline.llm.pretokens import OTHER_SPACE, as_letters, cutter

ASCII_SPACE = OTHER_SPACE[:4]
#: Characters of text encoded together, and pieces kept per generation of a worker's cache (about 60 MB).
SLICE_CHARS = 1 << 20
KEPT_PIECES = 250_000
KEPT_WORDS = 125_000
KEPT_BY_LIBRARY = 400_000  # pieces, of the encoder over the library
COLLECT_AFTER = 200_000  # new objects; lists of pieces live short and hold no cycles
LONGEST_KEPT = 48


class PieceEncoder:
    """Texts to ids (little-endian unsigned 32-bit) through a cache of pieces.

    ``encode_pieces`` turns a list of distinct pieces into a list of such byte strings; ``whole`` cuts an odd text
    into pieces that are safe to encode alone (by default the text itself).
    """

    def __init__(self, encode_pieces: Callable[[list[str]], list[bytes]], whole: Callable[[str], list[str]] | None = None):
        self.encode_pieces, self.whole = encode_pieces, whole or (lambda text: [text])
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if not text:
            return []
        if "\0" in text or any(c in text for c in (ASCII_SPACE if text.isascii() else OTHER_SPACE)):
            return self.whole(text)
        cut = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        if cut[-1] == "":
            cut.pop()
        return self.whole(text) if "" in cut or " " in cut else cut

    def encode(self, texts: list[str]) -> list[bytes]:
        lists = [self.pieces(t) for t in texts]
        need = set().union(*lists) - self.new.keys()
        if need:
            fresh = []
            for piece in need:
                if (ids := self.old.get(piece)) is None:
                    fresh.append(piece)
                else:
                    self.new[piece] = ids
            self.new.update(zip(fresh, self.encode_pieces(fresh), strict=True))
        get = self.new.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in lists]
        for piece in need:
            if len(piece) > LONGEST_KEPT:
                del self.new[piece]
        if len(self.new) > KEPT_PIECES:
            self.old, self.new = self.new, {"": b""}
        return out


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most`` characters of ``text``, and at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(text).cast(pa.large_string()).fill_null("")
        ends = np.cumsum(np.asarray(pa.compute.binary_length(sizes), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class _Kept(dict):
    """Ids by string, made when missing; two generations of at most ``most`` short strings are kept."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


class _Packed(dict):
    """Ids of so many tokens to bytes."""

    def __missing__(self, n: int) -> Callable[..., bytes]:
        pack = struct.Struct(f"<{n}I").pack
        if n < 64:
            self[n] = pack
        return pack


PACKED = _Packed()


class LibraryEncoder(PieceEncoder):
    """Over the ``tokenizers`` library: a new piece is cut into words as the vocabulary file says, and the library's
    model encodes new words.

    Pieces with the string of an added token, and all pieces of a file of an unknown kind, go through the whole library.
    """

    def __init__(self, library, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library, self.cut, self.tokenize = library, cutter(spec), library.model.tokenize
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or ()]
        self.added = re.compile("|".join(added)).search if added else lambda piece: None
        self.marks = tuple({t["content"][0] for t in spec.get("added_tokens") or () if t["content"]})
        self.words, self.kept = _Kept(self._word, KEPT_WORDS), _Kept(self._piece, KEPT_BY_LIBRARY)
        self.whole = lambda text: [text]

    def _word(self, word: str) -> bytes:
        found = self.tokenize(as_letters(word))
        return PACKED[len(found)](*[t.id for t in found])

    def _piece(self, piece: str) -> bytes:
        if self.cut is None or (any(m in piece for m in self.marks) and self.added(piece)):
            ids = self.library.encode(piece, add_special_tokens=False).ids
            return PACKED[len(ids)](*ids)
        words = self.cut(piece)
        return self._word(words[0]) if len(words) == 1 else b"".join([self.words[w] for w in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.kept.__getitem__
        return [b"".join(map(get, self.pieces(t))) for t in texts]


_LIBRARY: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """One encoder per worker process over the ``tokenizers`` library and the vocabulary at ``path``.

    Special tokens are not added; padding and truncation are off.
    """
    if path not in _LIBRARY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_padding()
        library.no_truncation()
        gc.set_threshold(COLLECT_AFTER)

        _LIBRARY[path] = LibraryEncoder(library, path)
    return _LIBRARY[path]
