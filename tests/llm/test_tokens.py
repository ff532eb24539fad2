"""Operators 1, 9 and 10: ids equal the library's, files come back whole, sequences are gapless."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import ODD_ROWS
from treeline.llm import bpe, packing, records
from treeline.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY
from treeline.llm.tokens import library_encoder
from treeline.session import scratch_path

BYTES, WORD = Tokenizer.from_file(BYTE_VOCABULARY), Tokenizer.from_file(WORD_VOCABULARY)
CODER = bpe.RankArrayBpe(BYTE_VOCABULARY)
PIECES = ["<|endoftext|>", "<|startoftext|>", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", "　", "​", "'s", "'S", "'ll", "a", "B", "é", "é",
          "ß", "İ", "Σ", "ς", "²", "½", "Ⅷ", "٣", "漢字", "\U0001f642", "!", "...", "_", "foo", "12", "\r\n", "\xa0", "\0", " the"]


def ids(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=6), max_size=12).map("".join))
def test_ids_equal_the_library(text):
    assert CODER.encode([text])[0] == ids(BYTES, text)
    assert CODER.decode(ids(BYTES, text)) == BYTES.decode(BYTES.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)
    assert library_encoder(BYTE_VOCABULARY).encode([text])[0] == ids(BYTES, text)
    assert library_encoder(WORD_VOCABULARY).encode([text])[0] == ids(WORD, text)


def test_broken_bytes_decode_like_the_library():
    r = random.Random(3)
    for _ in range(200):
        some = [r.randrange(50257) for _ in range(r.randrange(8))]
        assert CODER.decode(np.array(some, dtype="<u4").tobytes()) == BYTES.decode(some, skip_special_tokens=False)


def test_long_words_take_the_same_merges():
    r = random.Random(4)
    for n in (31, 32, 33, 200, 3000):
        word = "".join(r.choice("abcdehilnorst") for _ in range(n))
        assert CODER._merge_long(word.encode()) == ids(BYTES, word)
        assert CODER.encode_words([word])[0] == ids(BYTES, word)


def test_round_trip(odd, empty):
    got = Counter(tuple(r) for r in bpe.bpe_round_trip(odd, BYTE_VOCABULARY).collect())
    want = Counter((i, len(ids(BYTES, t)) // 4, hashlib.sha256(ids(BYTES, t)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD_ROWS)
    assert got == want
    assert bpe.bpe_round_trip(empty, BYTE_VOCABULARY).count() == 0


def test_encode_and_decode_frames(odd):
    back = bpe.bpe_decode(bpe.bpe_encode(odd, BYTE_VOCABULARY), BYTE_VOCABULARY)
    assert Counter(tuple(r) for r in back.collect()) == Counter((i, t or "") for i, t in ODD_ROWS)


def test_records(spark, odd, empty):
    folder = scratch_path(spark, "records")
    records.write_records(odd, folder, BYTE_VOCABULARY, end_id=2)
    index = records.write_index(spark, folder)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_crc32, r.start) for r in records.with_start(index).collect()), key=lambda r: r[3])
    assert [-1 if r[0] is None else r[0] for r in got] == sorted(-1 if i is None else i for i, _ in ODD_ROWS)
    assert [r[3] for r in got] == np.cumsum([0] + [r[1] for r in got[:-1]]).tolist()
    end = np.array([2], dtype="<u4").tobytes()
    want = Counter((i, zlib.crc32(ids(BYTES, t) + end)) for i, t in ODD_ROWS)
    assert Counter((r[0], r[2]) for r in got) == want
    for frame in (records.read_records(spark, folder), records.read_at(spark, folder, index.orderBy("ids_crc32"))):
        assert Counter((r.doc_id, zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())) for r in frame.collect()) == want
    nothing = scratch_path(spark, "records")
    records.write_records(empty, nothing, BYTE_VOCABULARY, end_id=2)
    assert records.with_start(records.write_index(spark, nothing)).count() == 0


def test_many_files_and_splits(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat(concat('word ', id, ' '), 50) AS text")
    folder = scratch_path(spark, "records")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        records.write_records(docs.repartition(7), folder, BYTE_VOCABULARY, end_id=2)
        got = records.with_start(records.write_index(spark, folder)).orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.doc_id for r in got] == list(range(500))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()


@pytest.mark.parametrize("pad", [b"x", b"xyz"])
def test_ids_that_spell_the_mark_and_wide_ids(pad):
    spelled = np.frombuffer(pad[:-1] + records.MARK.encode() + pad[:1], dtype="<u2").astype("<u4")
    for ids_, width in ((spelled, 4), (np.array([1, 65535]), 2), (np.array([1, 65536, 200_000]), 4), (np.zeros(0, dtype="<u4"), 2)):
        data = records.frame(7, 5, 6, ids_)
        assert records.MARK.encode() not in data
        doc, place, before, back = records.parse(data)
        assert (doc, place, before, back.tolist(), back.itemsize) == (7, 5, 6, ids_.tolist(), width)


def test_a_damaged_frame_raises():
    frame = records.frame(3, 0, 0, np.arange(9))
    assert records.parse(frame)[0] == 3
    for at in range(len(frame)):
        with pytest.raises(ValueError):
            records.parse(frame[:at] + bytes([frame[at] ^ 1]) + frame[at + 1 :])
    with pytest.raises(ValueError):
        records.parse(frame[:-1])


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plans_use_every_piece_once(histogram):
    plan = packing.plan_sequences(histogram, 64)
    used, sequences = Counter(), 0
    for pattern, copies in plan:
        assert sum(n * k for n, k in pattern) <= 64
        sequences += copies
        for n, k in pattern:
            used[n] += k * copies
    assert used == Counter(histogram)
    assert sequences <= 11 / 9 * -(-sum(n * c for n, c in histogram.items()) // 64) * 2 + 1


def test_a_known_best_packing_is_found():
    # 300 sequences of (60, 25, 15), which the longest-first rule alone packs with waste
    assert sum(c for _, c in packing.plan_sequences({60: 300, 25: 300, 15: 300}, 100)) == 300


def test_pack_documents(odd, empty):
    rows = packing.pack_documents(odd, WORD_VOCABULARY, end_id=1, capacity=4096).collect()
    end = np.array([1], dtype="<u4").tobytes()
    want = Counter()
    for i, t in ODD_ROWS:
        whole = ids(WORD, t) + end
        for piece, at in enumerate(range(0, len(whole), 4 * 4096)):
            want[i, piece, at // 4, len(whole[at : at + 4 * 4096]) // 4, zlib.crc32(whole[at : at + 4 * 4096])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
    assert packing.pack_documents(empty, WORD_VOCABULARY, end_id=1, capacity=4096).count() == 0


def test_too_long_pieces_raise(spark):
    with pytest.raises(ValueError):
        packing.pack_best_fit(spark.createDataFrame([(1, 65)], "doc_id long, length long"), 64)
