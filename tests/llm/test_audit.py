"""Operators 11, 12 and 13 against plain versions of the same rules."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import ODD_ROWS, table
from tests.llm.test_tokens import PIECES
from tools.compare import compare, connect
from treeline.llm import byte_bpe, divergence, merkle, queries

PATTERN = public_tokenizers.PATTERN
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.BYTE_RANKS, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODER = byte_bpe.MatrixBpe(queries.BYTE_RANKS, PATTERN)


def library_ids(text):
    return np.array(LIBRARY.encode_ordinary(text or ""), dtype="<u4").tobytes()


@pytest.mark.parametrize("name", ["op11_divergence", "op13_merkle"])
def test_agrees_with_sql(spark, sf, name):
    status, note, _ = compare(spark, connect(sf), sf, name, queries.QUERIES[name], queries.ORACLES[name])
    assert status == "OK", note


# -- 12


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=6), max_size=12).map("".join))
def test_ids_equal_the_library(text):
    assert CODER.encode([text])[0] == library_ids(text)
    assert CODER.decode(library_ids(text)) == text.encode()


def test_every_character():
    chars = [chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000]
    texts = [f"a{c}1 {c}{c}." for c in chars]
    got = [ids for at in range(0, len(texts), 20_000) for ids in CODER.encode(texts[at : at + 20_000])]
    assert [c for c, t, ids in zip(chars, texts, got) if ids != library_ids(t)] == []


@pytest.mark.parametrize("letters", ["abcdehilnorst", "ab", "a", "xé漢\U0001f642"])
def test_long_words(letters):
    r = random.Random(4)
    for n in (1, 2, 3, 31, 64, 65, 66, 200, 3000):
        word = "".join(r.choice(letters) for _ in range(n))
        assert CODER.encode([word])[0] == library_ids(word)
        if n < 1000 and len(word.encode()) > 1:
            row = CODER.byte_ids[np.frombuffer(word.encode(), dtype=np.uint8)][None, :].copy()
            assert CODER._merge_long(word.encode()) == CODER._merge_rows(row, np.array([len(word.encode())]))[0]


def test_a_round_that_makes_a_lower_rank(tmp_path):
    # "ab" ranks after "abc": both places of "ab" must not be merged before the "abc" that the first one makes
    own = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"cab"]
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(own)))
    small = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks={t: i for i, t in enumerate(own)}, special_tokens={})
    coder = byte_bpe.MatrixBpe(str(path), r"\S+|\s+")
    for word in ("abcabcab", "ababcab" * 12, "cabcab" * 20, "aabbccab" * 30):
        assert np.frombuffer(coder._merge_long(word.encode()), dtype="<u4").tolist() == small.encode_ordinary(word)


def test_pair_table_finds_all_and_nothing_else():
    r = np.random.default_rng(1)
    pairs = np.unique(r.integers(0, 300, (5000, 2)), axis=0)
    found = byte_bpe.PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs)))
    assert (found.find(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    assert (found.find(pairs[:, 0], pairs[:, 1] + 1000) == byte_bpe.NO_RANK).all()


def test_round_trip(odd, empty):
    got = Counter(tuple(r) for r in byte_bpe.byte_round_trip(odd, queries.BYTE_RANKS, PATTERN).collect())
    assert got == Counter(
        (i, len(library_ids(t)) // 4, hashlib.sha256(library_ids(t)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD_ROWS
    )
    coded = byte_bpe.byte_encode(odd, queries.BYTE_RANKS, PATTERN)
    back = Counter((r["doc_id"], bytes(r["bytes"])) for r in byte_bpe.byte_decode(coded, queries.BYTE_RANKS, PATTERN).collect())
    assert back == Counter((i, (t or "").encode()) for i, t in ODD_ROWS)
    assert byte_bpe.byte_round_trip(empty, queries.BYTE_RANKS).count() == 0


# -- 11


def plain_audit(rows, least=10, top=10):
    """``rows`` of (lang, source, text)."""
    groups, docs, counts = set(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups.add((lang, source))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = [s for x, s in groups if x == lang]
        whole = sum((counts[lang, s] for s in own), Counter())

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q = shares(whole)
        p = {s: shares(counts[lang, s]) for s in own}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in own:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(sorted(found)[:limit], 1)]
    return Counter(out)


def audit_rows(n=400, sources=7):
    r = random.Random(5)
    words = ["The", "and", "é", "größe", "naïve", "漢字", "x1y", "a-b", "Ω"] + [f"{a}{b}" for a in "abcdef" for b in "ghijkl"]
    rows = [(r.choice(["en", "de", None, ""]), r.choice([None, *(f"s{k}" for k in range(sources))]), " ".join(r.choice(words[k % 3 :]) for _ in range(r.randrange(30)))) for k in range(n)]
    rows += [("xx", "s0", None), ("xx", "s1", ""), ("yy", "s0", "only a few words"), ("yy", None, "...")] + [("en", "s1", "hot row " * 50)] * 20
    return rows + [("zz", "s9", "one source alone")] * 12


@pytest.fixture(scope="module")
def audited(spark):
    full = [(i, t, lang, s, None, 7, "x") for i, (lang, s, t) in enumerate(audit_rows())]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, term int, value string").repartition(5)


@pytest.mark.parametrize("tile, most, pairs", [(256, 400_000, 1 << 20), (3, 40, 16)])
def test_audit(audited, monkeypatch, tile, most, pairs):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", pairs)
    monkeypatch.setattr(divergence, "CHUNK", max(2, most // 10))
    plain = divergence.runs
    monkeypatch.setattr(divergence, "runs", lambda docs, shards: plain(docs, shards, most))
    got = divergence.divergence_audit(audited)
    assert Counter(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == plain_audit(audit_rows())


def test_audit_of_odd_rows(odd, empty):
    got = Counter(tuple(r) for r in divergence.divergence_audit(odd, least_docs=2).collect())
    assert got == plain_audit([("en", "src0", t) for _, t in ODD_ROWS], least=2)
    assert divergence.divergence_audit(empty).count() == 0


def test_shares_stay_exact_beyond_64_bits(spark):
    rows = [(10**13 + 7, 3 * 10**13 + 1, 12345), (0, 9 * 10**15, 1), (5, 7, 11), (0, 0, 0)]
    df = spark.createDataFrame(rows, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert [r["p"] for r in df.collect()] == [1 + 10**9 * (c + 2) // (n + 2 * v) if n + 2 * v else None for c, n, v in rows]


# -- 13


def plain_manifest(rows, cut):
    """``rows`` of (doc_id, source, lang, n_chars, text)."""

    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    def tree(nodes):
        """Root and the path (left, right) of every node."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, pos in enumerate(at):
                lo = pos // 3 * 3
                paths[k].append(("".join(nodes[lo:pos]), "".join(nodes[pos + 1 : lo + 3])))
            nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
            at = [pos // 3 for pos in at]
        return nodes[0], paths

    by_source = defaultdict(list)
    for row in rows:
        by_source[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources}
    root, high = tree([trees[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for (_, _, own, row), path in zip(sorted(by_source[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            node = leaf(cut(row))
            for left, right in path + high[k]:
                node = h(left, node, right)
            out.append((row[0], own, trees[s][0], root, h(*[a + b for a, b in path + high[k]]), node, node == root))
    return Counter(out)


def cut_lines(row):
    i, *rest, text = row
    return (i, *rest, text.replace("\n", "") if i is not None and text is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text)


def manifest(df):
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.expr("replace(text, '\\n', '')")).otherwise(F.col("text"))
    return Counter(tuple(r) for r in merkle.merkle_manifest(df, tampered={"text": cut}).collect())


@pytest.mark.parametrize("levels, sizes", [(6, (1, 2, 3, 4, 9, 10, 40)), (1, (1, 2, 3, 10, 28)), (2, (82,)), (2, (1,) * 30)])
def test_manifest(spark, monkeypatch, levels, sizes):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    r = random.Random(6)
    rows = [(None if r.random() < 0.05 else r.randrange(400), s or None, r.choice(["en", None, ""]), r.choice([None, 3]), r.choice([None, "", "a\nb\n", "é\n漢", "x"]))
            for s, n in zip(["", "Z", "a", "é", "src", "\U0001f642", "b", *[f"t{k}" for k in range(30)]], sizes) for _ in range(n)]
    df = spark.createDataFrame([(*row, "z", 1) for row in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, depth int").repartition(4)
    assert manifest(df) == plain_manifest(rows, cut_lines)


def test_manifest_of_odd_rows(odd, empty):
    rows = [(i, "src0", "en", None if t is None else len(t), t) for i, t in ODD_ROWS]
    assert manifest(odd) == plain_manifest(rows, cut_lines)
    assert merkle.merkle_manifest(empty).count() == 0
