"""Operators 2, 3, 5 and 8, and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import ODD_ROWS, prose, table
from tests.llm.test_pairs import brute_components, brute_repeats
from treeline.llm import fingerprints, html, licenses, quality

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style></head><body class="page">
<header><a href=/>Home</a> Site name</header><div id="cookie-notice">We use cookies to improve. Accept all of them please.</div>
<nav><ul><li><a href=x>A</a><li><a href=y>B</a></ul></nav><!-- <p>hidden</p> -->
<div class='content'><h1>Big news</h1><p>This is the first paragraph of the <b>article</b> with words.<p>Short.
<ul><li>one thing<li>another thing</ul><form action="a>b"><label>Email</label><input value=">"></form>
<p>The second   paragraph, a &lt;b&gt; &amp; caf&eacute;&nbsp;&#233;.</p><div class="advert">Buy now this thing, it is a great offer today.</div>
<script>var x = "<p>no</p>";</script><p>Last words here.</div>
<aside class=sidebar><p>Related stories about many things in a sidebar, long enough text.</p></aside>
<div id="comments"><p>Reader: I think this article is great and I have much to say about it.</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE).split("\n") == [
        "Big news", "This is the first paragraph of the article with words.", "Short.", "one thing", "another thing",
        "The second paragraph, a <b> & café é.", "Last words here.",
    ]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "a < b", "<!--", "<script>x", "</p></div>", "<a href='", "<p class=\"x>y", "&#xZZ; &amp", "<" * 3000, "<div>" * 3000 + "x", "<p>a" * 5000])
def test_broken_pages_do_no_harm(page):
    assert isinstance(html.main_text(page), str)


P = [f"<p>{prose(i, 60)}</p>" for i in range(4)]
ARTICLE, LINES = "<h1>Big news</h1>" + "".join(P), ["Big news", *[x[3:-4] for x in P]]
MENU = "<nav><ul><li><a href=x>A</a><li><a href=y>B</a></ul></nav>"
TALK = f"<div class='comments'><article><p>{prose(9, 40)}</p></article><article><p>{prose(8, 40)}</p></article></div>"


@pytest.mark.parametrize("page", [
    f"<div id=page class='layout with-sidebar'>{MENU}<article>{ARTICLE}</article><div class=sidebar><p>{prose(7, 30)}</p></div></div>",
    f"<div class='layout sidebar-right'>{MENU}<article>{ARTICLE}</article><div class=sidebar><article><p>{prose(7, 30)}</p></article></div></div>",
    f"<div class='no-sidebar'><div>{ARTICLE}</div></div>{MENU}",
    f"<div class='has-comments'><article>{ARTICLE}</article>{TALK}</div>",
    f"<div class='page-header-fixed'><div class='widget-area'><main>{ARTICLE}</main></div>{TALK}</div>",
    f"<div class='page-header-fixed'><div class='content'>{ARTICLE}</div><footer>me and others</footer></div>",
    f"<form id=page action=x>{MENU}<div role=main>{ARTICLE}</div></form>",
    f"<article><header class='entry-header'><h1>Big news</h1><div class='entry-meta'>By me, today</div></header>{''.join(P)}</article>",
    f"<article><div class='post-header'><h1>Big news</h1></div>{''.join(P)}</article>{TALK}",
    f"<div class='sidebar'>{MENU}<article><p>{prose(7, 30)}</p></article></div><main>{ARTICLE}<div class='ad'><p>{prose(6, 60)}</p></div></main>",
    f"<div>{ARTICLE}</div>{TALK}{MENU}",
])
def test_marked_wrappers_do_not_hide_the_article(page):
    assert html.main_text(f"<html><body>{page}</body></html>").split("\n") == LINES


@pytest.mark.parametrize("page", [f"<div id=cookie-consent><p>{prose(3, 30)}</p></div>{MENU}", f"<aside>{ARTICLE}</aside>", f"<footer><article>{ARTICLE}</article></footer>"])
def test_boilerplate_alone_is_no_article(page):
    assert html.main_text(page) == ""


def test_a_weak_mark_costs_less_than_the_edges_of_a_block_can_weigh():
    weak, strong = (html.Block("w", "div", (), -1, 1, 0, weak=w) for w in (True, False))
    assert html.classify(weak) > -10 * html.SMOOTH > html.classify(strong)


def test_cut_is_minimal():
    r = random.Random(1)
    for _ in range(150):
        n = r.randrange(1, 9)
        excess = [r.randrange(-30, 31) for _ in range(n)]
        edges = [(a, b, r.randrange(0, 20)) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5]

        def cost(side):
            return sum(e if e > 0 and not s else -e if e < 0 and s else 0 for e, s in zip(excess, side)) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html.minimum_cut(excess, edges)) == best


def test_pages(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None), (2, "v", "", 0)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    text = html.main_text(PAGE)
    assert Counter(tuple(r) for r in got) == Counter([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, "v", "", 0)])
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def runs(text):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute_sketch(text):
    """All run hashes below the threshold, by the library of the hash instead of Spark."""
    found = set()
    for run in runs(text):
        seed = 42
        for word in run:
            seed = xxhash.xxh64_intdigest(xxhash.xxh64_digest(word.encode(), 42)[::-1], seed)
        found.add(signed(seed))
    return {h for h in found if h < -(2**63) + 2**64 // fingerprints.FRACTION}


def test_fingerprints(spark, empty):
    r = random.Random(8)
    rows = [(i * 3, prose(70 + i, r.choice([0, 1, 4, 5, 30, 60, 400]))) for i in range(50)] + [(1000, rows_text := prose(7, 200)), (1003, rows_text), (-5, None), (2000, "é" * 9)]
    r.shuffle(rows)
    got = {x.doc_id: x for x in fingerprints.fingerprint_documents(table(spark, rows, 4)).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    errors = []
    for at, (i, text) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        tail = len(text) // 4
        edited = text[: len(text) - tail] + after[:tail]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for own, print_ in ((text, got[i].fingerprint), (edited, got[i].edited_fingerprint)):
            hashes = [signed(int(print_[k : k + 16], 16)) for k in range(16, len(print_), 16)]
            assert hashes == sorted(brute_sketch(own))
        for other, near in ((edited, got[i].near_edited), (after, got[i].near_next)):
            (a, b), (x, y) = (runs(text), runs(other)), (brute_sketch(text), brute_sketch(other))
            assert near == (1.0 if a == b else len(x & y) / min(len(x), len(y)) if x and y else 0.0)
            if min(len(a), len(b)) >= 100:
                errors.append(abs(near - (1.0 if a == b else len(a & b) / min(len(a), len(b)))))
    assert errors and max(errors) < 4 * 0.5 * (0.75 / 25) ** 0.5 and sum(errors) / len(errors) < 0.05
    assert got[1000].fingerprint == got[1003].fingerprint and got[1000].near_next == 1.0
    assert len({x.fingerprint for x in got.values()}) == len({frozenset(runs(t or "")) for _, t in rows})
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_union_of_sketches_is_the_sketch_of_the_union(spark):
    one, two = prose(1, 300), prose(2, 2000)
    both = spark.createDataFrame([(one,), (two,)], "text string")
    a, b = (set(r.kept) for r in fingerprints.sketch(both, "text", "kept", "digest").collect())
    border = {r for r in runs(one + " " + two) if r not in runs(one) | runs(two)}
    whole = set(fingerprints.sketch(spark.createDataFrame([(one + " " + two,)], "text string"), "text", "kept", "digest").first().kept)
    assert a | b <= whole and len(whole - a - b) <= len(border) == 4


def test_next_document_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 2)
    ids = random.Random(2).sample(range(-(10**12), 10**12), 60) + list(range(40))
    rows = [(i, f"text {i}") for i in ids]
    for limit in (100_000, 0):
        monkeypatch.setattr(fingerprints, "BROADCAST_ROWS", limit)
        named = table(spark, rows, 5).selectExpr("doc_id AS id", "text")
        got = {r.text: r.next_text for r in fingerprints.next_documents(named, ["text"]).collect()}
        order = sorted(ids)
        assert got == {f"text {a}": f"text {b}" for a, b in zip(order, order[1:] + order[:1])}


def test_fingerprints_of_odd_rows(odd):
    got = fingerprints.fingerprint_documents(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD_ROWS)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_places(text):
    words = WORD.findall((text or "").translate(LOWER))
    phrases = {k: v.split() for k, v in licenses.BASE_PHRASES.items()}
    return len(words), sorted((i, k) for k, p in phrases.items() for i in range(len(words)) if words[i : i + len(p)] == p)


def test_licenses(spark, odd, empty):
    r = random.Random(6)
    some = ["under the MIT license", "cc by nc", "CC-BY-NC 4.0", "apache license, version 2.0", "under the", "mit", "license version 2", "é", "x1", "\U0001f642", licenses.TEMPLATES["isc-text"]]
    rows = [(i, " ".join(r.choices(some, k=r.randrange(0, 12)))) for i in range(150)] + [(900 + i, t) for i, t in enumerate(licenses.TEMPLATES.values())]
    scanned = licenses.scan_licenses(table(spark, rows))
    texts = dict(rows)
    for x in licenses.license_report(scanned).collect():
        n, places = brute_places(texts[x.doc_id])
        assert (x.n_words, x.n_base) == (n, len(places))
        assert (x.first_word, x.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert x.base_labels == ",".join(sorted({k for _, k in places}))
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1
        if x.doc_id >= 900:
            assert list(licenses.TEMPLATES)[x.doc_id - 900] in x.labels.split(",") and x.score == 1
    clean = licenses.license_report(licenses.scan_licenses(odd)).collect()
    assert Counter(x.doc_id for x in clean) == Counter(i for i, _ in ODD_ROWS) and all(x.labels == "" for x in clean)
    assert licenses.scan_licenses(empty).count() == 0


def test_matching_statistics_survive_edits():
    words = licenses.TEMPLATES["mit-text"].split()
    del words[55], words[30]
    spans = licenses.automaton(licenses.BASE_PHRASES, licenses.TEMPLATES).scan("before " + " ".join(words) + " after")[2]
    assert any(s[0] == "mit-text" and s[3] >= 0.9 * s[4] for s in spans)


def test_quality_on_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_quality(docs, quality.fit_quality(docs, labels))
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    assert len(rows) > 5 and sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.85
    for r in scored.select("doc_id", "held_out").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_of_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([(1, None), (None, 1), (77, 0)], "doc_id long, quality int")
    scored = quality.score_quality(odd, quality.fit_quality(odd, none)).collect()
    assert Counter(r.doc_id for r in scored) == Counter(i for i, _ in ODD_ROWS)
    assert {r.score for r in scored} == {0.5}
    weights = np.zeros((1 << quality.BITS) + 1)
    assert quality.keep_quality(odd, weights).count() == len(ODD_ROWS)
    assert quality.keep_quality(odd, weights, 0.6).count() == 0
    assert quality.score_quality(empty, weights).count() == 0


def test_pipeline_stages_equal_brute_force(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES)
    good = stages[0](spark, docs, sf)
    weights = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.doc_id: r.text for r in good.collect()}
    assert rows == {i: t for i, t in texts.items() if quality.score_text(t, weights) >= 0.3} and good.schema == docs.schema

    one = stages[1](spark, good, sf)
    want = [c for c in brute_components(list(rows.items()), 5, 80, 100) if c[0] == c[2]]
    assert sorted(r.doc_id for r in one.collect()) == sorted(c[0] for c in want) and one.columns == docs.columns

    cut = stages[2](spark, one, sf)
    left = sorted((i, rows[i]) for i in (c[0] for c in want))
    expected = {x[0]: x[4] for x in brute_repeats(left, corpus_pipeline.PASSAGE)}
    assert {r.doc_id: r.text for r in cut.collect()} == expected and cut.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in cut.where("doc_id % 3 = 0").collect())

    packed = stages[3](spark, cut, sf).collect()
    assert {r.doc_id for r in packed} == set(expected)
    total = sum(r.length for r in packed)
    assert -(-total // 4096) <= len({r.sequence_id for r in packed}) <= -(-total // 4096) + 2


def test_pipeline_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
