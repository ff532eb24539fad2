"""Operators 4, 6 and 7 against brute force."""

import hashlib
import pathlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import LONG, ODD_ROWS, prose, table
from treeline.llm import components, jaccard, substrings, vectors


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_components(rows, n, p, q):
    """Smallest id reachable per row; equal sets of rows without id count too."""
    sets = [shingles(t, n) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and q * len(a & b) >= p * len(a | b):
                group[top(i)] = top(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if sets[i] and top(j) == top(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return Counter(out)


def near_copies(seed, groups=12, words=120):
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        base = prose(1000 * seed + g, r.choice([4, 12, 40, words, 3 * words])).split()
        for _ in range(r.choice([1, 2, 3, 9])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4, 7])):
                copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
            if r.random() < 0.3:
                copy = copy[: -r.randrange(1, 4)] or copy
            rows.append((len(rows) * 3 + 7, " ".join(copy)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("n,p,q", [(3, 90, 100), (5, 80, 100), (2, 50, 100), (1, 1, 1)])
def test_components_equal_brute_force(spark, n, p, q):
    rows = near_copies(n * p)
    got = Counter(tuple(r) for r in jaccard.jaccard_components(table(spark, rows, 4), n, p, q).collect())
    assert got == brute_components(rows, n, p, q)


def test_shared_tiles_take_no_table_of_all_keys(spark):
    # (class, key): key 1 of one class, 2 of one class twice, 3 and 4 of the same two, 5 of three, 6 of many
    rows = [(7, 1), (8, 2), (8, 2), (9, 3), (4, 3), (4, 4), (9, 4), (9, 5), (2, 5), (11, 5), *((c, 6) for c in range(20, 60))]
    places = spark.createDataFrame(rows, "class long, key long").repartition(3)
    found = jaccard._members(places)
    groups = {}
    for c, key in rows:
        groups.setdefault(key, set()).add(c)
    assert Counter(tuple(r) for r in found.collect()) == Counter({(min(g), c) for g in groups.values() if len(g) > 1 for c in g})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan[plan.index("Window") :]


@pytest.mark.parametrize("buckets", [1, 64, 5_000])
def test_packed_keys(buckets):
    r = np.random.default_rng(buckets)
    rows = np.sort(np.concatenate([r.integers(0, 1 << 17, 60), r.integers(0, 500, 60) + (7 << 33)])).repeat(300)
    keys = r.integers(0, 1 << 64, len(rows), dtype=np.uint64)
    keys[r.integers(0, len(keys), 900)] = keys[r.integers(0, 200, 900)]
    whole, found, tiles = pa.Table.from_batches([jaccard._pack_keys(keys[i::2], rows[i::2], buckets) for i in (0, 1)]), set(), {}
    assert whole.nbytes < 7 * len(keys) + 40 * whole.num_rows  # no list of rows or whole keys travels
    for bucket in np.unique(np.asarray(whole.column("bucket"))):
        for tile in jaccard._shared(*jaccard._unpack_keys(whole.filter(pa.compute.equal(whole.column("bucket"), int(bucket))))).to_pylist():
            found |= {(tile["least"], c) for c in tile["classes"]}
    for key, row in zip(keys.tolist(), rows.tolist(), strict=True):
        tiles.setdefault(key, set()).add(row)
    assert {x for x in found if len({c for least, c in found if least == x[0]}) > 1} == {(min(t), c) for t in tiles.values() if len(t) > 1 for c in t}


def test_written_keys_are_those_of_shared_tiles(spark, monkeypatch):
    # texts that share nothing: their tile keys were written, 8 bytes each, before they were shuffled
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(400))) for i in range(60)] + [(100, "one more text of a few words"), (101, "one more text of a few words")]
    sizes, write = {}, jaccard.stage

    def sized(df, name):
        table = write(df, name)
        sizes[name] = max(sizes.get(name, 0), sum(f.stat().st_size for f in pathlib.Path(table.staged_path.removeprefix("file:")).glob("part-*")))
        return table

    monkeypatch.setattr(jaccard, "stage", sized)
    got = Counter(tuple(r) for r in jaccard.jaccard_components(table(spark, rows, 4), 5, 80, 100).collect())
    assert got == brute_components(rows, 5, 80, 100)
    assert sizes["keyed"] < 8 * sum(len(jaccard.tile_keys(jaccard.shingle_set(t, 5), 80, 100)) for _, t in rows) / 2, sizes


def test_chain_of_copies_in_one_tile_across_chunks(spark, monkeypatch):
    # every text differs from its neighbours by a little and from the others by more: components need more than the star
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    base = prose(5, 200).split()
    rows = [(i, " ".join([f"x{i}_{k}" if k in (3 * i % 180, 3 * i % 180 + 1) else w for k, w in enumerate(base)])) for i in range(30)]
    rows += [(100 + i, " ".join(base[:180] + [f"tail{i}"] * 9 + [f"more{i}_{k}" for k in range(6)])) for i in range(12)]
    got = Counter(tuple(r) for r in jaccard.jaccard_components(table(spark, rows, 4), 3, 90, 100).collect())
    assert got == brute_components(rows, 3, 90, 100)


def test_no_table_grows_with_the_square_of_a_group(spark, monkeypatch):
    # the first row shares a tile with all near copies and links with none; as their only centre it left every pair to be listed
    base = prose(9, 200).split()
    rows = [(0, " ".join(base[:100] + [f"far{k}" for k in range(100)]))]
    rows += [(i, " ".join([f"x{i}_{k}" if k in (101 + i, 102 + i) else w for k, w in enumerate(base)])) for i in range(1, 81)]
    made, write = {}, jaccard.stage

    def counted(df, name):
        table = write(df, name)
        made[name] = max(made.get(name, 0), table.count())
        return table

    monkeypatch.setattr(jaccard, "stage", counted)
    got = Counter(tuple(r) for r in jaccard.jaccard_components(table(spark, rows, 4), 5, 80, 100).collect())
    assert got == brute_components(rows, 5, 80, 100)
    assert max(made.values()) < 81 * 80 // 4, made


def test_groups_with_pairs_near_the_bound(spark, monkeypatch):
    # bit counts let pairs pass that are no links: their trees are compared once more, across chunks too
    monkeypatch.setattr(jaccard, "CHUNK", 5)
    monkeypatch.setattr(jaccard, "overlap_bound", lambda a, n, b, m: np.minimum(n, m))
    r, base, rows = random.Random(3), prose(11, 120).split(), []
    for i in range(24):
        copy = list(base)
        for k in r.sample(range(120), r.choice([1, 2, 3, 4, 5])):
            copy[k] = f"new{i}_{k}"
        rows.append((i, " ".join(copy)))
    got = Counter(tuple(r) for r in jaccard.jaccard_components(table(spark, rows, 4), 3, 80, 100).collect())
    want = brute_components(rows, 3, 80, 100)
    assert len({c for _, _, c in want}) > 1
    assert got == want


def test_components_of_odd_rows(spark, odd, empty):
    got = Counter(tuple(r) for r in jaccard.jaccard_components(odd).collect())
    assert got == brute_components(ODD_ROWS, 3, 90, 100)
    assert jaccard.jaccard_components(empty).count() == 0


def test_keep_one(spark, odd):
    kept = [r.doc_id for r in jaccard.keep_one(odd, jaccard.jaccard_components(odd)).collect()]
    assert Counter(kept) == Counter([None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10])  # rows of one id are one document


def test_bounds_and_tiles_lose_no_pair():
    r = random.Random(5)
    for _ in range(1500):
        p, q = r.choice([(90, 100), (80, 100), (1, 1), (50, 100)])
        n = r.choice([1, 2, 3, 5, 8, 12, 20, 40, 90, 300])
        a = np.unique(np.array([r.getrandbits(64) for _ in range(n)], dtype=np.uint64))
        keep = list(a[: max(1, int(n * r.uniform(p / q - 0.08, 1)))])
        b = np.unique(np.array(keep + [r.getrandbits(64) for _ in range(r.randint(0, max(1, n // 12)))], dtype=np.uint64))
        shared = len(np.intersect1d(a, b))
        assert jaccard.overlap_bound(jaccard.bitmap(a), len(a), jaccard.bitmap(b), len(b)) >= shared
        if jaccard.reaches(shared, len(a), len(b), p, q):
            assert len(np.intersect1d(jaccard.tile_keys(a, p, q), jaccard.tile_keys(b, p, q)))


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200, 201), (201, 200), (300, 300), (400, 402), (401, 402)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200, 400: 400, 401: 400, 402: 400}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_links_that_are_chosen_anew_when_read_again(spark):
    # two of the three links of a triangle connect it, whichever they are, but not one direction of some and the other of others
    def forest(batches):
        r = random.SystemRandom()
        for batch in batches:
            links = [x for k in batch.column(0).to_pylist() for x in r.sample([(3 * k, 3 * k + 1), (3 * k, 3 * k + 2), (3 * k + 1, 3 * k + 2)], 2)]
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in links], pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    links = spark.range(300).mapInArrow(forest, "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {i: i // 3 * 3 for i in range(900)}


def brute_repeats(rows, window):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] or ""))
    seen, out = set(), []
    for i in order:
        words = (rows[i][1] or "").encode().split()
        gone = set()
        for at in range(len(words) - window + 1):
            w = tuple(words[at : at + window])
            if w in seen:
                gone.update(range(at, at + window))
            seen.add(w)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((rows[i][0], len(words), len(gone), hashlib.sha256(kept).hexdigest(), (kept.decode() if gone else rows[i][1])))
    return Counter(out)


@pytest.mark.parametrize("window", [20, 4])
def test_repeats_equal_brute_force(spark, window):
    r = random.Random(window)
    passages = [prose(50 + k, r.choice([window - 1, window, window + 1, 3 * window])) for k in range(8)]
    rows = []
    for i in range(60):
        parts = [prose(2000 + 7 * i + k, r.randrange(0, 40)) for k in range(3)]
        parts += r.sample(passages, r.randrange(0, 3)) * r.choice([1, 1, 2])
        r.shuffle(parts)
        rows.append((i * 2, " ".join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300, "a b " * 60), (301, "a b " * 60 + prose(1, 30))]
    r.shuffle(rows)
    got = substrings.dedup_substrings(table(spark, rows, 5), window).select("doc_id", "n_words", "n_removed", "kept_sha256", "text")
    assert Counter(tuple(x) for x in got.collect()) == brute_repeats(rows, window)


def test_repeats_of_odd_rows_and_carried_columns(spark, odd, empty):
    got = substrings.dedup_substrings(odd, 20, carry=["rest", "uid", "lang"])
    rows = got.collect()
    assert Counter(tuple(r)[:5] for r in rows) == brute_repeats(ODD_ROWS, 20)
    assert {(r.rest, r.uid, r.lang) for r in rows} == {(None, "z", "en")}
    assert substrings.dedup_substrings(empty, 20).count() == 0
    with pytest.raises(ValueError):
        substrings.dedup_substrings(odd, 3)


def test_places_pack(spark):
    for places in ([], [0], [5], [0, 255, 256, 1000, 1001, 70000]):
        assert substrings._unpack_places(*substrings._pack_places(np.array(places, dtype=np.int64))).tolist() == places


@pytest.mark.parametrize("documents", [1, 300])
def test_bytes_per_probe_do_not_grow_with_buckets(documents):
    r = np.random.default_rng(7)
    starts = np.sort(r.choice(200_000, documents, replace=False))
    starts[0] = 0
    uids, places = np.arange(documents) * 3 + 5, np.unique(r.integers(0, 200_000, 150_000))
    for buckets in (1, 64, 2_000, 50_000):
        at = r.integers(0, buckets, len(places))
        rows = substrings._rows_by_bucket(at, places, places.astype("<u4"), at[:100], places[:100], uids, starts)
        assert rows.num_rows == len(np.unique(at)) and rows.nbytes < 28 * len(places) + 80 * rows.num_rows
        found = []
        for row in rows.to_pylist():
            own = substrings._unpack_places(row["places"], row["wide"])
            assert own.tolist() == np.frombuffer(row["keys"], dtype="<u4").tolist()
            found += zip(*(x.tolist() for x in substrings._documents_of(row["uids"], row["starts"], own)), strict=True)
        document = np.searchsorted(starts, places, side="right") - 1
        assert sorted(found) == list(zip(uids[document].tolist(), (places - starts[document]).tolist(), strict=True))


@pytest.mark.parametrize("chars", [64, 4096])
def test_repeats_do_not_depend_on_buckets(spark, monkeypatch, chars):
    monkeypatch.setattr(substrings, "BUCKET_CHARS", chars)
    monkeypatch.setattr(substrings, "LEAST_BUCKETS", 1)
    shared = prose(91, 70)
    rows = [(i, " ".join([prose(900 + i, 30), shared if i % 3 else "", prose(950 + i, 25)])) for i in range(40)]
    got = substrings.dedup_substrings(table(spark, rows, 4), 20).select("doc_id", "n_words", "n_removed", "kept_sha256", "text")
    assert Counter(tuple(x) for x in got.collect()) == brute_repeats(rows, 20)


@pytest.mark.parametrize("most", [0, 100])
def test_only_texts_with_hits_are_written_again(spark, monkeypatch, most):
    # all texts were shuffled to their hits and written, whether they had any or not
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", most)
    made, write = {}, substrings.stage

    def counted(df, name):
        table = write(df, name)
        made[name] = table.count()
        return table

    monkeypatch.setattr(substrings, "stage", counted)
    shared = prose(77, 30)
    rows = [(i, prose(3000 + i, 60) + (" " + shared if i % 10 == 0 else "")) for i in range(50)]
    got = substrings.dedup_substrings(table(spark, rows, 4), 20)
    assert Counter(tuple(x) for x in got.select("doc_id", "n_words", "n_removed", "kept_sha256", "text").collect()) == brute_repeats(rows, 20)
    assert made["anchored"] == 5


def brute_top(rows, k, every):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q)))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return Counter(out)


@pytest.mark.parametrize("block,group", [(4096, 1024), (7, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "GROUP_QUERIES", group)
    r = random.Random(9)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(40)]  # many equal vectors
    rows += [(300 + i, [r.uniform(-9, 9) for _ in range(3)]) for i in range(8)]
    rows += [(400, None), (410, []), (420, [1.0, None]), (430, [float("nan")] * 6), (440, [float("inf")] * 6), (None, [0.5] * 6), (450, [0.0] * 6), (460, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("query", F.lit(2)).repartition(3)
    got = vectors.top_k(frame, F.col("vec_id") % 10 == 0, 5)
    assert Counter(tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows, 5, 10)


def test_top_k_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.top_k(frame, F.col("vec_id") % 10 == 0, 5).count() == 0


def test_a_very_long_text_of_two_words(spark):
    rows = [(1, LONG), (2, "alpha " + LONG)]
    got = substrings.dedup_substrings(table(spark, rows), 20).select("doc_id", "n_words", "n_removed", "kept_sha256", "text")
    assert Counter(tuple(x) for x in got.collect()) == brute_repeats(rows, 20)
