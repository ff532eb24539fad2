"""One registered query per operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import bpe, byte_bpe, divergence, fingerprints, html, jaccard, licenses, merkle, packing, quality, records, substrings, vectors
from treeline.session import scratch_path

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_table(spark, sf_dir, "pages"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(licenses.scan_licenses(_table(spark, sf_dir, "documents")))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(_table(spark, sf_dir, "documents"), window=20, with_text=False)


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


def op9_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "records")
    records.write_records(_table(spark, sf_dir, "documents"), folder, BYTE_VOCABULARY, end_id=2)
    index = records.write_index(spark, folder)
    return records.with_start(index).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_VOCABULARY, end_id=1, capacity=4096)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.byte_round_trip(_table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.expr("replace(text, '\n', '')")).otherwise(F.col("text"))
    return merkle.merkle_manifest(_table(spark, sf_dir, "documents"), tampered={"text": cut})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_html, op3_fingerprints, op4_jaccard, op5_licenses, op6_substrings, op7_topk, op8_quality, op9_records, op10_packing, op11_divergence, op12_byte_bpe, op13_merkle)
}
ORACLES: dict[str, str] = {
    "op4_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents WHERE text IS NOT NULL),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w WHERE len(ws) > 0),
        z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (
            SELECT a, b FROM common JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
        SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, min(r.other) AS component_id
        FROM documents d JOIN r USING (doc_id) LEFT JOIN z USING (doc_id) GROUP BY d.doc_id, z.n
    """,
    "op6_substrings": r"""
        WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS pos FROM w WHERE len(ws) >= 20),
        v AS (
            SELECT s.doc_id, s.pos, row_number() OVER (PARTITION BY md5(array_to_string(ws[s.pos:s.pos + 19], ' ')) ORDER BY s.doc_id, s.pos) AS nth
            FROM s JOIN w USING (doc_id)),
        gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM v WHERE nth > 1),
        lost AS (SELECT doc_id, list(pos) AS gone_at FROM gone GROUP BY 1)
        SELECT doc_id, len(ws) AS n_words, coalesce(len(gone_at), 0) AS n_removed,
            sha256(array_to_string(list_filter(ws, lambda x, i: gone_at IS NULL OR NOT list_contains(gone_at, i)), ' ')) AS kept_sha256
        FROM w LEFT JOIN lost USING (doc_id)
    """,
    "op11_divergence": r"""
        WITH d AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
            FROM documents),
        g AS (SELECT DISTINCT lang, source FROM d),
        kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ws)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
        c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ws) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
        x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p FROM x JOIN v USING (lang)),
        ql AS (
            SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v)::HUGEINT AS q
            FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        by_pair AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        by_term AS (
            SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN ql USING (lang, term) WHERE n > 0 AND p > q),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
            FROM (SELECT * FROM by_pair UNION ALL SELECT * FROM by_term))
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
    """,
    "op13_merkle": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, lang, n_chars, text, list_reduce(
                list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS UBIGINT))),
                lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(i AS UBIGINT) FOR i IN range(8)]),
                    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) AS crc
            FROM documents),
        t AS (
            SELECT *, CASE WHEN xor(crc, 4294967295::UBIGINT) & 1 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM d),
        f AS (
            SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
            FROM t),
        h AS (
            SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS changed
            FROM f),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM h),
        up(lvl, source, pos, node, n) AS (
            SELECT 0, source, pos, leaf, n FROM leaves
            UNION ALL
            SELECT lvl + 1, source, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM up WHERE n > 1 GROUP BY lvl, source, pos // 3),
        subroots AS (
            SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
        high(lvl, pos, node, n) AS (
            SELECT 0, pos, subroot, n FROM subroots
            UNION ALL
            SELECT lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM high WHERE n > 1 GROUP BY lvl, pos // 3),
        steps AS (
            SELECT lvl, source, pos, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM up WHERE n > 1 WINDOW w AS (PARTITION BY lvl, source, pos // 3 ORDER BY pos)),
        high_steps AS (
            SELECT lvl, pos, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM high WHERE n > 1 WINDOW w AS (PARTITION BY lvl, pos // 3 ORDER BY pos)),
        fold(lvl, source, first, pos, node, proof) AS (
            SELECT 0, source, pos, pos, changed, '' FROM leaves
            UNION ALL
            SELECT f.lvl + 1, f.source, f.first, f.pos // 3, sha256(s.l || f.node || s.r), f.proof || s.l || s.r
            FROM fold f JOIN steps s ON s.lvl = f.lvl AND s.pos = f.pos AND s.source IS NOT DISTINCT FROM f.source),
        low AS (
            SELECT source, first, arg_max(node, lvl) AS node, arg_max(proof, lvl) AS proof FROM fold GROUP BY source, first),
        fold_high(lvl, source, first, pos, node, proof) AS (
            SELECT 0, low.source, low.first, s.pos, low.node, low.proof FROM low JOIN subroots s ON s.source IS NOT DISTINCT FROM low.source
            UNION ALL
            SELECT f.lvl + 1, f.source, f.first, f.pos // 3, sha256(s.l || f.node || s.r), f.proof || s.l || s.r
            FROM fold_high f JOIN high_steps s ON s.lvl = f.lvl AND s.pos = f.pos),
        done AS (
            SELECT source, first, arg_max(node, lvl) AS folded_root, sha256(arg_max(proof, lvl)) AS proof_sha256 FROM fold_high GROUP BY source, first)
        SELECT l.doc_id, l.leaf, s.subroot, r.node AS root, d.proof_sha256, d.folded_root, d.folded_root = r.node AS verified
        FROM leaves l JOIN done d ON d.source IS NOT DISTINCT FROM l.source AND d.first = l.pos JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
            JOIN (SELECT node FROM high WHERE n = 1) r ON true
    """,
    "op7_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
}
