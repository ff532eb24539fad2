"""Operator 7: exact top-k search over vector-approximation files.

Every component is put into one of 256 cells; a vector's cells take a byte each. A scan of the cells bounds the
score of every vector for a query from below and above; the k-th best lower bound of a query is a score it surely
reaches, so only vectors whose upper bound is as high can count. Exact vectors are then read in the order of their
bounds, first the best few per query, then those whose bound is not below the k-th score found, until that is certain.

Layout. Equal vectors are one class with its smallest ids (any more cannot be among the k best of a query that
prefers small ids), and equal queries are one query. Classes are cut into blocks by a hash, queries into groups of
bounded size; each pair (block, group) is one row of work, so neither side is broadcast and no task holds more than a
block and a group. What leaves a pair is bounded by its own k-th bound.

Cases: vectors that are null, empty or hold a null or non-finite component take no part, as query or candidate; a
query meets only vectors of its own length; repeated ids are rows of their own, and a query excludes all rows with
its id; ties go to the smaller id; fewer than k candidates give fewer rows; an empty table gives an empty result;
scores are exact 64-bit integers, and components too large for that raise. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.staging import stage

CELLS = 256
BLOCK_ROWS = 4096
GROUP_QUERIES = 1024
FIRST_READ = 4  # times k: exact vectors read per query before the k-th score is judged


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``id, v array<bigint>``: floor of the scaled components, of the rows that take part."""
    ok = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.col(id_col).isNotNull()
    ok &= F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return table.where(ok).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))


def _smallest(rows: DataFrame, by: list[str], order: list[Column], most: int, name: str = "__n") -> DataFrame:
    """The first ``most`` rows per key; Spark keeps no more per key before the shuffle either."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)


def _cells(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Cells of equal width between the least and the greatest component of each dimension; exact edges are integers."""
    width = np.maximum((high - low + CELLS) // CELLS, 1)
    return np.clip((values - low) // width, 0, CELLS - 1).astype(np.uint8)


def _edges(cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = np.maximum((high - low + CELLS) // CELLS, 1)
    least = low + cells.astype(np.int64) * width
    return least, np.minimum(least + width - 1, high)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of the rows of ``a`` and ``b``; over floats where these are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise ValueError("components too large for 64-bit scores")
    return a @ b.T


def top_k(table: DataFrame, is_query: Column, k: int, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of each query row, without its own id."""
    spark = table.sparkSession
    rows = integer_vectors(table, id_col, vector_col, scale)
    asked = integer_vectors(table.where(is_query), id_col, vector_col, scale)

    # classes of equal vectors, with their k + 1 smallest ids
    kept = _smallest(rows, ["v"], [F.col("id")], k + 1)
    classes = kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = stage(classes.withColumn("class", F.col("ids")[0]).withColumn("dim", F.size("v")), "classes")
    queries = stage(asked.join(classes.select("v", F.col("class").alias("query")), "v").select("id", "query"), "queries")
    shapes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per vector length
    found = [_search(spark, classes, queries, r["dim"], r["n"], k) for r in sorted(shapes, key=lambda r: r["dim"])]
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    scored = found[0]
    for more in found[1:]:
        scored = scored.unionByName(more)

    # classes back to ids: of each class its k + 1 smallest, then every query row drops its own id
    members = scored.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    best = _smallest(members, ["query"], [F.desc("score"), F.col("vec_id")], k + 1).drop("__n")
    answers = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("best"))
    own = queries.join(answers, "query").select(F.col("id").alias("query_id"), F.expr(f"slice(filter(best, x -> x.vec_id != id), 1, {k})").alias("best"))
    return own.select("query_id", F.posexplode("best").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score")
    )


def _search(spark, classes: DataFrame, queries: DataFrame, dim: int, count: int, k: int) -> DataFrame:
    """``query, class, score`` for all queries of one vector length: a superset of the k best with all ties."""
    own = classes.where(F.col("dim") == dim)
    ends = own.agg(
        *[F.min(F.col("v")[i]).alias(f"l{i}") for i in range(dim)], *[F.max(F.col("v")[i]).alias(f"h{i}") for i in range(dim)]
    ).first()
    low, high = np.array(ends[:dim], dtype=np.int64), np.array(ends[dim:], dtype=np.int64)
    blocks = max(1, -(-count // BLOCK_ROWS))
    asked = queries.select("query").distinct().join(own.select(F.col("class").alias("query"), "v"), "query")
    asked = stage(asked, "asked")
    groups = max(1, -(-asked.count() // GROUP_QUERIES))
    want = k + 1  # one of the classes may hold nothing but the query itself

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(1).flatten(), dtype=np.int64).reshape(-1, dim)
            cells = _cells(values, low, high)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in cells], pa.binary())], ["class", "cells"])

    # the approximation file: a byte per component
    file = stage(own.select("class", "v").mapInArrow(approximate, "class bigint, cells binary"), "cells")
    block = F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int")
    left = file.select(block.alias("block"), "class", "cells").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.select(group.alias("group"), "query", "v").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def bound(_: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query", "class", "lower", "upper"]
        if not (a.num_rows and b.num_rows):
            return pa.table([pa.array([], pa.int64())] * 4, names)
        cells = np.frombuffer(b"".join(a.column("cells").to_pylist()), dtype=np.uint8).reshape(a.num_rows, dim)
        least, most = _edges(cells, low, high)
        q = np.asarray(b.column("v").combine_chunks().flatten(), dtype=np.int64).reshape(-1, dim)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        lower = _exact(up, least) + _exact(down, most)
        upper = _exact(up, most) + _exact(down, least)
        n = min(want, a.num_rows)
        sure = np.partition(lower, a.num_rows - n, axis=1)[:, a.num_rows - n] if a.num_rows >= want else np.full(len(q), np.iinfo(np.int64).min)
        at, of = np.nonzero(upper >= sure[:, None])
        ids, asks = np.asarray(a.column("class")), np.asarray(b.column("query"))
        return pa.table([pa.array(asks[at]), pa.array(ids[of]), pa.array(lower[at, of]), pa.array(upper[at, of])], names)

    bounds = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(bound, "query bigint, class bigint, lower bigint, upper bigint")
    bounds = stage(bounds, "bounds")
    sure = _smallest(bounds.select("query", "lower"), ["query"], [F.desc("lower")], want)
    sure = sure.where(F.col("__n") == want).select("query", F.col("lower").alias("sure"))
    open_ = bounds.join(sure, "query", "left").where(F.col("sure").isNull() | (F.col("upper") >= F.col("sure"))).select("query", "class", "upper")

    vectors, asks = own.select("class", "v"), asked.select("query", F.col("v").alias("q"))

    def score(pairs: DataFrame) -> DataFrame:
        product = F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, x: s + x)
        return pairs.join(vectors, "class").join(asks, "query").select("query", "class", "upper", product.alias("score"))

    numbered = open_.withColumn("__n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("upper"), "class")))
    numbered = stage(numbered, "open")
    first = stage(score(numbered.where(F.col("__n") <= FIRST_READ * want).drop("__n")), "first")
    kth = _smallest(first, ["query"], [F.desc("score")], want).where(F.col("__n") == want).select("query", F.col("score").alias("kth"))
    rest = numbered.where(F.col("__n") > FIRST_READ * want).join(kth, "query", "left").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
    return first.select("query", "class", "score").unionByName(score(rest.select("query", "class", "upper")).select("query", "class", "score"))
