"""Operator 13: a Merkle manifest of a table, with an inclusion proof per row.

Every row is a leaf: the SHA-256 of its fields, each with its length before it. The leaves of a tree (one per value of
``tree_col``) ascend by ``order_col``; each three in a row become the digest of their digests, until one is left. The
roots of the trees make a tree of their own in the same way, ordered by the value of ``tree_col``.

Levels are not joined to each other. The digits of a leaf's rank to base three are columns; within a block of
``3 ** BLOCK_LEVELS`` leaves they are grouped away one after another, and every group keeps its children as nested
structs. All groupings of a block need one shuffle. Block roots are the leaves of the next tier, so no row and no task
holds more than one block, however large a tree is. Proofs come from one nested transform over a block's struct and an
explode; the path above a block, one small row per block, is all that is brought to it.

Ranks come from a range shuffle and counts per range. A source that holds most of the table is spread like any other.

Cases: null and empty fields differ (``-`` and ``0:``); rows without ``order_col`` come first; equal ``order_col`` are
ordered by their leaf, and wholly equal rows stand side by side in any order; a null tree value is a tree of its own and
comes first; a tree of one row has that leaf as its root, and an only tree's root is the root; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.llm.staging import stage

FANOUT = 3
BLOCK_LEVELS = 6  # a block has at most 729 leaves
STEP = "array<struct<l:string,r:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the bytes of the value's text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ranked(df: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``rank`` (from 0, in ``order`` within ``key``) and ``size`` (rows of the key); no task holds a whole key.

    Rows are cut into ranges of (key, order); a number in the order of its range becomes a rank by the counts of the
    ranges before. A last column tells equal rows apart, so they may fall into several ranges.
    """
    rows = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(key, *order, "__tie").sortWithinPartitions(key, *order, "__tie")
    placed = stage(rows.drop("__tie").select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__place")), name)
    cells = placed.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__cell")).agg(F.count(F.lit(1)).alias("__n"), F.min("__place").alias("__first"))
    same = Window.partitionBy("__key")
    before = F.coalesce(F.sum("__n").over(same.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("__key", "__cell", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(same).alias("size"))
    joined = placed.join(cells, (F.col("__part") == F.col("__cell")) & F.col(key).eqNullSafe(F.col("__key")))
    return joined.withColumn("rank", F.col("__place") + F.col("__shift")).drop("__key", "__cell", "__shift", "__part", "__place")


def levels_of(size: Column) -> Column:
    """Levels above the leaves: the least number whose power of three reaches ``size``."""
    return sum(((size > FANOUT**k).cast("int") for k in range(40)), F.lit(0))


def rolled_up(nodes: DataFrame, base: int) -> DataFrame:
    """One row per block of ``tree, depth, rank, node, carried``: ``tree, depth, block, node, kids``.

    ``base`` levels lie below the nodes already. Levels beyond ``depth`` pass their only child on unchanged.
    """
    digits = [f"d{k}" for k in range(1, BLOCK_LEVELS + 1)]
    block = F.floor(F.col("rank") / F.lit(FANOUT**BLOCK_LEVELS)).cast("bigint")
    cut = [F.expr(f"cast(rank div {FANOUT ** (k - 1)} % {FANOUT} AS tinyint)").alias(d) for k, d in enumerate(digits, 1)]
    rows = nodes.select("tree", "depth", block.alias("block"), *cut, "node", F.col("carried").alias("kids")).repartition("tree", "block")
    for k, d in enumerate(digits, 1):
        grouped = rows.groupBy("tree", "depth", "block", *digits[k:]).agg(F.array_sort(F.collect_list(F.struct(F.col(d).alias("d"), "node", "kids"))).alias("kids"))
        made = F.sha2(F.array_join("kids.node", ""), 256)
        rows = grouped.withColumn("node", F.when(F.col("depth") >= base + k, made).otherwise(F.col("kids")[0]["node"]))
    return rows


def unrolled(blocks: DataFrame, base: int) -> DataFrame:
    """The nodes that ``rolled_up`` took: ``tree, rank, node, carried``, each with the ``path`` from itself to the top.

    ``blocks`` has its own ``path`` above each block. A step of a path holds the digests left and right of a node.
    """

    def step(kids: Column, d: Column) -> Column:
        left = F.array_join(F.transform(F.filter(kids, lambda x: x["d"] < d), lambda x: x["node"]), "")
        right = F.array_join(F.transform(F.filter(kids, lambda x: x["d"] > d), lambda x: x["node"]), "")
        return F.struct(left.alias("l"), right.alias("r"))

    def walk(kids: Column, level: int, place: Column, path: Column) -> Column:
        def one(kid: Column) -> Column:
            longer = F.when(F.col("depth") >= base + level, F.concat(F.array(step(kids, kid["d"])), path)).otherwise(path)
            at = place * FANOUT + kid["d"]
            if level == 1:
                return F.struct(at.alias("rank"), kid["node"].alias("node"), kid["kids"].alias("carried"), longer.alias("path"))
            return walk(kid["kids"], level - 1, at, longer)

        found = F.transform(kids, one)
        return found if level == 1 else F.flatten(found)

    leaves = F.explode(walk(F.col("kids"), BLOCK_LEVELS, F.col("block"), F.col("path")))
    carried = [c for c in blocks.columns if c not in ("tree", "depth", "block", "node", "kids", "path")]
    return blocks.select("tree", *carried, leaves.alias("__leaf")).select("tree", *carried, "__leaf.*")


def grown(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The tiers of all trees, lowest first; the last one has one row per tree, whose ``node`` is the tree's root."""
    deepest = nodes.agg(F.max("depth").alias("d")).first()["d"] or 0
    tiers, base = [], 0
    while not tiers or base < deepest:
        tiers.append(stage(rolled_up(nodes, base), f"{name}-{len(tiers)}"))
        base += BLOCK_LEVELS
        nodes = tiers[-1].select("tree", "depth", F.col("block").alias("rank"), "node", F.lit(None).cast("int").alias("carried"))
    return tiers


def paths(tiers: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """Every leaf of the trees with its path; ``above`` has ``tree, path`` over each root and columns to pass on."""
    above = above.withColumn("rank", F.lit(0).cast("bigint"))
    for base in range(len(tiers) - 1, -1, -1):
        upper = above.select(F.col("tree").alias("__tree"), F.col("rank").alias("__rank"), *[c for c in above.columns if c not in ("tree", "rank", "node", "carried")])
        joined = tiers[base].join(upper, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("block") == F.col("__rank"))).drop("__tree", "__rank")
        above = unrolled(joined, base * BLOCK_LEVELS)
    return above


def merkle_manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, tree_col: str = "source", order_col: str = "doc_id", tampered: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row: ``order_col, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``tampered`` gives other values of some fields (columns over ``docs``); the root is then folded from the digest of
    those with the row's own siblings, and ``verified`` says whether it is still the root.
    """
    leaf = digest(*[framed(F.col(c)) for c in fields])
    other = tampered or {}
    same = [F.col(c).eqNullSafe(v) for c, v in other.items()]
    changed = leaf
    if other:
        equal = same[0]
        for s in same[1:]:
            equal = equal & s
        changed = F.when(equal, F.lit(None).cast("string")).otherwise(digest(*[framed(other.get(c, F.col(c))) for c in fields]))
    else:
        changed = F.lit(None).cast("string")
    rows = docs.select(F.col(order_col).alias("order"), F.col(tree_col).alias("tree"), leaf.alias("node"), changed.alias("changed"))
    nodes = ranked(rows, "tree", ["order", "node"], "merkle-leaves").withColumn("depth", levels_of(F.col("size")))
    tiers = grown(nodes.select("tree", "depth", "rank", "node", F.struct("order", "changed").alias("carried")), "merkle-tree")

    one = F.lit(0).alias("__one")
    roots = ranked(tiers[-1].select("tree", "node", one), "__one", ["tree"], "merkle-roots").withColumn("depth", levels_of(F.col("size")))
    top = grown(roots.select(F.col("__one").alias("tree"), "depth", "rank", "node", F.struct(F.col("tree").alias("of")).alias("carried")), "merkle-top")
    root = top[-1].select("tree", F.col("node").alias("root"), F.expr(f"cast(array() AS {STEP})").alias("path"))
    subroots = paths(top, root).select(F.col("carried.of").alias("tree"), F.col("node").alias("subroot"), "root", "path")

    leaves = paths(tiers, subroots)
    folded = F.aggregate("path", F.coalesce("carried.changed", "node"), lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))
    done = leaves.select(
        F.col("carried.order").alias(order_col), F.col("node").alias("leaf"), "subroot", "root",
        F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""), 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
