"""Moving rows through trees with literal lookup arrays: no join, no shuffle, inside generated code."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T


# Widths of the fields of a packed node; features take the rest of the long.
BIN_BITS = 16
CHILD_BITS = 24
MAX_FEATURES = 1 << 63 - BIN_BITS - CHILD_BITS - 1


@dataclass
class Tree:
    """One tree as parallel arrays indexed by node id; ``feature`` is -1 at a leaf."""

    group: int = 0
    feature: list = field(default_factory=lambda: [-1])
    bin: list = field(default_factory=lambda: [0])
    split: list = field(default_factory=lambda: [0.0])
    default_left: list = field(default_factory=lambda: [False])
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])
    cover: list = field(default_factory=lambda: [0.0])
    depth: list = field(default_factory=lambda: [0])
    low: list = field(default_factory=lambda: [float("-inf")])
    high: list = field(default_factory=lambda: [float("inf")])
    path: list = field(default_factory=lambda: [frozenset()])
    scale: float = 1.0

    def add_children(self, node: int) -> tuple[int, int]:
        made = (len(self.feature), len(self.feature) + 1)
        for _ in made:
            self.feature.append(-1)
            self.bin.append(0)
            self.split.append(0.0)
            self.default_left.append(False)
            self.left.append(-1)
            self.right.append(-1)
            self.value.append(0.0)
            self.gain.append(0.0)
            self.cover.append(0.0)
            self.depth.append(self.depth[node] + 1)
            self.low.append(self.low[node])
            self.high.append(self.high[node])
            self.path.append(self.path[node])
        self.left[node], self.right[node] = made
        return made

    def max_depth(self) -> int:
        return max(self.depth)


def number_sql(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if v == float("inf"):
        return "double('Infinity')"
    if v == float("-inf"):
        return "double('-Infinity')"
    return f"{v!r}D"


def literal_array(values) -> str:
    return f"array({','.join(number_sql(v) for v in values)})"


def lookup(values, index: str) -> Column:
    """``values[index]`` with the values as one constant."""
    return F.expr(f"get({literal_array(values)}, {index})")


def packed_nodes(tree: Tree, binned: bool) -> list[int]:
    """One long per node: feature, bin, default direction and left child (the right child follows it); -1 at a leaf."""
    out = []
    for f, b, d, left in zip(tree.feature, tree.bin if binned else [0] * len(tree.bin), tree.default_left, tree.left):
        out.append(-1 if f < 0 else f << BIN_BITS + CHILD_BITS + 1 | b << CHILD_BITS + 1 | int(d) << CHILD_BITS | left)
    return out


def is_sparse(df: DataFrame, column: str) -> bool:
    """Whether features (or bins) are a map from index to value, where an absent index is a missing value."""
    return isinstance(df.schema[column].dataType, T.MapType)


def _advance(packed: str, node: str, binned: bool, column: str, split: str, sparse: bool) -> str:
    index = f"cast(shiftright({packed}, {BIN_BITS + CHILD_BITS + 1}) AS int)"
    x = f"try_element_at({column}, {index})" if sparse else f"get({column}, {index})"
    if sparse and binned:
        x = f"coalesce({x}, 0)"
    to_right = f"IF(({packed} & {1 << CHILD_BITS}L) = 0, 1, 0)"
    if binned:
        bin_number = f"(shiftright({packed}, {CHILD_BITS + 1}) & {(1 << BIN_BITS) - 1}L)"
        turn = f"IF({x} = 0, {to_right}, IF({x} <= {bin_number}, 0, 1))"
    else:
        turn = f"IF({x} IS NULL OR isnan({x}), {to_right}, IF({x} < get({split}, {node}), 0, 1))"
    return f"IF({packed} < 0, {node}, cast({packed} & {(1 << CHILD_BITS) - 1}L AS int) + {turn})"


def step_all(df: DataFrame, trees: list[Tree], nodes: list[str], binned: bool, column: str) -> DataFrame:
    """One level further down for several trees; a row at a leaf stays.

    Generated code stays small: one lookup of a packed node, then shifts. Later filters on the node must not be
    pushed below this projection, because substituting one level into the next would grow the condition
    exponentially with depth. The partition number is non-deterministic to the optimizer, so the (never true)
    test on it keeps each level a projection of its own.
    """
    moving = [(t, n) for t, n in zip(trees, nodes) if t.max_depth() > 0]
    if not moving:
        return df
    fetched = [
        f"IF(spark_partition_id() < 0, 0L, get(array({','.join(f'{v}L' for v in packed_nodes(t, binned))}), {n})) AS __k_{n}" for t, n in moving
    ]
    sparse = is_sparse(df, column)
    moved = {n: f"{_advance(f'__k_{n}', n, binned, column, '' if binned else literal_array(t.split), sparse)} AS {n}" for t, n in moving}
    return df.selectExpr("*", *fetched).selectExpr(*[moved.get(c, f"`{c}`") for c in df.columns])


def route(df: DataFrame, trees: list[Tree], nodes: list[str], binned: bool, column: str) -> DataFrame:
    """Adds the leaf each row reaches in each tree."""
    df = df.selectExpr("*", *[f"0 AS {n}" for n in nodes])
    for _ in range(max((t.max_depth() for t in trees), default=0)):
        df = step_all(df, trees, nodes, binned, column)
    return df


def add_tree_values(df: DataFrame, trees: list[Tree], nodes: list[str], margins: list[str], factor: float = 1.0) -> DataFrame:
    """Adds each tree's leaf value to the margin of its class and drops the node columns."""
    gained: dict[str, Column] = {}
    for t, n in zip(trees, nodes):
        m = margins[t.group]
        value = lookup([v * t.scale * factor for v in t.value], n)
        gained[m] = gained.get(m, F.col(m)) + value
    keep = [c for c in df.columns if c not in nodes]
    return df.select(*[gained[c].alias(c) if c in gained else F.col(c) for c in keep])
