"""A trained ensemble: node table, evaluation log and the few facts scoring needs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, types as T

from treeline.operators.routing import Tree

NODE_SCHEMA = T.StructType([
    T.StructField("round", T.IntegerType()),
    T.StructField("tree", T.IntegerType()),
    T.StructField("class", T.IntegerType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("split", T.DoubleType()),
    T.StructField("default_left", T.BooleanType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("leaf", T.DoubleType()),
    T.StructField("gain", T.DoubleType()),
    T.StructField("cover", T.DoubleType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("scale", T.DoubleType()),
])
LOG_SCHEMA = "round int, fold int, data_name string, metric string, value double"


@dataclass
class Model:
    """``trees[round]`` lists the trees of that round; values already include the learning rate."""

    objective: str
    params: dict
    base_margin: float
    n_features: int
    n_outputs: int = 1
    trees: list[list[Tree]] = field(default_factory=list)
    log: list[tuple] = field(default_factory=list)
    best_round: int | None = None
    index_base: str = "raw"

    @property
    def used_rounds(self) -> int:
        """Rounds that scoring uses: up to the best one when early stopping found it."""
        return len(self.trees) if self.best_round is None else self.best_round + 1

    def used_trees(self) -> list[Tree]:
        return [t for r in self.trees[: self.used_rounds] for t in r]

    def node_rows(self) -> list[tuple]:
        rows, index = [], 0
        for number, trees in enumerate(self.trees):
            for t in trees:
                for n in range(len(t.feature)):
                    leaf = t.feature[n] < 0
                    rows.append((
                        number, index, t.group, n, t.feature[n], None if leaf else float(t.split[n]),
                        None if leaf else bool(t.default_left[n]), t.left[n], t.right[n],
                        float(t.value[n]) if leaf else None, float(t.gain[n]), float(t.cover[n]), float(t.value[n]), float(t.scale),
                    ))
                index += 1
        return rows

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.node_rows(), NODE_SCHEMA)

    def log_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, LOG_SCHEMA)

    def facts(self) -> str:
        return json.dumps({
            "objective": self.objective, "params": self.params, "base_margin": self.base_margin, "rounds": len(self.trees),
            "n_features": self.n_features, "n_outputs": self.n_outputs, "best_round": self.best_round, "index_base": self.index_base,
        })


def trees_from_rows(rows) -> list[list[Tree]]:
    """Trees from node-table rows in any order."""
    rounds: dict[int, dict[int, Tree]] = {}
    for r in sorted(rows, key=lambda r: (r["tree"], r["node"])):
        t = rounds.setdefault(r["round"], {}).setdefault(r["tree"], Tree(group=r["class"]))
        n = r["node"]
        while len(t.feature) <= n:
            for name in ("feature", "bin", "split", "default_left", "left", "right", "value", "gain", "cover", "depth", "low", "high", "path"):
                getattr(t, name).append(getattr(t, name)[-1])
        t.scale = r["scale"]
        t.feature[n], t.left[n], t.right[n] = r["feature"], r["left"], r["right"]
        t.split[n] = r["split"] if r["split"] is not None else 0.0
        t.default_left[n] = bool(r["default_left"])
        t.gain[n], t.cover[n], t.value[n] = r["gain"], r["cover"], r["value"]
    for trees in rounds.values():
        for t in trees.values():
            t.depth[0] = 0
            for n in range(len(t.feature)):
                if t.feature[n] >= 0:
                    t.depth[t.left[n]] = t.depth[t.right[n]] = t.depth[n] + 1
    return [list(rounds[k].values()) for k in sorted(rounds)]


def save_model(model: Model, spark: SparkSession, path: str, model_id: str = "model") -> None:
    """Node table as Parquet partitioned by ``model_id`` plus a one-line facts file; replaces that model only."""
    nodes = model.nodes(spark)
    nodes.repartition(max(1, nodes.rdd.getNumPartitions() // 64)).write.mode("overwrite").parquet(f"{path}/nodes/model_id={model_id}")
    spark.createDataFrame([(model.facts(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts/model_id={model_id}")
    model.log_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/log/model_id={model_id}")


def load_model(spark: SparkSession, path: str, model_id: str = "model") -> Model:
    facts = json.loads(spark.read.text(f"{path}/facts/model_id={model_id}").first()["value"])
    rows = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes/model_id={model_id}").collect()
    log = [tuple(r) for r in spark.read.schema(LOG_SCHEMA).parquet(f"{path}/log/model_id={model_id}").collect()]
    return Model(
        facts["objective"], facts["params"], facts["base_margin"], facts["n_features"], facts["n_outputs"],
        trees_from_rows(rows), log, facts["best_round"], facts["index_base"],
    )


def load_models(spark: SparkSession, path: str) -> list[Model]:
    """All stored models in the order of their names, to answer together."""
    return [load_model(spark, path, name) for name in model_ids(spark, path)]


def model_ids(spark: SparkSession, path: str) -> list[str]:
    """Names of the stored models, sorted; hidden names are never listed by Spark."""
    ids = spark.read.option("basePath", f"{path}/facts").text(f"{path}/facts").select("model_id").distinct().collect()
    return sorted(str(r["model_id"]) for r in ids)
