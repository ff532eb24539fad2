"""Single training steps with SQL equivalents, and whole training runs."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from catalog.frames import EVENTS_SQL, LINES_SQL, ORDERS_SQL, binary_lines, class_vectors, event_rows, labelled_vectors, order_rows
from catalog.registry import query, table
from catalog.scoring import FLAT_SQL, fixed_model
from treeline.functions.scores import sigmoid_probability
from treeline.operators import gradients as G
from treeline.operators import group_gradients as GG
from treeline.operators import histograms as H
from treeline.operators import routing
from treeline.operators.sketches import weighted_feature_bins
from treeline.plans.boosting import fit_boosted_trees
from treeline.plans.kfold import fit_kfold
from treeline.plans.linear import fit_linear, predict_linear
from treeline.plans.parameters import DEFAULTS
from treeline.plans.refresh import leaf_statistics, prune_trees, refresh_trees
from treeline.plans.resume import resume_fit, save_each_round
from treeline.plans.scoring import predict_trees
from treeline.session import scratch_path


@query("feature_bins", """WITH long AS (SELECT 0 AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT 1, l_extendedprice FROM lineitem
  UNION ALL SELECT 2, l_discount FROM lineitem UNION ALL SELECT 3, l_tax FROM lineitem),
m AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM long GROUP BY feature)
SELECT CAST(feature AS INT) AS feature, CAST(least(floor((v - lo) * 16.0::DOUBLE / (hi - lo)), 15) + 1 AS INT) AS bin, count(*) AS n
FROM long JOIN m USING (feature) GROUP BY ALL""")
def _bins(spark, sf):
    df = table(spark, sf, "lineitem").select(F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("features"))
    return H.equal_width_bins(df, 16)


@query("feature_bins_quantile", f"""WITH {ORDERS_SQL}, long AS (SELECT 0 AS feature, features[1] AS v FROM ords UNION ALL SELECT 1, features[2] FROM ords
  UNION ALL SELECT 2, features[4] FROM ords), m AS (SELECT feature, min(v) AS lo FROM long GROUP BY feature)
SELECT DISTINCT CAST(feature AS INT) AS feature, v AS cut FROM long JOIN m USING (feature) WHERE v > lo""")
def _quantiles(spark, sf):
    df = order_rows(spark, sf).select(F.array(F.col("features")[0], F.col("features")[1], F.col("features")[3]).alias("features"))
    return H.feature_bins(df, 1024).select("feature", F.explode("cuts").alias("cut"))


# Bins between weighted cuts: whole mass, and none of several values that holds over twice its share.
@query("feature_bins_weighted", f"""WITH {ORDERS_SQL}, long AS (SELECT unnest([0, 1, 2, 3]) AS feature, unnest(features) AS v, grade FROM ords)
SELECT CAST(feature AS INT) AS feature, CAST(sum(grade) AS DOUBLE) AS mass, CAST(sum(grade) AS DOUBLE) AS binned, least(count(DISTINCT v), 32) AS bins, true AS even
FROM long GROUP BY feature""")
def _weighted_bins(spark, sf):
    df = order_rows(spark, sf).withColumn("weight", F.col("grade").cast("double"))
    found = weighted_feature_bins(df, 32)
    long = df.select("weight", F.posexplode("features").alias("feature", "v")).join(F.broadcast(found), "feature")  # four lines of at most 32 cuts
    inside = long.groupBy("feature", "mass", F.size(F.filter("cuts", lambda c: c <= F.col("v"))).alias("bin"))
    share = inside.agg(F.sum("weight").alias("held"), (F.min("v") < F.max("v")).alias("several"))
    return share.groupBy("feature", "mass").agg(
        F.sum("held").alias("binned"), F.count(F.lit(1)).alias("bins"), F.every(~F.col("several") | (F.col("held") <= F.col("mass") / 16)).alias("even")
    )


# Objective, label, and the SQL for g and h at margin m.
ROW_OBJECTIVES = {
    "reg:squarederror": ("price", "m - y", "1.0"),
    "binary:logistic": ("label", "1 / (1 + exp(-m)) - y", "exp(-m) / ((1 + exp(-m)) * (1 + exp(-m)))"),
    "binary:hinge": ("label", "CASE WHEN m * (2 * y - 1) < 1 THEN 1 - 2 * y ELSE 0 END", "CASE WHEN m * (2 * y - 1) < 1 THEN 1 ELSE 0 END"),
    "count:poisson": ("grade", "exp(m) - y", "exp(m + 0.7)"),
    "reg:gamma": ("price", "1 - y * exp(-m)", "y * exp(-m)"),
    "reg:tweedie": ("price", "-y * exp(-0.5 * m) + exp(0.5 * m)", "0.5 * y * exp(-0.5 * m) + 0.5 * exp(0.5 * m)"),
    "reg:squaredlogerror": ("price", "(ln(1 + greatest(m, -1 + 1e-6)) - ln(1 + y)) / (greatest(m, -1 + 1e-6) + 1)",
                            "greatest((1 - (ln(1 + greatest(m, -1 + 1e-6)) - ln(1 + y))) / pow(greatest(m, -1 + 1e-6) + 1, 2), 1e-6)"),
    "reg:pseudohubererror": ("price", "(m - y) / sqrt(1 + (m - y) * (m - y))", "pow(1 + (m - y) * (m - y), -1.5)"),
    "reg:absoluteerror": ("price", "sign(m - y)", "1.0"),
}


def _pair_sql():
    parts = [
        f"SELECT '{o}' AS objective, slice, round(avg(w * ({g})), 6) AS mean_g, round(avg(w * ({h})), 6) AS mean_h, round(max(w * ({g})), 6) AS top_g "
        f"FROM (SELECT slice, weight AS w, score / 4.0::DOUBLE AS m, {y}::DOUBLE AS y FROM lines) GROUP BY slice"
        for o, (y, g, h) in ROW_OBJECTIVES.items()
    ]
    return f"WITH {LINES_SQL} " + " UNION ALL ".join(parts)


@query("gradient_pairs", _pair_sql())
def _gradients(spark, sf):
    rows = binary_lines(spark, sf).withColumn("m_0", F.expr("score / 4.0D")).withColumnRenamed("label", "class")
    out = None
    for objective, (label, _, _) in ROW_OBJECTIVES.items():
        named = rows.withColumn("label", F.col("class" if label == "label" else label))
        pairs = G.gradient_pairs(named, objective, {**DEFAULTS, "max_delta_step": 0.7})
        part = pairs.groupBy(F.lit(objective).alias("objective"), "slice").agg(
            F.round(F.avg("g_0"), 6).alias("mean_g"), F.round(F.avg("h_0"), 6).alias("mean_h"), F.round(F.max("g_0"), 6).alias("top_g")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("gradient_pairs_multiclass", """WITH v AS (SELECT vec_id AS row_id, label, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS s FROM embeddings),
e AS (SELECT *, list_transform(s, lambda x: exp(x)) AS q FROM v), p AS (SELECT *, list_transform(q, lambda x: x / list_sum(q)) AS p FROM e),
k AS (SELECT row_id, label, unnest(range(10)) AS class, unnest(p) AS p FROM p)
SELECT row_id, CAST(class AS INT) AS class, round(p - CAST(label = class AS INT), 6) AS g, round(2 * p * (1 - p), 6) AS h FROM k""")
def _multiclass(spark, sf):
    rows = class_vectors(spark, sf).select("row_id", "label", *[F.col("scores")[k].alias(f"m_{k}") for k in range(10)])
    pairs = G.gradient_pairs(rows, "multi:softprob", DEFAULTS, weight=None, margins=tuple(f"m_{k}" for k in range(10)))
    each = F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"g_{k}").alias("g"), F.col(f"h_{k}").alias("h")) for k in range(10)])
    return pairs.select("row_id", F.explode(each).alias("e")).select("row_id", "e.class", F.round("e.g", 6).alias("g"), F.round("e.h", 6).alias("h"))


@query("gradient_pairs_cox", f"""WITH {ORDERS_SQL}, r AS (SELECT row_id, label AS t, grade > 2 AS event, features[3] / 10 AS m FROM ords),
k AS (SELECT t, sum(exp(m)) AS e, sum(CAST(event AS INT)) AS d FROM r GROUP BY t),
a AS (SELECT t, d, sum(e) OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS risk FROM k),
z AS (SELECT t, sum(d / risk) OVER w AS hz, sum(d / (risk * risk)) OVER w AS hz2 FROM a WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT row_id, round(exp(m) * hz - CAST(event AS INT), 6) AS g, round(greatest(exp(m) * hz - exp(2 * m) * hz2, 1e-16), 6) AS h FROM r JOIN z USING (t)""")
def _cox(spark, sf):
    rows = order_rows(spark, sf).select(
        "row_id", F.when(F.col("grade") > 2, F.col("label")).otherwise(-F.col("label")).alias("label"),
        (F.col("features")[2] / 10).alias("m_0"), F.lit(1.0).alias("w"),
    )
    return GG.cox_gradients(rows).select("row_id", F.round("g_0", 6).alias("g"), F.round("h_0", 6).alias("h"))


def _rank_sql(objective):
    change = {
        "rank:pairwise": "1.0",
        "rank:ndcg": "abs((pow(2, hy) - pow(2, ly)) * (1 / log2(hr + 1) - 1 / log2(lr + 1))) / ideal",
        "rank:map": """CASE WHEN ly <= 0 THEN abs(CASE WHEN lr < hr THEN (lh + 1.0) / lr - hh / hr + (hb - lb)
          ELSE lh / lr - hh / hr - (lb - hb - hi) END) / relevant ELSE 0 END""",
    }[objective]
    return f"""WITH {ORDERS_SQL}, q AS (SELECT group_id, row_id, grade - 1 AS y, features[3] / 5 AS m FROM ords),
s AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY m DESC, y, row_id) AS rk,
  sum(CAST(y > 0 AS INT)) OVER (PARTITION BY group_id ORDER BY m DESC, y, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS hits,
  row_number() OVER (PARTITION BY group_id ORDER BY y, md5('0|' || row_id), row_id) - 1 AS pos,
  row_number() OVER (PARTITION BY group_id ORDER BY y DESC) AS best FROM q),
i AS (SELECT *, CASE WHEN y > 0 THEN 1.0::DOUBLE / rk ELSE 0 END AS inv FROM s),
f AS (SELECT *, coalesce(sum(inv) OVER (PARTITION BY group_id ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM i),
t AS (SELECT group_id, sum((pow(2, y) - 1) / log2(best + 1)) AS ideal, sum(CAST(y > 0 AS INT))::DOUBLE AS relevant FROM s GROUP BY ALL),
b AS (SELECT group_id, y, count(*) AS same FROM q GROUP BY ALL),
c AS (SELECT *, coalesce(sum(same) OVER (PARTITION BY group_id ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  sum(same) OVER (PARTITION BY group_id) AS size FROM b),
d AS (SELECT f.*, start, same, ('0x' || substr(md5('0|0|' || row_id || '|0'), 1, 8))::BIGINT % (size - same) AS r FROM f JOIN c USING (group_id, y) WHERE size > same),
j AS (SELECT d.group_id, CASE WHEN d.y > o.y THEN d ELSE o END AS hi_, CASE WHEN d.y > o.y THEN o ELSE d END AS lo_ FROM
  (SELECT group_id, y, r, start, same, {{'id': row_id, 'y': y, 'm': m, 'rk': rk, 'hits': hits, 'b': before, 'inv': inv}} AS d FROM d) d
  JOIN (SELECT group_id, y, pos, {{'id': row_id, 'y': y, 'm': m, 'rk': rk, 'hits': hits, 'b': before, 'inv': inv}} AS o FROM f) o
  ON o.group_id = d.group_id AND o.pos = CASE WHEN r < start THEN r ELSE r + same END),
u AS (SELECT group_id, hi_.id AS hid, lo_.id AS lid, hi_.y AS hy, lo_.y AS ly, hi_.m AS hm, lo_.m AS lm, hi_.rk AS hr, lo_.rk AS lr,
  hi_.hits AS hh, lo_.hits AS lh, hi_.b AS hb, lo_.b AS lb, hi_.inv AS hi FROM j),
x AS (SELECT *, 0.5 * (1 + tanh(0.5 * (hm - lm))) AS p, {change} AS change FROM u JOIN t USING (group_id)),
g AS (SELECT hid AS row_id, (p - 1) * change AS g, greatest(2 * p * (1 - p) * change, 1e-16) AS h FROM x
  UNION ALL SELECT lid, (1 - p) * change, greatest(2 * p * (1 - p) * change, 1e-16) FROM x)
SELECT row_id, round(coalesce(sum(g), 0), 6) AS g, round(coalesce(sum(h), 0), 6) AS h FROM q LEFT JOIN g USING (row_id) GROUP BY row_id"""


def _rank(name, objective):
    def run(spark, sf):
        rows = order_rows(spark, sf).select(
            "group_id", "row_id", (F.col("grade") - 1).alias("label"), (F.col("features")[2] / 5).alias("m_0"), F.lit(1.0).alias("w")
        )
        out = GG.ranking_gradients(rows, objective, DEFAULTS)
        return out.select("row_id", F.round("g_0", 6).alias("g"), F.round("h_0", 6).alias("h"))

    query(name, _rank_sql(objective))(run)


_rank("gradient_pairs_rank_pairwise", "rank:pairwise")
_rank("gradient_pairs_rank_ndcg", "rank:ndcg")
_rank("gradient_pairs_rank_map", "rank:map")


def _binned(spark, sf):
    """lineitem rows in two nodes with three binned features (0 = missing) and logistic gradients."""
    df = table(spark, sf, "lineitem")
    p = sigmoid_probability(F.expr("(l_quantity - 25.0D) / 20.0D"))
    y = (F.col("l_returnflag") == "R").cast("double")
    bins = F.array(
        F.expr("cast(floor(l_quantity / 5) + 1 as short)"), F.expr("cast(floor(l_discount * 100 + 0.5) + 1 as short)"),
        F.expr("cast(case when l_linenumber = 7 then 0 else l_linenumber end as short)"),
    )
    return df.select(
        F.lit(0).alias("tree"), F.expr("cast(l_linestatus = 'F' as int)").alias("node"), (p - y).alias("g"), (p * (1 - p)).alias("h"), bins.alias("bins")
    )


BINNED_SQL = """rows_ AS (SELECT 0 AS tree, CAST(l_linestatus = 'F' AS INT) AS node, 0.5 * (1 + tanh(0.5 * ((l_quantity - 25.0) / 20.0))) AS p,
  CAST(l_returnflag = 'R' AS INT) AS y, CAST(floor(l_quantity / 5) + 1 AS INT) AS b0, CAST(floor(l_discount * 100 + 0.5) + 1 AS INT) AS b1,
  CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber END AS b2 FROM lineitem),
gh AS (SELECT tree, node, CAST(floor((p - y) * 1048576 + 0.5) AS BIGINT) AS g, CAST(floor(p * (1 - p) * 1048576 + 0.5) AS BIGINT) AS h, b0, b1, b2 FROM rows_),
long AS (SELECT tree, node, g, h, 0 AS feature, b0 AS bin FROM gh UNION ALL SELECT tree, node, g, h, 1, b1 FROM gh UNION ALL SELECT tree, node, g, h, 2, b2 FROM gh),
hist AS (SELECT tree, node, feature, bin, CAST(sum(g) AS BIGINT) AS sg, CAST(sum(h) AS BIGINT) AS sh, count(*) AS n FROM long GROUP BY ALL)"""


@query("node_histogram", f"WITH {BINNED_SQL} SELECT tree, node, feature, bin, sg, sh, n FROM hist")
def _histogram(spark, sf):
    return H.node_histogram(_binned(spark, sf))


STEP = {**DEFAULTS, "gamma": 0.0, "lambda": 1.0, "alpha": 0.5, "min_child_weight": 1.0}
BEST_SQL = f"""WITH {BINNED_SQL}, t AS (SELECT node, feature, sum(sg) / 1048576.0 AS gt, sum(sh) / 1048576.0 AS ht, sum(n) AS nt FROM hist GROUP BY ALL),
miss AS (SELECT node, feature, sum(sg) / 1048576.0 AS gm, sum(sh) / 1048576.0 AS hm FROM hist WHERE bin = 0 GROUP BY ALL),
c AS (SELECT node, feature, bin, sum(sg) OVER w / 1048576.0 AS gl, sum(sh) OVER w / 1048576.0 AS hl FROM hist WHERE bin > 0
  WINDOW w AS (PARTITION BY node, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT c.node, c.feature, bin, d, gl + CASE WHEN d = 1 THEN gm ELSE 0 END AS gl, hl + CASE WHEN d = 1 THEN hm ELSE 0 END AS hl, gt, ht
  FROM c JOIN t USING (node, feature) LEFT JOIN miss USING (node, feature), (SELECT unnest([0, 1]) AS d) WHERE d = 0 OR gm IS NOT NULL),
s AS (SELECT *, gt - gl AS gr, ht - hl AS hr, sign(gl) * greatest(abs(gl) - 0.5, 0) AS tl, sign(gt - gl) * greatest(abs(gt - gl) - 0.5, 0) AS tr,
  sign(gt) * greatest(abs(gt) - 0.5, 0) AS tt FROM k),
v AS (SELECT *, 0.5 * (tl * tl / (hl + 1) + tr * tr / (hr + 1) - tt * tt / (ht + 1)) AS gain FROM s WHERE hl >= 1 AND hr >= 1),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin, d) AS rk FROM v)
SELECT 0 AS tree, node, feature, bin, d = 1 AS default_left, round(gain, 6) AS gain, round(-tl / (hl + 1), 6) AS wl, round(-tr / (hr + 1), 6) AS wr FROM r WHERE rk = 1"""


@query("best_split", BEST_SQL)
def _best(spark, sf):
    out = H.best_split(H.node_histogram(_binned(spark, sf)), STEP)
    return out.select("tree", "node", "feature", "bin", "default_left", *[F.round(c, 6).alias(c) for c in ("gain", "wl", "wr")])


@query("assign_nodes", f"""WITH {FLAT_SQL} SELECT row_id, CAST(CASE WHEN f0 < 3 THEN CASE WHEN f3 < 12 THEN 3 ELSE 4 END ELSE 2 END AS INT) AS node FROM x""")
def _assign(spark, sf):
    tree = fixed_model().trees[0][0]
    tree.bin = [2 if f == 0 else 12 for f in tree.feature]
    cuts = [[2.0, 3.0, 4.0, 5.0], [], [], [float(v) for v in range(1, 25)]]
    binned = H.bin_features(order_rows(spark, sf).select("row_id", "features"), cuts)
    return routing.route(binned, [tree], ["node"], True, "bins").select("row_id", "node")


@query("leaf_weights", f"""WITH {BINNED_SQL}, s AS (SELECT tree, node, sum(p - y) AS g, sum(p * (1 - p)) AS h, count(*) AS n FROM rows_ GROUP BY ALL)
SELECT tree, node, round(g, 4) AS g, round(h, 4) AS h, n, round(-sign(g) * greatest(abs(g) - 0.5, 0) / (h + 1) * 0.3, 6) AS weight FROM s""")
def _leaves(spark, sf):
    out = H.leaf_weights(_binned(spark, sf), STEP)
    return out.select("tree", "node", F.round("g", 4).alias("g"), F.round("h", 4).alias("h"), "n", F.round("weight", 6).alias("weight"))


def _priced(spark, sf):
    """Orders with three features of few distinct values, so that every value is a cut point, and weights."""
    df = order_rows(spark, sf)
    return df.select(
        "row_id", "label", F.col("grade").cast("double").alias("weight"), F.array(F.col("features")[0], F.col("features")[1], F.col("features")[3]).alias("features")
    )


# One round of depth one with weights: the best border of all features and the two leaf values.
STUMP_SQL = f"""{ORDERS_SQL}, x AS (SELECT row_id, label, grade AS w, [features[1], features[2], features[4]] AS f FROM ords),
long AS (SELECT unnest([0, 1, 2]) AS feature, unnest(f) AS v, w * (0.5 - label) AS g, w AS h FROM x),
a AS (SELECT feature, v, sum(g) AS g, sum(h) AS h FROM long GROUP BY ALL),
c AS (SELECT feature, v, coalesce(sum(g) OVER w, 0) AS gl, coalesce(sum(h) OVER w, 0) AS hl FROM a
  WINDOW w AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT sum(w * (0.5 - label)) AS gt, sum(w) AS ht FROM x),
ranked AS (SELECT *, row_number() OVER (ORDER BY gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) DESC, feature, v) AS rk FROM c, t WHERE hl > 0 AND ht - hl > 0),
best AS (SELECT feature, v, -0.3 * gl / (hl + 1) AS left_value, -0.3 * (gt - gl) / (ht - hl + 1) AS right_value FROM ranked WHERE rk = 1),
stump AS (SELECT row_id, label, w, 0.5 + CASE WHEN f[feature + 1] < v THEN left_value ELSE right_value END AS prediction FROM x, best)"""
STUMP = {"num_round": 1, "max_depth": 1, "max_bin": 1024, "min_child_weight": 0}


@query("fit_with_weights", f"WITH {STUMP_SQL} SELECT row_id, round(prediction, 6) AS prediction FROM stump")
def _weighted(spark, sf):
    df = _priced(spark, sf)
    model = fit_boosted_trees(df, STUMP)
    return predict_trees(df, model).select("row_id", F.round("prediction", 6).alias("prediction"))


# The same for sparse rows: absent entries go to either side, and one more border has all present values on its left.
SPARSE_SQL = """WITH o AS (SELECT l_orderkey AS row_id, sum(l_extendedprice) / 100000.0::DOUBLE AS label FROM lineitem GROUP BY 1),
e AS (SELECT l_orderkey AS row_id, l_partkey % 300 AS feature, max(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL),
t AS (SELECT sum(0.5 - label) AS gt, count(*) AS ht FROM o),
a AS (SELECT feature, v, sum(0.5 - label) AS g, count(*) AS h FROM e JOIN o USING (row_id) GROUP BY ALL
  UNION ALL SELECT feature, 'infinity'::DOUBLE, 0, 0 FROM e GROUP BY feature),
c AS (SELECT feature, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER f AS gp, sum(h) OVER f AS hp FROM a
  WINDOW w AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY feature)),
k AS (SELECT feature, v, d, gl + d * (gt - gp) AS gl, hl + d * (ht - hp) AS hl, gt, ht FROM c, t, (SELECT unnest([0, 1]) AS d) WHERE hl > 0 AND (d = 0 OR ht > hp)),
best AS (SELECT *, -0.3 * gl / (hl + 1) AS left_value, -0.3 * (gt - gl) / (ht - hl + 1) AS right_value FROM k WHERE ht > hl
  ORDER BY gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) DESC, feature, v, d LIMIT 1)
SELECT o.row_id, round(0.5 + CASE WHEN coalesce(e.v < best.v, d = 1) THEN left_value ELSE right_value END, 6) AS prediction
FROM o CROSS JOIN best LEFT JOIN e ON e.row_id = o.row_id AND e.feature = best.feature"""


@query("fit_sparse", SPARSE_SQL)
def _sparse(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", F.expr("cast(l_partkey % 300 AS int)").alias("k")).agg(
        F.max("l_quantity").cast("double").alias("v"), F.sum("l_extendedprice").alias("price")
    )
    rows = lines.groupBy(F.col("l_orderkey").alias("row_id")).agg(
        (F.sum("price") / 100000.0).alias("label"), F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("features")
    )
    model = fit_boosted_trees(rows, STUMP)
    return predict_trees(rows, model).select("row_id", F.round("prediction", 6).alias("prediction"))


@query("leaf_statistics", f"""WITH {FLAT_SQL}, l AS (SELECT 0 AS tree, CASE WHEN f0 < 3 THEN CASE WHEN f3 < 12 THEN 3 ELSE 4 END ELSE 2 END AS leaf, label FROM x
  UNION ALL SELECT 1, CASE WHEN f2 < 4.5 THEN 1 WHEN f1 < 50 THEN 3 ELSE 4 END, label FROM x)
SELECT CAST(tree AS INT) AS tree, CAST(leaf AS INT) AS leaf, count(*) AS n, round(-sum(0.5 - label) / (count(*) + 1) * 0.3, 6) AS weight FROM l GROUP BY ALL""")
def _leaf_statistics(spark, sf):
    out = leaf_statistics(order_rows(spark, sf), fixed_model(), DEFAULTS)
    return out.select("tree", "leaf", "n", F.round("weight", 6).alias("weight"))


REFRESH_SQL = f"""{FLAT_SQL},
l AS (SELECT label, CASE WHEN f0 < 3 THEN CASE WHEN f3 < 12 THEN 3 ELSE 4 END ELSE 2 END AS one,
  CASE WHEN f2 < 4.5 THEN 1 WHEN f1 < 50 THEN 3 ELSE 4 END AS two FROM x),
w AS (SELECT one, sum(0.5 - label) AS g, count(*) AS h FROM l GROUP BY 1),
v AS (SELECT one, -sign(g) * greatest(abs(g) - 2, 0) / (h + 1) * 0.3 AS value FROM w),
u AS (SELECT two, sum(0.5 + value - label) AS g, count(*) AS h FROM l JOIN v USING (one) GROUP BY 1),
both_rounds AS (SELECT 0 AS tree, one AS leaf, value FROM v UNION ALL SELECT 1, two, -sign(g) * greatest(abs(g) - 2, 0) / (h + 1) * 0.3 FROM u)"""


def _refreshed(spark, sf):
    return refresh_trees(order_rows(spark, sf), fixed_model(), {**DEFAULTS, "alpha": 2.0})


@query("refresh_trees", f"WITH {REFRESH_SQL} SELECT CAST(tree AS INT) AS tree, CAST(leaf AS INT) AS leaf, round(value, 6) AS value FROM both_rounds")
def _refresh(spark, sf):
    model = _refreshed(spark, sf)
    leaves = [(r, n, t.value[n]) for r, trees in enumerate(model.trees) for t in trees for n in range(len(t.feature)) if t.feature[n] < 0]
    return spark.createDataFrame(leaves, "tree int, leaf int, value double").withColumn("value", F.round("value", 6))


@query("prune_trees", "SELECT CAST(range AS INT) AS tree, CAST(1 AS BIGINT) AS nodes_left FROM range(2)")
def _prune(spark, sf):
    model = prune_trees(_refreshed(spark, sf), 1e18)

    def reached(tree, n=0):
        return 1 if tree.feature[n] < 0 else 1 + reached(tree, tree.left[n]) + reached(tree, tree.right[n])

    return spark.createDataFrame([(r, reached(t)) for r, trees in enumerate(model.trees) for t in trees], "tree int, nodes_left long")


def _purchases(spark, sf):
    return event_rows(spark, sf).select("row_id", "label", "weight", "features")


def _log(spark, model):
    return model.log_frame(spark).select("round", "fold", "data_name", "metric", F.round("value", 6).alias("value"))


@query("fit_boosted_trees")
def _fit(spark, sf):
    df = _purchases(spark, sf)
    model = fit_boosted_trees(df, {"objective": "binary:logistic", "num_round": 3, "max_depth": 3, "max_bin": 64})
    return predict_trees(df, model).select("row_id", F.round("prediction", 6).alias("prediction"))


@query("evaluation_log", f"""WITH {STUMP_SQL}, e AS (SELECT 'train' AS data_name, * FROM stump UNION ALL SELECT 'low_priority', * FROM stump WHERE w > 3)
SELECT CAST(0 AS INT) AS round, data_name, 'rmse' AS metric, round(sqrt(avg((label - prediction) * (label - prediction))), 6) AS value FROM e GROUP BY data_name
UNION ALL SELECT 0, data_name, 'mae', round(avg(abs(label - prediction)), 6) FROM e GROUP BY data_name""")
def _evaluation_log(spark, sf):
    df = _priced(spark, sf)
    model = fit_boosted_trees(df, {**STUMP, "eval_metric": "rmse,mae"}, watch={"low_priority": df.where("weight > 3")})
    return _log(spark, model).drop("fold")


@query("fit_multiclass")
def _fit_multiclass(spark, sf):
    df = labelled_vectors(spark, sf)
    params = {"objective": "multi:softprob", "num_class": 10, "num_round": 2, "max_depth": 2, "max_bin": 16, "eval_metric": "mlogloss,merror"}
    return _log(spark, fit_boosted_trees(df, params))


def _properties(spark, **holds):
    """Statements about a trained model, one row each; the SQL says that all of them hold."""
    return spark.createDataFrame([(name, bool(value)) for name, value in holds.items()], "property string, holds boolean")


def _true(*names):
    return " UNION ALL ".join(f"SELECT '{n}' AS property, true AS holds" for n in names)


def _series(model, metric):
    return [value for _, _, name, m, value in model.log if (name, m) == ("train", metric)]


def _rising(spark, model, feature, rows, sign):
    """Whether predictions never move against ``sign`` as one feature grows over its range, at the features of some row."""
    low, high = rows.agg(F.min(F.col("features")[feature]), F.max(F.col("features")[feature])).first()
    row = rows.orderBy("row_id").first()["features"]
    grid = spark.range(41).select("id", F.array(*[(F.lit(low) + (high - low) * F.col("id") / 40.0) if i == feature else F.lit(v) for i, v in enumerate(row)]).alias("features"))
    curve = [r["prediction"] for r in predict_trees(grid, model).orderBy("id").collect()]
    return all(sign * (b - a) >= -1e-12 for a, b in zip(curve, curve[1:]))


@query("fit_monotone", _true("rises with feature 0", "falls with feature 1", "loss falls"))
def _fit_monotone(spark, sf):
    params = {"num_round": 2, "max_depth": 3, "max_bin": 32, "tree_method": "hist", "monotone_constraints": "(1,-1,0,0)", "eval_metric": "rmse"}
    rows = order_rows(spark, sf)
    model = fit_boosted_trees(rows, params)
    up, down, loss = _rising(spark, model, 0, rows, 1), _rising(spark, model, 1, rows, -1), _series(model, "rmse")
    return _properties(spark, **{"rises with feature 0": up, "falls with feature 1": down, "loss falls": loss[-1] <= loss[0]})


@query("fit_interaction", _true("no path mixes the groups", "trees have splits"))
def _fit_interaction(spark, sf):
    params = {"num_round": 2, "max_depth": 3, "max_bin": 32, "tree_method": "hist", "interaction_constraints": "[[1,2],[3]]"}
    trees = [t for trees in fit_boosted_trees(order_rows(spark, sf), params).trees for t in trees]
    apart = all(path <= {1, 2} or path <= {3} or len(path) <= 1 for t in trees for path in t.path)
    return _properties(spark, **{"no path mixes the groups": apart, "trees have splits": all(max(t.feature) >= 0 for t in trees)})


@query("fit_dart", _true("log equals scoring", "labels of 1e8 train"))
def _fit_dart(spark, sf):
    params = {"booster": "dart", "num_round": 3, "max_depth": 2, "max_bin": 32, "rate_drop": 0.5, "one_drop": 1, "eval_metric": "rmse"}
    rows = order_rows(spark, sf)
    model = fit_boosted_trees(rows, params)
    error = predict_trees(rows, model).agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))).first()[0]
    large = fit_boosted_trees(rows.withColumn("label", F.col("label") * 1e8), params)
    return _properties(spark, **{"log equals scoring": abs(error - _series(model, "rmse")[-1]) < 1e-6 * max(error, 1.0), "labels of 1e8 train": len(large.trees) == 3})


@query("fit_ranking", _true("ndcg does not fall"))
def _fit_ranking(spark, sf):
    df = order_rows(spark, sf).withColumn("label", F.col("grade") - 1)
    params = {"objective": "rank:ndcg", "num_round": 2, "max_depth": 2, "max_bin": 32, "eval_metric": "ndcg"}
    score = _series(fit_boosted_trees(df, params), "ndcg")
    return _properties(spark, **{"ndcg does not fall": score[-1] >= score[0]})


@query("fit_cox", _true("loss falls"))
def _fit_cox(spark, sf):
    df = order_rows(spark, sf).withColumn("label", F.when(F.col("grade") > 2, F.col("label")).otherwise(-F.col("label")))
    loss = _series(fit_boosted_trees(df, {"objective": "survival:cox", "num_round": 2, "max_depth": 2, "max_bin": 32}), "cox-nloglik")
    return _properties(spark, **{"loss falls": loss[-1] <= loss[0]})


@query("fit_aft", _true("loss falls"))
def _fit_aft(spark, sf):
    df = order_rows(spark, sf).withColumn("label_lower", F.col("label"))
    df = df.withColumn("label_upper", F.when(F.col("grade") > 2, F.col("label")))
    params = {"objective": "survival:aft", "num_round": 2, "max_depth": 2, "max_bin": 32, "aft_loss_distribution": "logistic"}
    loss = _series(fit_boosted_trees(df, params), "aft-nloglik")
    return _properties(spark, **{"loss falls": loss[-1] <= loss[0]})


def _determinant(entries: list[list[str]]) -> str:
    """A determinant as SQL, by its permutations."""
    terms = []
    for order in itertools.permutations(range(len(entries))):
        turns = sum(a > b for a, b in itertools.combinations(order, 2))
        terms.append(("-" if turns % 2 else "") + " * ".join(entries[i][j] for i, j in enumerate(order)))
    return "(" + " + ".join(terms) + ")"


def _ridge_sql(penalty: float) -> str:
    """The closed form over all four features: centred moments, the penalty on their diagonal, Cramer's rule."""
    n = range(4)
    moments = [f"covar_pop(x{i}, x{j}) AS c{i}{j}" for i in n for j in n if i <= j] + [f"covar_pop(x{i}, y) AS d{i}" for i in n]
    square = [[f"c{min(i, j)}{max(i, j)}" if i != j else f"(c{i}{i} + {penalty}::DOUBLE)" for j in n] for i in n]
    solved = [f"{_determinant([[f'd{i}' if j == k else square[i][j] for j in n] for i in n])} / {_determinant(square)} AS b{k}" for k in n]
    return f"""WITH {ORDERS_SQL}, x AS (SELECT row_id, label AS y, {", ".join(f"features[{i + 1}] AS x{i}" for i in n)} FROM ords),
m AS (SELECT {", ".join(moments)}, avg(y) AS my, {", ".join(f"avg(x{i}) AS a{i}" for i in n)} FROM x),
b AS (SELECT *, {", ".join(solved)} FROM m)
SELECT row_id, round(my + {" + ".join(f"b{i} * (x{i} - a{i})" for i in n)}, 4) AS prediction FROM x, b"""


@query("fit_linear", _ridge_sql(0.25))
def _fit_linear(spark, sf):
    df = order_rows(spark, sf).select("row_id", "label", "features")
    model = fit_linear(df, {"num_round": 1000, "eta": 1.0, "lambda": 0.25})
    return predict_linear(df, model).select("row_id", F.round("prediction", 4).alias("prediction"))


# With one indicator as feature the fitted means are the means of both sides.
@query("fit_linear_objectives", f"""WITH {LINES_SQL}, sides AS (SELECT slice, sum(weight * grade) / sum(weight) AS poisson, sum(weight * price) / sum(weight) AS gamma,
  sum(weight * label) / sum(weight) AS logistic FROM lines GROUP BY slice)
SELECT 'count:poisson' AS objective, slice, round(poisson, 4) AS mean FROM sides UNION ALL SELECT 'reg:gamma', slice, round(gamma, 4) FROM sides
UNION ALL SELECT 'binary:logistic', slice, round(logistic, 4) FROM sides""")
def _fit_linear_objectives(spark, sf):
    lines = binary_lines(spark, sf).withColumn("features", F.array(F.when(F.col("slice") == "F", 1.0).otherwise(-1.0)))
    out = None
    for objective, label in (("count:poisson", "grade"), ("reg:gamma", "price"), ("binary:logistic", "label")):
        rows = lines.select("slice", "weight", "features", F.col(label).cast("double").alias("label"))
        model = fit_linear(rows, {"objective": objective, "num_round": 12, "eta": 1.0, "max_delta_step": 0.1})
        sides = predict_linear(lines.select("slice", "features").distinct(), model, "mean")
        part = sides.select(F.lit(objective).alias("objective"), "slice", F.round("mean", 4).alias("mean"))
        out = part if out is None else out.unionByName(part)
    return out


@query("fit_kfold", f"""WITH {EVENTS_SQL}, f AS (SELECT row_id, label,
  (row_number() OVER (ORDER BY label, md5('0|0|' || row_id), row_id) - 1) % 2 AS fold FROM evs)
SELECT CAST(0 AS INT) AS repeat, CAST(fold AS INT) AS fold, count(*) AS n, sum(label) AS positives, true AS in_range FROM f GROUP BY fold""")
def _fit_kfold(spark, sf):
    params = {"objective": "binary:logistic", "num_round": 1, "max_depth": 2, "max_bin": 32, "_kfold": 2, "_num_cv_round": 1}
    out = fit_kfold(_purchases(spark, sf), params).predictions
    return out.groupBy("repeat", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("positives"), F.every((F.col("prob") > 0) & (F.col("prob") < 1)).alias("in_range")
    )


@query("resume_fit", f"WITH {STUMP_SQL} SELECT row_id, round(prediction, 6) AS prediction FROM stump")
def _resume(spark, sf):
    path = scratch_path(spark, "checkpoints")
    df = _priced(spark, sf)
    resume_fit(df, STUMP, path)
    return predict_trees(df, resume_fit(df, STUMP, path)).select("row_id", F.round("prediction", 6).alias("prediction"))


@query("save_each_round", f"""WITH {STUMP_SQL} SELECT CAST(0 AS INT) AS node, feature, v AS split, CAST(NULL AS DOUBLE) AS leaf FROM best
  UNION ALL SELECT 1, -1, NULL, round(left_value, 6) FROM best UNION ALL SELECT 2, -1, NULL, round(right_value, 6) FROM best""")
def _each_round(spark, sf):
    path = scratch_path(spark, "rounds")
    fit_boosted_trees(_priced(spark, sf), STUMP, on_round=save_each_round(spark, path))
    nodes = spark.read.parquet(f"{path}/checkpoint.0/nodes")
    return nodes.select("node", "feature", "split", F.round("leaf", 6).alias("leaf"))
