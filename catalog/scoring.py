"""Scoring with a small fixed tree set, ensembles, selected outputs and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.frames import EVENTS_SQL, ORDERS_SQL, VECTORS_SQL, class_vectors, event_rows, order_rows
from catalog.registry import query, table
from catalog.sources import csv_bodies
from treeline.functions.scores import softmax
from treeline.operators import encoding as E
from treeline.operators import ensembles, selection
from treeline.operators.hooks import score_with_user_hooks
from treeline.operators.routing import Tree
from treeline.plans.model import Model, load_model, load_models, save_model
from treeline.plans.scoring import predict_contribs, predict_ensemble, predict_leaf, predict_trees
from treeline.plans.transform import batch_transform
from treeline.session import scratch_path
from treeline.streaming.scoring import request_stream, stream_score


def _tree(splits, leaves) -> Tree:
    """A tree from ``node: (feature, split, default_left)`` and ``node: value``; children of n are 2n+1 and 2n+2."""
    t = Tree()
    for node in sorted(splits):
        f, split, default = splits[node]
        left, right = t.add_children(node)
        t.feature[node], t.split[node], t.default_left[node] = f, split, default
    for node, value in leaves.items():
        t.value[node] = value
    for node in sorted(splits, reverse=True):
        t.value[node] = (t.value[t.left[node]] + t.value[t.right[node]]) / 2
    return t


def fixed_model(objective="reg:squarederror", flip=False) -> Model:
    sign = -1.0 if flip else 1.0
    one = _tree({0: (0, 3.0, True), 1: (3, 12.0, False)}, {2: 0.5 * sign, 3: -0.25, 4: 0.75})
    two = _tree({0: (2, 4.5, False), 2: (1, 50.0, True)}, {1: -0.5 * sign, 3: 0.25, 4: 1.0})
    return Model(objective, {"eta": 0.3, "lambda": 1.0, "alpha": 0.0, "max_delta_step": 0.0}, 0.5, 4, 1, [[one], [two]])


def _tree_sql(flip=False):
    s = "-" if flip else ""
    return f"""(0.5 + CASE WHEN f0 < 3 THEN CASE WHEN f3 < 12 THEN -0.25 ELSE 0.75 END ELSE {s}0.5 END
  + CASE WHEN f2 < 4.5 THEN {'' if flip else '-'}0.5 WHEN f1 < 50 THEN 0.25 ELSE 1.0 END)::DOUBLE"""


FLAT_SQL = f"{ORDERS_SQL}, x AS (SELECT *, features[1] AS f0, features[2] AS f1, features[3] AS f2, features[4] AS f3 FROM ords)"


@query("predict_trees", f"WITH {FLAT_SQL} SELECT row_id, {_tree_sql()} AS prediction FROM x")
def _predict(spark, sf):
    return predict_trees(order_rows(spark, sf), fixed_model()).select("row_id", "prediction")


@query("predict_leaf", f"""WITH {FLAT_SQL} SELECT row_id,
  CAST(CASE WHEN f0 < 3 THEN CASE WHEN f3 < 12 THEN 3 ELSE 4 END ELSE 2 END AS INT) AS leaf_0,
  CAST(CASE WHEN f2 < 4.5 THEN 1 WHEN f1 < 50 THEN 3 ELSE 4 END AS INT) AS leaf_1 FROM x""")
def _leaf(spark, sf):
    out = predict_leaf(order_rows(spark, sf), fixed_model())
    return out.select("row_id", F.col("leaves")[0].alias("leaf_0"), F.col("leaves")[1].alias("leaf_1"))


@query("predict_contribs", f"""WITH {FLAT_SQL} SELECT row_id, (0.5 + 0.375 + 0.0625)::DOUBLE AS bias, {_tree_sql()} AS total,
  CAST(CASE WHEN f0 < 3 THEN 0.25 - 0.375 ELSE 0.5 - 0.375 END AS DOUBLE) AS c0 FROM x""")
def _contribs(spark, sf):
    out = predict_contribs(order_rows(spark, sf), fixed_model(), method="path")
    total = F.aggregate("contribs", F.lit(0.0), lambda a, b: a + b)
    return out.select("row_id", F.col("contribs")[4].alias("bias"), total.alias("total"), F.col("contribs")[0].alias("c0"))


# The subset formula for two trees of two features each: e_S is the mean of a tree by cover when only S is known.
SHAPLEY_SQL = f"""WITH {FLAT_SQL}, s AS (SELECT row_id,
  0.4 * 0.5 + 0.2 * -0.25 + 0.4 * 0.75 AS a, CASE WHEN f0 < 3 THEN 2.5 / 6.0::DOUBLE ELSE 0.5 END AS a0,
  0.4 * 0.5 + 0.6 * CASE WHEN f3 < 12 THEN -0.25 ELSE 0.75 END AS a3, CASE WHEN f0 < 3 THEN CASE WHEN f3 < 12 THEN -0.25 ELSE 0.75 END ELSE 0.5 END AS a03,
  0.375 * -0.5 + 0.125 * 0.25 + 0.5 * 1.0 AS b, CASE WHEN f2 < 4.5 THEN -0.5 ELSE 0.85 END AS b2,
  0.375 * -0.5 + 0.625 * CASE WHEN f1 < 50 THEN 0.25 ELSE 1.0 END AS b1, CASE WHEN f2 < 4.5 THEN -0.5 WHEN f1 < 50 THEN 0.25 ELSE 1.0 END AS b12 FROM x)
SELECT row_id, round((a0 - a + a03 - a3) / 2, 6)::DOUBLE AS c0, round((b1 - b + b12 - b2) / 2, 6)::DOUBLE AS c1, round((b2 - b + b12 - b1) / 2, 6)::DOUBLE AS c2,
  round((a3 - a + a03 - a0) / 2, 6)::DOUBLE AS c3, round(0.5 + a + b, 6)::DOUBLE AS bias, round(0.5 + a03 + b12, 6)::DOUBLE AS total FROM s"""


@query("predict_contribs_shapley", SHAPLEY_SQL)
def _shapley(spark, sf):
    model = fixed_model()
    model.trees[0][0].cover, model.trees[1][0].cover = [10.0, 6.0, 4.0, 2.0, 4.0], [8.0, 3.0, 5.0, 1.0, 4.0]
    out = predict_contribs(order_rows(spark, sf), model)
    each = [F.round(F.col("contribs")[i], 6).alias(n) for i, n in enumerate(("c0", "c1", "c2", "c3", "bias"))]
    return out.select("row_id", *each, F.round(F.aggregate("contribs", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


def _together(spark, sf, objective):
    members = [fixed_model(objective, flip) for flip in (False, True, False)]
    return predict_ensemble(order_rows(spark, sf), members).select("row_id", F.round("prediction", 6).alias("prediction"))


def _members(spark, sf, objective="reg:squarederror"):
    rows = order_rows(spark, sf)
    parts = [
        predict_trees(rows, fixed_model(objective, flip)).select("row_id", F.lit(name).alias("model_id"), "prediction")
        for name, flip in (("model-0", False), ("model-1", True), ("model-2", False))
    ]
    return ensembles.choose_models(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("ensemble_mean", f"WITH {FLAT_SQL} SELECT row_id, round((2 * {_tree_sql()} + {_tree_sql(True)}) / 3, 6) AS prediction FROM x")
def _mean(spark, sf):
    return _together(spark, sf, "reg:squarederror")


@query("ensemble_vote", f"WITH {FLAT_SQL} SELECT row_id, CASE WHEN {_tree_sql()} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM x")
def _vote(spark, sf):
    return _together(spark, sf, "binary:hinge")


@query("combine_models", f"WITH {FLAT_SQL} SELECT row_id, round((2 * {_tree_sql()} + {_tree_sql(True)}) / 3, 6) AS prediction FROM x")
def _combined(spark, sf):
    out = ensembles.combine_models(_members(spark, sf), "reg:squarederror")
    return out.select("row_id", F.round("prediction", 6).alias("prediction"))


SOFT_SQL = f"""{VECTORS_SQL}, e AS (SELECT row_id, list_transform(scores, lambda v: exp(v - list_max(scores))) AS q FROM vectors),
p AS (SELECT row_id, list_transform(q, lambda v: v / list_sum(q)) AS p FROM e)"""


def _soft(spark, sf):
    df = class_vectors(spark, sf)
    return df.select("row_id", F.array(*softmax([F.col("scores")[i] for i in range(10)])).alias("prediction"))


def _joined(column):
    return F.array_join(F.transform(column, lambda v: F.format_string("%.6f", v)), ",")


def _list_sql(items):
    return f"array_to_string(list_transform({items}, lambda v: printf('%.6f', v)), ',')"


BIN_SQL = f"{EVENTS_SQL}, b AS (SELECT row_id, score AS s FROM evs)"


def _select_pair(key, fn, soft_expr, binary_expr, as_text=False):
    """Softprob over embeddings and logistic over events side by side."""
    text = f"""WITH {SOFT_SQL}, {BIN_SQL} SELECT row_id, 'softprob' AS kind, {soft_expr} AS value FROM p
      UNION ALL SELECT row_id, 'logistic', {binary_expr} FROM b"""

    def run(spark, sf):
        wrap = _joined if as_text else (lambda c: F.round(c.cast("double"), 6))
        soft = _soft(spark, sf).select("row_id", F.lit("softprob").alias("kind"), wrap(fn("multi:softprob", F.col("prediction"))).alias("value"))
        binary = event_rows(spark, sf).select("row_id", F.lit("logistic").alias("kind"), wrap(fn("binary:logistic", F.col("score"))).alias("value"))
        return soft.unionByName(binary)

    query(key, text)(run)


_select_pair("select_predicted_label", selection.select_predicted_label, "(list_position(p, list_max(p)) - 1)::DOUBLE", "CAST(s > 0.5 AS INT)::DOUBLE")
_select_pair("select_probability", selection.select_probability, "round(list_max(p), 6)", "round(s, 6)")
_select_pair("select_probabilities", selection.select_probabilities, _list_sql("p"), _list_sql("[1 - s, s]"), True)
_select_pair("select_raw_score", selection.select_raw_score, "round(list_max(p), 6)", "round(s, 6)")
_select_pair("select_raw_scores", selection.select_raw_scores, _list_sql("p"), _list_sql("[1 - s, s]"), True)


@query("select_labels", f"""WITH {VECTORS_SQL}, {EVENTS_SQL} SELECT row_id, 'multi' AS kind, '0,1,2,3,4,5,6,7,8,9' AS value FROM vectors
  UNION ALL SELECT row_id, 'binary', '0,1' FROM evs""")
def _labels(spark, sf):
    text = lambda c: F.array_join(c.cast("array<string>"), ",").alias("value")
    multi = class_vectors(spark, sf).select("row_id", F.lit("multi").alias("kind"), text(selection.select_labels("multi:softprob", 10)))
    return multi.unionByName(event_rows(spark, sf).select("row_id", F.lit("binary").alias("kind"), text(selection.select_labels("binary:hinge"))))


@query("select_predicted_score", f"WITH {FLAT_SQL} SELECT row_id, {_tree_sql()} AS value FROM x")
def _score(spark, sf):
    out = predict_trees(order_rows(spark, sf), fixed_model())
    return out.select("row_id", selection.select_predicted_score("reg:squarederror", F.col("prediction")).alias("value"))


KEYS = ["predicted_label", "probability", "raw_score", "predicted_score"]


@query("select_predictions", f"""WITH {BIN_SQL} SELECT row_id, CAST(s > 0.5 AS INT) AS predicted_label, s AS probability, s AS raw_score,
  CAST(NULL AS DOUBLE) AS predicted_score FROM b""")
def _selected(spark, sf):
    df = event_rows(spark, sf).withColumnRenamed("score", "prediction")
    return selection.select_predictions(df, KEYS, "binary:logistic").select("row_id", "selected.*")


def _requests(spark, sf):
    """Fifty predictions per request, two decimals each."""
    df = table(spark, sf, "events")
    return df.select(
        F.expr("event_id div 50").alias("request_id"), F.col("event_id").alias("row_idx"), F.expr("event_id % 97 / 100.0D").alias("prediction")
    )


REQ_SQL = "req AS (SELECT event_id // 50 AS request_id, event_id AS row_idx, event_id % 97 / 100.0::DOUBLE AS v FROM events)"


@query("encode_csv_batch", f"WITH {REQ_SQL} SELECT request_id, string_agg(v::VARCHAR, chr(10) ORDER BY row_idx) || chr(10) AS body FROM req GROUP BY ALL")
def _csv_batch(spark, sf):
    return E.encode_csv_batch(_requests(spark, sf))


@query("encode_csv_online", f"WITH {REQ_SQL} SELECT request_id, string_agg(v::VARCHAR, ',' ORDER BY row_idx) AS body FROM req GROUP BY ALL")
def _csv_online(spark, sf):
    return E.encode_csv_online(_requests(spark, sf))


SELECTED = ["predicted_label", "labels", "probability", "predicted_score"]


def _selected_requests(spark, sf):
    return selection.select_predictions(_requests(spark, sf), SELECTED, "binary:logistic")


@query("encode_selected_csv", f"""WITH {REQ_SQL} SELECT request_id, string_agg(CAST(v > 0.5 AS INT) || ',"[0, 1]",' || v::VARCHAR || ',nan',
  chr(10) ORDER BY row_idx) AS body FROM req GROUP BY ALL""")
def _selected_csv(spark, sf):
    return E.encode_selected_csv(_selected_requests(spark, sf), SELECTED)


ITEM = """'{"predicted_label":' || CAST(v > 0.5 AS INT) || ',"labels":[0,1],"probability":' || v::VARCHAR || ',"predicted_score":null}'"""


@query("encode_json", f"""WITH {REQ_SQL} SELECT request_id, '{{"predictions":[' || string_agg({ITEM}, ',' ORDER BY row_idx) || ']}}' AS body FROM req GROUP BY ALL""")
def _json(spark, sf):
    return E.encode_json(_selected_requests(spark, sf))


@query("encode_scores_json", f"""WITH {REQ_SQL} SELECT request_id, '{{"predictions":[' || string_agg('{{"score":' || v::VARCHAR || '}}', ',' ORDER BY row_idx) || ']}}' AS body FROM req GROUP BY ALL""")
def _scores_json(spark, sf):
    return E.encode_scores_json(_requests(spark, sf))


@query("encode_jsonlines", f"WITH {REQ_SQL} SELECT row_idx, {ITEM} AS line FROM req")
def _jsonlines(spark, sf):
    return E.encode_jsonlines(_selected_requests(spark, sf)).select("row_idx", "line")


@query("json_to_jsonlines", f"""WITH {REQ_SQL} SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY row_idx) - 1 AS INT) AS row_idx,
  '{{"score":' || v::VARCHAR || '}}' AS line FROM req""")
def _to_jsonlines(spark, sf):
    return E.json_to_jsonlines(E.encode_scores_json(_requests(spark, sf)))


@query("encode_recordio", "SELECT event_id AS row_idx, 92 AS bytes FROM events")
def _encode_recordio(spark, sf):
    from treeline.sources.recordio import encode_recordio

    df = selection.select_predictions(_requests(spark, sf), ["predicted_label", "probabilities", "raw_score"], "binary:logistic")
    out = encode_recordio(df.select("row_idx", "selected.*"), ["predicted_label", "probabilities", "raw_score"])
    return out.select("row_idx", F.length("record").alias("bytes"))


@query("save_model", f"WITH {FLAT_SQL} SELECT row_id, {_tree_sql()} AS prediction FROM x")
def _save(spark, sf):
    path = scratch_path(spark, "model")
    save_model(fixed_model(), spark, path, "model-0")
    return predict_trees(order_rows(spark, sf), load_model(spark, path, "model-0")).select("row_id", "prediction")


def _request_model() -> Model:
    """Two stumps over the event features value, k, user hour."""
    one = _tree({0: (0, 20.0, True)}, {1: 0.25, 2: -0.5})
    two = _tree({0: (1, 40.0, False), 1: (2, 12.0, False)}, {2: 0.75, 3: 0.125, 4: -0.25})
    return Model("reg:squarederror", {"eta": 0.3, "lambda": 1.0}, 0.5, 3, 1, [[one], [two]])


REQUEST_SQL = f"""{EVENTS_SQL}, p AS (SELECT row_id // 50 AS request_id, row_id, (0.5 + CASE WHEN features[1] < 20 THEN 0.25 ELSE -0.5 END
  + CASE WHEN features[2] < 40 THEN CASE WHEN features[3] < 12 THEN 0.125 ELSE -0.25 END ELSE 0.75 END)::DOUBLE AS v FROM evs)"""


@query("batch_transform", f"""WITH {REQUEST_SQL} SELECT request_id, string_agg(v::VARCHAR, chr(10) ORDER BY row_id) || chr(10) AS body,
  CAST(NULL AS VARCHAR) AS error FROM p GROUP BY ALL""")
def _batch(spark, sf):
    return batch_transform(csv_bodies(spark, sf), _request_model())


@query("batch_transform_bad_bodies", f"""WITH {REQUEST_SQL} SELECT request_id, CASE WHEN request_id % 4 = 0 THEN string_agg(v::VARCHAR, chr(10) ORDER BY row_id) || chr(10) END AS body,
  CASE request_id % 4 WHEN 1 THEN 'empty row' WHEN 2 THEN 'not a number: x' WHEN 3 THEN '5 features for a model of 3' END AS error FROM p GROUP BY request_id""")
def _bad_bodies(spark, sf):
    bad = F.expr("CASE request_id % 4 WHEN 0 THEN body WHEN 1 THEN '' WHEN 2 THEN concat(body, '\n1,x,3') ELSE '1,2,3,4,5' END")
    return batch_transform(csv_bodies(spark, sf).withColumn("body", bad), _request_model())


def _ensemble_model() -> list[Model]:
    other = _request_model()
    other.base_margin = 0.0
    return [_request_model(), other]


@query("batch_transform_ensemble", f"""WITH {REQUEST_SQL} SELECT request_id, '{{"predictions":[' || string_agg('{{"score":' || (v - 0.25::DOUBLE)::VARCHAR || '}}', ',' ORDER BY row_id) || ']}}' AS body,
  CAST(NULL AS VARCHAR) AS error FROM p GROUP BY ALL""")
def _ensemble(spark, sf):
    path = scratch_path(spark, "models")
    for number, model in enumerate(_ensemble_model()):
        save_model(model, spark, path, f"model-{number}")
    return batch_transform(csv_bodies(spark, sf), load_models(spark, path), accept="json")


@query("batch_transform_jsonlines", f"""WITH {REQUEST_SQL} SELECT request_id, string_agg('{{"predicted_score":' || v::VARCHAR || ',"labels":null}}' || chr(10), '' ORDER BY row_id) AS body,
  CAST(NULL AS VARCHAR) AS error FROM p GROUP BY ALL""")
def _batch_jsonlines(spark, sf):
    return batch_transform(csv_bodies(spark, sf), _request_model(), accept="jsonlines", keys=["predicted_score", "labels"])


@query("stream_score", f"""WITH {REQUEST_SQL} SELECT request_id,
  CAST(row_number() OVER (PARTITION BY request_id ORDER BY row_id) - 1 AS INT) AS row_idx, v AS prediction FROM p""")
def _stream(spark, sf):
    source, target = scratch_path(spark, "requests"), scratch_path(spark, "responses")
    csv_bodies(spark, sf).write.parquet(source)
    stream = request_stream(spark, source, "request_id long, body string")
    running = stream_score(stream, _request_model(), target)
    running.awaitTermination()
    return spark.read.parquet(target).select("request_id", "row_idx", "prediction")


@query("score_with_user_hooks", f"""WITH {EVENTS_SQL} SELECT row_id // 50 AS request_id,
  string_agg(CAST(round(features[2] + 2 * features[3]) AS INT)::VARCHAR, chr(10) ORDER BY row_id) AS response, CAST(NULL AS VARCHAR) AS error FROM evs GROUP BY ALL""")
def _hooks(spark, sf):
    def model_fn(folder):
        return lambda rows: [int(round(r[1] + 2 * r[2])) for r in rows]

    return score_with_user_hooks(csv_bodies(spark, sf), model_fn)
