"""Bodies that cannot be scored have an error and no response; the others are not harmed."""

import math

import pytest

from treeline.operators.routing import Tree
from treeline.plans.model import Model, load_models, save_model
from treeline.plans.transform import batch_transform, score_rows
from treeline.sources import recordio
from treeline.streaming.scoring import request_stream, stream_score


def model():
    tree = Tree()
    left, right = tree.add_children(0)
    tree.feature[0], tree.split[0], tree.value[left], tree.value[right] = 1, 2.5, 1.0, 7.0
    return Model("reg:squarederror", {"num_class": None}, 0.0, 2, 1, [[tree]])


def record(*values):
    return recordio._frame(recordio._map_entry(recordio.FEATURES, "values", values))


BODIES = {
    "csv": [(1, "0,2\n0,3"), (2, ""), (3, "1,2,3,4"), (4, "1,x"), (5, None), (6, "0,2\n1,2,3,4"), (7, " \n")],
    "libsvm": [(1, "0:1 1:2\n0:1 1:3"), (2, ""), (3, "0:1 9:1"), (4, "0:1 1:x"), (5, None), (6, "0:1 1:2\n0:1 9:2"), (7, "\n")],
    "recordio-protobuf": [(1, record(0, 2) + record(0, 3)), (2, b""), (3, record(1, 2, 3, 4)), (4, b"garbage!"), (5, None), (6, record(0, 2) + record(1, 2, 3, 4)), (7, record(1, 2)[:-4])],
}


@pytest.mark.parametrize("kind", sorted(BODIES))
def test_bad_bodies(spark, kind):
    requests = spark.createDataFrame(BODIES[kind], f"request_id int, body {'binary' if kind.startswith('recordio') else 'string'}")
    out = {r["request_id"]: (r["body"], r["error"]) for r in batch_transform(requests, model(), kind).collect()}
    assert set(out) == set(range(1, 8)) and out[1] == ("1.0\n7.0\n", None)
    assert all(out[k][0] is None and out[k][1] for k in range(2, 8))
    rows = score_rows(requests, model(), kind).collect()
    assert all((r["prediction"] is None) == (r["error"] is not None) for r in rows)


def test_every_accept(spark):
    requests = spark.createDataFrame([(1, "0,2\n0,3"), (2, "0,x")], "request_id int, body string")
    keys = ["predicted_score", "probabilities"]
    for accept, plain, selected in (
        ("csv", "1.0\n7.0\n", "1.0,nan\n7.0,nan\n"),
        ("json", '{"predictions":[{"score":1.0},{"score":7.0}]}', '{"predictions":[{"predicted_score":1.0,"probabilities":null},{"predicted_score":7.0,"probabilities":null}]}'),
        ("jsonlines", '{"score":1.0}\n{"score":7.0}\n', '{"predicted_score":1.0,"probabilities":null}\n{"predicted_score":7.0,"probabilities":null}\n'),
        (
            "recordio-protobuf",
            b"".join(recordio._frame(recordio._map_entry(recordio.LABEL, "score", [v])) for v in (1.0, 7.0)),
            b"".join(recordio._frame(b"".join(recordio._map_entry(recordio.LABEL, k, [x]) for k, x in zip(keys, (v, math.nan)))) for v in (1.0, 7.0)),
        ),
    ):
        for named, body in ((None, plain), (keys, selected)):
            out = {r["request_id"]: r for r in batch_transform(requests, model(), accept=accept, keys=named).collect()}
            assert out[1]["body"] == body and out[1]["error"] is None, accept
            assert out[2]["body"] is None and out[2]["error"] == "not a number: x"
    with pytest.raises(ValueError, match="not supported"):
        batch_transform(requests, model(), accept="xml")


def test_stored_models_answer_together(spark, tmp_path):
    other = model()
    other.base_margin = 3.0
    for name, m in (("a", model()), ("b", other)):
        save_model(m, spark, str(tmp_path), name)
    requests = spark.createDataFrame([(1, "0,2\n0,3"), (2, "")], "request_id int, body string")
    out = {r["request_id"]: r["body"] for r in batch_transform(requests, load_models(spark, str(tmp_path))).collect()}
    assert out == {1: "2.5\n8.5\n", 2: None}
    other.n_features = 5
    with pytest.raises(ValueError, match="one width"):
        batch_transform(requests, [model(), other])


def test_a_restarted_stream_scores_nothing_twice(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for number in range(2):
        spark.createDataFrame([(number, "0,2\n0,3")], "request_id int, body string").write.mode("append").parquet(source)
        stream = request_stream(spark, source, "request_id int, body string")
        stream_score(stream, model(), target).awaitTermination()
        assert spark.read.parquet(target).count() == 2 * (number + 1)
