"""Measuring runs, and models that stay in their workers."""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from queuemill.operators import calibration, models
from queuemill.operators.inference import ContractError, Stage, chain, embed_text, predict


class Recorder:
    """Remembers its calls; ``cost(n)`` microseconds each."""

    def __init__(self, cost):
        self.cost, self.calls, self.now = cost, [], 0.0

    def __call__(self, inputs, batch_size=1):
        self.calls.append((list(inputs), batch_size))
        self.now += self.cost(len(inputs))
        return [x + 1 for x in inputs]


def walk(cost, example=(1, 2, 3), sizes=calibration.SIZES, batch_size=5):
    model = Recorder(cost)
    stage = Stage.from_function(model, "int", batch_size, name="recorder")
    walked, answer = calibration.walk_sizes(stage, list(example), sizes, lambda m: m.now)
    return model, walked, answer


def test_three_warm_ups_then_doubled_sizes():
    model, walked, answer = walk(lambda n: 100 + n)
    assert answer == [2, 3, 4]
    assert model.calls[:3] == [([1, 2, 3], 5)] * 3
    assert [size for size, _, _ in walked] == list(calibration.SIZES)
    assert [(len(inputs), size) for inputs, size in model.calls[3:]] == [(s, s) for s in calibration.SIZES]
    assert model.calls[5][0] == [1, 2, 3, 1] and model.calls[3][0] == [1]
    assert [elapsed for _, elapsed, _ in walked] == [100 + s for s in calibration.SIZES]


def test_stops_at_the_first_size_that_is_no_better():
    assert [s for s, _, _ in walk(lambda n: n)[1]] == [1, 2]
    assert [s for s, _, _ in walk(lambda n: 64 + n * n)[1]] == [1, 2, 4, 8, 16]
    assert [s for s, _, _ in walk(lambda n: 1.0, sizes=[7])[1]] == [7]


def test_errors():
    walked, answer = calibration.walk_sizes(Stage.from_function(too_large, "int"), [1, 2], calibration.SIZES, slow_clock)
    assert [(size, error) for size, _, error in walked] == [(1, None), (2, None), (4, None), (8, "too large")]
    assert answer is None and walked[-1][1] is None
    walked, answer = calibration.walk_sizes(Stage.from_function(too_large, "int"), [1] * 9, (1, 2), slow_clock)
    assert walked == [(1, None, "too large")] and answer is None
    broken = Stage.from_function(lambda inputs, batch_size=1: [], "int", name="broken")
    with pytest.raises(ContractError):
        calibration.walk_sizes(broken, [1], calibration.SIZES, calibration.wall_clock)


def too_large(inputs, batch_size=1):
    if len(inputs) >= 8:
        raise MemoryError("too large")
    return inputs


def slow_clock(_):
    """Every size takes the same, so that each is better than the one before."""
    slow_clock.now += 1.0
    return slow_clock.now


slow_clock.now = 0.0


def test_rows_of_a_chain(spark):
    examples = spark.createDataFrame(
        [(1, "a", [1, 2]), (2, "b", []), (3, None, None), (3, "c", [4])], "model int, name string, inputs array<int>"
    )
    stages = [Stage.from_function(too_large, "int"), Stage.from_function(lambda inputs, batch_size=1: [str(x) for x in inputs], "string", name="text")]
    found = calibration.calibrate(examples, stages, ["model", "name"], sizes=(1, 2, 4), clock=slow_clock)
    rows = [(r.model, str(r.name), r.stage, r.batch_size, r.error) for r in found.orderBy("model", "stage", "batch_size").collect()]
    assert (2, "b", 0, None, "the example is empty") in rows and (3, "None", 0, None, "the example is empty") in rows
    assert [r[3] for r in rows if r[:3] == (1, "a", 0)] == [1, 2, 4]
    assert [r[3] for r in rows if r[:3] == (1, "a", 1)] == [1, 2, 4]
    failed = calibration.calibrate(examples.filter("model = 1").drop("name"), stages, ["model"], clock=slow_clock)
    assert [(r.stage, r.batch_size, r.error) for r in failed.orderBy("batch_size").collect()][-1] == (0, 8, "too large")
    registry = calibration.measured_registry(failed, ["model"]).collect()
    assert [(r.predictor_sequence, r.optimal_batch_size, r.status) for r in registry] == [(0, 4, "failed")]


def test_runs_and_registry(spark):
    examples = spark.createDataFrame([(7, [1.5])], "queue_key int, inputs array<double>")
    stages = [Stage.from_function(lambda inputs, batch_size=1: [x * 2 for x in inputs], "double", name="twice")]
    measured = calibration.calibrate(examples, stages, runs=4)
    rows = measured.collect()
    assert {r.run for r in rows} == {0, 1, 2, 3} and all(r.elapsed_us >= 0 for r in rows)
    assert max(Counter(r.run for r in rows).values()) <= len(calibration.SIZES)
    (one,) = calibration.measured_registry(spark.createDataFrame(rows, measured.schema)).collect()
    assert json.loads(one.example_output) == [3.0] and one.predictor_name == "twice" and one.status == "running"
    assert one.max_wait_seconds == max(0.003, one.time_per_example / 1000 * 0.51)
    with pytest.raises(ValueError):
        calibration.calibrate(examples, [Stage.from_expression(lambda x: x, "double")])


def logging_loader(folder):
    def load():
        with open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w"):
            pass
        return lambda inputs, batch_size=1: [float(x) for x in inputs]

    return load


def loads(folder) -> Counter:
    return Counter(int(name.split("-")[0]) for name in os.listdir(folder))


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    """Forty tasks a job, three kinds of jobs, eight cores: no worker loads twice."""
    stage = Stage.from_loader(logging_loader(str(tmp_path)), "double", 4, name="logged")
    flat = spark.range(400).select(F.col("id").alias("input")).repartition(40)
    assert predict(flat, stage).filter("output = input").count() == 400
    first = loads(tmp_path)
    assert 1 <= len(first) <= 16 and set(first.values()) == {1}
    requests = flat.select(
        F.col("input").alias("request_id"), (F.col("input") % 20).alias("queue_key"), F.col("input").alias("received_us"),
        F.array("input").alias("inputs"),
    )
    assert chain(requests, [stage], tasks=20).filter("success").count() == 400
    again = Stage.from_loader(logging_loader(str(tmp_path)), "double", 4)
    assert again.key == stage.key
    vectors = Stage.from_loader(logging_loader(str(tmp_path)), "double", 4, name="other name")
    assert predict(flat, vectors).count() == 400
    assert set(loads(tmp_path).values()) == {1} and len(loads(tmp_path)) < 40


def load_profile_logged(folder):
    def load():
        with open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w"):
            pass
        return lambda inputs, batch_size=1: [[float(len(x)), 1.0] for x in inputs]

    return load


def test_embedding_uses_it(spark, tmp_path):
    stage = Stage.from_loader(load_profile_logged(str(tmp_path)), "array<double>", 16)
    texts = spark.range(60).select(F.concat(F.lit("t"), "id").alias("text")).repartition(30)
    assert embed_text(texts, stage).count() == 60
    assert set(loads(tmp_path).values()) == {1} and len(loads(tmp_path)) < 30


def test_bound_and_release():
    models.release_all()
    closed = []

    class Model:
        def __init__(self, name):
            self.name = name

        def close(self):
            closed.append(self.name)

    made = []

    def load(name):
        made.append(name)
        return Model(name)

    for name in "abcab":
        assert models.loaded(name, lambda name=name: load(name), limit=3).name == name
    assert made == ["a", "b", "c"] and closed == []
    models.loaded("d", lambda: load("d"), limit=3)
    assert closed == ["c"]
    with pytest.raises(ZeroDivisionError):
        models.loaded("e", lambda: 1 / 0, limit=3)
    assert closed == ["c", "a"] and models.loaded("e", lambda: load("e"), limit=3).name == "e"
    models.loaded("f", lambda: "without close", limit=1)
    assert models.release_all() == 1 and closed == ["c", "a", "b", "d", "e"]


def test_keys_follow_code_and_captured_values():
    assert models.content_key(logging_loader("x")) == models.content_key(logging_loader("x"))
    assert models.content_key(logging_loader("x")) != models.content_key(logging_loader("y"))
