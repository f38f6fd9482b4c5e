"""Array files cut into splits of a few bytes, against the JSON parser on whole files."""

from __future__ import annotations

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from queuemill.sources import arrays
from queuemill.sources.requests import read_request_array_file

SETTINGS = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
NASTY = ['a,"b', "[1,2]", "]},{[", '\\', '\\\\"', "tab\t\n", "ü,日本, ", "", " , ", '"', "\\,"]


@pytest.fixture()
def small_splits(spark):
    before = {name: spark.conf.get(name) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def nested(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind == 0:
        return rng.choice([None, True, 12, -3.5, 10**15])
    if kind < 4:
        return "".join(rng.choice(NASTY) for _ in range(rng.randrange(5)))
    if kind < 6:
        return [nested(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(NASTY) + str(i): nested(rng, depth + 1) for i in range(rng.randrange(4))}


def test_any_array_over_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(3)
    wanted = {}
    for number in range(8):
        items = [nested(rng) for _ in range(rng.choice([0, 1, 2, 40]))]
        text = json.dumps(items, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        name = f"f{number}.json"
        (tmp_path / name).write_text(rng.choice(["", " \n"]) + text + rng.choice(["", "\n \n"]))
        wanted |= {(name, i): item for i, item in enumerate(items)}
    found = arrays.read_array_elements(spark, str(tmp_path)).collect()
    assert {(r.path.rsplit("/", 1)[1], r.pos): json.loads(r.text) for r in found} == wanted
    assert len(found) == len(wanted)
    assert read_request_array_file(spark, str(tmp_path)).count() == len(wanted)


def test_one_element_over_many_splits(spark, tmp_path, small_splits):
    items = [list(range(500)), "x," * 300, {"a": ["]"] * 100}]
    (tmp_path / "a.json").write_text(json.dumps(items))
    found = arrays.read_array_elements(spark, str(tmp_path)).orderBy("pos").collect()
    assert [json.loads(r.text) for r in found] == items


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        with open(tmp_path / "large.json", "w") as out:
            out.write("[")
            for i in range(60_000):
                out.write((",\n" if i else "") + json.dumps({"i": i, "t": f'say "{i}", [{i}'}))
            out.write("]")
        read = arrays.read_array_elements(spark, str(tmp_path / "large.json"))
        tasks = {r[0] for r in spark.read.text(str(tmp_path), lineSep=",").selectExpr("spark_partition_id()").distinct().collect()}
        assert len(tasks) >= 3
        good = read.selectExpr("pos", "cast(get_json_object(text, '$.i') as bigint) as i", "get_json_object(text, '$.t') as t")
        assert good.filter("i = pos and t = concat('say \"', i, '\", [', i)").count() == 60_000 == read.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def test_other_files(spark, tmp_path, small_splits):
    for name, text in {"o.json": '{"a": [1, 2], "b": 3}', "s.json": '"text, more"', "e.json": "", "b.json": " \n ", "n.json": "[ \n]"}.items():
        (tmp_path / name).write_text(text)
    assert read_request_array_file(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("text", ["[1, 2", '[1, "2]', "[1, 2]]", "[1 2, 3]", "[1, ]", "[,]", "[1], [2]", "[1] [2]", "[1}{, 2]"])
def test_broken_arrays_end_the_job(spark, tmp_path, text):
    (tmp_path / "broken.json").write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        read_request_array_file(spark, str(tmp_path)).collect()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.recursive(st.text('",\\[]{}a', max_size=6) | st.integers(), lambda x: st.lists(x, max_size=3), max_leaves=6), max_size=8), st.data())
def test_fold_knows_the_state_of_every_split(items, data):
    """Cut anywhere behind a comma: states and positions are those of a scan from the start."""
    text = json.dumps(items) + ","
    commas = [i + 1 for i, c in enumerate(text[:-1]) if c == ","]
    cuts = sorted(data.draw(st.sets(st.sampled_from(commas), max_size=4))) if commas else []
    batches = []
    for lo, hi in zip([0, *cuts], [*cuts, len(text)]):
        row = {"split": lo, "path": "p", "begin": lo, "value": text[lo : hi - 1]}
        batches.append(pa.RecordBatch.from_pylist([row]))
    states = arrays._fold(pa.Table.from_batches(arrays._summaries(iter(batches)))).to_pylist()
    inside, depth, pos, at = False, 0, 0, {}
    escaped = False
    for i, c in enumerate(text):
        at[i] = (inside, depth, pos)
        if inside:
            inside, escaped = c != '"' or escaped, c == "\\" and not escaped
        elif c == '"':
            inside = True
        else:
            depth += (c in "[{") - (c in "]}")
            pos += c == "," and depth == 1
    assert [(s["inside"], s["depth"], s["pos"]) for s in states] == [at[s["begin"]] for s in states]
    assert {s["last_pos"] for s in states} == {pos}
    assert np.array_equal(arrays.structure(np.frombuffer(text.encode(), np.uint8))[0][-1:], [inside])
