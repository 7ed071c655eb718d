"""Large files cut into byte ranges, against the parsers of whole files."""

import csv
import io
import json
import random

import pytest

from quarry.sources import large, parsers


def awkward_json(rng, n):
    texts = ["plain", 'quo"te', "back\\slash", "com,ma", "[br]{ack}ets", "ünï", "tail\\", ",", '","', "line\nend", ""]
    value = lambda depth: rng.choice([rng.choice(texts), rng.randint(-5, 5), None, True, 1.5]) if depth > 2 or rng.random() < 0.5 else ([value(depth + 1) for _ in range(rng.randint(0, 3))] if rng.random() < 0.5 else {rng.choice(texts) + str(k): value(depth + 1) for k in range(rng.randint(0, 3))})
    return [value(0) for _ in range(n)]


@pytest.fixture()
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in zip(keys, ("700", "0"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_json_arrays_in_ranges(spark, tmp_path, small_splits):
    rng = random.Random(2)
    made = {"a.json": awkward_json(rng, 400), "b.json": [], "c.json": [1], "d.json": [["x" * 3000, 1], {"k": "y," * 900}], "e.json": [{}]}
    for n, (name, value) in enumerate(made.items()):
        (tmp_path / name).write_text(json.dumps(value, indent=(None, 1, None, 2, None)[n], ensure_ascii=n % 2 == 0) + "\n" * (n % 2))
    got = large.json_array_blocks(spark, f"file://{tmp_path}")
    assert spark.read.option("lineSep", ",").text(f"file://{tmp_path}/a.json").rdd.getNumPartitions() > 5
    rows = {(r["path"].rpartition("/")[2], r["record"], r["text"], r["value"]) for r in got.collect() if not r["error"]}
    want = {(name, meta["record"], text, meta["value"]) for name in made for text, meta in parsers.json_blocks((tmp_path / name).read_bytes())}
    assert rows == want and got.where("error is not null").count() == 0


def test_broken_records_are_errors_of_their_own(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a" 2}, 3]')
    (tmp_path / "b.json").write_text('{"a": 1}')
    rows = large.json_array_blocks(spark, f"file://{tmp_path}").collect()
    assert sorted((r["path"][-6:], r["record"], r["text"]) for r in rows if not r["error"]) == [("a.json", 0, "a: 1"), ("a.json", 2, "3")]
    assert sorted((r["path"][-6:], r["record"]) for r in rows if r["error"]) == [("a.json", 1), ("b.json", 0)]


def test_tables_in_ranges(spark, tmp_path, small_splits):
    rng = random.Random(3)
    cells = ["plain", 'quo"te', "com,ma", "two\nlines", "", " ü ", "a b cd", '"', '""', "5\" pipe"]
    for name, n in (("a.csv", 130), ("b.csv", 40), ("c.csv", 20), ("d.csv", 0), ("e.csv", 21)):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["k", " name ", "", "note"])
        for k in range(n):
            writer.writerow([k, *(rng.choice(cells) for _ in range(rng.choice([1, 2, 3, 4])))])
            if rng.random() < 0.1:
                out.write("\n")
        text = out.getvalue() + ('9,5" wide,x,y\n' if n else "")  # a quote inside a field that has none around it
        (tmp_path / name).write_text(text, newline="")
    rows = {(r["path"].rpartition("/")[2], r["block_no"], r["text"], r["rows"]) for r in large.table_row_blocks(spark, f"file://{tmp_path}").collect()}
    want = {(p.name, n, text, meta["rows"]) for p in tmp_path.iterdir() for n, (text, meta) in enumerate(parsers.separated(",")(p.read_bytes()))}
    assert rows == want
    assert len(want) > 10


def test_effects_from_either_state():
    assert large.json_effect(b'{"a": [1', 0, 1) == (0, 3)
    assert large.json_effect(b'x}" : "]', 1, 2) == (1, 2)
    assert large.json_effect(rb'"a\"b\\"', 0, 1) == (0, 1)
    effect = large.table_effect(b",")
    assert effect(b'a,"b', 0, 1) == (1, 1) and effect(b'still, inside', 1, 1) == (1, 1)
    assert effect(b'end""still",x', 1, 1) == (0, 1) and effect(b'5" pipe,"q""q"', 0, 1) == (0, 1)
