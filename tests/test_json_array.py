"""Objects of JSON arrays against a plain reading, with ranges far smaller than the objects."""

import json
import random

import pytest

from trustloom.sources import readers
from trustloom.sources.json_array import json_objects


def value(draw, depth=0):
    kind = draw.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return "".join(draw.choice(['{', '}', '"', '\\', 'a', ' ', 'é漢', '\n', ',', ']', '[']) for _ in range(draw.randrange(12)))
    if kind < 4:
        return draw.choice([None, True, 1.5, -3, "", {}, []])
    if kind == 4:
        return [value(draw, depth + 1) for _ in range(draw.randrange(4))]
    return {str(i) + draw.choice(['', '{', '"}']): value(draw, depth + 1) for i in range(draw.randrange(4))}


def read(spark, path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        frame = json_objects(spark, str(path))
        assert size > 1_000 or frame.rdd.getNumPartitions() > 3
        return sorted(json.dumps(json.loads(r["value"]), sort_keys=True) for r in frame.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [64, 300, 1 << 20])
def test_arrays_equal_a_plain_reading(spark, tmp_path, size):
    draw = random.Random(size)
    want = []
    for i, indent in enumerate([None, 2, 0]):
        objects = [{"k": value(draw), "n": j} for j in range(60)]
        (tmp_path / f"a{i}.json").write_text(json.dumps(objects, indent=indent, ensure_ascii=bool(i)), encoding="utf-8")
        want += objects
    lines = [{"line": value(draw)} for _ in range(20)] + [{"long": "}{" * 500}]
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(x) for x in lines))
    (tmp_path / "mixed.json").write_text('["a{b}", 3, {"x": {"y": "}"}}, null, {}]  ')
    (tmp_path / "empty.json").write_text("[]")
    want += lines + [{"x": {"y": "}"}}, {}]
    assert read(spark, tmp_path, size) == sorted(json.dumps(x, sort_keys=True) for x in want)


def test_readers_of_arrays(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"User": {"identifier": "u1"}}, {"Intent": {"scope": "a}b"}, "User": {"identifier": "u2"}}]))
    assert sorted(((r["concept"], dict(r["record"])) for r in readers.concept_records(spark, str(tmp_path / "r.json")).collect()), key=str) == [
        ("Intent", {"scope": "a}b"}), ("User", {"identifier": "u1"}), ("User", {"identifier": "u2"})]
    with pytest.raises(Exception):
        readers.snapshot_file(spark, str(tmp_path / "missing.json"))
