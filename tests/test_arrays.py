"""JSON arrays cut by bytes at every place."""

from __future__ import annotations

import json

import pytest

from tallybox.sources import formats
from tallybox.sources.arrays import read_json_array

SCHEMA = "struct<a:string,b:array<int>,c:struct<d:string,e:array<struct<f:int>>>>"


@pytest.fixture
def cuts(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, str(v)) for k, v in (("spark.sql.files.maxPartitionBytes", n), ("spark.sql.files.openCostInBytes", 1))]
    for k, v in old.items():
        spark.conf.set(k, v)


FLAT = [{"a": f"im{i}", "b": [i, i + 1, 2]} for i in range(40)]
DEEP = [{"a": 'q" }{ \\', "b": [1], "c": {"d": "}", "e": [{"f": 1}, {"f": 2}]}}, {"a": "\\\\\"}],{[", "b": []}, {"a": "é{", "c": {"d": "", "e": []}}, {"a": None, "b": [3]}, {"a": "} , {"}] * 5


def rows(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())


def want(items):
    full = [{"a": x.get("a"), "b": x.get("b"), "c": x.get("c")} for x in items]
    return sorted(json.dumps(x, sort_keys=True) for x in full)


@pytest.mark.parametrize("size", [37, 64, 1000])
def test_arrays_of_any_form(spark, tmp_path, cuts, size):
    cuts(size)
    (tmp_path / "flat.json").write_text(json.dumps(FLAT, indent=1))
    (tmp_path / "deep.json").write_text("\n" + json.dumps(DEEP, ensure_ascii=False) + "\n")
    (tmp_path / "none.json").write_text(" [ ]\n")
    (tmp_path / "void.json").write_text("")
    got = read_json_array(spark, str(tmp_path), SCHEMA)
    assert rows(got) == want(FLAT + DEEP)
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "x.json").write_text(json.dumps(FLAT))
    one = read_json_array(spark, str(tmp_path / "more"), SCHEMA)
    assert rows(one) == want(FLAT) and (one.rdd.getNumPartitions() > 5) == (size < 100)  # one file, several tasks


@pytest.mark.parametrize("text", ['[{"a":"x"}', '[{"a":"x"},{"a":"y"', '[{"a":"x"} {"a":"y"}]', '{"a":"x"}', '[{"a":"x"}]]', '[{"a":"x"},]', '{"a":"x"},[{"a":"y"}]', '[{"a":"}"},{"a":{"d":"y"}]', '[{"a":"x}]', "[", 'x', '[{"a":"x"}],[{"a":"y"}]'])
def test_broken_arrays_fail(spark, tmp_path, text):
    (tmp_path / "good.json").write_text('[{"a":"x"}]')
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="bad.json|Malformed|MALFORMED"):
        read_json_array(spark, str(tmp_path), SCHEMA).collect()


def test_predictions_of_whole_files(spark, tmp_path, cuts):
    cuts(50)
    items = [{"image_id": str(i), "category_name": "c", "bbox": [1, 2, 3, 4], "score": 0.5} for i in range(9)]
    (tmp_path / "p.json").write_text(json.dumps(items))
    got = formats.read_predictions(spark, str(tmp_path), whole_files=True)
    assert sorted(r.image_id for r in got.collect()) == [str(i) for i in range(9)] and got.columns == ["image_id", "category_name", "bbox", "score"]
