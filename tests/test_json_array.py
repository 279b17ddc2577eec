import json
import random

import pytest
from pyspark.sql import functions as F

from tierstone.sources.files import read_json_doc, read_json_text
from tierstone.sources.json_array import read_json_array

SCHEMA = "id long, text string, nested struct<a: array<struct<b: string>>, tickets: array<string>>"


def elements(n, seed=1):
    draw = random.Random(seed)
    pieces = ['}', '{', '"', '\\', '\\"', '],', '"tickets":[', "é", "\n", "a b", "[{", "}]}", "\\}"]
    return [
        {"id": i, "text": "".join(draw.choice(pieces) for _ in range(draw.randrange(12))) or None,
         "nested": None if i % 5 == 0 else {"a": [{"b": draw.choice(pieces)} for _ in range(draw.randrange(3))], "tickets": ["x{", "y}"]}}
        for i in range(n)
    ]


def as_json(row):
    d = row.asDict(recursive=True)
    return json.dumps(d, sort_keys=True)


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 1])
def test_equals_the_whole_file_reader_over_many_splits(small_splits, tmp_path, indent):
    spark, rows = small_splits, elements(300)
    (tmp_path / "plain.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    got = read_json_array(spark, str(tmp_path / "plain.json"), SCHEMA)
    expected = read_json_doc(spark, str(tmp_path / "plain.json"), SCHEMA)
    assert sorted(map(as_json, got.collect())) == sorted(map(as_json, expected.collect())) and expected.count() == 300
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "plain.json")).rdd.getNumPartitions() > 5


@pytest.mark.parametrize("indent", [None, 2])
def test_an_array_below_a_key_among_others(small_splits, tmp_path, indent):
    spark, rows = small_splits, elements(120, 2)
    document = {"cursor": 'x"}{', "meta": {"tickets": [{"id": -1}], "deep": [[{"id": -2}]]}, "before": [{"id": -3}], "tickets": rows, "after": [{"id": -4}, {"id": -5}], "end": {"tickets": [{"id": -6}]}}
    (tmp_path / "doc.json").write_text(json.dumps(document, indent=indent))
    got = read_json_array(spark, str(tmp_path / "doc.json"), SCHEMA, "tickets").collect()
    assert sorted(r["id"] for r in got) == list(range(120))
    assert {r["id"]: r["text"] for r in got} == {r["id"]: r["text"] for r in rows}


def test_several_files_and_empty_arrays(small_splits, tmp_path):
    for name, rows in (("a", elements(30, 3)), ("b", []), ("c", elements(5, 4))):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    got = read_json_array(small_splits, f"{tmp_path}/*.json", SCHEMA)
    assert sorted(r["id"] for r in got.collect()) == sorted([*range(30), *range(5)])


def test_a_malformed_element_fails(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"id": 1}, {"id": oops}]')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_json_array(spark, str(tmp_path / "bad.json"), SCHEMA).collect()


def test_nested_values_are_sorted_with_and_without_keys(spark, tmp_path):
    lines = ['{"k": {"z": 1, "a": [ {"y": 2, "b": 3} ]}, "s": "{\\"z\\":1,\\"a\\":2}", "n": 1.50, "l": [2, 1]}', "", '{"k": "plain", "s": null, "n": true}']
    (tmp_path / "rows.jsonl").write_text("\n".join(lines))
    want = {('{"a":[{"b":3,"y":2}],"z":1}', "[2,1]", "1.5", '{"z":1,"a":2}'), ("plain", None, "true", None)}
    given = read_json_text(spark, str(tmp_path / "rows.jsonl"), ["k", "l", "n", "s"])
    assert given.columns == ["k", "l", "n", "s"] and {tuple(r) for r in given.collect()} == want
    (tmp_path / "one.jsonl").write_text(lines[0])
    found = read_json_text(spark, str(tmp_path / "one.jsonl"))
    assert found.select("k", "l").first() == read_json_text(spark, str(tmp_path / "one.jsonl"), ["k", "l"]).first()
    assert found.select(F.col("s")).first()[0] == '{"z":1,"a":2}'


def test_a_large_table_is_written_as_several_documents(small_splits, tmp_path, monkeypatch):
    from tierstone.workload import landing
    from tierstone.workload.registry import QUERIES

    rows = [(i * 7 % 401, "".join(random.Random(i).choice('a}{"[],:\\') for _ in range(60))) for i in range(401)]
    small_splits.createDataFrame([(i, t, "en", "s", 60) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    written = []
    monkeypatch.setattr(landing, "DOCUMENT_BYTES", 10_000)
    monkeypatch.setattr(landing, "fresh_path", lambda spark, label: written.append(str(tmp_path / label)) or written[-1])
    got = QUERIES["json_doc_split"](small_splits, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["chars"]) for r in got) == [(i, 60) for i in range(401)]
    assert sum(f.stat().st_size > 2_000 for f in (tmp_path / "document").rglob("*.txt")) >= 5
