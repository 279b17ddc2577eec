import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_ten_queries_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "token_ids"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_stages_keep_columns_and_pass_odd_rows(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").unionByName(odd, allowMissingColumns=True)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "token_ids":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > 0 and counts[3] == counts[4]
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).collect() == []
