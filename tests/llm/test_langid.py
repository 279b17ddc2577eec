import os

import numpy as np
import pytest

from tierstone.llm import langid
from tierstone.llm.queries import QUERIES

WORDS = {"en": "the and house with green", "de": "der und haus mit grünen", "fr": "le et maison avec verte", "es": "el y casa con ñandú"}


def corpus(documents, n=40):
    draw = np.random.default_rng(1)
    return documents(*[(i, " ".join(draw.choice(WORDS[lang].split(), 60)), lang) for i, lang in enumerate(list(WORDS) * n)])


def test_held_out_documents_are_recognised(documents):
    docs = corpus(documents)
    found = langid.predict(docs.withColumn("held", langid.held_out()), langid.fit(docs)).filter("held").collect()
    assert len(found) > 20 and all(r["lang"] == r["lang_pred"] and 0.5 < r["score"] <= 1 for r in found)


def test_held_out_follows_crc32(documents):
    import zlib

    docs = documents(*[(i, "x") for i in range(50)], (None, "x"))
    got = {r["doc_id"]: r["h"] for r in docs.select("doc_id", langid.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)} | {None: False}


def test_labels_of_held_out_rows_are_not_learned(documents):
    docs = corpus(documents)
    from pyspark.sql import functions as F

    changed = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    one, two = langid.fit(docs), langid.fit(changed)
    assert one.labels == two.labels and np.array_equal(one.filters, two.filters)


def test_windows_cover_every_place():
    for n in (1, 3, 250, 256, 257, 1000):
        cut, new = langid.windows_of("ab" * n)
        step = langid.WINDOW - max(langid.WIDTHS) + 1
        assert new.sum() >= 2 * n - max(langid.WIDTHS) and len(cut) == len(new) and (len(cut) - 1) * step < 2 * n


def test_odd_rows_and_no_rows(odd, documents):
    net = langid.fit(odd)
    assert net is not None
    got = {(r["doc_id"], r["text"]): r for r in langid.predict(odd, net).collect()}
    assert got[(3, "!!! ???")]["lang_pred"] == "und" and got[(None, None)]["score"] == 0 and got[(4, "one")]["lang_pred"] == "en"
    assert langid.recognised(odd, net).columns == odd.columns and langid.recognised(odd, net).count() == 7
    assert langid.predict(odd.limit(0), langid.fit(odd.limit(0))).collect() == []
    assert langid.predict(odd, None).filter("lang_pred <> 'und'").isEmpty()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_accuracy_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op3_language"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.98
