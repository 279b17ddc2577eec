import gzip
import hashlib
import io
from pathlib import Path

import pytest

from tierstone.llm import warc

from llm_rows import rows_of

BIG = "<p>" + "ä text\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 20
ROWS = [(3, "http://c", BIG), (1, "http://a", BIG), (2, None, BIG), (4, "http://d\r\nX: y", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "n", BIG), (8, "l", "<p>long " * 200_000),
    (9, "http://x/?q=Content-Length: 5\tand Content-Length: 7", "<p>a payload behind a url that looks like a header")]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, file string")


def test_records_come_back(pages):
    index, folder = warc.archive(pages)
    got = {r["page_id"]: r for r in warc.read_records(index).collect()}
    assert len(got) == len(ROWS)
    for page, _, html in ROWS:
        raw = (html or "").encode()
        r = got[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert r["record_type"] == ("revisit" if page in (2, 3) else "response") and r["refers_to"] == (1 if page in (2, 3) else None)
        assert r["html"] == ("" if r["record_type"] == "revisit" else html or "")
    assert got[2]["url"] is None and got[4]["url"] == "http://d X: y"
    assert got[9]["url"] == ROWS[-1][1]


def test_each_record_is_a_member_the_index_points_at(pages):
    index, folder = warc.archive(pages)
    for r in index.collect():
        data = Path(r["file"].removeprefix("file:")).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n") and data[:2] == b"\x1f\x8b"


def test_streams_are_inflated_in_pieces():
    record = b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab\r\n\r\ncde\r\n\r\n"
    packed = gzip.compress(record * 3) + gzip.compress(record)
    whole = b"".join(warc._inflated(io.BytesIO(packed)))
    assert list(warc.records_of(whole[i : i + 7] for i in range(0, len(whole), 7))) == [record] * 4
    with pytest.raises(ValueError):
        list(warc.records_of([record[:-6]]))


def test_no_rows_and_repeated_rows(pages):
    assert warc.read_records(warc.archive(pages.limit(0))[0]).collect() == []
    twice = pages.filter("page_id = 1").union(pages.filter("page_id = 1"))
    assert rows_of(warc.read_records(warc.archive(twice)[0]), "page_id", "record_type") == [(1, "response")] * 2


def test_payloads_are_left_out_and_wrong_ones_refused(pages, tmp_path):
    index, folder = warc.archive(pages)
    assert {r["html"] for r in warc.read_records(index, payloads=False).collect()} == {None}
    record = index.filter("page_id = 5").first()
    raw = Path(record["file"].removeprefix("file:")).read_bytes()[record["offset"] : record["offset"] + record["length"]]
    forged = gzip.compress(gzip.decompress(raw).replace(b"\r\n\r\nsmall", b"\r\n\r\nSMALL"))
    (tmp_path / "forged.warc.gz").write_bytes(forged)
    bad = pages.sparkSession.createDataFrame([(str(tmp_path / "forged.warc.gz"), 0, len(forged), 5, "response")], warc.INDEX)
    with pytest.raises(Exception, match="payload its head names"):
        warc.read_records(bad).collect()
