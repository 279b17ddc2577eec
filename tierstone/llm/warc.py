"""WARC archives: written as monolithic gzip streams, normalised to one gzip member per record, read back by offset.

`write_archives` lets Spark's text writer emit records into whole-file gzip streams, as crawlers without seekable
archives do. `normalise` inflates each stream once, front to back, and writes a .warc.gz with every record as a member of its own, plus
a sidecar index of (file, offset, length). `read_records` goes by the index, so any record can be read alone.

Archives lie below the shared folder. Tasks open them through pyarrow's file systems, which know local
and shared mounts, s3, gcs and, with libhdfs at hand, hdfs.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.session import fresh_path, settle

REVISIT_BYTES = 100  # equal payloads of at least so many bytes are archived once
FILE_RECORDS = 2_000  # records in a monolithic stream
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 18  # bytes taken from a stream at once
BATCH_BYTES = 16 << 20  # payload bytes that a reading task hands on at once
LENGTH = b"\r\nContent-Length: "  # a line of the head; a URL can't hold one, as it holds no line ends

INDEX = "file string, offset long, length long, page_id long, record_type string"
RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, html string"


def _urn(page_id):
    """urn:uuid made of the id's digest; a null id has one too."""
    h = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit("null"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _uri(url):
    """The url with blanks and control characters percent-encoded, as the header line wants it; X-Url has it as it was, but for line ends."""
    out = url
    for code in range(0x21):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return out


def plan_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """pages with payload_bytes, payload_digest, record_type and refers_to.

    Of pages with equal payloads of at least `least` bytes, the one with the smallest page_id is the response and the others revisit it; rows
    that repeat that page_id are responses too, as is a null page_id (which sorts after all others).
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = kept.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    groups = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # written, so that the join sees two plain inputs and can split a payload that a third of the pages share
    firsts = settle(groups.filter("n > 1").select(F.col("payload_digest").alias("of"), "first"), "payloads")
    joined = rows.join(firsts, F.col("payload_digest") == F.col("of"), "left")
    revisit = F.coalesce(F.col("page_id") != F.col("first"), F.lit(False))
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write_archives(records: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """One gzip stream per file. A record is its head, an empty line and the payload (none for a revisit)."""
    # values of header lines must not hold line ends
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n"))).otherwise("")
    is_revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _urn(F.col("page_id"))), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", _uri(F.col("url"))), line("X-Url", F.col("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Refers-To", F.when(is_revisit, _urn(F.col("refers_to")))), line("WARC-Profile", F.when(is_revisit, F.lit(PROFILE))),
        line("X-Page-Id", F.col("page_id")), line("X-Refers-To-Page-Id", F.col("refers_to")), line("X-Payload-Bytes", F.col("payload_bytes")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(is_revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes"))), F.lit("\r\n"),
    )
    text = F.concat(head, F.when(is_revisit, "").otherwise(F.col("html")))
    records.select(text.alias("value")).write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records).text(path)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, body[: int(fields["Content-Length"])]


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Records (head, payload, closing empty lines) from the inflated pieces of a stream, holding one record at a time."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        at = 0
        while True:
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            start = held.find(LENGTH, at, end) + len(LENGTH)
            stop = held.find(b"\r\n", start, end + 2)
            whole = end + 4 + int(held[start:stop]) + 4
            if whole > len(held):
                break
            yield bytes(held[at:whole])
            at = whole
        del held[:at]
    if held.strip():
        raise ValueError("an archive ends inside a record")


def _inflated(stream) -> Iterator[bytes]:
    """Pieces of a gzip stream of any number of members."""
    inflater = zlib.decompressobj(31)
    while data := stream.read(READ):
        while data:
            yield inflater.decompress(data)
            data = inflater.unused_data
            if inflater.eof:
                inflater = zlib.decompressobj(31)


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite every archive below `source` to `target` with a member per record; the sidecar index.

    A task writes under a name of its own and the index holds the names of tasks that succeeded, so a task that is
    lost and run again leaves no trace in the index, only a file nobody refers to.
    """
    files = spark.read.format("binaryFile").load(source).select("path")  # content is not read here
    count = max(1, files.count())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                system, inside = _open(path)
                out_system, out = _open(f"{target}/{uuid.uuid4().hex}.warc.gz")
                out_system.create_dir(out.rsplit("/", 1)[0], recursive=True)
                rows, offset = [], 0
                with system.open_input_stream(inside, compression=None) as stream, out_system.open_output_stream(out, compression=None) as sink:
                    for record in records_of(_inflated(stream)):
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = packer.compress(record) + packer.flush()
                        sink.write(member)
                        fields, _ = parse_record(record[: record.find(b"\r\n\r\n") + 4])
                        page = fields.get("X-Page-Id")
                        rows.append((f"{target}/{out.rsplit('/', 1)[1]}", offset, len(member), None if page is None else int(page), fields["WARC-Type"]))
                        offset += len(member)
                names = ("file", "offset", "length", "page_id", "record_type")
                columns = {c: [r[i] for r in rows] for i, c in enumerate(names)}
                yield pd.DataFrame({c: pd.Series(v, dtype=object) if c in ("file", "record_type") else pd.array(v, "Int64") for c, v in columns.items()})

    # a file per task, dealt round-robin
    index = files.repartition(count).mapInPandas(run, INDEX)
    return settle(index, "warc-index")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records an index names; html is the archived payload (empty for revisits), or null without payloads.

    A response whose payload does not have the digest and the length of its head fails the job.
    """

    def framed(rows: list[tuple]) -> pd.DataFrame:
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "html"]
        columns = {c: [r[i] for r in rows] for i, c in enumerate(names)}
        whole = ("page_id", "payload_bytes", "refers_to")  # a null beside them must not make floats of them
        return pd.DataFrame({c: pd.array(v, "Int64") if c in whole else pd.Series(v, dtype=object) for c, v in columns.items()})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, part in frame.groupby("file"):
                system, inside = _open(path)
                rows, held = [], 0
                with system.open_input_file(inside) as stream:
                    for offset, length in zip(part["offset"].tolist(), part["length"].tolist(), strict=True):
                        stream.seek(offset)
                        fields, body = parse_record(zlib.decompress(stream.read(length), 31))
                        number = lambda name, f=fields: int(f[name]) if name in f else None
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if fields["WARC-Type"] == "response" and (hashlib.sha256(body).hexdigest(), len(body)) != (digest, number("X-Payload-Bytes")):
                            raise ValueError(f"a record of {path} at {offset} does not hold the payload its head names")
                        rows.append((
                            number("X-Page-Id"), fields.get("X-Url"), fields["WARC-Type"], digest, number("X-Payload-Bytes"), number("X-Refers-To-Page-Id"),
                            body.decode() if payloads else None,
                        ))
                        held += len(body) if payloads else 0
                        if held >= BATCH_BYTES:
                            yield framed(rows)
                            rows, held = [], 0
                yield framed(rows)

    return index.mapInPandas(run, RECORDS)


def archive(pages: DataFrame) -> tuple[DataFrame, str]:
    """Write pages as monolithic archives, normalise them, and give the index and the folder of the normalised archives.

    Null html is empty, null url has no header line. Each row is a record; further columns are not archived.
    """
    spark = pages.sparkSession
    raw, packed = fresh_path(spark, "warc-streams"), fresh_path(spark, "warc")
    write_archives(plan_records(pages), raw)
    return normalise(spark, raw, packed), packed
