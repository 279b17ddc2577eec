"""One query per operator over its whole table, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.llm import bagminhash, chunks, cuckoo, decontam, html, huffman, langid, lines, mixing, ranking, secrets, warc, whitening
from tierstone.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

END_ID = 2
SHARE, MOST = 1.5, 2.0
# weights 3, 1, 2 on average over the run: fading out, rising, and strongest in the middle
CURVES = ([(0.0, 4.5), (1.0, 1.5)], [(0.0, 0.5), (1.0, 1.5)], [(0.0, 1.0), (0.5, 3.0), (1.0, 1.0)])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def schedule(sources: list[str | None]) -> list[mixing.Knots]:
    return [CURVES[i % 3] for i in range(len(sources))]


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(tune(spark), folder)

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_store")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return huffman.encode_documents(table(spark, folder, "documents"), tokenizer_path(), END_ID)


@query(
    "op2_curriculum",
    r"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, coalesce(md5(doc_id::VARCHAR), '') AS k
        FROM documents
    ), sources AS (
        SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
        FROM sized GROUP BY source
    ), ranked AS (
        SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM sources
    ), levels AS (
        SELECT *,
            (1.5::DOUBLE * sum(source_size) OVER ()
                - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM ranked
    ), chosen AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE level <= ratio),
    targets AS (
        SELECT source, source_size, CASE WHEN chosen.level IS NULL THEN cap ELSE least(cap, chosen.level * weight) END AS target
        FROM ranked CROSS JOIN chosen
    ), placed AS (
        SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS goal,
            sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size ROWS UNBOUNDED PRECEDING) - s.size AS before
        FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size::BIGINT AS size, source_size, target,
        (least(size, greatest(0, goal - before)) + least(size, greatest(0, goal - source_size - before)))::BIGINT AS taken
    FROM placed
    """,
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, folder, "documents"), schedule, SHARE, MOST)
    return mixing.in_curriculum_order(plan).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_language")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op4_near_duplicates")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = bagminhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "class_rows")


@query("op5_main_text")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"))


@query("op6_secrets")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secrets.scan(docs, secrets.fit(docs))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"), count("crf")
    )


@query("op7_decontaminate")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "windows", "item_share", "changed")


@query("op8_repeated_passages")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, folder, "documents"))


@query(
    "op9_warc",
    """
    WITH rows AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
    ), firsts AS (
        SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM rows
    )
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN page_id <> first THEN first END AS refers_to
    FROM firsts
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    index, _ = warc.archive(table(spark, folder, "pages"))
    return warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op10_exact_dedup",
    r"""
    WITH rows AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
    ), named AS (
        SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM rows
    )
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM named
    """,
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return cuckoo.exact_duplicates(table(spark, folder, "documents"))


@query(
    "op11_shared_lines",
    r"""
    WITH cut AS (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
    ), placed AS (
        SELECT doc_id, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS pos FROM cut
    ), keyed AS (
        SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM placed
    ), shared AS (
        SELECT key, max(doc_id) AS keep_id FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
    ), marked AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keep_id AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    kept = lines.without_shared_lines(docs, lines.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op12_ranked_search",
    r"""
    WITH words AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM documents
    ), sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
    totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
    asked AS (
        SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ) GROUP BY item_id, term
    ), held AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
    weighed AS (
        SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held CROSS JOIN totals GROUP BY term, docs
    ), scored AS (
        SELECT a.item_id, h.doc_id,
            sum(a.times * g.w * ((1000000000 * h.tf) // (1000 * h.tf + 12 * (100 - 25 + ((25 * s.n * t.docs) // t.terms)))))::BIGINT AS score
        FROM held h JOIN asked a ON h.term = a.term JOIN weighed g ON h.term = g.term JOIN sizes s ON h.doc_id = s.doc_id CROSS JOIN totals t
        GROUP BY a.item_id, h.doc_id
    ), placed AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))
