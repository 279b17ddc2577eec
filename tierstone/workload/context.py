"""Run health, retrieval chunks, vector search, evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierstone.functions.columns import checksum16, seconds_between, uuid5_url
from tierstone.operators import chunks as C
from tierstone.operators import evals as E
from tierstone.operators import health as H
from tierstone.operators.agent_runs import tool_call_lists
from tierstone.operators.lsh import nearest_by_planes
from tierstone.operators.membership import changed, contained, match, members, missing
from tierstone.operators.ranking import top_n
from tierstone.operators.results import bounded_result, passages_text
from tierstone.operators.vectors import top_k_of_each, top_k_similar
from tierstone.session import fresh_path, settle
from tierstone.streaming.chunks import chunk_store, stream_chunks
from tierstone.workload import standins as I
from tierstone.workload.registry import Tables, query
from tierstone.workload.standins import plain, text, with_sql

# --- run history -----------------------------------------------------------------------

# Events as runs: a user is the unit, purchase a success, error a failure.


def _runs(t: Tables) -> DataFrame:
    return t.events.select(
        text("user_id").alias("unit"),
        text("event_id").alias("run_id"),
        F.when(F.col("event_type") == "purchase", "success")
        .when(F.col("event_type") == "error", "failed")
        .otherwise(F.col("event_type"))
        .alias("state"),
        F.col("ts").cast("timestamp").alias("run_after"),
    )


def _health(t: Tables, exclude: str | None = None) -> DataFrame:
    return H.run_health(_runs(t), "unit", "state", "run_after", "run_id", exclude_run=exclude)


def _units(t: Tables) -> DataFrame:
    return t.customer.select(
        text("c_custkey").alias("unit"),
        (F.col("c_acctbal") < 0).alias("is_paused"),
        F.lit(None).cast("boolean").alias("has_import_error"),
    )


def _assets(t: Tables) -> DataFrame:
    return t.events.select(
        text("user_id").alias("unit"),
        F.concat(F.lit("store/"), "event_type", F.lit("/"), F.get_json_object("props", "$.k")).alias("name"),
        F.col("ts").cast("timestamp").alias("at"),
    )


_HEALTH = """runs AS (
    SELECT CAST(user_id AS VARCHAR) AS unit, ts, {'at': ts, 'id': CAST(event_id AS VARCHAR)} AS moment,
           CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE event_type END AS state
    FROM events WHERE event_id <> 7),
  won AS (SELECT unit, max(moment) AS newest, max(ts) AS last_success_at FROM runs WHERE state = 'success' GROUP BY unit),
  lost AS (SELECT unit, count(*) AS consecutive_failures FROM runs LEFT JOIN won USING (unit)
    WHERE state = 'failed' AND (newest IS NULL OR moment > newest) GROUP BY unit),
  health AS (SELECT unit, count(*) AS total_runs, arg_max(state, moment) AS last_state, max(ts) AS last_run_at,
      any_value(last_success_at) AS last_success_at, coalesce(any_value(consecutive_failures), 0) AS consecutive_failures
    FROM runs LEFT JOIN won USING (unit) LEFT JOIN lost USING (unit) GROUP BY unit),
  names AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS unit, 'store/' || event_type || '/' || json_extract_string(props, '$.k') AS name
    FROM events),
  ordered AS (SELECT unit, json_extract_string('["' || replace(name, '/', '","') || '"]', '$[2]') AS short, name,
      row_number() OVER (PARTITION BY unit ORDER BY json_extract_string('["' || replace(name, '/', '","') || '"]', '$[2]'), name) AS rn
    FROM names),
  assets AS (SELECT unit, count(*) AS asset_count,
      string_agg(short, ', ' ORDER BY rn) FILTER (WHERE rn <= 5) ||
        CASE WHEN count(*) > 5 THEN ', and ' || (count(*) - 5) || ' more' ELSE '' END AS produces_assets FROM ordered GROUP BY 1),
  latest AS (SELECT CAST(user_id AS VARCHAR) AS unit, max(ts) AS last_event_at FROM events GROUP BY 1),
  units AS (SELECT CAST(c_custkey AS VARCHAR) AS unit, c_acctbal < 0 AS is_paused,
      EXISTS (SELECT 1 FROM pages WHERE contains(url, CAST(c_custkey AS VARCHAR))) AS has_import_error FROM customer),
  state AS (SELECT u.unit, is_paused, has_import_error, coalesce(total_runs, 0) AS total_runs, last_state, last_run_at,
      last_success_at, coalesce(consecutive_failures, 0) AS consecutive_failures, last_event_at AS last_asset_event_at,
      produces_assets FROM units u LEFT JOIN health h ON h.unit = u.unit LEFT JOIN assets a ON a.unit = u.unit
      LEFT JOIN latest l ON l.unit = u.unit)"""


def _state(t: Tables) -> DataFrame:
    """Customers as registered units; a page address that contains an id is a broken file."""
    assets = H.asset_summary(_assets(t), "unit", "name", "at")
    return H.entity_health(_units(t), _health(t, "7"), t.pages, "url", assets, "unit")


@query(
    "run_health",
    f"""WITH {_HEALTH} SELECT * REPLACE (strftime(last_run_at, '%Y-%m-%d %H:%M:%S') AS last_run_at,
          strftime(last_success_at, '%Y-%m-%d %H:%M:%S') AS last_success_at,
          strftime(last_asset_event_at, '%Y-%m-%d %H:%M:%S') AS last_asset_event_at) FROM state""",
)
def run_health(t: Tables) -> DataFrame:
    return plain(_state(t))


@query(
    "failure_streak",
    """SELECT CAST(e.user_id AS VARCHAR) AS unit, count(*) AS consecutive_failures FROM events e
       WHERE e.event_type = 'error' AND NOT EXISTS (
         SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'purchase'
           AND (s.ts > e.ts OR s.ts = e.ts AND CAST(s.event_id AS VARCHAR) > CAST(e.event_id AS VARCHAR)))
       GROUP BY 1""",
)
def failure_streak(t: Tables) -> DataFrame:
    return H.failure_streak(_runs(t), "unit", "state", "run_after", "run_id")


@query(
    "asset_summary",
    f"""WITH {_HEALTH} SELECT l.unit, strftime(last_event_at, '%Y-%m-%d %H:%M:%S') AS last_event_at, asset_count, produces_assets
        FROM latest l LEFT JOIN assets a ON a.unit = l.unit""",
)
def asset_summary(t: Tables) -> DataFrame:
    return plain(H.asset_summary(_assets(t), "unit", "name", "at"))


@query(
    "health_text",
    f"""WITH {_HEALTH}, lines AS (SELECT unit, unit || ': last run ' || coalesce(last_state, 'never') ||
          coalesce(' at ' || strftime(last_run_at, '%Y-%m-%d %H:%M:%S'), '') || '; last success ' ||
          coalesce(strftime(last_success_at, '%Y-%m-%d %H:%M:%S'), 'never') ||
          CASE WHEN consecutive_failures > 0 THEN '; ' || consecutive_failures || ' consecutive failures since then' ELSE '' END ||
          CASE WHEN is_paused THEN '; PAUSED, so its data is not being refreshed' ELSE '' END ||
          CASE WHEN has_import_error THEN '; HAS AN IMPORT ERROR, so it cannot run at all' ELSE '' END AS line FROM state)
        SELECT * FROM lines UNION ALL
        SELECT DISTINCT 's' || s_suppkey, 'no health recorded for: s' || s_suppkey FROM supplier""",
)
def health_text(t: Tables) -> DataFrame:
    """Lines for all customers and for suppliers, which have no health."""
    asked = _units(t).select("unit").unionByName(
        t.supplier.select(F.concat(F.lit("s"), text("s_suppkey")).alias("unit"))
    )
    return H.health_text(_state(t), "unit", asked)


@query(
    "run_duration",
    """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS duration_secs FROM events GROUP BY 1""",
)
def run_duration(t: Tables) -> DataFrame:
    ends = t.events.groupBy("user_id").agg(
        F.min("ts").cast("timestamp").alias("started"), F.max("ts").cast("timestamp").alias("ended")
    )
    return plain(ends.withColumn("duration_secs", seconds_between("started", "ended")))


@query(
    "topn_per_group",
    """SELECT user_id, event_id, event_type, rn AS place FROM
         (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events)
       WHERE rn <= 3""",
)
def topn_per_group(t: Tables) -> DataFrame:
    newest = [F.col("ts").desc_nulls_last(), F.col("event_id").desc()]
    return plain(top_n(t.events, ["user_id"], newest, 3, "place").select("user_id", "event_id", "event_type", "place"))


# --- lookups ---------------------------------------------------------------------------


@query(
    "theta_contains",
    """SELECT c_custkey, c_name FROM customer
       WHERE EXISTS (SELECT 1 FROM pages WHERE contains(url, CAST(c_custkey AS VARCHAR)))""",
)
def theta_contains(t: Tables) -> DataFrame:
    """Customers whose number occurs inside some page address."""
    ids = t.customer.select(text("c_custkey").alias("unit"), "c_custkey", "c_name")
    return contained(ids, "unit", t.pages, "url").drop("unit")


@query(
    "membership_lookup",
    "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def membership_lookup(t: Tables) -> DataFrame:
    cited = t.labels.filter("quality = 1").select("doc_id")
    return members(t.documents, "doc_id", cited).select("doc_id", "lang", "source", "n_chars")


@query("semi_match", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_match(t: Tables) -> DataFrame:
    return match(t.documents, t.labels, ["doc_id"])[0].select("doc_id", "lang", "n_chars")


@query("anti_match", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_match(t: Tables) -> DataFrame:
    return match(t.documents, t.labels, ["doc_id"])[1].select("doc_id", "lang", "n_chars")


@query(
    "set_difference",
    "SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events",
)
def set_difference(t: Tables) -> DataFrame:
    active = t.events.select(F.col("user_id").alias("c_custkey"))
    return missing(t.customer, active, "c_custkey").orderBy("c_custkey")


# --- chunks and vectors ------------------------------------------------------------------

# Name-based id of a text, in SQL.
_UUID = """(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab')
  || h[18:20] || '-' || h[21:32] FROM (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name})) AS h))"""
_PLACED = f"""
  SELECT ticket_id, 'ticket' AS source_kind, NULL AS comment_id, product_sku, 0 AS chunk_ordinal, subject AS heading, body,
         ticket_id || ':ticket:0' AS name FROM s_threads
  UNION ALL
  SELECT r.ticket_id, 'comment', r.comment_id, product_sku, rn, subject, author_role || ': ' || r.body,
         r.ticket_id || ':comment:' || r.comment_id
  FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY created_at, comment_id) AS rn FROM s_replies) r
  JOIN s_threads t ON t.ticket_id = r.ticket_id WHERE length(r.body) >= 200 AND r.body IS DISTINCT FROM t.body"""


def _chunks(t: Tables) -> DataFrame:
    return C.chunk(I.threads(t), I.replies(t))


@query(
    "chunk_tickets",
    with_sql(
        "threads replies",
        f"""SELECT {_UUID.format(name='name')} AS chunk_id, source_kind, ticket_id, comment_id, product_sku,
              CAST(chunk_ordinal AS BIGINT) AS chunk_ordinal, heading, md5(body) AS body_md5, sha256(body)[1:16] AS checksum
            FROM ({_PLACED})""",
    ),
)
def chunk_tickets(t: Tables) -> DataFrame:
    return plain(_chunks(t).withColumn("body_md5", F.md5("body")).drop("body", "customer_id"))


@query(
    "chunk_kinds",
    with_sql("threads replies", f"SELECT source_kind, count(*) AS n FROM ({_PLACED}) GROUP BY 1"),
)
def chunk_kinds(t: Tables) -> DataFrame:
    return _chunks(t).groupBy("source_kind").agg(F.count(F.lit(1)).alias("n"))


@query("chunk_checksum", "SELECT conv_id, turn, sha256(text)[1:16] AS checksum FROM conversations")
def chunk_checksum(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", checksum16("text").alias("checksum"))


@query("chunk_uuid", f"SELECT conv_id, turn, {_UUID.format(name='text')} AS chunk_id FROM conversations")
def chunk_uuid(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", uuid5_url("text").alias("chunk_id"))


@query(
    "changed_chunks",
    """SELECT doc_id, sha256(text)[1:16] AS checksum FROM documents
       WHERE lang <> 'en' OR source = 'src1'""",
)
def changed_chunks(t: Tables) -> DataFrame:
    """Documents against a store that has the English ones, one source of them outdated."""
    rows = t.documents.select("doc_id", "lang", "source", checksum16("text").alias("checksum"))
    stored = rows.filter("lang = 'en'").withColumn(
        "checksum", F.when(F.col("source") == "src1", F.lit("outdated")).otherwise(F.col("checksum"))
    )
    return changed(rows, stored, "doc_id", "checksum").select("doc_id", "checksum")


@query(
    "embed_column",
    """SELECT conv_id, turn, 256 AS dims, CASE WHEN length(trim(text)) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS norm FROM conversations""",
)
def embed_column(t: Tables) -> DataFrame:
    """Every turn embedded; the vectors themselves have no SQL, their shape has."""
    embedded = C.embed(t.conversations.select("conv_id", "turn", "text"), "text", C.hash_embedder(256))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return embedded.select("conv_id", "turn", F.size("embedding").alias("dims"), F.round(F.sqrt(square), 4).alias("norm"))


@query(
    "vector_topk",
    """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6)
         AS similarity FROM embeddings ORDER BY
       list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 5""",
)
def vector_topk(t: Tables) -> DataFrame:
    """The five vectors closest to one of them; the query vector is a parameter."""
    wanted = t.embeddings.filter("vec_id = 0").select("embedding").first()[0]
    hits = top_k_similar(t.embeddings, wanted, 5, "vec_id", "embedding")
    return hits.withColumn("similarity", F.round("similarity", 6))


@query(
    "vector_search_set",
    """SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) DESC, e.vec_id) AS rank
       FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q QUALIFY rank <= 5""",
)
def vector_search_set(t: Tables) -> DataFrame:
    """The five closest of all vectors to each of a stated query set."""
    asked = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = top_k_of_each(t.embeddings, asked, 5, "vec_id", "embedding")
    return plain(hits, similarity=6)


# Threads as tickets, in the versions of three exports: in the second, threads without a product have another body and all have lost their
# comments with an even number; the third is the first again.
_EDITED = "CASE WHEN product_sku IS NULL THEN body || ' (edited)' ELSE body END"


@query(
    "stream_chunks",
    with_sql(
        "threads replies",
        f""", placed AS ({_PLACED}), kept AS (
          SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY created_at, comment_id) AS rn FROM s_replies WHERE CAST(split_part(comment_id, '-', 2) AS INTEGER) % 2 = 1),
        edited AS (
          SELECT ticket_id, NULL AS comment_id, {_EDITED} AS body FROM s_threads
          UNION ALL SELECT r.ticket_id, r.comment_id, author_role || ': ' || r.body FROM kept r JOIN s_threads t ON t.ticket_id = r.ticket_id
          WHERE length(r.body) >= 200 AND r.body IS DISTINCT FROM ({_EDITED.replace('body', 't.body')}))
        SELECT coalesce(p.ticket_id, e.ticket_id) AS ticket_id, coalesce(p.comment_id, e.comment_id) AS comment_id, e.ticket_id IS NULL AS removed,
          sha256(coalesce(e.body, p.body))[1:16] AS checksum, CASE WHEN p.body IS DISTINCT FROM e.body AND e.body IS NOT NULL THEN 2 ELSE 1 END AS embedded_in
        FROM placed p FULL JOIN edited e ON e.ticket_id = p.ticket_id AND e.comment_id IS NOT DISTINCT FROM p.comment_id""",
    ),
)
def stream_chunks_query(t: Tables) -> DataFrame:
    """Three exports through the stream: all threads, an edit and a removal, and the first export once more."""
    landing, store, mark = (fresh_path(t.spark, n) for n in ("export", "chunks", "progress"))
    replies = I.replies(t)
    odd = F.split_part("comment_id", F.lit("-"), F.lit(2)).cast("int") % 2 == 1

    def export(threads: DataFrame, said: DataFrame, day: str) -> None:
        listed = said.groupBy("ticket_id").agg(F.collect_list(F.struct("comment_id", "author_role", "body", "created_at")).alias("comments"))
        rows = threads.withColumn("updated_at", F.lit(day)).join(listed, "ticket_id", "left")
        rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(landing)
        stream_chunks(t.spark, landing, store, mark, f"model-{day[-1]}", C.hash_embedder(16), buckets=4).awaitTermination()

    edited = F.when(F.col("product_sku").isNull(), F.concat("body", F.lit(" (edited)"))).otherwise(F.col("body"))
    export(I.threads(t), replies, "2026-04-01")
    export(I.threads(t).withColumn("body", edited), replies.filter(odd), "2026-04-02")
    export(I.threads(t), replies, "2026-04-01")
    rows = chunk_store(t.spark, store).read()
    return rows.select("ticket_id", "comment_id", "removed", "checksum", F.right("embedding_model", F.lit(1)).cast("bigint").alias("embedded_in"))


@query(
    "vector_lsh",
    """SELECT count(*) * least(5, any_value(n)) AS neighbours, true AS recall_reached, count(*) AS first_is_itself, true AS similarities_right
       FROM (SELECT *, (SELECT count(*) FROM embeddings) AS n FROM embeddings) WHERE vec_id % 100 = 0""",
)
def vector_lsh(t: Tables) -> DataFrame:
    """Search by hyperplanes held against the exact search: neighbours returned, whether nine in ten of the exact five are among them, queries
    that find themselves first (or a copy), and whether every similarity is the exact one."""
    asked = t.embeddings.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = settle(nearest_by_planes(t.embeddings, asked, 5, "vec_id", "embedding"), "nearest")
    exact = top_k_of_each(t.embeddings, asked, 5, "vec_id", "embedding").select("query_id", "vec_id", F.col("similarity").alias("exact"))
    both = found.join(exact, ["query_id", "vec_id"], "full")
    hit = F.count_if(F.col("exact").isNotNull() & F.col("similarity").isNotNull())
    return both.agg(
        F.count("similarity").alias("neighbours"),
        (hit >= 0.9 * F.count("exact")).alias("recall_reached"),
        F.count_if((F.col("rank") == 1) & (F.col("similarity") > 1 - 1e-6)).alias("first_is_itself"),
        (F.count_if(F.abs(F.col("exact") - F.col("similarity")) > 1e-9) == 0).alias("similarities_right"),
    )


@query(
    "passages_text",
    """SELECT doc_id, md5('[' || doc_id || '] ticket ' || source || CASE WHEN lang <> 'en' THEN ' product ' || lang ELSE '' END ||
         chr(10) || lang || chr(10) || text) AS passage_md5 FROM documents""",
)
def passages(t: Tables) -> DataFrame:
    chunks = t.documents.select(
        text("doc_id").alias("chunk_id"),
        F.col("source").alias("ticket_id"),
        F.nullif("lang", F.lit("en")).alias("product_sku"),
        F.col("lang").alias("heading"),
        F.col("text").alias("body"),
    )
    return passages_text(chunks).select(F.col("chunk_id").cast("bigint").alias("doc_id"), F.md5("passage").alias("passage_md5"))


@query(
    "bounded_result",
    """WITH head AS (SELECT doc_id, source, text, row_number() OVER (ORDER BY n_chars, doc_id) AS rn FROM documents
                     ORDER BY n_chars, doc_id LIMIT 51),
         sized AS (SELECT doc_id, source, rn, sum(strlen(to_json({'doc_id': doc_id, 'source': source, 'text': text, 'n_chars': length(text)})))
                     OVER (ORDER BY rn) AS bytes FROM head)
       SELECT doc_id, source, least(count(*) OVER (), 50) AS row_count,
         CASE WHEN count(*) OVER () < least((SELECT count(*) FROM head), 50) THEN 'bytes'
              WHEN (SELECT count(*) FROM head) > 50 THEN 'rows' END AS truncated_by
       FROM sized WHERE bytes <= 32768 QUALIFY rn <= 50""",
)
def bounded(t: Tables) -> DataFrame:
    """The shortest documents, up to 50 rows and 32 KiB of them."""
    rows = t.documents.select("doc_id", "source", "text", "n_chars")
    cut = bounded_result(rows, [F.col("n_chars").asc(), F.col("doc_id").asc()])
    return cut.select("doc_id", "source", F.col("row_count").cast("bigint").alias("row_count"), "truncated_by")


# --- evaluations -----------------------------------------------------------------------


def _responses(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    return t.documents.select(
        F.lit("answers").alias("dag_id"),
        text("doc_id").alias("run_id"),
        F.col("lang").alias("question"),
        F.md5("text").alias("answer"),
        F.when(F.col("lang") == "en", F.lit('["select 1","select 2"]')).alias("sql_used"),
        F.lit('["t1"]').alias("tables_used"),
        none.alias("chunks_used"),
        none.alias("freshness_note"),
        none.alias("caveats"),
        F.lit("high").alias("confidence"),
        F.when(F.col("lang") == "fr", F.lit("fixed")).alias("model"),
        F.lit("2026-08-01").cast("timestamp").alias("created_at"),
    )


def _scores(t: Tables) -> DataFrame:
    def graded(c: str, one: str, zero: str):
        return F.struct(
            F.when(F.col(c) == 1, one).otherwise(zero).alias("score"),
            F.when(F.col("quality") == F.col("toxic"), "low").otherwise("high").alias("confidence"),
            F.lit("r").alias("reasoning"),
        )

    return t.labels.select(
        F.lit("answers").alias("dag_id"),
        text("doc_id").alias("run_id"),
        F.to_json(
            F.struct(
                graded("quality", "good", "poor").alias("quality"),
                graded("toxic", "poor", "acceptable").alias("toxicity"),
                (F.col("quality") == 1).alias("data_was_fresh"),
            )
        ).alias("scores"),
        F.lit("2026-08-02").cast("timestamp").alias("scored_at"),
    )


def _answer_spans(t: Tables) -> DataFrame:
    """Two events per answer; those that are purchases or views belong to the answer."""
    return t.events.select(
        F.lit("answers").alias("dag_id"),
        text(F.floor(F.col("event_id") / 2)).alias("run_id"),
        F.when(F.col("event_type").isin("purchase", "view"), E.ANSWER_TASK).otherwise(F.col("event_type")).alias("task_id"),
        F.concat(F.lit("m-"), text(F.col("user_id") % 3)).alias("model"),
        F.lit("t0").alias("trace_id"),
        text("event_id").alias("span_id"),
        F.col("user_id").alias("input_tokens"),
        F.lit(None).cast("bigint").alias("output_tokens"),
        F.when(F.col("event_type") == "view", F.col("user_id")).alias("reasoning_tokens"),
        F.lit(None).cast("decimal(18,6)").alias("cost"),
        F.col("value").alias("duration_ms"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tool_call_count"),
        F.array(F.lit("a")).alias("tools_available"),
    )


def _records(t: Tables) -> DataFrame:
    return E.eval_records(_responses(t), _scores(t), _answer_spans(t))


_RECORDS = """
  SELECT 'answers:' || d.doc_id AS eval_id, lang, CASE WHEN lang = 'fr' THEN 'fixed' WHEN e.event_id IS NOT NULL THEN 'm-' || (user_id % 3) END AS model,
    CAST(e.event_id AS VARCHAR) AS span_id, e.event_id IS NULL AS has_no_trace, l.doc_id IS NOT NULL AS is_scored, quality, toxic,
    CASE WHEN event_type = 'view' THEN user_id END AS reasoning_tokens, value AS duration_ms,
    coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS tool_call_count
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN events e ON e.event_id // 2 = d.doc_id AND event_type IN ('purchase', 'view')"""


@query(
    "eval_records",
    f"""SELECT eval_id, model, span_id, has_no_trace, reasoning_tokens, duration_ms, tool_call_count,
          CAST(CASE WHEN lang = 'en' THEN 2 ELSE 0 END AS BIGINT) AS n_sql, CASE WHEN is_scored THEN 'quality,toxicity' ELSE '' END AS dimensions,
          CASE WHEN is_scored THEN 'data_was_fresh=' || CASE WHEN quality = 1 THEN 'true' ELSE 'false' END ELSE '' END AS flags,
          CASE WHEN is_scored THEN '2026-08-02 00:00:00' ELSE '2026-08-01 00:00:00' END AS sort_at FROM ({_RECORDS})""",
)
def eval_records(t: Tables) -> DataFrame:
    flags = F.transform(F.map_entries("flags"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return plain(
        E.newest_first(_records(t)).select(
            "eval_id", "model", "span_id", "has_no_trace", "reasoning_tokens", "duration_ms", "tool_call_count",
            F.size("sql_used").alias("n_sql"),
            F.array_join(F.array_sort(F.map_keys("dimensions")), ",").alias("dimensions"),
            F.array_join(flags, ",").alias("flags"),
            "sort_at",
        )
    )


def _answer_calls(t: Tables) -> DataFrame:
    """Clicks are tool calls of the event above them in the tree of events."""
    calls = t.events.filter("event_type = 'click' AND event_id >= 3").select(
        F.lit("t0").alias("trace_id"),
        text(F.floor((F.col("event_id") - 1) / 3)).alias("run_span_id"),
        text("event_id").alias("span_id"),
        F.lit("tool_call").alias("kind"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("start_unix_nano"),
        F.concat(F.lit("tool-"), F.get_json_object("props", "$.k")).alias("tool"),
        F.col("value").alias("duration_ms"),
    )
    return tool_call_lists(calls, segment_rows=2)


def _entry_sql(score: str, low: str) -> str:
    return f"""'{{"score":"' || {score} || '","confidence":"' || CASE WHEN {low} THEN 'low' ELSE 'high' END || '","reasoning":"r"}}'"""


@query(
    "eval_records_whole",
    f"""WITH calls AS (
          SELECT CAST(CAST(floor((event_id - 1) / 3) AS BIGINT) AS VARCHAR) AS span_id,
            string_agg('tool-' || json_extract_string(props, '$.k'), ',' ORDER BY epoch_us(ts), CAST(event_id AS VARCHAR)) AS tool_calls
          FROM events WHERE event_type = 'click' AND event_id >= 3 GROUP BY 1)
        SELECT eval_id, 'answers' AS dag_id, split_part(eval_id, ':', 2) AS run_id, lang AS question, answer,
          CASE WHEN lang = 'en' THEN 'select 1;select 2' ELSE '' END AS sql_used, 't1' AS tables_used, '' AS chunks_used,
          NULL::VARCHAR AS freshness_note, NULL::VARCHAR AS caveats, 'high' AS confidence, model, CASE WHEN has_no_trace THEN NULL ELSE 't0' END AS trace_id, r.span_id,
          has_no_trace, input_tokens, NULL::BIGINT AS output_tokens, reasoning_tokens, NULL::DOUBLE AS cost, duration_ms, tool_call_count,
          CASE WHEN has_no_trace THEN '' ELSE 'a' END AS tools_available,
          CASE WHEN is_scored THEN 'quality=' || {_entry_sql("CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END", 'quality = toxic')} || ';toxicity=' ||
            {_entry_sql("CASE WHEN toxic = 1 THEN 'poor' ELSE 'acceptable' END", 'quality = toxic')} ELSE '' END AS dimensions,
          CASE WHEN is_scored THEN 'data_was_fresh=' || CASE WHEN quality = 1 THEN 'true' ELSE 'false' END ELSE '' END AS flags,
          CASE WHEN is_scored THEN TIMESTAMP '2026-08-02' END AS scored_at,
          CASE WHEN is_scored THEN TIMESTAMP '2026-08-02' ELSE TIMESTAMP '2026-08-01' END AS sort_at, coalesce(tool_calls, '') AS tool_calls
        FROM ({_RECORDS.replace('lang,', 'lang, md5(text) AS answer, user_id AS input_tokens,', 1)}) r LEFT JOIN calls ON calls.span_id = r.span_id""",
)
def eval_records_whole(t: Tables) -> DataFrame:
    """Every column of a record with the types it has, and the ordered calls of its span."""
    records = E.eval_records(_responses(t), _scores(t), _answer_spans(t), calls=_answer_calls(t))
    listed = lambda c: F.array_join(c, ";").alias(c)
    entries = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias(c)
    plain_columns = [c for c in records.columns if c not in ("sql_used", "tables_used", "chunks_used", "tools_available", "dimensions", "flags", "tool_calls")]
    return records.select(
        *plain_columns, listed("sql_used"), listed("tables_used"), listed("chunks_used"), listed("tools_available"), entries("dimensions"), entries("flags"),
        F.array_join(F.transform("tool_calls", lambda c: c["tool"]), ",").alias("tool_calls"),
    )


@query(
    "eval_dimensions",
    f"""WITH r AS ({_RECORDS}), d AS (
          SELECT 'quality' AS name, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS score, quality = toxic AS low FROM r WHERE is_scored
          UNION ALL SELECT 'toxicity', CASE WHEN toxic = 1 THEN 'poor' ELSE 'acceptable' END, quality = toxic FROM r WHERE is_scored),
        c AS (SELECT name, count(*) AS counted, count(*) FILTER (WHERE score = 'good') AS good,
          count(*) FILTER (WHERE score = 'acceptable') AS acceptable, count(*) FILTER (WHERE score = 'poor') AS poor,
          count(*) FILTER (WHERE low) AS low_confidence FROM d GROUP BY 1)
        SELECT *, CAST(floor(100 * good / counted + 0.5) AS BIGINT) AS good_percent,
          CAST(floor(100 * acceptable / counted + 0.5) AS BIGINT) AS acceptable_percent,
          CAST(floor(100 * poor / counted + 0.5) AS BIGINT) AS poor_percent FROM c""",
)
def eval_dimensions(t: Tables) -> DataFrame:
    return E.eval_dimensions(_records(t))


@query(
    "eval_summary",
    f"""SELECT count(*) AS scored, CAST(round_even(avg(reasoning_tokens), 0) AS BIGINT) AS avg_reasoning_tokens,
          round_even(avg(duration_ms), 1) AS avg_duration_ms, round_even(avg(tool_call_count), 1) AS avg_tool_calls FROM ({_RECORDS})""",
)
def eval_summary(t: Tables) -> DataFrame:
    return E.eval_summary(_records(t))
