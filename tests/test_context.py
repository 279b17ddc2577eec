import datetime as dt
import hashlib
import uuid

import numpy as np
from rows import as_set
from pyspark.sql import functions as F

from tierstone.operators import chunks as C
from tierstone.operators import evals as E
from tierstone.operators.results import bounded_result, load_report, passages_text
from tierstone.operators.vectors import search, top_k_of_each, top_k_similar

TICKETS = "ticket_id string, customer_id string, product_sku string, subject string, body string"
COMMENTS = "comment_id string, ticket_id string, author_role string, body string, created_at timestamp"


def at(hour):
    return dt.datetime(2026, 3, 1) + dt.timedelta(hours=hour)


def chunked(frame):
    body = "b" * 300
    tickets = frame(TICKETS, ("t1", "c", "s", "Subject", body), ("t2", None, None, None, "short"))
    comments = frame(
        COMMENTS,
        ("c9", "t1", "customer", body, at(0)), ("c2", "t1", "agent", "x" * 199, at(30)), ("c3", "t1", "agent", "y" * 200, at(60)),
        ("c1", "t1", "customer", "z" * 250, at(60)), ("c0", "t1", "customer", "w" * 250, None), ("q", "none", "agent", "v" * 250, at(1)),
    )
    return C.chunk(tickets, comments)


def test_chunks(frame):
    got = {r["comment_id"] or r["ticket_id"]: r for r in chunked(frame).collect()}
    # an untimed comment sorts first; the duplicate of the ticket and the 199 characters leave gaps
    assert {k: r["chunk_ordinal"] for k, r in got.items()} == {"t1": 0, "t2": 0, "c0": 1, "c1": 4, "c3": 5}
    assert got["c3"]["body"] == "agent: " + "y" * 200 and got["c3"]["heading"] == "Subject"
    assert got["c3"]["chunk_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "t1:comment:c3"))
    assert got["t1"]["chunk_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "t1:ticket:0"))
    assert got["t2"]["checksum"] == hashlib.sha256(b"short").hexdigest()[:16]
    assert (got["c3"]["customer_id"], got["c3"]["product_sku"], got["t1"]["source_kind"]) == ("c", "s", "ticket")


def test_embed_order_batches_and_skip(frame):
    seen = []

    def embedder(texts):
        seen.append(len(texts))
        return np.array([[len(t), i] for i, t in enumerate(texts)], dtype=np.float32)

    df = frame("id int, t string", *[(i, "x" * i) for i in range(600)]).coalesce(1)
    vectors = {r["id"]: r["embedding"] for r in C.embed(df, "t", embedder).collect()}
    assert all(vectors[i] == [i, i % 256] for i in range(600))
    chunks = chunked(frame)
    store = C.embed(chunks, "body", C.hash_embedder(8))
    assert C.embed_changed(chunks, store, "m", C.hash_embedder(8)).isEmpty()
    renamed = chunks.withColumn("heading", F.lit("Other"))
    assert C.embed_changed(renamed, store, "m", C.hash_embedder(8)).isEmpty()
    assert C.embed_changed(renamed, store, "m", C.hash_embedder(8), whole_text=True).count() == 5
    partly = store.withColumn("embedding", F.when(F.col("comment_id").isNull(), F.col("embedding")))
    again = C.embed_changed(chunks, partly, "m", C.hash_embedder(8))
    assert as_set(again.select("comment_id", "embedding_model")) == {("c0", "m"), ("c1", "m"), ("c3", "m")}
    unit = C.hash_embedder(16)(["a b", "a b", "", "c"])
    assert np.allclose(unit[0], unit[1]) and not unit[2].any() and np.isclose(np.linalg.norm(unit[3]), 1)


def test_vector_search(frame):
    rows = [("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [1.0, 1.0]), ("d", [-1.0, 0.0]), ("n", None), ("z", [0.0, 0.0])]
    corpus = frame("id string, v array<float>", *rows).repartition(3)
    hits = top_k_similar(corpus, [3.0, 0.0], 3, "id", "v").collect()
    assert [r["id"] for r in hits] == ["a", "b", "c"]  # exact tie by id
    assert [round(r["similarity"], 6) for r in hits] == [1.0, 1.0, 0.707107]
    every = top_k_similar(corpus, [3.0, 0.0], 99, "id", "v").collect()
    assert [r["id"] for r in every] == ["a", "b", "c", "d", "z"] and every[-1]["similarity"] is None


def test_vector_search_equals_brute_force(frame):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(500, 12))
    wanted = rng.normal(size=12)
    exact = data @ wanted / np.linalg.norm(data, axis=1) / np.linalg.norm(wanted)
    corpus = frame("id int, v array<double>", *[(i, row.tolist()) for i, row in enumerate(data)]).repartition(5)
    got = [r["id"] for r in top_k_similar(corpus, wanted.tolist(), 20, "id", "v").collect()]
    assert got == np.argsort(-exact)[:20].tolist()


def test_search_store_and_passages(frame):
    store = C.embed(chunked(frame), "body", C.hash_embedder(32))
    query = C.hash_embedder(32)(["short"])[0].tolist()
    best = search(store, query, 1)
    assert best.select("ticket_id", "comment_id").first() == ("t2", None)
    text = passages_text(best).first()
    assert text["passage"] == f"[{text['chunk_id']}] ticket t2\nNone\nshort"
    other = passages_text(store.filter("comment_id = 'c1'")).first()["passage"]
    assert other.split("\n")[0].endswith("] ticket t1 product s")


def test_bounded_result(frame):
    df = frame("i int, s string", *[(i, "x") for i in range(51)])
    order = [F.col("i").asc()]
    cut = bounded_result(df, order)
    assert cut.count() == 50 and as_set(cut.select("row_count", "truncated_by")) == {(50, "rows")}
    whole = bounded_result(df.filter("i < 50"), order)
    assert whole.count() == 50 and as_set(whole.select("truncated_by")) == {(None,)}
    wide = frame("i int, s string", (1, "x" * 20_000), (2, "x" * 20_000))
    assert as_set(bounded_result(wide, order).select("i", "row_count", "truncated_by")) == {(1, 1, "bytes")}


def test_search_for_a_set_of_vectors(frame):
    corpus = frame("id string, v array<float>", ("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 3.0]), ("z", [0.0, 0.0]), ("n", None))
    asked = frame("query_id int, v array<float>", (1, [5.0, 0.0]), (2, [1.0, 1.0]), (3, None))
    got = top_k_of_each(corpus, asked, 4, "id", "v")
    ranked = {(r["query_id"], r["rank"]): (r["id"], r["similarity"]) for r in got.collect()}
    assert [ranked[1, i][0] for i in (1, 2, 3, 4)] == ["a", "b", "c", "z"] and ranked[1, 4][1] is None
    assert [ranked[2, i][0] for i in (1, 2, 3, 4)] == ["a", "b", "c", "z"] and len(ranked) == 8
    assert top_k_of_each(corpus, asked.limit(0), 4, "id", "v").collect() == []


def test_load_report(frame):
    df = frame("t string, f string", ("a", "1"), ("a", "1"), ("a", "2"), ("b", "1"))
    assert as_set(load_report(df, "t", "f")) == {("a", 2, 3, False), ("b", 1, 1, False), (None, 3, 4, True)}
    assert as_set(load_report(df, "t", "f", total=False)) == {("a", 2, 3, False), ("b", 1, 1, False)}


RESPONSES = (
    "dag_id string, run_id string, question string, answer string, sql_used string, tables_used string, chunks_used string,"
    " freshness_note string, caveats string, confidence string, model string, created_at timestamp"
)
SPANS = (
    "dag_id string, run_id string, task_id string, model string, trace_id string, span_id string, input_tokens bigint,"
    " output_tokens bigint, reasoning_tokens bigint, cost decimal(18,6), duration_ms double, tool_call_count bigint,"
    " tools_available array<string>"
)


def records(frame):
    answer = ("q", "a", '["s"]', None, None, None, None, "high")
    responses = frame(
        RESPONSES, ("d", "1", *answer, None, at(1)), ("d", "2", *answer, "own", at(2)), ("d", "3", *answer, None, at(9)),
    )
    scores = frame(
        "dag_id string, run_id string, scores string, scored_at timestamp",
        ("d", "1", '{"grounded":{"score":"good","confidence":"low"},"sql":{"score":"poor","confidence":"high"},"fresh":true}', at(5)),
        ("d", "2", '{"grounded":{"score":"acceptable","confidence":"high"},"note":{"text":"x"},"empty":{"score":null}}', at(4)),
    )
    spans = frame(
        SPANS,
        ("d", "1", E.ANSWER_TASK, "m", "t", "s1", 1, 1, None, None, 2.25, 3, ["z"]),
        ("d", "1", E.ANSWER_TASK, "m", "t", "s2", 1, 1, None, None, 4.0, 0, []),
        ("d", "2", "judge_answer", "m", "t", "s3", 1, 1, 7, None, 9.0, 5, []),
    )
    return E.eval_records(responses, scores, spans)


def test_eval_records(frame):
    rows = E.newest_first(records(frame)).collect()
    assert [(r["eval_id"], r["span_id"]) for r in rows] == [("d:3", None), ("d:1", "s1"), ("d:1", "s2"), ("d:2", None)]
    unscored, first, _, second = rows
    assert (unscored["dimensions"], unscored["flags"], unscored["has_no_trace"], unscored["tool_call_count"]) == ({}, {}, True, 0)
    assert set(first["dimensions"]) == {"grounded", "sql"} and first["flags"] == {"fresh": "true"}
    assert (first["model"], second["model"], first["sql_used"], first["tables_used"]) == ("m", "own", ["s"], [])
    assert set(second["flags"]) == {"note"} and set(second["dimensions"]) == {"grounded", "empty"}


def test_eval_rollups(frame):
    rows = {r["name"]: r.asDict() for r in E.eval_dimensions(records(frame)).collect()}
    assert rows["grounded"] == {
        "name": "grounded", "counted": 3, "good": 2, "acceptable": 1, "poor": 0, "low_confidence": 2, "good_percent": 67,
        "acceptable_percent": 33, "poor_percent": 0,
    }
    assert rows["sql"]["poor"] == 2 and len(rows) == 3
    assert E.eval_summary(records(frame)).first() == (4, None, 3.1, 0.8)
    assert E.eval_summary(records(frame), dedupe=True).first() == (3, None, 2.2, 1.0)
    assert E.eval_summary(records(frame).limit(0)).first() == (0, None, None, None)
