import json
import random

from rows import as_set
from pyspark.sql import functions as F

from tierstone.functions import spans as S
from tierstone.operators import agent_runs as A
from tierstone.operators import ancestry
from tierstone.operators.ancestry import nearest_ancestor, nearest_or_self
from tierstone.sources.otlp import flatten_spans, read_spans
from tierstone.streaming import spans as store_of
from tierstone.streaming.spans import batches, compact, pieces, stored_runs, stored_spans, stream_spans


def walk(parents, marked, node, include_self):
    seen, current = set(), node if include_self else parents.get(node)
    while current is not None and current not in seen:
        if current in marked:
            return current
        seen.add(current)
        current = parents.get(current)
    return None


def test_ancestors_equal_a_plain_walk(frame):
    rng = random.Random(11)
    cases = {
        # two-node cycle, self-loop, orphan, a root inside a cycle, nested roots
        "edges": ({"a": "b", "b": "a", "c": "c", "d": "zz", "e": "f", "f": "e", "g": "f", "h": "g", "r": None, "s": "r", "t": "s"},
                  {"f", "r", "s"}),
        "chain": ({str(i): str(i - 1) if i else None for i in range(70)}, {"0", "40"}),
        "forest": ({str(i): (str(rng.randrange(i)) if i and rng.random() < 0.95 else None) for i in range(300)},
                   {str(rng.randrange(300)) for _ in range(25)}),
        "star": ({str(i): "0" if i else None for i in range(200)}, {"0"}),
    }
    rows = [(t, n, p, n in marked) for t, (parents, marked) in cases.items() for n, p in parents.items()]
    df = frame("trace string, node string, parent string, hit boolean", *rows)
    for include_self, search, column in ((False, nearest_ancestor, "ancestor"), (True, nearest_or_self, "found")):
        got = search(df, "node", "parent", F.col("hit"), ["trace"]).select("trace", "node", column)
        expected = {(t, n, walk(p, m, n, include_self)) for t, (p, m) in cases.items() for n in p}
        assert as_set(got) == expected
    # the other ways: all forests by doubling, the large ones alone, and one forest without a scope
    expected = {(t, n, walk(p, m, n, True)) for t, (p, m) in cases.items() for n in p}
    for small in (0, 100):
        got = nearest_or_self(df, "node", "parent", F.col("hit"), ["trace"], small=small).select("trace", "node", "found")
        assert as_set(got) == expected
    chain = df.filter("trace = 'chain'").drop("trace")
    for small in (0, 1000):
        got = nearest_or_self(chain, "node", "parent", F.col("hit"), small=small)
        assert {tuple(r) for r in got.collect()} == {(n, f) for t, n, f in expected if t == "chain"}


def test_doubling_writes_half_the_rounds(frame, monkeypatch):
    chain = frame("node string, parent string, hit boolean", *[(str(i), str(i - 1) if i else None, i == 0) for i in range(64)])
    written = []
    real = ancestry._write
    monkeypatch.setattr(ancestry, "_write", lambda *a: written.append(1) or real(*a))
    assert nearest_or_self(chain, "node", "parent", F.col("hit"), small=0).filter("found = '0'").count() == 64
    assert len(written) - 1 <= 3  # the first write holds the forest itself; six doublings


def attr(key, **value):
    return {"key": key, "value": value}


def line(*spans, snake=False, service="svc"):
    if snake:
        return json.dumps({"resource_spans": [{"resource": {"attributes": [attr("service.name", string_value=service)]},
                                               "scope_spans": [{"spans": list(spans)}]}]})
    return json.dumps({"resourceSpans": [{"resource": {"attributes": [attr("service.name", stringValue=service)]},
                                          "scopeSpans": [{"spans": list(spans)}]}]})


def span(ident, parent=None, name="n", start="1000000000", end="1002500000", attributes=(), trace="t"):
    s = {"traceId": trace, "spanId": ident, "name": name, "startTimeUnixNano": start, "endTimeUnixNano": end,
         "attributes": list(attributes)}
    return s | ({"parentSpanId": parent} if parent is not None else {})


def test_flatten_both_casings_and_broken_lines(frame):
    snake = {"trace_id": "t", "span_id": "2", "parent_span_id": "1", "name": "x", "start_time_unix_nano": 5,
             "end_time_unix_nano": 0, "attributes": [attr("k", int_value=7)]}
    lines = frame("value string", line(span("1")), "", "   ", "{broken", "[]", "null", line(snake, snake=True))
    got = {r["span_id"]: r for r in flatten_spans(lines).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"]["duration_ms"], got["1"]["service_name"], got["1"]["parent_span_id"]) == (2.5, "svc", None)
    # a missing end has no duration
    assert (got["2"]["duration_ms"], got["2"]["start_unix_nano"], got["2"]["attributes"]) == (None, 5, {"k": "7"})


def test_an_export_that_is_not_there_yet_has_no_spans(spark, tmp_path):
    assert read_spans(spark, str(tmp_path / "none.jsonl")).isEmpty()
    (tmp_path / "some.jsonl").write_text(line(span("1")) + "\n\n{broken\n")
    assert read_spans(spark, str(tmp_path / "some.jsonl")).count() == 1


def test_attribute_values(frame):
    listed = [
        attr("s", stringValue=""), attr("i", intValue="12"), attr("d", doubleValue=1.5), attr("b", boolValue=True),
        attr("x", bytesValue="AA=="), attr("twice", intValue=1), attr("twice", intValue=2),
        attr("a", arrayValue={"values": [{"stringValue": 'q"\\\n'}, {"intValue": "5"}, {"boolValue": False}, {}]}),
        attr("kv", kvlist_value={"values": [attr("p", array_value={"values": [{"int_value": 1}]}), attr("q", stringValue="v")]}),
        {"key": "empty"}, attr("none", arrayValue={}),
    ]
    got = flatten_spans(frame("value string", line(span("1", attributes=listed)))).first()["attributes"]
    assert {k: got[k] for k in ("s", "i", "d", "b", "x", "twice", "empty")} == {
        "s": "", "i": "12", "d": "1.5", "b": "true", "x": None, "twice": "2", "empty": None,
    }
    assert json.loads(got["a"]) == ['q"\\\n', 5, False, None]
    assert json.loads(got["kv"]) == {"p": [1], "q": "v"} and got["none"] == "[]"


def wrapped(value, suffix="Value"):
    """A plain value in the wire format."""
    if isinstance(value, bool):
        return {f"bool{suffix}": value}
    if isinstance(value, int):
        return {f"int{suffix}": str(value)}
    if isinstance(value, float):
        return {f"double{suffix}": value}
    if isinstance(value, str):
        return {f"string{suffix}": value}
    if isinstance(value, list):
        return {f"array{suffix}": {"values": [wrapped(v, suffix) for v in value]} if value else {}}
    if isinstance(value, dict):
        return {f"kvlist{suffix}": {"values": [{"key": k, "value": wrapped(v, suffix)} for k, v in value.items()]} if value else {}}
    return {}


def test_values_of_any_depth(frame):
    def nested(n):
        return ["leaf", n] if n == 0 else [n, nested(n - 1), {"k": 'a}]}"\\ {[', "d": nested(n - 2) if n > 1 else {}}]

    values = [
        nested(9), nested(4), [[[[[[]]]]]], [[[[[{}]]]]], {"a": {"b": {"c": {"d": {"e": {"f": [1, {"g": None}]}}}}}}, ["flat"], [[[["four"]]]],
        [[[[[1.5, True, None, 'q"\\\n{"intValue":5}', {"stringValue": "x", "int_value": [7]}]]]]],
    ]
    lines = [
        line(span(f"{suffix}{i}", attributes=[{"key": "v", "value": wrapped(v, suffix)}])) for suffix in ("Value", "_value") for i, v in enumerate(values)
    ]
    got = {r["span_id"]: json.loads(r["attributes"]["v"]) for r in flatten_spans(frame("value string", *lines)).collect()}
    assert all(got[f"{suffix}{i}"] == v for suffix in ("Value", "_value") for i, v in enumerate(values))


def test_first_attr_keeps_zero_and_blank(frame):
    df = frame("m map<string,string>", ({"a": None, "b": "0"},), ({"a": "", "b": "1"},), ({},))
    assert [r[0] for r in df.select(S.first_attr(F.col("m"), ["a", "b", "c"])).collect()] == ["0", "", None]


def test_classification(frame):
    op, genai = S.OPERATION, {"gen_ai.x": "1"}
    cases = [
        ({op: "invoke_agent"}, "z", "agent_run"), ({op: "chat"}, None, "model_call"), ({op: "execute_tool"}, "chat", "tool_call"),
        ({op: "text_completion"}, "", "model_call"), ({op: "embed"}, "chat m", None), (genai, "chat m", "model_call"),
        (genai, "invoke_agent x", "agent_run"), (genai, "execute_tool y", "tool_call"), (genai, None, None),
        ({"other": "1"}, "chat m", None),
    ]
    df = frame("i int, attributes map<string,string>, name string", *[(i, a, n) for i, (a, n, _) in enumerate(cases)])
    got = {r["i"]: r["kind"] for r in A.tag(df).collect()}
    assert [got[i] for i in range(len(cases))] == [k for _, _, k in cases]


def test_offered_tools_and_json_or_raw(frame):
    key = S.TOOL_DEFINITIONS[0]
    df = frame(
        "m map<string,string>",
        ({key: '[{"name":"a"},{"x":1},{"name":""},"s",{"name":"b"}]'},), ({key: "{bad"},), ({key: '{"name":"a"}'},), ({},),
    )
    assert [r[0] for r in df.select(S.offered_tools(F.col("m"))).collect()] == [["a", "b"], [], [], []]
    texts = frame("x string", '{"b": 1}', "plain", "[1, 2]", None)
    got = [r[0] for r in texts.select(F.to_json(S.json_or_raw(F.col("x")))).collect()]
    assert got == ['{"b":1}', '"plain"', "[1,2]", None]


TASK = [attr("airflow.dag_id", stringValue="d"), attr("airflow.task_id", stringValue="answer_question"),
        attr("airflow.dag_run.run_id", stringValue="r1"), attr("airflow.task_instance.try_number", intValue=1)]
AGENT = [attr(S.OPERATION, stringValue="invoke_agent"), attr("model_name", stringValue="m"),
         attr("gen_ai.usage.input_tokens", intValue=0), attr("gen_ai.aggregated_usage.input_tokens", intValue=9),
         attr("final_result", stringValue='{"answer": 1}')]


def tool(name):
    return [attr(S.OPERATION, stringValue="execute_tool"), attr(S.TOOL_NAME, stringValue=name)]


OFFER = [attr(S.OPERATION, stringValue="chat"), attr(S.TOOL_DEFINITIONS[0], stringValue='[{"name":"z"},{"name":"a"},{"name":"z"}]')]


def spans_of_a_run():
    return [
        span("task", name="task", attributes=TASK),
        span("agent", "task", attributes=AGENT),
        span("c1", "agent", start="1000000003", attributes=tool("b")),
        span("c2", "c1", start="1000000001", attributes=tool("a")),
        span("c3", "agent", start="1000000004", attributes=tool("b")),
        span("m1", "agent", start="1000000002", attributes=OFFER),
        span("inner", "agent", attributes=[attr(S.OPERATION, stringValue="invoke_agent")]),
        span("c4", "inner", attributes=tool("deep")),
        span("lost", "nowhere", attributes=tool("lost")),
    ]


def test_agent_runs(frame):
    df = flatten_spans(frame("value string", *[line(s) for s in spans_of_a_run()]))
    got = {r["span_id"]: r for r in A.agent_runs(df).collect()}
    assert set(got) == {"agent", "inner"}
    run = got["agent"]
    # zero tokens are present and keep the next key out
    assert (run["model"], run["input_tokens"], run["output"], run["tool_call_count"]) == ("m", 0, '{"answer":1}', 3)
    assert (run["tools_used"], run["tools_available"]) == (["a", "b"], ["z", "a"])
    assert (run["dag_id"], run["run_id"], run["try_number"]) == ("d", "r1", "1")
    # the nested run owns its calls and inherits the task
    assert (got["inner"]["tools_used"], got["inner"]["task_id"]) == (["deep"], "answer_question")
    tagged = A.tag(df)
    lists = A.tool_call_lists(A.owned_spans(tagged, A.owning_run(tagged)), segment_rows=2)
    calls = {(r["run_span_id"], r["segment"]): [c["tool"] for c in r["tool_calls"]] for r in lists.collect()}
    assert calls == {("agent", 0): ["a", "b"], ("agent", 1): ["b"], ("inner", 0): ["deep"]}


def test_stream_resolves_late_parents_and_is_idempotent(spark, frame, tmp_path):
    landing, store, mark = (str(tmp_path / n) for n in ("in", "store", "mark"))
    all_spans = spans_of_a_run()

    def export(*spans):
        frame("value string", *[line(s) for s in spans]).coalesce(1).write.mode("append").text(landing)
        stream_spans(spark, landing, store, mark, depth=2).awaitTermination()

    export(*all_spans[2:])
    assert {r["span_id"] for r in stored_runs(spark, store).collect()} == {"inner"}
    export(all_spans[1])
    export(all_spans[0], all_spans[3])  # the task arrives last, one span a second time
    export(span("x", trace="another"))
    assert stored_spans(spark, store).count() == 11
    expected = A.agent_runs(flatten_spans(frame("value string", *[line(s) for s in all_spans])))
    got = stored_runs(spark, store).drop("ingested_at")
    assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(
        map(str, expected.select(*sorted(got.columns)).collect())
    )
    # nothing new: the checkpoint remembers the files
    stream_spans(spark, landing, store, mark, depth=2).awaitTermination()
    assert stored_spans(spark, store).count() == 11


def agent_trace(trace, calls=2):
    """An agent run with its task and some calls."""
    return [
        span(f"{trace}-task", name="task", attributes=TASK, trace=trace),
        span(f"{trace}-run", f"{trace}-task", attributes=AGENT, trace=trace),
        *[span(f"{trace}-c{i}", f"{trace}-run", start=str(1_000_000_000 + i), attributes=tool(f"tool{i}"), trace=trace) for i in range(calls)],
    ]


class Lake:
    def __init__(self, spark, frame, tmp_path, **options):
        self.spark, self.frame, self.options = spark, frame, options
        self.landing, self.store, self.mark = (str(tmp_path / n) for n in ("in", "store", "mark"))
        self.sent = []

    def export(self, *spans):
        self.sent += spans
        self.frame("value string", *[line(s) for s in spans]).coalesce(1).write.mode("append").text(self.landing)
        stream_spans(self.spark, self.landing, self.store, self.mark, **self.options).awaitTermination()

    def check(self):
        expected = A.agent_runs(flatten_spans(self.frame("value string", *[line(s) for s in self.sent])))
        got = stored_runs(self.spark, self.store).drop("ingested_at")
        shown = lambda df: sorted(map(str, df.select(*sorted(got.columns)).collect()))
        assert shown(got) == shown(expected)
        assert stored_spans(self.spark, self.store).count() == len(self.sent)


def test_a_batch_reads_only_the_pieces_of_its_traces(spark, frame, tmp_path, monkeypatch):
    lake = Lake(spark, frame, tmp_path, depth=3)
    lake.export(*[s for i in range(40) for s in agent_trace(f"t{i}")])
    read = []
    real = store_of.read_pieces
    monkeypatch.setattr(store_of, "read_pieces", lambda spark, found: read.extend(p.path for p in found) or real(spark, found))
    lake.export(span("late", "t7-run", start="1000000009", attributes=tool("late"), trace="t7"), *agent_trace("new"))
    bucket = frame("trace_id string", "t7").select(F.xxhash64("trace_id").alias("hash")).select(store_of._bucket(3)).first()[0]
    of_spans = [p for p in read if "/spans/" in p]
    assert len(of_spans) == 1 and f"/depth=3/bucket={bucket}/first=0/last=0" in of_spans[0]
    assert len([p for p in read if "/runs/" in p]) == 1 and len([p for p in read if "/traces/" in p]) <= 2  # the index in the two touched buckets
    monkeypatch.undo()
    lake.check()
    late = [r for r in stored_runs(spark, lake.store).collect() if r["trace_id"] == "t7"]
    assert len(late) == 1 and late[0]["tool_call_count"] == 3


def test_ten_batches_cost_the_same_and_depth_grows(spark, frame, tmp_path, monkeypatch):
    lake = Lake(spark, frame, tmp_path, depth=1, bucket_traces=5)
    # what the runs are is tested elsewhere; here it is what a batch reads
    none = A.agent_runs(flatten_spans(frame("value string", line(span("1"))))).schema
    monkeypatch.setattr(store_of, "agent_runs", lambda spans: spark.createDataFrame([], none))
    for b in range(10):
        late = [span(f"late{b}", f"b{b - 1}-0-run", start="1000000009", attributes=tool("late"), trace=f"b{b - 1}-0")] if b else []
        lake.export(*late, *[s for i in range(4) for s in agent_trace(f"b{b}-{i}", 1)])
    seen = [r.asDict() for r in batches(spark, lake.store).orderBy("batch").collect()]
    assert [r["pieces_read"] for r in seen] == [0] + [1] * 9  # one trace of the batch before, and no more as the store grows
    assert [r["total_traces"] for r in seen] == [4 * (b + 1) for b in range(10)]
    assert seen[0]["depth"] == 1 and seen[-1]["depth"] == 3 and len({p.depth for p in pieces(spark, f"{lake.store}/spans")}) == 3
    assert stored_spans(spark, lake.store).count() == len(lake.sent)


def test_compaction_merges_small_neighbours_and_can_be_stopped(spark, frame, tmp_path, monkeypatch):
    lake = Lake(spark, frame, tmp_path, depth=0)
    for b in range(3):
        lake.export(*agent_trace(f"t{b}", 1), span(f"x{b}", "t0-run", start=str(1_000_000_010 + b), attributes=tool(f"x{b}"), trace="t0"))
    assert len(pieces(spark, f"{lake.store}/spans")) == 3
    # stopped after the merged spans are written: their sources are still there, and dead
    with monkeypatch.context() as m:
        m.setattr(store_of, "_drop_dead", lambda *_: 1 / 0)
        try:
            compact(spark, lake.store, most=2)
        except ZeroDivisionError:
            pass
    assert len(pieces(spark, f"{lake.store}/spans")) == 1 and len(pieces(spark, f"{lake.store}/traces")) == 3
    lake.export(span("between", "t2-run", start="1000000030", attributes=tool("between"), trace="t2"))
    lake.check()
    gone = compact(spark, lake.store, most=2)
    assert gone >= 6 and all(len(pieces(spark, f"{lake.store}/{t}")) <= 2 for t in ("spans", "runs", "traces"))
    lake.export(span("after", "t1-run", start="1000000031", attributes=tool("after"), trace="t1"))
    lake.check()
    assert compact(spark, lake.store, most=1, sealed_bytes=1) == 0  # every piece is sealed


def test_a_batch_that_is_taken_again_changes_nothing(spark, frame, tmp_path):
    lake = Lake(spark, frame, tmp_path, depth=1)
    lake.export(*agent_trace("a"))
    again = [span("c9", "a-run", start="1000000009", attributes=tool("z"), trace="a"), *agent_trace("b")]
    lake.export(*again)
    batch = flatten_spans(frame("value string", *[line(s) for s in again]))
    store_of._absorb(batch, 1, lake.store, 1, 100)
    lake.check()
    assert [r["total_traces"] for r in batches(spark, lake.store).orderBy("batch").collect()] == [1, 2]


def test_a_batch_of_many_buckets_reads_the_index_whole(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(store_of, "LISTED", 1)
    lake = Lake(spark, frame, tmp_path, depth=3)
    for b in range(2):
        lake.export(*[span(f"{b}-{i}", f"t{i}-run" if b else None, attributes=tool("x") if b else AGENT, trace=f"t{i}") if b else
                      span(f"t{i}-run", attributes=AGENT, trace=f"t{i}") for i in range(12)])
    lake.check()


def test_a_value_given_as_text_is_parsed_once_and_rewritten_once(spark):
    """The plan names the parser of the value itself once, not once for each kind of value and each spelling."""
    from tierstone.functions import spans as S

    value = F.from_json(F.col("t"), S.VALUE_TYPE)
    rows = spark.createDataFrame([('{"arrayValue":{"values":[' * 8 + '{"intValue":"7"}' + "]}}" * 8,)], "t string").select(S.attribute_text(value).alias("v"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 1 + 2 * (S.NESTING + 1), plan.count("from_json")
    assert rows.first()["v"] == "[" * 8 + "7" + "]" * 8


def test_repeated_spans_are_taken_out_once(frame):
    """What is left of repeated spans is written once, not worked out again for each operator that reads it."""
    plan = A.agent_runs(flatten_spans(frame("value string", line(span("1")))))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
