from collections import Counter

import pytest

from tierstone.llm import mixing
from tierstone.llm.queries import schedule

from llm_rows import rows_of


def test_targets_share_the_excess_by_weight():
    assert mixing.fill_targets([100, 100, 100], [3, 1, 2], 1.5, 2.0) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.fill_targets([0, 10], [3, 1], 1.5, 2.0) == [0.0, 15.0]
    assert mixing.fill_targets([0, 0], [3, 1], 1.5, 2.0) == [0.0, 0.0]


def corpus(documents):
    return documents(*[(i, "w " * (i % 7 + 1), "en", ["a", "b", "c", None][i % 4]) for i in range(400)])


def test_taken_words_meet_targets_and_reruns_agree(documents):
    docs = corpus(documents)
    plan = mixing.plan_mix(docs, schedule, 1.5).collect()
    for source in ("a", "b", "c", None):
        own = [r for r in plan if r["source"] == source]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])
        assert all(r["taken"] <= 2 * r["size"] for r in own)
        assert all(sum(d["words"] for d in r["draws"]) == r["taken"] for r in own)
    assert sorted(map(str, plan)) == sorted(map(str, mixing.plan_mix(docs.repartition(7), schedule, 1.5).collect()))


def test_positions_follow_the_schedule(documents):
    """Words drawn up to time t are the integral of the source's curve, within a document."""
    docs = corpus(documents)
    plan = mixing.plan_mix(docs, schedule, 1.5).collect()
    knots = dict(zip(["a", "b", "c", None], schedule(["a", "b", "c", None]), strict=True))
    for source, line in knots.items():
        own = [r for r in plan if r["source"] == source]
        for t in (0.1, 0.35, 0.5, 0.9):
            done = 0.0
            for (t0, w0), (t1, w1) in zip(line, line[1:], strict=False):
                end = min(t, t1)
                if end > t0:
                    at_end = w0 + (w1 - w0) * (end - t0) / (t1 - t0)
                    done += (end - t0) * (w0 + at_end) / 2
            wanted = own[0]["target"] * done / mixing.area(line)
            drawn = sum(d["words"] for r in own for d in r["draws"] if d["position"] <= t)
            assert abs(drawn - wanted) <= 8


def test_order_and_drawn_documents(documents):
    docs = corpus(documents)
    plan = mixing.plan_mix(docs, schedule, 1.5, whole=True)
    draws = {r["doc_id"]: len(r["draws"]) for r in plan.collect()}
    mixed = mixing.mixed_documents(docs, plan)
    assert mixed.columns == docs.columns
    got = [r["doc_id"] for r in mixed.collect()]
    assert {d: got.count(d) for d in draws} == draws
    first = [r["draws"][0]["position"] for r in mixing.in_curriculum_order(plan.drop("taken")).collect() if r["draws"]]
    assert first == sorted(first)


def test_rows_that_repeat_id_source_and_size_are_drawn_as_planned(documents):
    rows = [(1, f"{'same words ' * 10}{w}", "en", "a") for w in ("one", "two", "three", "four", "two")] + [(None, "no id here", "en", "a")] * 6
    rows += [(i, f"text {i} of the source " * (i % 7 + 1), "en", "b" if i % 2 else None) for i in range(10, 60)]
    docs = documents(*rows)
    plan = mixing.plan_mix(docs, schedule, 1.5, whole=True)
    planned = Counter((r["doc_id"], r["source"], r["size"]) for r in plan.collect() for _ in r["draws"])
    got = mixing.mixed_documents(docs, plan).collect()
    assert Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in got) == planned
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_documents(docs, mixing.plan_mix(docs, schedule, 1.5, whole=True)).collect()))


def test_odd_rows_and_no_rows(odd):
    got = mixing.plan_mix(odd, schedule, 1.5)
    assert got.count() == 11 and rows_of(got.filter("doc_id = 1"), "size", "taken") == [(0, 0)]
    assert mixing.plan_mix(odd.limit(0), schedule, 1.5).collect() == []
    assert mixing.mixed_documents(odd, mixing.plan_mix(odd, schedule, 1.5)).columns == odd.columns
