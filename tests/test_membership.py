import random

from rows import as_set

from tierstone.operators import membership as M


def test_members_match_changed_missing(frame):
    df = frame("k string, v int", ("a", 1), ("b", 2), (None, 3))
    assert as_set(M.members(df, "k", frame("x string", "a", "a", "z"))) == {("a", 1)}
    assert M.members(df, "k", frame("x string", "a").limit(0)).isEmpty()
    hit, miss = M.match(df, frame("k string", "b", None), ["k"])
    assert as_set(hit) == {("b", 2)} and as_set(miss) == {("a", 1), (None, 3)}
    chunks = frame("id string, h string", ("1", "x"), ("2", "y"), ("3", "z"))
    known = frame("id string, h string", ("1", "x"), ("2", "old"))
    assert as_set(M.changed(chunks, known, "id", "h")) == {("2", "y"), ("3", "z")}
    assert as_set(M.missing(frame("k string", "a", "q", "q"), df, "k")) == {("q",)}


def test_contained_equals_brute_force(frame):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab_/") for _ in range(n))
    keys = sorted({word(rng.randrange(1, 7)) for _ in range(120)})
    texts = [word(rng.randrange(0, 12)) for _ in range(25)] + [None, "", "aaaa", "aaaa"]
    expected = {(k,) for k in keys if any(k in (t or "") for t in texts)}
    got = M.contained(frame("k string", *keys), "k", frame("t string", *texts), "t")
    assert as_set(got) == expected


def test_contained_hits_longer_names_and_no_texts(frame):
    keys = frame("k string", "load", "load_orders", "other")
    assert as_set(M.contained(keys, "k", frame("t string", "/dags/load_orders.py"), "t")) == {("load",), ("load_orders",)}
    assert M.contained(keys, "k", frame("t string", "x").limit(0), "t").isEmpty()
