import hashlib
import random

from tierstone.llm import cuckoo

from llm_rows import rows_of


def digest(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def test_filter_inserts_deletes_and_never_forgets():
    shard, live = cuckoo.Shard(), {}
    draw = random.Random(2)
    for step in range(6000):
        x = draw.randrange(900)
        if draw.random() < 0.6:
            shard.add(digest(x), step, 1)
            live.setdefault(x, [step, 0])[1] += 1
        elif x in live:
            assert shard.remove(digest(x), 1)
            live[x][1] -= 1
            if not live[x][1]:
                del live[x]
        else:
            assert not shard.remove(digest(x), 1)
    assert all(shard.find(digest(x)) == live[x] for x in live) and all(shard.find(digest(x)) is None for x in range(900, 3000))
    assert shard.resizes > 0 and shard.verified > 0
    assert int((shard.filter.slots > 0).sum()) == len(live)


def test_equal_fingerprints_are_told_apart_by_content():
    a = digest(1)
    b = ("0" if a[0] != "0" else "1") * 16 + a[16:]
    shard = cuckoo.Shard()
    shard.add(a, 1, 1)
    assert b in shard.filter and shard.find(b) is None and shard.false_hits == 1
    shard.add(b, 2, 1)
    shard.remove(a, 1)
    assert shard.find(b) == [2, 1] and shard.find(a) is None


def test_stored_index_takes_changes(documents):
    docs = documents(*[(i, f"text {i % 300}") for i in range(900)])
    found = cuckoo.digests(docs)
    index = cuckoo.build_index(found, keys_per_shard=200)
    assert index.entries.count() == 300 and index.shards.count() > 1
    gone = found.filter("doc_id % 300 < 50").selectExpr("text_sha256 AS digest", "doc_id AS keep_id", "CAST(-1 AS bigint) AS n")
    less = index.apply(gone)
    assert less.entries.count() == 250
    again = less.apply(gone.limit(1).selectExpr("digest", "keep_id", "CAST(1 AS bigint) AS n"))
    assert again.entries.count() == 251


def test_blanks_nulls_and_hot_groups(documents):
    rows = [(9, "a  b"), (3, "a\tb"), (5, "a b "), (7, None), (6, ""), (None, "a b"), (8, "a b"), *[(100 + i, "hot\n") for i in range(300)]]
    got = {r["doc_id"]: r for r in cuckoo.exact_duplicates(documents(*rows)).collect()}
    assert (got[9]["keep_id"], got[3]["kept"], got[None]["keep_id"], got[9]["group_size"]) == (3, True, 3, 3)
    assert got[7]["keep_id"] == 6 and got[5]["group_size"] == 1 and got[8]["kept"] and got[250]["keep_id"] == 100 and got[250]["group_size"] == 300
    assert got[3]["text_sha256"] == hashlib.sha256(b"a b").hexdigest()


def test_rows_of_other_tasks_are_true_hits(documents, monkeypatch):
    """Equal texts come to the filter once for each task that read some, and large ids keep all their digits."""
    big = 2**60 + 1
    docs = documents(*[(big + i, f"text {i % 5}") for i in range(200)], (None, "text 0")).repartition(6)
    got = {r["doc_id"]: r for r in cuckoo.exact_duplicates(docs).collect()}
    assert all(got[big + i]["keep_id"] == big + i % 5 for i in range(200)) and got[None]["keep_id"] == big and got[big]["group_size"] == 41
    shard = cuckoo.Shard()
    for part in range(3):
        shard.add(digest("same"), 10 - part, 2)
    assert shard.verified == 2 and shard.find(digest("same")) == [8, 6]


def test_untouched_shards_stay(documents):
    found = cuckoo.digests(documents(*[(i, f"text {i}") for i in range(400)]))
    index = cuckoo.build_index(found, keys_per_shard=40)
    more = index.apply(found.limit(1).selectExpr("text_sha256 AS digest", "doc_id AS keep_id", "CAST(1 AS bigint) AS n"))
    assert more.entries.count() == 400 and more.shards.count() == index.shards.count() == 10
    assert {r["n"] for r in more.entries.collect()} == {1, 2}
    old, new = ({f.rsplit("/", 2)[1] for f in i.entries.inputFiles()} for i in (index, more))
    assert old < new


def test_odd_rows_and_no_rows(odd):
    assert cuckoo.exact_duplicates(odd).count() == 11 and cuckoo.exact_duplicates(odd.limit(0)).collect() == []
    assert rows_of(cuckoo.exact_duplicates(odd).filter("doc_id = 5"), "kept", "group_size") == [(True, 2), (True, 2)]
