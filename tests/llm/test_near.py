import re
from collections import Counter

import numpy as np

from tierstone.llm import bagminhash as near
from tierstone.llm.components import connected

from llm_rows import rows_of


def bag(text):
    words = re.findall(r"[a-z0-9]+", text.lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(rows):
    """class of each id: components of pairs at 0.8 or more"""
    bags = [(d, bag(t or "")) for d, t in rows]
    label = {d: d for d, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, (a, x) in enumerate(bags):
            for b, y in bags[:i]:
                if x and y and label[a] != label[b] and similarity(x, y) >= 0.8:
                    low = min(label[a], label[b])
                    for d in label:
                        if label[d] in (label[a], label[b]) and d in (a, b):
                            label[d] = low
                    changed = True
    return label


def corpus():
    draw = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, passage = [], " ".join(draw.choice(vocabulary, 30))
    for family in range(8):
        base = list(draw.choice(vocabulary, 80))
        for copy in range(6):
            words = list(base)
            for k in range(copy):
                words[(13 * k + family) % 80] = f"x{copy}{k}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + i, f"{passage} {' '.join(draw.choice(vocabulary, 12))}") for i in range(15)]
    rows += [(len(rows) + i, rows[3][1].upper() + "!") for i in range(12)]
    repeated = "all the same line again. "
    return rows + [(len(rows), repeated * 20), (len(rows) + 1, repeated * 22), (len(rows) + 2, repeated * 40), (len(rows) + 3, "short text")]


def test_classes_against_brute_force(documents):
    rows = corpus()
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(documents(*rows)).collect()}
    assert got == brute(rows)


def test_signatures_estimate_the_weighted_similarity():
    a, b = "one two three four five six " * 9, "one two three four five six " * 5 + "other words that are not in the first text at all " * 2
    owner, shingles, weights, _, _ = near.bags([a, b])
    signature = near.signatures(owner, shingles, weights, 2, 4096)
    assert abs((signature[0] == signature[1]).mean() - similarity(bag(a), bag(b))) < 0.03


def test_bags_count_like_a_counter():
    texts = ["a b c d e f a b c d e f a b c d e", "x", "", "A b, c! d e"]
    owner, _, weights, _, words = near.bags(texts)
    for i, text in enumerate(texts):
        assert sorted(weights[owner == i]) == sorted(bag(text).values())
        assert words[i] == len(re.findall(r"\w+", text))


def test_components(spark):
    links = spark.createDataFrame([(f"{a:03}", f"{b:03}") for a, b in [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)]], "a string, b string")
    found = connected(links).groupBy("root").count()
    assert sorted(r["count"] for r in found.collect()) == [2, 51]


def test_hot_group_of_near_copies(documents):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base, f"tail{i}"])) for i in range(300)] + [(300 + i, f"lonely {i} " * 3) for i in range(20)]
    got = near.near_duplicates(documents(*rows)).collect()
    assert {r["class_id"] for r in got if r["doc_id"] < 300} == {0} and all(r["class_rows"] == 300 for r in got if r["doc_id"] < 300)


def test_families_that_share_most_of_a_page(documents):
    """Buckets hold many families, and no member of most of them is central in any."""
    draw = np.random.default_rng(5)
    page = [f"p{i}" for i in range(75)]
    rows = []
    for family in range(60):
        own = [f"f{family}x{i}" for i in range(20)]
        for _ in range(3):
            words = page + own
            words[int(draw.integers(75, 95))] = f"c{len(rows)}"
            rows.append((len(rows), " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(documents(*rows)).collect()}
    assert got == brute(rows) and len(set(got.values())) == 60


def test_texts_put_together_from_boilerplate(documents):
    """Every shingle has more than FEW holders; of ten paragraphs only the last may differ between texts at 0.8.

    Bands of one row make every bucket large."""
    part = [[" ".join(f"p{i}v{v}w{k}" for k in range(20)) for v in range(2)] for i in range(10)]
    picks = [(0, *(i >> k & 1 for k in range(8)), end) for i in range(256) if i.bit_count() <= 3 for end in range(2)]
    rows = [(i, " ".join(part[k][v] for k, v in enumerate(pick))) for i, pick in enumerate(picks)]
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(documents(*rows), bands=16, rows=1).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_texts_put_together_from_boilerplate_with_default_bands(documents):
    """As above with the bands of the query: classes are those of brute force."""
    part = [[" ".join(f"p{i}v{v}w{k}" for k in range(20)) for v in range(2)] for i in range(10)]
    picks = [tuple(i >> k & 1 for k in range(10)) for i in range(0, 1024, 5)]
    rows = [(i, " ".join(part[k][v] for k, v in enumerate(pick))) for i, pick in enumerate(picks)]
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(documents(*rows)).collect()}
    assert got == brute(rows)


def test_scripts_without_blanks(documents):
    draw = np.random.default_rng(2)
    text = "".join(chr(0x4E00 + int(c)) for c in draw.integers(0, 3000, 400))
    other = "".join(chr(0x4E00 + int(c)) for c in draw.integers(0, 3000, 400))
    got = {r["doc_id"]: r["class_id"] for r in near.near_duplicates(documents((1, text), (2, text[:-1] + "永"), (3, other), (4, "mixed " + text + " end"))).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}
    _, counts = near.word_hashes(["日本 abc語x", "éa日", "日", " 日。"])
    assert counts.tolist() == [5, 2, 1, 2]


def test_one_of_each_class_stays(documents):
    rows = corpus()
    docs = documents(*rows)
    kept = near.keep_one_of_each(docs, near.near_duplicates(docs))
    assert kept.columns == docs.columns and rows_of(kept, "doc_id") == [(d,) for d in sorted(set(brute(rows).values()))]


def test_odd_rows_and_no_rows(odd):
    got = near.near_duplicates(odd)
    assert got.count() == 11
    assert near.near_duplicates(odd.limit(0)).collect() == []
    assert near.keep_one_of_each(odd, got).count() == 10  # the repeated row once
