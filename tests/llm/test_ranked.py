import math
import random
import re
from collections import Counter

import pytest

from tierstone.llm import ranking

from llm_rows import rows_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, most=20):
    bags = [(d, Counter(words(t)), len(words(t))) for d, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    holders = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in set(items):
        scored = []
        for doc, bag, n in bags:
            score = 0
            for term in words(text):
                if bag[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[term] + 1)))
                    m = 100 - 25 + (25 * n * n_docs) // total
                    score += w * ((1_000_000_000 * bag[term]) // (1000 * bag[term] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if absent else doc, -score) for rank, (score, absent, doc) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


@pytest.fixture
def items(spark):
    return lambda *rows: spark.createDataFrame([(i, t, 0, "s", 1) for i, t in rows], "item_id long, text string, doc_id int, score string, rank int")


def found(docs, items, **options):
    return rows_of(ranking.ranked(docs, items, **options), "item_id", "rank", "doc_id", "score")


def test_equals_brute_force(documents, items):
    draw = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ñandú", "ñandú", "ÑANDÚ", "x", "xx", "été", "9", "99", "日本語"]
    text = lambda most: "".join(draw.choice(vocabulary) + draw.choice([" ", ", ", "\n", "--", "\x7f", "_"]) for _ in range(draw.randrange(most)))
    docs = [(i, text(60)) for i in range(400)]
    asked = [(i, text(12)) for i in range(40)]
    assert found(documents(*docs), items(*asked)) == brute(docs, asked)
    assert found(documents(*docs), items(*asked), bytes_each=300) == brute(docs, asked)  # several automata


def test_whole_terms_only_and_repeats(documents, items):
    docs = [(1, "cat catalog"), (2, "the cat's cat"), (3, "concat"), (4, "CAT-cat_cat"), (5, "dog")]
    asked = [(1, "cat"), (2, "cat cat dog"), (3, "?!")]
    got = found(documents(*docs), items(*asked))
    assert got == brute(docs, asked) and {r[2] for r in got if r[0] == 1} == {1, 2, 4} and not any(r[0] == 3 for r in got)


def test_ties_go_to_the_smaller_id_and_null_comes_last(documents, items):
    docs = [(i, "same words here") for i in range(30, 0, -1)] + [(None, "same words here"), (2**60 + 1, "other")]
    assert found(documents(*docs), items((1, "words"))) == brute(docs, [(1, "words")])
    few = [(None, "same words here"), (3, "same words here"), (3, "same words here"), (2**60 + 1, "same words here")]
    assert [r[2] for r in found(documents(*few, (9, "x")), items((1, "words")))] == [3, 3, 2**60 + 1, None]


def test_odd_tables(odd, documents, items):
    asked = [(None, "word and id"), (1, None), (2, ""), (3, "same"), (3, "same"), (3, "text one")]
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(odd, items(*asked)) == brute(rows, asked)
    assert found(documents(), items(*asked)) == [] and found(odd, items()) == [] and found(documents((1, None), (2, "!")), items(*asked)) == []


def test_a_third_of_all_documents_alike(documents, items):
    docs = [(i, "hot text of many copies" if i % 3 else f"text number {i}") for i in range(3000)]
    asked = [(1, "hot text"), (2, "number 3 and 6")]
    assert found(documents(*docs), items(*asked)) == brute(docs, asked)
