import pytest

from tierstone.llm import decontam

from llm_rows import rows_of

ITEMS = [
    (1, "A train leaves London at 9 with 120 people and goes 300 km to Paris where 40 people leave it. How many people stay?"),
    (2, "the colour of the sky over the sea in the early morning is what they all like the most"),
    (3, "too short"),
    (4, None),
    (5, "add five and six"),
]


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(*r, "clash") for r in ITEMS], "item_id long, text string, tokens string")


def test_verbatim_and_changed_questions(documents, benchmark):
    docs = documents(
        (1, f"Before it. {ITEMS[0][1]} And after."),
        (2, "A train leaves Berlin at 7 with 200 people and goes 500 km to Madrid where 60 people leave it. How many people stay?"),
        (3, "A train leaves Berlin at 7 with 200 people and goes 7 km to Berlin where nobody leaves it"),
        (4, "nothing of the kind " * 20),
        (5, "THE colour, of the sky over the sea in the early morning"),
        (6, "please add five and six now"),
        (7, "Too  SHORT!"),
        (8, "this is too short for that"),
    )
    found = {(d, i): c for d, i, c in rows_of(decontam.leaks(docs, benchmark), "doc_id", "item_id", "changed")}
    assert found[(1, 1)] == 0 and found[(2, 1)] > 0 and (5, 2) in found and (6, 5) in found
    assert (7, 3) in found and not [k for k in found if k[0] in (4, 8) or k[1] == 4]  # two words alone are a leak only as the whole text
    assert rows_of(decontam.without_leaks(docs, decontam.leaks(docs, benchmark)), "doc_id")[-2:] == [(4,), (8,)]


def test_one_value_of_the_item_can_not_become_two(spark, documents):
    item = spark.createDataFrame([(1, "he has 5 red apples then gives 5 green apples to 5 friends who like them a lot")], "item_id long, text string")
    docs = documents(
        (1, "he has 8 red apples then gives 8 green apples to 8 friends who like them a lot"),
        (2, "he has 8 red apples then gives 9 green apples to 7 friends who like them a lot"),
    )
    assert rows_of(decontam.leaks(docs, item), "doc_id") == [(1,)]


def test_names_that_begin_a_sentence_or_are_all_in_capitals(spark, documents):
    item = spark.createDataFrame(
        [(1, "Tom has 3 apples. Tom buys 4 pears. Tom eats 2 apples."), (2, "Paula sells seven old books"), (3, "the engineers at IBM wrote a report on rain")],
        "item_id long, text string",
    )
    docs = documents(
        (1, "So it is. Ann has 5 apples. Ann buys 6 pears. Ann eats 1 apples. Yes."), (2, "Now: Maria sells seven old books"),
        (3, "the engineers at NASA wrote a report on rain"), (4, "Ann has 5 apples and Ann buys a pear"),
    )
    assert rows_of(decontam.leaks(docs, item), "doc_id", "item_id", "windows", "changed") == [(1, 1, 5, 4), (2, 2, 1, 1), (3, 3, 2, 1)]


def test_a_conflict_does_not_hide_the_windows_beside_it(spark, documents):
    start = "he has 5 red apples and walks along the river with his old dog until the sun goes down behind the hills"
    item = spark.createDataFrame([(1, f"{start} then he buys 5 green pears for 300 people"), (2, f"goes 60 km in 60 minutes {start[18:]} for 7 days")], "item_id long, text string")
    docs = documents(
        (1, f"{start} then he buys 8 green pears for 300 people"),
        (2, f"goes 90 km in 45 minutes {start[18:]} for 9 days"),
    )
    found = {(d, i): (w, c) for d, i, w, c in rows_of(decontam.leaks(docs, item), "doc_id", "item_id", "windows", "changed")}
    assert found[(1, 1)][0] >= 10 and found[(1, 1)][1] == 1 and found[(2, 2)][0] >= 8 and found[(2, 2)][1] >= 1


def test_plan_has_no_python_and_scans_only_what_it_needs(documents, benchmark):
    plan = decontam.leaks(documents((1, ITEMS[1][1])), benchmark)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_more_windows_than_are_broadcast(documents, benchmark, monkeypatch):
    docs = documents((1, ITEMS[0][1]), (2, "nothing"))
    wanted = rows_of(decontam.leaks(docs, benchmark), "doc_id", "item_id", "windows")
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 1)
    assert rows_of(decontam.leaks(docs, benchmark), "doc_id", "item_id", "windows") == wanted


def test_odd_rows_and_no_rows(odd, benchmark):
    assert decontam.leaks(odd, benchmark).collect() == [] == decontam.leaks(odd.limit(0), benchmark).collect()
    assert decontam.leaks(odd, benchmark.limit(0)).collect() == []
    assert decontam.without_leaks(odd, decontam.leaks(odd, benchmark)).count() == 11


def test_items_that_only_match_as_they_stand(spark, documents):
    item = spark.createDataFrame(
        [(1, "What is 5 + 7?"), (2, "Who wrote Hamlet?"), (3, "1 2 3 4 5 6 7 8 9 10 11 12"), (4, "数学の問題です答えてください"), (5, "42")], "item_id long, text string"
    )
    docs = documents(
        (1, "so: what is 5 and 7? no, What is 5 + 7? Yes"), (2, "tell me who wrote hamlet"), (3, "0 1 2 3 4 5 6 7 8 9 10 11 12 13"), (4, "これは数学の問題です答えてくださいね"),
        (5, "42."), (6, "42 and more"), (7, "what is 5 plus 7"), (8, "who wrote it"), (9, "数学の問題"),
    )
    wanted = [(1, 1, 1), (2, 2, 1), (3, 3, 5), (4, 4, 7), (5, 5, 1)]
    assert rows_of(decontam.leaks(docs, item), "doc_id", "item_id", "windows") == wanted


def windows_in_common(doc, item, size=8):
    """Brute force for texts of small letters and numbers: windows of equal templates with four words or more."""
    template = lambda words: tuple("#" if w[0].isdigit() else w for w in words)
    cut = lambda text: [template(text.split()[i : i + size]) for i in range(len(text.split()) - size + 1)]
    held = set(cut(doc))
    return [w for w in cut(item) if w in held and sum(x != "#" for x in w) >= 4]


def test_equals_brute_force_on_random_texts(spark, documents, monkeypatch):
    import random

    draw = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("ba", "ke", "mo", "su", "ti") for b in ("ra", "lo", "ni", "ga")] + ["3", "17"]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    questions = [(i, text(draw.randrange(8, 20))) for i in range(15)]
    rows = []
    for i in range(120):
        item = questions[draw.randrange(15)][1].split()
        at = draw.randrange(len(item))
        rows.append((i, " ".join([text(draw.randrange(1, 30)), *item[at : at + draw.randrange(4, 14)], text(draw.randrange(0, 30))]).strip()))
    item = spark.createDataFrame(questions, "item_id long, text string")
    wanted = {(d, i) for d, doc in rows for i, q in questions if any("#" not in w for w in windows_in_common(doc, q))}
    possible = {(d, i) for d, doc in rows for i, q in questions if windows_in_common(doc, q)}
    found = set(rows_of(decontam.leaks(documents(*rows), item), "doc_id", "item_id"))
    assert wanted and wanted <= found <= possible
    monkeypatch.setattr(decontam, "PAIRS", 3)  # the way for a benchmark of any size
    assert set(rows_of(decontam.leaks(documents(*rows), item), "doc_id", "item_id")) == found
