import random
from collections import defaultdict

from pyspark.sql import functions as F

from tierstone.llm import lines

from llm_rows import rows_of

BLANK = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, least_chars=40, least_docs=5):
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(doc_id)
    order = lambda d: (d is not None, d or 0)
    out = []
    for doc_id, text in rows:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if len(key_of(x)) < least_chars or len(holders[key_of(x)]) < least_docs or max(holders[key_of(x)], key=order) == doc_id]
        out.append((doc_id, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def found(docs, **options):
    return rows_of(lines.without_shared_lines(docs, lines.keep_bitmaps(docs, **options)), "doc_id", "n_lines", "n_dropped", "kept")


def test_equals_brute_force_on_planted_lines(documents):
    draw = random.Random(4)
    shared = [f"This Line number {i} stands in many documents, Ünd Ñot only once" for i in range(30)]
    rows = []
    for doc_id in range(300):
        own = [draw.choice(["", "short", f"a line of its own which no other document {doc_id} ever holds {draw.random()}", "  " + draw.choice(shared).upper() + "\t", draw.choice(shared)])
               for _ in range(draw.randrange(1, 25))]
        rows.append((doc_id, "\n".join(own)))
    rows += [(1000 + i, shared[0] + "\n" + shared[0] + "\r\n\n" + shared[1].lower()) for i in range(200)]  # a hot line, twice in each
    assert found(documents(*rows)) == brute(rows)


def test_only_ascii_letters_fold_and_forty_code_points_count(documents):
    accents = ["É" * 40, "é" * 40]  # different keys: three documents each
    rows = [(i, accents[i % 2]) for i in range(6)] + [(10 + i, "ñ" * 39) for i in range(9)] + [(20 + i, "ñ" * 40) for i in range(5)]
    got = found(documents(*rows))
    assert got == brute(rows)
    assert [r[0] for r in got if r[2]] == [20, 21, 22, 23]


def test_odd_rows_have_the_stated_result(odd, documents):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(odd, least_chars=1, least_docs=1) == brute(rows, 1, 1)
    assert found(documents()) == []


def test_null_and_repeated_ids_are_one_document(documents):
    line = "the very same line in all of these documents, more than forty long"
    rows = [(None, line), (None, "x\n" + line), (1, line + "\na"), (1, "b\n" + line), (2, line), (3, line)]
    assert found(documents(*rows)) == brute(rows)  # four ids and null: five documents
    assert found(documents(*rows[:-1])) == brute(rows[:-1])  # one less than it takes
    assert all(r[2] == 0 for r in found(documents(*rows[:-1])))


def test_a_long_text_of_many_runs(documents):
    line = "a common line that is long enough to be counted as shared by documents"
    rows = [(0, "\n".join(line if i % 2 else f"own {i}" for i in range(40_000)))] + [(i, line) for i in range(1, 6)]
    assert found(documents(*rows)) == brute(rows)


def test_bitmap_is_the_ends_of_its_runs(spark):
    ends = spark.range(1).select(lines.run_ends(F.array(*map(F.lit, [0, 1, 5, 7, 8]))).alias("e")).first()["e"]
    assert ends == [0, 2, 5, 6, 7, 9]
    kept = spark.range(1).select(lines.apply_runs(F.array(*[F.lit(str(i)) for i in range(12)]), F.array(*map(F.lit, ends))).alias("k")).first()["k"]
    assert kept == ["2", "3", "4", "6", "9", "10", "11"]


def test_hot_lines_are_dealt_by_document_without_a_second_exchange(documents):
    line = "the hot line that every one of these documents has at its end, word for word"
    docs = documents(*[(i, line) for i in range(5000)])
    hashed = lines.hashed_lines(docs)
    first = lines.first_occurrences(hashed, 16)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
    sizes = [r["n"] for r in first.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 5000 and max(sizes) < 1000
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
