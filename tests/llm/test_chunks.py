import numpy as np

from tierstone.llm import chunks

from llm_rows import rows_of


def words(seed, n):
    draw = np.random.default_rng(seed)
    return " ".join("".join(draw.choice(list("abcdefghij"), draw.integers(2, 9))) for _ in range(n))


def test_gear_hash_is_the_weighted_sum_of_the_last_bytes():
    data = np.frombuffer(words(1, 20).encode(), np.uint8)
    h = chunks.gear(data)
    for i in (0, 5, 40):
        total = sum(int(chunks._GEAR[data[i - j]]) << j for j in range(min(chunks.GEAR_BYTES, i + 1)))
        assert int(h[i]) == total % (1 << 64)


def test_an_insertion_moves_only_the_cuts_near_it():
    text = words(2, 300)
    place = text.index(" ", 700)
    changed = text[:place] + " inserted" + text[place:]
    one, two = ({*chunks.cuts(np.frombuffer(t.encode(), np.uint8))[0].tolist()} for t in (text, changed))
    assert {c + 9 for c in one if c > place + 120} == {c for c in two if c > place + 129} and {c for c in one if c < place - 120} == {c for c in two if c < place - 120}


def test_every_passage_of_fifty_words_is_caught(documents):
    rows = []
    for i in range(120):
        passage = words(1000 + i, 51)
        rows += [(3 * i, f"{words(3 * i, 60)} {passage} {words(9000 + i, 40)}"), (3 * i + 1, f"{words(7000 + i, 35)}\n{passage}\n{words(5000 + i, 30)}"), (3 * i + 2, words(20000 + i, 100))]
    docs = documents(*rows)
    text = dict(rows)
    found = chunks.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in found} == {d for d, _ in rows if d % 3 < 2}
    for r in found:
        piece = text[r["doc_id"]][r["start"] : r["stop"]]
        assert len(piece.split()) == r["words"] and piece in text[r["first_doc_id"]] and r["kept"] == (r["doc_id"] == r["first_doc_id"])


def test_offsets_are_code_points(documents):
    passage = " ".join(f"é{w}ñ" for w in words(5, 60).split())
    rows = [(1, f"übung {words(6, 30)} {passage}"), (2, f"{passage} ende schön {words(7, 30)}")]
    for r in chunks.repeated_passages(documents(*rows)).collect():
        assert dict(rows)[r["doc_id"]][r["start"] : r["stop"]] in passage


def test_hot_passage(documents):
    passage = words(8, 60)
    rows = [(i, f"{words(100 + i, 30)} {passage}") for i in range(300)]
    found = chunks.repeated_passages(documents(*rows))
    assert rows_of(found.filter("kept"), "doc_id") == [(0,)] and found.count() == 300


def test_odd_rows_and_no_rows(odd, documents):
    assert rows_of(chunks.repeated_passages(odd), "doc_id") == []
    assert chunks.repeated_passages(odd.limit(0)).collect() == []
    same = words(9, 80)
    assert rows_of(chunks.repeated_passages(documents((None, same), (1, same))), "doc_id", "kept") == [(1, False), (None, True)]


def test_rows_of_one_id_and_rows_without_one(documents):
    one, two = words(11, 60), words(12, 60)
    rows = [(1, f"{words(13, 40)} {one} {words(14, 30)}"), (1, f"{words(15, 30)} {two} {words(16, 40)}"), (2, f"{words(17, 35)} {one}"), (None, f"{words(18, 35)} {two}"), (None, f"{two} {words(19, 35)}")]
    found = [r.asDict() for r in chunks.repeated_passages(documents(*rows)).collect()]
    texts = [t for _, t in rows]
    for r in found:
        assert any(len(t[r["start"] : r["stop"]].split()) == r["words"] and t[r["start"] : r["stop"]] in f"{one}|{two}" for t in texts), r
    assert sorted((r["doc_id"] or 0, r["first_doc_id"] or 0, r["kept"]) for r in found) == [(0, 0, False), (0, 0, True), (1, 0, False), (1, 1, True), (2, 1, False)]
    alone = documents((5, one), (5, f"{one} {two}"))
    assert chunks.repeated_passages(alone).collect() == []  # only one document holds it


def test_a_passage_that_repeats_itself(documents):
    for phrase in ("buy now ", "0 ", "please call us now on this number today "):
        rows = [(1, f"{words(20, 50)} {phrase * 120}{words(21, 40)}"), (2, f"{words(22, 30)} {phrase * 120}{words(23, 60)}"), (3, words(24, 90))]
        found = chunks.repeated_passages(documents(*rows)).collect()
        assert {r["doc_id"] for r in found} == {1, 2}
        assert all(r["words"] >= 0.7 * 120 * len(phrase.split()) and dict(rows)[r["doc_id"]][r["start"] : r["stop"]] in phrase * 121 for r in found)


def test_scripts_without_blanks(documents):
    draw = np.random.default_rng(4)
    han = lambda n: "".join(chr(0x4E00 + int(c)) for c in draw.integers(0, 3000, n))
    shared = han(200)
    rows = [(1, han(80) + shared + han(60)), (2, han(70) + shared), (3, han(200))]
    found = chunks.repeated_passages(documents(*rows)).collect()
    assert {r["doc_id"] for r in found} == {1, 2} and all(r["words"] >= 150 and dict(rows)[r["doc_id"]][r["start"] : r["stop"]] in shared for r in found)


def test_equals_brute_force_over_chunks(documents):
    draw = np.random.default_rng(6)
    passages = [words(30 + i, 30) for i in range(6)]
    rows = [(int(draw.integers(0, 60)), " ".join([words(100 + i, 25), passages[i % 6], words(300 + i, 20), passages[(i * 5 + 1) % 6]])) for i in range(80)]
    cut = []
    for number, (doc, text) in enumerate(rows):
        data = np.frombuffer(text.encode(), np.uint8)
        stops, ends = chunks.cuts(data)
        starts, _ = chunks.words_of(data)
        first = [0, *np.searchsorted(ends, stops, side="right")[:-1].tolist()]
        cut += [(number, doc, i, int(starts[f]), int(z), text[int(starts[f]) : int(z)]) for i, (f, z) in enumerate(zip(first, stops.tolist()))]
    holders = {}
    for _, doc, _, _, _, piece in cut:
        holders.setdefault(piece, set()).add(doc)
    wanted, run = [], []
    for c in [*cut, (None,) * 6]:
        if run and (c[0] != run[-1][0] or len(holders[c[5]]) < 2):
            size = sum(len(x[5].split()) for x in run)
            if size >= chunks.PASSAGE_WORDS:
                wanted.append((run[0][1], run[0][3], run[-1][4], size, min(holders[run[0][5]]), all(min(holders[x[5]]) == x[1] for x in run)))
            run = []
        if c[0] is not None and len(holders[c[5]]) > 1:
            run.append(c)
    got = rows_of(chunks.repeated_passages(documents(*rows)), "doc_id", "start", "stop", "words", "first_doc_id", "kept")
    assert got == sorted(wanted)
