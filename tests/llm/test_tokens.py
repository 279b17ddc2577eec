import zlib
from collections import Counter
from heapq import heapify, heappop, heappush
from random import Random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tierstone.llm import huffman
from tierstone.llm.queries import tokenizer_path

from llm_rows import rows_of


def expected(rows, end=2):
    library = Tokenizer.from_file(tokenizer_path())
    at, out = 0, []
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_words_give_the_library_s_ids():
    library, words = Tokenizer.from_file(tokenizer_path()), huffman.WordIds(tokenizer_path())
    for text in ["It's 10.5 km!?", "ÀÉÎ straße, ñandú... don't'll", "a b c\x85d", "é café", "<|endoftext|>x y<|startoftext|>", "İI ΑΣ ΣΑΣ", "x" * 300, "a\r\nb\tc\x0bd", "你好 мир 🙂🙂", "--,,!! #$%"]:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_texts_together_give_the_ids_of_each():
    library, words = Tokenizer.from_file(tokenizer_path()), huffman.WordIds(tokenizer_path())
    texts = ["Word, word. WORD!? word", None, "", "İ Word, ÀÉÎ... É,", " ", "a,b. <|endoftext|> Word,", "x\n\ny\t,", "...", "你好, word"]
    for text, ids in zip(texts, words.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text
    assert words.encode_all([]) == [] and words.encode_all([None, ""]) == [b"", b""]


def test_words_that_come_again_are_tokenised_once(monkeypatch):
    monkeypatch.setattr(huffman, "CACHED_WORDS", 30)
    words, asked = huffman.WordIds(tokenizer_path()), []
    part = words.part
    monkeypatch.setattr(words, "part", lambda text: asked.append(text) or part(text))
    for i in range(40):
        rare = ["".join(chr(97 + int(d)) for d in str(1000 + 10 * i + k)) for k in range(10)]
        words.encode("hot, hot. hot! " + " ".join(rare))
    assert asked.count("hot") == 1 and len(asked) == len(set(asked))
    assert len(words) + len(words.older) <= 60


def test_capitals_of_a_word_are_tokenised_once_in_any_text(monkeypatch):
    library, words, asked = Tokenizer.from_file(tokenizer_path()), huffman.WordIds(tokenizer_path()), []
    part = words.part
    monkeypatch.setattr(words, "part", lambda text: asked.append(text) or part(text))
    text = "你好 Hot hot, HOT! ÉTÉ Été."
    assert np.frombuffer(words.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == ["!", ",", ".", "hot", "été"]


def test_letters_become_small_as_in_python():
    assert pc.utf8_lower(pa.array(list(huffman.LATIN))).to_pylist() == [c.lower() for c in huffman.LATIN]


def test_words_outlive_full_generations(monkeypatch):
    monkeypatch.setattr(huffman, "CACHED_WORDS", 7)
    monkeypatch.setattr(huffman, "CACHED_BYTES", 500)
    library, words, random = Tokenizer.from_file(tokenizer_path()), huffman.WordIds(tokenizer_path()), Random(5)
    for _ in range(60):
        texts = [" ".join(random.choice(["one", "Two,", "été", "x" * 90, "你好", "a.b", "", "!!", f"w{random.random()}"]) for _ in range(9)) for _ in range(4)]
        for text, ids in zip(texts, words.encode_all(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert len(words) <= 7 and len(words.older) <= 7
        held = [*words.newer.words.to_pylist(), *words.older.words.to_pylist()]
        assert "x" * 90 not in held
        for word, ids in zip(held, [*words.newer.ids.to_pylist(), *words.older.ids.to_pylist()], strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_places_of_wanted_words():
    held = huffman.Generation(pa.array(["a", "b", "", "c"], pa.large_string()))
    assert held.places(pa.array(["c", "x", "", "a"], pa.large_string())).tolist() == [3, -1, 2, 0]
    assert held.places(huffman.NO_WORDS).tolist() == [] and huffman.Generation().places(held.words).tolist() == [-1] * 4


def test_remembered_words_take_little_room():
    words = huffman.WordIds(tokenizer_path())
    words.encode(" ".join("".join(chr(97 + int(d)) for d in str(n)) for n in range(10_000, 30_000)))
    assert len(words) == 20_001  # and the empty tail
    assert words.newer.words.nbytes + words.newer.ids.nbytes < 50 * 20_000


def test_ids_are_counted_where_they_are_made(spark, documents):
    rows = [(i, f"text {i} of more words, café! " * (i % 7) or None) for i in range(200)]
    staged = huffman.stage(documents(*rows), tokenizer_path(), 2, block=64).collect()
    library, expected_counts, counted = Tokenizer.from_file(tokenizer_path()), Counter(), Counter()
    for _, text in rows:
        expected_counts.update([*library.encode(text or "", add_special_tokens=False).ids, 2])
    for row in staged:
        counted.update(dict(zip(row["seen"] or [], row["times"] or [], strict=True)))
    assert counted == expected_counts
    shards = [r for r in staged if r["seen"]]
    columns = {"seen": pa.array([r["seen"] for r in shards], pa.list_(pa.int32())), "times": pa.array([r["times"] for r in shards], pa.list_(pa.int64()))}
    (whole,) = huffman._shards_counted(iter([pa.record_batch(columns)]))  # a row for each id and task, not for each id and shard
    assert dict(zip(whole["id"].to_pylist(), whole["count"].to_pylist(), strict=True)) == expected_counts
    last = {r["shard"]: r["block"] for r in sorted(staged, key=lambda r: (r["shard"], r["block"]))}
    assert all((r["seen"] is not None) == (r["block"] == last[r["shard"]]) for r in staged)


def test_groups_keep_every_row_in_order(monkeypatch):
    monkeypatch.setattr(huffman, "TEXT_AT_ONCE", 10)
    texts = ["abc", None, "d" * 25, "", "éé", "fgh", "i" * 9, "j", "k"]
    batches = [pa.record_batch({"doc_id": pa.array(range(a, z)), "text": pa.array(texts[a:z], pa.string())}) for a, z in [(0, 2), (2, 2), (2, 8), (8, 9)]]
    groups = list(huffman._gathered(iter(batches)))
    assert [i for ids, _ in groups for i in ids] == list(range(9))
    assert [t for _, held in groups for t in held.to_pylist()] == texts
    assert all(sum(len((t or "").encode()) for t in held.to_pylist()[:-1]) < 10 for _, held in groups)


def test_lengths_are_those_of_huffman_where_the_limit_allows():
    counts = np.array([5, 9, 12, 13, 16, 45, 1, 1, 2])
    heap = [(int(c), i, [i]) for i, c in enumerate(counts)]
    heapify(heap)
    depth = [0] * len(counts)
    while len(heap) > 1:
        (a, _, x), (b, n, y) = heappop(heap), heappop(heap)
        for i in x + y:
            depth[i] += 1
        heappush(heap, (a + b, n, x + y))
    assert (huffman.limited_lengths(counts) * counts).sum() == (np.array(depth) * counts).sum()


@given(st.lists(st.integers(1, 10**9), min_size=1, max_size=60), st.integers(6, 16))
@settings(max_examples=60, deadline=None)
def test_lengths_keep_the_limit_and_can_be_decoded(counts, limit):
    lengths = huffman.limited_lengths(np.array(counts), limit)
    assert lengths.max() <= limit and sum(2.0**-n for n in lengths) <= 1


@given(st.lists(st.integers(0, 40), min_size=1, max_size=1500))
@settings(max_examples=40, deadline=None)
def test_round_trip_of_a_block(ids):
    ids = np.array(ids)
    found, counts = np.unique(ids, return_counts=True)
    code = huffman.Code(found, huffman.limited_lengths(counts**3))
    points, payload = code.encode(ids)
    assert code.decode(payload, points, len(ids)).tolist() == ids.tolist()
    if len(points) > 1:  # any checkpoint is a place to start
        part = code.decode(payload, points[1:], len(ids) - huffman.CHECKPOINT)
        assert part.tolist() == ids[huffman.CHECKPOINT :].tolist()


def test_too_many_ids_for_the_limit():
    with pytest.raises(ValueError):
        huffman.limited_lengths(np.ones(20), 4)


def test_crc_of_joined_parts():
    a, b = b"some bytes", b"and the others" * 50
    assert huffman.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_documents(spark, documents):
    rows = [(i, f"Text number {i}, café! " * (i % 5) or None) for i in range(40, 0, -1)]
    got = rows_of(huffman.encode_documents(documents(*rows), tokenizer_path()), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == expected(sorted(rows))


def test_long_documents_reach_over_blocks(spark, documents, tmp_path):
    rows = [(1, "short"), (2, "many different words " * 300), (3, ""), (4, "end")]
    huffman.write_tokens(documents(*rows), str(tmp_path / "s"), tokenizer_path(), 2, block=100)
    got = rows_of(huffman.token_digests(spark, str(tmp_path / "s")), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == expected(rows)
    ids = {}
    for r in sorted(huffman.read_ids(spark, str(tmp_path / "s")).collect(), key=lambda r: r["start"]):
        ids.setdefault(r["doc_id"], []).extend(r["ids"])
    assert [len(ids[d]) for d in (1, 2, 3, 4)] == [n for _, _, n, _ in got]


def test_odd_rows_and_no_rows(odd):
    got = rows_of(huffman.encode_documents(odd, tokenizer_path()), "start", "n_tokens")
    assert len(got) == 11 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:], strict=False))
    assert huffman.encode_documents(odd.limit(0), tokenizer_path()).collect() == []
