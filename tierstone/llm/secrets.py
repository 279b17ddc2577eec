"""Secrets in text: three fixed patterns, and a linear-chain conditional random field over tokens.

Every token of every text gets features of its shape, of the words before it and of the whole file, and is tagged B (a
secret begins), I (it goes on) or O by Viterbi over the whole text. The field learns from the patterns' own findings in a bounded
sample and then finds secrets that no pattern describes. Pattern findings always stay.

Scanning takes the texts of a batch as one array of tokens. What a word or a pair of shapes is worth is looked up once for each
different one, and the best path goes through blocks of tokens side by side, each for every label it may be entered with.

The sample is of stretches: around long tokens and those with digits, and one of `PLAIN` tokens anywhere in the text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so this is every run of 32 or more
ASSIGN_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")

AROUND = 40
WORD = re.compile(r"[A-Za-z0-9+/_-]{8,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-]")
CUES = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "private", "login")
CUE = re.compile("|".join(CUES), re.I)

TRAIN_DOCS = 3000  # documents with a finding that the field learns from, chosen by a hash of their text; as many without
BUCKETS = 1 << 12  # weights per label, features are hashed into them
PLAIN = 64  # tokens of the stretch of plain text that each document of the sample adds
EPOCHS = 12
SEED = 11
O, B, I = 0, 1, 2  # noqa: E741
BLOCK = 64  # tokens that one block of the best path walks


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the pattern findings, leftmost and non-overlapping per kind, by start and then kind."""
    found = []
    low = text.lower()
    if any(cue in low for cue in ASSIGN_CUES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def secret_ranges(text: str) -> list[tuple[int, int]]:
    """Where the secrets themselves stand in the pattern findings."""
    out = [(a, b) for a, kind, b in base_spans(text) if kind != "assign"]
    return sorted(out + [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8])


def chains(text: str) -> list[tuple[int, int]]:
    """Stretches around all long tokens and those with digits: what the field learns from. Scanning takes whole texts."""
    out: list[list[int]] = []
    for m in WORD.finditer(text):
        word = m.group()
        if word.isalpha() and len(word) < 20:
            continue
        a, b = m.start() - AROUND, m.end() + AROUND
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(max(0, a), min(len(text), b)) for a, b in out]


def shape(word: str) -> str:
    """What a token looks like: its characters, how long it is and how varied."""
    if not word[0].isalnum() and len(word) == 1 and word not in "+/_-":
        return word
    kinds = "".join(c for c, there in (
        ("u", word != word.lower()), ("l", word != word.upper()), ("d", any(map(str.isdigit, word))), ("s", not word.isalnum()),
    ) if there)
    size = next(i for i, most in enumerate((3, 7, 11, 15, 23, 31, 47, 1 << 60)) if len(word) <= most)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(word, word[1:], strict=False))
    hexadecimal = "x" if all(c in "0123456789abcdefABCDEF" for c in word) else ""
    return f"{kinds}{hexadecimal}{size}{min(3, turns // 2)}{'+' if len(set(word)) >= 12 else ''}"


def _hash(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=4).digest(), "little") % BUCKETS


class _Shapes(dict):
    """Shape -> number; 0 and 1 stand for the ends of a text."""

    def __init__(self):
        super().__init__({"^": 0, "$": 1})
        self.names = ["^", "$"]

    def __missing__(self, name: str) -> int:
        # a mark is its own shape, and these two are also the signs of the ends
        self[name] = number = len(self.names)
        self.names.append(name)
        return number


class _Words(dict):
    """Word -> row of the columns that hold what is known of it."""

    def __init__(self):
        super().__init__()
        self.shape, self.cue, self.alone, self.begins = array("q"), array("b"), array("i"), array("i")

    def __missing__(self, word: str) -> int:
        name = shape(word)
        self.shape.append(_shapes[name])
        self.cue.append(bool(CUE.search(word)))
        self.alone.append(_hash(f"s {name}"))
        self.begins.append(_hash(f"w {name} {word[:4]}"))
        self[word] = number = len(self.shape) - 1
        return number


KNOWN = 500_000  # words, and feature numbers of a kind, that a task remembers
_shapes, _words = _Shapes(), _Words()
_pairs: dict[str, dict[int, int]] = {"p": {}, "c": {}, "n": {}, "f": {}}
_files: dict[str, int] = {}


def _numbers(kind: str, keys: np.ndarray, name) -> np.ndarray:
    """The feature number of each key; `name` spells a key out."""
    known = _pairs[kind]
    if len(known) > KNOWN:
        known.clear()
    codes, different = pd.factorize(keys)
    for key in different.tolist():
        if key not in known:
            known[key] = _hash(f"{kind} {name(key)}")
    return np.array([known[key] for key in different.tolist()], np.int32)[codes]


_letter: list[np.ndarray] = []


def file_feature(text: str) -> str:
    """How much of the file is marks and digits, and whether it speaks of secrets."""
    if not _letter:
        _letter.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    letters = int(_letter[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].sum())
    low = text.lower()
    return f"{int(letters / max(1, len(text)) * 5)}{any(cue in low for cue in CUES)}"


def features_of(texts: Sequence[list[str]], whole_files: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of all tokens of all texts, one text after the other; where a text begins): see `features`."""
    global _words
    if len(_words) > KNOWN:
        _words = _Words()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(sizes.sum())
    first = np.zeros(total, bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    if not total:
        return np.zeros((0, 6), np.int32), first
    word = np.fromiter(map(_words.__getitem__, chain.from_iterable(texts)), np.int64, total)
    shapes = np.frombuffer(_words.shape, np.int64)[word]
    cues = np.frombuffer(_words.cue, np.int8)[word].astype(bool)
    alone, begins = np.frombuffer(_words.alone, np.int32)[word], np.frombuffer(_words.begins, np.int32)[word]

    at = np.arange(total)
    start = np.maximum.accumulate(np.where(first, at, 0))
    one, two, after = np.zeros(total, np.int64), np.zeros(total, np.int64), np.ones(total, np.int64)
    one[1:], two[2:], after[:-1] = shapes[:-1], shapes[:-2], shapes[1:]
    one[first] = 0
    two[at - start < 2] = 0
    after[:-1][first[1:]] = 1
    last_cue = np.full(total, -10)
    last_cue[1:] = np.maximum.accumulate(np.where(cues, at, -10))[:-1]
    cue = np.where((at - last_cue <= 5) & (last_cue >= start), at - last_cue, 0)
    files = np.repeat(np.fromiter((_files.setdefault(f, len(_files)) for f in whole_files), np.int64, len(texts)), sizes)

    names, named_files, n = _shapes.names, list(_files), 1 << 21  # there are fewer shapes than characters
    return np.stack([
        alone,
        _numbers("p", shapes * n + one, lambda k: f"{names[k // n]} {names[k % n]}"),
        _numbers("c", shapes * 6 + cue, lambda k: f"{names[k // 6]} {k % 6}"),
        _numbers("n", (one * n + two) * n + after, lambda k: f"{names[k // n // n]} {names[k // n % n]} {names[k % n]}"),
        begins,
        _numbers("f", shapes * n + files, lambda k: f"{names[k // n]} {named_files[k % n]}"),
    ], axis=1), first


def features(words: list[str], whole_file: str) -> np.ndarray:
    """tokens x 6 feature numbers: shape, shape with the token before, cues before, neighbours, start, file."""
    return features_of([words], [whole_file])[0]


class Field:
    """weights: feature bucket x label; moves: label x label, from the one before; a chain starts as if after O."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros((BUCKETS, 3)) if weights is None else weights
        self.moves = np.zeros((3, 3)) if moves is None else moves
        self.never = np.zeros((3, 3))
        self.never[O, I] = -1e4  # a secret must begin before it goes on

    @staticmethod
    def _pad(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for x in items])
        out = np.zeros((len(items), lengths.max(), *items[0].shape[1:]), np.int32)
        for row, x in zip(out, items, strict=True):
            row[: len(x)] = x
        return out, lengths

    def train(self, chains: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 64, rate: float = 0.3) -> None:
        """Adagrad on the log likelihood, gradients by forward and backward sums."""
        draw = np.random.default_rng(SEED)
        seen_w, seen_m = np.full_like(self.weights, 1e-6), np.full_like(self.moves, 1e-6)
        by_length = sorted(range(len(chains)), key=lambda i: (len(chains[i]), i))
        groups = [by_length[a : a + batch] for a in range(0, len(by_length), batch)]
        for _ in range(epochs):
            for g in draw.permutation(len(groups)):
                x, lengths = self._pad([chains[i] for i in groups[g]])
                y, _ = self._pad([labels[i] for i in groups[g]])
                rows, steps = x.shape[:2]
                scores, moves = self.weights[x].sum(axis=2), self.moves + self.never
                live = np.arange(steps) < lengths[:, None]
                ahead, behind = np.zeros((rows, steps, 3)), np.zeros((rows, steps, 3))
                ahead[:, 0] = scores[:, 0] + moves[O]
                for t in range(1, steps):
                    ahead[:, t] = scores[:, t] + _logsum(ahead[:, t - 1, :, None] + moves, 1)
                for t in range(steps - 2, -1, -1):
                    go = _logsum(moves + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
                    behind[:, t] = np.where(live[:, t + 1, None], go, 0)
                last = ahead[np.arange(rows), lengths - 1]
                total = _logsum(last, 1)
                chance = np.exp(ahead + behind - total[:, None, None]) * live[:, :, None]
                target = np.eye(3)[y] * live[:, :, None]
                error = (target - chance) / rows
                grad = np.zeros_like(self.weights)
                for k in range(x.shape[2]):
                    np.add.at(grad, x[:, :, k].ravel(), error.reshape(-1, 3))
                pair = np.exp(ahead[:, :-1, :, None] + moves + (scores + behind)[:, 1:, None, :] - total[:, None, None, None])
                move = -(pair * live[:, 1:, None, None]).sum(axis=(0, 1))
                np.add.at(move, (y[:, :-1][live[:, 1:]], y[:, 1:][live[:, 1:]]), 1)
                move[O] += target[:, 0].sum(axis=0) - chance[:, 0].sum(axis=0)
                move /= rows
                grad -= 1e-5 * self.weights
                seen_w += grad**2
                seen_m += move**2
                self.weights += rate * grad / np.sqrt(seen_w)
                self.moves += rate * move / np.sqrt(seen_m)

    def decode(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each chain; chains of like length are walked together."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(chains)
        by_length = sorted((i for i in range(len(chains)) if len(chains[i])), key=lambda i: len(chains[i]))
        moves = self.moves + self.never
        at = 0
        while at < len(by_length):
            # a group's table has a bounded number of cells, whatever the lengths
            size = max(1, min(4096, 400_000 // len(chains[by_length[min(len(by_length) - 1, at + 255)]])))
            group = by_length[at : at + size]
            at += size
            x, lengths = self._pad([chains[i] for i in group])
            scores = self.weights[x].sum(axis=2)
            rows, steps = x.shape[:2]
            best = np.empty((rows, steps, 3))
            back = np.zeros((rows, steps, 3), np.int8)
            best[:, 0] = scores[:, 0] + moves[O]
            for t in range(1, steps):
                ways = best[:, t - 1, :, None] + moves
                back[:, t] = ways.argmax(axis=1)
                best[:, t] = scores[:, t] + ways.max(axis=1)
            tags = np.zeros((rows, steps), int)
            now = best[np.arange(rows), lengths - 1].argmax(axis=1)
            for t in range(steps - 1, -1, -1):
                inside = t < lengths
                tags[inside, t] = now[inside]
                now = np.where(inside, back[np.arange(rows), t, now], now)
            for row, i, n in zip(tags, group, lengths, strict=True):
                out[i] = row[:n]
        return out


    def tags(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best labels of all tokens of all texts, one text after the other; `first` marks where one begins.

        The tokens are cut into blocks, which walk side by side, for each label a block may be entered with. The labels at the ends of
        blocks follow one after the other, and the labels inside from those. The result is that of `decode` for whole texts.
        """
        n = len(features)
        if not n:
            return np.zeros(0, np.int8)
        blocks = -(-n // BLOCK)
        scores, fresh = np.zeros((blocks * BLOCK, 3)), np.ones(blocks * BLOCK, bool)
        for k in range(features.shape[1]):
            scores[:n] += self.weights[features[:, k]]
        fresh[:n] = first
        scores = np.ascontiguousarray(scores.reshape(blocks, BLOCK, 3).transpose(1, 2, 0))  # step, label, block
        fresh = np.ascontiguousarray(fresh.reshape(blocks, BLOCK).T)
        moves = self.moves + self.never
        back = np.zeros((BLOCK, 3, 3, blocks), np.int8)  # step, label entered with, label -> label before
        best = np.full((3, 3, blocks), -np.inf)  # label entered with, label now
        best[range(3), range(3)] = 0
        for t in range(BLOCK):
            now = np.empty_like(best)
            # a text begins as if after O, whatever the one before ended with
            into = [[np.where(fresh[t], moves[O, c], moves[b, c]) for c in range(3)] for b in range(3)]
            for c in range(3):
                ways = [best[:, b] + into[b][c] for b in range(3)]
                second, third = ways[1] > ways[0], ways[2] > np.maximum(ways[0], ways[1])
                back[t, :, c] = np.where(third, 2, second)
                now[:, c] = np.maximum(np.maximum(ways[0], ways[1]), ways[2]) + scores[t, c]
            best = now
        ends, entered = np.zeros(blocks, np.int64), np.zeros((blocks, 3), np.int8)
        sums = [0.0, -np.inf, -np.inf]
        for i, block in enumerate(best.transpose(2, 0, 1).tolist()):
            after = []
            for c in range(3):
                ways = [sums[a] + block[a][c] for a in range(3)]
                top = max(ways)
                entered[i, c] = ways.index(top)
                after.append(top)
            top = max(after)
            sums = [x - top for x in after]
        label = sums.index(0.0)
        for i in range(blocks - 1, -1, -1):
            ends[i] = label
            label = int(entered[i, label])
        out, every = np.empty((BLOCK, blocks), np.int8), np.arange(blocks)
        entry = entered[every, ends]
        for t in range(BLOCK - 1, -1, -1):
            out[t] = ends
            ends = back[t, entry, ends, every]
        return out.T.reshape(-1)[:n]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def tokens_of(text: str, start: int, stop: int) -> list[tuple[int, int, str]]:
    """Tokens that begin in the stretch; the one at its edge may reach in from before and is left out."""
    if start and not text[start - 1].isspace():
        while start < stop and not text[start].isspace():
            start += 1
    return [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text, start, stop)]


def _labels(tokens: list[tuple[int, int, str]], ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(tokens), np.int32)
    for a, b in ranges:
        hit = [i for i, (s, e, _) in enumerate(tokens) if s >= a and e <= b]
        if hit:
            out[hit] = I
            out[hit[0]] = B
    return out


def fit(docs: DataFrame, rows: int = TRAIN_DOCS) -> Field:
    """A field from a bounded sample: `rows` documents with a pattern finding and `rows` without, smallest text hash first.

    A table without findings gives a field that tags nothing.
    """
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["text"]:
                ranges, whole_file = secret_ranges(text), file_feature(text)
                found, tags = [], []
                # the first of the stretches around marked tokens, and one of plain text from a place the text itself decides
                place = len(text) * _hash(text) // BUCKETS
                for tokens in [*(tokens_of(text, a, b)[:400] for a, b in chains(text)[:20]), tokens_of(text, place, min(len(text), place + 16 * PLAIN))[:PLAIN]]:
                    if tokens:
                        found.append(features([w for _, _, w in tokens], whole_file))
                        tags.append(_labels(tokens, ranges))
                if found:
                    lengths = [len(x) for x in found]
                    yield pd.DataFrame([(np.array(lengths, "<i4").tobytes(), np.concatenate(found).astype("<i4").tobytes(), np.concatenate(tags).astype("<i4").tobytes())], columns=["lengths", "features", "tags"])

    order = F.xxhash64("text", F.lit(SEED))
    cue = F.col("text").rlike(f"(?i){'|'.join(ASSIGN_CUES)}|AKIA[A-Z0-9]|[0-9a-f]{{32}}")
    counted = {r["cue"]: r["n"] for r in texts.groupBy(cue.alias("cue")).agg(F.count("*").alias("n")).collect()}

    def some(with_cue: bool) -> DataFrame:
        # the hash comes first: the pattern is looked for in few rows only
        share = min(1.0, (2 * rows + 50) / max(1, counted.get(with_cue, 0)))
        few = F.pmod(order, F.lit(1_000_000)) < share * 1_000_000
        return texts.filter(few & (cue if with_cue else ~cue)).withColumn("order", order).orderBy("order").limit(rows)

    picked = some(True).union(some(False))
    sample = picked.select("text").repartition(12).mapInPandas(cut, "lengths binary, features binary, tags binary").collect()
    field, x, y = Field(), [], []
    for row in sorted(sample, key=lambda r: bytes(r["features"])):
        ends = np.cumsum(np.frombuffer(row["lengths"], "<i4"))[:-1]
        x += np.split(np.frombuffer(row["features"], "<i4").reshape(-1, 6), ends)
        y += np.split(np.frombuffer(row["tags"], "<i4"), ends)
    if any(t.any() for t in y):
        field.train(x, y)
    else:
        field.weights[:, O] = 1.0
    return field


def find_all(texts: list[str], field: Field) -> list[list[tuple[int, str, int]]]:
    """All spans of each text: pattern findings, and stretches the field tags that no finding touches."""
    out = [base_spans(text) for text in texts]
    words = [TOKEN.findall(text) for text in texts]
    tags = field.tags(*features_of(words, [file_feature(text) for text in texts]))
    stops = np.cumsum([len(w) for w in words])
    begun = np.flatnonzero(tags == B)
    for row in np.unique(np.searchsorted(stops, begun, "right")):
        mine = tags[stops[row] - len(words[row]) : stops[row]]
        places = [m.span() for m in TOKEN.finditer(texts[row])]
        spans = []
        for i in np.flatnonzero(mine == B).tolist():
            k = i + 1
            while k < len(mine) and mine[k] == I:
                k += 1
            spans.append((places[i][0], places[k - 1][1]))
        base = [(a, b) for a, _, b in out[row]]
        extra = [(a, "crf", b) for a, b in spans if not any(a < e and s < b for s, e in base)]
        out[row] = sorted(out[row] + extra, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
    return out


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, spans array<struct<start, kind, stop>>) of every row; null text is empty and has none. Offsets count code points."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = frame["text"].str.len().fillna(0).cumsum()
            for _, part in frame.groupby((sizes // 1_000_000).astype(int).to_numpy()):
                found = find_all([t or "" for t in part["text"].where(part["text"].notna(), "")], field)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64"), "starts": [[a for a, _, _ in s] for s in found],
                    "kinds": [[k for _, k, _ in s] for s in found], "stops": [[b for _, _, b in s] for s in found],
                })

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = kept.mapInPandas(run, "doc_id long, starts array<long>, kinds array<string>, stops array<long>")
    spans = F.transform(F.arrays_zip("starts", "kinds", "stops"), lambda s: F.struct(s["starts"].alias("start"), s["kinds"].alias("kind"), s["stops"].alias("stop")))
    return rows.select("doc_id", spans.alias("spans"))
