"""Language of a text by a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over them, each filter keeps its largest response in a window, and
a softmax over languages follows. A text is cut into windows of fixed length that overlap by the widest filter, so no byte
and no filter position is left out, and the windows' probabilities are averaged by length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"
WINDOW = 256  # bytes of a window
WIDTHS = (2, 3, 4)
FILTERS = 12  # per width
EMBEDDED = 8
BATCH_WINDOWS = 512  # windows in one matrix product

TRAIN_ROWS = 400  # documents per language that the network learns from
TRAIN_WINDOWS = 4  # windows of each, spread over the text
MAX_LABELS = 200
EPOCHS = 8
SEED = 7

# ASCII capitals count as small letters
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW bytes, bytes that are new in each); short ends are filled up with zero bytes."""
    data = np.frombuffer(text.encode("utf-8", "replace").translate(_FOLD), np.uint8)
    step = WINDOW - max(WIDTHS) + 1
    starts = np.arange(0, max(1, len(data) - max(WIDTHS) + 1), step)
    padded = np.zeros(starts[-1] + WINDOW, np.uint8)
    padded[: len(data)] = data
    cut = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts]
    new = np.minimum(step, np.maximum(1, len(data) - starts))
    return cut, new


class ByteNet:
    """labels: the languages in order; weights: embedding, filters (one matrix over the widest window), biases, output."""

    def __init__(self, labels: list[str], seed: int = SEED):
        draw = np.random.default_rng(seed)
        wide, total = max(WIDTHS), FILTERS * len(WIDTHS)
        self.labels = labels
        self.embedding = draw.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32)
        self.mask = np.zeros((wide * EMBEDDED, total), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[: width * EMBEDDED, k * FILTERS : (k + 1) * FILTERS] = 1
        self.filters = (draw.normal(0, 0.35, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(total, np.float32)
        self.out = draw.normal(0, 0.2, (total, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def _responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = max(WIDTHS)
        places = windows.shape[1] - wide + 1
        embedded = self.embedding[windows].reshape(len(windows), -1)
        size = embedded.itemsize
        seen = np.lib.stride_tricks.as_strided(
            embedded, (len(windows), places, wide * EMBEDDED), (embedded.strides[0], EMBEDDED * size, size)
        )
        return seen, (seen.reshape(-1, wide * EMBEDDED) @ self.filters).reshape(len(windows), places, -1)

    @staticmethod
    def _softmax(scores: np.ndarray) -> np.ndarray:
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.labels)), np.float32)
        for a in range(0, len(windows), BATCH_WINDOWS):
            part = windows[a : a + BATCH_WINDOWS]
            pooled = self._responses(part)[1].max(axis=1) + self.bias
            out[a : a + BATCH_WINDOWS] = self._softmax(np.maximum(pooled, 0) @ self.out + self.out_bias)
        return out

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01) -> None:
        """Adam on cross entropy; the order of batches is fixed by the seed."""
        draw = np.random.default_rng(SEED + 1)
        names = ("embedding", "filters", "bias", "out", "out_bias")
        first, second = ({n: np.zeros_like(getattr(self, n)) for n in names} for _ in range(2))
        step, wide = 0, max(WIDTHS)
        for _ in range(epochs):
            order = draw.permutation(len(windows))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                x, y = windows[rows], labels[rows]
                seen, responses = self._responses(x)
                best = responses.argmax(axis=1)
                pooled = np.take_along_axis(responses, best[:, None, :], axis=1)[:, 0] + self.bias
                active = np.maximum(pooled, 0)
                error = self._softmax(active @ self.out + self.out_bias)
                error[np.arange(len(rows)), y] -= 1
                error /= len(rows)
                back = (error @ self.out.T) * (pooled > 0)
                chosen = seen[np.arange(len(rows))[:, None], best]  # rows x filters x (wide * embedded)
                grads = {
                    "out": active.T @ error, "out_bias": error.sum(axis=0), "bias": back.sum(axis=0),
                    "filters": np.einsum("rf,rfi->if", back, chosen) * self.mask,
                }
                to_bytes = (back[:, :, None] * self.filters.T[None]).reshape(-1, wide, EMBEDDED)
                at = (best[:, :, None] + np.arange(wide)).reshape(len(rows), -1)
                grads["embedding"] = np.zeros_like(self.embedding)
                np.add.at(grads["embedding"], np.take_along_axis(x, at, axis=1).ravel(), to_bytes.reshape(-1, EMBEDDED))
                step += 1
                for n in names:
                    first[n] = 0.9 * first[n] + 0.1 * grads[n]
                    second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                    move = rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - move).astype(np.float32))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1; a null id is never held out, nor learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, per_row: int = TRAIN_WINDOWS) -> ByteNet | None:
    """A network from a bounded sample of labelled documents: `rows` per language, chosen by a hash of the id,
    `per_row` windows of each. None if no document has a label and a letter.

    Documents held out, without lang, id or text are not learned from.
    """
    usable = docs.filter(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LABELS + 1).collect()}
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} languages")
    if not counts:
        return None
    # thin out by hash first, so that the exact choice sorts a bounded number of rows
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED))
    share = F.coalesce(F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, (2 * rows + 50) / n))))) [F.col("lang")], F.lit(0.0))
    near = usable.filter(F.pmod(draw, F.lit(1_000_000)) < share * 1_000_000).select("lang", "text", draw.alias("draw"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = []
            for lang, text, order in zip(frame["lang"], frame["text"], frame["draw"], strict=True):
                found = windows_of(text)[0]
                some = np.unique(np.linspace(0, len(found) - 1, per_row).astype(int))
                parts.append((lang, order, found[some].tobytes()))
            yield pd.DataFrame(parts, columns=["lang", "draw", "windows"])

    ranked = near.mapInPandas(cut, "lang string, draw long, windows binary").withColumn(
        "no", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "windows"))
    )
    sample = sorted(ranked.filter(F.col("no") <= rows).select("lang", "no", "windows").collect(), key=lambda r: (r["lang"], r["no"]))
    labels = sorted(counts)
    cut_up = [np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW) for r in sample]
    net = ByteNet(labels)
    if len(labels) > 1:
        net.train(np.concatenate(cut_up), np.repeat([labels.index(r["lang"]) for r in sample], [len(c) for c in cut_up]))
    return net


def _guesser(net: ByteNet | None):
    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        held, owner, news = [], [], []

        def settle_held():
            if not held:
                return
            weights = np.concatenate(news).astype(np.float64)
            probabilities = net.predict(np.concatenate(held)) * weights[:, None]
            lengths = [len(h) for h in held]
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            sums = np.add.reduceat(probabilities, starts) / np.add.reduceat(weights, starts)[:, None]
            for row, mean in zip(owner, sums, strict=True):
                best = int(mean.argmax())
                names[row], scores[row] = net.labels[best], float(min(1.0, mean[best]))
            held.clear(), owner.clear(), news.clear()

        waiting = 0
        for row, text in enumerate(texts):
            if net is None or text is None or not any(map(str.isalpha, text)):
                continue
            cut, new = windows_of(text)
            held.append(cut), owner.append(row), news.append(new)
            waiting += len(cut)
            if waiting >= 4 * BATCH_WINDOWS:
                settle_held()
                waiting = 0
        settle_held()
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return guess


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """docs with lang_pred and score: the language with the largest mean probability over the whole text, and that mean.

    `und` with score 0 where text is null or has no letter, or if there is no network. Columns of docs
    named lang_pred or score are replaced; all others pass through.
    """
    kept = docs.drop("lang_pred", "score")
    return kept.withColumn("_guess", _guesser(net)(F.col("text").cast("string"))).select(
        *kept.columns, F.col("_guess.lang_pred").alias("lang_pred"), F.col("_guess.score").alias("score")
    )


def recognised(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """The rows of docs, with their own columns, in which the network sees a language."""
    return docs.filter(_guesser(net)(F.col("text").cast("string"))["lang_pred"] != UNKNOWN)
