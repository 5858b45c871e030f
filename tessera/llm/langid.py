"""Language identification by a byte convolutional network.

A text is lower-cased (A-Z) and cut into windows of fixed length, all of it and not only a prefix. Each byte is
embedded; filters of several widths run over a window, each filter's maximum is kept, and a softmax over the
languages is taken. The log probabilities of a text's windows, weighted by their bytes, are summed; the best
language wins. Training is plain numpy with Adam on a bounded sample of labelled rows.

Cases: a null text, an empty one, or one without any letter gets ``und`` and score 0; rows whose label is null
never train; an empty or label-free training fold gives ``und`` for every row; ties go to the first language in
string order; repeated rows are each predicted; a null key is no part of a fold that its hash names; extra columns are ignored by predict() and kept by keep_known().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded_batches, tidy, utf8

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: Bound of the training sample: rows, and windows of WINDOW characters taken from each.
TRAIN_ROWS, TRAIN_WINDOWS = 4000, 3
#: Rows considered for the sample per row taken.
OVER = 2
BATCH, RATE = 128, 0.01
#: Training steps, whatever the sample's size: a small sample is gone through more often.
STEPS = 564
#: Windows that one matrix product scores.
BLOCK = 512
UNKNOWN = "und"

_LOWER = np.frombuffer(LOWER, np.uint8)


@dataclass
class ByteCNN:
    """Weights: bytes' embedding (row 0 is padding), one matrix and bias per filter width, the softmax layer."""

    langs: list[str]
    embed: np.ndarray
    convs: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def start(cls, langs: list[str], seed: int = 7) -> ByteCNN:
        r = np.random.default_rng(seed)
        f4 = lambda a: a.astype(np.float32)
        return cls(
            langs,
            f4(r.normal(0, 0.3, (256, EMBED))),
            [f4(r.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS))) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            f4(r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs)))),
            np.zeros(len(langs), np.float32),
        )

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.convs, *self.biases, self.out, self.out_bias]

    def _columns(self, x: np.ndarray, w: int) -> np.ndarray:
        """x: windows as bytes, (n, WINDOW). Gives (n, WINDOW - w + 1, w * EMBED)."""
        e = self.embed[x]
        n, length, d = e.shape
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (n, length - w + 1, w * d), (s[0], s[1], s[2]), writeable=False)

    def pooled(self, x: np.ndarray, where: bool = False):
        tops, at = [], []
        for w, W, b in zip(WIDTHS, self.convs, self.biases, strict=True):
            c = np.ascontiguousarray(self._columns(x, w))
            z = c.reshape(-1, c.shape[2]) @ W
            z = z.reshape(len(x), -1, FILTERS)
            if where:
                k = z.argmax(1)
                at.append(k)
                tops.append(np.take_along_axis(z, k[:, None, :], 1)[:, 0] + b)
            else:
                tops.append(z.max(1) + b)
        h = np.maximum(np.concatenate(tops, 1), 0)
        return (h, at) if where else h

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        h, at = self.pooled(x, where=True)
        z = h @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        dh = (p @ self.out.T) * (h > 0)
        d_embed, d_convs, d_biases = np.zeros_like(self.embed), [], []
        for i, w in enumerate(WIDTHS):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            spots = at[i][:, :, None] + np.arange(w)  # (n, FILTERS, w): only the maxima get gradient
            seen = x[np.arange(len(x))[:, None, None], spots]
            cols = self.embed[seen].reshape(len(x), FILTERS, w * EMBED)
            d_convs.append(np.einsum("nf,nfk->kf", d, cols, optimize=True))
            d_biases.append(d.sum(0))
            back = (d[:, :, None] * self.convs[i].T[None]).reshape(-1, EMBED)
            for j in range(EMBED):
                d_embed[:, j] += np.bincount(seen.ravel(), back[:, j], 256).astype(np.float32)
        return [d_embed, *d_convs, *d_biases, h.T @ p, p.sum(0)]


def windows_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts between the offsets: bytes (n, WINDOW) padded by 0, the text each is of, its length."""
    sizes = np.diff(at)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = at[:-1][owner] + nth * WINDOW
    length = np.minimum(WINDOW, at[1:][owner] - first)
    spots = first[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < length[:, None]
    x = _LOWER[raw[np.minimum(spots, max(len(raw) - 1, 0))]] if len(raw) else np.zeros(spots.shape, np.uint8)
    return np.where(inside, x, 0).astype(np.uint8), owner, length


def train(samples: list[tuple[str, bytes]], seed: int = 7) -> ByteCNN | None:
    """Fits the network on (language, window bytes); None without samples."""
    samples = [(lang, b) for lang, b in samples if b]
    if not samples:
        return None
    langs = sorted({lang for lang, _ in samples})
    index = {lang: i for i, lang in enumerate(langs)}
    x = np.zeros((len(samples), WINDOW), np.uint8)
    for row, (_, b) in zip(x, samples, strict=True):
        b = b[:WINDOW]
        row[: len(b)] = _LOWER[np.frombuffer(b, np.uint8)]
    y = np.array([index[lang] for lang, _ in samples])
    model, r = ByteCNN.start(langs, seed), np.random.default_rng(seed)
    mean, square, step = [np.zeros_like(p) for p in model.params()], [np.zeros_like(p) for p in model.params()], 0
    while step < STEPS and len(langs) > 1:
        order = r.permutation(len(y))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            step += 1
            xs = x[pick].copy()
            for row in xs[::2]:  # half of the windows are shortened, as the last window of a text is
                row[r.integers(12, WINDOW) :] = 0
            for p, g, m, v in zip(model.params(), model.gradients(xs, y[pick]), mean, square, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return model


def training_sample(labelled: DataFrame, text: str, lang: str, key: str) -> list[tuple[str, bytes]]:
    """Windows of at most TRAIN_ROWS rows, those with the smallest hash of the key; only the windows travel."""
    h = F.xxhash64(F.col(key).cast("string"))
    room = F.greatest(F.length(text) - WINDOW, F.lit(1))
    cut = [F.substring(F.col(text), (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(i)), room) + 1).cast("int"), F.lit(WINDOW)) for i in range(TRAIN_WINDOWS)]
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(h.alias("h"), F.col(lang).cast("string").alias("lang"), *[c.alias(f"w{i}") for i, c in enumerate(cut)])
    by = ["h", "lang", *[f"w{i}" for i in range(TRAIN_WINDOWS)]]
    # a top-k sends k rows of each partition to the driver: only hashes below a bound take part, about OVER * TRAIN_ROWS rows in all
    below = OVER * TRAIN_ROWS / max(1, labelled.where(F.col(lang).isNotNull()).count())
    while True:
        part = rows.where(F.col("h") < F.lit(int(below * 2**64) - 2**63)) if below < 1 else rows
        found = part.orderBy(*by).limit(TRAIN_ROWS).collect()
        if len(found) == TRAIN_ROWS or below >= 1:
            return [(r["lang"], r[f"w{i}"].encode()) for r in found for i in range(TRAIN_WINDOWS)]
        below *= 8


def predict_texts(model: ByteCNN | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language and score of each text of an Arrow column."""
    raw, at, nulls = utf8(column)
    n = len(nulls)
    langs, scores = np.array([UNKNOWN] * n, object), np.zeros(n)
    letter = np.zeros(n, bool)
    if n and len(raw):
        ascii_letters = np.concatenate([[0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122))])
        letter = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
        whole = raw.tobytes()
        for i in np.flatnonzero(~letter & (np.diff(at) > 0)):
            letter[i] = any(c.isalpha() for c in whole[at[i] : at[i + 1]].decode("utf-8", "ignore"))
    if model is None or not letter.any():
        return list(langs), scores
    rows = np.flatnonzero(letter)
    total = np.zeros((len(rows), len(model.langs)))
    k = 0
    while k < len(rows):  # texts in groups of some megabytes, windows in blocks: memory stays bounded
        j = max(k + 1, int(np.searchsorted(np.cumsum(np.diff(at)[rows[k:]]), 1 << 21)) + k)
        parts = [raw[at[i] : at[i + 1]] for i in rows[k:j]]
        x, owner, length = windows_of(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
        for b in range(0, len(x), BLOCK):
            logs = model.log_probs(x[b : b + BLOCK])
            np.add.at(total, owner[b : b + BLOCK] + k, logs * (length[b : b + BLOCK, None] / WINDOW))
        total[k:j] /= np.maximum(1, np.bincount(owner, length / WINDOW, j - k))[:, None]
        k = j
    best = total.argmax(1)
    p = np.exp(total - total.max(1, keepdims=True))
    langs[rows] = np.array(model.langs, object)[best]
    scores[rows] = np.clip(1 / p.sum(1), 0, 1)
    return list(langs), scores


def fit(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> ByteCNN | None:
    return train(training_sample(docs.where(training), text, lang, key))


def predict(docs: DataFrame, model: ByteCNN | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = predict_texts(model, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [key, "lang_pred", "score"])

    return bounded_batches(docs).select(key, text).mapInArrow(tidy(run), f"`{key}` {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: ByteCNN | None, text: str = "text", languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows, with all their columns, whose predicted language is one of `languages`; without these, any that is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, _ = predict_texts(model, b.column(b.schema.get_field_index(text)))
            yield b.filter(pa.array([x != UNKNOWN and (languages is None or x in languages) for x in found], pa.bool_()))

    return bounded_batches(docs).mapInArrow(tidy(run), docs.schema)
