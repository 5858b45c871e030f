"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents in one task, bounded in words. Its words are numbered by the benchmark's vocabulary;
words that no item has cannot be in a match, so the shard's text is the collection of maximal runs of known words,
each with its own end mark (runs shorter than the shortest window are left out: nothing can occur in them). The
index holds the Burrows-Wheeler transform of that collection in a wavelet tree and every 16th suffix position.
All test windows search backward together; occurrences are located through the samples; spans are merged.

Words: A-Z lower-cased, then `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A window is `size` consecutive words of an item;
an item of fewer words, but not none, is one window. A document is contaminated when n_hit > 0 and
parts * n_hit >= n_words.

Cases: a null or empty text has no words and is not contaminated; items that are null, wordless or without an id
are ignored; rows that repeat an item_id act as one item; an empty benchmark hits nothing; words may be of any
length; repeated documents are each reported; extra columns are ignored by the report and kept by drop_contaminated().
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, texts

SIZE, PARTS = 13, 20
#: Distance between sampled suffix positions.
SAMPLE = 16
#: Words of known runs that one index holds at most, but for a longer single document.
SHARD_WORDS = 2_000_000
#: Bytes of benchmark text whose windows are held at a time; a larger benchmark is searched block by block.
BLOCK_BYTES = 32 << 20

#: To lower case; every byte outside 0-9, a-z and 0x80-0xFF to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class WaveletTree:
    """Ranks of a symbol sequence: one bit vector per level, with counts of ones before each position."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        first = np.zeros_like(i)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = ones[first], ones[i]
            first, i = np.where(bit, zeros + a, first - a), np.where(bit, zeros + b, i - b)
        return i - first

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol, first = np.zeros_like(i), np.zeros_like(i)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[i + 1] - ones[i]
            one = bit.astype(bool)
            a, b = ones[first], ones[i]
            first, i = np.where(one, zeros + a, first - a), np.where(one, zeros + b, i - b)
            symbol = symbol * 2 + bit
        return symbol, i - first


def suffix_array(keys: np.ndarray) -> np.ndarray:
    """Prefix doubling; only suffixes that still tie are sorted again."""
    n = len(keys)
    sa = np.argsort(keys, kind="stable")
    rank = np.zeros(n, np.int64)
    first = np.concatenate([[True], np.diff(keys[sa]) != 0])
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    h = 1
    while True:
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, n))
        tied = np.repeat(size > 1, size)
        if not tied.any():
            return sa
        spots = np.flatnonzero(tied)
        s = sa[spots]
        follow = np.where(s + h < n, rank[np.minimum(s + h, n - 1)] + 1, 0)
        order = np.lexsort((follow, rank[s]))
        sa[spots] = s[order]
        group, follow = rank[s][order], follow[order]
        new = np.ones(len(spots), bool)
        new[1:] = (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])
        first[spots] = new
        rank[sa[spots]] = np.maximum.accumulate(np.where(new, spots, 0))
        h *= 2


class FMIndex:
    """Backward search over a collection of sequences of symbols 1 to sigma - 1; each ends with its own mark, symbol 0."""

    def __init__(self, runs: np.ndarray, ends: np.ndarray, sigma: int):
        """runs: all sequences with a 0 after each; ends: the positions of the zeros."""
        n = len(runs)
        keys = runs.astype(np.int64) + len(ends)
        keys[ends] = np.arange(len(ends))
        sa = suffix_array(keys)
        self.tree = WaveletTree(runs[sa - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(runs, minlength=sigma))]).astype(np.int64)
        starts = np.concatenate([[0], ends[:-1] + 1])
        sampled = np.zeros(n, bool)
        sampled[::SAMPLE] = True
        sampled[starts] = True  # the walk back never has to pass an end mark
        self.marked = sampled[sa]
        self.places = np.cumsum(self.marked) - 1
        self.samples = sa[self.marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each pattern, right-aligned in a row; all patterns step together."""
        width = patterns.shape[1]
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.before[-1])
        live = np.arange(len(patterns))
        for step in range(width):
            live = live[(lengths[live] > step) & (lo[live] < hi[live])] if step else live
            if not len(live):
                break
            c = patterns[live, width - 1 - step]
            lo[live], hi[live] = self.before[c] + self.tree.rank(c, lo[live]), self.before[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks: steps back through the transform until a sampled one."""
        out, steps, live = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            done = self.marked[rows[live]]
            hit = live[done]
            out[hit] = self.samples[self.places[rows[hit]]] + steps[hit]
            live = live[~done]
            if len(live):
                symbol, rank = self.tree.access_rank(rows[live])
                rows[live] = self.before[symbol] + rank
                steps[live] += 1
        return out


class Patterns:
    """The distinct windows of a block of items, as rows of word numbers, and the items each is of."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple, set[int]] = {}
        for item, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words_of(text)]
            for k in range(max(1, len(w) - size + 1) if w else 0):
                found.setdefault(tuple(w[k : k + size]), set()).add(number[item])
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.shortest = int(self.lengths.min()) if found else 0
        self.rows = np.zeros((len(found), size), np.int64)
        for k, w in enumerate(found):
            self.rows[k, size - len(w) :] = w
        counts = [len(v) for v in found.values()]
        self.item_start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.items = np.array([i for v in found.values() for i in sorted(v)], np.int64)

    def scan(self, docs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Indexes the documents' word numbers (0: unknown). Per document: words hit, merged [start, end) spans, items."""
        sizes = np.array([len(d) for d in docs], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        none = np.zeros((0, 2), np.int64)
        hits, spans, items = np.zeros(len(docs), np.int64), [none] * len(docs), [np.zeros(0, np.int64)] * len(docs)
        # a 0 after each document keeps runs apart
        ids = np.concatenate([x for d in docs for x in (d, [0])]) if docs else np.zeros(0, np.int32)
        place = np.arange(len(ids))
        edge = np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - start >= max(self.shortest, 1)
        start, end = start[long], end[long]
        if not len(self.lengths) or not len(start):
            return hits, spans, items
        take = np.zeros(len(ids) + 1, np.int64)
        np.add.at(take, start, 1)
        np.add.at(take, end + 1, -1)  # with its end mark, which is a 0
        keep = np.cumsum(take[:-1]) > 0
        text, where = ids[keep].astype(np.int64), place[keep]
        index = FMIndex(text, np.flatnonzero(text == 0), len(self.vocabulary) + 1)
        lo, hi = index.search(self.rows, self.lengths)
        n = hi - lo
        pattern = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(lo, n) + np.arange(len(pattern)) - np.repeat(np.cumsum(n) - n, n)
        at = where[index.locate(rows)]
        doc = np.searchsorted(first + np.arange(len(first)), at, side="right") - 1
        cover = np.zeros(len(ids) + 1, np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.lengths[pattern], -1)
        covered = np.cumsum(cover[:-1]) > 0
        edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(first + np.arange(len(first)), start, side="right") - 1
        np.add.at(hits, owner, end - start)
        pairs = np.unique(np.stack([doc, pattern]), axis=1)
        m = self.item_start[pairs[1] + 1] - self.item_start[pairs[1]]
        spot = np.repeat(self.item_start[pairs[1]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        of_doc, of_item = np.unique(np.stack([np.repeat(pairs[0], m), self.items[spot]]), axis=1)
        for d in np.unique(owner):
            a, b = np.searchsorted(owner, [d, d + 1])
            spans[d] = np.stack([start[a:b], end[a:b]], 1) - (first[d] + d)
            a, b = np.searchsorted(of_doc, [d, d + 1])
            items[d] = of_item[a:b]
        return hits, spans, items


def _scanned(blocks: list[Patterns], column: pa.Array) -> Iterator[tuple[int, list[tuple[int, np.ndarray, set[str]]]]]:
    """Each document's (n_words, word spans, items), shard by shard."""
    shard: list[list[bytes]] = []
    held = 0

    def flush():
        found = [(len(w), [], set()) for w in shard]
        for p in blocks:
            get = p.vocabulary.get
            ids = [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)) for w in shard]
            _, spans, items = p.scan(ids)
            for f, s, i in zip(found, spans, items, strict=True):
                if len(s):
                    f[1].append(s)
                    f[2].update(p.ids[k] for k in i)
        return [(n, merged(s), i) for n, s, i in found]

    for t in texts(column):
        shard.append(words_of(t))
        held += len(shard[-1])
        if held >= SHARD_WORDS:
            yield from flush()
            shard, held = [], 0
    if shard:
        yield from flush()


def merged(spans: list[np.ndarray]) -> np.ndarray:
    """The union of span lists, as sorted spans that neither meet nor overlap."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    if len(spans) == 1:
        return spans[0]
    s = np.concatenate(spans)
    s = s[np.argsort(s[:, 0], kind="stable")]
    reach = np.maximum.accumulate(s[:, 1])
    new = np.concatenate([[True], s[1:, 0] > reach[:-1]])
    return np.stack([s[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]], 1)


def byte_spans(text: bytes, spans: np.ndarray) -> list[tuple[int, int]]:
    """Word spans as byte spans of the text."""
    if not len(spans):
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def blocks_of(benchmark: DataFrame, text: str = "text", item: str = "item_id", size: int = SIZE) -> list[Patterns]:
    """The benchmark's windows, in blocks of BLOCK_BYTES at most: what workers hold at a time stays bounded."""
    out, block, held = [], [], 0
    rows = benchmark.where(F.col(text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("string"), text)
    for i, t in rows.toLocalIterator():
        block.append((i, t.encode()))
        held += len(block[-1][1])
        if held >= BLOCK_BYTES:
            out.append(Patterns(block, size))
            block, held = [], 0
    return [*out, Patterns(block, size)] if block or not out else out


def report(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, parts: int = PARTS) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items_sha256, contaminated, spans (bytes [start, end) to remove)."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(blocks_of(benchmark, size=size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            n_words, n_hit, n_items, digests, bad, cut = [], [], [], [], [], []
            raw = texts(b.column(1))
            for (n, spans, items), t in zip(_scanned(sent.value, b.column(1)), raw, strict=True):
                hit = int((spans[:, 1] - spans[:, 0]).sum())
                n_words.append(n)
                n_hit.append(hit)
                n_items.append(len(items))
                digests.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
                bad.append(hit > 0 and parts * hit >= n)
                cut.append([{"start": x, "end": y} for x, y in byte_spans(t, spans)] if hit else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests, pa.string()), pa.array(bad, pa.bool_()), pa.array(cut, span)],
                [key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    schema = f"`{key}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"
    return bounded_batches(docs).select(key, text).mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = SIZE, parts: int = PARTS) -> DataFrame:
    """The rows, with all their columns, whose documents are not contaminated; their texts stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(blocks_of(benchmark, size=size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, spans, _ in _scanned(sent.value, b.column(b.schema.get_field_index(text))):
                hit = int((spans[:, 1] - spans[:, 0]).sum())
                keep.append(not (hit > 0 and parts * hit >= n))
            yield b.filter(pa.array(keep, pa.bool_()))

    return bounded_batches(docs).mapInArrow(run, docs.schema)
