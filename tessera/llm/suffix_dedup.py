"""Removal of repeated byte strings with suffix arrays built bucket by bucket over a difference cover.

A byte goes when a string of `size` bytes that covers it also starts in a document with a smaller key. Strings never
cross documents and are judged on the input. The rule needs, for each string, the smallest key that has it:

1. Exact copies keep one representative: a copy with a larger key is covered whole (if it has `size` bytes).
2. Every string of `size` bytes belongs to the suffix bucket of its anchor, the smallest hash among its GRAM-byte
   substrings, so equal strings are in the same bucket. Consecutive strings with one anchor make a context of the
   text. Each part of the documents sends its distinct anchors, packed, by anchor; those that one part alone has, in
   one document, hold no repeat and are done with.
3. Contexts of the other anchors go, once per part with the part's smallest key, to their bucket's task. A bucket with
   one distinct context needs no sort. The others are sorted as suffixes: the ranks of a difference-cover sample of
   the text come first; then one bucket of suffixes at a time is sorted by its first PERIOD bytes, and longer ties are
   compared by the sample ranks a few bytes further on. Equal neighbours give each string's smallest key.
4. What is smaller than a part's own smallest key returns to it, and the documents' covered bytes are cut.

Texts are dealt once, by content; the three passes over them read the same exchange. No step gathers a hot string:
contexts are deduplicated in each part before they travel.

Cases: null and empty texts, and texts under `size` bytes, lose nothing; rows with equal keys never cut each other;
a null key counts as larger than all; an empty table gives no rows; very long texts are handled in blocks; extra
columns are ignored by report() and kept by cut_repeats().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, given_back, tidy, utf8

SIZE = 50
#: Bytes of an anchor.
GRAM = 24
#: Strings that one context holds at most.
RUN = 96
#: Period of the difference cover: suffixes are compared by their first PERIOD bytes before ranks are used.
PERIOD = 32
#: Suffixes sorted at a time; bytes of text that anchors are found in, or suffixes sorted over, at a time.
BUCKET, BLOCK = 1 << 16, 1 << 21
#: Bytes of text in a task and in a part, of which a task has several.
TASK_BYTES, PARTS_PER_TASK = 16 << 20, 4
#: Copies from this part of all rows on are taken out before texts are dealt; at most as many groups.
HEAVY_PARTS = 2000
LAST = (1 << 63) - 1


def difference_cover(v: int) -> np.ndarray:
    """Residues such that every difference modulo v is one of two of them: 0..r-1 and the multiples of r, for r near sqrt(v)."""
    r = int(np.ceil(v**0.5))
    return np.array(sorted({*range(r), *range(0, v + 1, r)} - {v} | ({0})), np.int64)


def _words(text: np.ndarray, count: int) -> np.ndarray:
    """The big-endian 8-byte word at each of the first `count` positions."""
    return np.ndarray((count,), ">u8", text.tobytes() if not text.flags.c_contiguous else text, 0, (1,)).astype(np.uint64)


class SuffixSorter:
    """Orders chosen suffixes of a text, one bucket at a time, in memory bounded by the bucket and the sample's ranks."""

    def __init__(self, text: np.ndarray, v: int = PERIOD):
        self.n, self.v = len(text), v
        self.padded = np.concatenate([text, np.zeros(2 * v + 8, np.uint8)])
        self.word = _words(self.padded, self.n + v)
        cover = difference_cover(v)
        in_cover = np.zeros(v, bool)
        in_cover[cover] = True
        # delta[a, b]: how far on both of two suffixes at residues a and b are in the sample
        self.delta = np.zeros((v, v), np.int64)
        for d in range(v - 1, -1, -1):
            both = np.roll(in_cover, -d)
            self.delta[np.ix_(both, both)] = d
        sample = np.flatnonzero(in_cover[np.arange(self.n) % v])
        self.rank = np.full(self.n + 2 * v, -1, np.int64)
        if len(sample):
            self._rank_sample(sample)

    def _rank_sample(self, sample: np.ndarray) -> None:
        keys = [self.word[np.minimum(sample + 8 * k, len(self.word) - 1)] for k in range(self.v // 8 - 1, -1, -1)]
        length = np.minimum(self.n - sample, self.v)  # a suffix that ends sooner is smaller than the same bytes padded
        order = np.lexsort((length, *keys))
        same = length[order][1:] == length[order][:-1]
        for k in keys:
            same &= k[order][1:] == k[order][:-1]
        name = np.concatenate([[0], np.cumsum(~same)])
        self.rank[sample[order]] = name
        step = self.v
        while name[-1] < len(sample) - 1:
            after = np.where(sample + step < self.n, self.rank[np.minimum(sample + step, self.n + self.v)], -1)
            now = self.rank[sample]
            order = np.lexsort((after, now))
            same = (now[order][1:] == now[order][:-1]) & (after[order][1:] == after[order][:-1])
            name = np.concatenate([[0], np.cumsum(~same)])
            self.rank[sample[order]] = name
            step *= 2

    def sorted_bucket(self, at: np.ndarray) -> np.ndarray:
        """The suffixes at these positions, in order: by v bytes, then ties around pivots by sample ranks."""
        keys = [self.word[np.minimum(at + 8 * k, len(self.word) - 1)] for k in range(self.v // 8 - 1, -1, -1)]
        order = np.lexsort(keys)
        at = at[order]
        same = np.ones(max(len(at) - 1, 0), bool)
        for k in keys:
            same &= k[order][1:] == k[order][:-1]
        group = np.concatenate([[0], np.cumsum(~same)]) if len(at) else np.zeros(0, np.int64)
        while True:
            first = np.concatenate([[True], group[1:] != group[:-1]])
            start = np.flatnonzero(first)
            size = np.diff(np.append(start, len(group)))
            tied = np.flatnonzero(np.repeat(size > 1, size))
            if not len(tied):
                return at
            pivot = at[np.repeat(start + size // 2, size)[tied]]
            mine = at[tied]
            d = self.delta[mine % self.v, pivot % self.v]
            side = np.sign(self.rank[np.minimum(mine + d, self.n + self.v)] - self.rank[np.minimum(pivot + d, self.n + self.v)])
            order = np.lexsort((side, group[tied]))
            at[tied] = mine[order]
            g, side = group[tied][order], side[order]
            new = np.zeros(len(group), bool)
            new[tied[1:]] = (g[1:] != g[:-1]) | (side[1:] != side[:-1])
            group = np.cumsum(first | new)

    def order(self, at: np.ndarray) -> Iterator[np.ndarray]:
        """All suffixes at these positions, bucket by bucket: a bucket is a range of first words."""
        by = at[np.argsort(self.word[at], kind="stable")]
        first = self.word[by]
        k = 0
        while k < len(by):
            j = min(k + BUCKET, len(by))
            j = int(np.searchsorted(first, first[j - 1], side="right"))
            yield self.sorted_bucket(by[k:j])
            k = j


def runs_of(raw: np.ndarray, at: np.ndarray, size: int = SIZE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of all strings of `size` bytes: (document, first start, last start, anchor), blocks of documents at a time."""
    n, k = len(at) - 1, 0
    mix = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    while k < n:
        j = max(k + 1, int(np.searchsorted(at, at[k] + BLOCK, side="right")) - 1)
        x, y = int(at[k]), int(at[j])
        if y - x >= size:
            block = raw[x:y]
            grams = len(block) - GRAM + 1
            word = np.ndarray((len(block) - 7,), "<u8", np.ascontiguousarray(block), 0, (1,))
            h = word[:grams] * mix[0]
            for i in range(1, GRAM // 8):
                h ^= h >> np.uint64(29)
                h += word[8 * i : 8 * i + grams]
                h *= mix[i % 3]
            h ^= h >> np.uint64(32)
            need, width = size - GRAM + 1, 1
            while 2 * width <= need:
                h = np.minimum(h[:-width], h[width:])
                width *= 2
            if width < need:
                h = np.minimum(h[: len(h) - (need - width)], h[need - width :])
            doc = np.repeat(np.arange(k, j), np.diff(at[k : j + 1]))[: len(h)]
            fits = np.arange(x, x + len(h)) + size <= at[doc + 1]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            start = np.flatnonzero(new)
            end = np.append(start[1:], len(h)) - 1
            long = np.flatnonzero(end - start >= RUN)
            if len(long):  # periodic texts: one anchor over many strings
                pieces = np.concatenate([np.arange(a, b + 1, RUN) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)])
                new[pieces] = True
                start = np.flatnonzero(new)
                end = np.append(start[1:], len(h)) - 1
            end = np.minimum(end, at[doc[start] + 1] - size - x)
            ok = fits[start]
            start, end = start[ok], end[ok]
            found = doc[start], start + x, end + x, h[start]
            del block, word, h, doc, fits, new
            yield found
        k = j


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % buckets


def _split(by: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(by, kind="stable")
    return order, np.searchsorted(by[order], np.arange(n + 1))


def _least_of_block(contexts: list[bytes], keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings of these contexts with one smallest key: (context, first string, last string, key). What it sorts by is freed with it."""
    text = np.frombuffer(b"".join(contexts), np.uint8)
    lengths = np.array([len(c) for c in contexts])
    strings = lengths - size + 1
    first = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(contexts)), strings)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    sorter = SuffixSorter(text)
    slot = np.zeros(len(text), np.int64)
    slot[first[owner] + nth] = np.arange(len(owner))
    found = keys[owner]
    for bucket in sorter.order(first[owner] + nth):
        a, b = bucket[:-1], bucket[1:]
        same = np.ones(len(a), bool)
        for d in [*range(0, size - 7, 8), size - 8]:
            same &= sorter.word[a + d] == sorter.word[b + d]
        group = np.concatenate([[0], np.cumsum(~same)])
        s = slot[bucket]
        least = np.full(group[-1] + 1, LAST)
        np.minimum.at(least, group, found[s])
        found[s] = least[group]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(found)) - 1
    return owner[start], nth[start], nth[end], found[start]


def smallest_keys(contexts: list[bytes], anchors: np.ndarray, keys: np.ndarray, size: int) -> list[list[tuple[int, int, int]]]:
    """For distinct contexts with the smallest key that has each: runs (first string, last string, smallest key) of its strings."""
    out = [[(0, len(c) - size, int(k))] for c, k in zip(contexts, keys, strict=True)]
    by = np.argsort(anchors, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(anchors[by].view(np.int64)) != 0, [True]])) if len(by) else np.zeros(1, int)
    shared = [by[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True) if b - a > 1]
    k = 0
    while k < len(shared):
        chosen, held = [], 0
        while k < len(shared) and (not chosen or held < BLOCK):
            chosen.append(shared[k])
            held += sum(len(contexts[i]) for i in shared[k])
            k += 1
        members = np.concatenate(chosen)
        owner, first, last, found = _least_of_block([contexts[i] for i in members], keys[members], size)
        for i in members:
            out[i] = []
        for o, a, b, m in zip(members[owner].tolist(), first.tolist(), last.tolist(), found.tolist(), strict=True):
            out[o].append((a, b, m))
    return out


class _Part:
    """The documents of a part: exact copies aside, runs by anchor, contexts of the anchors that may repeat."""

    def __init__(self, table: pa.Table, text: str, size: int):
        self.raw, self.at, _ = utf8(table.column(text))
        self.keys = table.column("__key").to_numpy().astype(np.int64)
        self.size, n = size, len(self.keys)
        self.copy = np.zeros(n, bool)
        whole = self.raw.tobytes()
        least: dict[bytes, int] = {}
        digest = []
        for i in range(n):
            d = hashlib.blake2b(whole[self.at[i] : self.at[i + 1]], digest_size=16).digest()
            digest.append(d)
            least[d] = min(least.get(d, LAST), int(self.keys[i]))
        taken: set[bytes] = set()
        for i in range(n):  # of equal texts with equal smallest keys one stands for all
            self.copy[i] = int(self.keys[i]) > least[digest[i]] or digest[i] in taken
            if not self.copy[i]:
                taken.add(digest[i])
        self.least = np.array([least[d] for d in digest], np.int64) if n else np.zeros(0, np.int64)
        self.twin = self.copy & (self.keys == self.least) if n else self.copy
        self.same = {d: i for i, d in enumerate(digest) if not self.copy[i]}
        self.digest = digest
        keep = ~self.copy
        self.runs = [np.concatenate(x) if x else np.zeros(0, np.uint64 if k == 3 else np.int64) for k, x in enumerate(zip(*[tuple(c[keep[d]] for c in (d, a, b, m)) for d, a, b, m in runs_of(self.raw, self.at, size)], strict=True))] or [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]

    def anchors(self) -> np.ndarray:
        return np.unique(self.runs[3])

    def contexts(self, flagged: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Runs that may repeat, each one's context, the distinct contexts, their anchors and smallest keys here."""
        doc, start, end, anchor = self.runs
        order = np.lexsort((doc, anchor))
        a, d = anchor[order], doc[order]
        several = np.unique(a[1:][(a[1:] == a[:-1]) & (d[1:] != d[:-1])])  # in two documents of this part
        picked = np.flatnonzero(np.isin(anchor, np.union1d(flagged, several)))
        # numbers must not depend on the order of rows, which may differ when a part is read again: one row has each digest here
        rank = np.zeros(len(self.keys), np.int64)
        rank[sorted(self.same.values(), key=lambda i: self.digest[i])] = np.arange(len(self.same))
        picked = picked[np.argsort(rank[doc[picked]], kind="stable")]
        whole = self.raw.tobytes()
        number: dict[bytes, int] = {}
        stop = (end[picked] + self.size).tolist()
        which = np.array([number.setdefault(whole[x:y], len(number)) for x, y in zip(start[picked].tolist(), stop, strict=True)], np.int64)
        of = np.zeros(len(number), np.uint64)
        of[which] = anchor[picked]
        least = np.full(len(number), LAST)
        np.minimum.at(least, which, self.keys[doc[picked]])
        return picked, which, list(number), of, least


def _deal(docs: DataFrame, text: str, key: str, size: int) -> tuple[DataFrame, DataFrame, int, int]:
    """The rows with __key and __part; heavy copies; the numbers of tasks and parts."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.withColumn("__key", F.coalesce(F.col(key).cast("long"), F.lit(LAST))).withColumn("__digest", F.md5(t))
    groups = rows.groupBy("__digest").agg(F.count("*").alias("n"), F.min("__key").alias("least"), F.max(F.octet_length(t)).alias("size"))
    total = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("bytes")).first()
    all_rows, all_bytes = total["n"] or 0, total["bytes"] or 0
    heavy = groups.where((F.col("n") > max(50, all_rows // HEAVY_PARTS)) & (F.col("size") >= size)).select("__digest", F.col("least").alias("__least"))
    rows = rows.join(F.broadcast(heavy), "__digest", "left")
    out = F.col("__least").isNotNull() & (F.col("__key") > F.col("__least"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-all_bytes // TASK_BYTES))
    parts = tasks * PARTS_PER_TASK
    light = rows.where(~F.coalesce(out, F.lit(False))).withColumn("__part", F.pmod(F.xxhash64("__digest"), F.lit(parts)).cast("int"))
    return light.drop("__digest", "__least").repartition(tasks, "__part"), rows.where(out).drop("__digest", "__least"), tasks, parts


def _apply(docs: DataFrame, text: str, key: str, size: int, schema: T.StructType, finish, finish_heavy) -> DataFrame:
    bounded_batches(docs)
    dealt, heavy, tasks, _ = _deal(docs, text, key, size)
    message = "__part int, kind int, payload binary"

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        """A task's rows part by part; they come sorted."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(b.schema.get_field_index("__part")).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if held and held[-1].column(held[-1].schema.get_field_index("__part"))[0].as_py() != int(part[x]):
                    yield held[0].column(held[0].schema.get_field_index("__part"))[0].as_py(), pa.Table.from_batches(held)
                    held = []
                held.append(b.slice(x, y - x))
        if held:
            yield held[0].column(held[0].schema.get_field_index("__part"))[0].as_py(), pa.Table.from_batches(held)

    def send(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        p, k, b = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(b, pa.binary())], ["__part", "kind", "payload"])

    def anchors(batches):
        for part, table in grouped(batches):
            found = _Part(table, text, size).anchors()
            order, cut = _split(_bucket(found, tasks), tasks)
            found = found[order]
            yield send([(b, part, found[cut[b] : cut[b + 1]].tobytes()) for b in range(tasks) if cut[b] < cut[b + 1]])

    def repeated(batches):
        """Of a task's anchors, those that two parts have, to each of these parts."""
        parts, data = [], []
        for b in batches:
            parts += b.column(1).to_pylist()
            data += b.column(2).to_pylist()
        if not parts:
            return
        values = np.frombuffer(b"".join(data), np.uint64)
        owner = np.repeat(np.array(parts), [len(d) // 8 for d in data])
        order = np.argsort(values, kind="stable")
        v, o = values[order], owner[order]
        twice = np.zeros(len(v), bool)
        twice[1:] = v[1:] == v[:-1]
        twice[:-1] |= twice[1:]
        v, o = v[twice], o[twice]
        order = np.argsort(o, kind="stable")
        v, o = v[order], o[order]
        edge = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1], [True]])) if len(o) else [0]
        yield send([(int(o[x]), 0, v[x:y].tobytes()) for x, y in zip(edge[:-1], edge[1:], strict=True)])

    def flagged_of(right: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(p for k, p in zip(right.column("kind").to_pylist(), right.column("payload").to_pylist(), strict=True) if k == 0), np.uint64)

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([send([])])
        part = left.column("__part")[0].as_py()
        _, _, found, anchor, least = _Part(left, text, size).contexts(flagged_of(right))
        order, cut = _split(_bucket(anchor, tasks), tasks)
        rows = []
        for b in range(tasks):
            if cut[b] < cut[b + 1]:
                own = order[cut[b] : cut[b + 1]]
                texts = [found[i] for i in own]
                rows.append((b, part, np.uint32(len(own)).tobytes() + own.astype(np.uint32).tobytes() + anchor[own].tobytes() + least[own].tobytes() + np.array([len(t) for t in texts], np.uint32).tobytes() + b"".join(texts)))
        out = pa.Table.from_batches([send(rows)])
        del found, anchor, least, order, rows
        given_back()
        return out

    def sort_contexts(batches):
        number: dict[bytes, int] = {}
        part, local, which, least, anchor = [], [], [], [], []
        for b in batches:
            for p, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n = int(np.frombuffer(data, np.uint32, 1)[0])
                own = np.frombuffer(data, np.uint32, n, 4)
                a = np.frombuffer(data, np.uint64, n, 4 + 4 * n)
                k = np.frombuffer(data, np.int64, n, 4 + 12 * n)
                ends = np.cumsum(np.frombuffer(data, np.uint32, n, 4 + 20 * n).astype(np.int64)) + 4 + 24 * n
                x = 4 + 24 * n
                for e in ends.tolist():
                    which.append(number.setdefault(data[x:e], len(number)))
                    x = e
                part.append(np.full(n, p))
                local.append(own)
                least.append(k)
                anchor.append(a)
        if not part:
            return
        part, local, which, least, anchor = np.concatenate(part), np.concatenate(local), np.array(which), np.concatenate(least), np.concatenate(anchor)
        of, key_of = np.zeros(len(number), np.uint64), np.full(len(number), LAST)
        of[which] = anchor
        np.minimum.at(key_of, which, least)
        runs = smallest_keys(list(number), of, key_of, size)
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        for p, i, w, k in zip(part.tolist(), local.tolist(), which.tolist(), least.tolist(), strict=True):
            for a, b, m in runs[w]:
                if m < k:
                    rows.setdefault(p, []).append((i, a, b, m))
        yield send([(p, 1, np.array(r, np.int64).tobytes()) for p, r in rows.items()])

    def cut_part(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema_table([])
        p = _Part(left, text, size)
        picked, which, found, _, least = p.contexts(flagged_of(right))
        told = [np.frombuffer(d, np.int64).reshape(-1, 4) for k, d in zip(right.column("kind").to_pylist(), right.column("payload").to_pylist(), strict=True) if k == 1]
        rows = np.concatenate(told) if told else np.zeros((0, 4), np.int64)
        # a context's strings keep the part's own smallest key unless a smaller one was found
        full = np.stack([np.arange(len(found)), np.zeros(len(found), np.int64), np.array([len(c) - size for c in found], np.int64), least], 1) if found else np.zeros((0, 4), np.int64)
        rows = np.concatenate([rows, full])
        order = np.argsort(rows[:, 0], kind="stable")
        rows = rows[order]
        bounds = np.searchsorted(rows[:, 0], np.arange(len(found) + 1))
        n = bounds[which + 1] - bounds[which]
        run = np.repeat(picked, n)
        row = rows[np.repeat(bounds[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        gone = row[:, 3] < p.keys[p.runs[0][run]]
        start = p.runs[1][run][gone] + row[gone, 1]
        end = p.runs[1][run][gone] + row[gone, 2] + size
        spans = [[] for _ in range(len(p.keys))]
        by = np.argsort(start, kind="stable")
        start, end, owner = start[by], end[by], p.runs[0][run][gone][by]
        if len(start):
            reach = np.maximum.accumulate(end)
            new = np.ones(len(start), bool)
            new[1:] = (start[1:] > reach[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(start)) - 1
            for o, x, y in zip(owner[first].tolist(), start[first].tolist(), reach[last].tolist(), strict=True):
                spans[o].append((x - int(p.at[o]), y - int(p.at[o])))
        for i in np.flatnonzero(p.copy).tolist():
            if p.twin[i]:
                spans[i] = spans[p.same[p.digest[i]]]
            elif p.at[i + 1] - p.at[i] >= size:
                spans[i] = [(0, int(p.at[i + 1] - p.at[i]))]
        whole = p.raw.tobytes()
        out = schema_table([finish(left, [whole[p.at[i] : p.at[i + 1]] for i in range(len(p.keys))], spans)])
        del p, whole, found, rows, row, told
        given_back()
        return out

    arrow = None

    def schema_table(batches: list[pa.RecordBatch]) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        nonlocal arrow
        arrow = arrow or to_arrow_schema(schema)
        return pa.Table.from_batches(batches) if batches else arrow.empty_table()

    in_order = dealt.sortWithinPartitions("__part")
    by_anchor = in_order.mapInArrow(tidy(anchors), message).repartition(tasks, "__part")
    flagged = by_anchor.mapInArrow(tidy(repeated), message)
    left = dealt.groupBy("__part")
    found = left.cogroup(flagged.groupBy("__part")).applyInArrow(contexts, message).repartition(tasks, "__part")
    smaller = found.mapInArrow(tidy(sort_contexts), message)
    out = left.cogroup(flagged.unionByName(smaller).groupBy("__part")).applyInArrow(cut_part, schema)
    return out.unionByName(finish_heavy(heavy))


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, x = [], 0
    for a, b in spans:
        out.append(text[x:a])
        x = b
    return b"".join([*out, text[x:]])


def kept_text(text: bytes, spans: list[tuple[int, int]]) -> str:
    """What stays of a UTF-8 text when only characters that are covered whole go."""
    whole = []
    for a, b in spans:
        while a < len(text) and (text[a] & 0xC0) == 0x80:
            a += 1
        while b < len(text) and b > a and (text[b] & 0xC0) == 0x80:
            b -= 1
        if a < b:
            whole.append((a, b))
    return kept_bytes(text, whole).decode()


def report(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """Per document: key, n_bytes, n_removed, n_spans, kept_sha256."""
    schema = T.StructType([T.StructField(key, T.LongType())] + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])

    def finish(left, texts, spans):
        removed = [sum(b - a for a, b in s) for s in spans]
        return pa.RecordBatch.from_arrays(
            [left.column("__id").combine_chunks(), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array([hashlib.sha256(kept_bytes(t, s)).hexdigest() for t, s in zip(texts, spans, strict=True)], pa.string())],
            [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    def heavy(rows):
        n = F.octet_length(F.col("__text")).cast("long")
        return rows.select(F.col("__id").alias(key), n.alias("n_bytes"), n.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"))

    narrow = docs.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__text"))
    return _apply(narrow, "__text", "__id", size, schema, finish, heavy)


def cut_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """The rows with all their columns, of whatever names; the text loses the characters whose bytes are all covered. Null texts stay null."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no name that the work adds
    names = plain.columns
    own, key = names[docs.columns.index(text)], names[docs.columns.index(key)]

    def finish(left, texts, spans):
        columns = [left.column(c).combine_chunks() for c in names]
        nulls = left.column(own).is_null().to_pylist()
        columns[names.index(own)] = pa.array([None if z else kept_text(t, s) for t, s, z in zip(texts, spans, nulls, strict=True)], left.schema.field(own).type)
        return pa.RecordBatch.from_arrays(columns, names)

    return _apply(plain, own, key, size, plain.schema, finish, lambda rows: rows.withColumn(own, F.lit("")).select(*names)).toDF(*docs.columns)
