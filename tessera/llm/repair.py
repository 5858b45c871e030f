"""Token-id output compressed by a Re-Pair grammar per shard, with random access.

Texts are encoded in ascending key order; each document's ids end with an end id. A shard's ids are compressed in
rounds: the most frequent adjacent pairs, counted over the whole shard, become nonterminals and are replaced from
the most frequent on, overlaps going to the pair with more occurrences and then to the left one. Pairs never cross
documents. A shard's file has the rules, each rule's expansion length, the remaining symbols and the document
table; a range of tokens is decoded by cumulated expansion lengths, touching only the symbols it needs.

File format, little endian: magic ``RPG1``; uint32 terminals, rules, symbols, documents; rules as uint32 pairs;
expansion lengths as uint32; the symbols' low 16 bits as uint16, then one bit plane (np.packbits) for each higher
bit; per document int64 key, uint32 symbols, uint32 tokens; a packed bit per document that is 1 where the key is null.

Cases: a null text is empty and gives the end id alone; an empty table gives no file rows and no documents; equal
keys are ordered by text; a document of any length stays whole in one shard; a null key sorts first; extra columns
are ignored. Keys are integers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, gathered, shared_dir, texts, utf8
from .encoder import Encoder

END = 1
#: Tokens that one shard file holds, but for a longer single document.
SHARD_TOKENS = 3_000_000
#: Occurrences that a rule needs.
LEAST = 12
_HASH_BITS = 20


def compress(ids: np.ndarray, sizes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over documents of the given sizes: terminals, rules (n, 2), expansion lengths, symbols, symbols per document."""
    seq = ids.astype(np.int32)
    terminals = int(seq.max()) + 1 if len(seq) else 1
    last = np.zeros(len(seq), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    rules, lengths = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    fresh = 0  # pairs of older symbols were counted before, and only lose since
    while len(seq) > 1:
        spots = np.flatnonzero(~last[:-1] & ((seq[:-1] >= fresh) | (seq[1:] >= fresh))) if fresh else np.flatnonzero(~last[:-1])
        a, b = seq[spots], seq[spots + 1]
        bucket = (((a.view(np.uint32) * np.uint32(0x9E3779B1)) ^ (b.view(np.uint32) * np.uint32(0x85EBCA77))) >> np.uint32(32 - _HASH_BITS)).astype(np.intp)
        often = np.flatnonzero(np.bincount(bucket, minlength=1 << _HASH_BITS)[bucket] >= LEAST)  # the others' pairs are rarer still
        spots, bucket = spots[often], bucket[often]
        pair = a[often].astype(np.int64) << 32 | b[often]
        owner = np.full(1 << _HASH_BITS, -1, np.int64)
        owner[bucket] = pair
        mine = owner[bucket] == pair  # one pair counts in each bucket, those that share it are sorted
        rest = np.flatnonzero(~mine)
        other, which_other, counts_other = np.unique(pair[rest], return_inverse=True, return_counts=True)
        used = np.bincount(bucket[mine], minlength=1 << _HASH_BITS)
        code, counts = np.concatenate([owner, other]), np.concatenate([used, counts_other])
        best = np.flatnonzero(counts >= LEAST)
        if not len(best):
            break
        best = best[np.lexsort((code[best], -counts[best]))]
        rank = np.full(len(code), -1, np.int64)
        rank[best] = np.arange(len(best))
        which = rank[bucket]
        which[rest] = rank[len(owner) + which_other]
        won, rule = settled(spots[which >= 0], which[which >= 0], len(seq))
        made = np.bincount(rule, minlength=len(best))
        kept = made >= LEAST // 2  # overlaps may have left a pair too few places to be worth a rule
        won, rule = won[kept[rule]], (np.cumsum(kept) - 1)[rule[kept[rule]]]
        if not len(won):
            break
        left, right = code[best[kept]] >> 32, code[best[kept]] & 0xFFFFFFFF
        known = np.concatenate([np.ones(terminals, np.int64), lengths])
        fresh = terminals + len(rules)
        seq[won] = fresh + rule
        lengths, rules = np.concatenate([lengths, known[left] + known[right]]), np.concatenate([rules, np.stack([left, right], 1)])
        last[won] = last[won + 1]
        keep = np.ones(len(seq), bool)
        keep[won + 1] = False
        seq, last = seq[keep], last[keep]
    ends = np.flatnonzero(last) + 1
    per = np.zeros(len(sizes), np.int64)
    per[sizes > 0] = np.diff(np.concatenate([[0], ends]))
    return terminals, rules, lengths, seq, per


def settled(spots: np.ndarray, rule: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending positions with a rule each, those to replace: where neighbours overlap, the lower rule, then the left."""
    won_at, won_rule = [], []
    while len(spots):
        order = rule * n + spots
        left = np.concatenate([[False], spots[1:] == spots[:-1] + 1])
        right = np.concatenate([left[1:], [False]])
        beaten = np.zeros(len(spots), bool)
        beaten[1:] |= left[1:] & (order[:-1] < order[1:])
        beaten[:-1] |= right[:-1] & (order[1:] < order[:-1])
        won = ~beaten
        won_at.append(spots[won])
        won_rule.append(rule[won])
        gone = won.copy()
        gone[1:] |= left[1:] & won[:-1]
        gone[:-1] |= right[:-1] & won[1:]
        spots, rule = spots[~gone], rule[~gone]
    at, rule = np.concatenate(won_at), np.concatenate(won_rule)
    by = np.argsort(at)
    return at[by], rule[by]


def pack(keys: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> bytes:
    terminals, rules, lengths, seq, per = compress(ids, sizes)
    bits = max(16, int(terminals + len(rules)).bit_length())
    out = [b"RPG1", struct.pack("<4I", terminals, len(rules), len(seq), len(sizes)), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), (seq & 0xFFFF).astype("<u2").tobytes()]
    out += [np.packbits(((seq >> k) & 1).astype(np.uint8)).tobytes() for k in range(16, bits)]
    out += [np.array([k or 0 for k in keys], "<i8").tobytes(), per.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), np.packbits(np.array([k is None for k in keys], np.uint8)).tobytes()]
    return b"".join(out)


class Shard:
    """A shard file, opened for reading."""

    def __init__(self, data: bytes):
        if data[:4] != b"RPG1":
            raise ValueError("not a shard file")
        self.terminals, n_rules, n_symbols, n_docs = struct.unpack_from("<4I", data, 4)
        at = 20

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules = read("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.lengths = read("<u4", n_rules).astype(np.int64)
        self.symbols = read("<u2", n_symbols).astype(np.int64)
        for k in range(16, max(16, int(self.terminals + n_rules).bit_length())):
            self.symbols |= np.unpackbits(read("u1", -(-n_symbols // 8)), count=n_symbols).astype(np.int64) << k
        self.keys, self.per, self.sizes = read("<i8", n_docs), read("<u4", n_docs).astype(np.int64), read("<u4", n_docs).astype(np.int64)
        self.flat = self.at = None
        self.null_keys = np.unpackbits(read("u1", -(-n_docs // 8)), count=n_docs).astype(bool)

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols' ids; rules are spelled out once, each from two earlier symbols."""
        if self.flat is None:
            known = np.concatenate([np.ones(self.terminals, np.int64), self.lengths])
            at = np.concatenate([[0], np.cumsum(known)])
            flat = np.zeros(int(at[-1]), "<u4")
            flat[: self.terminals] = np.arange(self.terminals)
            spots = at.tolist()
            for k, (a, b) in enumerate(self.rules.tolist(), self.terminals):
                middle = spots[k] + spots[a + 1] - spots[a]
                flat[spots[k] : middle] = flat[spots[a] : spots[a + 1]]
                flat[middle : spots[k + 1]] = flat[spots[b] : spots[b + 1]]
            self.flat, self.at = flat, at
        return gathered(self.flat, self.at, symbols)

    def span(self, start: int, end: int) -> np.ndarray:
        """The tokens [start, end) of the shard, by the symbols that hold them."""
        size = np.where(self.symbols < self.terminals, 1, self.lengths[np.maximum(self.symbols - self.terminals, 0)] if len(self.lengths) else 1)
        reach = np.cumsum(size)
        start, end = max(0, start), min(end, int(reach[-1]) if len(reach) else 0)
        if start >= end:
            return np.zeros(0, "<u4")
        a, b = np.searchsorted(reach, start, side="right"), np.searchsorted(reach, end, side="left")
        skipped = int(reach[a] - size[a])
        return self.expanded(self.symbols[a : b + 1])[start - skipped : end - skipped]

    def tokens(self) -> np.ndarray:
        return self.expanded(self.symbols)


def write(docs: DataFrame, tokenizer: str, path: str, text: str = "text", key: str = "doc_id", end: int = END) -> None:
    """Writes shard files under `path`, as rows (shard, block, n_docs, n_tokens, file) in ascending key order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder.shared(tokenizer), TaskContext.get().partitionId()
        keys, ids, sizes, held, block = [], [], [], 0, 0

        def flush():
            nonlocal keys, ids, sizes, held, block
            n = np.concatenate(sizes)
            data = pack(keys, np.concatenate(ids), n)
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([data], pa.binary())], ["shard", "block", "n_docs", "n_tokens", "file"])
            keys, ids, sizes, held, block = [], [], [], 0, block + 1
            return row

        for b in batches:
            own = b.column(0).to_pylist()
            raw, ends, _ = utf8(b.column(1))
            at = 0
            while at < len(own):
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] + (4 << 20), side="right")) - 1)
                found, n = encoder.encode(raw[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at])
                full = n + 1  # the end id after each document
                out = np.full(int(full.sum()), end, np.uint32)
                spots = np.ones(len(out), bool)
                spots[np.cumsum(full) - 1] = False
                out[spots] = found
                keys += own[at:stop]
                ids.append(out)
                sizes.append(full)
                held += len(out)
                at = stop
                if held >= SHARD_TOKENS:
                    yield flush()
        if keys:
            yield flush()

    rows = bounded_batches(docs).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    rows = rows.repartitionByRange("k").sortWithinPartitions("k", "t")
    rows.mapInArrow(run, "shard int, block int, n_docs long, n_tokens long, file binary").write.parquet(path)


def read(spark, path: str, key: str = "doc_id") -> DataFrame:
    """Per document of the files: key, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    before, rows = 0, []
    for r in files.select("shard", "block", "n_tokens").orderBy("shard", "block").toLocalIterator():  # a row per SHARD_TOKENS tokens
        rows.append((r["shard"], r["block"], before))
        before += r["n_tokens"]
    starts = spark.sparkContext.broadcast({(s, b): n for s, b, n in rows})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), strict=True):
                shard = Shard(data)
                tokens = shard.tokens()
                ends = np.cumsum(shard.sizes)
                first = ends - shard.sizes
                view = memoryview(tokens).cast("B")
                crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(first.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.keys, pa.int64(), mask=shard.null_keys), pa.array(first + starts.value[s, k]), pa.array(shard.sizes), pa.array(crc, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    return files.select("shard", "block", "file").mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", end: int = END) -> DataFrame:
    """Writes the files to shared storage and reads them back."""
    path = shared_dir(docs.sparkSession)
    write(docs, tokenizer, path, text, key, end)
    return read(docs.sparkSession, path, key)
