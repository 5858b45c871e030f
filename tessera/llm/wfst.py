"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The machine has three parts, compiled from a SentencePiece BPE model with byte fallback: the normaliser (a space
before the text, spaces written as U+2581), the pieces' trie, which maps character strings to pieces, and byte
fallback for characters that no piece has. A text is composed with them into a lattice: positions are states, each
piece that matches is an arc. A BPE model's pieces carry merge ranks, and a sum of ranks does not give its encoding;
what does is a weight on pairs of arcs in the tropical semiring, 0 where the two pieces are what the merges leave of
their joint string, and infinite otherwise. Exactly one path of each prefix has a finite weight, so the shortest path
keeps one arc per state: the encoding. Whether a pair is free is computed from the pieces' last merges, undoing the
later one of the two each time.

The lattices of many words are solved together in numpy; words are cut where no piece crosses (before a space, at
characters that never stand side by side in a piece), so a text is the sequence of its words' paths, and a worker
remembers words it has seen. Words with runs of spaces or of U+2581 are replayed merge by merge: the model gives all
of the pieces that are made of spaces one equal rank, for which the order of merges, not a weight, decides.

Cases: null and empty texts have no tokens and decode to an empty text; texts of any length are handled whole; a
literal U+2581 in a text decodes to a space, as the model does not tell them apart (round_trip is then false);
repeated rows are each encoded; an empty table gives no rows; extra columns are ignored by encode(), kept by
with_tokens().
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Numbered, bounded_batches, gathered, unused, utf8

SPACE = "▁"
BIG = np.int64(1) << 40
#: Words whose ids a worker remembers.
REMEMBERED = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RUNS = re.compile(r"[ ▁]*[^ \n▁]+|\n|[ ▁]+")


def _merged(symbols: list[str], score: dict[str, float], without: str = "") -> list[str]:
    """Replays BPE: the best-scored adjacent pair merges first, the leftmost of equals; never into `without`."""
    n = len(symbols)
    text, left, right = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < n and (s := text[i] + text[j]) in score and s != without:
            heapq.heappush(heap, (-score[s], i, j, s))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, s = heapq.heappop(heap)
        if text[i] and text[j] and right[i] == j and text[i] + text[j] == s:
            text[i], text[j] = s, ""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
    return [t for t in text if t]


@dataclass
class Machine:
    """Compiled arrays. Pieces are numbered by merge rank: single characters first, then merges from the first on."""

    ids: np.ndarray  # model id by rank
    first: np.ndarray  # the parts of each piece's last merge; a single character's are itself
    second: np.ndarray
    pair_keys: np.ndarray  # sorted first * 2^20 + second, and the piece that they make
    pair_made: np.ndarray
    node_keys: np.ndarray  # sorted hashes of all prefixes of pieces, and the piece there or -1
    node_piece: np.ndarray
    chars: np.ndarray  # sorted code points
    joined: np.ndarray  # [char, char]: some piece has them side by side; row and column 0: unknown
    char_piece: np.ndarray
    byte_ids: np.ndarray
    score: dict[str, float]
    id_of: dict[str, int]
    bytes_flat: np.ndarray  # what each model id decodes to
    bytes_at: np.ndarray


def compile_model(path: str) -> Machine:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    plain = {sp.id_to_piece(i): i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    score = {p: sp.get_score(i) for p, i in plain.items()}
    spelled = [b""] * size
    byte_ids = np.zeros(256, np.int64)
    for i in range(size):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[1:-1], 16)] = i
            spelled[i] = bytes([int(p[1:-1], 16)])
        elif p in plain:
            spelled[i] = p.replace(SPACE, " ").encode()
    single = sorted(p for p in plain if len(p) == 1)
    parts = {}
    for p in plain:  # the state before a piece's own merge
        if len(p) > 1 and set(p) != {SPACE}:
            split = _merged(list(p), score, without=p)
            if len(split) == 2:
                parts[p] = tuple(split)
    ranked = single + sorted(parts, key=lambda p: (-score[p], p))
    number = {p: i for i, p in enumerate(ranked)}
    first, second = np.arange(len(ranked)), np.arange(len(ranked))
    for p, (a, b) in parts.items():
        first[number[p]], second[number[p]] = number[a], number[b]
    merges = np.arange(len(single), len(ranked))
    keys = (first[merges] << 20) | second[merges]
    by = np.argsort(keys)
    chars = np.array(sorted({ord(c) for p in plain for c in p}), np.int64)
    at = {chr(c): i + 1 for i, c in enumerate(chars.tolist())}
    joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
    nodes: dict[int, int] = {}
    for p in ranked:
        h = 0
        for k, c in enumerate(p):
            h = (h * int(_BASE) + at[c]) & 0xFFFFFFFFFFFFFFFF
            nodes.setdefault(h, -1)
            if k:
                joined[at[p[k - 1]], at[c]] = True
        nodes[h] = number[p]
    node_keys = np.array(sorted(nodes), np.uint64)
    ends = np.concatenate([[0], np.cumsum([len(b) for b in spelled])])
    return Machine(
        np.array([plain[p] for p in ranked], np.int64), first, second, keys[by], merges[by], node_keys, np.array([nodes[int(k)] for k in node_keys], np.int64),
        chars, joined, np.array([-1, *(number.get(chr(c), -1) for c in chars.tolist())], np.int64), byte_ids, score, plain, np.frombuffer(b"".join(spelled), np.uint8), ends,
    )


class Transducer:
    """Composes texts with a machine and takes shortest paths."""

    def __init__(self, machine: Machine):
        self.m = machine
        self.index = Numbered()
        self.flat, self.at, self.used = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def free(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces has weight 0: their merges, undone from the last on, never would have joined them."""
        m, out, live = self.m, np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), BIG)
        a, b = a.copy(), b.copy()
        while len(live):
            key = (a << 20) | b
            spot = np.minimum(np.searchsorted(m.pair_keys, key), len(m.pair_keys) - 1)
            made = np.where(m.pair_keys[spot] == key, m.pair_made[spot], BIG)
            bad = made < limit
            out[live[bad]] = False
            ra, lb = m.second[a], m.first[b]
            left = ((a > b) & (ra != a)) | ((a <= b) & (lb == b) & (ra != a))  # undo a's last merge
            right = ~left & (lb != b)
            go = ~bad & (left | right)
            limit = np.where(left, a, b + 1)[go]
            a, b, live = np.where(left, ra, a)[go], np.where(right, lb, b)[go], live[go]
        return out

    def paths(self, chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shortest paths over strings of character numbers laid end to end: the model ids, and the string start each token lies at."""
        m, n = self.m, len(chars)
        begin = np.zeros(n + 1, bool)
        begin[starts] = True
        begin[n] = True
        # states where a path must break: strings' starts, and between characters that no piece joins
        cut = begin.copy()
        cut[1:n] |= ~m.joined[chars[:-1], chars[1:]]
        first = np.maximum.accumulate(np.where(cut[:n], np.arange(n), 0))
        ahead = np.flatnonzero(cut)
        end = ahead[np.searchsorted(ahead, np.arange(n), side="right")]  # the next cut after each state
        # compose: arcs (start, end, piece)
        arc_from, arc_to, arc_piece = [], [], []
        live = np.flatnonzero(m.char_piece[chars] >= 0)
        h, k = np.zeros(len(live), np.uint64), 0
        while len(live):
            h = h * _BASE + chars[live + k].astype(np.uint64)
            spot = np.minimum(np.searchsorted(m.node_keys, h), len(m.node_keys) - 1)
            alive = m.node_keys[spot] == h
            live, h, piece = live[alive], h[alive], m.node_piece[spot[alive]]
            k += 1
            is_piece = piece >= 0
            arc_from.append(live[is_piece])
            arc_to.append(live[is_piece] + k)
            arc_piece.append(piece[is_piece])
            inside = live + k < end[live]
            live, h = live[inside], h[inside]
        a_from, a_to, a_piece = np.concatenate(arc_from or [np.zeros(0, int)]), np.concatenate(arc_to or [np.zeros(0, int)]), np.concatenate(arc_piece or [np.zeros(0, int)])
        # shortest paths: all strings step from state to state together
        step = a_to - first[a_to - 1]
        by = np.argsort(step, kind="stable")
        a_from, a_to, a_piece, step = a_from[by], a_to[by], a_piece[by], step[by]
        last, back = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(step)) + 1, [len(step)]])
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            f, t, p = a_from[x:y], a_to[x:y], a_piece[x:y]
            before = last[f]
            at_cut = cut[f]
            ok = at_cut.copy()
            check = np.flatnonzero(~at_cut & (before >= 0))
            ok[check] = self.free(before[check], p[check])
            last[t[ok]], back[t[ok]] = p[ok], f[ok]
        # walk back from every cut
        states = ahead[ahead > 0]
        known = m.char_piece[chars] >= 0
        at, got = [], []
        states = states[known[states - 1]]
        while len(states):
            at.append(back[states])
            got.append(last[states])
            states = back[states]
            states = states[~cut[states]]
        at, got = np.concatenate(at or [np.zeros(0, int)]), np.concatenate(got or [np.zeros(0, int)])
        return at, m.ids[got]

    def of_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word; a word has its space in front, and a run of spaces or a line end is a word of its own."""
        m = self.m
        out: list = [None] * len(words)
        plain = []
        for i, w in enumerate(words):
            if "  " in w or SPACE in w:
                ids: list[int] = []
                for s in _merged(list(w.replace(" ", SPACE)), m.score):
                    ids += [m.id_of[s]] if s in m.id_of else m.byte_ids[list(s.encode())].tolist()
                out[i] = ids
            else:
                plain.append(i)
        if not plain:
            return out
        joined = "".join(words[i] for i in plain)
        points = np.frombuffer(joined.replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        spot = np.minimum(np.searchsorted(m.chars, points), len(m.chars) - 1)
        chars = np.where(m.chars[spot] == points, spot + 1, 0)
        sizes = np.array([len(words[i]) for i in plain])
        starts = np.cumsum(sizes) - sizes
        at, ids = self.paths(chars, starts)
        unknown = np.flatnonzero(m.char_piece[chars] < 0)
        spelled = [chr(c).encode("utf-8", "surrogatepass") for c in points[unknown].tolist()]
        counts = np.array([len(s) for s in spelled], np.int64)
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.concatenate([at, np.repeat(unknown, counts)])
        ids = np.concatenate([ids, m.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]])
        order = np.lexsort((np.concatenate([np.zeros(len(at) - len(nth), np.int64), nth]), at))
        at, ids = at[order], ids[order]
        bounds = np.searchsorted(at, np.append(starts, len(points)))
        ids = ids.tolist()
        for i, a, b in zip(plain, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = ids[a:b]
        return out

    def trim(self) -> None:
        kept = np.flatnonzero(self.used > 1)
        if len(kept) > REMEMBERED // 2:
            kept = kept[:0]
        keys, sizes = list(self.index), np.diff(self.at)[kept]
        self.flat = gathered(self.flat, self.at, kept)
        self.index = Numbered((keys[k], i) for i, k in enumerate(kept.tolist()))
        self.at, self.used = np.concatenate([[0], np.cumsum(sizes)]), np.zeros(len(kept), np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and each text's number of ids."""
        if len(self.index) > REMEMBERED:
            self.trim()
        words: list[str] = []
        ends = []
        for t in texts:
            if t:
                t = " " + t
                if "  " in t or SPACE in t or "\0" in t:
                    words += _RUNS.findall(t)
                else:
                    words += [w for w in t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if w]
            ends.append(len(words))
        which = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if new := self.index.new:
            for k in range(0, len(new), 20_000):
                ids = self.of_words(new[k : k + 20_000])
                sizes = [len(x) for x in ids]
                self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
                self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int32, sum(sizes))])
            self.index.new = []
        seen = np.bincount(which, minlength=len(self.at) - 1)
        seen[: len(self.used)] += self.used
        self.used = seen
        sizes = np.concatenate([[0], np.cumsum((self.at[1:] - self.at[:-1])[which])])
        return gathered(self.flat, self.at, which), np.diff(sizes[np.array(ends, np.int64)], prepend=0)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of one document's ids, without the space that the normaliser put before it."""
        out = gathered(self.m.bytes_flat, self.m.bytes_at, ids.astype(np.int64)).tobytes()
        return out[1:] if out[:1] == b" " else out


def _encoded(machine: Machine, column: pa.Array, transducer: Transducer) -> Iterator[tuple[np.ndarray, bytes]]:
    """(ids, raw text) of each value, some megabytes of text at a time."""
    raw, at, _ = utf8(column)
    whole = raw.tobytes()
    n, k = len(at) - 1, 0
    while k < n:
        j = max(k + 1, int(np.searchsorted(at, at[k] + (4 << 20), side="right")) - 1)
        own = [whole[at[i] : at[i + 1]] for i in range(k, j)]
        ids, sizes = transducer.encode([t.decode() for t in own])
        ends = np.cumsum(sizes)
        for t, a, b in zip(own, (ends - sizes).tolist(), ends.tolist(), strict=True):
            yield ids[a:b], t
        k = j


def encode(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, n_tokens, ids_crc32 (of uint32 little-endian ids), decoded_crc32 (of the decoded UTF-8), round_trip."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(compile_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = Transducer(sent.value)
        for b in batches:
            n, crc, back, same = [], [], [], []
            for ids, t in _encoded(sent.value, b.column(1), transducer):
                decoded = transducer.decode(ids)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                back.append(zlib.crc32(decoded))
                same.append(decoded == t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.int64()), pa.array(same, pa.bool_())], [key, "n_tokens", "ids_crc32", "decoded_crc32", "round_trip"])

    return bounded_batches(docs).select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean")


def with_tokens(docs: DataFrame, model: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """The rows with their ids as array<int>; texts are what the ids decode to. A table that has the ids' column gets one named with `_` after it."""
    from pyspark.sql import types as T

    ids = unused(docs, ids)

    sent = docs.sparkSession.sparkContext.broadcast(compile_model(model))
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = Transducer(sent.value)
        for b in batches:
            where = b.schema.get_field_index(text)
            found = [(x, transducer.decode(x)) for x, _ in _encoded(sent.value, b.column(where), transducer)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x, _ in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x for x, _ in found]).astype(np.int32) if found else [], pa.int32()))
            columns = [*b.columns, lists]
            nulls = b.column(where).is_null().to_pylist()
            columns[where] = pa.array([None if z else t.decode("utf-8", "replace") for (_, t), z in zip(found, nulls, strict=True)], b.column(where).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return bounded_batches(docs).mapInArrow(run, schema)
