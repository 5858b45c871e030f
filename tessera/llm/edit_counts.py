"""Token counts that follow edits: a segment tree per document over its pre-tokens.

A leaf is a piece of text whose encoding does not depend on its neighbours (what the tokenizer's pre-tokens cannot cross
on either side), with the white space after it; the tree's nodes hold the sums of characters, bytes and tokens below
them. An edit replaces a range of characters. Positions are found by descent. The leaf of the character before the
range and that of the character after it are the boundary context: they are encoded again with the new text between
them, the leaves in the range become empty, and only the sums above these are updated. What comes of the region stays in
the first of its leaves: as a plain leaf while it has at most LEAF pieces, else as a tree of its own; a tree that nests
deeper than DEPTH is laid out anew. Rounds of edits of many documents are encoded together.

A text that holds a special token of the tokenizer is one leaf, and so is every text of a tokenizer that encoder.py does
not cut.

Cases: a null or empty text has one empty leaf and no tokens; null or empty edit lists change nothing; a null edit
changes nothing but counts; ranges are cut to the text, and a range that ends before it starts is an insertion at its
start; edits apply one after another, each to the text as the ones before left it; very long texts, ties and repeated
rows are nothing special, null keys are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, bounded_batches, utf8
from .encoder import Encoder

#: Pieces that an edited leaf holds; trees within trees; bytes of text whose trees are held at a time.
LEAF, DEPTH, HELD = 24, 16, 2 << 20


def _cut(text: bytes, character: int) -> int:
    """The byte position of a character position."""
    return character if text.isascii() else len(text.decode()[:character].encode())


class CountTree:
    """Sums (characters, bytes, tokens) over the leaves of a text, in a heap of nodes."""

    def __init__(self, raw: bytes, edges: np.ndarray, sums: np.ndarray):
        self.raw, self.edges, self.n = raw, edges, len(sums)
        self.changed: dict[int, bytes | CountTree] = {}
        self.width = 1 << (self.n - 1).bit_length()
        self.node = np.zeros((2 * self.width, 3), np.int64)
        self.node[self.width : self.width + self.n] = sums
        level = self.width
        while level > 1:
            self.node[level // 2 : level] = self.node[level : 2 * level : 2] + self.node[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def total(self) -> tuple[int, int, int]:
        """Characters, bytes and tokens of the text."""
        return tuple(self.node[1].tolist())

    def leaf_at(self, character: int) -> tuple[int, int]:
        """The leaf that holds a character of the text, and its place there."""
        node, sums = 1, self.node
        while node < self.width:
            node *= 2
            left = int(sums[node, 0])
            if character >= left:
                character -= left
                node += 1
        return node - self.width, character

    def leaf(self, i: int) -> bytes:
        new = self.changed.get(i)
        if new is None:
            return self.raw[self.edges[i] : self.edges[i + 1]]
        return new if isinstance(new, bytes) else new.text()

    def text(self) -> bytes:
        out, at = [], 0
        for i in sorted(self.changed):  # what lies between changed leaves is as it was
            out.append(self.raw[self.edges[at] : self.edges[i]])
            out.append(self.leaf(i))
            at = i + 1
        return b"".join([*out, self.raw[self.edges[at] : self.edges[-1]]])

    def between(self, start: int, end: int) -> bytes:
        """The leaves that hold these characters, whole."""
        end = min(end, self.total[0])
        if start >= end:
            return b""
        first, last = self.leaf_at(start)[0], self.leaf_at(end - 1)[0]
        return b"".join(self.leaf(i) for i in range(first, last + 1))

    def _set(self, first: int, last: int, sums) -> None:
        """New sums of the leaves first..last - 1, and of the nodes above them."""
        x, y = self.width + first, self.width + last
        self.node[x:y] = sums
        while x > 1:
            x, y = x // 2, (y - 1) // 2 + 1
            self.node[x:y] = self.node[2 * x : 2 * y : 2] + self.node[2 * x + 1 : 2 * y : 2]

    def open(self, start: int, end: int, new: bytes) -> tuple[list[tuple[CountTree, int]], bytes]:
        """Takes out the range start..end: where what comes in its place goes (leaf in leaf), and the text to encode there."""
        path, tree = [], self
        while True:
            size = tree.total[0]
            home, a = tree.leaf_at(start - 1) if start else tree.leaf_at(0) if size else (0, 0)
            a += bool(start)
            last, b = tree.leaf_at(end) if end < size else (tree.n, 0)
            if last == home:
                end = b
            else:
                if last < tree.n:
                    rest = tree.leaf(last)
                    new += rest[_cut(rest, b) :]
                end = int(tree.node[tree.width + home, 0])
                stop = min(last + 1, tree.n)
                if stop > home + 1:
                    tree._set(home + 1, stop, 0)
                    for i in range(home + 1, stop):
                        tree.changed[i] = b""
            start = a
            path.append((tree, home))
            inner = tree.changed.get(home)
            if not isinstance(inner, CountTree):
                old = tree.leaf(home)
                return path, old[: _cut(old, start)] + new + old[_cut(old, end) :]
            tree = inner

    @staticmethod
    def close(path: list[tuple[CountTree, int]], region: bytes, edges: np.ndarray, sums: np.ndarray) -> None:
        """Puts a region into its leaf, and its sums into all nodes above."""
        tree, leaf = path[-1]
        tree.changed[leaf] = region if len(sums) <= LEAF else CountTree(region, edges, sums)
        own = sums.sum(0)
        for tree, leaf in reversed(path):
            tree._set(leaf, leaf + 1, own)
            own = tree.node[1]


def _leaves(encoder: Encoder, raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text: the edges of its leaves, from 0, and their sums."""
    start, tokens, first = encoder.measured(raw, at)
    characters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    for i, (x, y) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        edges = np.empty(max(1, y - x) + 1, np.int64)
        edges[0], edges[-1] = at[i], at[i + 1]
        edges[1:-1] = start[x + 1 : y]
        sums = np.zeros((len(edges) - 1, 3), np.int64)
        sums[:, 0], sums[:, 1] = np.diff(characters[edges]), np.diff(edges)
        if y > x:
            sums[:, 2] = tokens[x:y]
        yield edges - at[i], sums


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, and where each begins and ends."""
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])


def trees(encoder: Encoder, raw: np.ndarray, at: np.ndarray) -> list[CountTree]:
    """The tree of each text."""
    whole = raw.tobytes()
    return [CountTree(whole[x:y], *found) for x, y, found in zip(at[:-1].tolist(), at[1:].tolist(), _leaves(encoder, raw, at), strict=True)]


def apply_edits(encoder: Encoder, own: list[CountTree], edits: list[list]) -> list[int]:
    """Applies each text's edits (start, end, bytes), a round of all texts at a time; the bytes encoded again of each."""
    again = [0] * len(own)
    reach = max((len(m) for m in encoder.special), default=0)
    for turn in range(max(map(len, edits), default=0)):
        who, paths, regions, places = [], [], [], []
        for i, mine in enumerate(edits):
            if turn < len(mine) and mine[turn] is not None:
                size = own[i].total[0]
                start, end, new = mine[turn]
                start = min(max(0, start), size)
                path, region = own[i].open(start, min(max(start, end), size), new)
                who.append(i)
                paths.append(path)
                regions.append(region)
                places.append((start, start + len(new)))
        for i, path, region, place, found in zip(who, paths, regions, places, _leaves(encoder, *joined(regions)), strict=True):
            CountTree.close(path, region, *found)
            again[i] += len(region)
            near = own[i].between(max(0, place[0] - reach), place[1] + reach).translate(LOWER) if reach else b""
            if len(path) > DEPTH or any(m in near for m in encoder.special):
                text = own[i].text()
                own[i] = trees(encoder, *joined([text]))[0]
                again[i] += len(text)
    return again


def recount(docs: DataFrame, tokenizer: str, text: str = "text", edits: str = "edits", key: str = "doc_id") -> DataFrame:
    """Per document: key, n_tokens, n_edits, n_tokens_edited, bytes_edited, bytes_reencoded. Edits: array<struct<start, end, text>> in characters."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(tokenizer)
        for b in batches:
            raw, at, _ = utf8(b.column(1))
            changes = [[e and (e["start"] or 0, e["end"] or 0, (e["text"] or "").encode()) for e in mine or ()] for mine in b.column(2).to_pylist()]
            k, rows = 0, []
            while k < b.num_rows:
                j = max(k + 1, int(np.searchsorted(at, at[k] + HELD, side="right")) - 1)
                own = trees(encoder, raw[at[k] : at[j]], at[k : j + 1] - at[k])
                before = [t.total[2] for t in own]
                again = apply_edits(encoder, own, changes[k:j])
                rows += [(n, len(mine), t.total[2], t.total[1], m) for n, mine, t, m in zip(before, changes[k:j], own, again, strict=True)]
                k = j
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in columns]], [key, "n_tokens", "n_edits", "n_tokens_edited", "bytes_edited", "bytes_reencoded"])

    schema = f"`{key}` {kind}, n_tokens long, n_edits long, n_tokens_edited long, bytes_edited long, bytes_reencoded long"
    return bounded_batches(docs).select(key, text, edits).mapInArrow(run, schema)
