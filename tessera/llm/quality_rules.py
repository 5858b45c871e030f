"""Quality rules by repetition coverage: how much of a text lies in n-grams and lines that it has said before.

Words are `[^\\x20\\x09-\\x0D]+`, case kept. Texts are taken in blocks as raw bytes. Prefix sums of the bytes' values times
powers of an odd factor give the hash of any word or line; the same sums over words' hashes give a rolling hash of
every n-gram, for each length of LENGTHS and for 3. Sorted by text and hash, equal windows lie side by side; the words
below repeated ones are marked by a difference array, and their characters summed. Hashes are of 64 bits and are not
compared word by word.

A text is kept if it has MIN_WORDS words, at most half of them in 3-word windows found twice (`base_failed` otherwise),
and of its words' characters at most MOST[n] percent lie in n-grams met earlier in it, at most LINE_CHARS percent in
lines met earlier, and it has at most SYMBOLS symbols per hundred words. Percentages are compared in whole numbers.

Cases: a null or empty text has no words and fails; lines without a word are never repeated lines; a text of fewer words
than a window has none; each repeated row is judged by itself; a null doc_id stays null; other columns are ignored by
report() and kept by keep_good(); an empty table gives no rows. A text may have any length: bytes are hashed in pieces
of STEP, and what is held beside the text is a few bytes per byte of it and arrays over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import MIX, SPACES, bounded_batches, mixed, tidy, utf8

#: n-gram lengths whose repeated characters are measured, and the percentage of the words' characters allowed for each.
LENGTHS = (5, 7, 10)
MOST = {5: 15, 7: 13, 10: 10}
#: Percentage of the words' characters allowed in lines met before; symbols allowed per hundred words.
LINE_CHARS, SYMBOLS = 20, 10
#: The base rule: words needed, and the percentage of words allowed in repeated 3-word windows.
MIN_WORDS, BASE_WINDOW, BASE_MOST = 50, 3, 50
#: Bytes of text that one block holds, but for a longer text; bytes hashed at a time.
BLOCK, STEP = 1 << 22, 1 << 20

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[f"dup{n}_chars" for n in LENGTHS], "dup_line_chars"]

_FACTOR = 0x9FB21C651E98DF25
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * MIX)
_SPACE = np.isin(np.arange(256), list(SPACES))
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Hasher:
    """Hashes of spans of one array of values, from prefix sums taken piece by piece at the spans' ends only."""

    up, down = _powers(_FACTOR, STEP), _powers(_INVERSE, STEP)

    def __init__(self, values: np.ndarray, table: np.ndarray | None = None):
        self.values, self.table = values, table

    def _sums(self, at: np.ndarray) -> np.ndarray:
        """Prefix sums before each of the sorted positions."""
        out, carry, scale, far = np.zeros(len(at), np.uint64), 0, 1, pow(_FACTOR, STEP, 1 << 64)
        for k in range(0, len(self.values), STEP):
            piece = self.values[k : k + STEP]
            sums = np.cumsum((self.table[piece] if self.table is not None else piece) * self.up[: len(piece)], dtype=np.uint64)
            i, j = np.searchsorted(at, [k, k + len(piece)], side="right")
            out[i:j] = sums[at[i:j] - k - 1] * np.uint64(scale) + np.uint64(carry)
            carry = (carry + int(sums[-1]) * scale) % (1 << 64)
            scale = scale * far % (1 << 64)
        return out

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of values[start:end] for each pair of non-decreasing ends; equal content has equal hashes wherever it lies."""
        blocks = _powers(pow(_INVERSE, STEP, 1 << 64), len(self.values) // STEP + 1)
        back = self.down[start % STEP] * blocks[start // STEP]
        return mixed((self._sums(end) - self._sums(start)) * back + (end - start).astype(np.uint64) * MIX)


def repeats(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a key occurs again in its owner, and where it is one that occurs twice or more; in the given order."""
    own = key ^ mixed(owner.astype(np.uint64) * MIX + np.uint64(1))
    order = np.argsort(own, kind="stable")  # equal ones stay in their order
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = np.diff(own[order]) == 0
    again, twice = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order], twice[order] = same[:-1], same[:-1] | same[1:]
    return again, twice


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` places lie in a window of n that begins at one of the starts."""
    change = np.bincount(starts, minlength=size + n + 1) - np.bincount(starts + n, minlength=size + n + 1)
    return np.cumsum(change)[:size] > 0


def measure(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """COLUMNS of the texts raw[at[i]:at[i + 1]], one row each."""
    n_texts, n = len(at) - 1, len(raw)
    out = np.zeros((n_texts, len(COLUMNS)), np.int64)
    column = {name: k for k, name in enumerate(COLUMNS)}
    if not n:
        return out
    inside = np.zeros(n + 1, bool)
    inside[:-1] = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:]
    last = inside[:-1] & (~inside[1:] | edge[1:])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    del first, last
    chars_before = np.zeros(n + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=chars_before[1:])
    chars = chars_before[end] - chars_before[start]
    del chars_before
    owner = np.searchsorted(at, start, side="right") - 1
    add = lambda name, which, weights=None: out.__setitem__((slice(None), column[name]), np.bincount(which, weights, n_texts).astype(np.int64))
    add("n_words", owner)
    add("word_chars", owner, chars)
    add("n_symbols", np.searchsorted(at, np.flatnonzero(_SYMBOL[raw]), side="right") - 1)

    bytes_of = Hasher(raw, _VALUE)
    words = Hasher(bytes_of.spans(start, end))
    for length in (BASE_WINDOW, *LENGTHS):
        whole = np.flatnonzero(owner[length - 1 :] == owner[: len(owner) - length + 1]) if len(owner) >= length else np.zeros(0, np.int64)
        again, twice = repeats(owner[whole], words.spans(whole, whole + length))
        if length == BASE_WINDOW:
            under = covered(whole[twice], length, len(owner))
            add("n_repeat_words", owner[under])
        if length in MOST:
            under = covered(whole[again], length, len(owner))
            add(f"dup{length}_chars", owner[under], chars[under])

    breaks = np.flatnonzero(raw == 0x0A)
    line_start = np.unique(np.concatenate([at[:-1][at[:-1] < n], breaks[breaks + 1 < n] + 1]))
    # a line ends before its break or where its text ends
    line_end = np.append(line_start[1:], n)
    line_end = line_end - ((raw[line_end - 1] == 0x0A) & (line_end > line_start))
    line_of = np.searchsorted(line_start, start, side="right") - 1
    spoken = np.unique(line_of)
    lines_owner = np.searchsorted(at, line_start[spoken], side="right") - 1
    again, _ = repeats(lines_owner, bytes_of.spans(line_start[spoken], line_end[spoken]))
    add("n_dup_lines", lines_owner[again])
    repeated = np.isin(line_of, spoken[again])
    add("dup_line_chars", owner[repeated], chars[repeated])
    return out


def verdicts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept of measured rows."""
    of = lambda name: rows[:, COLUMNS.index(name)]
    failed = (of("n_words") < MIN_WORDS) | (100 * of("n_repeat_words") > BASE_MOST * of("n_words"))
    kept = ~failed & (100 * of("dup_line_chars") <= LINE_CHARS * of("word_chars")) & (100 * of("n_symbols") <= SYMBOLS * of("n_words"))
    for n, most in MOST.items():
        kept &= 100 * of(f"dup{n}_chars") <= most * of("word_chars")
    return failed, kept


def measured(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """measure() of an Arrow column, in blocks of about BLOCK bytes."""
    raw, at, _ = utf8(column)
    n, k, out = len(at) - 1, 0, []
    while k < n:
        j = max(k + 1, int(np.searchsorted(at, at[k] + BLOCK, side="right")) - 1)
        out.append(measure(raw[at[k] : at[j]], at[k : j + 1] - at[k]))
        k = j
    return np.concatenate(out) if out else np.zeros((0, len(COLUMNS)), np.int64)


def report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, COLUMNS, base_failed, kept) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    names = [key, *COLUMNS, "base_failed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = measured(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in rows.T], *[pa.array(v) for v in verdicts(rows)]], names)

    schema = f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, kept boolean"
    return bounded_batches(docs).select(key, text).mapInArrow(tidy(run), schema)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that the rules keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(verdicts(measured(b.column(b.schema.get_field_index(text))))[1]))

    return bounded_batches(docs).mapInArrow(tidy(run), docs.schema)
