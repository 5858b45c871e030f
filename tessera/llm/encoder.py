"""Token ids of texts by a tokenizers file, each distinct piece of text encoded once by the library and remembered.

A file whose normaliser is NFC, white space to blanks, lower case, and whose pre-tokens are contractions, runs of letters,
single digits and runs of the rest, encodes texts by pieces: texts are cut at ASCII white space and where ASCII letters,
digits and punctuation meet. No pre-token, composed character or special token crosses such a cut (apostrophes and
bytes beyond ASCII are never cut off), and A-Z may be lower-cased before. Texts that hold a special token, and all
texts of any other file, go to the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np

from .common import LOWER, _powers, _VALUE, gathered, mixed, MIX

#: Distinct pieces that a worker remembers; bytes of text that pieces are looked for in at a time.
REMEMBERED, BLOCK = 2_000_000, 1 << 20
#: The normaliser and pre-tokenizer under which texts may be cut.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}


def _classes() -> np.ndarray:
    """Of each byte: 0 white space, 1 ASCII letter, 2 digit, 3 punctuation, 4 what is never cut off."""
    out = np.full(256, 4, np.uint8)
    for c in range(33, 127):
        out[c] = 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 4 if c == 39 else 3
    out[[9, 10, 11, 12, 13, 32]] = 0
    return out


def _shown() -> dict[int, int]:
    """The character that byte-level models write for a byte: itself if it is printable in Latin-1, else the next one from U+0100 on."""
    hidden = [c for c in range(256) if c < 33 or 127 <= c < 161 or c == 173]
    return {c: 256 + k for k, c in enumerate(hidden)}


_CLASS = _classes()
_SHOWN = _shown()
_ENCODERS: dict[str, Encoder] = {}


def pieces_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each piece of texts that lie one after another; each text's first piece."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(at), np.int64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[:n], out=sums[1:])
    kind = _CLASS[raw]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    edge[1:n] |= (kind[1:] != kind[:-1]) & ((kind[1:] < 4) & (kind[:-1] < 4) | (kind[1:] == 0) | (kind[:-1] == 0))
    word = kind > 0
    start, end = np.flatnonzero(word & edge[:n]), np.flatnonzero(word & edge[1:]) + 1
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * MIX), start, end, np.searchsorted(start, at)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        normal, pre = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
        split = (pre.get("pretokenizers") or [{}])[0]
        self.cuts = (
            normal.get("normalizers") == _NORMALIZER and split.get("type") == "Split" and split.get("pattern") == _PATTERN and split.get("behavior") == "Removed" and split.get("invert") is True
            and not file["model"].get("dropout") and [p.get("type") for p in pre["pretokenizers"][1:]] == ["ByteLevel"] and not pre["pretokenizers"][1].get("add_prefix_space") and not pre["pretokenizers"][1].get("use_regex")
        )
        self.special = [t["content"].encode().translate(LOWER) for t in file.get("added_tokens", ())]
        self.forget()

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """This worker's encoder: what one task has met serves the next one."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def forget(self) -> None:
        self.known, self.row = np.full(1, ~np.uint64(0)), np.zeros(1, np.int64)
        self.flat, self.at, self.used = np.zeros(0, np.uint32), np.zeros(2, np.int64), np.zeros(1, np.int64)

    def trim(self) -> None:
        """Forgets pieces that were in one block only; all, if that is not enough."""
        keep = self.used[self.row] > 1
        keep[-1] = True
        if keep.sum() > REMEMBERED // 2:
            return self.forget()
        rows = self.row[keep]
        sizes = np.diff(self.at)[rows]
        self.flat, self.at = gathered(self.flat, self.at, rows), np.concatenate([[0], np.cumsum(sizes)])
        self.known, self.row, self.used = self.known[keep], np.arange(len(rows)), np.zeros(len(rows), np.int64)
        return None

    def _rows(self, raw: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The remembered row of each piece; new pieces are encoded by the library."""
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.trim()
        spot = np.searchsorted(self.known, distinct)
        new = np.flatnonzero(self.known[spot] != distinct)
        if len(new):
            lower = raw.tobytes().translate(LOWER)
            ids = self._encoded([lower[x:y].decode() for x, y in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
            rows = len(self.at) - 1 + np.arange(len(new))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in ids])])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32)])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
            self.known, self.row = np.insert(self.known, spot[new], distinct[new]), np.insert(self.row, spot[new], rows)
            spot = np.searchsorted(self.known, distinct)
        rows = self.row[spot]
        self.used[rows] += 1
        return rows[which]

    def _encoded(self, pieces: list[str]) -> list[list[int]]:
        """The library's ids of new pieces. Of letters below U+0300 the normaliser only lower-cases, and a run of them is one pre-token: its bytes go to the model."""
        out: list[list[int] | None] = []
        for piece in pieces:
            word = piece if piece.isascii() else piece.lower()
            if not word.isalpha():
                out.append(None)
            elif word.isascii():
                out.append([t.id for t in self.model.tokenize(word)])
            elif max(word) < "\u0300":
                out.append([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_SHOWN))])
            else:
                out.append(None)
        others = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(others, self.tokenizer.encode_batch_fast([pieces[i] for i in others], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _whole(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which texts the library must see whole."""
        odd = np.full(len(at) - 1, not self.cuts)
        if self.cuts and self.special:
            lower = raw.tobytes().translate(LOWER)
            for mark in self.special:
                x = lower.find(mark)
                while x >= 0:
                    odd[min(int(np.searchsorted(at, x, side="right")) - 1, len(odd) - 1)] = True
                    x = lower.find(mark, x + 1)
        return odd

    def _blocks(self, raw: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
        """(first text, text after the last, pieces' starts, each text's first piece, rows, None), or (text, next, ..., ids) of a text that the library saw whole."""
        n, k = len(at) - 1, 0
        odd = self._whole(raw, at)
        while k < n:
            if odd[k]:
                own = self.tokenizer.encode(raw[at[k] : at[k + 1]].tobytes().decode(), add_special_tokens=False).ids
                yield k, k + 1, None, None, None, np.array(own, np.uint32)
                k += 1
                continue
            j = max(k + 1, int(np.searchsorted(at, at[k] + BLOCK, side="right")) - 1)
            if odd[k:j].any():
                j = k + int(odd[k:j].argmax())
            block = raw[at[k] : at[j]]
            hashes, start, end, first = pieces_of(block, at[k : j + 1] - at[k])
            yield k, j, start, first, self._rows(block, hashes, start, end), None
            k = j

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts that lie one after another, and each text's number of ids."""
        found, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for _, _, _, first, rows, own in self._blocks(raw, at):
            if own is not None:
                found.append(own)
                sizes.append(np.array([len(own)], np.int64))
                continue
            total = np.concatenate([[0], np.cumsum(self.at[rows + 1] - self.at[rows])])
            sizes.append(np.diff(total[first]))
            found.append(gathered(self.flat, self.at, rows))
        return np.concatenate(found), np.concatenate(sizes)

    def measured(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and number of ids of each piece of texts that lie one after another, and each text's first piece (n + 1)."""
        starts, counts, firsts, total = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0
        for k, _, start, first, rows, own in self._blocks(raw, at):
            if own is not None:
                start, first, n = np.zeros(1, np.int64), np.array([0, 1]), np.array([len(own)], np.int64)
            else:
                n = self.at[rows + 1] - self.at[rows]
            starts.append(start + at[k])
            counts.append(n)
            firsts.append(first[1:] + total)
            total += len(start)
        return np.concatenate(starts), np.concatenate(counts), np.concatenate(firsts)
