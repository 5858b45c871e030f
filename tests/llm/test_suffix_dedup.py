"""Numbers of a part's contexts when its rows come in another order, as a second read of a shuffle may bring them."""

import random

import numpy as np
import pyarrow as pa

from tessera.llm import suffix_dedup


def part(rows):
    keys, texts = zip(*rows, strict=True)
    return suffix_dedup._Part(pa.table({"__key": pa.array(keys, pa.int64()), "text": pa.array(texts, pa.string())}), "text", suffix_dedup.SIZE)


def strings(p, picked, which):
    """(text, place in it) of each run with its context's number."""
    doc, start, _, _ = p.runs
    whole = p.raw.tobytes()
    return sorted((whole[p.at[d] : p.at[d + 1]], int(s - p.at[d]), int(w)) for d, s, w in zip(doc[picked], start[picked], which, strict=True))


def test_contexts_keep_their_numbers_when_rows_are_shuffled():
    rng = random.Random(5)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [line(120) for _ in range(6)]
    rows = [(k, line(90) + rng.choice(shared) + line(70) + rng.choice(shared)) for k in range(40)]
    rows += [(3, rows[9][1]), (50, rows[2][1]), (2, rows[2][1]), (60, "ab" * 400), (61, ""), (62, "short")]
    first = part(rows)
    flagged = first.anchors()[::3]
    picked, which, found, of, least = first.contexts(flagged)
    assert len(found) > 50
    for _ in range(5):
        again = rng.sample(rows, len(rows))
        second = part(again)
        picked2, which2, found2, of2, least2 = second.contexts(flagged)
        assert found2 == found
        assert np.array_equal(of2, of) and np.array_equal(least2, least)
        assert strings(second, picked2, which2) == strings(first, picked, which)
