"""Scalar functions over texts and numbers, all built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column, places: int) -> Column:
    """Halves go up, as floor(x + 0.5) does."""
    scale = float(10**places)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _folded() -> dict[str, str]:
    """Letters below U+2000 that are a letter with marks, and that letter."""
    out = {}
    for c in map(chr, range(0xC0, 0x2000)):
        first, *marks = unicodedata.normalize("NFD", c)
        if marks and unicodedata.category(first)[0] in "LN" and all(unicodedata.combining(m) for m in marks):
            out[c] = first
    return out


_FOLDED = _folded()


def index_terms(text: Column) -> Column:
    """Terms of the full-text index: without diacritics, in lower case, split at anything but letters and digits."""
    plain = F.regexp_replace(F.translate(text, "".join(_FOLDED), "".join(_FOLDED.values())), r"[\x{300}-\x{36F}]+", "")
    return F.regexp_extract_all(F.lower(F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the length in UTF-16 units, rounded up."""
    return F.ceil(F.octet_length(F.encode(text, "UTF-16BE")) / 2 / 4)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def fingerprint(text: Column) -> Column:
    """Lower-cased ASCII letters and digits with single blanks, without frontmatter and a first heading; equal ones are duplicates."""
    rest = F.regexp_replace(F.regexp_replace(F.lower(text), r"(?s)^---.*?---\s*", ""), r"^# [^\n]*\n+", "")
    return F.trim(F.regexp_replace(rest, r"[^a-z0-9]+", " "))


def days_between(ts: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400_000_000.0))


def counted(words: Column) -> Column:
    """(terms, squares): how many distinct words there are, and the sum of the squares of their counts.

    Equal words lie together when sorted, and the nth of them adds 2 n - 1.
    """
    state = lambda word, run, terms_of, squares: F.struct(word.alias("word"), run.alias("run"), terms_of.alias("terms"), squares.alias("squares"))

    def step(a: Column, w: Column) -> Column:
        same = a["word"] == w
        run = F.when(same, a["run"] + 1).otherwise(F.lit(1).cast("long"))
        return state(w, run, F.when(same, a["terms"]).otherwise(a["terms"] + 1), a["squares"] + 2 * run - 1)

    zero = F.lit(0).cast("long")
    return F.aggregate(F.sort_array(words), state(F.lit(""), zero, zero, zero), step, lambda a: F.struct(a["terms"].alias("terms"), a["squares"].alias("squares")))


def vector_norm(words: Column) -> Column:
    """The length of the vector of term counts."""
    return F.sqrt(counted(words)["squares"])
