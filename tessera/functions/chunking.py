"""Splitting of sections that are too long, as folds of built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space here, and ends of sentences.
BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in BLANKS) + "]"
SENTENCE_ENDS = ".!?。！？"
#: Characters that stand for a token.
TOKEN_CHARS = 4


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def units16(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def packed(units: Column, most: int, overlong: Callable[[Column], Column]) -> Column:
    """Units one after another, as many to a piece as fit `most`; a longer unit is cut up by `overlong` on its own.

    Pieces are trimmed, and one that is blank is dropped. The fold holds the finished pieces, the open one, its length
    and whether it has anything but blanks.
    """

    def flushed(a: Column) -> Column:
        return F.when(a["solid"], F.concat(a["pieces"], F.array(trimmed(a["current"])))).otherwise(a["pieces"])

    def state(pieces: Column, current: Column, size: Column, solid: Column) -> Column:
        return F.struct(pieces.alias("pieces"), current.alias("current"), size.alias("size"), solid.alias("solid"))

    def step(a: Column, u: Column) -> Column:
        text, size, solid = u["text"], u["size"], u["solid"]
        alone = state(F.concat(flushed(a), overlong(text)), F.when(a["solid"], "").otherwise(a["current"]), F.when(a["solid"], 0).otherwise(a["size"]), F.lit(False))
        full = (a["size"] + size > most) & a["solid"]
        return F.when(size > most, alone).when(full, state(flushed(a), text, size, solid)).otherwise(state(a["pieces"], F.concat(a["current"], text), a["size"] + size, a["solid"] | solid))

    sized = F.transform(units, lambda x: F.struct(x.alias("text"), units16(x).alias("size"), (trimmed(x) != "").alias("solid")))
    start = state(F.array().cast("array<string>"), F.lit(""), F.lit(0), F.lit(False))
    return F.aggregate(sized, start, step, flushed)


def words(text: Column, most: int) -> Column:
    """Pieces of words and the blanks between them; a longer word is cut every `most` characters.

    Where no word or run of blanks comes near half of `most` and all characters are single UTF-16 units, a pattern takes the
    longest stretch that ends at a word's edge, again and again, which is what the fold over words gives.
    """
    solid = f"[^{SPACE[1:-1]}]"
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.char_length(w) - 1) / most).cast("int")), lambda k: F.substring(w, k * most + 1, F.lit(most)))
    folded = packed(F.regexp_extract_all(text, F.lit(f"{SPACE}+|{solid}+"), F.lit(0)), most, cut)
    edge = f"(?:(?<={SPACE})(?={solid})|(?<={solid})(?={SPACE})|\\z)"
    stretches = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{most}}}{edge}"), F.lit(0)), lambda p: trimmed(p))
    half = most // 2  # of characters without a space a word is a part; classes of all blanks are slow over every word
    plain = (units16(text) == F.char_length(text)) & ~text.rlike(f"[^ ]{{{half}}}") & ~text.rlike(f"{SPACE}{{{min(half, 64)}}}") if half else F.lit(False)
    return F.when(plain, F.filter(stretches, lambda p: p != "")).otherwise(folded)


def pieces(text: Column, max_tokens: int) -> Column:
    """A section's text whole if it fits, else in pieces: by paragraphs, without these by sentences, without those by words.

    The blank lines between paragraphs are units of their own; the blanks between sentences are lost.
    """
    most = max_tokens * TOKEN_CHARS
    paragraphs = F.split(text, r"(?<=\n\n)(?!\n)|(?<!\n)(?=\n\n)")
    sentences = F.split(text, rf"(?<=[{SENTENCE_ENDS}]){SPACE}+")
    units = F.filter(F.when(F.contains(text, F.lit("\n\n")), paragraphs).otherwise(sentences), lambda u: u != "")
    many = let(units, lambda us: F.when(F.size(us) <= 1, words(text, most)).otherwise(packed(us, most, lambda u: words(u, most))))
    return F.when(units16(text) <= most, F.array(text)).otherwise(many)
