"""Source divergence audit: which sources of a language use its terms unlike the others, by inclusion-exclusion over supports.

Every group (language, source) and every language gives each of its V kept terms a scaled probability
p = 1 + floor(SCALE * (n + 1) / (N + V)). The divergence of p from q is the sum over all kept terms of
floor((p - q)^2 / q). It is never taken term by term over the vocabulary: with p0 and q0 for a count of 0,

    sum f(p, q) = (V - |P| - |Q|) f(p0, q0) + sum over P of f(p, q0) + sum over Q of f(p0, q)
                  + sum over P and Q of (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))

where P and Q are the terms that occur in either group. The first term is a constant, the sums over P and Q need only
how many terms have each count, and the last one only terms that both groups have. Tasks count words in dictionaries;
the rest is exact integer arithmetic on built-in columns: the quotients are long divisions in steps of 1000, so N + V may
reach 9 * 10^15.

Cases: null text, language and source count as ''; an empty text gives its group no term, but the group is there; a
language without kept terms gives pairs of value 0 and no terms; repeated rows count as often as they occur; equal
values are ranked by the item's UTF-8 bytes; a text may have any length; other columns are not looked at; an empty
table gives no rows. A source alone in its language gives no pairs.

Scale: counts are summed before they are shuffled. A kept term's row lists its sources, as many as the result has
groups, and pairs of sources are what is asked for. The table of group sizes is stored, so joins with it are broadcast
only below the session's threshold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, bounded_batches, stored, texts, tidy

#: Words as UTF-8: runs of ASCII letters and of bytes of other characters; and what ends one.
_WORD, _BREAK = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of a text searched at a time; terms that a task holds before it passes their counts on.
PIECE, HELD = 1 << 20, 1 << 18
#: Probabilities are in units of one in SCALE.
SCALE = 1_000_000_000
#: Documents of a language that a kept term is in, at least.
LEAST_DOCS = 3
#: Terms reported per group.
TOP_TERMS = 200


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def probability(n: Column, mass: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / mass), for n + 1 <= mass, by long division in three steps of 1000."""
    rest, found = n + 1, F.lit(0).cast("long")
    for _ in range(3):
        found = found * 1000 + _div(rest * 1000, mass)
        rest = (rest * 1000) % mass
    return found + 1


def priced(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """A lower-cased text's words, from pieces of about PIECE bytes that cut no word."""
    at = 0
    while at < len(text):
        end = _BREAK.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = end.start() if end else len(text)
        yield _WORD.findall(text, at, end)
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), counted in each task first: a group's term may have several rows."""

    def emptied(held: dict) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), (n, seen) in held.items():
            for column, values in zip(columns, ([lang] * len(n), [source] * len(n), n.keys(), n.values(), map(seen.__getitem__, n)), strict=True):
                column.extend(values)
        held.clear()
        kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for lang, source, text in zip(*(texts(c) for c in batch.columns), strict=True):
                n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                own: set = set()
                for words in words_of(text.translate(LOWER)):
                    n.update(words)
                    own.update(words)
                seen.update(own)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield emptied(held)
        yield emptied(held)

    rows = bounded_batches(docs).select("lang", "source", "text").mapInArrow(tidy(count), "lang binary, source binary, term binary, n long, docs long")
    return rows.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")], "n", "docs")


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, posts): the kept terms with the sources that have them, as (source, n)."""
    counts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("posts"))
    return terms.where(F.col("docs") >= least_docs).drop("docs")


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, mass, support, zero, terms): N + V, terms with a count, the probability of a count of 0, V."""
    sums = kept.select("lang", F.inline("posts")).groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("support"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    all_of = docs.select("lang", "source").distinct().join(vocabulary, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["terms", "n", "support"])
    mass = F.col("n") + F.col("terms")
    zero = F.when(mass > 0, probability(F.lit(0).cast("long"), mass)).otherwise(F.lit(1).cast("long"))
    return all_of.select("lang", "source", mass.alias("mass"), "support", zero.alias("zero"), "terms")


def _named(sizes: DataFrame, prefix: str) -> DataFrame:
    return sizes.select("lang", *[F.col(c).alias(f"{prefix}_{c}") for c in ("source", "mass", "support", "zero", "terms")])


def pair_values(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of a language's groups."""
    a, b = _named(sizes, "a"), _named(sizes, "b")
    c = F.col
    zeros = priced(c("a_zero"), c("b_zero"))
    constants = a.join(b, "lang").where("a_source <> b_source")
    neither = F.when(c("a_terms") > 0, (c("a_terms") - c("a_support") - c("b_support")) * zeros).otherwise(F.lit(0).cast("long"))
    parts = [constants.select("lang", c("a_source").alias("source"), c("b_source").alias("item"), neither.alias("value"))]

    def both_ways(rows: DataFrame, ab: Column, ba: Column) -> None:
        sums = rows.groupBy("lang", "a_source", "b_source").agg(F.sum(ab).alias("ab"), F.sum(ba).alias("ba"))
        one = lambda source, item, value: F.struct(c(source).alias("source"), c(item).alias("item"), c(value).alias("value"))
        parts.append(sums.select("lang", F.inline(F.array(one("a_source", "b_source", "ab"), one("b_source", "a_source", "ba")))))

    # one-sided terms: how many terms of a group have each count, against the other group's zero
    histogram = kept.select("lang", F.inline("posts")).groupBy("lang", c("source").alias("a_source"), "n").agg(F.count("*").alias("of"))
    sided = histogram.join(a, ["lang", "a_source"]).withColumn("p", probability(c("n"), c("a_mass"))).join(b, "lang").where("a_source <> b_source")
    both_ways(sided, c("of") * priced(c("p"), c("b_zero")), c("of") * priced(c("b_zero"), c("p")))

    # terms of both groups: the postings of a term meet, each two sources once
    left = kept.select("lang", "posts", F.explode("posts").alias("x")).select("lang", "posts", c("x.source").alias("a_source"), c("x.n").alias("n"))
    left = left.join(a, ["lang", "a_source"]).select("lang", "posts", "a_source", "a_zero", probability(c("n"), c("a_mass")).alias("p"))
    met = left.select("lang", "a_source", "a_zero", "p", F.explode("posts").alias("y")).where("a_source < y.source")
    met = met.select("lang", "a_source", "a_zero", "p", c("y.source").alias("b_source"), c("y.n").alias("n")).join(b, ["lang", "b_source"]).withColumn("q", probability(c("n"), c("b_mass")))
    one = lambda p, q, p0, q0: priced(p, q) - priced(p, q0) - priced(p0, q) + priced(p0, q0)
    both_ways(met, one(c("p"), c("q"), c("a_zero"), c("b_zero")), one(c("q"), c("p"), c("b_zero"), c("a_zero")))

    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value) of terms that a group has, and has more than its language."""
    whole = kept.groupBy("lang").agg((F.sum("total") + F.count("*")).alias("lang_mass"))
    rows = kept.select("lang", F.col("term").alias("item"), "total", F.inline("posts")).join(sizes.select("lang", "source", "mass"), ["lang", "source"]).join(stored(whole), "lang")
    p, q = probability(F.col("n"), F.col("mass")), probability(F.col("total"), F.col("lang_mass"))
    rows = rows.select("lang", "source", "item", p.alias("p"), q.alias("q")).where("p > q")
    return rows.select("lang", "source", "item", priced(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of a group's language, and its foremost terms."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    docs = docs.select(blank("lang"), blank("source"), blank("text"))
    kept = stored(kept_terms(docs, least_docs))
    sizes = stored(group_sizes(docs, kept))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = ranked(term_values(kept, sizes), "term").where(F.col("rank") <= top_terms)
    return ranked(pair_values(kept, sizes), "pair").unionByName(terms)
