import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence


def brute(rows, least=3, top=200):
    """The contract, term by term over the whole vocabulary, in Python's integers."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang, source].update(words)
        docs[lang].update(set(words))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in docs.items()}
    out = []

    def scaled(counts, terms):
        mass = sum(counts[t] for t in terms) + len(terms)
        return {t: 1 + 10**9 * (counts[t] + 1) // mass for t in terms}

    f = lambda p, q: (p - q) ** 2 // q
    for lang, source in groups:
        terms = kept[lang]
        p = scaled(groups[lang, source], terms)
        whole = scaled(sum((c for (k, _), c in groups.items() if k == lang), Counter()), terms)
        pairs = []
        for k, other in groups:
            if k == lang and other != source:
                q = scaled(groups[k, other], terms)
                pairs.append((sum(f(p[t], q[t]) for t in terms), other))
        found = [(f(p[t], whole[t]), t) for t in terms if groups[lang, source][t] and p[t] > whole[t]]
        for part, items in (("pair", pairs), ("term", found)):
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


ODD = [
    ("The cat sat on the mat", "en", "a"), ("the cat, THE dog; the bird", "en", "b"), ("a cat and a dog", "en", "c"), (None, "en", "d"), ("", "en", "a"),
    ("The cat sat on the mat", "en", "a"), ("ÉTÉ été Été straße", None, None), ("ÉTÉ été", None, "x"), ("été", "", "x"), ("12 34 !?", "xx", "only"), ("alone", "yy", "p"), ("alone", "yy", "q"),
    ("cat dog " * 40_000, "en", "b"), ("日本 語 日本", "en", "日"), ("日本", "en", "~"), ("日本", "en", "日"),
]


def test_odd_rows_equal_brute_force(spark):
    docs = spark.createDataFrame([(*r, "z", 0) for r in ODD], "text string, lang string, source string, term string, value int")
    found = rows_of(divergence.audit(docs))
    assert found == brute(ODD)
    assert {x[:2] for x in found} >= {("en", "d"), ("yy", "p")} and ("xx", "only") not in {x[:2] for x in found}
    assert ("yy", "p", "pair", "q", 0, 1) in found  # no kept term: the pair is there, of value 0


def test_ties_and_the_term_limit(spark):
    rows = [(" ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)), "en", "a")] * 3 + [("other words here", "en", "b")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    found = rows_of(divergence.audit(docs))
    assert found == brute(rows)
    assert sum(x[1:3] == ("a", "term") for x in found) == 200
    assert divergence.audit(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n, mass", [(0, 1), (0, 7), (6, 7), (10**12, 3 * 10**12 + 7), (9 * 10**14, 9 * 10**15 - 1), (123_456_789, 987_654_321)])
def test_probability_is_exact(spark, n, mass):
    found = spark.range(1).select(divergence.probability(F.lit(n).cast("long"), F.lit(mass).cast("long"))).first()[0]
    assert found == 1 + 10**9 * (n + 1) // mass
