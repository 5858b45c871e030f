"""Each stage of the pipeline against brute force on its own input."""

import corpus_pipeline
from tessera.llm import langid
from tessera.llm.queries import _fold, _tokenizer

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = langid.predict(docs, langid.fit(docs, ~_fold(4))).collect()
    good = {r["doc_id"] for r in found if r["lang_pred"] in corpus_pipeline.LANGUAGES}
    return [r for r in rows if r[0] in good]


def near_copies(rows):
    sets = {}
    for r in rows:
        w = "".join(c.lower() if c.isascii() else c for c in r[1] or "").replace("\x0b", " ").replace("\x0c", " ")
        w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        sets[r[0]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return [r for r in rows if top(r[0]) == r[0]]


def without_repeats(rows):
    first, out = {}, []
    for i, t, *rest in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        kept, at = [], 0
        for c in t or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        text = None if t is None else "".join(kept)
        out.append((i, text, *rest[:-1], None if text is None else len(text)))
    return out


def decontaminated(rows, items):
    from test_decontaminate import brute

    bad = {r[0] for r in brute([r[:2] for r in rows], items) if r[5]}
    return [r for r in rows if r[0] not in bad]


def encoded(rows):
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=_tokenizer("piece_bpe_32k.model"))
    return [(r[0], None if r[1] is None else p.decode(p.encode(r[1])), *r[2:], p.encode(r[1] or "")) for r in rows]


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_run_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    odd = [(9001, None, "en", "src1", None), (9002, "", None, None, 0), (9003, "12 / 34", "de", "src2", 7), (9004, "Yes.", "en", None, 4)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "suffix_dedup", "decontaminate", "sentencepiece"]
    one = language(spark, rows)
    assert one == [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    two = near_copies(one)
    three = without_repeats(two)
    four = decontaminated(three, items)
    assert len(rows) > len(one) > len(two) > len(four) > 0 and three != two
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == [*COLUMNS, "token_ids"]
    assert listed(found) == sorted(encoded(four), key=repr)


ODD = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size int, __gone int, __key string, __part int, __digest string, token_ids int, gone int"


def test_stages_on_odd_rows(spark):
    """Nulls, empty and letterless texts, equal keys, a very long text, an empty table, columns whose names the stages use."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the old house by the river "
    short = [(1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base + "again", None, None, None), (3, None, "en", "b", 0), (4, "", None, "b", 0), (None, "a text with a null key", "en", None, None), (5, "wort " * 30_000, "de", "c", 9), (6, "123 ?", "de", None, 5), (7, base, "en", None, 1)]
    rows = [(*r, "x", 1, 2, "y", 3, "z", 4, 5) for r in short]
    docs = spark.createDataFrame(rows, ODD)
    lettered = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    # rows of one key stay or go together; 2 is a near copy of 1
    unlike = [r for r in rows if r[0] not in (2, 7)]
    cut = {2: "again", 7: ""}
    wanted = {
        "language_id": lettered,
        "jaccard_join": unlike,
        "suffix_dedup": [(r[0], cut.get(r[0], r[1]), *r[2:4], None if r[1] is None else len(cut.get(r[0], r[1])), *r[5:]) for r in rows],
        "decontaminate": rows,
        "sentencepiece": encoded(rows),
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns
        assert name != "sentencepiece" or out.columns[-1] == "token_ids_"
        assert listed(out) == sorted(wanted[name], key=repr), name
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_the_network_removes_texts_of_other_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    other = [(10_000 + k, f"vjaku ozmi pketu zzuva hnoq {k} " + "yqaz ujvo kzmi xuwu qofz " * (3 + k % 5), "zz", "src1", 0) for k in range(60)]
    both = docs.unionByName(spark.createDataFrame(other, docs.schema))
    found = {r["doc_id"]: r["lang_pred"] for r in langid.predict(both, langid.fit(both, ~_fold(4))).collect()}
    stay = {r["doc_id"] for r in corpus_pipeline.known_language(spark, both, SF).collect()}
    assert stay == {i for i, lang in found.items() if lang in corpus_pipeline.LANGUAGES}
    assert sum(i >= 10_000 for i in stay) <= 3 and sum(i < 10_000 for i in stay) >= 190
