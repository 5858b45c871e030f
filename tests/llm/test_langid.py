import numpy as np

from tessera.llm import langid
from tessera.llm.queries import QUERIES, _fold


def test_query_learns_from_its_fold_and_is_accurate_on_the_rest(spark):
    sf = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in QUERIES["op10_language_id"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held_out", _fold(4)).select("doc_id", "text", "lang", "held_out").collect()
    assert len(found) == len(docs)
    good = []
    for d in docs:
        r = found[d["doc_id"]]
        assert r["held_out"] == d["held_out"] and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in d["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        if d["held_out"] and letters and d["lang"] is not None:
            good.append(r["lang_pred"] == d["lang"])
    assert len(good) > 150 and np.mean(good) > 0.97


def test_labels_of_the_held_out_fold_change_nothing(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = langid.fit(docs, ~_fold(4))
    b = langid.fit(docs.withColumn("lang", F.when(_fold(4), F.lit("xx")).otherwise(F.col("lang"))), ~_fold(4))
    assert a.langs == b.langs and all((p == q).all() for p, q in zip(a.params(), b.params(), strict=True))


def test_edge_cases(spark):
    rows = [(None, "the words of a text", "en"), (1, "the cat sat on the mat and the dog", "en"), (2, "der Hund und die Katze sind im Haus", "de"), (3, None, "en"), (4, "", None), (5, "1234 !?", "de"), (6, "日本", None), (7, "the cat " * 20_000, None), (8, "der Hund", None), (8, "der Hund", None)]
    docs = spark.createDataFrame([(*x, 0.0) for x in rows], "doc_id long, text string, lang string, score double")
    model = langid.fit(docs, _fold(4) | ~_fold(4))
    found = langid.predict(docs, model).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["lang_pred"] == "und" and r["score"] == 0) == (r["doc_id"] in (3, 4, 5))
    assert {r["lang_pred"] for r in found} <= {"en", "de", "und"}
    assert langid.keep_known(docs, model).columns == docs.columns and langid.keep_known(docs, model).count() == len(rows) - 3
    assert langid.fit(docs.limit(0), _fold(4)) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).collect() == []


def test_windows_cover_the_whole_text():
    raw = np.arange(300, dtype=np.int64).astype(np.uint8)
    x, owner, length = langid.windows_of(raw, np.array([0, 0, 300]))
    assert owner.tolist() == [1, 1, 1] and length.tolist() == [128, 128, 44]
    assert np.concatenate([row[:n] for row, n in zip(x, length, strict=True)]).tolist() == langid._LOWER[raw].tolist()


def test_gradients_equal_finite_differences():
    model = langid.ByteCNN.start(["a", "b", "c"])
    r = np.random.default_rng(0)
    x, y = r.integers(97, 123, (6, langid.WINDOW)).astype(np.uint8), r.integers(0, 3, 6)
    for p in (model.embed, *model.convs, *model.biases, model.out, model.out_bias):
        p += r.normal(0, 0.05, p.shape).astype(np.float32)
    loss = lambda: -model.log_probs(x)[np.arange(6), y].mean()
    for p, g in zip(model.params(), model.gradients(x, y), strict=True):
        spot = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[spot], np.float32(2e-3)
        p[spot] = old + step
        high = loss()
        p[spot] = old - step
        low = loss()
        p[spot] = old
        assert abs((high - low) / (2 * step) - g[spot]) < 0.05 * max(abs(g[spot]), 0.02)


def test_sample_is_the_rows_of_smallest_hash(spark, monkeypatch):
    rows = [(k % 40, f"text number {k} of many", "en" if k % 3 else None) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "TRAIN_ROWS", 100)
    found = langid.training_sample(docs, "text", "lang", "doc_id")
    monkeypatch.setattr(langid, "OVER", 10**9)
    assert found == langid.training_sample(docs, "text", "lang", "doc_id") and len(found) == 300
