import numpy as np
import pyarrow.parquet as pq

from lodestone.llm import langid


def test_held_out_accuracy(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(d).toPandas()
    truth = pq.read_table(f"{sf}/documents.parquet").to_pandas().set_index("doc_id")
    held = got[got.held_out]
    assert len(got) == len(truth) and 0.2 < len(held) / len(got) < 0.5
    letters = truth.text[held.doc_id].str.contains("[a-zA-Z]")
    right = held.lang_pred.to_numpy() == truth.lang[held.doc_id].to_numpy()
    assert right[letters.to_numpy()].mean() > 0.95
    assert got.score.between(0, 1).all()


def test_bundles_are_the_sum_of_bound_trigrams():
    p = langid.Profiler(64)
    (_, _, counts, codes), = p.matrix(["abab"])
    got = (counts @ p.bound(codes))[0]
    v = {c: langid._letter_vector(ord(c), 64).astype(int) for c in "ab "}
    text = " abab "
    want = sum(np.roll(v[text[i]], 2) * np.roll(v[text[i + 1]], 1) * v[text[i + 2]] for i in range(len(text) - 2))
    assert (got == want).all()


def test_awkward_rows(awkward, no_documents):
    rows = langid.identify(awkward).collect()
    assert len(rows) == awkward.count()
    by = [(r.doc_id, r.lang_pred, r.score) for r in rows]
    assert all(p == "und" and s == 0 for i, p, s in by if i in (3, 4, 5, 6))
    assert any(i == 8 and p == "en" for i, p, _ in by)
    assert langid.identify(no_documents).count() == 0


def test_nothing_learned(spark):
    d = spark.createDataFrame([(1, "some words", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(d).collect()} == {("und", 0.0)}


def test_predict_keeps_and_replaces_columns(awkward):
    found = langid.predict(awkward, langid.learn(langid.teaching(awkward)))
    assert found.columns == [c for c in awkward.columns if c != "score"] + ["lang_pred", "score"]
