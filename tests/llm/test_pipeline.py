import collections
import re

import pytest

import corpus_pipeline
from lodestone.llm import queries


def test_queries_cover_all_ten():
    names = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert names == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, sf))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes)
            docs = out
        counts.append(out.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    assert out.where("not lossless").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == counts[-1]


def _stage(name):
    return dict(corpus_pipeline.STAGES)[name]


CLASHING = "doc_id long, text string, lang string, source string, score double, lang_pred string, _file long, _row long, _maybe boolean, token string, digest binary, ids string, decoded int, `a.b` int, _pii_base int, _bitmap int"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_with_awkward_rows_clashing_names_and_none(spark, awkward, name):
    rows = [(r.doc_id, r.text, r.lang, r.source, 0.5, "x", k, k, True, "t", b"d", "i", 1, 2, 3, 4) for k, r in enumerate(awkward.collect())]
    rows += [(None, None, None, None) + (None,) * 12] * 2
    docs = spark.createDataFrame(rows, CLASHING)
    out = _stage(name)(spark, docs, "/root/testdata/sf0.001")
    got = out.collect()
    if name == "sentencepiece":
        assert len(got) == len(rows) and all(r.lossless for r in got)
    else:
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        other = lambda r: tuple(v for k, v in enumerate(r) if docs.columns[k] != "text")
        assert set(map(other, got)) <= set(map(other, rows))
    want = {"language_id": [r for r in rows if any(c.isalpha() for c in r[1] or "")], "decontamination": rows, "personal_data": rows}
    if name in want:
        assert len(got) == len(want[name])
    assert _stage(name)(spark, docs.where("false"), "/root/testdata/sf0.001").count() == 0


def test_languages_that_are_not_learned_are_rejected(spark, sf):
    taught = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    more = ["Быстрая коричневая лиса прыгает через ленивую собаку и убегает далеко в тёмный лес за рекой", "Kdyby tisíc klarinetů hrálo v noci na střeše domu, vzbudilo by to všechny sousedy v ulici", "日本語の文章はここにありますそしてもう少し長くします" * 4]
    short = ["A.", "Re.", "日本"]
    docs = taught.unionByName(spark.createDataFrame([(10**9 + k, t, None) for k, t in enumerate([*more, *short])], "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in _stage("language_id")(spark, docs, sf).select("doc_id").collect()}
    assert not {10**9 + k for k in range(len(more))} & kept and {10**9 + len(more) + k for k in range(len(short))} <= kept


def plain(rows, items):
    """The pipeline's rows without Spark: languages as they were predicted are given, all else is brute force."""
    words = [(t or "").encode().split() for _, t in rows]
    shingles = [collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None for w in words]
    head = list(range(len(rows)))

    def find(k):
        while head[k] != k:
            k = head[k]
        return k

    holders = collections.defaultdict(list)
    for k, bag in enumerate(shingles):
        for other, common in sum((collections.Counter(holders[s]) for s in bag or ()), collections.Counter()).items():
            both = bag & shingles[other]
            if find(k) != find(other) and sum(both.values()) >= 0.8 * sum((bag | shingles[other]).values()):
                head[max(find(k), find(other))] = min(find(k), find(other))
        for s in bag or ():
            holders[s].append(k)
    kept = [k for k in range(len(rows)) if find(k) == k]
    norm = lambda t: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    windows = {" ".join(w[k : k + 10]) for w in (norm(t).split() for t in items) if w for k in range(max(1, len(w) - 9))}
    clean = [rows[k] for k in kept if not any(f" {w} " in f" {norm(rows[k][1])} " for w in windows)]
    return clean


def test_the_pipeline_against_a_plain_version(spark, sf):
    import sentencepiece

    from lodestone.llm import langid, pii

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labelled = langid.predict(docs.select("doc_id", "text"), langid.learn(langid.teaching(docs))).orderBy("doc_id").collect()
    spoken = [(r.doc_id, r.text) for r in labelled if r.lang_pred != "und" and (r.score >= corpus_pipeline.LEAST_COSINE or sum(c.isalpha() for c in r.text) < corpus_pipeline.LEAST_LETTERS)]
    clean = plain(spoken, items)
    processor = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert sorted(got) == [i for i, _ in clean]
    for i, text in clean:
        assert got[i].lossless and list(got[i].ids) == processor.encode(got[i].decoded) and got[i].n_tokens == len(got[i].ids)
        base = pii.masked(text, pii.base_spans(text))
        secrets = re.sub(r'(token = ")[0-9A-Fa-f]{40}(")', r"\1[SECRET]\2", base, flags=re.I)
        assert got[i].decoded in (base, secrets)
