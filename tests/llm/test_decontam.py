import hashlib
import random
import re

import pytest

from lodestone.llm import decontam


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, block", [(10, decontam.BLOCK), (3, 900)])
def test_against_brute_force(spark, window, block):
    rng = random.Random(window)
    vocab = ["Aa", "b", "ÇÉ", "d1", "e", "ff"]
    text = lambda n, gap=" ": gap.join(rng.choice(vocab) for _ in range(n))
    items = [(1, text(14)), (2, text(10)), (2, text(12)), (3, "b"), (None, text(11)), (4, None), (5, "!!"), (6, text(4))]
    docs = [(i, rng.choice([None, "", text(30), text(40, "-\x00 "), text(5) + " " + (items[i % 3][1] or "") + "," + text(3), "B"])) for i in range(40)] + [(None, items[0][1]), (7, items[0][1]), (7, items[0][1])]
    d = spark.createDataFrame([(*r, 1, "w") for r in docs], "doc_id long, text string, row int, token string")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, seq string")
    assert sorted(map(tuple, decontam.contaminated(d, b, window, block).collect()), key=str) == brute(docs, items, window)
    clean = sorted(str((r.doc_id, r.text)) for r in decontam.clean(d, b, window, block).collect())
    bad = {t for _, t in docs if brute([(0, t)], items, window)[0][-1]}
    assert clean == sorted(str((i, t)) for i, t in docs if t not in bad)


def test_awkward_rows_and_empty_tables(spark, awkward, no_documents):
    b = spark.createDataFrame([(1, "the river ran over")], "item_id long, text string")
    assert decontam.contaminated(awkward, b).count() == awkward.count()
    assert decontam.contaminated(no_documents, b).count() == 0
    none = decontam.contaminated(awkward, b.where("false")).collect()
    assert len(none) == awkward.count() and not any(r.contaminated for r in none)
    assert decontam.clean(awkward, b.where("false")).columns == awkward.columns


def test_the_main_path_is_native(spark, sf):
    d, b = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plan = decontam.contaminated(d, b)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
