from lodestone.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(d, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 40 and (held.predicted == held.quality).mean() > 0.93
    assert ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_labels_of_held_out_rows_teach_nothing(spark, sf):
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.fold("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.classify(d, x).select("doc_id", "score").toPandas().sort_values("doc_id") for x in (labels, turned))
    assert (a.score.to_numpy() == b.score.to_numpy()).all()


def test_awkward_rows(spark, awkward, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (9, 0), (9, None), (None, 1), (77, 0)], "doc_id long, quality int")
    rows = quality.classify(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(no_documents, labels).count() == 0
    assert {r.score for r in quality.classify(awkward, labels.where("false")).collect()} == {0.5}


def test_votes_are_weighted_cosines():
    import numpy as np

    terms = np.stack([quality.features(t) for t in ("good words here. " * 20, "BAD!! BAD!! " * 30, "good things there. " * 15)])
    model = quality.fit(terms, np.array([1.0, 0.0, 1.0]), rank=3)
    scores = quality.vote(np.stack([quality.features("fine words again. " * 10), quality.features("WORSE!! WORSE!! " * 9)]), model, neighbours=1)
    assert scores.tolist() == [1.0, 0.0]


def test_votes_of_500_documents_against_brute_force(spark):
    """Cosines, neighbours and shares one number at a time, from terms counted anew for the words."""
    import math

    import numpy as np

    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(*quality.teaching(d, labels))
    texts = [r.text for r in d.orderBy("doc_id").limit(500).collect()]
    terms = np.stack([quality.features(t) for t in texts])
    got = quality.vote(terms, model)
    vectors, votes = model["vectors"].astype(np.float64).tolist(), model["labels"].tolist()
    latent = terms.astype(np.float64) @ model["project"].astype(np.float64)
    for k, v in enumerate(latent.tolist()):
        size = math.sqrt(sum(x * x for x in v)) or 1.0
        cosines = sorted(((sum(a * b for a, b in zip(v, w, strict=True)) / size, y) for w, y in zip(vectors, votes, strict=True)), reverse=True)
        edge = cosines[quality.NEIGHBOURS - 1][0]
        above, level = [c for c in cosines if c[0] > edge + 1e-6], [c for c in cosines if abs(c[0] - edge) <= 1e-6]
        share = (quality.NEIGHBOURS - len(above)) / len(level)
        total = [(c, y, 1.0) for c, y in above] + [(c, y, share) for c, y in level]
        assert abs(got[k] - sum(max(c, 1e-9) * y * s for c, y, s in total) / sum(max(c, 1e-9) * s for c, y, s in total)) < 1e-3


def test_words_decide_where_style_is_the_same():
    import numpy as np

    rng = np.random.default_rng(1)
    good, bad = ["river", "stone", "green", "field"], ["scamm", "fraud", "cheap", "offer"]
    text = lambda words: " ".join(rng.choice(words, 40))
    taught = [text(good) for _ in range(30)] + [text(bad) for _ in range(30)]
    model = quality.fit(np.stack([quality.features(t) for t in taught]), np.array([1.0] * 30 + [0.0] * 30))
    scores = quality.vote(np.stack([quality.features(text(good)), quality.features(text(bad))]), model)
    assert scores[0] > 0.9 and scores[1] < 0.1


def test_ties_share_the_last_places():
    import numpy as np

    same = np.stack([quality.features("the same words")] * 6)
    model = quality.fit(same, np.array([1.0, 0, 0, 1, 0, 0]))
    assert abs(quality.vote(same[:1], model, neighbours=2)[0] - 1 / 3) < 1e-6


def test_the_sample_does_not_depend_on_partitions(spark):
    import numpy as np

    rows = [(k % 40, f"text {k} " * (k % 9 + 1)) for k in range(120)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (quality.teaching(x, labels, 25) for x in (d.coalesce(1), d.repartition(7)))
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]) and len(a[1]) == 25
