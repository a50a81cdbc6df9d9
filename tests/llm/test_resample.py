import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrand.llm import resample


def corpus(n, seed=1):
    rng = random.Random(seed)
    clean = [f"w{i}" for i in range(800)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(20, 200))]
        quality, toxic = 1, 0
        if i % 10 == 0:
            quality, words = 0, [w + "***" for w in words]
        elif i % 10 == 1:
            toxic = 1
            for _ in range(4):
                words[rng.randrange(len(words))] = "slur"
        rows.append((i, " ".join(words), "x"))
        if rng.random() < 0.5:
            labels.append((i, quality, toxic))
    return rows, labels


def test_junk_goes_and_clean_text_stays(spark):
    rows, labels = corpus(3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = {r.doc_id for r in resample.reject(resample.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    labelled = {i for i, _, _ in labels}
    held_out = [i for i, _, _ in rows if i not in labelled]
    share = lambda kind: sum(i in kept for i in held_out if kind(i)) / sum(map(kind, held_out))
    assert share(lambda i: i % 10 > 1) > 0.97
    assert share(lambda i: i % 10 == 0) < 0.05
    assert share(lambda i: i % 10 == 1) < 0.3


def test_sample_size_and_reruns(spark):
    rows, labels = corpus(600)
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, key string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a = {r.doc_id for r in resample.resample(docs, lab, k=100).collect()}
    assert len(a) == 100 and a == {r.doc_id for r in resample.resample(docs.repartition(5), lab, k=100).collect()}
    assert resample.resample(docs, lab, k=0).count() == 0
    assert resample.resample(docs, lab, k=10_000).count() == 600


def test_weights_match_brute_force_and_the_sample_is_the_top_k(spark):
    rows, labels = corpus(400)
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, key string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    every = {r.doc_id: r for r in resample.resample(docs, lab, k=400).collect()}
    known = {r.doc_id: r for r in resample.labelled(lab).collect()}
    grams = {i: [list(map(int, b)) for b in resample.buckets(text)] for i, text, _ in rows}
    raw, target = [Counter(), Counter()], [Counter(), Counter()]
    for i, both in grams.items():
        for n in (0, 1):
            raw[n].update(both[n])
            if i in known and known[i].good and not known[i].held_out:
                target[n].update(both[n])
    share = [target[n].total() / raw[n].total() for n in (0, 1)]
    for i, both in grams.items():
        total = sum(math.log((target[n][g] + resample.PRIOR) / (raw[n][g] * share[n] + resample.PRIOR)) for n in (0, 1) for g in both[n])
        assert every[i].log_weight == pytest.approx(total * min(1, resample.PASSAGE / len(both[0])), abs=1e-3)
    for k in (1, 37, 200):
        got = {r.doc_id for r in resample.resample(docs, lab, k=k).collect()}
        assert got == set(sorted(every, key=lambda i: -every[i].key)[:k])
    samples = [frozenset(r.doc_id for r in resample.resample(docs, lab, k=200, seed=seed).collect()) for seed in (1, 2, 3)]
    assert len(set(samples)) == 3 and all(len(a & b) < 190 for a in samples for b in samples if a != b)


def test_gumbel_noise_draws_by_weight(spark):
    weights = [0.0, 0.7, 1.4]
    rows = spark.range(30_000).select((F.col("id") % 3).alias("w"), F.floor(F.col("id") / 3).alias("draw"), "id")
    value = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("w") + 1).cast("int"))
    keyed = rows.withColumn("key", value + resample._gumbel(5, "id"))
    won = {r.w: r["count"] for r in keyed.groupBy("draw").agg(F.max_by("w", "key").alias("w")).groupBy("w").count().collect()}
    for i, w in enumerate(weights):
        assert won[i] / 10_000 == pytest.approx(math.exp(w) / sum(map(math.exp, weights)), abs=0.02)


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(resample, "LAST_KEYS", 5)
    rng = random.Random(4)
    for values in ([2.0] * 40, [rng.gauss(0, 1) for _ in range(500)], [float(rng.randint(0, 9)) for _ in range(300)], [1e9, *[rng.random() for _ in range(200)]]):
        df = spark.createDataFrame([(v,) for v in values], "key double")
        for k in {1, len(values) // 2 or 1}:
            assert resample.kth_largest(df, "key", k) == sorted(values, reverse=True)[min(k, len(values)) - 1]


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    assert resample.resample(edge_docs, labels).count() == edge_docs.count()  # nothing good is known
    assert resample.resample(edge_docs, labels.limit(0), keep=edge_docs.columns).select("kept.*").columns == edge_docs.columns
    good = spark.createDataFrame([(i, 1, 0) for i in range(1, 8)], "doc_id long, quality int, toxic int")
    assert 0 < resample.resample(edge_docs, good).count() <= edge_docs.count()
    assert resample.resample(no_docs, good).count() == 0
