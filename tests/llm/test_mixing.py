import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrand.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Reshare what is above the cap until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        by = sum(weight[s] for s in names if s not in capped)
        share = {s: most * sizes[s] if s in capped else (left * weight[s] / by if by else 0) for s in names}
        over = {s for s in names if s not in capped and share[s] > most * sizes[s]}
        if not over:
            return share
        capped |= over


def test_targets(spark):
    rng = random.Random(1)
    for n in (2, 12):
        sizes = {f"s{i}": rng.choice([0, 3, 50, 1000, 40_000]) for i in range(n)} | {None: 7, "é": 20, "Z": 90}
        df = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, rows long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_apportionment_gives_the_highest_quotients(spark):
    rng = random.Random(2)
    cases = [(m, seats, [rng.choice([0.0, 1.0, 1.0, rng.random() * 50]) for _ in range(m)]) for m, seats in ((1, 5), (4, 10), (9, 3), (30, 1000), (25, 0))]
    df = spark.createDataFrame([(g, i, w, seats) for g, (_, seats, ws) in enumerate(cases) for i, w in enumerate(ws)], "g long, i long, w double, seats long")
    got = {(r.g, r.i): r.quota for r in mixing.apportion(df, ["g"], "w", "seats", [F.col("i")]).collect()}
    for g, (m, seats, weights) in enumerate(cases):
        want, heap = {i: 0 for i in range(m)}, [(-w, i) for i, w in enumerate(weights) if w > 0]
        heapq.heapify(heap)
        for _ in range(seats if heap else 0):
            _, i = heapq.heappop(heap)
            want[i] += 1
            heapq.heappush(heap, (-weights[i] / (2 * want[i] + 1), i))
        assert {i: got[g, i] for i in range(m)} == want


def test_mix_of_a_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == sizes
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.source, []).append(r)
    targets = brute_targets({s: sum(r["size"] for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert rs[0].target == pytest.approx(targets[s])
        assert abs(sum(r.taken for r in rs) - targets[s]) <= 0.005 * targets[s] + 2


def test_shards_have_quotas(spark, small, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    rows = mixing.mix(spark.read.parquet(f"{small}/documents.parquet")).collect()
    by = {}
    for r in rows:
        by.setdefault((r.source, r.target), []).append(r.taken)
    assert all(abs(sum(t) - target) <= 0.03 * target + 20 for (_, target), t in by.items())


def test_rendered_words_are_those_taken(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    mixed = mixing.mix(docs, keep=docs.columns)
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    got, texts = dict.fromkeys(taken, 0), {r.doc_id: r.text for r in docs.collect()}
    for r in mixing.render(mixed).collect():
        got[r.doc_id] += len(r.text.split())
        assert set(r.text.split()) <= set(texts[r.doc_id].split())
    assert got == taken


def test_edges(spark, edge_docs, no_docs):
    rows = mixing.mix(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert sorted(r["size"] for r in rows) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in edge_docs.collect())
    assert all(r.taken <= 3 * r["size"] for r in rows) and {r.source for r in rows} == {"a", "b", "c", None}
    assert mixing.mix(no_docs).count() == 0
    assert mixing.render(mixing.mix(edge_docs, keep=edge_docs.columns)).columns == edge_docs.columns
