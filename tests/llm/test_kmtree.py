import math
import random

import numpy as np
from pyspark.sql import functions as F

from lodestrand.llm import kmtree


def brute(rows, k, every):
    """rows: (id, vector); the contract's answer."""
    use = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            use.setdefault(i, v)
    ids = np.array(sorted(use))
    vectors = np.array([use[i] for i in ids], np.float64)
    out = {}
    for q, v in zip(ids, vectors, strict=True):
        if q % every == 0:
            d = np.sqrt(((vectors - v) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
            out[int(q)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_small_tables_are_exact(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # many copies of one vector
    rows += [(2000, None), (2010, [0.0] * 4), (2020, [1.0, None, 0.0, 1.0]), (2030, [float("nan")] * 4), (2040, [float("inf"), 1.0, 1.0, 1.0]), (2050, []), (2060, [1.0, 2.0]), (None, [1.0] * 4), rows[0]]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, leaf int")
    got, want = answers(kmtree.search(df, k=10, every=10)), brute([r for r in rows if r[0] != 2060], 10, 10)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], "vec_id long, embedding array<double>")
    assert answers(kmtree.search(df)) == {0: [(1, 1.0)]}
    assert kmtree.search(df.limit(0)).count() == 0
    assert kmtree.search(df.limit(1)).count() == 0


def test_vectors_of_other_lengths_are_searched_apart(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)] + [(100 + i, [float(i), 1.0, 2.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows[:30], 10, 10) | brute(rows[30:], 10, 10)
    assert answers(kmtree.search(df, every=10)) == want


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_recall_of_a_searched_tree(spark, monkeypatch):
    monkeypatch.setattr(kmtree, "BUCKET_ROWS", 100)
    monkeypatch.setattr(kmtree, "FIT_ROWS", 100)  # too few for buckets of that size, so there are blocks
    monkeypatch.setattr(kmtree, "QUERY_ROWS", 20)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.4 * rng.normal(size=16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = answers(kmtree.search(df, every=25)), brute(rows, 10, 25)
    assert all(len(v) == 10 for v in got.values()) and recall(got, want) >= 0.9
    exact = dict(rows)
    for q, found in got.items():
        for i, s in found:
            assert abs(s - math.dist(exact[q], exact[i])) < 1e-12


def test_recall_and_share_on_the_embeddings(spark, monkeypatch):
    monkeypatch.setattr(kmtree, "BUCKET_ROWS", 512)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got, want = answers(kmtree.search(table, every=10)), brute([(r.vec_id, r.embedding) for r in table.collect()], 10, 10)
    assert recall(got, want) >= 0.9
    index = kmtree.Index.build(kmtree.usable(table).drop("dim"), 64, 11)
    assert sum(index.sizes.values()) == table.count()
    asked = kmtree.usable(table).filter("vec_id % 5 = 0").select("vec", F.col("vec_id").alias("query"))
    factor, share = index.calibrate(asked, 10, kmtree.RECALL)
    assert factor > 0 and 0 < share < 0.45  # directions at random, the hardest case; clustered vectors need less
    wider, more = index.calibrate(asked, 10, 0.99)
    assert wider > factor and more > share


def test_leaves_come_best_bin_first():
    rng = np.random.default_rng(3)
    held = rng.normal(size=(2000, 8))
    tree = kmtree.Tree.fit(held, 20)
    assert sorted(tree.order.tolist()) == list(range(2000))
    assert all(b - a <= 20 for a, b in zip(tree.first[tree.is_leaf], tree.last[tree.is_leaf], strict=True))
    for leaf in np.flatnonzero(tree.is_leaf):
        mine = tree.order[tree.first[leaf] : tree.last[leaf]]
        assert (tree.assign(held[mine]) == leaf).all()
    far = kmtree._squared(rng.normal(size=(50, 8)), tree.centres)
    every = tree.priorities(far)
    for to_centres, known in zip(far, every, strict=True):
        order = list(tree.visit(to_centres))
        assert sorted(leaf for _, leaf in order) == np.flatnonzero(tree.is_leaf).tolist()
        assert [p for p, _ in order] == sorted(known[tree.is_leaf]) and all(known[leaf] == p for p, leaf in order)
    again = kmtree.Tree.from_bytes(tree.to_bytes())
    assert all((getattr(again, k) == v).all() for k, v in vars(tree).items())
