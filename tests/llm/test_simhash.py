import random

import numpy as np
import pytest
import xxhash

from lodestrand.llm import simhash
from lodestrand.llm.components import components


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints(spark, edge_docs):
    got = sorted(((r.doc_id or -1), r.fp % (1 << 64)) for r in simhash.fingerprints(edge_docs).collect())
    assert got == sorted(((r.doc_id or -1), brute_fp(r.text)) for r in edge_docs.collect())


def test_spark_hashes_the_same(spark):
    text = "some ünïcode words that are longer than thirty-two bytes"
    assert spark.sql(f"SELECT xxhash64('{text}')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


def test_variants_lose_no_pair():
    rng = random.Random(2)
    for distance in (0, 1, 2, 3, 5):
        for blank in (1, 4):
            keys = simhash.variant_keys(distance, blank)
            for _ in range(200):
                a = rng.getrandbits(64)
                b = a
                for bit in rng.sample(range(64), distance):
                    b ^= 1 << bit
                assert any(a & m == b & m for _, m in keys)


def test_edges_match_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.randint(0, 8)):
            x = base
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    near = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    want = {k: v for k, v in groups(near, signed).items()}
    for large in (4096, 2):  # buckets whole, and cut by the finer index
        monkeypatch.setattr(simhash, "LARGE_BUCKET", large)
        got = {r.node: r.root for r in components(simhash.fingerprint_edges(df, 2)).collect()}
        assert {x: got.get(x, x) for x in signed} == want


def test_large_buckets_by_the_finer_index():
    rng = random.Random(6)
    base = rng.getrandbits(64)
    fps = np.array(sorted({base ^ (1 << i) ^ (1 << j) for i in range(0, 64, 5) for j in range(0, 64, 7)}), np.uint64)
    a = groups([(int(fps[i]), int(fps[j])) for i, j in simhash.bucket_edges(fps, 2)], [int(x) for x in fps])
    near = [(int(x), int(y)) for x in fps for y in fps if x < y and bin(int(x) ^ int(y)).count("1") <= 2]
    assert a == groups(near, [int(x) for x in fps])


@pytest.mark.parametrize("frequent", [256, 3])
def test_components(spark, monkeypatch, frequent):
    monkeypatch.setattr("lodestrand.llm.components.LEAST_FREQUENT", frequent)
    rng = random.Random(9)
    for n, m in ((60, 50),):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 240)]
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
        nodes = {x for e in edges if e[0] != e[1] for x in e}
        assert got == groups(edges, nodes)


def test_near_duplicates(spark, edge_docs, no_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[1] == by[7] == {1} and by[2] == by[3] == by[4] == {2} and by[6] == {6} and by[None] >= {2}
    assert {r.fingerprint for r in rows if r.doc_id in (2, 3, 4)} == {"0" * 16}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_copies_match_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(4000)]
    docs = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        docs.append(base)
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(copy)
    docs += [[], [], ["a", "b"], ["a", "b"]]
    df = spark.createDataFrame([(i, " ".join(d).upper() if i % 5 == 0 else " ".join(d), "x") for i, d in enumerate(docs)], "doc_id long, text string, uid string")
    sets = [set(simhash.shingle_hashes(" ".join(d), 5).tolist()) for d in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if docs[i] == docs[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = set(groups(pairs, range(len(docs))).values())
    for block in (2,):
        monkeypatch.setattr(simhash, "BLOCK_DOCS", block)
        kept = {r.doc_id for r in simhash.without_copies(df).collect()}
        # The candidate index may miss a pair at the very threshold, and nothing else.
        assert want <= kept and len(kept - want) <= 1
    assert simhash.without_copies(df.limit(0)).count() == 0


def test_all_kinds_of_copies_match_brute_force(spark):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(3000)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    docs, common = [], words(80)
    for k in range(60):
        base = words(rng.choice([3, 6, 9, 14, 25, 60, 150, 400]))
        n = len(base)
        part, at = max(1, n * rng.choice([5, 9, 10, 14, 18, 20, 24]) // 100), rng.randrange(n)
        docs += [base, base + words(part), base[: n - part], base[part:], base[:at] + words(part // 2) + base[at + part // 2 :], base[:at] + words(part) + base[at:]]
        docs.append(common + words(rng.randint(10, 200)))  # a shared passage alone makes no copy
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    sets = [set(simhash.shingle_hashes(" ".join(d), 5).tolist()) for d in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if docs[i] == docs[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) > 100
    assert {r.doc_id for r in simhash.without_copies(df).collect()} == set(groups(pairs, range(len(docs))).values())


def test_copies_of_edge_rows(spark, edge_docs):
    kept = [r.doc_id for r in simhash.without_copies(edge_docs).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 2, 5, 6] and kept.count(None) == 1
