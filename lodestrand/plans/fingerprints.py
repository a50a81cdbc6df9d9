"""k-gram queries: benchmark items are the references, documents the requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import evidence
from lodestrand.functions.grams import K, W, grams, winnow
from lodestrand.operators import matching
from lodestrand.operators.distribution import zero_filled
from lodestrand.plans.registry import Query, table

LADDER = (1, 2, 4, 8, 16, 32, 64)
SWEEP = tuple(range(8, 65, 4))
FAMILIES = 5


def _bytes(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _bytes(table(spark, sf_dir, "benchmark"), "item_id"), _bytes(table(spark, sf_dir, "documents"), "doc_id")


_SQL_GRAMS = f"""
b AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark),
bg AS (SELECT DISTINCT item_id, substr(h, 2 * p + 1, {2 * K}) AS gram FROM (SELECT item_id, h, unnest(range(0, length(h) // 2 - {K - 1})) AS p FROM b)),
d AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
dg AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * K}) AS gram FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {K - 1})) AS p FROM d)),
hits AS (SELECT doc_id, p, gram FROM dg WHERE gram IN (SELECT gram FROM bg))
"""


def kgram_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document under grams of the benchmark."""
    refs, docs = _sides(spark, sf_dir)
    found = matching.contamination(refs, "item_id", "data", docs, "doc_id", "data")
    return found.select("doc_id", "matched_bytes", F.size("refs").cast("long").alias("n_refs"))


CONTAMINATION = f"""
WITH {_SQL_GRAMS},
c AS (SELECT doc_id, sum(least({K}, coalesce(nxt - p, {K}))) AS matched FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM hits) GROUP BY 1),
r AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM hits JOIN bg USING (gram) GROUP BY 1)
SELECT doc_id, CAST(matched AS BIGINT) AS matched_bytes, r.n AS n_refs FROM c JOIN r USING (doc_id)
"""


def matched_refs_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which references each document carries, in order."""
    refs, docs = _sides(spark, sf_dir)
    found = matching.contamination(refs, "item_id", "data", docs, "doc_id", "data")
    return found.select("doc_id", F.array_join(F.col("refs").cast("array<string>"), ",").alias("matched_refs"))


MATCHED_REFS = f"""
WITH {_SQL_GRAMS}
SELECT doc_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS matched_refs
FROM (SELECT DISTINCT doc_id, item_id FROM hits JOIN bg USING (gram)) GROUP BY 1
"""


def winnow_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winnowed grams of each benchmark item."""
    sequence = grams(_bytes(table(spark, sf_dir, "benchmark"), "item_id"), "data")
    return winnow(sequence, "item_id", "pos", "gram").select("item_id", F.hex("gram").alias("fingerprint"))


WINNOW = f"""
WITH b AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark),
g AS (SELECT item_id, p, length(h) // 2 - {K - 1} AS n, substr(h, 2 * p + 1, {2 * K}) AS gram FROM (SELECT item_id, h, unnest(range(0, length(h) // 2 - {K - 1})) AS p FROM b)),
m AS (SELECT item_id, p, n, min(gram) OVER (PARTITION BY item_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS gram FROM g)
SELECT DISTINCT item_id, gram AS fingerprint FROM m WHERE p <= n - {W} OR (n < {W} AND p = 0)
"""


def kgram_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many grams of the benchmark are in how many items."""
    df = matching.document_frequency(_bytes(table(spark, sf_dir, "benchmark"), "item_id"), "item_id", "data", 12)
    return df.groupBy("df").agg(F.count("*").alias("grams"))


FREQUENCY = """
WITH b AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark),
g AS (SELECT DISTINCT item_id, substr(h, 2 * p + 1, 24) AS gram FROM (SELECT item_id, h, unnest(range(0, length(h) // 2 - 11)) AS p FROM b))
SELECT df, count(*) AS grams FROM (SELECT gram, count(*) AS df FROM g GROUP BY 1) GROUP BY 1
"""


def rarity_mass_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of document and item that reach each rung of gram rarity; no gram, no match."""
    refs, docs = _sides(spark, sf_dir)
    hits = matching.reference_hits(refs, "item_id", "data", docs, "doc_id", "data")
    mass = matching.rarity_mass(hits, ["doc_id", "item_id"], matching.document_frequency(refs, "item_id", "data"))
    rungs = spark.createDataFrame([(m,) for m in LADDER], "threshold int")
    passed = mass.join(F.broadcast(rungs), F.col("mass") >= F.col("threshold") - 1e-9).groupBy("threshold").agg(F.count("*").alias("n"))
    return rungs.join(passed, "threshold", "left").select("threshold", F.coalesce("n", F.lit(0)).cast("long").alias("pairs"))


RARITY = f"""
WITH {_SQL_GRAMS},
f AS (SELECT gram, count(*) AS df FROM bg GROUP BY 1),
m AS (SELECT doc_id, item_id, sum(1.0::DOUBLE / (1 + df)) AS mass FROM (SELECT DISTINCT doc_id, item_id, gram FROM hits JOIN bg USING (gram)) JOIN f USING (gram) GROUP BY 1, 2),
t(threshold) AS (VALUES (1), (2), (4), (8), (16), (32), (64))
SELECT threshold, count(mass) AS pairs FROM t LEFT JOIN m ON mass >= threshold - 1e-9 GROUP BY 1
"""


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(table(spark, sf_dir, "benchmark"), "item_id").withColumn("family", F.pmod("item_id", F.lit(FAMILIES)))


def false_positive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance matches between different items of a family, by family and over all, with intervals."""
    pairs = matching.false_positive_pairs(_families(spark, sf_dir), "family", "item_id", "data", [12])
    return matching.pooled(pairs, "family").select("family", "matches", "pairs", "rate", "low", "high")


_PAIRS = f"""
b AS (SELECT item_id, item_id % {FAMILIES} AS family, hex(encode(text)) AS h FROM benchmark),
g AS (SELECT DISTINCT k, family, item_id, substr(h, 2 * p + 1, 2 * k) AS gram FROM (SELECT k, family, item_id, h, unnest(range(0, length(h) // 2 - k + 1)) AS p FROM b, ks)),
m AS (SELECT DISTINCT x.k, x.family, x.item_id AS a, y.item_id AS b FROM g x JOIN g y ON x.k = y.k AND x.family = y.family AND x.gram = y.gram AND x.item_id <> y.item_id),
s AS (SELECT family, count(*) * (count(*) - 1) AS pairs FROM b GROUP BY 1),
r AS (SELECT ks.k, s.family, s.pairs, count(m.a) AS matches FROM s CROSS JOIN ks LEFT JOIN m ON m.k = ks.k AND m.family = s.family GROUP BY 1, 2, 3)
"""

FALSE_POSITIVES = f"""
WITH ks AS (SELECT 12 AS k), {_PAIRS},
u AS (SELECT family, matches, pairs FROM r UNION ALL SELECT NULL, sum(matches), sum(pairs) FROM r),
v AS (SELECT family, CAST(matches AS BIGINT) AS matches, CAST(pairs AS BIGINT) AS pairs, matches::DOUBLE / pairs AS p, pairs::DOUBLE AS n, {evidence.Z95}::DOUBLE AS z FROM u)
SELECT family, matches, pairs, p AS rate,
  CASE WHEN matches = 0 THEN 0.0 ELSE greatest(0.0, (p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) END AS low,
  CASE WHEN matches = pairs THEN 1.0 ELSE least(1.0, (p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) END AS high
FROM v
"""


def k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance matches and self-match recall of every gram length, and the length that the rule chooses."""
    items = _families(spark, sf_dir)
    rates = matching.false_positive_pairs(items, "family", "item_id", "data", list(SWEEP)).groupBy("k").agg(F.sum("matches").alias("matches"), F.sum("pairs").alias("pairs"))
    sizes = items.groupBy(F.octet_length("data").alias("bytes")).agg(F.count("*").alias("items"))
    recall = sizes.crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in SWEEP], "k int"))).groupBy("k").agg(F.sum(F.when(F.col("bytes") >= F.col("k"), F.col("items")).otherwise(0)).alias("found"), F.sum("items").alias("items"))
    rows = rates.join(recall, "k").withColumn("rate", evidence.ratio(F.col("matches"), F.col("pairs"))).withColumn("recall", evidence.ratio(F.col("found"), F.col("items")))
    chosen = matching.choose(rows.withColumn("known_negatives", F.lit(0)))
    return rows.crossJoin(F.broadcast(chosen)).select("k", "matches", "pairs", "found", "items", (F.col("k") == F.col("chosen_k")).alias("chosen"))


K_SWEEP = f"""
WITH ks AS (SELECT CAST(unnest(range(8, 65, 4)) AS INTEGER) AS k), {_PAIRS},
e AS (SELECT k, CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(pairs) AS BIGINT) AS pairs FROM r GROUP BY 1),
q AS (SELECT k, count(*) FILTER (WHERE length(h) // 2 >= k) AS found, count(*) AS items FROM b, ks GROUP BY 1),
j AS (SELECT k, matches, pairs, found, items FROM e JOIN q USING (k))
SELECT k, matches, pairs, found, items,
       row_number() OVER (ORDER BY found::DOUBLE / items DESC, matches::DOUBLE / pairs, k) = 1 AS chosen FROM j
"""


def longest_common_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of bytes that each benchmark item has in common with the next."""
    items = _bytes(table(spark, sf_dir, "benchmark"), "item_id")
    a = items.select("item_id", F.col("data").alias("a"))
    b = items.select((F.col("item_id") - 1).alias("item_id"), F.col("data").alias("b"))
    return matching.longest_common_run(a, b.join(a.select("item_id"), "item_id"), ["item_id"])


RUNS = """
WITH b AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark),
c AS (SELECT item_id, p, substr(h, 2 * p + 1, 2) AS byte FROM (SELECT item_id, h, unnest(range(0, length(h) // 2)) AS p FROM b)),
m AS (SELECT x.item_id, x.p AS i, x.p - y.p AS d FROM c x JOIN c y ON y.item_id = x.item_id + 1 AND x.byte = y.byte),
s AS (SELECT item_id, d, i - row_number() OVER (PARTITION BY item_id, d ORDER BY i) AS island FROM m)
SELECT item_id, max(n) AS run FROM (SELECT item_id, d, island, count(*) AS n FROM s GROUP BY 1, 2, 3) GROUP BY 1
"""


def longest_matched_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of bytes that each document has in common with each item that it carries."""
    refs, docs = _sides(spark, sf_dir)
    return matching.longest_matched_run(refs, "item_id", "data", docs, "doc_id", "data")


MATCHED_RUNS = f"""
WITH {_SQL_GRAMS},
pairs AS (SELECT DISTINCT doc_id, item_id FROM hits JOIN bg USING (gram)),
x AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS byte FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM pairs))),
y AS (SELECT item_id, p, substr(h, 2 * p + 1, 2) AS byte FROM (SELECT item_id, h, unnest(range(0, length(h) // 2)) AS p FROM b)),
m AS (SELECT doc_id, item_id, x.p AS i, x.p - y.p AS g FROM pairs JOIN x USING (doc_id) JOIN y USING (item_id) WHERE x.byte = y.byte),
s AS (SELECT doc_id, item_id, g, i - row_number() OVER (PARTITION BY doc_id, item_id, g ORDER BY i) AS island FROM m)
SELECT doc_id, item_id, max(n) AS run FROM (SELECT doc_id, item_id, g, island, count(*) AS n FROM s GROUP BY 1, 2, 3, 4) GROUP BY 1, 2
"""


def detectability_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many neighbouring pairs share a run that clears each floor (k = 6, w = 4)."""
    runs = longest_common_runs(spark, sf_dir)
    counts = runs.groupBy(evidence.detectability(F.col("run"), 6, 4).alias("bucket")).agg(F.count("*").alias("n"))
    return zero_filled(counts, "bucket", ("below_k_invisible", "matched_but_below_winnowing_floor", "at_or_above_winnowing_floor"))


BUCKETS = f"""
WITH runs AS ({RUNS}),
d(bucket) AS (VALUES ('below_k_invisible'), ('matched_but_below_winnowing_floor'), ('at_or_above_winnowing_floor')),
r AS (SELECT CASE WHEN run >= 9 THEN 'at_or_above_winnowing_floor' WHEN run >= 6 THEN 'matched_but_below_winnowing_floor' ELSE 'below_k_invisible' END AS bucket FROM runs)
SELECT bucket, count(r.bucket) AS n FROM d LEFT JOIN r USING (bucket) GROUP BY 1
"""


def precision_recall_vs_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims (a document carries benchmark material) against the labels, by label."""
    refs, docs = _sides(spark, sf_dir)
    claimed = matching.reference_hits(refs, "item_id", "data", docs, "doc_id", "data").select("doc_id").distinct().withColumn("claimed", F.lit(1))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    truth = docs.select("doc_id").join(labels, "doc_id", "left").join(claimed, "doc_id", "left")
    claims = F.count(F.when(F.col("claimed") == 1, 1))
    return truth.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("truth")).agg(
        F.count("*").alias("documents"), claims.alias("claimed"), (claims.cast("double") / F.count("*")).alias("rate")
    )


PRECISION = f"""
WITH {_SQL_GRAMS}, c AS (SELECT DISTINCT doc_id FROM hits)
SELECT coalesce(CAST(quality AS VARCHAR), 'unknown') AS truth, count(*) AS documents, count(c.doc_id) AS claimed,
       count(c.doc_id)::DOUBLE / count(*) AS rate
FROM documents t LEFT JOIN labels l ON t.doc_id = l.doc_id LEFT JOIN c ON t.doc_id = c.doc_id GROUP BY 1
"""

QUERIES = [
    Query("kgram_contamination", kgram_contamination, CONTAMINATION),
    Query("matched_refs_per_doc", matched_refs_per_doc, MATCHED_REFS),
    Query("winnow_fingerprints", winnow_fingerprints, WINNOW),
    Query("kgram_document_frequency", kgram_document_frequency, FREQUENCY),
    Query("rarity_mass_ladder", rarity_mass_ladder, RARITY),
    Query("false_positive_pairs", false_positive_pairs, FALSE_POSITIVES),
    Query("k_sweep", k_sweep, K_SWEEP),
    Query("longest_common_runs", longest_common_runs, RUNS),
    Query("longest_matched_runs", longest_matched_runs, MATCHED_RUNS),
    Query("detectability_buckets", detectability_buckets, BUCKETS),
    Query("precision_recall_vs_truth", precision_recall_vs_truth, PRECISION),
]
