"""k-gram matches between references and requests, their rarity, and how often they happen by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import evidence
from lodestrand.functions.grams import K, grams

#: Distinct grams of the references up to which they are broadcast (8 bytes each, and the table's overhead).
BROADCAST_GRAMS = 1_000_000


def reference_hits(references: DataFrame, ref: str, ref_data: str, requests: DataFrame, req: str, req_data: str, k: int = K) -> DataFrame:
    """(req, pos, gram, ref): where a gram of a request is one of a reference.

    Requests are first reduced to the positions whose 64-bit hash a reference has, then compared byte for
    byte. The hashes are broadcast if their number, which is counted, is small, and joined by key if not.
    """
    known = grams(references.select(ref, ref_data), ref_data, k).select(ref, "gram").distinct()
    known = known.withColumn("h", F.xxhash64("gram"))
    hashes = known.select("h").distinct()
    small = hashes.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    asked = grams(requests.select(req, req_data), req_data, k).withColumn("h", F.xxhash64("gram"))
    near = asked.join(F.broadcast(hashes) if small else hashes, "h", "left_semi")
    return near.join(known, ["h", "gram"]).select(req, "pos", "gram", ref)


def contamination(references: DataFrame, ref: str, ref_data: str, requests: DataFrame, req: str, req_data: str, k: int = K) -> DataFrame:
    """req, matched_bytes (under the union of the hits) and refs (sorted) of the requests with a hit."""
    hits = reference_hits(references, ref, ref_data, requests, req, req_data, k)
    # One row a position, with the references of its gram; neighbours mostly have the same, which a set keeps once.
    placed = hits.groupBy(req, "pos").agg(F.array_sort(F.collect_set(ref)).alias("_refs"))
    ahead = F.lead("pos").over(Window.partitionBy(req).orderBy("pos")) - F.col("pos")
    placed = placed.withColumn("_step", F.least(F.lit(k), F.coalesce(ahead, F.lit(k))))
    found = F.array_sort(F.array_distinct(F.flatten(F.collect_set("_refs"))))
    return placed.groupBy(req).agg(F.sum("_step").cast("long").alias("matched_bytes"), found.alias("refs"))


def document_frequency(documents: DataFrame, doc: str, data: str, k: int = K) -> DataFrame:
    """(gram, df): the number of documents that have a gram."""
    return grams(documents.select(doc, data), data, k).select(doc, "gram").distinct().groupBy("gram").agg(F.count("*").alias("df"))


def rarity_mass(matched: DataFrame, keys: list[str], frequency: DataFrame) -> DataFrame:
    """Sum of 1 / (1 + df) over the distinct matched grams of each key; an unseen gram weighs 1."""
    weighed = matched.select(*keys, "gram").distinct().join(frequency, "gram", "left")
    weight = 1.0 / (1 + F.coalesce("df", F.lit(0)))
    return weighed.groupBy(*keys).agg(F.sum(weight).alias("mass"), F.count("*").alias("grams"))


def false_positive_pairs(items: DataFrame, family: str, item: str, data: str, ks: list[int], decide: Column | None = None) -> DataFrame:
    """k, family, pairs, matches: ordered pairs of different items of a family that share a gram.

    k is a column, so all lengths are one job. `decide` replaces the test (at least one shared gram) by
    an expression over `shared`, their number. Grams that the same items have are joined as one, with their
    number, so that a passage in m items makes m (m - 1) rows and not as many for each of its grams.
    """
    lengths = items.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    shared = shared_grams(items, family, item, data, ks)
    hits = shared.filter(decide if decide is not None else F.col("shared") >= 1).groupBy("k", family).agg(F.count("*").alias("matches"))
    sizes = items.groupBy(family).agg(F.count("*").alias("n")).select(family, (F.col("n") * (F.col("n") - 1)).alias("pairs"))
    grid = sizes.crossJoin(F.broadcast(lengths))
    return grid.join(hits, ["k", family], "left").select("k", family, "pairs", F.coalesce("matches", F.lit(0)).cast("long").alias("matches"))


def shared_grams(items: DataFrame, family: str, item: str, data: str, ks: list[int]) -> DataFrame:
    """k, family, x, y, shared: how many grams each ordered pair of different items of a family shares, if any."""
    lengths = items.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    # Lengths are few and fixed: their cross product with the items is the grid of the sweep.
    grid = items.select(family, F.col(item).alias("_i"), data).crossJoin(F.broadcast(lengths))
    held = grams(grid, data, "k").select("k", family, "_i", "gram").distinct()
    # Who has a gram, as three sums over the holders; grams with the same holders are alike, and one stands for all.
    holders, mark = Window.partitionBy("k", family, "gram"), F.xxhash64("_i")
    named = held.select("*", F.count("*").over(holders).alias("_n"), F.bit_xor(mark).over(holders).alias("_x"), F.sum(F.shiftrightunsigned(mark, 24)).over(holders).alias("_s")).filter("_n > 1")
    keys = ["k", family, "_n", "_x", "_s"]
    alike = Window.partitionBy(*keys)
    chosen = named.select("*", F.min("gram").over(alike).alias("_one"), (F.count("*").over(alike) / F.col("_n")).cast("long").alias("_m")).filter("gram = _one")
    left, right = chosen.select(*keys, "_m", F.col("_i").alias("x")), chosen.select(*keys, F.col("_i").alias("y"))
    met = left.join(right, keys).filter("x <> y")
    return met.groupBy("k", family, "x", "y").agg(F.sum("_m").alias("shared"))


def pooled(pairs: DataFrame, family: str) -> DataFrame:
    """Rates by k and family and over all families (null), with their Wilson intervals."""
    both = pairs.rollup("k", family).agg(F.sum("matches").alias("matches"), F.sum("pairs").alias("pairs")).filter("k IS NOT NULL")
    interval = evidence.wilson(F.col("matches"), F.col("pairs"))
    return both.select("k", family, "matches", "pairs", evidence.ratio(F.col("matches"), F.col("pairs")).alias("rate"), interval["low"].alias("low"), interval["high"].alias("high"))


def choose(rows: DataFrame, recall: str = "recall", rate: str = "rate", k: str = "k", disqualified: str = "known_negatives") -> DataFrame:
    """The chosen k: no known negative detected, then best recall, lowest rate, smallest k; null for none."""
    fit = rows.filter(F.col(disqualified) == 0)
    return fit.agg(F.min_by(k, F.struct(-F.col(recall), F.col(rate), F.col(k))).alias("chosen_k"))


def recheck(calls: DataFrame, requests: DataFrame, k: int = K) -> DataFrame:
    """window, request, matching: of the calls in flight, those whose own arguments share a gram with the request.

    calls: (window, call, data), the canonical bytes of their arguments; requests: (window, request, target,
    body). Grams lie within the target or the body, never across both. A request without any has no row.
    """
    own = grams(calls, "data", k).select("window", "call", "gram").distinct().withColumn("_h", F.xxhash64("gram"))
    wire = requests.select("window", "request", F.explode(F.array("target", "body")).alias("data"))
    seen = grams(wire, "data", k).select("window", "request", "gram").distinct().withColumn("_h", F.xxhash64("gram"))
    met = seen.join(own, ["window", "_h", "gram"]).select("window", "request", "call").distinct()
    return met.groupBy("window", "request").agg(F.array_sort(F.collect_list("call")).alias("matching"))


def longest_matched_run(references: DataFrame, ref: str, ref_data: str, requests: DataFrame, req: str, req_data: str, k: int = K) -> DataFrame:
    """req, ref, run: the longest run of equal bytes of each pair that shares a gram, which is k at least.

    Matched grams at consecutive places of both lie on a diagonal; a run is an island of one, and k - 1 bytes. So
    only matched places are joined, whatever the lengths of the two.
    """
    hits = reference_hits(references, ref, ref_data, requests, req, req_data, k).withColumn("_h", F.xxhash64("gram"))
    places = grams(references.select(ref, ref_data), ref_data, k).select(ref, F.col("pos").alias("_at"), "gram", F.xxhash64("gram").alias("_h"))
    met = hits.join(places, [ref, "_h", "gram"]).select(req, ref, "pos", (F.col("pos") - F.col("_at")).alias("_d"))
    along = Window.partitionBy(req, ref, "_d").orderBy("pos")
    islands = met.withColumn("_island", F.col("pos") - F.row_number().over(along))
    runs = islands.groupBy(req, ref, "_d", "_island").agg(F.count("*").alias("n"))
    return runs.groupBy(req, ref).agg((F.max("n") + k - 1).alias("run"))


def longest_common_run(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, run: the longest run of equal bytes at any two places of `a` and `b` (BINARY), by pair.

    Equal bytes lie on diagonals; a run is an island of one. left: (keys, a), right: (keys, b); a pair's
    rows are the product of its lengths over the frequency of bytes, so inputs are to be short.
    """
    pairs = r"(?<=\G..)"
    a = left.select(*keys, F.posexplode(F.split(F.hex("a"), pairs)).alias("_i", "_byte")).filter("_byte <> ''")
    b = right.select(*keys, F.posexplode(F.split(F.hex("b"), pairs)).alias("_j", "_byte")).filter("_byte <> ''")
    met = a.join(b, [*keys, "_byte"]).withColumn("_d", F.col("_i") - F.col("_j"))
    along = Window.partitionBy(*keys, "_d").orderBy("_i")
    islands = met.withColumn("_island", F.col("_i") - F.row_number().over(along))
    runs = islands.groupBy(*keys, "_d", "_island").agg(F.count("*").alias("run"))
    return runs.groupBy(*keys).agg(F.max("run").alias("run"))
