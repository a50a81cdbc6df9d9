"""Calibrating a matcher: recall by reason, matches of a call with itself, rarity thresholds and their verdict.

items: (family, item, args, target, body), calls with the request that each caused, all bytes but the names; transfers:
(transfer, args, target, body, detectable, reason), known ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import evidence
from lodestrand.functions.grams import K, W, grams
from lodestrand.operators import matching
from lodestrand.operators.distribution import zero_filled
from lodestrand.sources.corpora import PurposeError

#: Rarity mass that a match needs, and the rungs that are tried (fixed values of the acceptance test).
LEAST_MASS = 1.0
LADDER = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 12.0, 16.0)
BUCKETS = ("below_k_invisible", "matched_but_below_winnowing_floor", "at_or_above_winnowing_floor")


def _own(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """(key, gram): grams of a row's arguments that are in its own target or body."""
    asked = grams(rows, "args", k).select(*key, "gram").distinct()
    wire = rows.select(*key, F.explode(F.array("target", "body")).alias("_data"))
    return asked.join(grams(wire, "_data", k).select(*key, "gram").distinct(), [*key, "gram"])


def detection_recall(transfers: DataFrame, k: int = K) -> DataFrame:
    """reason, transfers, detected: by why a transfer can't be seen; those that must be are '' with their recall."""
    found = _own(transfers, ["transfer"], k).select("transfer").distinct().withColumn("hit", F.lit(1))
    reason = F.when(F.col("detectable"), "").otherwise(F.coalesce(F.nullif("reason", F.lit("")), F.lit("unclassified")))
    out = transfers.join(found, "transfer", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("transfers"), F.count("hit").alias("detected"))
    return out.withColumn("recall", F.when(F.col("reason") == "", evidence.ratio(F.col("detected"), F.col("transfers"))))


def self_match_recall(items: DataFrame, k: int = K) -> DataFrame:
    """family (null for all), calls, matched, recall: of calls whose own arguments show in their own request."""
    found = _own(items, ["family", "item"], k).select("family", "item").distinct().withColumn("hit", F.lit(1))
    out = items.join(found, ["family", "item"], "left").rollup("family").agg(F.count("*").alias("calls"), F.count("hit").alias("matched"))
    return out.withColumn("recall", evidence.ratio(F.col("matched"), F.col("calls")))


def pair_matches(items: DataFrame, k: int = K) -> DataFrame:
    """family, a, b, gram: what of b's arguments is in a's request, for ordered pairs of a family, a's with itself too."""
    asked = grams(items, "args", k).select("family", F.col("item").alias("b"), "gram").distinct()
    wire = items.select("family", F.col("item").alias("a"), F.explode(F.array("target", "body")).alias("_data"))
    return grams(wire, "_data", k).select("family", "a", "gram").distinct().join(asked, ["family", "gram"])


def _pairs(items: DataFrame) -> DataFrame:
    """One row: calls, and ordered pairs of different calls of a family."""
    n = items.groupBy("family").agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("calls"), F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0)).alias("pairs"))


def upper_median(counts: DataFrame, value: str) -> DataFrame:
    """One row n, min, median, max: the median is the value at floor(n / 2), from 0; zeros where there is none."""
    hist = counts.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    held = hist.agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("h"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("v"))
    # A row for each distinct count is few.
    walk = F.aggregate("h", start, lambda acc, x: F.struct((acc["at"] + x["c"]).alias("at"), F.when(acc["v"].isNull() & (acc["at"] + x["c"] > F.floor(F.col("n") / 2)), x["v"].cast("long")).otherwise(acc["v"]).alias("v")))
    zero = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    return held.select("n", zero(F.array_min("h")["v"]).alias("min"), zero(walk["v"]).alias("median"), zero(F.array_max("h")["v"]).alias("max"))


def colliding_frequencies(items: DataFrame, frequency: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    """((df, instances), one row of the grams a colliding pair shares): how common is what collides, in the background."""
    met = pair_matches(items, k).filter("a <> b")
    by_df = met.join(frequency, "gram", "left").groupBy(F.coalesce("df", F.lit(0)).cast("long").alias("df")).agg(F.count("*").alias("instances"))
    return by_df, upper_median(met.groupBy("family", "a", "b").agg(F.count("*").alias("n")), "n")


def true_match_counts(transfers: DataFrame, k: int = K) -> DataFrame:
    """The same row for matches that are real: transfers that must be seen, and are."""
    return upper_median(_own(transfers.filter("detectable"), ["transfer"], k).groupBy("transfer").agg(F.count("*").alias("n")), "n")


def _masses(met: DataFrame, keys: list[str], frequency: DataFrame) -> DataFrame:
    return matching.rarity_mass(met, keys, frequency).select(*keys, "mass")


def sweep_mass(items: DataFrame, transfers: DataFrame, frequency: DataFrame, half: str, k: int = K, ladder: tuple[float, ...] = LADDER) -> DataFrame:
    """min_mass, false_positives, rate, self_recall, bench_recall of each rung; on the half that is for calibration only.

    A match needs at least one shared gram, whatever the rung.
    """
    if half != "calibration":
        raise PurposeError(f"a threshold is not chosen on the {half} half")
    met = pair_matches(items, k)
    pairs = _masses(met, ["family", "a", "b"], frequency).select((F.col("a") == F.col("b")).alias("own"), "mass")
    known = _masses(_own(transfers.filter("detectable"), ["transfer"], k), ["transfer"], frequency)
    rungs = items.sparkSession.createDataFrame([(float(m),) for m in ladder], "min_mass double")

    def reached(rows: DataFrame, name: str) -> DataFrame:
        # Few rungs: each pair is counted at all that it reaches.
        return rows.join(F.broadcast(rungs), F.col("mass") >= F.col("min_mass")).groupBy("min_mass").agg(F.count("*").alias(name))

    out = rungs
    for rows, name in ((pairs.filter("NOT own"), "false_positives"), (pairs.filter("own"), "_own"), (known, "_known")):
        out = out.join(reached(rows, name), "min_mass", "left")
    whole = _pairs(items).crossJoin(transfers.agg(F.count_if("detectable").alias("known")))
    n = lambda c: F.coalesce(c, F.lit(0))
    return out.crossJoin(F.broadcast(whole)).select(
        "min_mass",
        n("false_positives").cast("long").alias("false_positives"),
        evidence.ratio(n("false_positives"), F.col("pairs")).alias("rate"),
        evidence.ratio(n("_own"), F.col("calls")).alias("self_recall"),
        evidence.ratio(n("_known"), F.col("known")).alias("bench_recall"),
    )


def cheapest_clean(ladder: DataFrame) -> DataFrame:
    """One row: the least mass without a false positive, and the recall there; null where no rung is clean."""
    clean = F.col("false_positives") == 0
    return ladder.agg(F.min(F.when(clean, F.col("min_mass"))).alias("cheapest_mass"), F.min_by("self_recall", F.when(clean, F.col("min_mass"))).alias("self_recall_there"))


def acceptance(held_out: DataFrame, frequency: DataFrame, k: int = K, least_mass: float = LEAST_MASS) -> DataFrame:
    """One row: false positives of the held-out half without and with weighting, and whether weighting is kept, which it is if they fall."""
    masses = _masses(pair_matches(held_out, k).filter("a <> b"), ["family", "a", "b"], frequency)
    n = masses.agg(F.count("*").alias("unweighted"), F.count_if(F.col("mass") >= least_mass).alias("weighted")).crossJoin(_pairs(held_out).select("pairs"))
    return n.select("pairs", "unweighted", "weighted", evidence.ratio(F.col("unweighted"), F.col("pairs")).alias("unweighted_rate"), evidence.ratio(F.col("weighted"), F.col("pairs")).alias("weighted_rate"), F.when(F.col("weighted") < F.col("unweighted"), "kept").otherwise("reverted").alias("verdict"))


def structural_matches(items: DataFrame, own_token: bool = True) -> DataFrame:
    """family (null for all), calls, self_matched, pairs, false_positives of the structural matcher.

    items: (family, item, tokens, request), the tokens of a call and of its request; item names one row. b is contained
    in a's request if all its tokens are there. own_token: b must also have a token that a lacks, and two at least.

    Pairs are counted, not made: equal calls are one row with their number, equal requests too, and a call meets only
    the requests with its rarest token. Where own_token holds, only requests with a foreign token that some call has
    take part, as one that has a's tokens alone holds no call that tells itself apart.
    """
    sets = items.select("family", *[F.array_sort(F.array_distinct(c)).alias(n) for c, n in (("tokens", "ta"), ("request", "held"))])
    own = F.col("family").isNotNull() & (F.size("ta") > 0) & (F.size(F.array_except("ta", "held")) == 0)
    sizes = sets.groupBy("family").agg(F.count("*").alias("calls"), F.count_if(own).alias("self_matched")).withColumn("pairs", F.col("calls") * (F.col("calls") - 1))
    calls = sets.filter(F.size("ta") >= (2 if own_token else 1)).groupBy("family", F.col("ta").alias("tb")).agg(F.count("*").alias("same_calls"))
    owned = calls.select("*", F.explode("tb").alias("token"))
    if own_token:
        foreign = F.array_except("held", "ta")
        wires = sets.filter(F.size(foreign) > 0).groupBy("family", "ta", "held").agg(F.count("*").alias("same_requests"))
        known = wires.select("*", F.explode(foreign).alias("token")).join(owned.select("family", "token").distinct(), ["family", "token"], "left_semi")
        wires = known.drop("token").distinct()
    else:
        wires = sets.groupBy("family", "held").agg(F.count("*").alias("same_requests"))
    asked = wires.select("*", F.explode("held").alias("token"))
    common = asked.groupBy("family", "token").agg(F.count("*").alias("df"))
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("rarest")
    sought = owned.join(common, ["family", "token"], "left").groupBy("family", "tb", "same_calls").agg(rarest).filter("rarest.df > 0")
    met = asked.join(sought.select("family", "tb", "same_calls", "rarest.token"), ["family", "token"])
    met = met.filter(F.size(F.array_except("tb", "held")) == 0)
    if own_token:
        met = met.filter(F.size(F.array_except("tb", "ta")) > 0)
    counts = met.groupBy("family").agg(F.sum(F.col("same_calls") * F.col("same_requests")).alias("contained"))
    contained = F.coalesce("contained", F.lit(0))
    # With own_token no call is told from itself; without, each that its own request holds is counted once too often.
    others = contained if own_token else contained - F.col("self_matched")
    joined = sizes.join(counts, "family", "left").withColumn("false_positives", others)
    return joined.rollup("family").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("calls", "self_matched", "pairs", "false_positives")])


def canaries(files: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """bucket, n: planted tokens of files (content BINARY) by the floor that their length clears."""
    token = F.explode(F.regexp_extract_all(F.col("content").cast("string"), F.lit(r"CANARY_[A-Za-z0-9_.:@/-]+"), F.lit(0)))
    lengths = files.select(token.alias("t")).select(F.char_length("t").alias("run"))
    return lengths.groupBy(evidence.detectability(F.col("run"), k, w).alias("bucket")).agg(F.count("*").alias("n"))


def inventory(items: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """family, calls, self_matched, min, median (upper), max and the buckets of the longest run that a call's arguments share with its request."""
    wire = items.select("family", "item", F.concat("target", F.lit(b"\0"), "body").alias("b"))
    runs = matching.longest_common_run(items.select("family", "item", F.col("args").alias("a")), wire, ["family", "item"])
    rows = items.select("family", "item").join(runs, ["family", "item"], "left").withColumn("run", F.coalesce("run", F.lit(0)))
    found = _own(items, ["family", "item"], k).select("family", "item").distinct().withColumn("hit", F.lit(1))
    rows = rows.join(found, ["family", "item"], "left").withColumn("bucket", evidence.detectability(F.col("run"), k, w))
    ordered = F.array_sort(F.collect_list("run"))
    return rows.groupBy("family").agg(
        F.count("*").alias("calls"),
        F.count("hit").alias("self_matched"),
        F.min("run").alias("min"),
        F.get(ordered, F.floor(F.count("*") / 2).cast("int")).alias("median"),
        F.max("run").alias("max"),
        *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS],
    )


def bucket_counts(runs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """bucket, n of a column `run`, zeros included."""
    counts = runs.groupBy(evidence.detectability(F.col("run"), k, w).alias("bucket")).agg(F.count("*").alias("n"))
    return zero_filled(counts, "bucket", BUCKETS)
