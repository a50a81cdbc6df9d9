"""Which calls in flight could have caused a request: containment of their tokens, and discrimination."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import evidence


def candidates(calls: DataFrame, requests: DataFrame) -> DataFrame:
    """wave, request, contained and discriminating (sorted ids), non_discriminating, token_count.

    calls: (wave, call, tokens array); requests: (wave, request, tokens array). A call is contained in a
    request that has all its tokens; one without tokens claims nothing. A call of whose tokens another
    call of the wave has each one discriminates nothing and is no candidate.

    Division by equality: tokens are joined within a wave, and a call is contained where it matches as
    often as it has tokens. So a wave of many calls and requests makes rows by shared tokens only.
    """
    calls = calls.select("wave", "call", F.array_distinct("tokens").alias("tokens"))
    owned = calls.select("wave", "call", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    rivals = F.count("*").over(Window.partitionBy("wave", "token"))
    own = owned.withColumn("alone", (rivals == 1).cast("int"))
    tells = own.groupBy("wave", "call", "size").agg(F.max("alone").alias("tells"))
    asked = requests.select("wave", "request", F.explode(F.array_distinct("tokens")).alias("token"))
    hits = asked.join(owned, ["wave", "token"]).groupBy("wave", "request", "call").agg(F.count("*").alias("hits"))
    held = hits.join(tells, ["wave", "call"]).filter(F.col("hits") == F.col("size"))
    lists = held.groupBy("wave", "request").agg(
        F.array_sort(F.collect_list("call")).alias("contained"),
        F.array_sort(F.collect_list(F.when(F.col("tells") == 1, F.col("call")))).alias("discriminating"),
        F.max(F.when(F.col("tells") == 1, F.col("size"))).alias("size"),
    )
    mute = tells.groupBy("wave").agg(F.sum(1 - F.col("tells")).alias("mute"))
    out = requests.select("wave", "request").join(lists, ["wave", "request"], "left").join(mute, "wave", "left")
    ids = calls.schema["call"].dataType.simpleString()
    none = F.array().cast(f"array<{ids}>")
    found = F.coalesce("discriminating", none)
    return out.select(
        "wave",
        "request",
        F.coalesce("contained", none).alias("contained"),
        found.alias("discriminating"),
        F.coalesce("mute", F.lit(0)).cast("long").alias("non_discriminating"),
        F.when(F.size(found) == 1, F.col("size")).otherwise(0).cast("long").alias("token_count"),
    )


def simulate(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Add grade, reason and false_strong to requests that are derived from the calls of waves, as if all were in flight.

    calls: (wave, call, tokens); targets: (wave, request, call, tokens), requests with the call that makes each. A
    strong grade for another call than that is a false one.
    """
    found = candidates(calls, targets.select("wave", "request", "tokens"))
    active = calls.groupBy("wave").agg(F.count("*").alias("active"))
    rows = found.join(targets.select("wave", "request", F.col("call").alias("_own")), ["wave", "request"]).join(active, "wave")
    told = F.size("discriminating")
    ladder = evidence.grade(F.lit(False), told > 0, F.col("active"), told, F.lit(True), F.lit(True), F.lit(True), F.col("token_count"))
    graded = rows.withColumn("_g", ladder).select("wave", "request", "_g.grade", "_g.reason", "discriminating", "_own")
    false_strong = (F.col("grade") == "CONTENT_UNIQUE") & ~F.get("discriminating", F.lit(0)).eqNullSafe(F.col("_own"))
    return graded.withColumn("false_strong", false_strong).drop("discriminating", "_own")
