"""Distributions by nearest rank, over zero-filled counts and fixed domains."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of calls and flows that one task holds while distinct values are counted.
TASK_ROWS = 1 << 18


def distribution(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, p50, p95 and max of a numeric column, as longs; zeros where there is no row and no group.

    Percentiles are nearest rank: the value at position ceil(p n). They are read from a histogram of the
    distinct values, so the rows are only counted, with partial sums, however many they are.
    """
    by = by or []
    hist = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upward = Window.partitionBy(*by).orderBy("v")
    ranked = hist.withColumn("below", F.sum("c").over(upward)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))

    def at(percent: int) -> Column:
        # ceil(percent n / 100) in whole numbers
        rank = F.floor((F.col("n") * percent + 99) / 100)
        return F.coalesce(F.min(F.when(F.col("below") >= rank, F.col("v"))), F.lit(0)).cast("long").alias(f"p{percent}")

    return ranked.groupBy(*by).agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n"), at(50), at(95), F.coalesce(F.max("v"), F.lit(0)).cast("long").alias("max"))


def zero_filled(counts: DataFrame, key: str, domain: Iterable[str], count: str = "n") -> DataFrame:
    """Counts over a fixed domain, 0 where it has none; keys outside the domain stay."""
    fixed = counts.sparkSession.createDataFrame([(d,) for d in domain], f"{key} string")
    return fixed.join(counts, key, "full_outer").select(key, F.coalesce(count, F.lit(0)).cast("long").alias(count))


def tasks_for(*tables: DataFrame) -> int:
    """How many tasks the rows of tables are dealt to, so that none holds more than about TASK_ROWS; they are counted."""
    rows = sum(t.count() for t in tables)
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def _tallied(calls: DataFrame, flows: DataFrame, call: str, aggregates: list[Column], count_flow: Column | None, deal: tuple[int, str] | None) -> DataFrame:
    """Aggregates of each call, with `literal` and `repaired`: whether those readings have it.

    Calls and flows are one table that is grouped once: calls are rows without a flow's values, as are the flows that
    do not count.
    """
    counts = F.lit(True) if count_flow is None else F.coalesce(count_flow, F.lit(False))
    values = [c for c in flows.columns if c != call]
    seen = flows.filter(F.col(call).isNotNull()).select(call, *[F.when(counts, F.col(c)).alias(c) for c in values], F.when(counts, True).alias("counted"), F.lit(True).alias("_flow"))
    rows = seen.withColumn("_call", F.lit(None).cast("boolean")).unionByName(calls.select(call, F.lit(True).alias("_call")), allowMissingColumns=True)
    if deal is not None:
        rows = rows.repartition(deal[0], call, deal[1])
    grouped = rows.groupBy(call).agg(*aggregates, F.max("counted").alias("_counted"), F.max("_flow").alias("_flow"), F.max("_call").alias("_call"))
    caused, known = F.col("_counted").isNotNull(), F.col("_call").isNotNull()
    return grouped.select("*", (caused | (known & F.col("_flow").isNull())).alias("literal"), (caused | known).alias("repaired")).drop("_counted", "_flow", "_call")


def per_call(calls: DataFrame, flows: DataFrame, call: str, aggregates: list[Column], count_flow: Column | None = None, deal: tuple[int, str] | None = None) -> DataFrame:
    """Aggregates of each call's flows, with a zero row for each call that has no flow at all.

    aggregates: counts that skip nulls; `counted` is true for each flow that counts, so its count is their number.
    count_flow: which flows count. A call that has flows of which none counts is absent, as it was not
    silent; `repaired` below gives it its zero. deal: (tasks, column), by which rows are dealt first, so that distinct
    values of the column are held by so many tasks, those of one call too; see `tasks_for`.
    """
    return _tallied(calls, flows, call, aggregates, count_flow, deal).filter("literal").drop("literal", "repaired")


def repaired(calls: DataFrame, flows: DataFrame, call: str, aggregates: list[Column], count_flow: Column, deal: tuple[int, str] | None = None) -> DataFrame:
    """As per_call, but a call whose flows all fail `count_flow` is a zero too."""
    return _tallied(calls, flows, call, aggregates, count_flow, deal).filter("repaired").drop("literal", "repaired")


def both_readings(calls: DataFrame, flows: DataFrame, call: str, aggregates: list[Column], count_flow: Column, deal: tuple[int, str] | None = None) -> DataFrame:
    """The rows of per_call and of repaired under their `variant`, literal or repaired, from one grouping."""
    names = F.array_compact(F.array(*[F.when(F.col(v), v) for v in ("literal", "repaired")]))
    return _tallied(calls, flows, call, aggregates, count_flow, deal).withColumn("variant", F.explode(names)).drop("literal", "repaired")
