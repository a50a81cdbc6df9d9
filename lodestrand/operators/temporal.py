"""State as of a time: which calls were in flight when a flow was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(flows: DataFrame, states: DataFrame, by: list[str], time: str, state: str, tie: str | None = None) -> DataFrame:
    """Each flow with the last state at or before its time, null before the first.

    At one time a state comes before a flow; of several states there, the one with the greatest `tie`
    holds. One union and one window: neither side is exploded or broadcast.
    """
    columns = flows.columns
    order = [F.col(time), F.col("_is_flow"), *([F.col("_tie")] if tie else [])]
    left = flows.select(*[F.col(c).alias(f"f_{c}") for c in columns], *by, time, F.lit(None).cast(states.schema[state].dataType).alias("_state"), F.lit(1).alias("_is_flow"), F.lit(None).cast("long").alias("_tie"))
    right = states.select(
        *[F.lit(None).cast(flows.schema[c].dataType).alias(f"f_{c}") for c in columns],
        *by, time, F.col(state).alias("_state"), F.lit(0).alias("_is_flow"), (F.col(tie).cast("long") if tie else F.lit(None).cast("long")).alias("_tie"),
    )
    past = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn(state, F.last("_state", ignorenulls=True).over(past))
    return both.filter("_is_flow = 1").select(*[F.col(f"f_{c}").alias(c) for c in columns], state)


def in_flight_changes(events: DataFrame, by: list[str], time: str, phase: str, active: str) -> DataFrame:
    """The change log of what is in flight: a phase in which no call can run empties the set.

    What leaves the machine after `drained` is so attributed to no call, and never to the last one.
    """
    driving = F.col(phase) == "driving"
    empty = F.array().cast(events.schema[active].dataType)
    return events.select(*by, time, phase, F.when(driving, F.coalesce(active, empty)).otherwise(empty).alias(active))
