"""The instrument against the truth: what a bench sent, what it planned, and what the sensor claims.

plan: call_id, slot, cell, channel, expect, fragment_present and an order; truth: dest_host, error; flows: the run's
records. A destination belongs to the plan's last row for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import evidence
from lodestrand.operators import numbers

#: Destinations that slots share in turn (fixed value of the bench), and the channels that the sensor reads.
SLOTS = 128
MATCHED_CHANNELS = ("target", "body")


class BenchError(ValueError):
    """A run without a ledger or a plan, of which no metric can be computed."""


@dataclass(frozen=True)
class Instrument:
    """capture, attribution (a row a cell and one for all), cells: what each was expected to give and gave."""

    capture: DataFrame
    attribution: DataFrame
    cells: DataFrame


def host_of_slot(slot: Column) -> Column:
    """The destination of a slot (fixed form of the bench)."""
    return F.format_string("sink%03d.bench.invalid", (slot % SLOTS).cast("int"))


def claims(plan: DataFrame, truth: DataFrame, flows: DataFrame, order: str = "slot") -> DataFrame:
    """A row for each flow to a destination that was sent to: what the sensor claims, and what the plan says.

    Grades come from the k-gram signal alone, as a bench's destination is never package infrastructure and its
    material has no structure.
    """
    last = F.max_by(F.struct("call_id", "cell", "channel", "fragment_present"), order).alias("p")
    planned = plan.groupBy(host_of_slot(F.col("slot")).alias("dest_host")).agg(last)
    sent = truth.filter(F.coalesce("error", F.lit("")) == "").select("dest_host").distinct()
    ladder = evidence.grade(F.col("our_traceparent_present"), F.col("causal"), F.col("active_calls_in_window"), F.col("matching_calls_in_window"), F.lit(True), F.col("has_time_and_pid"), F.lit(True), F.lit(0))
    seen = flows.join(sent, "dest_host", "left_semi").withColumn("grade", ladder["grade"]).join(planned, "dest_host", "left")
    return seen.select(
        F.coalesce("p.cell", F.lit("unknown")).alias("cell"),
        "grade",
        F.col("call_id").alias("claimed_call"),
        F.col("p.call_id").alias("expected_call"),
        "provenance",
        F.coalesce("p.fragment_present", F.lit(False)).alias("fragment_present"),
        F.coalesce(F.col("p.channel").isin(*MATCHED_CHANNELS), F.lit(False)).alias("in_matched_channel"),
    )


def capture(truth: DataFrame, flows: DataFrame) -> DataFrame:
    """One row: connections sent, observed and failed, flows to the bench, destinations that were never seen."""
    recall = numbers.instrument_recall(truth, flows)
    sent = truth.filter(F.coalesce("error", F.lit("")) == "").select("dest_host").distinct()
    seen = flows.join(sent, "dest_host", "left_semi").agg(F.count("*").alias("flows_to_bench_hosts"))
    failed = truth.agg(F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed_to_send"))
    # Three results of one row each.
    return recall.crossJoin(seen).crossJoin(failed)


def confusion(claimed: DataFrame, plan: DataFrame, order: str = "slot") -> DataFrame:
    """cell, expect, flows, correct_call, wrong_call, no_call, grades (map): planned cells without a flow too."""
    named = F.coalesce("claimed_call", F.lit("")) != ""
    right = F.col("claimed_call").eqNullSafe(F.col("expected_call"))
    counts = claimed.groupBy("cell").agg(F.count("*").alias("flows"), F.count_if(named & right).alias("correct_call"), F.count_if(named & ~right).alias("wrong_call"), F.count_if(~named).alias("no_call"))
    by_grade = claimed.groupBy("cell", "grade").agg(F.count("*").alias("n")).groupBy("cell")
    grades = by_grade.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("grade", "n")))).alias("grades"))
    expected = plan.groupBy("cell").agg(F.max_by("expect", order).alias("expect"))
    both = counts.join(grades, "cell").join(expected, "cell", "full_outer")
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("flows", "correct_call", "wrong_call", "no_call")]
    return both.select("cell", "expect", *filled, F.coalesce("grades", F.create_map().cast("map<string,bigint>")).alias("grades"))


def compute(plan: DataFrame, truth: DataFrame, flows: DataFrame, order: str = "slot") -> Instrument:
    """All metrics of a bench run; refused where there is no ledger or no plan."""
    if truth.isEmpty() or plan.isEmpty():
        raise BenchError("no truth ledger or no plan: these metrics are those of a bench run only")
    claimed = claims(plan, truth, flows, order)
    return Instrument(capture(truth, flows), numbers.instrument_precision(claimed), confusion(claimed, plan, order))
