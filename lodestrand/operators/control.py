"""A control run against a subject: which destinations under review a bare client reaches too, and what they carried."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import evidence
from lodestrand.operators import reports


def _hosts(flows: DataFrame) -> DataFrame:
    return flows.withColumn("host", F.lower(F.trim(F.coalesce("dest_host", F.lit("")))))


def host_counts(flows: DataFrame, server: str | None = None, call_caused_only: bool = True) -> DataFrame:
    """(host, flows) of one server or of all; by default without what was seen before any call."""
    rows = _hosts(flows).filter("host <> ''")
    if server is not None:
        rows = rows.filter(F.col("server_id") == server)
    if call_caused_only:
        rows = rows.filter(evidence.call_caused())
    return rows.groupBy("host").agg(F.count("*").alias("flows"))


def match_summary(flows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What our material did, by channel, in one row or one for each group.

    Context is measured in bytes, arguments as yes or no, so the two are never summed. `alive` says whether the
    matcher saw anything: it is a statement about a whole run, so groups have none.
    """
    target, body = F.coalesce("target_matched_bytes", F.lit(0)), F.coalesce("body_matched_bytes", F.lit(0))
    causal = F.count_if(F.coalesce("causal", F.lit(False)))
    sums = [
        F.count("*").alias("flows"),
        F.count_if((target > 0) | (body > 0)).alias("flows_with_context"),
        F.coalesce(F.sum(target), F.lit(0)).alias("target_matched_bytes"),
        F.coalesce(F.sum(body), F.lit(0)).alias("body_matched_bytes"),
        causal.alias("causal_flows"),
    ]
    if by:
        return flows.groupBy(*by).agg(*sums)
    return flows.agg(*sums, (causal > 0).alias("alive"))


@dataclass(frozen=True)
class Comparison:
    """verdict: one row; hosts: a row each, with its flows on both sides; matching: a row a side; carried: what
    reviewed hosts carried on each side."""

    verdict: DataFrame
    hosts: DataFrame
    matching: DataFrame
    carried: DataFrame


def compare(control: DataFrame, subject: DataFrame, server: str, under_review: DataFrame) -> Comparison:
    """Flows of a control run, flows of the subject's run with the server that is compared, hosts (host) under review."""
    own = subject.filter(F.col("server_id") == server)
    here, there = host_counts(control), host_counts(own)
    review = under_review.select(F.lower(F.trim("host")).alias("host")).filter("host <> ''").distinct()
    verdict = reports.control(here.select("host"), there.select("host"), review)
    both = here.withColumnRenamed("flows", "in_control").join(there.withColumnRenamed("flows", "in_subject"), "host", "full_outer")
    hosts = both.join(review.withColumn("reviewed", F.lit(True)), "host", "full_outer")
    hosts = hosts.select("host", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_control", "in_subject")], F.coalesce("reviewed", F.lit(False)).alias("reviewed"))
    sides = match_summary(control).withColumn("side", F.lit("control")).unionByName(match_summary(own).withColumn("side", F.lit("subject")))
    each = _hosts(control).withColumn("side", F.lit("control")).unionByName(_hosts(own).withColumn("side", F.lit("subject")))
    carried = match_summary(each.join(review, "host", "left_semi"), ["side", "host"])
    return Comparison(verdict, hosts, sides, carried)


def publishable(found: Comparison, authorisation: str, **driven: str | int | float) -> DataFrame:
    """The comparison as one row that names hosts, with how the control was driven; refused without the record of who allowed it."""
    if not authorisation.strip():
        raise ValueError("a named instance is not published without its authorisation")
    row = F.struct("host", "in_control", "in_subject")
    reviewed = found.hosts.filter("reviewed").agg(F.array_sort(F.collect_list(row)).alias("hosts"))
    # Both sides are one row.
    out = found.verdict.crossJoin(reviewed)
    return out.select("*", F.lit(authorisation).alias("authorisation"), *[F.lit(v).alias(k) for k, v in driven.items()])
