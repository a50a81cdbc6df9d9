"""Destinations against what servers declare: whose traffic it is first, and then whether it is declared."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import evidence
from lodestrand.functions.structure import host_suffixes
from lodestrand.operators import reports

#: Commands that resolve a package and then start it (fixed values).
LAUNCHERS = ("npx", "uvx", "pipx")
CLEAR, REVIEW, UNDETERMINABLE = "clear", "review_required", "undeterminable"
NO_DECLARATION = "the server declares nothing"
NEW_HOST = "a destination is neither declared nor known"
BEFORE_CALLS = "reached before the first call, and no package infrastructure of a launcher"
UNKNOWN_SERVER = "<unknown>"
_TEXTS = "array<string>"


@dataclass(frozen=True)
class Disclosure:
    """verdict: one row; servers: a row each with sorted hosts by status; launcher: what is the package manager's."""

    verdict: DataFrame
    servers: DataFrame
    launcher: DataFrame


def piles(flows: DataFrame, declared: DataFrame | None, exclusions: DataFrame | None) -> DataFrame:
    """server, host, pile (launcher, pre_call, called), distinct; flows without a host have a null host.

    The launcher's are flows before calls, to package infrastructure, of a server that a launcher starts:
    all three, or the process reached out by itself. A class that a record carries wins over the list.
    """
    host = F.lower(F.trim(F.coalesce("dest_host", F.lit(""))))
    rows = flows.select(
        F.coalesce(F.nullif("server_id", F.lit("")), F.lit(UNKNOWN_SERVER)).alias("server"), F.nullif(host, F.lit("")).alias("host"), "phase", "dest_class"
    )
    listed = F.lit(False)
    if exclusions is not None:
        found = reports.listed_hosts(rows.filter("host IS NOT NULL"), "host", exclusions.select("suffix", F.lit("listed").alias("class")))
        rows = rows.join(found.select("host", F.lit(True).alias("listed")), "host", "left")
        listed = F.col("listed")
    launched = F.lit(False)
    if declared is not None:
        tools = declared.groupBy("server").agg(F.max(F.col("launch_tool").isin(*LAUNCHERS)).alias("launched"))
        rows = rows.join(tools, "server", "left")
        launched = F.coalesce("launched", F.lit(False))
    before = ~evidence.call_caused()
    pile = F.when(before & launched & evidence.package_infrastructure(listed), "launcher").when(before, "pre_call").otherwise("called")
    return rows.select("server", "host", pile.alias("pile"))


def check(flows: DataFrame, declared: DataFrame | None, exclusions: DataFrame | None = None) -> Disclosure:
    """declared: (server, hosts, known, basis, launch_tool), a row a server, or None where there is no declaration.

    Without declarations nothing can be called declared or new, so the verdict is that it can't be told. A server
    that is not in them has only new hosts, as no expectation is none that is met.
    """
    sorted_out = piles(flows, declared, exclusions)
    hostless = sorted_out.agg(F.count_if(F.col("host").isNull()).alias("connections_without_a_host"))
    hosts = sorted_out.filter("host IS NOT NULL").distinct()
    launcher = hosts.filter("pile = 'launcher'").groupBy("server").agg(F.array_sort(F.collect_list("host")).alias("hosts"))
    called = hosts.filter("pile = 'called'").select("server", "host")
    if declared is None:
        servers = called.groupBy("server").agg(F.array_sort(F.collect_list("host")).alias("observed"))
        return Disclosure(hostless.select(F.lit(UNDETERMINABLE).alias("verdict"), F.lit(None).cast("long").alias("servers_to_review"), "connections_without_a_host"), servers, launcher)
    named = declared.select("server", F.explode(F.concat(F.transform("hosts", lambda h: F.struct(F.lower(h).alias("suffix"), F.lit(0).alias("status"))), F.transform("known", lambda h: F.struct(F.lower(h).alias("suffix"), F.lit(1).alias("status"))))).alias("d"))
    each = called.withColumn("suffix", F.explode(host_suffixes(F.col("host"))))
    status = each.join(named.select("server", "d.suffix", "d.status"), ["server", "suffix"]).groupBy("server", "host").agg(F.min("status").alias("status"))
    judged = called.join(status, ["server", "host"], "left")
    lists = [F.array_sort(F.collect_list(F.when(c, F.col("host")))).alias(n) for n, c in (("declared", F.col("status") == 0), ("known", F.col("status") == 1), ("new", F.col("status").isNull()))]
    own = judged.groupBy("server").agg(*lists)
    early = hosts.filter("pile = 'pre_call'").groupBy("server").agg(F.array_sort(F.collect_list("host")).alias("pre_first_call"))
    known = declared.select("server", "basis").dropDuplicates(["server"]).withColumn("has", F.lit(True))
    servers = own.join(early, "server", "full_outer").join(known, "server", "left")
    empty = F.array().cast(_TEXTS)
    servers = servers.select("server", *[F.coalesce(c, empty).alias(c) for c in ("declared", "known", "new", "pre_first_call")], F.coalesce("has", F.lit(False)).alias("has"), "basis")
    reason = F.when(F.size("pre_first_call") > 0, BEFORE_CALLS).when((F.size("new") > 0) & ~F.col("has"), NO_DECLARATION).when(F.size("new") > 0, NEW_HOST)
    servers = servers.withColumn("reason", reason).withColumn("under_review", reason.isNotNull()).drop("has")
    review = servers.agg(F.count_if("under_review").alias("servers_to_review"))
    # Two results of one row each.
    verdict = review.crossJoin(hostless).select(F.when(F.col("servers_to_review") > 0, REVIEW).otherwise(CLEAR).alias("verdict"), "servers_to_review", "connections_without_a_host")
    return Disclosure(verdict, servers, launcher)
