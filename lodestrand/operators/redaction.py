"""Redacting a run: servers, tools, calls and destinations under labels, errors without their messages.

The relabelling is injective, so counts and comparisons of sets stay what they were.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.evidence import scrubbed_error
from lodestrand.operators import reports
from lodestrand.sources.runs import Run, RunError

# Labels of the redacted records, and the first address of the block set aside for documentation.
LOOPBACK = ("localhost", "127.0.0.1", "::1")
LOOPBACK_LABEL, PACKAGE_LABEL, OTHER_LABEL = "loopback-proxy", "package-registry", "third-party"
ADDRESSES, FIRST_ADDRESS = "192.0.2.", 10


def first_seen_labels(rows: DataFrame, key: str, cls: str, order: str) -> DataFrame:
    """(key, class, label): each key once, labelled class-0, class-1 and so on by where it is first seen.

    Classes are few; a class's keys are put in order in one task, which sees a row a key and not the rows.
    """
    first = rows.groupBy(key, F.col(cls).alias("class")).agg(F.min(order).alias("_first"))
    place = F.row_number().over(Window.partitionBy("class").orderBy("_first", key)) - 1
    return first.withColumn("label", F.concat("class", F.lit("-"), place.cast("string"))).drop("_first")


def dense_index(rows: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """Add `name`: name-0, name-1 and so on for the sorted keys of each group."""
    place = F.row_number().over(Window.partitionBy("_group").orderBy("_key")) - 1
    named = rows.select(F.col(group).alias("_group"), F.col(key).alias("_key")).distinct().withColumn(name, F.concat(F.lit(f"{name}-"), place.cast("string")))
    return rows.join(named, F.col(group).eqNullSafe(F.col("_group")) & F.col(key).eqNullSafe(F.col("_key"))).drop("_group", "_key")


@dataclass(frozen=True)
class Labels:
    """What stands for what: servers (server_id, label), hosts (host, class, label, address), tools (server_id, tool_name, label)."""

    servers: DataFrame
    hosts: DataFrame
    tools: DataFrame


def labels(run: Run, exclusions: DataFrame | None = None) -> Labels:
    """The maps of a run. Servers by the manifest's order, then by name; hosts by where they are first seen."""
    listed = run.manifest.select(F.posexplode_outer("server_ids").alias("at", "server_id"))
    seen = run.calls.select("server_id").unionByName(run.flows.select("server_id")).withColumn("at", F.lit(None).cast("int"))
    each = listed.select("at", "server_id").unionByName(seen.select("at", "server_id")).filter(F.coalesce("server_id", F.lit("")) != "")
    order = each.groupBy("server_id").agg(F.min("at").alias("at"))
    number = F.row_number().over(Window.orderBy(F.col("at").asc_nulls_last(), "server_id")) - 1
    servers = order.select("server_id", F.concat(F.lit("server-"), number.cast("string")).alias("label"))

    hosts = run.flows.select(F.lower(F.trim("dest_host")).alias("host"), "ts").filter("host <> ''")
    known = reports.listed_hosts(hosts, "host", exclusions.select("suffix", F.lit("listed").alias("class"))) if exclusions is not None else None
    cls = F.lit(OTHER_LABEL)
    if known is not None:
        hosts = hosts.join(known.select("host", F.lit(True).alias("listed")), "host", "left")
        cls = F.when(F.col("listed"), PACKAGE_LABEL).otherwise(OTHER_LABEL)
    hosts = hosts.withColumn("class", F.when(F.col("host").isin(*LOOPBACK), LOOPBACK_LABEL).otherwise(cls))
    named = first_seen_labels(hosts, "host", "class", "ts")
    place = F.row_number().over(Window.orderBy("label")) - 1 + FIRST_ADDRESS
    local = F.col("class") == LOOPBACK_LABEL
    # All loopback names are one destination; addresses beyond the block go on in the next octet, so they stay apart.
    address = F.when(local, "127.0.0.1").when(place < 256, F.concat(F.lit(ADDRESSES), place.cast("string")))
    address = address.otherwise(F.concat(F.lit(ADDRESSES), F.floor(place / 256).cast("string"), F.lit("-"), (place % 256).cast("string")))
    named = named.withColumn("label", F.when(local, LOOPBACK_LABEL).otherwise(F.col("label"))).withColumn("address", address)
    tools = dense_index(run.calls.select("server_id", "tool_name").distinct(), "server_id", "tool_name", "tool").withColumnRenamed("tool", "label")
    return Labels(servers, named, tools)


def _relabelled(rows: DataFrame, servers: DataFrame) -> DataFrame:
    """Server and call ids under the server's label; a call id keeps what follows its server's name."""
    named = rows.join(servers.select("server_id", F.col("label").alias("_server")), "server_id", "left")
    own = F.startswith("call_id", F.concat("server_id", F.lit("-")))
    rest = F.substring(F.col("call_id"), F.char_length("server_id") + 1, F.char_length("call_id"))
    call: Column = F.when(own & F.col("_server").isNotNull(), F.concat("_server", rest)).otherwise(F.col("call_id"))
    return named.withColumn("call_id", call).withColumn("server_id", F.coalesce("_server", "server_id")).drop("_server")


def redact(run: Run, run_id: str, exclusions: DataFrame | None = None, redaction_of: str | None = None) -> Run:
    """The run under labels. A run that is redacted already is refused: its labels would be classed as hosts."""
    head = run.manifest.first()
    if (head["notes"] or "").startswith("redacted"):
        raise RunError("a redacted run can't be redacted again; redact the capture")
    found = labels(run, exclusions)
    hosts = found.hosts.select(F.col("host").alias("_host"), F.col("label").alias("_label"), F.col("address").alias("_address"), F.col("class").alias("_class"))
    kind = F.when(F.col("_class") == LOOPBACK_LABEL, "local").when(F.col("_class") == PACKAGE_LABEL, "package_infrastructure").when(F.col("_class").isNotNull(), "third_party").otherwise("")
    flows = run.flows.join(hosts, F.lower(F.trim(run.flows["dest_host"])) == F.col("_host"), "left")
    flows = flows.withColumn("dest_class", kind).withColumn("dest_host", F.coalesce("_label", F.lit(""))).withColumn("dest_ip", F.coalesce("_address", F.lit("")))
    flows = _relabelled(flows, found.servers).withColumn("run_id", F.lit(run_id)).select(*run.flows.columns)
    calls = dense_index(run.calls, "server_id", "tool_name", "tool").withColumn("tool_name", F.col("tool")).withColumn("error", scrubbed_error(F.col("error")))
    calls = _relabelled(calls, found.servers).withColumn("run_id", F.lit(run_id)).select(*run.calls.columns)
    # A manifest is one row and names the run's servers, which are few.
    names = {r["server_id"]: r["label"] for r in found.servers.collect()}
    new = head.asDict(recursive=True)
    new |= {"run_id": run_id, "server_ids": [names.get(s, s) for s in head["server_ids"] or []], "notes": f"redacted from {redaction_of or head['run_id']}", "tool_versions": {}}
    new["server_protocol_versions"] = {names.get(s, s): v for s, v in (head["server_protocol_versions"] or {}).items()}
    new["servers_expecting_egress"] = [names.get(s, s) for s in head["servers_expecting_egress"] or []]
    new["credential_presence"] = {names.get(s, s): {f"secret-{i}": v for i, v in enumerate(x.values())} for s, x in (head["credential_presence"] or {}).items()}
    spark = run.manifest.sparkSession
    manifest = spark.range(1).select(F.from_json(F.lit(json.dumps(new)), run.manifest.schema).alias("m")).select("m.*")
    return Run(manifest, calls, flows)
