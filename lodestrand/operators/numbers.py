"""The six numbers of a run. Every result is aggregate: no server, call or host id is in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import evidence
from lodestrand.operators import reports
from lodestrand.operators.distribution import distribution, per_call, zero_filled
from lodestrand.schema import CHANNELS, GRADES, NODE_CATEGORIES, OBSERVABILITY, OCCURRENCES, PROVENANCES, STRONG_GRADES
from lodestrand.sources.runs import Run


def _called(flows: DataFrame) -> DataFrame:
    return flows.filter(F.coalesce("call_id", F.lit("")) != "")


def _marked(flows: DataFrame, exclusions: DataFrame | None) -> DataFrame:
    """Flows with `infrastructure`: by the class they carry, else by the list."""
    if exclusions is None:
        return flows.withColumn("infrastructure", evidence.package_infrastructure(F.lit(False)))
    listed = reports.listed_hosts(flows, "dest_host", exclusions.select("suffix", F.lit("listed").alias("class"))).select(F.col("host").alias("dest_host"), F.lit(True).alias("_listed"))
    return flows.join(listed, "dest_host", "left").withColumn("infrastructure", evidence.package_infrastructure(F.col("_listed"))).drop("_listed")


def connections_per_call(run: Run, exclusions: DataFrame | None = None) -> DataFrame:
    """Number 1: figure, n, p50, p95, max; raw, distinct hosts, and without package infrastructure.

    Without a list the third figure is not there: no list and no such traffic are not the same.
    """
    flows = _marked(_called(run.flows), exclusions)
    caused = evidence.call_caused()
    kept = F.count_if(~F.col("infrastructure"))
    counted = per_call(run.calls, flows, "call_id", [F.count("counted").alias("raw"), F.countDistinct("dest_host").alias("hosts"), kept.alias("kept")], caused)
    rows = counted.selectExpr("stack(3, 'connections_raw', raw, 'distinct_hosts', hosts, 'excluding_package_infrastructure', kept) AS (figure, v)")
    if exclusions is None:
        rows = rows.filter("figure <> 'excluding_package_infrastructure'")
    return distribution(rows, "v", ["figure"])


def connection_counts(run: Run, exclusions: DataFrame | None = None) -> DataFrame:
    """What stands beside number 1: launcher flows, flows without a phase, flows on the list (null: no list)."""
    flows = _marked(run.flows, exclusions)
    listed = F.count_if("infrastructure") if exclusions is not None else F.lit(None).cast("long")
    return flows.agg(
        F.count_if(~evidence.call_caused()).alias("launcher_connections"),
        F.count_if(F.coalesce("phase", F.lit("")) == "").alias("flows_with_unrecorded_phase"),
        listed.alias("package_infrastructure_connections"),
    )


def domains_per_call(run: Run) -> DataFrame:
    """Number 2: n, p50, p95, max of the distinct destinations of a call."""
    return distribution(per_call(run.calls, _called(run.flows), "call_id", [F.countDistinct("dest_host").alias("v")], evidence.call_caused()), "v")


def _servers(run: Run) -> DataFrame:
    """A row for each server that was driven or seen, with what is known of it."""
    expecting = run.manifest.select(F.explode_outer("servers_expecting_egress").alias("server_id")).filter("server_id IS NOT NULL").distinct().withColumn("declared", F.lit(True))
    recorded = expecting.limit(1).count() > 0
    called = run.calls.groupBy("server_id").agg(F.max(F.coalesce("ok", F.lit(False))).alias("succeeded"))
    seen = run.flows.groupBy("server_id").agg(F.max("our_traceparent_present").alias("propagates"), F.max(evidence.call_caused()).alias("observed"))
    revisions = run.manifest.select(F.explode_outer("server_protocol_versions").alias("server_id", "revision"))
    rows = called.withColumn("driven", F.lit(True)).join(seen, "server_id", "full_outer").filter(F.coalesce("server_id", F.lit("")) != "")
    rows = rows.join(expecting, "server_id", "left").join(revisions, "server_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    expects = F.col("declared").isNotNull() if recorded else F.lit(True)
    state = F.when(flag("observed"), "proxy_observed").when(flag("succeeded") & expects, "egress_unobserved").otherwise("no_egress_expected")
    return rows.select("server_id", flag("driven").alias("driven"), flag("propagates").alias("propagates"), flag("observed").alias("observed"), F.coalesce(F.nullif("revision", F.lit("")), F.lit("unknown")).alias("revision"), state.alias("state"))


def observability(run: Run) -> DataFrame:
    """state, servers: how many servers the capture could see. Servers seen only before calls do not count."""
    rows = _servers(run).filter("driven OR observed")
    return zero_filled(rows.groupBy("state").agg(F.count("*").alias("servers")), "state", OBSERVABILITY, "servers")


def propagation(run: Run) -> DataFrame:
    """Number 3: by protocol revision and pooled (null), with the fraction of servers observed (null if none)."""
    rows = _servers(run)
    pooled = rows.rollup("revision").agg(
        F.count("*").alias("servers_total"),
        F.count_if("propagates").alias("servers_propagating"),
        F.count_if("observed").alias("servers_observed"),
        F.count_if(F.col("propagates") & F.col("observed")).alias("propagating_of_observed"),
    )
    return pooled.select("*", evidence.ratio(F.col("servers_propagating"), F.col("servers_total")).alias("fraction"), evidence.fraction(F.col("propagating_of_observed"), F.col("servers_observed")).alias("fraction_of_observed"))


def provenance_coverage(run: Run) -> DataFrame:
    """Number 4: matched bytes by channel, never only their sum, in one row."""
    seen = F.coalesce("body_observed", F.lit(False))
    sums = run.flows.agg(
        F.count("*").alias("flows_total"),
        F.count_if(F.size("matched_refs") > 0).alias("flows_with_context_match"),
        F.count_if(F.col("target_matched_bytes") > 0).alias("flows_with_target_match"),
        F.count_if(F.col("body_matched_bytes") > 0).alias("flows_with_body_match"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("target_matched_bytes", "body_matched_bytes")],
        *[F.coalesce(F.sum(F.when(seen, F.col(c))), F.lit(0)).alias(f"observed_{c}") for c in ("target_bytes", "body_bytes")],
    )
    total = (F.col("target_matched_bytes") + F.col("body_matched_bytes")).alias("matched_bytes_total")
    return sums.select("*", total, (F.col("observed_target_bytes") + F.col("observed_body_bytes")).alias("observed_bytes_total"), evidence.ratio(F.col("flows_with_context_match"), F.col("flows_total")).alias("fraction_flows_with_match"))


def claims(run: Run, claim: str) -> DataFrame:
    """provenance or occurrence, n: zero-filled; values outside the vocabulary stay."""
    domain = {"provenance": PROVENANCES, "occurrence": OCCURRENCES}[claim]
    return zero_filled(run.flows.groupBy(claim).agg(F.count("*").alias("n")), claim, domain)


def graded(run: Run, exclusions: DataFrame | None = None) -> DataFrame:
    """Flows with grade and reason: graded once, read by all views of number 5."""
    flows = _marked(run.flows, exclusions)
    ladder = evidence.grade(
        F.col("our_traceparent_present"), evidence.attributing_match(), F.col("active_calls_in_window"), evidence.attributing_candidates(),
        ~F.col("infrastructure"), F.col("has_time_and_pid"), evidence.call_caused(), F.col("candidate_token_count"),
    )
    rows = flows.withColumn("_g", ladder).select("*", "_g.grade", "_g.reason").drop("_g")
    return rows.withColumn("possible", evidence.call_caused()).withColumn("eligible", ~F.col("infrastructure")).withColumn("constant", F.col("constant_client_path"))


def grades(rows: DataFrame) -> DataFrame:
    return zero_filled(rows.groupBy("grade").agg(F.count("*").alias("n")), "grade", GRADES)


def reasons(rows: DataFrame) -> DataFrame:
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def channels(rows: DataFrame) -> DataFrame:
    matched = rows.filter(F.col("causal") & (F.col("causal_channel") != "none"))
    return zero_filled(matched.groupBy("causal_channel").agg(F.count("*").alias("n")), "causal_channel", CHANNELS[1:])


def windows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("active_calls_in_window", "grade").agg(F.count("*").alias("n"))


def discrimination(rows: DataFrame) -> DataFrame:
    """By window: flows, the most calls that told nothing apart, and containments that were refused."""
    refused = F.sum(F.greatest(F.lit(0), F.col("structural_contained") - F.col("structural_candidates")))
    return rows.filter("possible").groupBy("active_calls_in_window").agg(F.count("*").alias("flows"), F.max("non_discriminating_calls").alias("non_discriminating_calls"), refused.alias("contained_but_not_candidate"))


def instrument(rows: DataFrame) -> DataFrame:
    """Whether the structural matcher left a trace: state, contained calls, flows it attributed."""
    n = rows.agg(F.count("*").alias("flows"), F.coalesce(F.sum("structural_contained"), F.lit(0)).alias("contained"), F.count_if("structural_match").alias("matched"), F.count_if(F.col("active_calls_in_window") > 0).alias("called"))
    state = F.when(F.col("flows") == 0, "no_flows").when((F.col("contained") > 0) | (F.col("matched") > 0), "present").when(F.col("called") > 0, "absent").otherwise("no_calls_in_flight")
    return n.select(state.alias("state"), F.col("contained").alias("flows_where_a_call_was_contained"), F.col("matched").alias("flows_attributed_structurally"))


def attribution(rows: DataFrame, constant_list: bool = True) -> DataFrame:
    """Number 5's denominators; without the list of constant paths the content figures are null."""
    out = reports.denominators(rows)
    if constant_list:
        return out
    withheld = ("content", "content_fraction", "strong_content", "repaired_content_fraction")
    return out.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name in withheld else F.col(f.name) for f in out.schema])


def regime(rows: DataFrame) -> DataFrame:
    """How the run was driven, from its largest window: null when nothing was seen, and what a reader must know."""
    top = rows.agg(F.max("active_calls_in_window").alias("largest_window"))
    name = F.when(F.col("largest_window") > 1, "concurrent").when(F.col("largest_window").isNotNull(), "sequential")
    note = (
        F.when(F.col("largest_window") > 1, F.concat(F.lit("up to "), F.col("largest_window").cast("string"), F.lit(" calls were in flight: the grades are a measurement, without ground truth")))
        .when(F.col("largest_window").isNotNull(), "at most one call was in flight, so nothing could be told apart: the grades restate how the run was driven")
        .otherwise("no connection was seen, so no grade was given and the flows say nothing about how the run was driven")
    )
    return top.select("largest_window", name.alias("regime"), note.alias("note"))


def self_hostable(run: Run, lists: DataFrame) -> DataFrame:
    """Number 6: category, hosts and the fraction that could be hosted, over distinct destinations."""
    hosts = run.flows.filter(F.coalesce("dest_host", F.lit("")) != "").select("dest_host").distinct()
    named = reports.classified(hosts, "dest_host", lists).groupBy("class").agg(F.count("*").alias("hosts"))
    return _hostable(zero_filled(named, "class", NODE_CATEGORIES, "hosts"))


def self_hostable_carried(run: Run, order: str = "ts") -> DataFrame:
    """Number 6 of a run without host names: the last category that each destination carries."""
    named = run.flows.filter(F.coalesce("dest_host", F.lit("")) != "").groupBy("dest_host").agg(F.max_by("node_category", order).alias("class"))
    return _hostable(zero_filled(named.groupBy("class").agg(F.count("*").alias("hosts")), "class", NODE_CATEGORIES, "hosts"))


def _hostable(counts: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    whole = Window.partitionBy()
    own: Column = F.sum(F.when(F.col("class").isin("local", "self_hostable"), F.col("hosts")).otherwise(0)).over(whole)
    return counts.withColumn("fraction", evidence.ratio(own, F.sum("hosts").over(whole)))


def driving(run: Run) -> DataFrame:
    """Calls by wave size (unrecorded for 0): how many went well, with arguments, and the noise."""
    size = F.when(F.coalesce("wave_size", F.lit(0)) == 0, "unrecorded").otherwise(F.col("wave_size").cast("string"))
    return run.calls.groupBy(size.alias("wave_size")).agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("errored"), F.count_if("args_present").alias("with_arguments"), F.sum("stdout_noise_lines").alias("stdout_noise_lines"))


def phases(run: Run) -> DataFrame:
    phase = F.coalesce(F.nullif("phase", F.lit("")), F.lit("unrecorded"))
    return run.flows.groupBy(phase.alias("phase")).agg(F.count("*").alias("flows"))


_LONG = "number int, figure string, key string, value double"


def _long(number: int, rows: DataFrame, figures: dict[str, Column | str], key: Column | None = None) -> DataFrame:
    """A row (number, figure, key, value) for each figure of each row; key is empty where a figure has no parts."""
    cells = F.array(*[F.struct(F.lit(name).alias("figure"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("value")) for name, c in figures.items()])
    parts = key if key is not None else F.lit("")
    return rows.select(F.lit(number).alias("number"), F.coalesce(parts.cast("string"), F.lit("")).alias("key"), F.explode(cells).alias("c")).select("number", "c.figure", "key", "c.value")


def _spread(number: int, rows: DataFrame, figure: Column) -> DataFrame:
    """The statistics of distributions as parts of a figure each."""
    cells = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in ("n", "p50", "p95", "max")])
    return rows.select(F.lit(number).alias("number"), figure.alias("figure"), F.explode(cells).alias("c")).select("number", "figure", "c.key", "c.value")


def number_one(run: Run, exclusions: DataFrame | None = None) -> DataFrame:
    """Without a list the figure that needs one has a null, not a number."""
    names = ("launcher_connections", "flows_with_unrecorded_phase", "package_infrastructure_connections")
    out = _spread(1, connections_per_call(run, exclusions), F.col("figure")).unionByName(_long(1, connection_counts(run, exclusions), {n: n for n in names}))
    if exclusions is None:
        withheld = run.manifest.sparkSession.createDataFrame([(1, "excluding_package_infrastructure", "", None)], _LONG)
        out = out.unionByName(withheld)
    return out


def number_two(run: Run) -> DataFrame:
    return _spread(2, domains_per_call(run), F.lit("distinct_domains"))


def number_three(run: Run) -> DataFrame:
    names = ("servers_total", "servers_propagating", "servers_observed", "propagating_of_observed", "fraction", "fraction_of_observed")
    return _long(3, propagation(run), {n: n for n in names}, F.coalesce("revision", F.lit("pooled"))).unionByName(_long(3, observability(run), {"observability": "servers"}, F.col("state")))


def number_four(run: Run) -> DataFrame:
    coverage = provenance_coverage(run)
    out = _long(4, coverage, {n: n for n in coverage.columns})
    for claim in ("provenance", "occurrence"):
        out = out.unionByName(_long(4, claims(run, claim), {f"{claim}_counts": "n"}, F.col(claim)))
    return out


def number_five(run: Run, exclusions: DataFrame | None = None, constant_list: bool = True) -> DataFrame:
    """The four views, the denominators, discrimination by window, the instrument and the regime, graded once."""
    rows = graded(run, exclusions).select(
        "grade", "reason", "possible", "eligible", "constant", "causal", "causal_channel", "active_calls_in_window",
        "structural_match", "structural_contained", "structural_candidates", "non_discriminating_calls",
    )
    shares = attribution(rows, constant_list)
    told = discrimination(rows)
    window = F.col("active_calls_in_window").cast("string")
    concurrent = F.when(F.col("regime") == "sequential", 1).when(F.col("regime") == "concurrent", 0)
    return (
        _long(5, grades(rows), {"attribution_grades": "n"}, F.col("grade"))
        .unionByName(_long(5, reasons(rows), {"attribution_reasons": "n"}, F.col("reason")))
        .unionByName(_long(5, channels(rows), {"content_match_by_channel": "n"}, F.col("causal_channel")))
        .unionByName(_long(5, windows(rows), {"grades_by_window_size": "n"}, F.concat(window, F.lit(" "), F.col("grade"))))
        .unionByName(_long(5, shares, {n: n for n in shares.columns}))
        .unionByName(_long(5, told, {n: n for n in told.columns[1:]}, window))
        .unionByName(_long(5, instrument(rows), {n: n for n in ("flows_where_a_call_was_contained", "flows_attributed_structurally")}))
        .unionByName(_long(5, regime(rows), {"max_active_calls_in_window": "largest_window", "sequential_driving": concurrent}))
    )


def number_six(run: Run, lists: DataFrame | None) -> DataFrame:
    """lists: (suffix, class), or None for a run that carries the categories."""
    rows = self_hostable(run, lists) if lists is not None else self_hostable_carried(run)
    whole = rows.agg(F.sum("hosts").alias("distinct_nodes"), F.max("fraction").alias("fraction"))
    return _long(6, rows, {"category_counts": "hosts"}, F.col("class")).unionByName(_long(6, whole, {"distinct_nodes": "distinct_nodes", "selfhostable_fraction": "fraction"}))


def driving_figures(run: Run) -> DataFrame:
    """Number 0: what was driven, which is a denominator and no finding."""
    by_size = driving(run)
    whole = by_size.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls_total"), F.coalesce(F.sum("errored"), F.lit(0)).alias("calls_errored"))
    figures = {"calls_total": "calls_total", "calls_errored": "calls_errored", "error_fraction": evidence.ratio(F.col("calls_errored"), F.col("calls_total"))}
    names = ("calls", "ok", "errored", "with_arguments", "stdout_noise_lines")
    return _long(0, whole, figures).unionByName(_long(0, by_size, {n: n for n in names}, F.col("wave_size"))).unionByName(_long(0, phases(run), {"flows_by_lifecycle_phase": "flows"}, F.col("phase")))


def all_numbers(run: Run, lists: DataFrame | None, exclusions: DataFrame | None = None, constant_list: bool = True) -> DataFrame:
    """(number, figure, key, value): the driving summary and the six numbers of a run in one table."""
    parts = [driving_figures(run), number_one(run, exclusions), number_two(run), number_three(run), number_four(run), number_five(run, exclusions, constant_list), number_six(run, lists)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def document(run: Run, figures: DataFrame) -> DataFrame:
    """One row, `figures`: a run's figures as one JSON text, fractions to four places, with what was not measured as null.

    {run_id, created, pass, numbers: {number: {figure: {key: value}}}}. An unlabelled pass is named so.
    """
    value = F.round("value", 4)

    def entries(key: str, value: str) -> Column:
        """A map with its keys in order; the values are maps, which have none."""
        ordered = lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0)
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias(key), value)), ordered))

    by_figure = figures.groupBy("number", "figure").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", value.alias("value"))))).alias("parts"))
    by_number = by_figure.groupBy("number").agg(entries("figure", "parts").alias("figures"))
    whole = by_number.agg(entries("number", "figures").alias("numbers"))
    # Both sides are one row.
    head = run.manifest.select("run_id", "created", F.coalesce(F.nullif("pass_name", F.lit("")), F.lit("unlabelled")).alias("pass"))
    return head.crossJoin(whole).select(F.to_json(F.struct("run_id", "created", "pass", "numbers"), {"ignoreNullFields": "false"}).alias("figures"))


def instrument_recall(sent: DataFrame, flows: DataFrame) -> DataFrame:
    """Connections sent and seen: of each host no more count as seen than were sent. Failed ones are neither."""
    truth = sent.filter(F.coalesce("error", F.lit("")) == "").groupBy("dest_host").agg(F.count("*").alias("sent"))
    seen = flows.groupBy("dest_host").agg(F.count("*").alias("seen"))
    both = truth.join(seen, "dest_host", "left")
    n = both.agg(F.coalesce(F.sum("sent"), F.lit(0)).alias("sent"), F.coalesce(F.sum(F.least("sent", F.coalesce("seen", F.lit(0)))), F.lit(0)).alias("observed"), F.count_if(F.col("seen").isNull()).alias("hosts_never_observed"))
    return n.withColumn("recall", evidence.ratio(F.col("observed"), F.col("sent")))


def instrument_precision(claimed: DataFrame) -> DataFrame:
    """claimed: cell, grade, claimed_call, expected_call, provenance, fragment_present, in_matched_channel.

    One row a cell and one for all (null): strong claims right and wrong, provenance claimed where nothing
    was sent, and strong claims in channels that are not read.
    """
    strong = F.col("grade").isin(*STRONG_GRADES) & (F.coalesce("claimed_call", F.lit("")) != "")
    right = F.col("claimed_call").eqNullSafe(F.col("expected_call"))
    out = claimed.rollup("cell").agg(
        F.count("*").alias("flows"),
        F.count_if(strong & right).alias("strong_correct"),
        F.count_if(strong & ~right).alias("false_strong"),
        F.count_if(~F.col("fragment_present")).alias("nothing_sent"),
        F.count_if(~F.col("fragment_present") & F.col("provenance").isin("arguments", "context", "both")).alias("false_provenance"),
        F.count_if(~F.col("in_matched_channel") & F.col("fragment_present")).alias("unread_channel"),
        F.count_if(~F.col("in_matched_channel") & F.col("fragment_present") & F.col("grade").isin(*STRONG_GRADES)).alias("unread_but_strong"),
    )
    return out.withColumn("precision", evidence.ratio(F.col("strong_correct"), F.col("strong_correct") + F.col("false_strong"))).withColumn("false_provenance_rate", evidence.ratio(F.col("false_provenance"), F.col("nothing_sent")))
