"""The six numbers of a run: orders as calls, line items as the flows that they cause.

The run is made from the tables by expressions; each number's SQL states its rule anew over the same
expressions, in `_RUN`.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import numbers
from lodestrand.plans.registry import Query, table
from lodestrand.schema import CALLS, FLOWS, GRADES, MANIFEST, NODE_CATEGORIES, OBSERVABILITY, OCCURRENCES, PROVENANCES, REASONS
from lodestrand.sources.runs import Run

#: Servers with a known protocol revision, and servers that are expected to reach out, by number.
REVISIONS = {n: ("2024-11-05", "2026-07-28", "")[n % 3] for n in range(0, 55, 2)}
EXPECTING = tuple(range(0, 70, 3))
#: Suffixes of the lists.
INFRASTRUCTURE, SELF_HOSTABLE = "registry.example.net", "example.org"

_CALLS = {
    "run_id": "'r'",
    "server_id": "concat('server-', CAST(o_custkey % 50 AS VARCHAR(20)))",
    "call_id": "CAST(o_orderkey AS VARCHAR(20))",
    "tool_name": "'tool'",
    "args_present": "o_totalprice > 100000",
    "traceparent": "''",
    "ok": "o_orderstatus <> 'F'",
    "error": "''",
    "stdout_noise_lines": "o_orderkey % 3",
    "wave_size": "CASE WHEN o_orderpriority LIKE '4%' THEN 0 ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END",
}
_FLOWS = {
    "run_id": "'r'",
    "server_id": "CASE WHEN l_linenumber = 5 THEN '' ELSE concat('server-', CAST(l_suppkey % 60 AS VARCHAR(20))) END",
    "call_id": "CASE WHEN l_linenumber = 6 THEN NULL WHEN l_linenumber = 7 THEN '' ELSE CAST(l_orderkey AS VARCHAR(20)) END",
    "ts": "CAST(l_orderkey AS DOUBLE) * 10 + l_linenumber",
    "dest_host": f"CASE WHEN l_partkey % 23 = 0 THEN '' WHEN l_partkey % 29 = 0 THEN '10.0.0.7' ELSE concat('h', CAST(l_partkey % 40 AS VARCHAR(20)), CASE l_partkey % 3 WHEN 0 THEN '.{INFRASTRUCTURE}' WHEN 1 THEN '.{SELF_HOSTABLE}' ELSE '.example.com' END) END",
    "dest_ip": "''",
    "scheme": "'https'",
    "method": "'GET'",
    "body_observed": "l_linestatus = 'O'",
    "our_traceparent_present": "l_quantity >= 49",
    "target_bytes": "CAST(l_quantity * 10 AS BIGINT)",
    "target_matched_bytes": "CASE WHEN l_discount >= 0.085 THEN CAST(l_quantity AS BIGINT) ELSE 0 END",
    "body_bytes": "CAST(l_quantity * 7 AS BIGINT)",
    "body_matched_bytes": "CASE WHEN l_tax >= 0.075 THEN CAST(l_quantity AS BIGINT) ELSE 0 END",
    "causal": "l_discount >= 0.065",
    "causal_channel": "CASE WHEN l_discount < 0.065 THEN 'none' WHEN l_linenumber % 3 = 0 THEN 'both' WHEN l_linenumber % 3 = 1 THEN 'target' ELSE 'body' END",
    "node_category": "CASE WHEN l_partkey % 3 = 1 THEN 'self_hostable' ELSE 'remote_leaf' END",
    "has_time_and_pid": "l_linestatus = 'O'",
    "occurrence": "CASE WHEN l_linestatus = 'O' THEN 'observed' ELSE 'connection_only' END",
    "provenance": "CASE WHEN l_linestatus <> 'O' THEN 'unknown' WHEN l_tax >= 0.075 THEN 'context' WHEN l_discount >= 0.085 THEN 'odd' ELSE 'none' END",
    "active_calls_in_window": "l_linenumber % 4",
    "matching_calls_in_window": "l_suppkey % 3",
    "structural_match": "l_discount >= 0.045 AND l_tax >= 0.025",
    "structural_contained": "l_suppkey % 4",
    "structural_candidates": "l_partkey % 3",
    "non_discriminating_calls": "l_partkey % 5",
    "candidate_token_count": "l_partkey % 4",
    "constant_client_path": "l_partkey % 7 = 0",
    "phase": "CASE WHEN l_returnflag = 'R' AND l_linenumber <= 2 THEN 'launcher' WHEN l_returnflag = 'R' AND l_linenumber = 3 THEN 'handshake' WHEN l_linenumber = 4 THEN '' WHEN l_linestatus = 'F' THEN 'drained' ELSE 'driving' END",
    "dest_class": "CASE l_suppkey % 9 WHEN 0 THEN 'package_infrastructure' WHEN 1 THEN 'third_party' ELSE '' END",
}


def run_of_tables(spark: SparkSession, sf_dir: str) -> Run:
    """Calls, flows and a manifest made of orders and line items."""

    def records(name: str, columns: dict[str, str], schema) -> DataFrame:
        rows = table(spark, sf_dir, name).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()], *(["CASE WHEN l_tax >= 0.065 THEN array('ref') ELSE array() END AS matched_refs"] if "ts" in columns else []))
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

    head = {"run_id": "r", "created": "2026", "pass_name": "concurrent", "server_ids": [], "server_protocol_versions": {f"server-{n}": v for n, v in REVISIONS.items()}, "servers_expecting_egress": [f"server-{n}" for n in EXPECTING]}
    manifest = spark.range(1).select(F.from_json(F.lit(json.dumps(head)), MANIFEST).alias("m")).select("m.*")
    return Run(manifest, records("orders", _CALLS, CALLS), records("lineitem", _FLOWS, FLOWS))


def _lists(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(SELF_HOSTABLE, "self_hostable")], "suffix string, class string")


def _exclusions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(INFRASTRUCTURE,)], "suffix string")


def _values(rows) -> str:
    return ", ".join(f"({', '.join(repr(x) for x in row)})" for row in rows)


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


_RUN = f"""
calls AS (SELECT {_select(_CALLS)} FROM orders),
flows AS (SELECT {_select(_FLOWS)}, CASE WHEN l_tax >= 0.065 THEN 1 ELSE 0 END AS n_refs FROM lineitem),
marked AS (
  SELECT *, phase NOT IN ('launcher', 'handshake') AS possible,
         CASE WHEN dest_class <> '' THEN dest_class = 'package_infrastructure' ELSE dest_host = '{INFRASTRUCTURE}' OR dest_host LIKE '%.{INFRASTRUCTURE}' END AS infra FROM flows
)
"""

_ZERO_CALLS = "SELECT count(*) FROM calls WHERE call_id NOT IN (SELECT call_id FROM flows WHERE call_id IS NOT NULL AND call_id <> '')"


def _stats(number: int, figure: str, values: str) -> str:
    """Statistics of a query of one column v, read off the sorted values at their nearest ranks."""
    rank = lambda p: f"coalesce(max(v) FILTER (WHERE r = CAST(ceil({p} * n / 100.0) AS BIGINT)), 0)"
    cells = f"[('n', CAST(count(*) AS DOUBLE)), ('p50', {rank(50)}), ('p95', {rank(95)}), ('max', coalesce(max(v), 0))]"
    return f"SELECT {number}, '{figure}', c[1], CAST(c[2] AS DOUBLE) FROM (SELECT unnest({cells}) AS c FROM (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS n FROM ({values})))"


def _with_zeros(value: str, where: str = "possible") -> str:
    return f"SELECT {value} AS v FROM marked WHERE {where} AND call_id <> '' GROUP BY call_id UNION ALL SELECT 0 FROM range(CAST(({_ZERO_CALLS}) AS BIGINT))"


def _one(number: int, figures: dict[str, str], source: str) -> str:
    """Figures without parts, from a query of one row."""
    return " UNION ALL ".join(f"SELECT {number}, '{name}', '', CAST({e} AS DOUBLE) FROM {source}" for name, e in figures.items())


def _counts(number: int, figure: str, key: str, source: str, domain=(), where: str = "true") -> str:
    """Counts by key over a source, 0 for what of the domain it lacks."""
    counted = f"SELECT {key} AS k, count(*) AS n FROM {source} WHERE {where} GROUP BY 1"
    if not domain:
        return f"SELECT {number}, '{figure}', CAST(k AS VARCHAR), CAST(n AS DOUBLE) FROM ({counted})"
    return f"SELECT {number}, '{figure}', coalesce(d.k, c.k), CAST(coalesce(n, 0) AS DOUBLE) FROM (VALUES {_values((x,) for x in domain)}) d(k) FULL JOIN ({counted}) c ON d.k = c.k"


N1 = " UNION ALL ".join([
    _stats(1, "connections_raw", _with_zeros("count(*)")),
    _stats(1, "distinct_hosts", _with_zeros("count(DISTINCT dest_host)")),
    _stats(1, "excluding_package_infrastructure", _with_zeros("count(*) FILTER (WHERE NOT infra)")),
    _one(1, {"launcher_connections": "count(*) FILTER (WHERE NOT possible)", "flows_with_unrecorded_phase": "count(*) FILTER (WHERE phase = '')", "package_infrastructure_connections": "count(*) FILTER (WHERE infra)"}, "marked"),
])
N2 = _stats(2, "distinct_domains", _with_zeros("count(DISTINCT dest_host)"))

_SERVERS = f"""
revisions(server_id, revision) AS (VALUES {', '.join(f"('server-{n}', '{v}')" for n, v in REVISIONS.items())}),
expecting(server_id) AS (VALUES {', '.join(f"('server-{n}')" for n in EXPECTING)}),
servers AS (
  SELECT s.server_id, coalesce(nullif(r.revision, ''), 'unknown') AS revision, s.server_id IN (SELECT server_id FROM calls) AS driven,
         s.server_id IN (SELECT server_id FROM flows WHERE our_traceparent_present) AS propagates, s.server_id IN (SELECT server_id FROM marked WHERE possible) AS observed,
         s.server_id IN (SELECT server_id FROM calls WHERE ok) AND s.server_id IN (SELECT server_id FROM expecting) AS missed
  FROM (SELECT server_id FROM calls UNION SELECT server_id FROM flows WHERE server_id <> '') s LEFT JOIN revisions r ON s.server_id = r.server_id
),
segments AS (SELECT revision, propagates, observed FROM servers UNION ALL SELECT 'pooled', propagates, observed FROM servers),
rates AS (SELECT revision, count(*) AS servers_total, count(*) FILTER (WHERE propagates) AS servers_propagating, count(*) FILTER (WHERE observed) AS servers_observed, count(*) FILTER (WHERE propagates AND observed) AS propagating_of_observed FROM segments GROUP BY 1)
"""
_RATES = {
    **{n: n for n in ("servers_total", "servers_propagating", "servers_observed", "propagating_of_observed")},
    "fraction": "servers_propagating::DOUBLE / servers_total",
    "fraction_of_observed": "CASE WHEN servers_observed > 0 THEN propagating_of_observed::DOUBLE / servers_observed END",
}
N3 = " UNION ALL ".join(f"SELECT 3, '{name}', revision, CAST({e} AS DOUBLE) FROM rates" for name, e in _RATES.items()) + " UNION ALL " + _counts(
    3, "observability", "CASE WHEN observed THEN 'proxy_observed' WHEN missed THEN 'egress_unobserved' ELSE 'no_egress_expected' END", "servers", OBSERVABILITY, "driven OR observed"
)

_COVERAGE = {
    "flows_total": "count(*)",
    "flows_with_context_match": "count(*) FILTER (WHERE n_refs > 0)",
    "flows_with_target_match": "count(*) FILTER (WHERE target_matched_bytes > 0)",
    "flows_with_body_match": "count(*) FILTER (WHERE body_matched_bytes > 0)",
    "target_matched_bytes": "coalesce(sum(target_matched_bytes), 0)",
    "body_matched_bytes": "coalesce(sum(body_matched_bytes), 0)",
    "observed_target_bytes": "coalesce(sum(target_bytes) FILTER (WHERE body_observed), 0)",
    "observed_body_bytes": "coalesce(sum(body_bytes) FILTER (WHERE body_observed), 0)",
    "matched_bytes_total": "coalesce(sum(target_matched_bytes) + sum(body_matched_bytes), 0)",
    "observed_bytes_total": "coalesce(sum(target_bytes + body_bytes) FILTER (WHERE body_observed), 0)",
    "fraction_flows_with_match": "CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE n_refs > 0)::DOUBLE / count(*) ELSE 0 END",
}
N4 = " UNION ALL ".join([_one(4, _COVERAGE, "flows"), _counts(4, "provenance_counts", "provenance", "flows", PROVENANCES), _counts(4, "occurrence_counts", "occurrence", "flows", OCCURRENCES)])


def _reason(key: str) -> str:
    text = "'" + REASONS[key].replace("'", "''") + "'"
    for name in ("active", "matching"):
        text = text.replace("{" + name + "}", f"' || CAST({name} AS VARCHAR) || '")
    return text


_LADDER = (
    ("NOT possible", "UNATTRIBUTED", "pre_launch"),
    ("our_traceparent_present", "TRACE_PROPAGATED", "trace"),
    ("match AND candidate_token_count = 1", "CONTENT_AMBIGUOUS", "one_token"),
    ("match AND active > 1 AND matching = 1", "CONTENT_UNIQUE", "unique"),
    ("match AND active > 1", "CONTENT_AMBIGUOUS", "ambiguous"),
    ("match", "CONTENT_MATCH_UNCONTESTED", "uncontested"),
    ("infra", "UNATTRIBUTED", "ineligible"),
    ("has_time_and_pid AND active = 1", "TEMPORAL_ONLY", "temporal"),
    ("has_time_and_pid AND active > 1", "UNATTRIBUTED", "temporal_set"),
    ("has_time_and_pid", "UNATTRIBUTED", "no_evidence"),
)
_GRADED = f"""
evidenced AS (
  SELECT *, active_calls_in_window AS active, structural_match OR (causal AND structural_contained = 0 AND structural_candidates = 0) AS match,
         CASE WHEN structural_match THEN structural_candidates ELSE matching_calls_in_window END AS matching FROM marked
),
graded AS (
  SELECT *, CASE {' '.join(f"WHEN {c} THEN '{g}'" for c, g, _ in _LADDER)} ELSE 'UNATTRIBUTED' END AS grade,
         CASE {' '.join(f"WHEN {c} THEN {_reason(r)}" for c, _, r in _LADDER)} ELSE {_reason('unreadable')} END AS reason FROM evidenced
),
tallied AS (
  SELECT *, grade IN ('TRACE_PROPAGATED', 'CONTENT_UNIQUE') AS is_strong, possible AND NOT infra AS is_att, possible AND NOT infra AND NOT constant_client_path AS is_content FROM graded
),
shares AS (
  SELECT count(*) AS flows, count(*) FILTER (WHERE is_strong) AS strong, count(*) FILTER (WHERE is_att) AS attributable, count(*) FILTER (WHERE is_content) AS content,
         count(*) FILTER (WHERE is_att AND is_strong) AS strong_attributable, count(*) FILTER (WHERE is_content AND is_strong) AS strong_content FROM tallied
)
"""
_SHARES = {
    **{n: n for n in ("flows", "strong", "attributable", "content", "strong_attributable", "strong_content")},
    "raw_fraction": "CASE WHEN flows > 0 THEN strong::DOUBLE / flows ELSE 0 END",
    "attributable_fraction": "CASE WHEN attributable > 0 THEN strong::DOUBLE / attributable END",
    "content_fraction": "CASE WHEN content > 0 THEN strong::DOUBLE / content END",
    "repaired_content_fraction": "CASE WHEN content > 0 THEN strong_content::DOUBLE / content END",
}
_TOLD = {"flows": "count(*)", "non_discriminating_calls": "max(non_discriminating_calls)", "contained_but_not_candidate": "sum(greatest(0, structural_contained - structural_candidates))"}
N5 = " UNION ALL ".join([
    _counts(5, "attribution_grades", "grade", "graded", GRADES),
    _counts(5, "attribution_reasons", "reason", "graded"),
    _counts(5, "content_match_by_channel", "causal_channel", "graded", ("target", "body", "both"), "causal AND causal_channel <> 'none'"),
    _counts(5, "grades_by_window_size", "active || ' ' || grade", "graded"),
    _one(5, _SHARES, "shares"),
    *[f"SELECT 5, '{name}', CAST(active AS VARCHAR), CAST({e} AS DOUBLE) FROM graded WHERE possible GROUP BY active" for name, e in _TOLD.items()],
    _one(5, {"flows_where_a_call_was_contained": "coalesce(sum(structural_contained), 0)", "flows_attributed_structurally": "count(*) FILTER (WHERE structural_match)"}, "graded"),
    _one(5, {"max_active_calls_in_window": "max(active)", "sequential_driving": "CASE WHEN max(active) > 1 THEN 0 WHEN max(active) IS NOT NULL THEN 1 END"}, "graded"),
])

_NODES = f"""
nodes AS (
  SELECT dest_host, CASE WHEN dest_host = '10.0.0.7' THEN 'local' WHEN dest_host = '{SELF_HOSTABLE}' OR dest_host LIKE '%.{SELF_HOSTABLE}' THEN 'self_hostable' ELSE 'remote_leaf' END AS category
  FROM (SELECT DISTINCT dest_host FROM flows WHERE dest_host <> '')
),
carried AS (SELECT dest_host, arg_max(node_category, ts) AS category FROM flows WHERE dest_host <> '' GROUP BY 1)
"""


def _n6(nodes: str) -> str:
    share = "CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE category IN ('local', 'self_hostable'))::DOUBLE / count(*) ELSE 0 END"
    return _counts(6, "category_counts", "category", nodes, NODE_CATEGORIES) + " UNION ALL " + _one(6, {"distinct_nodes": "count(*)", "selfhostable_fraction": share}, nodes)


_SIZE = "CASE WHEN wave_size = 0 THEN 'unrecorded' ELSE CAST(wave_size AS VARCHAR) END"
_DRIVEN = {"calls": "count(*)", "ok": "count(*) FILTER (WHERE ok)", "errored": "count(*) FILTER (WHERE NOT ok)", "with_arguments": "count(*) FILTER (WHERE args_present)", "stdout_noise_lines": "sum(stdout_noise_lines)"}
N0 = " UNION ALL ".join([
    _one(0, {"calls_total": "count(*)", "calls_errored": "count(*) FILTER (WHERE NOT ok)", "error_fraction": "CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE NOT ok)::DOUBLE / count(*) ELSE 0 END"}, "calls"),
    *[f"SELECT 0, '{name}', {_SIZE}, CAST({e} AS DOUBLE) FROM calls GROUP BY 3" for name, e in _DRIVEN.items()],
    _counts(0, "flows_by_lifecycle_phase", "CASE WHEN phase = '' THEN 'unrecorded' ELSE phase END", "flows"),
])


def _sql(ctes: list[str], body: str) -> str:
    return f"WITH {', '.join(ctes)} SELECT CAST(n.number AS INTEGER) AS number, n.figure, n.key, n.value FROM ({body}) AS n(number, figure, key, value)"


ALL = _sql([_RUN, _SERVERS, _GRADED, _NODES], " UNION ALL ".join([N0, N1, N2, N3, N4, N5, _n6("nodes")]))


def all_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driving summary and the six numbers, one row a figure and part."""
    return numbers.all_numbers(run_of_tables(spark, sf_dir), _lists(spark), _exclusions(spark))


def _query(name: str, build, ctes: list[str], body: str) -> Query:
    return Query(name, lambda spark, sf_dir: build(spark, run_of_tables(spark, sf_dir)), _sql(ctes, body))


QUERIES = [
    Query("all_numbers", all_numbers, ALL),
    _query("number_1_connections", lambda s, r: numbers.number_one(r, _exclusions(s)), [_RUN], N1),
    _query("number_2_domains", lambda s, r: numbers.number_two(r), [_RUN], N2),
    _query("propagation_by_segment", lambda s, r: numbers.number_three(r).filter("figure <> 'observability'"), [_RUN, _SERVERS], " UNION ALL ".join(f"SELECT 3, '{n}', revision, CAST({e} AS DOUBLE) FROM rates" for n, e in _RATES.items())),
    _query("observability_states", lambda s, r: numbers.number_three(r).filter("figure = 'observability'"), [_RUN, _SERVERS], N3.rpartition(" UNION ALL ")[2]),
    _query("number_4_coverage", lambda s, r: numbers.number_four(r), [_RUN], N4),
    _query("number_5_grades", lambda s, r: numbers.number_five(r, _exclusions(s)), [_RUN, _GRADED], N5),
    _query("number_6_self_hostable", lambda s, r: numbers.number_six(r, _lists(s)), [_RUN, _NODES], _n6("nodes")),
    _query("number_6_carried", lambda s, r: numbers.number_six(r, None), [_RUN, _NODES], _n6("carried")),
    _query("driving_summary", lambda s, r: numbers.driving_figures(r), [_RUN], N0),
]
