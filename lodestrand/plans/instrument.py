"""The instrument against truth, and its calibration: line items as a bench's flows, benchmark items as calls.

An item's arguments are its text. Its request's target is the same text for two items of three, and its body the
text of the item before, so that calls match themselves, others, or nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.structure import split_string
from lodestrand.operators import bench, calibration, control, disclosure, matching
from lodestrand.plans.attribution import _SQL_TOKENS
from lodestrand.plans.registry import Query, table
from lodestrand.plans.six_numbers import _GRADED, _RUN, INFRASTRUCTURE, SELF_HOSTABLE, _exclusions, run_of_tables

FAMILIES, K = 5, 12


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "benchmark").select("item_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("args"))
    before = texts.select((F.col("item_id") + 1).alias("item_id"), F.col("args").alias("body"))
    target = F.when(F.col("item_id") % 3 != 0, F.col("args")).otherwise(F.lit(b""))
    joined = texts.join(before, "item_id", "left")
    return joined.select((F.col("item_id") % FAMILIES).alias("family"), F.col("item_id").alias("item"), "args", target.alias("target"), F.coalesce("body", F.lit(b"")).alias("body"))


def _transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("item") % 4 == 0, F.when(F.col("item") % 8 == 0, "re_encoded").otherwise(""))
    return _items(spark, sf_dir).select(F.col("item").alias("transfer"), "args", "target", "body", (F.col("item") % 4 != 0).alias("detectable"), reason.alias("reason"))


def _frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    background = _items(spark, sf_dir).filter("item % 2 = 0").select("item", "args")
    return matching.document_frequency(background, "item", "args", K)


_SQL_ITEMS = f"""
texts AS (SELECT item_id AS item, item_id % {FAMILIES} AS family, hex(encode(text)) AS h FROM benchmark),
grams AS (SELECT DISTINCT family, item, substr(h, 2 * p + 1, {2 * K}) AS gram FROM (SELECT family, item, h, unnest(range(0, length(h) // 2 - {K - 1})) AS p FROM texts)),
wires AS (
  SELECT family, item AS a, gram FROM grams WHERE item % 3 <> 0
  UNION SELECT t.family, t.item, g.gram FROM texts t JOIN grams g ON g.item = t.item - 1
),
met AS (SELECT w.family, w.a, g.item AS b, g.gram FROM wires w JOIN grams g ON w.family = g.family AND w.gram = g.gram),
background AS (SELECT gram, count(*) AS df FROM grams WHERE item % 2 = 0 GROUP BY 1),
masses AS (SELECT a, b, sum(1.0::DOUBLE / (1 + coalesce(df, 0))) AS mass, count(*) AS n FROM met LEFT JOIN background USING (gram) GROUP BY 1, 2),
pairs AS (SELECT sum(n) AS calls, sum(n * (n - 1)) AS pairs FROM (SELECT count(*) AS n FROM texts GROUP BY family))
"""

RECALL = f"""
WITH {_SQL_ITEMS}, own AS (SELECT DISTINCT a FROM met WHERE a = b),
r AS (SELECT CASE WHEN item % 4 <> 0 THEN '' WHEN item % 8 = 0 THEN 're_encoded' ELSE 'unclassified' END AS reason, own.a FROM texts LEFT JOIN own ON own.a = item)
SELECT reason, count(*) AS transfers, count(a) AS detected, CASE WHEN reason = '' THEN count(a)::DOUBLE / count(*) END AS recall FROM r GROUP BY 1
"""

SELF = f"""
WITH {_SQL_ITEMS}, own AS (SELECT DISTINCT a FROM met WHERE a = b), f AS (SELECT family, own.a FROM texts LEFT JOIN own ON own.a = item)
SELECT family, count(*) AS calls, count(a) AS matched, count(a)::DOUBLE / count(*) AS recall FROM f GROUP BY ROLLUP (family)
"""

SWEEP = f"""
WITH {_SQL_ITEMS}, t(min_mass) AS (VALUES {', '.join(f'({m}::DOUBLE)' for m in calibration.LADDER)}), k AS (SELECT count(*) AS known FROM texts WHERE item % 4 <> 0)
SELECT min_mass, count(mass) FILTER (WHERE a <> b) AS false_positives, count(mass) FILTER (WHERE a <> b)::DOUBLE / (SELECT pairs FROM pairs) AS rate,
       count(mass) FILTER (WHERE a = b)::DOUBLE / (SELECT calls FROM pairs) AS self_recall, count(mass) FILTER (WHERE a = b AND a % 4 <> 0)::DOUBLE / (SELECT known FROM k) AS bench_recall
FROM t LEFT JOIN masses ON mass >= min_mass GROUP BY 1
"""

CHEAPEST = f"""
SELECT min(min_mass) FILTER (WHERE false_positives = 0) AS cheapest_mass, arg_min(self_recall, min_mass) FILTER (WHERE false_positives = 0) AS self_recall_there FROM ({SWEEP})
"""

COLLIDING = f"""
WITH {_SQL_ITEMS} SELECT coalesce(df, 0) AS df, count(*) AS instances FROM met LEFT JOIN background USING (gram) WHERE a <> b GROUP BY 1
"""


def _spread(where: str) -> str:
    return f"""
WITH {_SQL_ITEMS}, s AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS r, count(*) OVER () AS total FROM masses WHERE {where})
SELECT count(*) AS n, coalesce(min(n), 0) AS min, coalesce(max(n) FILTER (WHERE r = total // 2), 0) AS median, coalesce(max(n), 0) AS max FROM s
"""


ACCEPTANCE = f"""
WITH {_SQL_ITEMS}, c AS (SELECT count(*) AS u, count(*) FILTER (WHERE mass >= {calibration.LEAST_MASS}) AS w FROM masses WHERE a <> b)
SELECT CAST(pairs AS BIGINT) AS pairs, u AS unweighted, w AS weighted, u::DOUBLE / pairs AS unweighted_rate, w::DOUBLE / pairs AS weighted_rate, CASE WHEN w < u THEN 'kept' ELSE 'reverted' END AS verdict FROM c, pairs
"""

_STRUCTURE = f"""
WITH {_SQL_TOKENS},
own AS (SELECT page_id % {FAMILIES} AS family, page_id AS item, token FROM toks WHERE token NOT LIKE 'utm\\_%' ESCAPE '\\'),
wire AS (SELECT page_id % {FAMILIES} AS family, page_id AS item, token FROM toks),
size AS (SELECT family, item, count(*) AS n FROM own GROUP BY 1, 2),
hits AS (SELECT w.family, w.item AS a, o.item AS b FROM wire w JOIN own o ON w.family = o.family AND w.token = o.token GROUP BY w.family, w.item, o.item
         HAVING count(*) = (SELECT n FROM size WHERE size.item = o.item)),
told AS (SELECT h.*, (SELECT n FROM size WHERE size.item = h.b) >= 2 AND EXISTS (SELECT 1 FROM own x WHERE x.item = h.b AND x.token NOT IN (SELECT token FROM own y WHERE y.item = h.a)) AS apart FROM hits h),
f AS (SELECT page_id % {FAMILIES} AS family, count(*) AS calls FROM pages GROUP BY 1),
t AS (SELECT family, count(*) FILTER (WHERE a = b) AS s, count(*) FILTER (WHERE a <> b AND apart) AS p FROM told GROUP BY 1)
SELECT f.family, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(coalesce(s, 0)) AS BIGINT) AS self_matched, CAST(sum(calls * (calls - 1)) AS BIGINT) AS pairs, CAST(sum(coalesce(p, 0)) AS BIGINT) AS false_positives
FROM f LEFT JOIN t ON f.family = t.family GROUP BY ROLLUP (f.family)
"""


def structural_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as calls: their addresses' tokens but for tracking values, against all tokens of the pages of a family."""
    tokens = split_string(F.col("url"))
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % FAMILIES).alias("family"), F.col("page_id").alias("item"), F.filter(tokens, lambda t: ~t.startswith("utm_")).alias("tokens"), tokens.alias("request"))
    return calibration.structural_matches(pages)


def kgram_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calls of a family have their own arguments in each request."""
    items = _items(spark, sf_dir)
    calls = items.select(F.col("family").alias("window"), F.col("item").alias("call"), F.col("args").alias("data"))
    found = matching.recheck(calls, items.select(F.col("family").alias("window"), F.col("item").alias("request"), "target", "body"), K)
    return found.select("window", "request", F.array_join(F.col("matching").cast("array<string>"), ",").alias("matching"))


RECHECK = f"WITH {_SQL_ITEMS} SELECT family AS window, a AS request, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS matching FROM (SELECT DISTINCT family, a, b FROM met) GROUP BY 1, 2"


def _bench(spark: SparkSession, sf_dir: str) -> bench.Instrument:
    run = run_of_tables(spark, sf_dir)
    slot = F.regexp_extract("dest_host", r"^h(\d+)\.", 1)
    flows = run.flows.filter(slot != "").withColumn("dest_host", bench.host_of_slot(slot.cast("long")))
    parts = table(spark, sf_dir, "part").filter("p_partkey < 35")
    channel = F.element_at(F.array(F.lit("target"), F.lit("body"), F.lit("header")), (F.col("p_partkey") % 3 + 1).cast("int"))
    plan = parts.select(F.col("p_partkey").alias("slot"), (F.col("p_partkey") * 32).cast("string").alias("call_id"), F.concat(F.lit("cell-"), F.col("p_partkey") % 4).alias("cell"), channel.alias("channel"), F.concat(F.lit("expect-"), F.col("p_partkey")).alias("expect"), (F.col("p_partkey") % 5 != 0).alias("fragment_present"))
    truth = parts.select(bench.host_of_slot(F.col("p_partkey")).alias("dest_host"), F.when(F.col("p_partkey") % 11 == 0, "refused").alias("error"))
    return bench.compute(plan, truth, flows)


_SQL_BENCH = f"""
{_RUN}, {_GRADED},
b AS (SELECT *, 'sink' || lpad(regexp_extract(dest_host, '^h(\\d+)\\.', 1), 3, '0') || '.bench.invalid' AS sink FROM graded WHERE regexp_matches(dest_host, '^h\\d+\\.')),
plan AS (SELECT p_partkey AS slot, 'sink' || lpad(CAST(p_partkey % 128 AS VARCHAR), 3, '0') || '.bench.invalid' AS sink, CAST(p_partkey * 32 AS VARCHAR) AS call_id, 'cell-' || (p_partkey % 4) AS cell,
                p_partkey % 3 <> 2 AS readable, p_partkey % 5 <> 0 AS sent FROM part WHERE p_partkey < 35),
ok AS (SELECT sink FROM plan WHERE slot % 11 <> 0),
g AS (
  SELECT p.cell, b.call_id AS claimed, p.call_id AS expected, b.provenance, p.sent, p.readable,
         CASE WHEN our_traceparent_present THEN 'TRACE_PROPAGATED' WHEN causal AND active > 1 AND matching_calls_in_window = 1 THEN 'CONTENT_UNIQUE' WHEN causal AND active > 1 THEN 'CONTENT_AMBIGUOUS'
              WHEN causal THEN 'CONTENT_MATCH_UNCONTESTED' WHEN has_time_and_pid AND active = 1 THEN 'TEMPORAL_ONLY' ELSE 'UNATTRIBUTED' END AS grade
  FROM b JOIN ok USING (sink) JOIN plan p USING (sink)
), q AS (SELECT *, grade IN ('TRACE_PROPAGATED', 'CONTENT_UNIQUE') AS strong, coalesce(claimed, '') <> '' AS named FROM g)
"""
BENCH_ATTRIBUTION = f"""
WITH {_SQL_BENCH},
c AS (SELECT cell, count(*) AS flows, count(*) FILTER (WHERE strong AND named AND claimed = expected) AS strong_correct, count(*) FILTER (WHERE strong AND named AND claimed <> expected) AS false_strong,
             count(*) FILTER (WHERE NOT sent) AS nothing_sent, count(*) FILTER (WHERE NOT sent AND provenance IN ('arguments', 'context', 'both')) AS false_provenance,
             count(*) FILTER (WHERE NOT readable AND sent) AS unread_channel, count(*) FILTER (WHERE NOT readable AND sent AND strong) AS unread_but_strong FROM q GROUP BY ROLLUP (cell))
SELECT *, CASE WHEN strong_correct + false_strong > 0 THEN strong_correct::DOUBLE / (strong_correct + false_strong) ELSE 0 END AS precision,
       CASE WHEN nothing_sent > 0 THEN false_provenance::DOUBLE / nothing_sent ELSE 0 END AS false_provenance_rate FROM c
"""
BENCH_CONFUSION = f"""
WITH {_SQL_BENCH}, n AS (SELECT cell, grade, count(*) AS n FROM q GROUP BY 1, 2),
s AS (SELECT cell, string_agg(grade || ':' || n, ',' ORDER BY grade) AS grades FROM n GROUP BY 1),
c AS (SELECT cell, count(*) AS flows, count(*) FILTER (WHERE named AND claimed = expected) AS correct_call, count(*) FILTER (WHERE named AND claimed <> expected) AS wrong_call, count(*) FILTER (WHERE NOT named) AS no_call FROM q GROUP BY 1)
SELECT p.cell, 'expect-' || max(slot) AS expect, coalesce(max(c.flows), 0) AS flows, coalesce(max(correct_call), 0) AS correct_call, coalesce(max(wrong_call), 0) AS wrong_call, coalesce(max(no_call), 0) AS no_call, coalesce(max(grades), '') AS grades
FROM plan p LEFT JOIN c ON c.cell = p.cell LEFT JOIN s ON s.cell = p.cell GROUP BY 1
"""
BENCH_CAPTURE = f"""
WITH {_SQL_BENCH}, t AS (SELECT sink, count(*) AS sent FROM ok GROUP BY 1), f AS (SELECT sink, count(*) AS seen FROM b WHERE sink IN (SELECT sink FROM ok) GROUP BY 1),
r AS (SELECT CAST(sum(sent) AS BIGINT) AS sent, CAST(sum(least(sent, coalesce(seen, 0))) AS BIGINT) AS observed, count(*) FILTER (WHERE seen IS NULL) AS hosts_never_observed FROM t LEFT JOIN f USING (sink))
SELECT *, observed::DOUBLE / sent AS recall, (SELECT CAST(coalesce(sum(seen), 0) AS BIGINT) FROM f) AS flows_to_bench_hosts, (SELECT count(*) FROM plan) - sent AS failed_to_send FROM r
"""


def bench_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each cell of the bench gave, with its grades as text."""
    grades = F.array_join(F.transform(F.array_sort(F.map_entries("grades")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return _bench(spark, sf_dir).cells.withColumn("grades", grades)




def _disclosure(spark: SparkSession, sf_dir: str) -> disclosure.Disclosure:
    suppliers = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0 AND s_suppkey < 40")
    declared = suppliers.select(
        F.concat(F.lit("server-"), F.col("s_suppkey")).alias("server"), F.array(F.lit(SELF_HOSTABLE), F.lit(INFRASTRUCTURE)).alias("hosts"), F.array(F.lit("h2.example.com")).alias("known"),
        F.lit("stated").alias("basis"), F.when(F.col("s_suppkey") % 3 == 0, "npx").otherwise("python").alias("launch_tool"),
    )
    return disclosure.check(run_of_tables(spark, sf_dir).flows, declared, _exclusions(spark))


_SQL_DISCLOSURE = f"""
{_RUN}, d AS (SELECT 'server-' || s_suppkey AS server, s_suppkey % 3 = 0 AS launched FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey < 40),
f AS (SELECT CASE WHEN server_id = '' THEN '<unknown>' ELSE server_id END AS server, dest_host AS host, possible, infra FROM marked),
p AS (SELECT DISTINCT f.server, host, CASE WHEN possible THEN 'called' WHEN coalesce(launched, false) AND infra THEN 'launcher' ELSE 'pre_call' END AS pile, d.server IS NOT NULL AS has
      FROM f LEFT JOIN d ON d.server = f.server WHERE host <> ''),
s AS (SELECT server, has, host, pile, CASE WHEN pile <> 'called' THEN pile WHEN NOT has THEN 'new' WHEN host LIKE '%.{SELF_HOSTABLE}' OR host LIKE '%.{INFRASTRUCTURE}' THEN 'declared' WHEN host = 'h2.example.com' OR host LIKE '%.h2.example.com' THEN 'known' ELSE 'new' END AS status FROM p),
g AS (SELECT server, has, {', '.join(f"coalesce(string_agg(host, ',' ORDER BY host) FILTER (WHERE status = '{x}'), '') AS {y}" for x, y in (('declared', 'declared'), ('known', 'known'), ('new', 'new'), ('pre_call', 'pre_first_call')))} FROM s WHERE pile <> 'launcher' GROUP BY 1, 2),
v AS (SELECT *, CASE WHEN pre_first_call <> '' THEN '{disclosure.BEFORE_CALLS}' WHEN new <> '' AND NOT has THEN '{disclosure.NO_DECLARATION}' WHEN new <> '' THEN '{disclosure.NEW_HOST}' END AS reason FROM g)
"""
DISCLOSURE_SERVERS = f"WITH {_SQL_DISCLOSURE} SELECT server, declared, known, new, pre_first_call, CASE WHEN has THEN 'stated' END AS basis, reason, reason IS NOT NULL AS under_review FROM v"
DISCLOSURE_VERDICT = f"""
WITH {_SQL_DISCLOSURE} SELECT CASE WHEN count(reason) > 0 THEN 'review_required' ELSE 'clear' END AS verdict, count(reason) AS servers_to_review, (SELECT count(*) FROM f WHERE host = '') AS connections_without_a_host FROM v
"""
DISCLOSURE_LAUNCHER = f"WITH {_SQL_DISCLOSURE} SELECT server, string_agg(host, ',' ORDER BY host) AS hosts FROM s WHERE pile = 'launcher' GROUP BY 1"


def disclosure_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _disclosure(spark, sf_dir).servers
    return found.select("server", *[F.array_join(c, ",").alias(c) for c in ("declared", "known", "new", "pre_first_call")], "basis", "reason", "under_review")


def disclosure_launcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _disclosure(spark, sf_dir).launcher.select("server", F.array_join("hosts", ",").alias("hosts"))


def _control(spark: SparkSession, sf_dir: str) -> control.Comparison:
    flows = run_of_tables(spark, sf_dir).flows
    review = table(spark, sf_dir, "nation").select(F.concat(F.lit("h"), F.col("n_nationkey"), F.lit(".example.com")).alias("host"))
    return control.compare(flows.filter("active_calls_in_window = 0"), flows.filter("active_calls_in_window > 0"), "server-7", review)


_SQL_CONTROL = f"""
{_RUN}, c AS (SELECT * FROM marked WHERE active_calls_in_window = 0), s AS (SELECT * FROM marked WHERE active_calls_in_window > 0 AND server_id = 'server-7'),
r AS (SELECT 'h' || n_nationkey || '.example.com' AS host FROM nation),
sides AS (SELECT 'control' AS side, * FROM c UNION ALL SELECT 'subject', * FROM s)
"""
CONTROL_HOSTS = f"""
WITH {_SQL_CONTROL}, n AS (SELECT dest_host AS host, count(*) FILTER (WHERE side = 'control') AS in_control, count(*) FILTER (WHERE side = 'subject') AS in_subject FROM sides WHERE possible AND dest_host <> '' GROUP BY 1)
SELECT coalesce(n.host, r.host) AS host, coalesce(in_control, 0) AS in_control, coalesce(in_subject, 0) AS in_subject, r.host IS NOT NULL AS reviewed FROM n FULL JOIN r ON n.host = r.host
"""
_SUMS = """count(*) AS flows, count(*) FILTER (WHERE target_matched_bytes > 0 OR body_matched_bytes > 0) AS flows_with_context, CAST(coalesce(sum(target_matched_bytes), 0) AS BIGINT) AS target_matched_bytes,
CAST(coalesce(sum(body_matched_bytes), 0) AS BIGINT) AS body_matched_bytes, count(*) FILTER (WHERE causal) AS causal_flows"""
CONTROL_MATCHING = f"WITH {_SQL_CONTROL} SELECT side, {_SUMS}, count(*) FILTER (WHERE causal) > 0 AS alive FROM sides GROUP BY 1"
CONTROL_CARRIED = f"WITH {_SQL_CONTROL} SELECT side, dest_host AS host, {_SUMS} FROM sides WHERE dest_host IN (SELECT host FROM r) GROUP BY 1, 2"

QUERIES = [
    Query("detection_recall", lambda s, d: calibration.detection_recall(_transfers(s, d), K), RECALL),
    Query("self_match_recall", lambda s, d: calibration.self_match_recall(_items(s, d), K), SELF),
    Query("mass_sweep", lambda s, d: calibration.sweep_mass(_items(s, d), _transfers(s, d), _frequency(s, d), "calibration", K), SWEEP),
    Query("cheapest_clean_mass", lambda s, d: calibration.cheapest_clean(calibration.sweep_mass(_items(s, d), _transfers(s, d), _frequency(s, d), "calibration", K)), CHEAPEST),
    Query("colliding_frequencies", lambda s, d: calibration.colliding_frequencies(_items(s, d), _frequency(s, d), K)[0], COLLIDING),
    Query("colliding_pairs", lambda s, d: calibration.colliding_frequencies(_items(s, d), _frequency(s, d), K)[1], _spread("a <> b")),
    Query("true_match_counts", lambda s, d: calibration.true_match_counts(_transfers(s, d), K), _spread("a = b AND a % 4 <> 0")),
    Query("rarity_acceptance", lambda s, d: calibration.acceptance(_items(s, d), _frequency(s, d), K), ACCEPTANCE),
    Query("structural_matches", structural_matches, _STRUCTURE),
    Query("kgram_recheck", kgram_recheck, RECHECK),
    Query("bench_attribution", lambda s, d: _bench(s, d).attribution, BENCH_ATTRIBUTION),
    Query("bench_confusion", bench_confusion, BENCH_CONFUSION),
    Query("bench_capture", lambda s, d: _bench(s, d).capture, BENCH_CAPTURE),
    Query("disclosure_servers", disclosure_servers, DISCLOSURE_SERVERS),
    Query("disclosure_verdict", lambda s, d: _disclosure(s, d).verdict, DISCLOSURE_VERDICT),
    Query("disclosure_launcher", disclosure_launcher, DISCLOSURE_LAUNCHER),
    Query("control_hosts", lambda s, d: _control(s, d).hosts, CONTROL_HOSTS),
    Query("control_matching", lambda s, d: _control(s, d).matching, CONTROL_MATCHING),
    Query("control_carried", lambda s, d: _control(s, d).carried, CONTROL_CARRIED),
]
