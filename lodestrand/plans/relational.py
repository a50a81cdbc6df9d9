"""Fan-out, coverage and domain counts, with orders as calls and line items as the flows they cause."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import redaction
from lodestrand.operators.distribution import both_readings, distribution, per_call, tasks_for, zero_filled
from lodestrand.operators.reports import curve
from lodestrand.plans.registry import Query, table
from lodestrand.sources import pcap

#: Nations whose suppliers are on the declared list.
LISTED_NATIONS = (3, 7, 11)
EVENT_DOMAIN = ("click", "error", "purchase", "refund", "logout", "signup", "view")


def _calls_and_flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call"))
    flows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call"), F.col("l_suppkey").alias("host"), "l_returnflag")
    return calls, flows


def fanout_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections and distinct destinations of each call, silent calls as zeros."""
    calls, flows = _calls_and_flows(spark, sf_dir)
    counted = per_call(calls, flows, "call", [F.count("counted").alias("connections"), F.countDistinct("host").alias("distinct_hosts")], deal=(tasks_for(flows, calls), "host"))
    stacked = counted.selectExpr("stack(2, 'connections', connections, 'distinct_hosts', distinct_hosts) AS (metric, v)")
    return distribution(stacked, "v", ["metric"])


FANOUT = """
WITH g AS (
  SELECT l_orderkey AS call, count(*) AS c, count(DISTINCT l_suppkey) AS h FROM lineitem GROUP BY 1
  UNION ALL SELECT o_orderkey, 0, 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
), m AS (SELECT 'connections' AS metric, c AS v FROM g UNION ALL SELECT 'distinct_hosts', h FROM g)
SELECT metric, count(*) AS n, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, max(v) AS max FROM m GROUP BY 1
"""


def distinct_hosts_per_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations of call-caused flows; a call with other flows only is absent, and a zero when repaired."""
    calls, flows = _calls_and_flows(spark, sf_dir)
    caused, hosts = F.col("l_returnflag") != "R", [F.countDistinct("host").alias("v")]
    return distribution(both_readings(calls, flows, "call", hosts, caused, (tasks_for(flows, calls), "host")), "v", ["variant"])


HOSTS = """
WITH g AS (SELECT l_orderkey AS call, count(DISTINCT l_suppkey) AS v FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
m AS (
  SELECT 'literal' AS variant, v FROM g
  UNION ALL SELECT 'literal', 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT 'repaired', v FROM g
  UNION ALL SELECT 'repaired', 0 FROM orders WHERE o_orderkey NOT IN (SELECT call FROM g)
)
SELECT variant, count(*) AS n, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, max(v) AS max FROM m GROUP BY 1
"""


def fanout_excluding_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections of each call without those to listed destinations, and how many are listed."""
    calls, flows = _calls_and_flows(spark, sf_dir)
    listed = table(spark, sf_dir, "supplier").filter(F.col("s_nationkey").isin(*LISTED_NATIONS)).select(F.col("s_suppkey").alias("host"), F.lit(True).alias("listed"))
    marked = flows.join(listed, "host", "left").withColumn("other", F.when(F.col("listed").isNull(), 1))
    kept = distribution(per_call(calls, marked, "call", [F.count("other").alias("v")]), "v")
    # Two results of one row each.
    return kept.crossJoin(marked.agg(F.count("listed").alias("listed_connections")))


EXCLUDING = """
WITH f AS (
  SELECT l_orderkey AS call, s_suppkey IS NOT NULL AS listed
  FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (3, 7, 11)) ON l_suppkey = s_suppkey
), g AS (
  SELECT call, count(*) FILTER (WHERE NOT listed) AS v FROM f GROUP BY 1
  UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
)
SELECT count(*) AS n, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, max(v) AS max,
       (SELECT count(*) FROM f WHERE listed) AS listed_connections FROM g
"""


def zero_filled_domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type of a fixed domain, those that never occur included."""
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return zero_filled(counts, "event_type", EVENT_DOMAIN)


ZERO_FILLED = """
WITH d(event_type) AS (VALUES ('click'), ('error'), ('purchase'), ('refund'), ('logout'), ('signup'), ('view'))
SELECT coalesce(d.event_type, e.event_type) AS event_type, coalesce(n, 0) AS n
FROM d FULL JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) e ON d.event_type = e.event_type
"""



def honesty_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strong share of each year, whether it fell, and which priorities came and went."""
    orders = table(spark, sf_dir, "orders").withColumn("yr", F.year("o_orderdate").cast("long"))
    # Priority 4 is listed only in even years, so that the sets differ.
    listed = F.collect_set(F.when(~(F.col("o_orderpriority").startswith("4") & (F.col("yr") % 2 == 1)), F.substring("o_orderpriority", 1, 1)))
    points = orders.groupBy("yr").agg(F.count("*").alias("denominator"), F.count_if(F.col("o_orderstatus") == "F").alias("strong"), listed.alias("members"))
    found = curve(points, "yr", "strong", "denominator", "members")
    text = lambda c: F.array_join(c, ",").alias(c)
    return found.select("yr", "denominator", "strong", "fraction", "fell", "always_fell", text("added"), text("removed"))


HONESTY = """
WITH o AS (SELECT year(o_orderdate) AS yr, o_orderstatus, substr(o_orderpriority, 1, 1) AS m FROM orders),
y AS (SELECT yr, count(*) AS denominator, count(*) FILTER (WHERE o_orderstatus = 'F') AS strong FROM o GROUP BY 1),
s AS (SELECT DISTINCT yr, m FROM o WHERE NOT (m = '4' AND yr % 2 = 1)),
c AS (SELECT yr, denominator, strong, strong::DOUBLE / denominator AS fraction, lag(strong::DOUBLE / denominator) OVER (ORDER BY yr) AS before, lag(yr) OVER (ORDER BY yr) AS prior FROM y)
SELECT CAST(yr AS BIGINT) AS yr, denominator, strong, fraction, CASE WHEN before IS NOT NULL THEN fraction < before END AS fell,
       min(CASE WHEN before IS NULL OR fraction < before THEN 1 ELSE 0 END) OVER () = 1 AS always_fell,
       CASE WHEN prior IS NULL THEN '' ELSE coalesce((SELECT string_agg(m, ',' ORDER BY m) FROM s WHERE s.yr = c.yr AND m NOT IN (SELECT m FROM s WHERE s.yr = c.prior)), '') END AS added,
       CASE WHEN prior IS NULL THEN '' ELSE coalesce((SELECT string_agg(m, ',' ORDER BY m) FROM s WHERE s.yr = c.prior AND m NOT IN (SELECT m FROM s WHERE s.yr = c.yr)), '') END AS removed
FROM c
"""


def unobserved_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection attempts to addresses that no flow has: parts as destinations, line items as flows."""
    address = lambda c: F.concat(F.lit("10.1."), F.floor(F.col(c) / 256).cast("string"), F.lit("."), (F.col(c) % 256).cast("string"))
    attempts = table(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_size") == 1, "127.0.0.1").otherwise(address("p_partkey")), F.lit(":443")).alias("destination"), F.col("p_size").cast("long").alias("syns"))
    flows = table(spark, sf_dir, "lineitem").filter("l_quantity >= 47").select(address("l_partkey").alias("dest_ip"))
    return pcap.unobserved(attempts, flows)


UNOBSERVED = """
SELECT '10.1.' || (p_partkey // 256) || '.' || (p_partkey % 256) || ':443' AS destination, CAST(p_size AS BIGINT) AS syns FROM part p
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity >= 47) AND p.p_size <> 1
"""


def redact_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers under labels of their nation, in the order in which they are first seen."""
    seen = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("class"))
    return redaction.first_seen_labels(seen, "s_suppkey", "class", "s_suppkey")


RELABEL = """
SELECT s_suppkey, 'nation-' || s_nationkey AS class, 'nation-' || s_nationkey || '-' || (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) AS label FROM supplier
"""


def tool_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types under their number within a brand."""
    return redaction.dense_index(table(spark, sf_dir, "part"), "p_brand", "p_type", "tool").select("p_brand", "p_type", "tool").distinct()


TOOL_INDEX = """
SELECT DISTINCT p_brand, p_type, 'tool-' || (dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) - 1) AS tool FROM part
"""

QUERIES = [
    Query("fanout_distribution", fanout_distribution, FANOUT),
    Query("distinct_hosts_per_call", distinct_hosts_per_call, HOSTS),
    Query("fanout_excluding_listed", fanout_excluding_listed, EXCLUDING),
    Query("zero_filled_domain_counts", zero_filled_domain_counts, ZERO_FILLED),
    Query("honesty_curve", honesty_curve, HONESTY),
    Query("unobserved_destinations", unobserved_destinations, UNOBSERVED),
    Query("redact_relabel", redact_relabel, RELABEL),
    Query("tool_index", tool_index, TOOL_INDEX),
]
