"""Structure, grades, state in time and reports: pages as requests, line items as flows, events as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import evidence, structure
from lodestrand.operators import reports
from lodestrand.operators.containment import candidates, simulate
from lodestrand.operators.temporal import as_of, in_flight_changes
from lodestrand.plans.registry import Query, table
from lodestrand.schema import REASONS
from lodestrand.streaming.in_flight import replay

#: Pages of a wave, and the declared hosts of the reports.
WAVE = 10
SELF_HOSTABLE, INFRASTRUCTURE = ("example.org",), ("www.ththhe.example.com", "blog.tionsh.example.net")
DECLARED, KNOWN = ("example.com",), ("spam-farm.example.org",)


def url_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural tokens of each page's address."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(F.array_distinct(structure.split_string(F.col("url")))).alias("token"))


_SQL_TOKENS = r"""
parts AS (
  SELECT page_id, regexp_extract(url, '^[^/?#]*?://([^/?#]*)', 1) AS host,
         string_split(regexp_extract(url, '^[^/?#]*?://[^/?#]*([^?#]*)', 1), '/') AS segs,
         string_split(regexp_extract(url, '\?([^#]*)', 1), '&') AS pairs
  FROM pages
), toks AS (
  SELECT DISTINCT page_id, token FROM (
    SELECT page_id, host AS token FROM parts
    UNION ALL SELECT page_id, unnest(segs) FROM parts
    UNION ALL SELECT page_id, substr(p, strpos(p, '=') + 1) FROM (SELECT page_id, unnest(pairs) AS p FROM parts) WHERE strpos(p, '=') > 0
  ) WHERE length(token) >= 3
)
"""
URL_TOKENS = f"WITH {_SQL_TOKENS} SELECT page_id, token FROM toks"


def containment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages' tokens are all in which page of their wave, and which tell themselves apart."""
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / WAVE).cast("long").alias("wave"), "page_id", structure.split_string(F.col("url")).alias("tokens"))
    calls = pages.select("wave", F.col("page_id").alias("call"), F.filter("tokens", lambda t: ~t.startswith("utm_")).alias("tokens"))
    found = candidates(calls, pages.select("wave", F.col("page_id").alias("request"), "tokens"))

    def text(name: str):
        return F.array_join(F.col(name).cast("array<string>"), ",").alias(name)

    return found.select("wave", "request", text("contained"), text("discriminating"), "non_discriminating", "token_count")


CANDIDATES = f"""
WITH {_SQL_TOKENS},
c AS (SELECT page_id // {WAVE} AS wave, page_id AS call, token FROM toks WHERE token NOT LIKE 'utm\\_%' ESCAPE '\\'),
r AS (SELECT page_id // {WAVE} AS wave, page_id AS request, token FROM toks),
s AS (SELECT wave, call, count(*) AS size FROM c GROUP BY 1, 2),
tells AS (SELECT wave, call, max(alone) AS tells FROM (SELECT wave, call, CASE WHEN count(*) OVER (PARTITION BY wave, token) = 1 THEN 1 ELSE 0 END AS alone FROM c) GROUP BY 1, 2),
held AS (
  SELECT p.wave, p.request, s.call, s.size, t.tells
  FROM (SELECT page_id AS request, page_id // {WAVE} AS wave FROM pages) p JOIN s ON s.wave = p.wave JOIN tells t ON t.wave = s.wave AND t.call = s.call
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.call = s.call AND NOT EXISTS (SELECT 1 FROM r WHERE r.request = p.request AND r.token = c.token))
), mute AS (SELECT wave, sum(1 - tells) AS mute FROM tells GROUP BY 1)
SELECT p.page_id // {WAVE} AS wave, p.page_id AS request,
  coalesce(string_agg(CAST(h.call AS VARCHAR), ',' ORDER BY h.call), '') AS contained,
  coalesce(string_agg(CAST(h.call AS VARCHAR), ',' ORDER BY h.call) FILTER (WHERE h.tells = 1), '') AS discriminating,
  CAST(coalesce(max(mute.mute), 0) AS BIGINT) AS non_discriminating,
  CAST(CASE WHEN count(*) FILTER (WHERE h.tells = 1) = 1 THEN max(h.size) FILTER (WHERE h.tells = 1) ELSE 0 END AS BIGINT) AS token_count
FROM pages p LEFT JOIN held h ON h.request = p.page_id LEFT JOIN mute ON mute.wave = p.page_id // {WAVE} GROUP BY 1, 2
"""


def sibling_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of a wave's pages and of a file that every client asks for on their hosts, as if the wave were in flight."""
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / WAVE).cast("long").alias("wave"), "page_id", structure.split_string(F.col("url")).alias("tokens"))
    calls = pages.select("wave", F.col("page_id").alias("call"), F.filter("tokens", lambda t: ~t.startswith("utm_")).alias("tokens"))
    own = pages.select("wave", F.col("page_id").alias("request"), F.col("page_id").alias("call"), "tokens")
    fixed = own.select("wave", (F.col("request") + (1 << 40)).alias("request"), "call", F.array(F.get("tokens", F.lit(0)), F.lit("robots.txt")).alias("tokens"))
    found = simulate(calls, own.unionByName(fixed))
    return found.groupBy("grade", (F.col("request") >= 1 << 40).alias("fixed")).agg(F.count("*").alias("requests"), F.count_if("false_strong").alias("false_strong"))


SIMULATION = f"""
WITH {_SQL_TOKENS},
c AS (SELECT page_id // {WAVE} AS wave, page_id AS call, token FROM toks WHERE token NOT LIKE 'utm\\_%' ESCAPE '\\'),
r AS (SELECT page_id // {WAVE} AS wave, page_id AS request, page_id AS own, token, false AS fixed FROM toks
      UNION ALL SELECT page_id // {WAVE}, page_id, page_id, unnest([host, 'robots.txt']), true FROM parts),
s AS (SELECT wave, call, count(*) AS size FROM c GROUP BY 1, 2),
tells AS (SELECT wave, call, max(alone) AS tells FROM (SELECT wave, call, CASE WHEN count(*) OVER (PARTITION BY wave, token) = 1 THEN 1 ELSE 0 END AS alone FROM c) GROUP BY 1, 2),
held AS (SELECT r.wave, r.request, r.fixed, c.call FROM r JOIN c ON r.wave = c.wave AND r.token = c.token JOIN s ON s.wave = c.wave AND s.call = c.call GROUP BY r.wave, r.request, r.fixed, c.call, s.size HAVING count(DISTINCT r.token) = s.size),
n AS (SELECT p.page_id AS request, f.fixed, count(t.call) AS told, max(t.call) AS one, max(s.size) FILTER (WHERE t.call IS NOT NULL) AS size
      FROM parts p CROSS JOIN (SELECT unnest([false, true]) AS fixed) f LEFT JOIN held h ON h.request = p.page_id AND h.fixed = f.fixed LEFT JOIN tells t ON t.wave = h.wave AND t.call = h.call AND t.tells = 1 LEFT JOIN s ON s.call = t.call GROUP BY 1, 2),
w AS (SELECT page_id // {WAVE} AS wave, count(*) AS active FROM pages GROUP BY 1),
g AS (SELECT n.*, CASE WHEN told = 1 AND size = 1 THEN 'CONTENT_AMBIGUOUS' WHEN told > 0 AND active > 1 AND told = 1 THEN 'CONTENT_UNIQUE' WHEN told > 0 AND active > 1 THEN 'CONTENT_AMBIGUOUS'
             WHEN told > 0 THEN 'CONTENT_MATCH_UNCONTESTED' WHEN active = 1 THEN 'TEMPORAL_ONLY' ELSE 'UNATTRIBUTED' END AS grade FROM n JOIN w ON w.wave = n.request // {WAVE})
SELECT grade, fixed, count(*) AS requests, count(*) FILTER (WHERE grade = 'CONTENT_UNIQUE' AND one <> request) AS false_strong FROM g GROUP BY 1, 2
"""


def host_suffix_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts by class: the first list that has the host or a suffix of it at a label."""
    host = F.regexp_extract("url", "^[^/?#]*?://([^/?#]*)", 1)
    hosts = table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("pages"))
    listed = spark.createDataFrame([(s, "package_infrastructure") for s in INFRASTRUCTURE] + [(s, "self_hostable") for s in SELF_HOSTABLE], "suffix string, class string")
    return reports.classified(hosts, "host", listed).groupBy("class").agg(F.count("*").alias("hosts"), F.sum("pages").alias("pages"))


_ENDS = "h = '{0}' OR ends_with(h, '.{0}')"
HOST_CLASS = f"""
WITH p AS (SELECT lower(regexp_extract(url, '^[^/?#]*?://([^/?#]*)', 1)) AS h, count(*) AS n FROM pages GROUP BY 1)
SELECT CASE WHEN {' OR '.join(_ENDS.format(s) for s in INFRASTRUCTURE)} THEN 'package_infrastructure'
            WHEN {' OR '.join(_ENDS.format(s) for s in SELF_HOSTABLE)} THEN 'self_hostable' ELSE 'remote_leaf' END AS class,
       count(*) AS hosts, CAST(sum(n) AS BIGINT) AS pages FROM p GROUP BY 1
"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as flows of a wave (the order): what each shows, and its grade."""
    flows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("wave"),
        (F.col("l_returnflag") == "A").alias("flag"),
        (F.col("l_quantity") >= 49).alias("traced"),
        (F.col("l_discount") >= 0.065).alias("match"),
        (F.col("l_suppkey") % 7 != 0).alias("eligible"),
        (F.col("l_linestatus") == "O").alias("correlated"),
        (F.col("l_returnflag") != "N").alias("possible"),
        (F.col("l_linenumber") % 3).alias("tokens"),
        (F.col("l_partkey") % 5 == 0).alias("constant"),
    )
    waves = flows.groupBy("wave").agg(F.count("*").alias("active"), F.count(F.when(F.col("match"), 1)).alias("matching"))
    joined = flows.join(waves, "wave")
    ladder = evidence.grade(F.col("flag") & F.col("traced"), F.col("match"), F.col("active"), F.col("matching"), F.col("eligible"), F.col("correlated"), F.col("possible"), F.col("tokens"))
    return joined.withColumn("g", ladder).select("*", "g.grade", "g.reason")


def _sql_reason(key: str) -> str:
    text = "'" + REASONS[key] + "'"
    for name in ("active", "matching"):
        text = text.replace("{" + name + "}", f"' || CAST({name} AS VARCHAR) || '")
    return text


_SQL_GRADED = f"""
f AS (
  SELECT l_orderkey AS wave, l_returnflag = 'A' AND l_quantity >= 49 AS trace, l_discount >= 0.065 AS match, l_suppkey % 7 <> 0 AS eligible,
         l_linestatus = 'O' AS correlated, l_returnflag <> 'N' AS possible, l_linenumber % 3 AS tokens, l_partkey % 5 = 0 AS constant FROM lineitem
), w AS (SELECT wave, count(*) AS active, count(*) FILTER (WHERE match) AS matching FROM f GROUP BY 1),
g AS (
  SELECT *, CASE WHEN NOT possible THEN 'UNATTRIBUTED' WHEN trace THEN 'TRACE_PROPAGATED' WHEN match AND tokens = 1 THEN 'CONTENT_AMBIGUOUS'
      WHEN match AND active > 1 AND matching = 1 THEN 'CONTENT_UNIQUE' WHEN match AND active > 1 THEN 'CONTENT_AMBIGUOUS'
      WHEN match THEN 'CONTENT_MATCH_UNCONTESTED' WHEN NOT eligible THEN 'UNATTRIBUTED' WHEN correlated AND active = 1 THEN 'TEMPORAL_ONLY' ELSE 'UNATTRIBUTED' END AS grade,
    CASE WHEN NOT possible THEN {_sql_reason('pre_launch')} WHEN trace THEN {_sql_reason('trace')} WHEN match AND tokens = 1 THEN {_sql_reason('one_token')}
      WHEN match AND active > 1 AND matching = 1 THEN {_sql_reason('unique')} WHEN match AND active > 1 THEN {_sql_reason('ambiguous')}
      WHEN match THEN {_sql_reason('uncontested')} WHEN NOT eligible THEN {_sql_reason('ineligible')} WHEN correlated AND active = 1 THEN {_sql_reason('temporal')}
      WHEN correlated AND active > 1 THEN {_sql_reason('temporal_set')} WHEN correlated THEN {_sql_reason('no_evidence')} ELSE {_sql_reason('unreadable')} END AS reason
  FROM f JOIN w USING (wave)
)
"""


def attribution_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).groupBy("grade", "reason").agg(F.count("*").alias("flows"))


GRADES_SQL = f"WITH {_SQL_GRADED} SELECT grade, reason, count(*) AS flows FROM g GROUP BY 1, 2"


def grades_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades by the number of calls in flight, with what discrimination refused."""
    refused = F.greatest(F.lit(0), F.col("matching") - F.col("tokens"))
    return _graded(spark, sf_dir).groupBy("active", "grade").agg(F.count("*").alias("flows"), F.max("matching").alias("most_matching"), F.sum(refused).cast("long").alias("refused"))


WINDOWS_SQL = f"WITH {_SQL_GRADED} SELECT active, grade, count(*) AS flows, max(matching) AS most_matching, CAST(sum(greatest(0, matching - tokens)) AS BIGINT) AS refused FROM g GROUP BY 1, 2"


def denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong flows over all, attributable and content flows; and over those that are in each denominator."""
    return reports.denominators(_graded(spark, sf_dir))


DENOMINATORS_SQL = f"""
WITH {_SQL_GRADED}, m AS (SELECT *, grade IN ('TRACE_PROPAGATED', 'CONTENT_UNIQUE') AS strong, possible AND eligible AS att FROM g),
c AS (SELECT count(*) AS flows, count(*) FILTER (WHERE strong) AS strong, count(*) FILTER (WHERE att) AS attributable, count(*) FILTER (WHERE att AND NOT constant) AS content,
             count(*) FILTER (WHERE att AND strong) AS strong_attributable, count(*) FILTER (WHERE att AND NOT constant AND strong) AS strong_content FROM m)
SELECT *, CASE WHEN flows > 0 THEN strong::DOUBLE / flows ELSE 0.0 END AS raw_fraction, CASE WHEN attributable > 0 THEN strong::DOUBLE / attributable END AS attributable_fraction,
       CASE WHEN content > 0 THEN strong::DOUBLE / content END AS content_fraction, CASE WHEN content > 0 THEN strong_content::DOUBLE / content END AS repaired_content_fraction FROM c
"""


def _event_log(events: DataFrame) -> DataFrame:
    """Events as a log: signup publishes a wave of two calls, error drains, view and click are flows."""
    kind = F.col("event_type")
    phase = F.when(kind == "signup", "driving").when(kind == "error", "drained")
    wave = F.when(kind == "signup", F.array(*[F.concat(F.col("event_id").cast("string"), F.lit(x)) for x in "ab"]))
    return events.filter(kind.isin("signup", "error", "view", "click")).select("event_id", "ts", F.col("user_id").alias("key"), phase.alias("phase"), wave.alias("active"))


def asof_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was in flight for its user when each flow was seen; null before any state, empty after a drain."""
    log = _event_log(table(spark, sf_dir, "events"))
    states = in_flight_changes(log.filter("phase IS NOT NULL"), ["key", "event_id"], "ts", "phase", "active")
    found = as_of(log.filter("phase IS NULL").select("event_id", "key", "ts"), states, ["key"], "ts", "active", "event_id")
    return found.select("event_id", F.col("key").alias("user_id"), F.array_join("active", ",").alias("in_flight"))


ASOF = """
WITH s AS (SELECT user_id, ts, CASE WHEN event_type = 'signup' THEN event_id || 'a,' || event_id || 'b' ELSE '' END AS in_flight FROM events
           WHERE event_type IN ('signup', 'error') QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1),
f AS (SELECT event_id, user_id, ts FROM events WHERE event_type IN ('view', 'click'))
SELECT f.event_id, f.user_id, s.in_flight FROM f ASOF LEFT JOIN s ON f.user_id = s.user_id AND f.ts >= s.ts
"""


def window_of_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each assistant turn the last user turn at or before it."""
    turns = table(spark, sf_dir, "conversations")
    flows = turns.filter("role = 'assistant'").select("conv_id", "turn")
    calls = turns.filter("role = 'user'").select("conv_id", "turn", F.col("turn").alias("call_turn"))
    return as_of(flows, calls, ["conv_id"], "turn", "call_turn", "call_turn")


TURNS = """
SELECT a.conv_id, a.turn, max(u.turn) AS call_turn
FROM (SELECT conv_id, turn, row_number() OVER () AS r FROM conversations WHERE role = 'assistant') a
LEFT JOIN (SELECT conv_id, turn FROM conversations WHERE role = 'user') u ON u.conv_id = a.conv_id AND u.turn <= a.turn
GROUP BY a.conv_id, a.turn, a.r
"""


def streaming_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same question as asof_in_flight, asked of a stream with keyed state."""
    found = replay(spark, f"{sf_dir}/events.parquet", _event_log)
    return found.select("event_id", F.col("key").cast("long").alias("user_id"), F.array_join("in_flight", ",").alias("in_flight"))


def _page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "^[^/?#]*?://([^/?#]*)", 1)
    return table(spark, sf_dir, "pages").select((F.col("page_id") % 8).alias("server"), F.lower(host).alias("host"), "page_id")


def disclosure_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations of each server as declared, known or new, and whether it is to be reviewed."""
    declared = spark.createDataFrame([(s, d, "declared") for s in range(7) for d in DECLARED] + [(s, k, "known") for s in range(7) for k in KNOWN], "server long, suffix string, status string")
    return reports.disclosure(_page_hosts(spark, sf_dir), declared)


DISCLOSURE = f"""
WITH h AS (SELECT DISTINCT page_id % 8 AS server, lower(regexp_extract(url, '^[^/?#]*?://([^/?#]*)', 1)) AS h FROM pages),
s AS (SELECT server, CASE WHEN server = 7 THEN 'new' WHEN {' OR '.join(_ENDS.format(d) for d in DECLARED)} THEN 'declared' WHEN {' OR '.join(_ENDS.format(k) for k in KNOWN)} THEN 'known' ELSE 'new' END AS status FROM h),
c AS (SELECT server, count(*) FILTER (WHERE status = 'declared') AS declared, count(*) FILTER (WHERE status = 'known') AS known, count(*) FILTER (WHERE status = 'new') AS new FROM s GROUP BY 1)
SELECT *, CASE WHEN new > 0 THEN 'review_required' ELSE 'clear' END AS verdict FROM c
"""


def control_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the destinations under review are reached in the control run too."""
    hosts = _page_hosts(spark, sf_dir).select("host", (F.col("page_id") % 2 == 0).alias("control"))
    review = hosts.filter(F.col("host").startswith("m.") | F.col("host").startswith("www.")).select("host")
    return reports.control(hosts.filter("control").select("host"), hosts.filter("NOT control").select("host"), review)


CONTROL = """
WITH h AS (SELECT lower(regexp_extract(url, '^[^/?#]*?://([^/?#]*)', 1)) AS host, page_id % 2 = 0 AS control FROM pages),
c AS (SELECT DISTINCT host FROM h WHERE control), s AS (SELECT DISTINCT host FROM h WHERE NOT control),
r AS (SELECT DISTINCT host FROM h WHERE host LIKE 'm.%' OR host LIKE 'www.%'),
n AS (SELECT (SELECT count(*) FROM r) AS under_review, (SELECT count(*) FROM r WHERE host IN (SELECT host FROM c)) AS reproduced,
             (SELECT count(*) FROM c WHERE host NOT IN (SELECT host FROM s)) AS only_in_control, (SELECT count(*) FROM s WHERE host NOT IN (SELECT host FROM c)) AS only_in_subject)
SELECT under_review, reproduced, under_review - reproduced AS not_reproduced, only_in_control, only_in_subject,
       CASE WHEN under_review = 0 THEN 'nothing_under_review' WHEN reproduced = 0 THEN 'cause_not_reproduced' WHEN reproduced < under_review THEN 'cause_partially_reproduced' ELSE 'cause_reproduced' END AS verdict FROM n
"""

def json_string_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String leaves of conversations as nested documents, and of the events' properties, which have none."""
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", F.lit("c"), "conv_id", "turn").alias("doc"),
        F.to_json(F.struct("turn", F.struct("role", F.array(F.struct(F.col("text").alias("said")), F.struct(F.lit(None).cast("string").alias("said"))).alias("more")).alias("say"))).alias("body"),
    )
    props = table(spark, sf_dir, "events").select(F.concat_ws("/", F.lit("e"), "event_id").alias("doc"), F.col("props").alias("body"))
    broken = table(spark, sf_dir, "pages").select(F.concat_ws("/", F.lit("p"), "page_id").alias("doc"), F.col("html").alias("body"))
    return structure.string_leaves(turns.unionByName(props).unionByName(broken), ["doc"], "body")


LEAVES = """
WITH d AS (SELECT 'c/' || conv_id || '/' || turn AS doc, to_json({'turn': turn, 'say': {'role': role, 'more': [{'said': text}, {'said': NULL}]}}) AS body FROM conversations
           UNION ALL SELECT 'e/' || event_id, CAST(props AS JSON) FROM events)
SELECT doc, t.atom ->> '$' AS leaf FROM d, json_tree(d.body) AS t WHERE t.type = 'VARCHAR'
"""


def argument_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tools: a schema of two properties, of which some are strings, addresses or required; b may be in an item."""
    text = F.when(F.col("p_partkey") % 2 == 0, '{"type": "string"').otherwise('{"type": "integer"')
    uri = F.when(F.col("p_size") % 3 == 0, ', "format": "uri"}').otherwise("}")
    second = F.when(F.col("p_size") % 4 == 0, '{"type": "array", "items": {"enum": ["x", 1]}}').when(F.col("p_size") % 4 == 1, '{"type": "string", "enum": ["y"]}').otherwise('{"enum": [1, 2]}')
    required = F.element_at(F.array(*map(F.lit, ("", '"a"', '"b", "gone"', '"a", "b"'))), (F.col("p_partkey") % 4 + 1).cast("int"))
    schema = F.concat(F.lit('{"properties": {"a": '), text, uri, F.lit(', "b": '), second, F.lit('}, "required": ['), required, F.lit('], "examples": [{"type": "string"}]}'))
    tools = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("tool"), schema.alias("schema"))
    return reports.argument_shapes(tools).groupBy("shape", "declared_enum").agg(F.count("*").alias("tools"))


SHAPES = """
WITH p AS (SELECT p_partkey % 2 = 0 AS a, p_size % 3 = 0 AS uri, p_size % 4 = 1 AS b, p_size % 4 = 0 AS items, p_partkey % 4 IN (1, 3) AS need_a, p_partkey % 4 IN (2, 3) AS need_b FROM part),
n AS (SELECT *, CAST(a AND need_a AS INTEGER) + CAST(b AND need_b AS INTEGER) AS strings FROM p)
SELECT CASE WHEN strings = 2 THEN 'structured' WHEN strings = 1 AND a AND need_a AND uri THEN 'single_value_declared_uri' WHEN strings = 1 OR a OR b OR items THEN 'single_value' ELSE 'no_string' END AS shape,
       b AND need_b AS declared_enum, count(*) AS tools FROM n GROUP BY 1, 2
"""

QUERIES = [
    Query("url_tokens", url_tokens, URL_TOKENS),
    Query("containment_candidates", containment_candidates, CANDIDATES),
    Query("sibling_simulation", sibling_simulation, SIMULATION),
    Query("host_suffix_class", host_suffix_class, HOST_CLASS),
    Query("attribution_grades", attribution_grades, GRADES_SQL),
    Query("grades_by_window", grades_by_window, WINDOWS_SQL),
    Query("denominators", denominators, DENOMINATORS_SQL),
    Query("asof_in_flight", asof_in_flight, ASOF),
    Query("window_of_in_flight", window_of_in_flight, TURNS),
    Query("streaming_in_flight", streaming_in_flight, ASOF),
    Query("disclosure_check", disclosure_check, DISCLOSURE),
    Query("control_compare", control_compare, CONTROL),
    Query("json_string_leaves", json_string_leaves, LEAVES),
    Query("argument_shapes", argument_shapes, SHAPES),
]
