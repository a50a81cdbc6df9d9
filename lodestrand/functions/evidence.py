"""The evidence model: what a flow shows, and how strongly it ties to a call. Column expressions only,
so that batch and streaming share them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.schema import PRE_CALL_PHASES, REASONS

#: z of a two-sided 95 % interval (fixed value).
Z95 = 1.959963984540054


def call_caused(phase: str | Column = "phase") -> Column:
    """Not seen before any call could be; an unrecorded phase counts as possible."""
    return ~F.coalesce(F.col(phase) if isinstance(phase, str) else phase, F.lit("")).isin(*PRE_CALL_PHASES)


def package_infrastructure(listed: Column, dest_class: str = "dest_class") -> Column:
    """The class that a record carries wins over the list."""
    carried = F.coalesce(F.col(dest_class), F.lit(""))
    return F.when(carried != "", carried == "package_infrastructure").otherwise(F.coalesce(listed, F.lit(False)))


def attributing_match() -> Column:
    """The structural signal; the older one counts where no structural field was written."""
    return F.col("structural_match") | (F.col("causal") & (F.col("structural_contained") == 0) & (F.col("structural_candidates") == 0))


def attributing_candidates() -> Column:
    return F.when(F.col("structural_match"), F.col("structural_candidates")).otherwise(F.col("matching_calls_in_window"))


def occurrence(observed: Column) -> Column:
    return F.when(observed, "observed").otherwise("connection_only")


def provenance(observed: Column, context: Column, arguments: Column) -> Column:
    """What was not readable is unknown, never none."""
    return F.when(~observed, "unknown").when(context & arguments, "both").when(context, "context").when(arguments, "arguments").otherwise("none")


def causal_channel(target: Column, body: Column) -> Column:
    return F.when(target & body, "both").when(target, "target").when(body, "body").otherwise("none")


def grade(
    trace: Column, match: Column, active: Column, matching: Column, eligible: Column, correlated: Column, possible: Column, tokens: Column
) -> Column:
    """struct(grade, reason). The order of the rungs is the meaning: evidence before a call existed counts
    for nothing, direct evidence is never withheld by a list, and a set of calls is no call."""
    several = active > 1

    def rung(name: str, reason: str) -> Column:
        text = F.lit(REASONS[reason])
        for key, count in (("{active}", active), ("{matching}", matching)):
            if key in REASONS[reason]:
                text = F.replace(text, F.lit(key), count.cast("string"))
        return F.struct(F.lit(name).alias("grade"), text.alias("reason"))

    return (
        F.when(~possible, rung("UNATTRIBUTED", "pre_launch"))
        .when(trace, rung("TRACE_PROPAGATED", "trace"))
        .when(match & (tokens == 1), rung("CONTENT_AMBIGUOUS", "one_token"))
        .when(match & several & (matching == 1), rung("CONTENT_UNIQUE", "unique"))
        .when(match & several, rung("CONTENT_AMBIGUOUS", "ambiguous"))
        .when(match, rung("CONTENT_MATCH_UNCONTESTED", "uncontested"))
        .when(~eligible, rung("UNATTRIBUTED", "ineligible"))
        .when(correlated & (active == 1), rung("TEMPORAL_ONLY", "temporal"))
        .when(correlated & several, rung("UNATTRIBUTED", "temporal_set"))
        .when(correlated, rung("UNATTRIBUTED", "no_evidence"))
        .otherwise(rung("UNATTRIBUTED", "unreadable"))
    )


def ratio(part: Column, whole: Column) -> Column:
    """0.0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def fraction(part: Column, whole: Column) -> Column:
    """Null where there is nothing to divide by: not measured is not zero."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))


def wilson(successes: Column, n: Column, z: float = Z95) -> Column:
    """struct(low, high): the Wilson score interval, exact at its ends; (0, 1) for n = 0."""
    s, m = successes.cast("double"), n.cast("double")
    p = s / m
    spread = z / (1 + z * z / m) * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    low = F.when((n == 0) | (s == 0), 0.0).otherwise(F.greatest(F.lit(0.0), centre - spread))
    high = F.when((n == 0) | (s == m), 1.0).otherwise(F.least(F.lit(1.0), centre + spread))
    return F.struct(low.alias("low"), high.alias("high"))


def detectability(run: Column, k: int, w: int) -> Column:
    """Which floor a common run of bytes clears."""
    return F.when(run >= k + w - 1, "at_or_above_winnowing_floor").when(run >= k, "matched_but_below_winnowing_floor").otherwise("below_k_invisible")


def attributed_call(discriminating: Column, contained: Column, matching: Column, active: Column) -> Column:
    """Which call a flow is recorded against, from arrays of call ids; null for none.

    A flow never goes back to a call that discrimination rejected.
    """
    return (
        F.when(F.size(discriminating) == 1, F.get(discriminating, F.lit(0)))
        .when((F.size(contained) > 0) & (F.size(discriminating) == 0), F.lit(None))
        .when(F.size(matching) == 1, F.get(matching, F.lit(0)))
        .when((F.size(active) == 1) & (F.size(contained) == 0), F.get(active, F.lit(0)))
    )


def traceparent_present(traceparent: Column, header: Column, body: Column) -> Column:
    """Ours, in the header or anywhere in the body; an empty one is in nothing."""
    return F.coalesce((traceparent != "") & ((header == traceparent) | F.contains(body, traceparent)), F.lit(False))


def constant_path(host: Column, target: Column, hosts: list[str], paths: list[str], prefixes: list[str]) -> Column:
    """A target that a client asks for whatever the call was; the query does not count."""
    path = F.split_part(F.coalesce(target, F.lit("")), F.lit("?"), F.lit(1))
    hit = (host != "") & host.isin(*hosts) if hosts else F.lit(False)
    hit = hit | path.isin(*paths) if paths else hit
    for prefix in prefixes:
        hit = hit | path.startswith(prefix)
    return F.coalesce(hit, F.lit(False))


def scrubbed_error(error: Column) -> Column:
    """The kind of an error and its JSON-RPC code, without the message; a scrubbed one stays as it is."""
    kind = F.trim(F.split_part(error, F.lit(":"), F.lit(1)))
    code = F.regexp_extract(error, r"'code':\s*(-?\d+)", 1)
    coded = F.concat(kind, F.lit(": tools/call error, JSON-RPC code "), code, F.lit(", message redacted"))
    done = (F.coalesce(error, F.lit("")) == "") | F.contains(error, F.lit("message redacted"))
    return F.when(done, error).when(code != "", coded).otherwise(F.concat(kind, F.lit(": message redacted")))
