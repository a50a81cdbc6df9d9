"""Record types and closed vocabularies of a run: calls, flows, manifest, in-flight state."""

from __future__ import annotations

from pyspark.sql import types as T

# The vocabularies of the records.
PHASES = ("launcher", "handshake", "driving", "drained")
PRE_CALL_PHASES = ("launcher", "handshake")
DEST_CLASSES = ("package_infrastructure", "third_party", "local")
PASSES = ("sequential", "concurrent", "bench", "selftest", "control")
OCCURRENCES = ("observed", "connection_only")
PROVENANCES = ("none", "context", "arguments", "both", "unknown")
GRADES = ("TRACE_PROPAGATED", "CONTENT_UNIQUE", "CONTENT_MATCH_UNCONTESTED", "CONTENT_AMBIGUOUS", "TEMPORAL_ONLY", "UNATTRIBUTED")
STRONG_GRADES = ("TRACE_PROPAGATED", "CONTENT_UNIQUE")
CHANNELS = ("none", "target", "body", "both")
NODE_CATEGORIES = ("local", "self_hostable", "remote_leaf")
OBSERVABILITY = ("proxy_observed", "egress_unobserved", "no_egress_expected")
UNATTRIBUTED_CALL = "<unattributed>"
# Why a flow has its grade. {active} and {matching} are counts of calls.
REASONS = {
    "pre_launch": "pre-launch: seen while the launcher was resolving the package, before the server process existed, so no tool call could have caused it",
    "trace": "our traceparent appeared in the outbound request",
    "one_token": "a single structural token is not strong evidence on its own: one token identifies a class, not a call",
    "unique": "fragment present in exactly 1 of {active} concurrent calls",
    "ambiguous": "fragment present in {matching} of {active} concurrent calls; content did not discriminate",
    "uncontested": "fragment matched with only one call active: no competing candidate existed, so nothing was discriminated",
    "ineligible": "ineligible: package infrastructure traffic, carries no tool-call arguments",
    "temporal": "time window and pid, with exactly one call in flight",
    "temporal_set": "time window covers {active} concurrent calls: correlation identifies no single call",
    "no_evidence": "no trace, no content match, and no temporal correlation available",
    "unreadable": "request unreadable and no temporal correlation available",
}


def _fields(**kinds: str) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(k) if k not in _ATOMS else _ATOMS[k]) for n, k in kinds.items()])


_ATOMS: dict[str, T.DataType] = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "strings": T.ArrayType(T.StringType()),
    "text_map": T.MapType(T.StringType(), T.StringType()),
    "flags": T.MapType(T.StringType(), T.MapType(T.StringType(), T.BooleanType())),
}

CALLS = _fields(
    run_id="string", server_id="string", call_id="string", tool_name="string", args_present="boolean",
    traceparent="string", ok="boolean", error="string", stdout_noise_lines="int", wave_size="int",
)
FLOWS = _fields(
    run_id="string", server_id="string", call_id="string", ts="double", dest_host="string", dest_ip="string",
    scheme="string", method="string", body_observed="boolean", our_traceparent_present="boolean",
    target_bytes="long", target_matched_bytes="long", body_bytes="long", body_matched_bytes="long",
    matched_refs="strings", causal="boolean", causal_channel="string", node_category="string",
    has_time_and_pid="boolean", occurrence="string", provenance="string", active_calls_in_window="int",
    matching_calls_in_window="int", structural_match="boolean", structural_contained="int",
    structural_candidates="int", non_discriminating_calls="int", candidate_token_count="int",
    constant_client_path="boolean", phase="string", dest_class="string",
)
MANIFEST = _fields(
    run_id="string", created="string", salt_fixed="boolean", k="int", w="int", corpus_sha256="string",
    server_ids="strings", tool_versions="text_map", server_protocol_versions="text_map", pass_name="string",
    notes="string", credential_presence="flags", servers_expecting_egress="strings",
)
#: What a field that an older run lacks reads as.
DEFAULTS = {
    "calls": {"ok": True, "error": "", "stdout_noise_lines": 0, "wave_size": 0},
    "flows": {
        "occurrence": "", "provenance": "", "active_calls_in_window": 0, "matching_calls_in_window": 0,
        "structural_match": False, "structural_contained": 0, "structural_candidates": 0,
        "non_discriminating_calls": 0, "candidate_token_count": 0, "constant_client_path": False,
        "phase": "", "dest_class": "",
    },
}
IN_FLIGHT = T.StructType(
    [
        T.StructField("server_id", T.StringType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("phase", T.StringType()),
        T.StructField("active", T.ArrayType(T.StructType([T.StructField("call_id", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType()))]))),
    ]
)
