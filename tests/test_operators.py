import datetime as dt
import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from lodestrand import cli
from lodestrand.operators import bench, calibration, control, disclosure, matching, numbers, redaction, reports
from lodestrand.operators import distribution as distributions
from lodestrand.operators.containment import candidates, simulate
from lodestrand.operators.distribution import distribution, zero_filled
from lodestrand.operators.temporal import as_of, in_flight_changes
from lodestrand.plans import relational
from lodestrand.schema import CALLS, DEFAULTS, FLOWS
from lodestrand.sources import corpora, pcap, runs


@pytest.mark.parametrize(("values", "want"), [([89, 2], (2, 2, 89, 89)), ([], (0, 0, 0, 0)), ([7], (1, 7, 7, 7)), (list(range(1, 101)), (100, 50, 95, 100))])
def test_nearest_rank(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert tuple(distribution(df, "v").select("n", "p50", "p95", "max").first()) == want


def test_zero_fill_keeps_what_is_outside(spark):
    df = spark.createDataFrame([("a", 2), ("z", 1)], "k string, n long")
    assert {r.k: r.n for r in zero_filled(df, "k", ["a", "b"]).collect()} == {"a": 2, "b": 0, "z": 1}


def brute_candidates(calls, request):
    contained = [c for c, t in calls.items() if t and t <= request]
    mute = [c for c, t in calls.items() if t and not t - set().union(*(u for d, u in calls.items() if d != c))]
    keep = [c for c in contained if c not in mute]
    return contained, keep, len(mute), len(calls[keep[0]]) if len(keep) == 1 else 0


def test_containment_matches_brute_force(spark):
    rng = random.Random(7)
    waves = {w: ({c: set(rng.sample("abcdef", rng.randint(0, 3))) for c in range(4)}, {r: set(rng.sample("abcdefg", rng.randint(0, 6))) for r in range(4)}) for w in range(25)}
    calls = spark.createDataFrame([(w, c, sorted(t)) for w, (cs, _) in waves.items() for c, t in cs.items()], "wave int, call int, tokens array<string>")
    requests = spark.createDataFrame([(w, r, sorted(t)) for w, (_, rs) in waves.items() for r, t in rs.items()], "wave int, request int, tokens array<string>")
    got = {(r.wave, r.request): (r.contained, r.discriminating, r.non_discriminating, r.token_count) for r in candidates(calls, requests).collect()}
    assert got == {(w, r): brute_candidates(cs, t) for w, (cs, rs) in waves.items() for r, t in rs.items()}


def test_as_of_ties_and_drains(spark):
    log = spark.createDataFrame([("s", 1.0, "driving", ["c1"], 1), ("s", 2.0, "driving", ["c2"], 2), ("s", 2.0, "driving", ["c3"], 3), ("s", 4.0, "drained", ["c3"], 4)], "server string, ts double, phase string, active array<string>, tie int")
    states = in_flight_changes(log, ["server", "tie"], "ts", "phase", "active")
    flows = spark.createDataFrame([(i, "s", t) for i, t in enumerate([0.5, 1.0, 1.5, 2.0, 4.0, 9.0])], "flow int, server string, ts double")
    got = {r.flow: r.active for r in as_of(flows, states, ["server"], "ts", "active", "tie").collect()}
    assert got == {0: None, 1: ["c1"], 2: ["c1"], 3: ["c3"], 4: [], 5: []}


def test_longest_common_run(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choice("ab") for _ in range(20)), "".join(rng.choice("ab") for _ in range(25))) for _ in range(20)]

    def brute(a, b):
        return max((n for n in range(1, 21) for i in range(len(a) - n + 1) if a[i : i + n] in b), default=0)

    df = spark.createDataFrame([(i, bytearray(a.encode()), bytearray(b.encode())) for i, (a, b) in enumerate(pairs)], "i int, a binary, b binary")
    got = {r.i: r.run for r in matching.longest_common_run(df.select("i", "a"), df.select("i", "b"), ["i"]).collect()}
    assert got == {i: brute(a, b) for i, (a, b) in enumerate(pairs)}


def test_contamination(spark):
    secret = "the planted secret phrase of some length"
    refs = spark.createDataFrame([("r1", bytearray(secret.encode())), ("r2", bytearray(b"another reference that is absent here"))], "ref string, data binary")
    docs = spark.createDataFrame([(1, bytearray(f"before {secret} after".encode())), (2, bytearray(b"nothing")), (3, None)], "doc int, data binary")
    got = matching.contamination(refs, "ref", "data", docs, "doc", "data", 22).collect()
    assert [(r.doc, r.matched_bytes, r.refs) for r in got] == [(1, len(secret), ["r1"])]


def test_choice_rule(spark):
    rows = [(8, 1.0, 0.5, 0), (16, 1.0, 0.2, 0), (22, 1.0, 0.2, 0), (30, 0.5, 0.0, 0), (4, 1.0, 0.0, 1)]
    df = spark.createDataFrame(rows, "k int, recall double, rate double, known_negatives int")
    assert matching.choose(df).first()[0] == 16
    assert matching.choose(df.filter("k = 4")).first()[0] is None


FLOW = {
    "run_id": "r", "server_id": "s1", "call_id": None, "ts": 1.0, "dest_host": "", "dest_ip": "", "scheme": "https", "method": "GET", "body_observed": True,
    "our_traceparent_present": False, "target_bytes": 10, "target_matched_bytes": 0, "body_bytes": 20, "body_matched_bytes": 0, "matched_refs": [],
    "causal": False, "causal_channel": "none", "node_category": "remote_leaf", "has_time_and_pid": True,
}
CALL = {"run_id": "r", "server_id": "s1", "call_id": "c1", "tool_name": "t", "args_present": True, "traceparent": "tp"}


def make_run(tmp_path, calls, flows, **manifest):
    tmp_path.mkdir(exist_ok=True)
    (tmp_path / "calls.jsonl").write_text("".join(json.dumps(CALL | c) + "\n" for c in calls))
    (tmp_path / "flows.jsonl").write_text("".join(json.dumps(FLOW | f) + "\n" for f in flows) + "\n")
    (tmp_path / "manifest.json").write_text(json.dumps({"run_id": "r", "created": "2026", "pass_name": "sequential"} | manifest, indent=1))
    return str(tmp_path)


@pytest.fixture
def run(spark, tmp_path):
    calls = [{"call_id": "c1"}, {"call_id": "c2", "wave_size": 2}, {"call_id": "c3", "server_id": "s2", "ok": False}]
    flows = [
        {"call_id": "c1", "dest_host": "a.example", "active_calls_in_window": 1, "our_traceparent_present": True, "provenance": "none", "occurrence": "observed"},
        {"call_id": "c1", "dest_host": "a.example", "active_calls_in_window": 1, "causal": True, "causal_channel": "body", "provenance": "arguments"},
        {"call_id": "c1", "dest_host": "reg.pkg.example", "active_calls_in_window": 2, "structural_match": True, "structural_contained": 2, "structural_candidates": 1, "candidate_token_count": 2},
        {"call_id": "c2", "dest_host": "10.0.0.1", "active_calls_in_window": 1, "target_matched_bytes": 4, "body_matched_bytes": 6, "matched_refs": ["x"], "provenance": "context"},
        {"call_id": "", "dest_host": "reg.pkg.example", "phase": "launcher"},
    ]
    folder = make_run(tmp_path / "run", calls, flows, server_protocol_versions={"s1": "2025"}, servers_expecting_egress=["s1", "s2"])
    return runs.load_run(spark, folder)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_numbers(spark, run):
    listed = spark.createDataFrame([("pkg.example",)], "suffix string")
    got = {r.figure: (r.n, r.p50, r.p95, r["max"]) for r in numbers.connections_per_call(run, listed).collect()}
    assert got == {"connections_raw": (3, 1, 3, 3), "distinct_hosts": (3, 1, 2, 2), "excluding_package_infrastructure": (3, 1, 2, 2)}
    assert {r.figure for r in numbers.connections_per_call(run).collect()} == {"connections_raw", "distinct_hosts"}
    assert tuple(numbers.connection_counts(run, listed).first()) == (1, 4, 2) and numbers.connection_counts(run).first()[2] is None
    assert tuple(numbers.domains_per_call(run).select("n", "p50", "p95", "max").first()) == (3, 1, 2, 2)
    assert rows(numbers.observability(run), "state", "servers") == [("egress_unobserved", 0), ("no_egress_expected", 1), ("proxy_observed", 1)]
    assert rows(numbers.propagation(run), "revision", "servers_total", "servers_propagating") == sorted([("2025", 1, 1), ("unknown", 1, 0), (None, 2, 1)], key=str)
    four = numbers.provenance_coverage(run).first()
    assert (four.target_matched_bytes, four.body_matched_bytes, four.matched_bytes_total, four.flows_with_context_match) == (4, 6, 10, 1)
    assert dict(rows(numbers.claims(run, "provenance"), "provenance", "n"))["both"] == 0
    graded = numbers.graded(run, listed).cache()
    assert dict(rows(numbers.grades(graded), "grade", "n")) == {"TRACE_PROPAGATED": 1, "CONTENT_UNIQUE": 1, "CONTENT_MATCH_UNCONTESTED": 1, "CONTENT_AMBIGUOUS": 0, "TEMPORAL_ONLY": 1, "UNATTRIBUTED": 1}
    assert dict(rows(numbers.channels(graded), "causal_channel", "n")) == {"target": 0, "body": 1, "both": 0}
    assert sum(r.n for r in numbers.windows(graded).collect()) == sum(r.n for r in numbers.reasons(graded).collect()) == 5
    five = numbers.attribution(graded).first()
    # A strong flow on the list is in the numerator and not in the denominator.
    assert (five.strong, five.attributable, five.strong_attributable) == (2, 3, 1)
    assert numbers.attribution(graded, constant_list=False).first().content is None
    assert numbers.instrument(graded).first().state == "present" and numbers.regime(graded).first().regime == "concurrent"
    assert {r.active_calls_in_window: r.contained_but_not_candidate for r in numbers.discrimination(graded).collect()} == {1: 0, 2: 1}
    hosted = spark.createDataFrame([("a.example", "self_hostable")], "suffix string, class string")
    six = {r["class"]: (r.hosts, r.fraction) for r in numbers.self_hostable(run, hosted).collect()}
    assert six == {"local": (1, 2 / 3), "self_hostable": (1, 2 / 3), "remote_leaf": (1, 2 / 3)}
    assert rows(numbers.driving(run), "wave_size", "calls", "errored") == [("2", 1, 0), ("unrecorded", 2, 1)]
    assert dict(rows(numbers.phases(run), "phase", "flows")) == {"launcher": 1, "unrecorded": 4}


def test_aggregates_name_nothing(spark, run):
    figures = numbers.all_numbers(run, None)
    results = [numbers.connections_per_call(run), numbers.observability(run), numbers.propagation(run), numbers.grades(numbers.graded(run)), figures, numbers.document(run, figures)]
    text = str([r.asDict() for df in results for r in df.collect()])
    assert not any(name in text for name in ("a.example", "s1", "c1"))


def test_records(spark, tmp_path, run):
    with pytest.raises(Exception, match="unknown field"):
        runs.load_run(spark, make_run(tmp_path / "odd", [{"surprise": 1}], [])).calls.collect()
    (tmp_path / "bad.jsonl").write_text('{"run_id": "r"\n')
    with pytest.raises(Exception):
        runs.read_records(spark, str(tmp_path / "bad.jsonl"), CALLS, DEFAULTS["calls"]).collect()
    assert runs.read_optional(spark, str(tmp_path / "none.jsonl"), FLOWS).count() == 0
    runs.write_records(run.calls, str(tmp_path / "out"), ["call_id"], single=True)
    assert runs.read_records(spark, str(tmp_path / "out"), CALLS).exceptAll(run.calls).count() == 0
    lines = spark.createDataFrame([('{"run_id": "a"}',), ("noise",), ('{"run_id": 1',)], "value string")
    assert {r.kind: r.n for r in runs.append_tolerantly(lines, CALLS, str(tmp_path / "kept")).collect()} == {"good": 1, "bad": 2}
    assert runs.dead_letters(spark, str(tmp_path / "kept")).count() == 2
    assert runs.noise_tolerant(lines, CALLS)[1].first()[0] == 2
    assert json.loads(runs.write_manifest(run.manifest))["run_id"] == "r"
    with pytest.raises(runs.RunError):
        runs.refuse_control(runs.load_run(spark, make_run(tmp_path / "control", [], [], pass_name="control")))
    manifests = spark.createDataFrame([("a", "1", "bench"), ("b", "3", "control"), ("c", "2", "bench")], "run_id string, created string, pass_name string")
    assert (runs.latest(manifests), runs.latest(manifests, "bench"), runs.latest(manifests, "x")) == ("b", "c", None)
    assert runs.undriven(run.calls, run.calls.filter("call_id = 'c1'"), "did not start").count() == 2


def test_lists_that_are_absent_are_none(spark, tmp_path):
    assert corpora.suffix_list(spark, str(tmp_path / "none.json")) is None
    assert corpora.declared_destinations(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "list.json").write_text('{"list_name": "l", "version": "1", "suffixes": ["A.example"]}')
    got = corpora.suffix_list(spark, str(tmp_path / "list.json"))
    assert (got.name, got.rows.first()[0], len(got.sha256)) == ("l", "a.example", 64)
    (tmp_path / "half.json").write_text('{"half": "held-out", "families": [{"family": "f", "calls": [{"call_id": "1", "arguments": "{}", "target": "/", "body": "", "information": []}]}]}')
    with pytest.raises(corpora.PurposeError):
        corpora.negative_corpus(spark, str(tmp_path / "half.json"), "calibration")
    assert corpora.negative_corpus(spark, str(tmp_path / "half.json"), "held-out").count() == 1


def test_capture(spark, tmp_path, run):
    def packet(dst, port, flags):
        ip = bytes([0x45, 0, 0, 40, 0, 0, 0, 0, 64, 6, 0, 0, 10, 0, 0, 9, *map(int, dst.split("."))])
        frame = bytes(12) + b"\x08\x00" + ip + struct.pack("!HHIIBBHHH", 1, port, 0, 0, 0x50, flags, 0, 0, 0)
        return struct.pack("<IIII", 0, 0, len(frame), len(frame)) + frame

    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    path = tmp_path / "x.pcap"
    path.write_bytes(head + packet("1.2.3.4", 443, 2) * 2 + packet("1.2.3.4", 443, 0x12) + packet("127.0.0.1", 80, 2) + packet("5.6.7.8", 80, 2))
    got = pcap.syn_counts(spark, str(path))
    assert rows(got, "destination", "syns") == [("1.2.3.4:443", 2), ("127.0.0.1:80", 1), ("5.6.7.8:80", 1)]
    flows = spark.createDataFrame([("1.2.3.4",)], "dest_ip string")
    assert rows(pcap.unobserved(got, flows), "destination", "syns") == [("5.6.7.8:80", 1)]
    assert rows(pcap.by_server(run.calls, run.flows), "server_id", "calls", "proxy_flows") == [("s1", 2, 5), ("s2", 1, 0)]
    with pytest.raises(pcap.CaptureError):
        pcap.connection_attempts(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 147))
    with pytest.raises(pcap.CaptureError):
        pcap.connection_attempts(b"no capture")


def test_control_verdicts(spark):
    hosts = lambda *h: spark.createDataFrame([(x,) for x in h], "host string")
    verdict = lambda c, s, r: reports.control(hosts(*c), hosts(*s), hosts(*r)).first().verdict
    assert verdict("ab", "bc", []) == "nothing_under_review"
    assert verdict("ab", "bc", "b") == "cause_reproduced"
    assert verdict("ab", "bc", "bc") == "cause_partially_reproduced"
    assert verdict("ab", "bc", "c") == "cause_not_reproduced"


def test_instrument(spark):
    sent = spark.createDataFrame([("h1", ""), ("h1", ""), ("h2", None), ("h3", "failed")], "dest_host string, error string")
    seen = spark.createDataFrame([("h1",), ("h1",), ("h1",), ("other",)], "dest_host string")
    assert tuple(numbers.instrument_recall(sent, seen).first()) == (3, 2, 1, 2 / 3)
    claimed = spark.createDataFrame(
        [("u", "CONTENT_UNIQUE", "c1", "c1", "arguments", True, True), ("u", "CONTENT_UNIQUE", "c2", "c1", "arguments", True, True), ("n", "UNATTRIBUTED", None, "c3", "context", False, True), ("n", "TRACE_PROPAGATED", "c4", "c4", "none", True, False)],
        "cell string, grade string, claimed_call string, expected_call string, provenance string, fragment_present boolean, in_matched_channel boolean",
    )
    got = {r.cell: (r.flows, r.strong_correct, r.false_strong, r.false_provenance, r.unread_but_strong) for r in numbers.instrument_precision(claimed).collect()}
    assert got == {"u": (2, 1, 1, 0, 0), "n": (2, 1, 0, 1, 1), None: (4, 2, 1, 1, 1)}


def test_time_is_not_a_timestamp_only(spark):
    t = dt.datetime(2024, 1, 1)
    flows = spark.createDataFrame([(1, "s", t)], "flow int, server string, ts timestamp_ntz")
    states = spark.createDataFrame([("s", t, "on")], "server string, ts timestamp_ntz, state string")
    assert as_of(flows, states, ["server"], "ts", "state").first().state == "on"


def test_all_numbers_and_the_document(spark, run):
    listed = spark.createDataFrame([("pkg.example",)], "suffix string")
    hosted = spark.createDataFrame([("a.example", "self_hostable")], "suffix string, class string")
    figures = numbers.all_numbers(run, hosted, listed)
    got = {(r.number, r.figure, r.key): r.value for r in figures.collect()}
    assert got[1, "connections_raw", "max"] == 3 and got[1, "package_infrastructure_connections", ""] == 2
    assert got[3, "fraction", "pooled"] == 0.5 and got[5, "strong", ""] == 2 and got[6, "selfhostable_fraction", ""] == 2 / 3
    assert got[5, "sequential_driving", ""] == 0 and got[0, "error_fraction", ""] == 1 / 3
    (text,) = numbers.document(run, figures).first()
    held = json.loads(text)
    assert (held["run_id"], held["pass"]) == ("r", "sequential") and held["numbers"]["6"]["selfhostable_fraction"][""] == 0.6667
    # Without a list a figure is withheld, and without flows the regime is not known.
    bare = {(r.number, r.figure, r.key): r.value for r in numbers.all_numbers(runs.Run(run.manifest, run.calls, run.flows.limit(0)), None).collect()}
    assert bare[1, "excluding_package_infrastructure", ""] is None and bare[5, "sequential_driving", ""] is None
    assert "no connection" in numbers.regime(numbers.graded(run).limit(0)).first().note


def test_bench_is_refused_without_a_ledger(spark, run):
    plan = spark.createDataFrame([(3, "c1", "u", "body", "x", True)], "slot long, call_id string, cell string, channel string, expect string, fragment_present boolean")
    truth = spark.createDataFrame([("sink003.bench.invalid", "")], "dest_host string, error string")
    with pytest.raises(bench.BenchError):
        bench.compute(plan.limit(0), truth, run.flows)
    found = bench.compute(plan, truth, run.flows)
    assert found.capture.first().hosts_never_observed == 1 and found.cells.first().flows == 0


def test_disclosure(spark, run):
    declared = spark.createDataFrame([("s1", ["a.example"], ["10.0.0.1"], "stated", "npx")], "server string, hosts array<string>, known array<string>, basis string, launch_tool string")
    listed = spark.createDataFrame([("pkg.example",)], "suffix string")
    none = disclosure.check(run.flows, None, listed)
    assert none.verdict.first().verdict == "undeterminable" and none.servers.first().observed == ["10.0.0.1", "a.example", "reg.pkg.example"]
    found = disclosure.check(run.flows, declared, listed)
    (row,) = found.servers.collect()
    assert (row.declared, row.known, row.new, row.pre_first_call, row.under_review) == (["a.example"], ["10.0.0.1"], ["reg.pkg.example"], [], True)
    assert found.launcher.first().hosts == ["reg.pkg.example"] and found.verdict.first().servers_to_review == 1
    # Not started by a launcher: the same flow is the server's own.
    own = disclosure.check(run.flows, declared.withColumn("launch_tool", F.lit("python")), listed)
    assert own.servers.first().pre_first_call == ["reg.pkg.example"] and own.launcher.isEmpty()


def test_control_comparison(spark, run):
    review = spark.createDataFrame([(" A.example",), ("nowhere.example",)], "host string")
    found = control.compare(run.flows.filter("dest_host = 'a.example'"), run.flows, "s1", review)
    assert found.verdict.first().verdict == "cause_partially_reproduced"
    assert {r.side: (r.flows, r.causal_flows, r.alive) for r in found.matching.collect()} == {"control": (2, 1, True), "subject": (5, 1, True)}
    assert {(r.side, r.host, r.flows) for r in found.carried.collect()} == {("control", "a.example", 2), ("subject", "a.example", 2)}
    with pytest.raises(ValueError):
        control.publishable(found, " ")
    assert control.publishable(found, "by whom", repetitions=3).first().repetitions == 3


def test_redaction_is_injective_and_keeps_the_numbers(spark, tmp_path):
    calls = [{"call_id": "s1-1", "error": "Oops: {'code': -32602, 'message': 'Vendor'}"}, {"call_id": "s2-1", "server_id": "s2", "tool_name": "u"}]
    flows = [{"call_id": "s1-1", "dest_host": h, "ts": float(i)} for i, h in enumerate(["b.example", "reg.pkg.example", "localhost", "a.example", "b.example", ""])]
    run = runs.load_run(spark, make_run(tmp_path / "raw", calls, flows, server_ids=["s2", "s1"], server_protocol_versions={"s1": "2025"}))
    listed = spark.createDataFrame([("pkg.example",)], "suffix string")
    got = redaction.redact(run, "redacted", listed)
    assert [r.dest_host for r in got.flows.orderBy("ts").collect()] == ["third-party-0", "package-registry-0", "loopback-proxy", "third-party-1", "third-party-0", ""]
    assert [(r.server_id, r.call_id, r.tool_name) for r in got.calls.orderBy("server_id").collect()] == [("server-0", "server-0-1", "tool-0"), ("server-1", "server-1-1", "tool-0")]
    assert "Vendor" not in str(got.calls.collect()) and len({r.dest_ip for r in got.flows.collect()}) == 5
    assert got.manifest.first().server_protocol_versions == {"server-1": "2025"}
    before, after = (rows(numbers.number_one(r, listed if r is run else None), "figure", "key", "value") for r in (run, got))
    assert set(before) - set(after) <= {x for x in before if x[0].endswith("infrastructure") or x[0].endswith("infrastructure_connections")}
    assert rows(numbers.grades(numbers.graded(run, listed)), "grade", "n") == rows(numbers.grades(numbers.graded(got)), "grade", "n")
    with pytest.raises(runs.RunError):
        redaction.redact(got, "again")


def test_calibration_guards_and_medians(spark):
    items = spark.createDataFrame([(0, 1, bytearray(b"x" * 30), bytearray(b"x" * 30), bytearray(b""))], "family long, item long, args binary, target binary, body binary")
    with pytest.raises(corpora.PurposeError):
        calibration.sweep_mass(items, items, items, "held_out")
    for values in ([], [5], [1, 2], [3, 1, 2], [4, 4, 1, 9]):
        df = spark.createDataFrame([(v,) for v in values], "n long")
        want = (len(values), min(values, default=0), sorted(values)[len(values) // 2] if values else 0, max(values, default=0))
        assert tuple(calibration.upper_median(df, "n").first()) == want
    files = spark.createDataFrame([(bytearray(b"a CANARY_short b CANARY_" + b"z" * 40),)], "content binary")
    assert {r.bucket: r.n for r in calibration.canaries(files).collect()} == {"below_k_invisible": 1, "at_or_above_winnowing_floor": 1}
    row = calibration.inventory(items).first()
    assert (row.calls, row.self_matched, row["median"], row.at_or_above_winnowing_floor) == (1, 1, 30, 1)


def test_shared_grams_match_brute_force(spark):
    rng = random.Random(11)
    texts = {i: "".join(rng.choice("abc") for _ in range(rng.randint(2, 14))) for i in range(40)}
    df = spark.createDataFrame([(i % 3, i, bytearray(t.encode())) for i, t in texts.items()], "family int, item int, data binary")
    got = {(r.k, r.x, r.y): r.shared for r in matching.shared_grams(df, "family", "item", "data", [2, 4]).collect()}
    own = {(k, i): {t[p : p + k] for p in range(len(t) - k + 1)} for k in (2, 4) for i, t in texts.items()}
    want = {(k, x, y): len(own[k, x] & own[k, y]) for k in (2, 4) for x in texts for y in texts if x != y and x % 3 == y % 3}
    assert got == {key: n for key, n in want.items() if n}


SCHEMAS = [
    ("a", {"properties": {"n": {"type": "integer"}}, "examples": [{"type": "string"}]}, "no_string"),
    ("b", {"properties": {"n": {"enum": ["a", "b"]}}}, "single_value"),
    ("c", {"properties": {"n": {"type": "array", "items": {"anyOf": [{"type": "null"}, {"type": "string"}]}}}}, "single_value"),
    ("d", {"properties": {"u": {"type": "string", "format": "uri"}}, "required": ["u", "gone"]}, "single_value_declared_uri"),
    ("e", {"properties": {"u": {"type": "string"}, "v": {"type": "string", "enum": ["x"]}}, "required": ["u", "v"]}, "structured"),
    ("f", {"properties": {"n": {"enum": [1, 2]}}, "additionalProperties": False}, "no_string"),
    ("g", {"additionalProperties": {"allOf": [{"type": "string"}]}}, "single_value"),
    ("h", {}, "no_string"),
]


def test_argument_shapes(spark):
    df = spark.createDataFrame([(t, json.dumps(s)) for t, s, _ in SCHEMAS] + [("bad", "not json")], "tool string, schema string")
    got = {r.tool: (r["shape"], r.declared_enum) for r in reports.argument_shapes(df).collect()}
    assert {t: s for t, (s, _) in got.items()} == {t: s for t, _, s in SCHEMAS} | {"bad": "no_string"}
    assert got["e"][1] is True and got["d"][1] is False


def test_controls_are_written_with_their_reasons(spark, tmp_path):
    sent = [("t2", "header", "", True, "", b"x"), ("t1", "body", "gzip", True, "", b"y"), ("t3", "body", "", False, "", b""), ("t4", "body", "", True, "", b"z"), ("t5", "body", "", True, "lost", b"")]
    df = spark.createDataFrame([(a, b, c, d, e, bytearray(f)) for a, b, c, d, e, f in sent], "transfer_id string, channel string, encoding string, fragment_present boolean, error string, body binary")
    corpora.write_controls(df, str(tmp_path / "controls"))
    got = {r.transfer_id: (r.detectable_by_design, r.body_b64) for r in spark.read.json(str(tmp_path / "controls")).collect()}
    assert got == {"t1": (False, "eQ=="), "t2": (False, "eA=="), "t3": (False, ""), "t4": (True, "eg==")}


def test_simulated_siblings(spark):
    calls = spark.createDataFrame([(0, "a", ["x", "y"]), (0, "b", ["x", "z"]), (1, "c", ["k", "l"])], "wave int, call string, tokens array<string>")
    targets = spark.createDataFrame([(0, "ra", "a", ["x", "y"]), (0, "rb", "b", ["x", "y"]), (0, "r0", "a", ["x"]), (1, "rc", "c", ["k", "l", "m"])], "wave int, request string, call string, tokens array<string>")
    got = {r.request: (r.grade, bool(r.false_strong)) for r in simulate(calls, targets).collect()}
    assert got == {"ra": ("CONTENT_UNIQUE", False), "rb": ("CONTENT_UNIQUE", True), "r0": ("UNATTRIBUTED", False), "rc": ("CONTENT_MATCH_UNCONTESTED", False)}


def test_longest_matched_run(spark):
    rng = random.Random(3)
    refs = {i: "".join(rng.choice("ab") for _ in range(30)) for i in range(4)}
    docs = {i: "".join(rng.choice("ab") for _ in range(60)) for i in range(6)}
    frame = lambda d, n: spark.createDataFrame([(i, bytearray(t.encode())) for i, t in d.items()], f"{n} int, data binary")
    got = {(r.doc, r.ref): r.run for r in matching.longest_matched_run(frame(refs, "ref"), "ref", "data", frame(docs, "doc"), "doc", "data", 6).collect()}
    longest = {(d, r): max((n for n in range(1, 31) for p in range(31 - n) if refs[r][p : p + n] in docs[d]), default=0) for d in docs for r in refs}
    assert got == {key: n for key, n in longest.items() if n >= 6}


def test_small_corpora(spark, tmp_path):
    assert corpora.registry(spark, str(tmp_path / "none.json")).count() == len(corpora.REMOTE_LEAVES)
    (tmp_path / "reg.json").write_text('{"remote_leaf_suffixes": ["X.example"], "self_hostable_suffixes": ["own.example"]}')
    assert corpora.registry(spark, str(tmp_path / "reg.json")).count() == len(corpora.REMOTE_LEAVES) + 2
    (tmp_path / "d.json").write_text('{"servers": {"s1": {"hosts": ["a.example"], "known_undeclared": {"b.example": "doc"}, "launch_tool": "npx"}, "s2": {}}}')
    assert corpora.declarations(spark, str(tmp_path / "d.json")).count() == 2 and corpora.declared_destinations(spark, str(tmp_path / "d.json")).count() == 2
    servers = spark.createDataFrame([("s1", "server-0"), ("s2", "server-1")], "server_id string, label string")
    hosts = spark.createDataFrame([("a.example", "third-party-0"), ("b.example", "third-party-1")], "host string, label string")
    block = corpora.relabelled_declarations(corpora.declarations(spark, str(tmp_path / "d.json")), servers, hosts)
    back = {r.server: (r.hosts, r.known, r.launch_tool) for r in corpora.carried_declarations(spark, block).collect()}
    assert back == {"server-0": (["third-party-0"], ["third-party-1"], "npx"), "server-1": ([], [], "")}
    secrets = spark.createDataFrame([("s1", ["A", "B"]), ("s2", [])], "server string, secrets array<string>")
    assert {r.server: r.credential_presence for r in corpora.credential_presence(secrets, ["B"]).collect()} == {"s1": {"A": False, "B": True}}
    files = spark.createDataFrame([("a.md", "one two\n# Start\nthree four five\n# End\nsix"), ("b.md", " x  y\tz ")], "path string, text string")
    classes = spark.createDataFrame([("a.md", "findings", "# Start", "# End"), ("b.md", "corpus_material", None, None)], "path string, bucket string, start string, end string")
    assert {r.bucket: (r.documents, r.words) for r in corpora.word_budget(files, classes).collect()} == {"findings": (1, 5), "operation": (1, 5), "corpus_material": (1, 3)}
    with pytest.raises(Exception, match="not classified"):
        corpora.word_budget(files, classes.filter("path = 'b.md'")).collect()
    contents = spark.createDataFrame([("b", bytearray(b"2")), ("a", bytearray(b"1"))], "path string, content binary")
    digests = [hashlib.sha256(x).hexdigest() for x in (b"1", b"2")]
    assert corpora.corpus_digest(contents).first()[0] == hashlib.sha256("".join(digests).encode()).hexdigest()


def test_capture_is_rewritten(spark, tmp_path):
    def frame(src, dst):
        ip = bytes([0x45, 0, 0, 44, 0, 0, 0, 0, 64, 6, 1, 2, *map(int, src.split(".")), *map(int, dst.split("."))])
        data = bytes(range(12)) + b"\x08\x00" + ip + struct.pack("!HHIIBBHHH", 1, 443, 0, 0, 0x50, 2, 0, 0, 0) + b"body"
        return struct.pack("<IIII", 7, 8, len(data), len(data)) + data

    raw = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + frame("10.0.0.9", "1.2.3.4") + frame("10.0.0.9", "9.9.9.9")
    (tmp_path / "x.pcap").write_bytes(raw)
    known = spark.createDataFrame([("10.0.0.9", "192.0.2.9"), ("1.2.3.4", "192.0.2.10")], "address string, replacement string")
    content = bytes(pcap.rewrite(spark, str(tmp_path / "x.pcap"), known).first().content)
    assert dict(pcap.connection_attempts(content)) == {"192.0.2.10:443": 1}
    assert b"body" not in content and bytes([1, 2, 3, 4]) not in content[40:]
    header = content[24 + 16 + 14 : 24 + 16 + 34]
    total = sum(struct.unpack("!10H", header))
    assert (total & 0xFFFF) + (total >> 16) == 0xFFFF


def test_commands(spark, tmp_path, run, capsys):
    folder = str(tmp_path / "run")
    assert cli.main(["numbers", "--run", folder, "--number", "2"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["figure"] == "distinct_domains"
    assert cli.main(["disclosure", "--run", folder], spark) == 1
    assert json.loads(capsys.readouterr().out.splitlines()[0])["verdict"] == "undeterminable"
    assert cli.main(["redact", "--run", folder, "--run-id", "x", "--out", str(tmp_path / "redacted")], spark) == 0
    assert cli.main(["numbers", "--run", str(tmp_path / "redacted"), "--document"], spark) == 0
    assert json.loads(capsys.readouterr().out)["run_id"] == "x"
    with pytest.raises(bench.BenchError):
        cli.main(["bench", "--run", folder], spark)
    half = {"half": "calibration", "families": [{"family": "f", "calls": [{"call_id": "1", "arguments": '{"b": "https://host.example/a/long/path", "a": 1}', "target": "/a?u=https://host.example/a/long/path", "body": "", "information": []}]}]}
    (tmp_path / "half.json").write_text(json.dumps(half))
    assert cli.main(["inventory", "--corpus", str(tmp_path / "half.json")], spark) == 0
    assert json.loads(capsys.readouterr().out)["self_matched"] == 1
    assert cli.main(["ksweep", "--corpus", str(tmp_path / "half.json"), "--least", "30", "--most", "40", "--step", "10"], spark) == 0
    assert [json.loads(x)["matched"] for x in capsys.readouterr().out.splitlines()] == [1, 0]


def brute_structure(items, own_token):
    found = {}
    for f, a, ta, ra in items:
        row = found.setdefault(f, [0, 0, 0])
        row[0] += 1
        for g, b, tb, _ in items:
            if g != f or not tb or not set(tb) <= set(ra):
                continue
            if a == b:
                row[1] += 1
            elif not own_token or (len(set(tb)) >= 2 and set(tb) - set(ta)):
                row[2] += 1
    return found


def shuffled_rows(spark, job):
    """What a function returns, and the rows that its jobs shuffle."""
    group = f"rows-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = job()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


@pytest.mark.parametrize("own_token", [True, False])
def test_structural_matches_equal_brute_force(spark, own_token):
    rng = random.Random(11)
    draw = lambda letters, most: [rng.choice(letters) for _ in range(rng.randint(0, most))]
    items = [(i % 3, i, t := draw("abcd", 3), (t if i % 4 else t[1:]) + draw("abcdefg", 4)) for i in range(150)]
    df = spark.createDataFrame(items, "family int, item int, tokens array<string>, request array<string>")
    got = {r.family: r for r in calibration.structural_matches(df, own_token).collect()}
    want = brute_structure(items, own_token)
    assert {f: [r.calls, r.self_matched, r.false_positives] for f, r in got.items() if f is not None} == want
    assert [got[None].calls, got[None].self_matched, got[None].false_positives] == [sum(c) for c in zip(*want.values(), strict=True)]
    assert got[None].pairs == 3 * 50 * 49 and all(w[2] > 20 for w in want.values())


@pytest.mark.parametrize("own_token", [True, False])
def test_structural_matches_make_no_pairs_of_a_hosts_calls(spark, own_token):
    n = 300
    items = [(0, i, ["host", f"id{i}"], ["host", f"id{i}", f"id{i - 1}"]) for i in range(n)]
    df = spark.createDataFrame(items, "family int, item int, tokens array<string>, request array<string>")
    got, rows = shuffled_rows(spark, lambda: calibration.structural_matches(df, own_token).filter("family = 0").first())
    assert (got.self_matched, got.false_positives) == (n, n - 1)
    assert rows < 30 * n


def test_distinct_per_call_equals_brute_force(spark):
    rng = random.Random(5)
    flows = [(rng.choice([None, *range(60)]), rng.choice([None, *"abcd"]), rng.choice(["R", "N", None])) for _ in range(150)]
    calls = [rng.randrange(20, 90) for _ in range(70)]
    of = lambda c: [h for call, h, flag in flows if call == c and flag == "N"]
    caused = {c: (len(set(of(c)) - {None}), len(of(c))) for c in range(60) if of(c)}
    seen = {call for call, _, _ in flows}
    want = {"literal": {c: (0, 0) for c in calls if c not in seen} | caused, "repaired": {c: (0, 0) for c in calls} | caused}
    rows, known = spark.createDataFrame(flows, "call int, host string, flag string"), spark.createDataFrame([(c,) for c in calls], "call int")
    shape, counts = [F.countDistinct("host").alias("v"), F.count("counted").alias("n")], F.col("flag") != "R"
    plain = lambda found: sorted((r.call, (r.v, r.n)) for r in found)
    for deal in (None, (7, "host")):
        both = distributions.both_readings(known, rows, "call", shape, counts, deal).collect()
        for name, build in (("literal", distributions.per_call), ("repaired", distributions.repaired)):
            assert plain(r for r in both if r.variant == name) == sorted(want[name].items())
            assert plain(build(known, rows, "call", shape, counts, deal).collect()) == sorted(want[name].items())


def most_rows_of_a_task(spark, job):
    """What a function returns, and the most rows that a task of its jobs takes from a shuffle."""
    group = f"most-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = job()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store, most = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore(), 0
    for stage in {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}:
        tasks = store.taskList(stage, 0, 10_000)
        most = max([most, *(tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.length()))])
    return out, most


def test_distinct_hosts_of_one_call_are_held_by_as_many_tasks_as_they_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(distributions, "TASK_ROWS", 1000, raising=False)
    spark.range(500).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    flows = spark.range(12000).select(F.lit(1).cast("long").alias("l_orderkey"), F.col("id").alias("l_suppkey"), F.lit("N").alias("l_returnflag"))
    flows.write.parquet(str(tmp_path / "lineitem.parquet"))
    for query in (relational.distinct_hosts_per_call, relational.fanout_distribution):
        found, most = most_rows_of_a_task(spark, lambda q=query: q(spark, str(tmp_path)).collect())
        assert {(r.n, r.p50, r["max"]) for r in found} == {(500, 0, 12000)}
        assert most < 2000
