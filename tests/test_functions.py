import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrand import session
from lodestrand.functions import digests, evidence, grams, structure


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_polynomial_hash(spark):
    texts = ["multi-byte é漢 text", "a", "\x00\xff" * 20]
    want = []
    for t in texts:
        h = 0
        for b in t.encode():
            h = (h * 257 + b) % ((1 << 61) - 1)
        want.append(h)
    assert column(spark, texts, lambda c: grams.polynomial(F.encode(c, "UTF-8"))) == want


def test_grams_are_bytes_and_short_rows_have_none(spark):
    df = spark.createDataFrame([(1, bytearray(b"abcd")), (2, bytearray(b"ab")), (3, None)], "i int, d binary")
    got = [(r.i, r.pos, bytes(r.gram)) for r in grams.grams(df, "d", 3).collect()]
    assert sorted(got) == [(1, 0, b"abc"), (1, 1, b"bcd")]


def test_winnowing_and_coverage_match_brute_force(spark):
    rng = random.Random(3)
    docs = {i: [rng.randint(0, 20) for _ in range(rng.randint(1, 30))] for i in range(30)}
    df = spark.createDataFrame([(d, p, v) for d, vs in docs.items() for p, v in enumerate(vs)], "doc int, pos int, v int")
    got = {}
    for r in grams.winnow(df, "doc", "pos", "v", 4).collect():
        got.setdefault(r.doc, set()).add(r.v)
    assert got == {d: {min(vs[i : i + 4]) for i in range(max(1, len(vs) - 3))} for d, vs in docs.items()}
    hits = {i: sorted(rng.sample(range(200), rng.randint(1, 40))) for i in range(20)}
    df = spark.createDataFrame([(d, p) for d, ps in hits.items() for p in ps + ps], "doc int, pos int")
    want = {d: len({b for p in ps for b in range(p, p + 7)}) for d, ps in hits.items()}
    assert {r.doc: r.matched_bytes for r in grams.covered(df, ["doc"], "pos", 7).collect()} == want
    with pytest.raises(ValueError):
        grams.winnow(df, "doc", "pos", "pos", 0)


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("https://host.example:8080/docs/deploy?section=rollback-steps&x=1", ["host.example:8080", "docs", "deploy", "rollback-steps"]),
        ("a/%20/yyy/b%ZZc", ["yyy", "b%ZZc"]),
        ("ab", []),
        ("abc", ["abc"]),
        ("https://h.example/?q=a+b%2Bc&flag", ["h.example", "a b+c"]),
        ("plain words", ["plain words"]),
        ("", []),
    ],
)
def test_split_string(spark, text, tokens):
    assert sorted(column(spark, [text], structure.split_string)[0]) == sorted(tokens)


def test_redirected_addresses_are_split_again(spark):
    df = spark.createDataFrame([("proxy.example", "/get?url=https%3A%2F%2Finner.example%2Fa%2Fbbb")], "h string, t string")
    got = df.select(structure.request_tokens(F.col("h"), F.col("t")).alias("x")).first().x
    assert {"proxy.example", "get", "inner.example", "bbb"} <= set(got)


def test_string_leaves(spark):
    df = spark.createDataFrame([(1, '{"a": ["x", {"b": "y"}], "n": 1, "t": true}'), (2, "nope"), (3, '"top"'), (4, None)], "i int, d string")
    assert sorted((r.i, r.leaf) for r in structure.string_leaves(df, ["i"], "d").collect()) == [(1, "x"), (1, "y"), (3, "top")]


def test_hosts(spark):
    assert column(spark, ["A.b.Example.", "x"], structure.host_suffixes) == [["a.b.example", "b.example", "example"], ["x"]]
    local = ["", None, "localhost", "127.0.0.1", "10.1.2.3", "172.16.0.1", "192.168.1.1", "169.254.9.9", "::1", "fe80::1", "fd00::2"]
    assert column(spark, local, structure.is_local_address) == [True] * len(local)
    far = ["8.8.8.8", "172.32.0.1", "example.org", "1.2.3", "2600::1", "300.1.1.1"]
    assert column(spark, far, structure.is_local_address) == [False] * len(far)


def test_wilson_interval(spark):
    rows = spark.createDataFrame([(0, 224), (66, 224), (10, 10), (0, 0)], "s int, n int")
    got = [tuple(r.w) for r in rows.select(evidence.wilson(F.col("s"), F.col("n")).alias("w")).collect()]
    assert got[0] == (0.0, pytest.approx(0.0169, abs=1e-4))
    assert got[1] == (pytest.approx(0.2388, abs=1e-4), pytest.approx(0.3574, abs=1e-4))
    assert got[2][1] == 1.0 and got[3] == (0.0, 1.0)


LADDER = ("trace", "match", "active", "matching", "eligible", "correlated", "possible", "tokens")


@pytest.mark.parametrize(
    ("case", "grade"),
    [
        ((True, True, 5, 1, True, True, False, 3), "UNATTRIBUTED"),
        ((True, False, 5, 0, False, False, True, 0), "TRACE_PROPAGATED"),
        ((False, True, 5, 1, True, True, True, 1), "CONTENT_AMBIGUOUS"),
        ((False, True, 5, 1, False, False, True, 2), "CONTENT_UNIQUE"),
        ((False, True, 5, 2, True, True, True, 0), "CONTENT_AMBIGUOUS"),
        ((False, True, 1, 1, True, True, True, 0), "CONTENT_MATCH_UNCONTESTED"),
        ((False, False, 1, 0, False, True, True, 0), "UNATTRIBUTED"),
        ((False, False, 1, 0, True, True, True, 0), "TEMPORAL_ONLY"),
        ((False, False, 2, 0, True, True, True, 0), "UNATTRIBUTED"),
        ((False, False, 10, 0, True, True, True, 0), "UNATTRIBUTED"),
        ((False, False, 1, 0, True, False, True, 0), "UNATTRIBUTED"),
    ],
)
def test_grade_ladder(spark, case, grade):
    got = one(spark, evidence.grade(**{k: F.lit(v) for k, v in zip(LADDER, case, strict=True)}))
    assert got.grade == grade
    if case == (False, True, 5, 1, False, False, True, 2):
        assert got.reason == "fragment present in exactly 1 of 5 concurrent calls"


def test_small_rules(spark):
    lit = F.lit
    assert one(spark, evidence.provenance(lit(False), lit(True), lit(True))) == "unknown"
    assert one(spark, evidence.causal_channel(lit(True), lit(True))) == "both"
    assert one(spark, evidence.ratio(lit(1), lit(0))) == 0.0 and one(spark, evidence.fraction(lit(1), lit(0))) is None
    assert one(spark, evidence.traceparent_present(lit(""), lit(""), lit("x"))) is False
    assert one(spark, evidence.traceparent_present(lit("tp"), lit(None), lit("a tp b"))) is True
    assert one(spark, evidence.constant_path(lit("h"), lit("/robots.txt?x=1"), [], ["/robots.txt"], [])) is True
    assert one(spark, evidence.constant_path(lit("h"), lit("/.well-known/a"), [], [], ["/.well-known/"])) is True
    assert one(spark, evidence.detectability(lit(29), 22, 8)) == "at_or_above_winnowing_floor"
    text = "RuntimeError: tools/call failed: {'code': -32602, 'message': 'x'}"
    assert one(spark, evidence.scrubbed_error(lit(text))) == "RuntimeError: tools/call error, JSON-RPC code -32602, message redacted"
    assert one(spark, evidence.scrubbed_error(evidence.scrubbed_error(lit(text)))) == "RuntimeError: tools/call error, JSON-RPC code -32602, message redacted"


def test_a_rejected_call_does_not_get_its_flow_back(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, evidence.attributed_call(a("c1"), a("c1", "c2"), a(), a("c1", "c2"))) == "c1"
    assert one(spark, evidence.attributed_call(a(), a("c1"), a("c1"), a("c1"))) is None
    assert one(spark, evidence.attributed_call(a(), a(), a("c2"), a("c1", "c2"))) == "c2"
    assert one(spark, evidence.attributed_call(a(), a(), a(), a("c1"))) == "c1"


def test_canonical_arguments_and_digests(spark):
    texts = ['{"b": [1, "é"], "a": {"y": null, "x": "z"}}', "not json", None, '"alone"']
    got = column(spark, texts, digests.canonical_arguments)
    assert [bytes(x) if x is not None else None for x in got] == [b'{"a": {"x": "z", "y": null}, "b": [1, "\\u00e9"]}', None, None, b'"alone"']
    want = [hashlib.blake2b(b"tok\0" + t.encode(), key=b"salt", digest_size=16).hexdigest() for t in ("docs", "é")]
    assert column(spark, ["docs", "é", None], lambda c: digests.token_digest(c, "salt")) == [*want, None]
    assert column(spark, [5, None], lambda c: digests.gram_digest(c, "salt"), "long") == [hashlib.blake2b((5).to_bytes(8, "big"), key=b"salt", digest_size=16).hexdigest(), None]
    for encoding in ("base64", "gzip", "json_escaped"):
        (made,) = column(spark, ["BFa1é"], lambda c, e=encoding: digests.encoded(c, e))
        assert digests.decoded(bytes(made), encoding) == "BFa1é" and b"BFa1" not in bytes(made)
    assert len(digests.fragment("t", b"k")) == 40 and digests.fragment("t", b"k") != digests.fragment("u", b"k")
    assert one(spark, digests.finding(F.lit("d"), F.lit("r"), F.lit("h"))) == "fragment d from reference r appeared in output toward h"
    assert one(spark, digests.frac(F.lit(2), F.lit(3))) == 0.6667 and one(spark, digests.frac(F.lit(2), F.lit(0))) == 0.0
    assert one(spark, digests.concurrency_levels(F.lit(10), F.lit(7))) == [2, 5] and one(spark, digests.concurrency_levels(F.lit(1), F.lit(7))) == []
    assert column(spark, [" a  b\tc\n", "", None, "x"], digests.word_count) == [3, 0, 0, 1]


def test_tokens_of_arguments_and_requests(spark):
    calls = spark.createDataFrame([(1, '{"url": "https://host.example/a1b/c?q=cat&n=%20", "more": ["plain", 3, "ab"]}')], "id int, args string")
    assert {r.token for r in structure.argument_tokens(calls, ["id"], "args").collect()} == {"host.example", "a1b", "cat", "plain"}
    requests = spark.createDataFrame(
        [(1, "h.example", "/p/abc?u=https%3A%2F%2Fin.example%2Fxyz", '{"deep": [{"k": "leaf"}, 4]}'), (2, "h.example", "/", "form=some+value&x=ok"), (3, "h.example", "/abc", ""), (4, "", "", None)],
        "id int, host string, target string, body string",
    )
    got = {r.id: set(r.tokens) for r in structure.tokens_of_request(requests, ["id"], "host", "target", "body").collect()}
    assert got == {1: {"h.example", "abc", "https://in.example/xyz", "in.example", "xyz", "leaf"}, 2: {"h.example", "some value"}, 3: {"h.example", "abc"}, 4: set()}


def test_scratch_folder(spark):
    class Far:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "spark://far:7077"})

    with pytest.raises(RuntimeError):
        session.scratch_root(Far)
    assert session.scratch_root(spark)


def test_small_texts(spark):
    made = [r.x for r in spark.range(3).select(digests.traceparent().alias("x")).collect()]
    assert len(set(made)) == 3 and all(re.fullmatch(r"00-[0-9a-f]{32}-[0-9a-f]{16}-01", x) for x in made)
    found = one(spark, digests.first_difference(F.lit("a  b\nsame\nx"), F.lit("a b \nsame\ny\nz")))
    assert tuple(found) == (3, "x", "y") and one(spark, digests.first_difference(F.lit("a\tb"), F.lit("a b"))) is None
    assert one(spark, digests.summary_counts(F.lit("== 3 failed, 714 passed, 1 error in 2s =="))) == {"failed": 3, "passed": 714, "errors": 1}
