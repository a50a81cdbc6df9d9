import hashlib
import re

import duckdb

from lodestrand.llm import preference

ROWS = [
    (0, 0, "system", "be kind"), (0, 1, "user", "hi"), (0, 2, "assistant", "hello"), (0, 3, "user", "more"), (0, 4, "assistant", "good"),
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "more"), (1, 4, "assistant", "bad"), (1, 5, "user", "?"),
    (2, 0, "user", "same"), (2, 1, "assistant", "all"), (3, 0, "user", "same"), (3, 1, "assistant", "all"),
    (4, 0, "user", "one side only"),
    (6, None, "user", "no turn"), (6, 0, None, None), (6, 0, "user", "twice"), (6, 0, "user", "twice"), (7, None, "user", "no turn"), (7, 0, None, None),
    (None, 0, "user", "no conversation"),
]


#: Pair 5: the same turns under other numbers; pair 6: more turns than a row holds; pair 7: two turns of one number.
ROWS += [(10, 0, "user", "hi"), (10, 1, "assistant", "yes"), (11, 1, "user", "hi"), (11, 2, "assistant", "no"), (11, 7, "user", "more")]
ROWS += [(c, i, ("user", "assistant")[i % 2], f"turn {i}" if i < 70 else f"turn {i} of {c}") for c in (12, 13) for i in range(150 + c)]
ROWS += [(14, 0, "user", "b"), (14, 0, "user", "a"), (15, 0, "user", "a"), (15, 0, "user", "b"), (15, 1, "assistant", None)]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """(pair, part) -> turns in order."""
    sides = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{role}\n{text}".encode()).hexdigest()
            sides.setdefault((c // 2, ("chosen", "rejected")[c % 2]), []).append((turn is not None, turn or 0, digest, role, text))
    out = {}
    for pair in {k[0] for k in sides}:
        both = [[r[3:] for r in sorted(sides.get((pair, s), []))] for s in ("chosen", "rejected")]
        n = 0
        while n < min(map(len, both)) and both[0][n] == both[1][n]:
            n += 1
        out |= {(pair, "prompt"): both[0][:n], (pair, "chosen"): both[0][n:], (pair, "rejected"): both[1][n:]}
    return {k: v for k, v in out.items() if v}


def rendered(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def test_segments_match_brute_force(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], SCHEMA + ", part int")
    got = preference.segments(df).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.position):
        by.setdefault((r.pair_id, r.part), []).append(r)
    want = brute(ROWS)
    assert by.keys() == want.keys()
    for key, rows in by.items():
        assert [r.position for r in rows] == list(range(len(rows)))
        assert "".join(r.rendered for r in rows) == rendered(want[key])
        for r, (role, text) in zip(rows, want[key], strict=True):
            trained = key[1] != "prompt" and role == "assistant"
            assert r.rendered[r.loss_start : r.loss_end] == (f"{text}<|im_end|>" if trained else "")
    assert len(by[5, "prompt"]) == 1 and len(by[6, "prompt"]) == 70 and len(by[7, "prompt"]) == 2


def test_pairs_have_every_turn(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r.pair_id, r.chunk): r for r in preference.pairs(preference.segments(df)).collect()}
    want = brute(ROWS)
    assert {k[0] for k in got} == {k[0] for k in want} and {k[1] for k in got if k[0] != 6} == {0} and {k[1] for k in got if k[0] == 6} == {0, 1}
    for pair in {k[0] for k in got}:
        chunks = [got[k] for k in sorted(got) if k[0] == pair]
        for part in ("prompt", "chosen", "rejected"):
            assert "".join(r[part] for r in chunks) == rendered(want.get((pair, part), []))
            if part != "prompt":
                trained = [r[part][s.start : s.end] for r in chunks for s in r[f"{part}_loss"]]
                assert trained == [f"{t}<|im_end|>" for role, t in want.get((pair, part), []) if role == "assistant"]


def test_a_table_of_pairs_takes_the_place_of_parity(spark):
    df = spark.createDataFrame([(7, 0, "user", "q"), (9, 3, "user", "q"), (9, 4, "assistant", "a")], SCHEMA)
    named = spark.createDataFrame([(7, "x", "rejected"), (9, "x", "chosen")], "conv_id long, pair_id string, side string")
    (row,) = preference.pairs(preference.segments(df, named)).collect()
    assert (row.prompt, row.chosen, row.rejected) == (rendered([("user", "q")]), rendered([("assistant", "a")]), "")


def test_one_conversation_in_many_ranges(spark):
    rows = [(0, i, "user", f"t{i}") for i in range(3000)] + [(1, i + 5, "user", f"t{i}" if i < 2900 else "x") for i in range(3000)] + [(2, 0, "user", "t0")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = preference.segments(spark.createDataFrame(rows, SCHEMA)).groupBy("pair_id", "part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.pair_id, r.part): r["count"] for r in got} == {(0, "prompt"): 2900, (0, "chosen"): 100, (0, "rejected"): 100, (1, "chosen"): 1}


def test_oracle_on_edge_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ROWS)
    got = preference.report(preference.pairs(preference.segments(df)))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({preference.ORACLE})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert preference.report(preference.pairs(preference.segments(df.limit(0)))).count() == 0


def test_main_path_has_no_python(spark):
    plan = preference.pairs(preference.segments(spark.createDataFrame(ROWS, SCHEMA)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
