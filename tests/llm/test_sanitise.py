import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrand.llm import sanitise

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def brute(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in sanitise.report(sanitise.find(df)).collect():
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest(), (texts[r.doc_id], r.spans)
        assert r.spans.startswith(written(base))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in BASE]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(3)
    parts = [*"0123456789..--@@++() aZé😀_%\n", "a@b.co", "192.168.0.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "256.1.1.1", "00000255.1.2.3", "4111-1111-1111-1112"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1000)]
    texts += [None, "", "a@b.cd+e@f.gh", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "9" * 50_000, "a" * 8_000, "x@" * 8_000, "1 " * 40_000, "+1" + "(" * 50_000]
    check(spark, texts)


@settings(max_examples=2, deadline=None)
@given(st.lists(st.text(alphabet="19.@-+ ()ab\n", max_size=30), min_size=200, max_size=300))
def test_base_spans_by_property(spark, texts):
    check(spark, texts)


def test_disclosive_terms_are_found_and_replaced(spark):
    rng = random.Random(5)
    filler = [f"filler{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]

    def words(n):
        return " ".join(rng.choice(filler) for _ in range(n))

    rows = [(i, words(60)) for i in range(200)]
    rows += [(200 + i, f"{words(30)} Contact Quillfeather at q@uill.example {words(30)}") for i in range(6)]
    rows += [(300 + i, f"{words(50)} Quillfeather alone {words(5)}") for i in range(2)]
    # A passage repeated word for word is one context, however often it is there.
    rows += [(400 + i, f"copied passage with Wibblewock and w@wibble.example inside {i}") for i in range(1)] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sanitise.find(df, keep=df.columns)
    by = {r.doc_id: r for r in sanitise.clean(found).collect()}
    terms = {t for r in by.values() for t in [x.value.lower() for x in r.more]}
    assert "quillfeather" in terms and "wibblewock" not in terms and not any(t.startswith("filler") for t in terms)
    assert "q@uill.example" not in by[200].cleaned and "Quillfeather" not in by[200].cleaned and "[EMAIL]" in by[200].cleaned
    assert by[300].cleaned == dict(rows)[300]  # the term alone gives nobody away
    assert by[5].cleaned == dict(rows)[5]


def test_rare_values_and_distant_terms_are_weighed(spark):
    rng = random.Random(15)
    filler = [f"filler{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]

    def words(n):
        return " ".join(rng.choice(filler) for _ in range(n))

    rows = [(i, words(60)) for i in range(1000)]
    rows += [(2000 + i, f"{words(30)} Brackenmoor {words(40)} mail b@rack.example {words(30)}") for i in range(2)]  # two texts, far apart
    rows += [(3000 + i, f"Larkspindle {words(60)} mail l@ark.example") for i in range(5)]  # heading against footer
    rows += [(4000, f"{words(30)} Onlyonce mail o@nce.example {words(30)}")]  # one text: any of its words might be the one
    passage = f"{words(20)} mail p@ass.example {words(20)}"
    rows += [(5000 + i, f"{words(30)} Oldpassage {passage} {words(30)}") for i in range(4)]  # one passage in four texts
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r.doc_id: r for r in sanitise.clean(sanitise.find(df, keep=df.columns)).collect()}
    for ids, name in ((range(2000, 2002), "Brackenmoor"), (range(3000, 3005), "Larkspindle")):
        assert all(name not in by[i].cleaned for i in ids)
    assert "Onlyonce" in by[4000].cleaned and all("Oldpassage" in by[i].cleaned for i in range(5000, 5004))
    assert not any(x.value.startswith("filler") for r in by.values() for x in r.more)


def test_near_copies_count_once(spark):
    rng = random.Random(35)
    filler = [f"filler{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    rows = [(i, " ".join(rng.choice(filler) for _ in range(80))) for i in range(1000)]
    page = [f"Only{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]
    for i in range(8):  # a word is changed every fifty characters or so, and the address too
        own = [w if rng.random() > 0.04 else rng.choice(filler) for w in page]
        rows.append((2000 + i, " ".join([*own[:70], f"write to p{i}@copied.example", *own[70:]])))
    found = sanitise.find(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).filter("doc_id >= 2000").collect()
    assert sum(len(r.more) for r in found) == 0


def test_a_name_beside_the_addresses_of_one_domain_gives_it_away(spark):
    rng = random.Random(25)
    filler = [f"filler{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]

    def words(n):
        return " ".join(rng.choice(filler) for _ in range(n))

    rows = [(i, words(60)) for i in range(1500)]
    firms = [f"Firm{chr(97 + i)}{chr(107 + i)}" for i in range(12)]
    for i, firm in enumerate(firms):  # every address is in one text only
        rows += [(2000 + 10 * i + j, f"{words(20)} {firm if j else ''} {words(20)} write to p{j}.{i}@host{i}.example {words(20)}") for j in range(5)]
    rows += [(3000 + i, f"{words(40)} someone{i}@common.example {words(20)}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in sanitise.find(df, keep=df.columns).collect()}
    told = {d: {x.value for x in r.more} for d, r in found.items()}
    caught = sum(firm in told[2000 + 10 * i + j] for i, firm in enumerate(firms) for j in range(1, 5))
    assert caught >= 0.9 * 4 * len(firms)
    assert not any(x.startswith("filler") for t in told.values() for x in t) and not any(told[3000 + i] for i in range(200))


def test_edges(spark, edge_docs, no_docs):
    rows = sanitise.report(sanitise.find(edge_docs)).collect()
    assert len(rows) == edge_docs.count()
    assert sorted(r.n_email for r in rows) == [0] * 8 + [1, 1]
    assert sanitise.report(sanitise.find(no_docs)).count() == 0
    cleaned = sanitise.clean(sanitise.find(edge_docs, keep=edge_docs.columns))
    assert {r.cleaned for r in cleaned.filter("doc_id = 6").collect()} == {"naïve café 漢字 😀 mail [EMAIL]"}


def test_overlapping_spans_are_replaced_together(spark):
    df = spark.createDataFrame([(1, "call +4111111111111111 or 1.2.3.4, ok")], "doc_id long, text string")
    r = sanitise.clean(sanitise.find(df)).first()
    assert r.cleaned == "call +[CARD] or [IP], ok"


def test_main_path_has_no_python(spark, edge_docs):
    plan = sanitise.report(sanitise.find(edge_docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
