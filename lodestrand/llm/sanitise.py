"""Personal data: patterns, and terms that give protected values away (information-theoretic).

Patterns find e-mail and IP addresses, card and phone numbers. Each distinct value is a protected
entity, and so is the part of it that names whom it belongs to with others (the domain, network, issuer or
exchange): most values are in one text only, and a name beside addresses of one domain gives that away. How strongly a term reveals it is estimated from the corpus: with p(t|e) the share of the
value's documents (one for each distinct passage) that hold the term and p(t) the share of all that do, the
pointwise mutual information log2 p(t|e) / p(t), over the value's own information log2 1 / p(e), is the
share of the value that the term discloses. Terms above a threshold are generalised to a
class of words, and above a higher one removed. Only DataFrame operations are used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import likely, materialise

#: The patterns of the base kinds. Written so that no part is tried twice: a local part or a
#: number is entered at its first character only, or where the match before ended. A run of fewer than 13
#: digits is no card, and neither is its rest, so such runs are not matched at all.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.|$)){4}$"
#: A text without these can hold no match of the kind.
_NEEDS = {"email": r"@", "phone": r"\+"}

#: Characters to each side of a value by which passages are the same, and keys by which near copies are; share of the passages that a term must
#: be with; chance, for each value, that any term of the vocabulary would be with it as often; shares disclosed
#: from which a term is generalised or removed.
CONTEXT_CHARS, SKETCHES = 100, 3
LEAST_SHARE, CHANCE = 0.5, 0.01
GENERALISE_FROM, REMOVE_FROM = 0.5, 0.8
#: Share of the texts from which an entity is frequent; so few are that they are broadcast.
FREQUENT = 1e-4

_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    n = F.char_length(_digits(match))
    if kind == "ip":
        return match.rlike(_OCTETS)
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _value(kind: str, match: Column) -> Column:
    """What makes two matches the same entity."""
    return _digits(match) if kind in ("card", "phone") else F.lower(match)


def _entities(spans: Column) -> Column:
    """The distinct entities of a text's base spans: each value, and the class that it belongs to."""

    def both(s: Column) -> Column:
        value = F.substring(s["value"], F.char_length(s["kind"]) + 2, F.char_length(s["value"]))
        shared = (
            F.when(s["kind"] == "email", F.substring_index(value, "@", -1))
            .when(s["kind"] == "ip", F.substring_index(value, ".", 3))
            .when(s["kind"] == "card", F.substring(value, 1, 6))
            .otherwise(F.substring(value, F.lit(1), F.char_length(value) - 7))
        )
        return F.array(s["value"], F.concat(F.lit("class of "), s["kind"], F.lit(":"), shared))

    return F.array_distinct(F.flatten(F.transform(spans, both)))


def _located(kind: Column, found: Column, between: Column) -> Column:
    """Spans (code points, end exclusive) of matches, from the texts between them."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("spans"))
    both = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["b"])
        end = begin + F.char_length(x["m"])
        span = F.struct(kind.alias("kind"), begin.alias("start"), end.alias("end"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.aggregate(both, start, add, lambda acc: acc["spans"])


def _checked(kind: str, spans: Column) -> Column:
    """Drop matches that fail the kind's test; of the rest, keep the entity in place of the match."""

    def entity(s: Column) -> Column:
        value = F.concat(F.lit(kind + ":"), _value(kind, s["value"]))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value.alias("value"))

    return F.transform(F.filter(spans, lambda s: _valid(kind, s["value"])), entity)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `spans`: the base matches by kind as listed, then start, each with its entity's value."""
    for kind in KINDS:
        found = F.regexp_extract_all(F.col(text), F.lit(PATTERNS[kind]), F.lit(0))
        if kind in _NEEDS:
            found = F.when(F.col(text).contains(_NEEDS[kind].strip("\\")), found).otherwise(F.array().cast("array<string>"))
        docs = docs.withColumn(f"_{kind}", found)
    for kind in KINDS:
        spans = _checked(kind, _located(F.lit(kind), F.col(f"_{kind}"), F.split(F.col(text), PATTERNS[kind], -1)))
        docs = docs.withColumn(f"_{kind}", F.when(F.size(f"_{kind}") > 0, spans).otherwise(F.array().cast(_SPAN)))
    return docs.withColumn("spans", F.concat(*[F.col(f"_{k}") for k in KINDS])).drop(*[f"_{k}" for k in KINDS])


def _words(text: Column) -> Column:
    """The distinct lower-case letter runs of a text."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: w != "")


def _free_words(text: Column) -> Column:
    """The words of a text outside its addresses; no other pattern holds letters."""
    return _words(F.when(text.contains("@"), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text))


def _sketches(words: Column) -> Column:
    """SKETCHES keys of a set of words, each of two of its smallest hashes: near copies share one, other texts hardly do."""

    def least(seed: int) -> Column:
        return F.array_min(F.transform(words, lambda w: F.xxhash64(F.lit(seed), w)))

    keys = [F.xxhash64(F.lit(i), least(2 * i), least(2 * i + 1)) for i in range(SKETCHES)]
    return F.when(F.size(words) > 0, F.array(*keys)).otherwise(F.array().cast("array<bigint>"))


def distinct_texts(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(th, text): each text once, with its hash; only texts that may be repeated are moved."""
    hashed = corpus.select(F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"))
    repeated = materialise(hashed.groupBy("th").agg(F.count("*").alias("n")).filter("n > 1").select("th"), "repeated-texts")
    marked = likely(hashed, "th", repeated)
    return marked.filter("NOT likely").select("th", "text").unionByName(marked.filter("likely").select("th", "text").dropDuplicates(["th"]))


def associations(found: DataFrame, corpus: DataFrame, text: str = "text") -> DataFrame:
    """value, term, surprise, needed, share of the terms that are with half of an entity's passages at least.

    share: what of the entity the term discloses; surprise: how improbable it is that chance brings them together as
    often, in nats; needed: the surprise from which that counts.

    found: rows with `spans` and, where there are any, `text`; corpus: all texts. Terms count wherever in
    a text they are, and equal texts count once. So do near copies, and texts that repeat one passage around a value, of
    which each has a part of one: copies of one passage prove nothing. However few texts a value has, its
    terms are weighed; one counts only if chance would not bring any of the vocabulary together with
    the value as often (Chernoff's bound, times the number of terms, at most CHANCE).
    """
    counted = distinct_texts(corpus, text).select(F.explode(_free_words(F.col("text"))).alias("term"))
    counted = materialise(counted.groupBy("term").agg(F.count("*").alias("df")), "vocabulary")
    total = float(corpus.select(F.xxhash64(F.col(f"`{text}`")).alias("th")).distinct().count())
    needed = math.log(max(1, counted.count()) / CHANCE)
    spanned = found.filter(F.size("spans") > 0).withColumn("th", F.xxhash64("text"))
    # A class is seen wherever one of its values is.
    named = F.explode(F.flatten(F.transform("spans", lambda s: F.transform(_entities(F.array(s)), lambda e: F.struct(s["start"].alias("start"), s["end"].alias("end"), e.alias("value"))))))
    sketched = spanned.withColumn("sketches", _sketches(_free_words(F.col("text"))))
    seen = sketched.select("th", "text", "sketches", named.alias("s"))
    left = F.substring(F.col("text"), F.greatest(F.col("s.start") + 1 - CONTEXT_CHARS, F.lit(1)).cast("int"), F.least(F.col("s.start"), F.lit(CONTEXT_CHARS)).cast("int"))
    right = F.substring(F.col("text"), (F.col("s.end") + 1).cast("int"), F.lit(CONTEXT_CHARS))
    context = F.xxhash64(F.concat(left, F.lit(" \u0000 "), right))
    keys = F.concat(F.array(context), F.col("sketches"))
    seen = seen.select("th", F.col("s.value").alias("value"), F.explode(keys).alias("ctx")).distinct()
    alike = seen.groupBy("value", "ctx").agg(F.count("*").alias("m"))
    parts = seen.join(alike, ["value", "ctx"]).groupBy("value", "th").agg((1.0 / F.max("m")).alias("part"))
    parts = materialise(parts, "passages")
    known = parts.groupBy("value").agg(F.sum("part").alias("n_e"), F.count("*").alias("docs_e"))
    # A term in all of a value's texts and in no other would count for no less, so the rest need not be looked at.
    known = materialise(known.filter(F.col("n_e") * math.log(max(1.0, total)) >= needed - 1e-6), "known-entities")
    # A frequent entity's texts stay where they are: of such entities there are 1 / FREQUENT for each of a text's at most.
    often = F.col("docs_e") > FREQUENT * total
    wanted = parts.join(F.broadcast(known.filter(often)), "value").unionByName(parts.join(known.filter(~often), "value"))
    wanted = materialise(wanted, "entities")
    texts = likely(spanned.select("th", "text"), "th", wanted.select("th")).filter("likely").select("th", "text").dropDuplicates(["th"])
    together = wanted.join(texts.select("th", _free_words(F.col("text")).alias("words")), "th")
    together = together.select("value", "n_e", "docs_e", "part", F.explode("words").alias("term"))
    together = together.groupBy("value", "n_e", "docs_e", "term").agg(F.least(F.sum("part"), F.col("n_e")).alias("n_te"))
    joined = together.filter(F.col("n_te") >= LEAST_SHARE * F.col("n_e") - 1e-6).join(counted, "term")
    among, overall = F.col("n_te") / F.col("n_e"), F.col("df") / total
    apart = F.when(among < 1 - 1e-6, (1 - among) * F.log((1 - among) / (1 - overall))).otherwise(0.0)
    surprise = F.when(among > overall, F.col("n_e") * (among * F.log(among / overall) + apart)).otherwise(0.0)
    own = F.log2(total / F.col("docs_e"))
    share = F.when(own > 0, F.log2(among / overall) / own).otherwise(0.0)
    return joined.select("value", "term", surprise.alias("surprise"), F.lit(needed).alias("needed"), share.alias("share"))


def disclosive_terms(found: DataFrame, corpus: DataFrame, text: str = "text") -> DataFrame:
    """(value, terms): for each entity its disclosive terms, each (term, removed)."""
    flagged = associations(found, corpus, text).filter((F.col("surprise") >= F.col("needed") - 1e-6) & (F.col("share") >= GENERALISE_FROM))
    term = F.struct("term", (F.col("share") >= REMOVE_FROM).alias("removed"))
    return flagged.groupBy("value").agg(F.sort_array(F.collect_set(term)).alias("terms"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, text (of rows with spans, or all with `keep`), kept, base (spans), more (term spans).

    A null text is empty. Equal rows stay apart. Columns named in `keep` come along in `kept`, but for
    the text, which is there already; `_had_text` in it is false where it was null.
    """
    named = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *([F.struct(F.col(f"`{text_col}`").isNotNull().alias("_had_text"), *[F.col(f"`{c}`") for c in keep if c != text_col]).alias("kept")] if keep else []),
    )
    found = base_spans(named).withColumn("uid", F.monotonically_increasing_id())
    if not keep:
        found = found.withColumn("text", F.when(F.size("spans") > 0, F.col("text")))
    found = materialise(found, "base-spans")
    terms = materialise(disclosive_terms(found, named), "disclosive-terms")
    # One row for each entity that a document holds; what the document must lose is the union.
    holds = found.filter(F.size("spans") > 0).select("uid", F.explode(_entities(F.col("spans"))).alias("value"))
    lost = holds.join(terms, "value").groupBy("uid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
    lost = materialise(lost, "lost-terms")
    # Few documents lose a term; the others are not moved to learn that.
    marked = likely(found, "uid", lost)
    some = marked.filter("likely").join(lost, "uid", "left")
    none = marked.filter("NOT likely").withColumn("terms", F.lit(None).cast(lost.schema["terms"].dataType))
    both = some.unionByName(none)
    names = F.array_distinct(F.transform("terms", lambda t: t["term"]))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(names, "|"), F.lit(r")(?!\p{L})"))
    both = both.withColumn("pattern", F.when(F.size("terms") > 0, pattern))
    both = both.withColumn("hits", F.when(F.col("pattern").isNotNull(), F.regexp_extract_all(F.col("text"), F.col("pattern"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    located = _located(F.lit("term"), F.col("hits"), F.split(F.col("text"), F.col("pattern"), F.lit(-1)))
    apart = F.filter(located, lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    both = both.withColumn("more", F.when(F.size("hits") > 0, apart).otherwise(F.array().cast(_SPAN)))
    return both.select("doc_id", "text", *(["kept"] if keep else []), F.col("spans").alias("base"), "more", "terms")


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(found: DataFrame) -> DataFrame:
    """doc_id, the number of each base kind and of terms, the digest of the base spans, all spans."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.size("more").cast("long").alias("n_term"),
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.concat("base", "more")).alias("spans"),
    )


def clean(found: DataFrame) -> DataFrame:
    """Add `cleaned`: the text with base matches replaced by their kind, terms generalised or removed.

    Overlapping spans are replaced together, under the name of the first.
    """
    removed = F.transform(F.filter(F.coalesce("terms", F.array().cast("array<struct<term:string,removed:boolean>>")), lambda t: t["removed"]), lambda t: t["term"])
    spans = F.array_sort(F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    found = found.withColumn("_spans", spans).withColumn("_removed", removed)
    text = F.col("text")

    def label(s: Column) -> Column:
        general = F.when(F.regexp_like(s["value"], F.lit(r"^\p{Lu}")), "[NAME]").otherwise("[WORD]")
        return F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(F.array_contains("_removed", F.lower(s["value"])), "").otherwise(general)

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        between = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(fresh, F.concat(acc["out"], between, label(s))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    rebuilt = F.aggregate("_spans", start, add, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
    return found.withColumn("cleaned", F.when(F.size("_spans") > 0, rebuilt).otherwise(text)).drop("_spans", "_removed")
