"""Structural tokens of URLs, paths, forms and JSON documents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that a token has at least, after decoding.
LEAST_CHARS = 3
_TEXTS = "array<string>"


def unquote(text: Column) -> Column:
    """Percent-decode; a malformed escape stays as it is, and a plus sign is a plus sign."""
    literal = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(text.contains("%"), F.url_decode(F.replace(literal, F.lit("+"), F.lit("%2B")))).otherwise(text)


def query_values(query: Column) -> Column:
    """The values of a query string, blanks included; keys are the interface's vocabulary, not data."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    value = lambda p: F.when(F.locate("=", p) > 0, F.substring(p, F.locate("=", p) + 1, F.char_length(p))).otherwise("")
    return F.when(F.coalesce(query, F.lit("")) == "", F.array().cast(_TEXTS)).otherwise(F.transform(pairs, lambda p: unquote(F.replace(value(p), F.lit("+"), F.lit(" ")))))


def keep(tokens: Column) -> Column:
    """Decode, then drop what is shorter than LEAST_CHARS: in this order, so `%20` does not pass."""
    return F.filter(F.transform(tokens, unquote), lambda t: F.char_length(t) >= LEAST_CHARS)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


_URL = r"^[^/?#]*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def split_string(text: Column) -> Column:
    """Tokens of one string: of a URL its authority, path segments and query values; of a path its
    segments; of anything else itself."""
    is_url = F.contains(text, F.lit("://"))
    authority = F.regexp_extract(text, _URL, 1)
    path = F.when(is_url, F.regexp_extract(text, _URL, 2)).otherwise(text)
    head = F.when(is_url & (authority != ""), F.array(authority)).otherwise(F.array().cast(_TEXTS))
    values = F.when(is_url, query_values(F.regexp_extract(text, _URL, 3))).otherwise(F.array().cast(_TEXTS))
    rest = F.when(F.contains(path, F.lit("/")), segments(path)).when(path != "", F.array(path)).otherwise(F.array().cast(_TEXTS))
    return keep(F.concat(head, values, rest))


def request_tokens(host: Column, target: Column, leaves: Column | None = None) -> Column:
    """Tokens of a request, sorted: authority, segments, query values and body leaves, then each split again.

    The second pass finds a URL or path that travels inside a value.
    """
    path = F.regexp_extract(target, r"^([^?#]*)", 1)
    query = F.regexp_extract(target, r"\?([^#]*)", 1)
    head = F.when(host != "", F.array(host)).otherwise(F.array().cast(_TEXTS))
    first = keep(F.concat(head, segments(path), query_values(query), *([leaves] if leaves is not None else [])))
    again = F.flatten(F.transform(first, split_string))
    return F.array_sort(F.array_distinct(F.concat(first, again)))


def string_leaves(rows: DataFrame, keys: list[str], document: str) -> DataFrame:
    """(keys, leaf): every string scalar of a JSON text, at any depth. What is no JSON has no leaf.

    One explosion a level, until no container is left: the levels are those of the deepest document.
    """
    spark = rows.sparkSession
    level = rows.select(*keys, F.try_parse_json(F.col(document)).alias("v")).filter("v IS NOT NULL")
    out: DataFrame | None = None
    while True:
        kind = F.schema_of_variant("v")
        found = level.filter(kind == "STRING").select(*keys, F.col("v").cast("string").alias("leaf"))
        out = found if out is None else out.unionAll(found)
        inner = level.filter(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        if inner.isEmpty():
            return out
        level = spark.sql(f"SELECT {', '.join('t.' + k for k in keys)}, e.value AS v FROM {{t}} AS t, LATERAL variant_explode(t.v) AS e", t=inner)


def host_suffixes(host: Column) -> Column:
    """The host and every suffix of it that begins at a label; lower case, without final dots."""
    labels = F.split(F.regexp_replace(F.lower(host), r"\.+$", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def is_local_address(host: Column) -> Column:
    """Loopback, private and link-local addresses, and the names of this machine."""
    host = F.lower(F.trim(F.coalesce(host, F.lit(""))))
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    four = host.rlike(rf"^{octet}(?:\.{octet}){{3}}$")
    part = lambda i: F.get(F.split(host, r"\."), F.lit(i)).try_cast("int")
    a, b, c = part(0), part(1), part(2)
    # The address ranges of the registries for special-purpose addresses.
    private = (
        a.isin(0, 10, 127)
        | (a >= 240)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254))
        | ((a == 192) & (b == 0) & c.isin(0, 2))
        | ((a == 198) & (b.isin(18, 19) | ((b == 51) & (c == 100))))
        | ((a == 203) & (b == 0) & (c == 113))
    )
    six = host.rlike(r"^(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|2001:db8:.*)$") & host.rlike(r"^[0-9a-f:]+$")
    return host.isin("", "localhost") | (four & private) | six


def argument_tokens(rows: DataFrame, keys: list[str], arguments: str) -> DataFrame:
    """(keys, token): the distinct structural tokens of the string leaves of a call's arguments (JSON text)."""
    leaves = string_leaves(rows, keys, arguments)
    return leaves.select(*keys, F.explode(split_string(F.col("leaf"))).alias("token")).distinct()


def body_values(rows: DataFrame, keys: list[str], body: str) -> DataFrame:
    """(keys, leaf): the string leaves of a body that is JSON, else its values as a form. Empty bodies have none."""
    held = rows.filter(F.coalesce(F.col(body), F.lit("")) != "")
    form = held.filter(F.try_parse_json(F.col(body)).isNull()).select(*keys, F.explode(query_values(F.col(body))).alias("leaf"))
    return string_leaves(held, keys, body).unionByName(form)


def tokens_of_request(rows: DataFrame, keys: list[str], host: str, target: str, body: str) -> DataFrame:
    """(keys, tokens): the sorted tokens of each request, those of its body among them. keys name one row."""
    named = body_values(rows, keys, body).groupBy(*keys).agg(F.collect_list("leaf").alias("_leaves"))
    with_body = rows.join(named, keys, "left").withColumn("_leaves", F.coalesce("_leaves", F.array().cast(_TEXTS)))
    return with_body.select(*keys, request_tokens(F.col(host), F.col(target), F.col("_leaves")).alias("tokens"))
