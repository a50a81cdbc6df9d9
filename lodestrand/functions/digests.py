"""Digests and canonical forms that no built-in function gives, in Arrow batches; and texts about findings."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a digest, what keeps token digests apart from gram digests, and the form of a bench's material (fixed values).
DIGEST_BYTES, TOKEN_DOMAIN = 16, b"tok\x00"
FRAGMENT_PREFIX, FRAGMENT_HEX = "BF", 38
#: Numbers of calls at once that a server is driven at (fixed values).
CONCURRENCY = (2, 5, 10)


def _texts(make, kind: str = "string"):
    return F.pandas_udf(lambda values: pd.Series([None if v is None or v is pd.NA else make(v) for v in values], dtype=object), kind)


def canonical_arguments(arguments: Column) -> Column:
    """A call's arguments (JSON text) as the bytes that they are matched as: keys sorted, ASCII; null for what is no JSON."""

    def canonical(text: str) -> bytes | None:
        try:
            return json.dumps(json.loads(text), sort_keys=True).encode()
        except ValueError:
            return None

    return _texts(canonical, "binary")(arguments)


def gram_digest(value: Column, salt: str) -> Column:
    """The salted digest of a rolling hash (a long from 0), as hex."""
    key = salt.encode()

    @F.pandas_udf("string")
    def digests(values: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else hashlib.blake2b(int(v).to_bytes(8, "big"), key=key, digest_size=DIGEST_BYTES).hexdigest() for v in values.astype("Int64")], dtype=object)

    return digests(value)


def token_digest(token: Column, salt: str) -> Column:
    """The salted digest of a structural token, never equal to that of a gram. Short tokens can be guessed by who has the salt."""
    key = salt.encode()
    return _texts(lambda t: hashlib.blake2b(TOKEN_DOMAIN + t.encode("utf-8", "surrogateescape"), key=key, digest_size=DIGEST_BYTES).hexdigest())(token)


def finding(digest: Column, reference: Column, domain: Column) -> Column:
    """The one sentence about a match that may be stored."""
    return F.format_string("fragment %s from reference %s appeared in output toward %s", digest, reference, domain)


def fragment(tag: str, key: bytes) -> str:
    """A bench's material for a tag under the bench's key: no two tags share a run that could match."""
    return FRAGMENT_PREFIX + hashlib.blake2b(tag.encode(), key=key, digest_size=32).hexdigest()[:FRAGMENT_HEX]


def encoded(text: Column, encoding: str) -> Column:
    """Material re-encoded so that no literal run is left: base64, gzip or json_escaped."""
    if encoding == "base64":
        return F.base64(F.encode(text, "UTF-8")).cast("binary")
    makers = {"gzip": lambda t: gzip.compress(t.encode(), mtime=0), "json_escaped": lambda t: "".join(f"\\u{ord(c):04x}" for c in t).encode()}
    return _texts(makers[encoding], "binary")(text)


def decoded(data: bytes, encoding: str) -> str:
    """What `encoded` was made of."""
    if encoding == "base64":
        return base64.b64decode(data).decode()
    if encoding == "gzip":
        return gzip.decompress(data).decode()
    return json.loads(f'"{data.decode()}"')


def frac(part: Column, whole: Column) -> Column:
    """A ratio to four places, 0.0 where there is nothing to divide by."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), 4)


def concurrency_levels(cap: Column, corpus: Column) -> Column:
    """The rungs at which a server is driven: none above its cap or the number of distinct calls."""
    return F.filter(F.array(*map(F.lit, CONCURRENCY)), lambda n: n <= F.least(cap, corpus))


def word_count(text: Column) -> Column:
    """Words as runs of anything but white space."""
    core = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(core == "", 0).otherwise(F.size(F.split(core, r"(?U)\s+"))).cast("long")


def traceparent() -> Column:
    """A new trace context for each row (version 00, sampled); it differs each time."""
    hexes = lambda n: F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, n)
    return F.concat(F.lit("00-"), hexes(32), F.lit("-"), hexes(16), F.lit("-01"))


def first_difference(left: Column, right: Column) -> Column:
    """struct(line, left, right): the first line (from 1) in which two texts differ, runs of blanks counting as one; null for none."""
    lines = lambda c: F.transform(F.split(c, "\n"), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " ")))
    both = F.zip_with(lines(left), lines(right), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    placed = F.transform(both, lambda x, i: F.struct((i + 1).alias("line"), x["left"].alias("left"), x["right"].alias("right")))
    return F.get(F.filter(placed, lambda x: ~x["left"].eqNullSafe(x["right"])), F.lit(0))


def summary_counts(text: Column) -> Column:
    """The counts of a test run's summary line by outcome, as a map."""
    found = F.regexp_extract_all(text, F.lit(r"\d+ (?:passed|failed|skipped|errors?|xfailed|xpassed)"), F.lit(0))
    pairs = F.transform(found, lambda x: F.struct(F.regexp_replace(F.split_part(x, F.lit(" "), F.lit(2)), "^error$", "errors").alias("outcome"), F.split_part(x, F.lit(" "), F.lit(1)).cast("long").alias("n")))
    return F.map_from_entries(pairs)
