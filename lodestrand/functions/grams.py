"""Byte k-grams: sequences, rolling hash, winnowing, coverage. All on BINARY, so a gram is bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a gram in bytes, and of a winnowing window in grams.
K, W = 22, 8
#: The rolling hash's modulus (a Mersenne prime, so reduction stays within 64 bits) and base.
MODULUS, BASE = (1 << 61) - 1, 257


def grams(rows: DataFrame, data: str, k: int | str = K, pos: str = "pos", gram: str = "gram") -> DataFrame:
    """A row for each k-gram of a binary column, with its position. k: a number or a column's name.

    Rows shorter than k, or null, have none; the filter comes before the explosion.
    """
    width = F.lit(k) if isinstance(k, int) else F.col(k)
    n = F.octet_length(data)
    long_enough = rows.filter(n >= width)
    at = long_enough.withColumn(pos, F.explode(F.sequence(F.lit(0), (n - width).cast("int"))))
    return at.withColumn(gram, F.substring(F.col(data), F.col(pos) + 1, width))


def polynomial(gram: Column) -> Column:
    """The hash of a gram: base 257 modulo 2^61 - 1, without overflow of a signed 64-bit number."""
    text = F.hex(gram)
    byte = lambda i: F.conv(F.substring(text, 2 * i + 1, F.lit(2)), 16, 10).cast("long")

    def step(h: Column, i: Column) -> Column:
        # 256 h + h + b, with the top 8 of 61 bits folded round
        shifted = F.shiftright(h, 53) + F.shiftleft(h.bitwiseAND(F.lit((1 << 53) - 1)), 8)
        return (shifted + h + byte(i)) % MODULUS

    return F.aggregate(F.sequence(F.lit(0), F.octet_length(gram) - 1), F.lit(0).cast("long"), step)


def winnow(sequence: DataFrame, doc: str, pos: str, value: str, w: int = W) -> DataFrame:
    """(doc, value): the minima of all windows of w values; of the whole sequence if it is shorter.

    Two documents that share w grams in a row share a value here.
    """
    if w <= 0:
        raise ValueError("a window needs a positive length")
    ahead = Window.partitionBy(doc).orderBy(pos).rowsBetween(0, w - 1)
    whole = Window.partitionBy(doc)
    rows = sequence.select(doc, pos, F.min(value).over(ahead).alias(value), F.max(pos).over(whole).alias("last"))
    return rows.filter((F.col(pos) <= F.col("last") - (w - 1)) | ((F.col("last") < w - 1) & (F.col(pos) == 0))).select(doc, value).distinct()


def covered(hits: DataFrame, keys: list[str], pos: str, k: int | str = K) -> DataFrame:
    """Bytes under the union of [pos, pos + k) of each key's hits; hits at one position count once."""
    width = F.lit(k) if isinstance(k, int) else F.col(k)
    once = hits.select(*keys, pos, *([k] if isinstance(k, str) and k not in keys else [])).distinct()
    follows = F.lead(pos).over(Window.partitionBy(*keys).orderBy(pos)) - F.col(pos)
    step = once.withColumn("step", F.least(width, F.coalesce(follows, width)))
    return step.groupBy(*keys).agg(F.sum("step").cast("long").alias("matched_bytes"))
