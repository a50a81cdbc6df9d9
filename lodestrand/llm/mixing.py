"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source's documents, in a seeded order, are one stream of words, cut into blocks of equal length.
All blocks of the mix are apportioned to sources by highest quotients (target / 1, / 3, / 5, ...), and
each source's to its shards in the same way, so that every shard has an integer quota. A shard takes
each of its blocks as often as the quota goes into their number, and a seeded choice of them once
more. What a document gives is then a difference of two closed forms at its ends, so no block
becomes a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, word_count

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Words of a block at most, and blocks that the smallest source's target has at least.
BLOCK_WORDS, LEAST_BLOCKS = 1024, 1000
#: Words and rows of a shard on average at most, and shards of a source, which are ranked in one task: a larger
#: source has larger shards.
SHARD_WORDS, SHARD_ROWS, MOST_SHARDS = 1_000_000, 20_000, 100_000


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Add weight and target to (source, source_size): a share of the total by weight, none above `most` sizes.

    Sources count by code point, null last, and weigh `weights` in turn. With the sources by size over
    weight, those at their limit come first; the rest share what is left by weight. One row a source.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    tightest = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = tightest.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        F.row_number().over(tightest).alias("place"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped_before"),
        F.sum("weight").over(tightest.rowsBetween(0, Window.unboundedFollowing)).alias("weight_from"),
        F.sum("source_size").over(everything).alias("total"),
    )
    left = F.col("total") - F.col("capped_before")
    rows = rows.withColumn("free", F.col("weight") * left <= F.col("cap") * F.col("weight_from"))
    rows = rows.withColumn("first_free", F.min(F.when(F.col("free"), F.col("place"))).over(everything))
    first = F.col("place") == F.col("first_free")
    rows = rows.withColumn("share", F.max(F.when(first, left)).over(everything)).withColumn("shared_by", F.max(F.when(first, F.col("weight_from"))).over(everything))
    target = F.when(F.col("place") < F.col("first_free"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("share")).cast("double") / F.col("shared_by"))
    return rows.select("source", "source_size", "rows", "weight", target.alias("target"), "total")


def apportion(rows: DataFrame, group: list[str], weight: str, seats: str, order: list[Column]) -> DataFrame:
    """Sainte-Lague: add `quota`, which gives the `seats` of each group to its rows by highest quotients.

    Two divisors bracket the right one: with m rows, seats less m/2 + 1 shared by rounding give too few
    and seats plus m/2 + 1 too many. Only the quotients between them, some 2 m, are ranked.
    """
    whole = Window.partitionBy(*group)
    w = F.col(weight).cast("double")
    rows = rows.withColumn("_all", F.sum(w).over(whole)).withColumn("_m", F.count(F.when(w > 0, 1)).over(whole))

    def rounded(n: Column) -> Column:
        return F.when(F.col("_all") > 0, F.floor(w / F.col("_all") * F.greatest(n, F.lit(0.0)) + 0.5)).otherwise(F.lit(0)).cast("long")

    margin = F.col("_m") / 2 + 1
    rows = rows.withColumn("_base", rounded(F.col(seats) - margin)).withColumn("_top", rounded(F.col(seats) + margin))
    rows = rows.withColumn("_rest", F.col(seats) - F.sum("_base").over(whole)).withColumn("_row", F.struct(*order))
    ranked = rows.filter(w > 0).select(*group, "_row", "_rest", F.explode(F.sequence("_base", "_top")).alias("_k"), w.alias("_w"))
    quotient = F.col("_w") / (2 * F.col("_k") + 1)
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(quotient.desc(), "_row", "_k")))
    more = ranked.filter(F.col("_rank") <= F.col("_rest")).groupBy(*group, "_row").agg(F.count("*").alias("_more"))
    same = F.lit(True)
    left, right = rows.alias("l"), more.alias("r")
    for c in [*group, "_row"]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    out = left.join(right, same, "left")
    kept = [c for c in rows.columns if not c.startswith("_")]
    return out.select(*[F.col(f"l.{c}") for c in kept], (F.col("l._base") + F.coalesce("r._more", F.lit(0))).alias("quota"))


def _taken_before(x: Column) -> Column:
    """Words that a shard gives of its first x words."""
    block = F.floor(x / F.col("block")).cast("long")

    def chosen(i: Column) -> Column:
        """How many of the first i blocks the seeded choice takes: evenly spaced from a seeded turn."""
        per = F.greatest("blocks", F.lit(1))
        return (F.floor((i * F.col("extra") + F.col("turn")) / per) - F.floor(F.col("turn") / per)).cast("long")

    part = x - block * F.col("block")
    return F.col("copies") * x + chosen(block) * F.col("block") + (chosen(block + 1) - chosen(block)) * part


def mix(docs: DataFrame, seed: int = 17, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of (doc_id, source, text).

    Null texts have size 0 and give nothing; a null source is one source. Rows with one id stay apart.
    No row gives more than `most` times its size. `keep` names columns to carry along (under `kept`);
    `place` says which of the row's words are meant, for `render`.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("void")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *([kept.alias("kept")] if keep else []))
    sized = materialise(sized, "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, most)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy())
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.coalesce(least, F.lit(1.0)) / LEAST_BLOCKS))).cast("long"))
    sources = sources.withColumn("seats", F.floor(F.col("total") / F.col("block")).cast("long"))
    sources = apportion(sources, [], "target", "seats", [F.col("source")])
    shards = F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("rows") / SHARD_ROWS)))).cast("long")
    sources = materialise(sources.select("source", "source_size", "target", "block", "quota", shards.alias("shards")), "sources")

    # Names are joined by value and nullness, as a null source is a source too.
    named = sources.select(F.col("source").alias("_source"), "source_size", "target", "block", F.col("quota").alias("source_quota"), "shards")
    drawn = F.xxhash64(F.lit(seed), "doc_id", "size")
    dealt = sized.join(named, sized.source.eqNullSafe(named._source)).drop("_source")
    dealt = dealt.withColumn("drawn", drawn).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), "shards"))
    narrow = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"), F.first("block").alias("b"))
    cells = apportion(narrow, ["source"], "words", "source_quota", [F.col("shard")])
    blocks = F.ceil(F.col("words") / F.col("b")).cast("long")
    quota = F.least(F.col("quota"), blocks * most)
    per = F.greatest(blocks, F.lit(1))
    copies = F.floor(quota / per).cast("long")
    cells = materialise(cells.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), blocks.alias("blocks"), copies.alias("copies"), (quota - copies * per).alias("extra"), F.pmod(F.xxhash64(F.lit(seed + 2), F.coalesce("source", F.lit("")), "shard"), per).alias("turn")), "cells")
    joined = dealt.join(cells, dealt.source.eqNullSafe(cells._source) & (dealt.shard == cells._shard)).drop("_source", "_shard")
    order = Window.partitionBy("source", "shard").orderBy("drawn", "doc_id", "size")
    joined = joined.withColumn("begins", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    taken = _taken_before(F.col("begins") + F.col("size")) - _taken_before(F.col("begins"))
    place = F.struct("begins", "block", "blocks", "copies", "extra", "turn").alias("place")
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["kept", place] if keep else []))


def taken_ranges(size: int, place: dict) -> list[tuple[int, int]]:
    """The word ranges of a document that the seeded choice takes once more, beside its full copies."""
    begins, block, blocks, extra, turn = (place[k] for k in ("begins", "block", "blocks", "extra", "turn"))
    ranges: list[tuple[int, int]] = []
    if not extra or not size:
        return ranges
    for i in range(begins // block, (begins + size - 1) // block + 1):
        if ((i + 1) * extra + turn) // blocks - (i * extra + turn) // blocks:
            a, b = max(i * block, begins) - begins, min((i + 1) * block, begins + size) - begins
            if ranges and ranges[-1][1] == a:
                ranges[-1] = (ranges[-1][0], b)
            else:
                ranges.append((a, b))
    return ranges


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def render(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself, from `mix(..., keep=[...])`: a row for each copy, with the kept columns.

    Full copies keep the whole text; a part keeps its words with what lies between them. Documents of
    which nothing is taken give no row, but for wordless ones, which stay as they are.
    """
    bounded_batches(mixed.sparkSession)
    fields = mixed.schema["kept"].dataType
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.column("kept")
            source, texts = [], []
            old = kept.field(names.index(text)).to_pylist()
            for i, (size, place) in enumerate(zip(batch.column("size").to_pylist(), batch.column("place").to_pylist(), strict=True)):
                if not size:
                    source.append(i)
                    texts.append(old[i])
                    continue
                source.extend([i] * place["copies"])
                texts.extend([old[i]] * place["copies"])
                ranges = taken_ranges(size, place)
                if ranges == [(0, size)]:
                    source.append(i)
                    texts.append(old[i])
                elif ranges:
                    ends = [m.span() for m in _WORD.finditer(old[i])]
                    source.append(i)
                    texts.append("\n".join(old[i][ends[a][0] : ends[b - 1][1]] for a, b in ranges))
            rows = pa.array(source, pa.int64())
            columns = [pa.array(texts, kept.type.field(k).type) if n == text else kept.field(k).take(rows) for k, n in enumerate(names)]
            for at in range(0, len(source), 256):
                yield pa.RecordBatch.from_arrays([c[at : at + 256] for c in columns], names=names)

    return mixed.select("kept", "size", "place").mapInArrow(run, fields)
