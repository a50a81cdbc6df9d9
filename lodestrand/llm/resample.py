"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and word pairs are hashed into buckets. The target model counts a bounded sample of labelled good
documents, the raw model counts every document. A document's log importance weight is
log p_target - log p_raw under these models, read as one passage of at most PASSAGE words, so that long
texts do not win or lose by their length alone. Gumbel noise of scale 1, seeded by the document, turns the k
largest keys into a sample without replacement, in which chances are as the weights. k, unless given, is
the number of documents whose weight is within that of good ones.

A few words that the target never has hardly change the weight of a long passage. They are read apart
(`out_of_target`), and `reject` drops what has them; it is no part of the sampling.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise

#: Buckets of words and of word pairs (powers of two).
WORD_BITS, PAIR_BITS = 20, 18
BUCKETS = (1 << WORD_BITS) + (1 << PAIR_BITS)
#: Labelled rows that are fitted on at most (in expectation; chosen by a hash of the id).
LABELLED_ROWS = 40_000
#: Share of them that is held out to put weights on a scale.
HELD_OUT = 0.3
#: Prior count of a bucket in the models; words of the passage as which a document is weighed.
PRIOR, PASSAGE = 5.0, 64
#: Prior count for words that the target may never have, and the log-ratio beyond which a word is one.
RARE_PRIOR, CLEARLY = 1.0, 0.7
#: Quantile of held-out good documents that bounds what is within good ones.
EDGE = 0.002
#: Keys that are sorted on the driver at most, in the last step of the selection.
LAST_KEYS = 10_000

_MIX1, _MIX2, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def buckets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of a text, and of its pairs of neighbours."""
    words = text.encode("utf-8").split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pairs = h[:-1] * _MIX1 ^ h[1:] * _MIX2
    pairs = (pairs ^ pairs >> np.uint64(29)) * _MIX3
    return (h * _MIX1 >> np.uint64(64 - WORD_BITS)).astype(np.int64), (1 << WORD_BITS) + (pairs >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


COUNTS = pa.schema([("bucket", pa.int64()), ("raw", pa.int64()), ("target", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    held: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal raw, size
        if held:
            raw += np.bincount(np.concatenate(held), minlength=BUCKETS)
            held.clear()
            size = 0

    for batch in batches:
        for text, good in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist(), strict=True):
            both = buckets(text)
            held.extend(both)
            size += 2 * len(both[0])
            if good:
                for b in both:
                    np.add.at(target, b, 1)
            if size > 2_000_000:
                flush()
    flush()
    used = np.flatnonzero(raw)
    for at in range(0, len(used), 1 << 16):
        part = used[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(raw[part]), pa.array(target[part])], schema=COUNTS)


def labelled(labels: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, good, held_out): a sample of the labels, at most `most` rows in expectation.

    One row an id: good if every row of it has quality 1 and none toxic 1; ids or labels that are null go.
    """
    one = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    one = one.agg(((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("good"))
    n = one.count()
    share = min(1.0, most / n) if n else 1.0
    drawn = F.pmod(F.xxhash64(F.lit("labels"), "doc_id"), F.lit(1 << 20))
    held = F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(1000)) < int(1000 * HELD_OUT)
    return one.filter(drawn < int(share * (1 << 20)) + (share == 1.0)).select("doc_id", "good", held.alias("held_out"))


def count(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over all texts and over good ones, from rows of (text, good)."""
    bounded_batches(texts.sparkSession)
    rows = texts.select("text", "good").mapInArrow(_count, "bucket long, raw long, target long")
    total = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    got = total.toArrow()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = got.column("bucket").to_numpy()
    raw[at], target[at] = got.column("raw").to_numpy(), got.column("target").to_numpy()
    return raw, target


def log_ratio(raw: np.ndarray, target: np.ndarray, prior: float) -> np.ndarray:
    """log p_target - log p_raw of each bucket, apart for words and for pairs; `prior` keeps rare ones near 0."""
    ratio = np.zeros(BUCKETS, np.float32)
    for part in (slice(0, 1 << WORD_BITS), slice(1 << WORD_BITS, BUCKETS)):
        share = target[part].sum() / max(raw[part].sum(), 1.0)
        ratio[part] = np.log((target[part] + prior) / (raw[part] * share + prior))
    return ratio


def weigh(text: str, ratio: np.ndarray, rare: np.ndarray) -> tuple[float, float]:
    """(log weight, evidence of words that the target never has: the sum of their log-ratios over the root
    of the length); wordless: zeros."""
    words, pairs = buckets(text)
    if not len(words):
        return 0.0, 0.0
    total = float(ratio[words].sum(dtype=np.float64)) + float(ratio[pairs].sum(dtype=np.float64))
    weight = total * min(1.0, PASSAGE / len(words))
    return weight, float(np.minimum(rare[words] + CLEARLY, 0).sum(dtype=np.float64)) / len(words) ** 0.5


def _gumbel(seed: int, *columns: str) -> Column:
    u = (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest value of a column, by histograms; only their bins and LAST_KEYS values reach the driver."""
    if k <= 0:
        return None
    while True:
        n, low, high = rows.agg(F.count(key), F.min(key), F.max(key)).first()
        if n < k:
            return low
        if n <= LAST_KEYS or low == high:
            break
        width = (high - low) / 4096
        cell = F.least(F.floor((F.col(key) - low) / width), F.lit(4095)).cast("int")
        bins = {r[0]: (r[1], r[2], r[3]) for r in rows.groupBy(cell.alias("c")).agg(F.count("*"), F.min(key), F.max(key)).collect()}
        for c in sorted(bins, reverse=True):
            if bins[c][0] >= k:
                rows = rows.filter((F.col(key) >= bins[c][1]) & (F.col(key) <= bins[c][2]))
                break
            k -= bins[c][0]
    if low == high:
        return low
    return sorted((r[0] for r in rows.select(key).filter(F.col(key).isNotNull()).collect()), reverse=True)[k - 1]


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 11, keep: Sequence[str] = (), labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """The sampled documents: doc_id, log_weight, key, out_of_target (and `kept`, the columns named in `keep`).

    out_of_target is negative for a document whose evidence of words that the target never has is beyond that
    of held-out good ones. Null texts are empty; wordless documents have weight 0. Equal rows have equal
    keys; those that tie with the k-th are all in the sample. Without good labels nothing is known and all
    documents are kept with weight 0.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labelled(labels, labelled_rows)
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []),
    )
    known = materialise(known, "labelled")
    # LABELLED_ROWS bounds what is broadcast.
    judged = named.select("doc_id", "text").join(F.broadcast(known), "doc_id", "left")
    good = F.coalesce(F.col("good") & ~F.col("held_out"), F.lit(False))
    counts = count(judged.select("text", good.alias("good")))
    ratios = spark.sparkContext.broadcast((log_ratio(*counts, PRIOR), log_ratio(*counts, RARE_PRIOR)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.array([weigh(t, *ratios.value) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, 2)
            columns = [batch.column("doc_id"), pa.array(both[:, 0]), pa.array(both[:, 1])]
            names = ["doc_id", "log_weight", "rare"]
            if "kept" in batch.schema.names:
                columns.append(batch.column("kept"))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = [f for f in named.schema.fields if f.name == "kept"]
    schema = "doc_id long, log_weight double, rare double" + "".join(f", kept {f.dataType.simpleString()}" for f in kept)
    scored = materialise(named.mapInArrow(score, schema), "weights")
    scale = scored.select("doc_id", "log_weight", "rare").join(F.broadcast(known.filter("good AND held_out")), "doc_id").select("log_weight", "rare").toArrow()
    names = ["kept"] if kept else []
    if not scale.num_rows:
        return scored.select("doc_id", *[F.lit(0.0).alias(c) for c in ("log_weight", "key", "out_of_target")], *names)
    least, rarest = (float(np.quantile(scale.column(c).to_numpy(), EDGE)) for c in ("log_weight", "rare"))
    weighed = scored.withColumn("out_of_target", F.col("rare") - rarest)
    weighed = weighed.withColumn("key", F.col("log_weight") + _gumbel(seed, "doc_id", "log_weight"))
    wanted = weighed.filter(F.col("log_weight") >= least).count() if k is None else k
    threshold = kth_largest(weighed, "key", wanted)
    chosen = weighed.filter(F.col("key") >= threshold) if threshold is not None else weighed.limit(0)
    return chosen.select("doc_id", "log_weight", "key", "out_of_target", *names)


def reject(sampled: DataFrame) -> DataFrame:
    """The sampled documents without those that have words which the target never has."""
    return sampled.filter("out_of_target >= 0")
