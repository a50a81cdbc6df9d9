"""Shared scratch tables, file access and Arrow plumbing of the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.session import importable, scratch_root

#: Rows of one Arrow batch at most, so that long texts do not pile up in a Python worker.
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20
#: Bits of a presence bitmap: at most 262,144 rows of 16 bytes are broadcast.
PRESENCE_BITS = 1 << 24

def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/lodestrand/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back.

    This cuts the lineage: whatever reads the result recovers from the files and not from the
    executors that made them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no result reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def likely(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Add `likely`: false only for rows whose key is surely not among `wanted` (a column of the same name).

    A bitmap of PRESENCE_BITS, of which the words that have a bit, at most PRESENCE_BITS / 64 rows, are
    broadcast. So a join that few rows take part in need not move the wide rows that do not; if there
    are too many keys for the bitmap, more rows are likely and the join is the same.
    """
    place = F.pmod(F.xxhash64(key), F.lit(PRESENCE_BITS))
    bit = F.expr("shiftleft(1L, CAST(_place % 64 AS INT))")
    word = F.floor(F.col("_place") / 64).alias("_word")
    bits = wanted.select(place.alias("_place")).groupBy(word).agg(F.bit_or(bit).alias("_bits"))
    placed = rows.withColumn("_place", place).withColumn("_word", F.floor(F.col("_place") / 64))
    found = placed.join(F.broadcast(bits), "_word", "left")
    return found.withColumn("likely", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_place", "_word", "_bits")


def bounded_batches(spark: SparkSession) -> None:
    """Ready a session for Python workers: importable package, Arrow batches no larger than ours."""
    importable(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def one_task_each(files: DataFrame, name: str) -> DataFrame:
    """Deal a list of files out to about a task each, at most 10,000; small rows would else be coalesced."""
    return files.repartitionByRange(max(1, min(files.count(), 10_000)), name)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI: local, HDFS or an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """A column by its name, or nulls where the table has none."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under names of our own; extra columns go."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def arrow_rows(
    make: Callable[[pa.RecordBatch], Iterable[tuple]], schema: pa.Schema, flush: int = 2048
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that makes tuples of each batch; what it emits is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in make(batch):
                held.append(row)
                if len(held) >= flush:
                    yield to_batch(held, schema)
                    held = []
        if held:
            yield to_batch(held, schema)

    return run


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, type=f.type) for col, f in zip(zip(*rows), schema, strict=True)], schema=schema
    )


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\x09-\\x0D; null: 0."""
    blank = " \t\n\x0b\x0c\r"
    core = F.btrim(text, F.lit(blank))
    return F.when(F.coalesce(core, F.lit("")) == "", F.lit(0)).otherwise(
        F.size(F.split(core, r"[\x20\x09-\x0D]+"))
    ).cast("long")
