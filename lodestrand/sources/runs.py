"""Runs: calls, flows and a manifest as JSON, one folder a run."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.schema import CALLS, DEFAULTS, FLOWS, MANIFEST


class RunError(ValueError):
    """A run that can't be read, or must not be measured."""


@dataclass(frozen=True)
class Run:
    manifest: DataFrame
    calls: DataFrame
    flows: DataFrame


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, of any store that Spark reads, has something."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_records(spark: SparkSession, path: str, schema: T.StructType, defaults: dict | None = None, strict: bool = True) -> DataFrame:
    """JSON lines to records; absent fields read as their defaults.

    A malformed line fails the read, and so does a field that the schema lacks (strict), as a record
    that is only half understood is no evidence.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), F.json_object_keys("value").alias("keys"))
    if strict:
        unknown = F.array_except("keys", F.array(*[F.lit(f.name) for f in schema]))
        message = F.concat(F.lit("unknown field: "), F.array_join(unknown, ", "))
        checked = F.when(F.size(unknown) > 0, F.raise_error(message).cast(schema)).otherwise(F.col("r"))
        parsed = parsed.withColumn("r", checked)
    return parsed.select(*[F.coalesce(F.col(f"r.{f.name}"), F.lit(defaults[f.name])).alias(f.name) if defaults and f.name in defaults else F.col(f"r.{f.name}") for f in schema])


def read_optional(spark: SparkSession, path: str, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """As read_records; a path that is not there is an empty table."""
    return read_records(spark, path, schema, defaults) if exists(spark, path) else spark.createDataFrame([], schema)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)


def load_run(spark: SparkSession, folder: str) -> Run:
    return Run(
        read_manifest(spark, f"{folder}/manifest.json"),
        read_records(spark, f"{folder}/calls.jsonl", CALLS, DEFAULTS["calls"]),
        read_records(spark, f"{folder}/flows.jsonl", FLOWS, DEFAULTS["flows"]),
    )


def latest(manifests: DataFrame, pass_name: str | None = None) -> str | None:
    """The id of the last run, or of the last of one pass; null if there is none."""
    rows = manifests.filter(F.col("pass_name") == pass_name) if pass_name else manifests
    return rows.agg(F.max_by("run_id", F.struct("created", "run_id"))).first()[0]


def refuse_control(run: Run) -> Run:
    """A control run measures a bare browser; no number is to be computed from one."""
    if run.manifest.filter("pass_name = 'control'").limit(1).count():
        raise RunError("a control run has no numbers")
    return run


def write_records(rows: DataFrame, path: str, order: list[str] | None = None, single: bool = False) -> None:
    """Records as JSON lines with their fields by name; ordered, and in one file only where asked."""
    sorted_fields = rows.select(*sorted(rows.columns))
    if order:
        sorted_fields = sorted_fields.orderBy(*order)
    lines = sorted_fields.select(F.to_json(F.struct(*sorted_fields.columns), {"ignoreNullFields": "false"}).alias("value"))
    (lines.coalesce(1) if single else lines).write.mode("error").text(path)


def append_tolerantly(rows: DataFrame, schema: T.StructType, folder: str) -> DataFrame:
    """Append JSON texts (column value) to folder/kind=good, and those that are no record to folder/kind=bad.

    One pass parses and writes. The result counts what the folder now has: (kind, n).
    """
    parsed = rows.withColumn("r", F.from_json("value", T.StructType([*schema, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    whole = F.col("r").isNotNull() & F.col("r._bad").isNull()
    parsed.select("value", F.when(whole, "good").otherwise("bad").alias("kind")).write.mode("append").partitionBy("kind").text(folder)
    return rows.sparkSession.read.schema("value string, kind string").text(folder).groupBy("kind").agg(F.count("*").alias("n"))


def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that `append_tolerantly` put aside."""
    return spark.read.schema("value string, kind string").text(folder).filter("kind = 'bad'").select("value")


def noise_tolerant(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, count of lines that are none) of a column `value` of mixed output."""
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return parsed.filter(is_object).select("r.*"), parsed.agg(F.count_if(~is_object).alias("noise_lines"))


def write_manifest(rows: DataFrame) -> str:
    """The manifest (one row) as JSON text with sorted keys."""
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise RunError("a manifest is one row")
    return json.dumps(found[0].asDict(recursive=True), sort_keys=True, indent=2, default=str)


def undriven(expected: DataFrame, driven: DataFrame, error: str) -> DataFrame:
    """Rows for the calls that were planned and never driven: a failed start is a fact, not a gap."""
    rest = expected.join(driven.select("run_id", "call_id"), ["run_id", "call_id"], "left_anti")
    return rest.withColumn("ok", F.lit(False)).withColumn("error", F.lit(error))
