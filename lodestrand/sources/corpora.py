"""Corpora, lists and declarations. A list that is absent is None, never an empty list."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.digests import word_count
from lodestrand.functions.grams import K, grams
from lodestrand.sources.runs import exists


class PurposeError(ValueError):
    """A corpus that is used for what it was not set aside for."""


NEGATIVE = "half string, families array<struct<family:string,calls:array<struct<call_id:string,arguments:string,target:string,body:string,information:array<string>>>>>"
POSITIVE = "transfers array<struct<transfer_id:string,channel:string,arguments:string,target:string,body_b64:string,detectable_by_design:boolean,not_detectable_reason:string>>"


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def driven_calls(spark: SparkSession, path: str) -> DataFrame:
    """(server_id, tool, arguments as JSON text, ord), in the corpus's order."""
    rows = _document(spark, path, "calls array<struct<server_id:string,tool:string,arguments:string>>")
    return rows.select(F.posexplode("calls").alias("ord", "c")).select("c.*", "ord")


def first_calls(calls: DataFrame, by: str, n: int) -> DataFrame:
    """The first n calls of each, by their explicit order."""
    from pyspark.sql import Window

    return calls.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("ord"))).filter(F.col("_r") <= n).drop("_r")


def negative_corpus(spark: SparkSession, path: str, purpose: str) -> DataFrame:
    """Calls of a labelled half: half, family, call_id, arguments, target, body, information.

    The half that is held out for the verdict is not read to calibrate, and the reverse.
    """
    rows = _document(spark, path, NEGATIVE)
    halves = [r[0] for r in rows.select("half").distinct().limit(3).collect()]
    if halves != [purpose]:
        raise PurposeError(f"the corpus is {halves}, the purpose {purpose}")
    return rows.select("half", F.explode("families").alias("f")).select("half", "f.family", F.explode("f.calls").alias("c")).select("half", "family", "c.*")


def positive_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Known transfers, with their bodies as bytes."""
    rows = _document(spark, path, POSITIVE).select(F.explode("transfers").alias("t")).select("t.*")
    return rows.withColumn("body", F.unbase64("body_b64")).drop("body_b64")


def control_reasons(transfers: DataFrame) -> DataFrame:
    """Which transfers a byte-literal matcher must see, and why it can't see the others."""
    sent = transfers.filter(F.coalesce("error", F.lit("")) == "")
    reason = F.when(F.col("channel") == "header", "headers are not read").when(F.col("encoding").isin("base64", "gzip"), "re-encoded").when(~F.col("fragment_present"), "nothing was sent")
    return sent.withColumn("not_detectable_reason", reason).withColumn("detectable_by_design", reason.isNull())


def write_controls(transfers: DataFrame, path: str) -> None:
    """The transfers that were sent, each with why it can't be seen, as JSON lines in order; bodies as base64."""
    rows = control_reasons(transfers).drop("error")
    if "body" in rows.columns:
        rows = rows.withColumn("body_b64", F.base64("body")).drop("body")
    rows.orderBy("transfer_id").write.mode("error").json(path)


def background(spark: SparkSession, pattern: str, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of the files that a pattern names; a forbidden one among them is an error."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    for name in forbidden:
        if files.filter(F.col("path").endswith(name)).limit(1).count():
            raise PurposeError(f"{name} is held out and may not be background")
    return files


def context_index(files: DataFrame, k: int = K, salt: str = "") -> DataFrame:
    """(ref_id, digest): salted digests of the distinct grams of each context file; no bytes are kept."""
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("ref_id"), "content")
    found = grams(named, "content", k).select("ref_id", "gram").distinct()
    return found.select("ref_id", F.substring(F.sha2(F.concat(F.lit(salt).cast("binary"), F.col("gram")), 256), 1, 32).alias("digest"))


@dataclass(frozen=True)
class Listed:
    """A list, and what to cite it by."""

    rows: DataFrame
    name: str
    version: str
    sha256: str


def suffix_list(spark: SparkSession, path: str) -> Listed | None:
    """A list of host suffixes, or None where there is none: its figures are then withheld."""
    if not exists(spark, path):
        return None
    head = _document(spark, path, "list_name string, version string, suffixes array<string>").first()
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    rows = spark.createDataFrame([(s.lower(),) for s in head["suffixes"] or []], "suffix string")
    return Listed(rows, head["list_name"], head["version"], digest)


def constant_paths(spark: SparkSession, path: str) -> dict[str, list[str]] | None:
    """Exact paths, prefixes and hosts that clients ask for whatever the call is, or None."""
    if not exists(spark, path):
        return None
    head = _document(spark, path, "exact_paths array<struct<path:string>>, path_prefixes array<struct<prefix:string>>, hosts array<struct<host:string>>").first()
    return {"paths": [r[0] for r in head[0] or []], "prefixes": [r[0] for r in head[1] or []], "hosts": [r[0] for r in head[2] or []]}


#: Hosted interfaces that no one can run on a machine of their own (fixed values; a file adds to them).
REMOTE_LEAVES = (
    "googleapis.com", "google.com", "api.openai.com", "api.anthropic.com", "api.stripe.com", "api.github.com", "githubusercontent.com", "amazonaws.com",
    "blob.core.windows.net", "azure.com", "slack.com", "atlassian.net", "atlassian.com", "notion.so", "notion.com", "api.brave.com", "duckduckgo.com", "bing.com",
)


def registry(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(suffix, class): the defaults and what a file, where there is one, adds to them."""
    rows = [(s, "remote_leaf") for s in REMOTE_LEAVES]
    if path and exists(spark, path):
        head = _document(spark, path, "remote_leaf_suffixes array<string>, self_hostable_suffixes array<string>").first()
        rows += [(s.lower(), "remote_leaf") for s in head[0] or []] + [(s.lower(), "self_hostable") for s in head[1] or []]
    return spark.createDataFrame(rows, "suffix string, class string").distinct()


DECLARATIONS = "list_name string, version string, servers map<string,struct<hosts:array<string>,known_undeclared:map<string,string>,basis:string,launch_tool:string>>"


def _declarations(rows: DataFrame) -> DataFrame:
    texts = F.array().cast("array<string>")
    each = rows.select(F.explode("servers").alias("server", "d"))
    return each.select("server", F.coalesce("d.hosts", texts).alias("hosts"), F.coalesce(F.map_keys("d.known_undeclared"), texts).alias("known"), "d.basis", F.coalesce("d.launch_tool", F.lit("")).alias("launch_tool"))


def declarations(spark: SparkSession, path: str) -> DataFrame | None:
    """(server, hosts, known, basis, launch_tool), a row a server also where it declares no host; None where there is no file."""
    return _declarations(_document(spark, path, DECLARATIONS)) if exists(spark, path) else None


def carried_declarations(spark: SparkSession, block: str) -> DataFrame:
    """The same from the block (JSON text) that a redacted run carries, under its labels."""
    return _declarations(spark.range(1).select(F.from_json(F.lit(block), DECLARATIONS).alias("b")).select("b.*"))


def declared_destinations(spark: SparkSession, path: str) -> DataFrame | None:
    """(server, suffix, status, basis, launch_tool): a row for each declared host and known exception, or None."""
    each = declarations(spark, path)
    if each is None:
        return None
    rows = [each.select("server", F.explode(c).alias("suffix"), F.lit(s).alias("status"), "basis", "launch_tool") for c, s in (("hosts", "declared"), ("known", "known"))]
    return rows[0].unionByName(rows[1])


def relabelled_declarations(declared: DataFrame, servers: DataFrame, hosts: DataFrame) -> str:
    """The block that a redacted run carries: declarations under the labels of its servers and hosts (see operators.redaction)."""
    named = declared.join(servers.select(F.col("server_id").alias("server"), "label"), "server")
    maps = hosts.select("host", F.col("label").alias("to"))
    out = {}
    for column in ("hosts", "known"):
        each = named.select("label", F.explode(column).alias("h")).join(maps, F.lower("h") == F.col("host"))
        out[column] = {r["label"]: r["to"] for r in each.groupBy("label").agg(F.array_sort(F.collect_set("to")).alias("to")).collect()}
    # A row for each server that is declared.
    block = {r["label"]: {"hosts": out["hosts"].get(r["label"], []), "known_undeclared": dict.fromkeys(out["known"].get(r["label"], []), "carried"), "basis": "carried under labels", "launch_tool": r["launch_tool"]} for r in named.collect()}
    return json.dumps({"list_name": "declared-destinations", "version": "", "servers": block}, sort_keys=True)


def corpus_digest(files: DataFrame) -> DataFrame:
    """One row, `sha256`: the digest of the files' own digests in order of their paths. Contents stay in the tasks."""
    each = files.select("path", F.sha2("content", 256).alias("d"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "d"))), lambda x: x["d"]), "").cast("binary"), 256).alias("sha256"))


def credential_presence(servers: DataFrame, available: list[str]) -> DataFrame:
    """(server, credential_presence): for each named secret whether it is there, and nothing else about it.

    servers: (server, secrets, an array of names). A server without secrets has no row.
    """
    held = F.array(*map(F.lit, available)) if available else F.array().cast("array<string>")
    named = F.map_from_entries(F.transform(F.array_distinct("secrets"), lambda s: F.struct(s, F.array_contains(held, s))))
    return servers.filter(F.size("secrets") > 0).select("server", named.alias("credential_presence"))


def word_budget(files: DataFrame, classes: DataFrame) -> DataFrame:
    """bucket, documents, words: of files (path, text) by their class (path, bucket, start, end).

    Of a file with `start` and `end`, what lies between these headings is `operation` and the rest its bucket's. A file
    without a class, or with a heading that is gone, is an error: the budget would be that of other files.
    """
    joined = files.join(classes, "path", "left")
    missing = F.col("bucket").isNull() | (F.col("start").isNotNull() & ~(F.contains(F.col("text"), F.col("start")) & F.contains(F.col("text"), F.col("end"))))
    checked = joined.withColumn("bucket", F.when(missing, F.raise_error(F.concat(F.lit("not classified: "), "path"))).otherwise(F.col("bucket")))
    before = lambda text, mark: F.call_function("substring_index", text, mark, F.lit(1))
    head = before(F.col("text"), F.col("start"))
    rest = F.substring(F.col("text"), F.char_length(head) + F.char_length("start") + 1, F.char_length("text"))
    gate = before(rest, F.col("end"))
    tail = F.substring(rest, F.char_length(gate) + F.char_length("end") + 1, F.char_length("text"))
    own = F.array(F.struct(F.col("bucket").alias("bucket"), F.col("text").alias("part")))
    # A heading goes with what it closes.
    parts = F.array(*[F.struct(F.lit(b).alias("bucket"), p.alias("part")) for b, p in (("operation", F.col("start")), ("operation", gate), (None, head), (None, F.col("end")), (None, tail))])
    split = F.transform(parts, lambda x: F.struct(F.coalesce(x["bucket"], F.col("bucket")).alias("bucket"), x["part"].alias("part")))
    each = checked.select("path", F.explode(F.when(F.col("start").isNotNull(), split).otherwise(own)).alias("x")).select("path", "x.bucket", word_count(F.col("x.part")).alias("words"))
    return each.groupBy("bucket").agg(F.countDistinct("path").alias("documents"), F.sum("words").alias("words"))
