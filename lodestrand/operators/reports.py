"""Reports made of the operators: host classes, denominators, disclosure, control comparison, shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import evidence
from lodestrand.functions.structure import host_suffixes, is_local_address
from lodestrand.schema import STRONG_GRADES


def listed_hosts(hosts: DataFrame, host: str, lists: DataFrame) -> DataFrame:
    """(host, class): the distinct hosts that a list has, themselves or by a suffix that begins at a label.

    lists: (suffix, class). The test is an equality join on the suffixes of a host. A host that several
    classes have gets the first by name.
    """
    each = hosts.select(F.col(host).alias("host")).distinct().withColumn("suffix", F.explode(host_suffixes(F.col("host"))))
    return each.join(lists, "suffix").groupBy("host").agg(F.min("class").alias("class"))


def classified(hosts: DataFrame, host: str, lists: DataFrame) -> DataFrame:
    """Add `class`: local addresses, then the lists, and what is on none is a remote leaf."""
    found = listed_hosts(hosts, host, lists).withColumnRenamed("host", host)
    joined = hosts.join(found, host, "left")
    return joined.withColumn("class", F.when(is_local_address(F.col(host)), "local").otherwise(F.coalesce("class", F.lit("remote_leaf"))))


def denominators(graded: DataFrame) -> DataFrame:
    """Strong flows over three denominators, in one row; null where one is empty, 0 for all flows.

    graded: grade, possible, eligible, constant. The numerator counts every strong flow, also those
    outside a denominator; the repaired fraction counts those inside.
    """
    strong, attributable = F.col("grade").isin(*STRONG_GRADES), F.col("possible") & F.col("eligible")
    content = attributable & ~F.col("constant")
    counts = graded.agg(
        F.count("*").alias("flows"),
        F.count_if(strong).alias("strong"),
        F.count_if(attributable).alias("attributable"),
        F.count_if(content).alias("content"),
        F.count_if(attributable & strong).alias("strong_attributable"),
        F.count_if(content & strong).alias("strong_content"),
    )
    return counts.select(
        "*",
        evidence.ratio(F.col("strong"), F.col("flows")).alias("raw_fraction"),
        evidence.fraction(F.col("strong"), F.col("attributable")).alias("attributable_fraction"),
        evidence.fraction(F.col("strong"), F.col("content")).alias("content_fraction"),
        evidence.fraction(F.col("strong_content"), F.col("content")).alias("repaired_content_fraction"),
    )


def disclosure(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """server, declared, known, new, verdict, by the distinct hosts that each server reached.

    observed: (server, host); declared: (server, suffix, status). Declared wins over known; a server that
    declares nothing has only new hosts, as no expectation is none that is met.
    """
    hosts = observed.select("server", F.lower(F.trim("host")).alias("host")).filter("host <> ''").distinct()
    each = hosts.withColumn("suffix", F.explode(host_suffixes(F.col("host"))))
    status = each.join(declared, ["server", "suffix"]).groupBy("server", "host").agg(F.min("status").alias("status"))
    judged = hosts.join(status, ["server", "host"], "left").withColumn("status", F.coalesce("status", F.lit("new")))
    counted = judged.groupBy("server").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("declared", "known", "new")])
    return counted.withColumn("verdict", F.when(F.col("new") > 0, "review_required").otherwise("clear"))


def control(control_hosts: DataFrame, subject_hosts: DataFrame, review: DataFrame) -> DataFrame:
    """Which hosts under review the control run reached too, in one row with its verdict."""
    each = [df.select("host").filter("host <> ''").distinct().withColumn(n, F.lit(1)) for df, n in ((control_hosts, "c"), (subject_hosts, "s"), (review, "r"))]
    joined = each[0].join(each[1], "host", "full_outer").join(each[2], "host", "full_outer")
    c, s, r = (F.col(x).isNotNull() for x in "csr")
    n = joined.agg(F.count_if(r).alias("under_review"), F.count_if(r & c).alias("reproduced"), F.count_if(r & ~c).alias("not_reproduced"), F.count_if(c & ~s).alias("only_in_control"), F.count_if(s & ~c).alias("only_in_subject"))
    verdict = F.when(F.col("under_review") == 0, "nothing_under_review").when(F.col("reproduced") == 0, "cause_not_reproduced").when(F.col("not_reproduced") > 0, "cause_partially_reproduced").otherwise("cause_reproduced")
    return n.withColumn("verdict", verdict)


def curve(points: DataFrame, order: str, strong: str, whole: str, members: str) -> DataFrame:
    """Add fraction, fell (null for the first point), always_fell, and what `members` gained and lost since the point before.

    points: a row a measured point, of which there are few: they are put in order in one task.
    """
    along = Window.orderBy(order)
    share = points.withColumn("fraction", evidence.ratio(F.col(strong), F.col(whole)))
    stepped = share.withColumn("_before", F.lag("fraction").over(along)).withColumn("_were", F.lag(members).over(along))
    fell = F.when(F.col("_before").isNotNull(), F.col("fraction") < F.col("_before"))
    apart = lambda a, b: F.coalesce(F.array_sort(F.array_except(a, b)), F.array().cast("array<string>"))
    named = stepped.withColumn("fell", fell).withColumn("added", apart(members, "_were")).withColumn("removed", apart("_were", members))
    return named.withColumn("always_fell", F.min(F.coalesce("fell", F.lit(True))).over(Window.partitionBy())).drop("_before", "_were")


_NESTED = ("items", "additionalProperties")
_CHOICES = ("anyOf", "oneOf", "allOf")


def carries_string(tools: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """(keys): those whose JSON Schema admits a string leaf: by its type, an enum of strings without a type, or a
    schema below it (properties, items, additionalProperties, anyOf, oneOf, allOf). One step a level."""
    spark = tools.sparkSession
    level = tools.select(*keys, F.try_parse_json(F.col(schema)).alias("v")).filter("v IS NOT NULL")
    out: DataFrame | None = None
    while True:
        level = level.filter(F.schema_of_variant("v").startswith("OBJECT"))
        kind = F.try_variant_get("v", "$.type", "string")
        listed = F.exists(F.coalesce(F.try_variant_get("v", "$.enum", "array<variant>"), F.array().cast("array<variant>")), lambda e: F.schema_of_variant(e) == "STRING")
        hit = level.filter((kind == "string") | (kind.isNull() & listed)).select(*keys)
        out = hit if out is None else out.unionByName(hit)
        below = F.concat(
            F.coalesce(F.map_values(F.try_variant_get("v", "$.properties", "map<string,variant>")), F.array().cast("array<variant>")),
            F.array(*[F.try_variant_get("v", f"$.{name}", "variant") for name in _NESTED]),
            *[F.coalesce(F.try_variant_get("v", f"$.{name}", "array<variant>"), F.array().cast("array<variant>")) for name in _CHOICES],
        )
        level = level.select(*keys, F.explode(below).alias("v")).filter("v IS NOT NULL")
        if level.isEmpty():
            return out.distinct()


def argument_shapes(tools: DataFrame) -> DataFrame:
    """Add `shape` and `declared_enum` to (tool, schema): by the required string properties, else by any string inside.

    Required names that are no property do not count. declared_enum: a required string lists its values.
    """
    property_type = "map<string,struct<type:string,format:string,enum:array<string>>>"
    kinds = F.from_json(F.get_json_object("schema", "$.properties"), property_type)
    required = F.from_json(F.get_json_object("schema", "$.required"), "array<string>")
    named = tools.withColumn("p", F.coalesce(kinds, F.create_map().cast(property_type))).withColumn("r", F.coalesce(required, F.array().cast("array<string>")))
    named = named.withColumn("s", F.filter("r", lambda x: F.element_at("p", x)["type"] == "string"))
    named = named.join(carries_string(tools, ["tool"], "schema").withColumn("inside", F.lit(True)), "tool", "left")
    uris = F.filter("s", lambda x: F.element_at("p", x)["format"] == "uri")
    shape = (
        F.when(F.size("s") >= 2, "structured")
        .when((F.size("s") == 1) & (F.size(uris) > 0), "single_value_declared_uri")
        .when((F.size("s") == 1) | F.col("inside"), "single_value")
        .otherwise("no_string")
    )
    listed = F.exists("s", lambda x: F.coalesce(F.size(F.element_at("p", x)["enum"]), F.lit(0)) > 0)
    return named.withColumn("shape", shape).withColumn("declared_enum", listed).drop("p", "r", "s", "inside")
