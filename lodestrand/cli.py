"""Commands over runs and corpora: `python -m lodestrand.cli <command> --help`. Results are printed as JSON lines."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.digests import canonical_arguments
from lodestrand.functions.structure import tokens_of_request
from lodestrand.operators import bench, calibration, control, disclosure, matching, numbers, redaction
from lodestrand.schema import CALLS, FLOWS
from lodestrand.sources import corpora, pcap, runs

PLAN = "call_id string, slot long, cell string, channel string, expect string, fragment_present boolean"
TRUTH = "dest_host string, error string"


def _print(rows: DataFrame) -> None:
    """Results are figures of a run, which are few."""
    for line in rows.toJSON().toLocalIterator():
        print(line)


def _lists(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame | None, dict | None]:
    listed = corpora.suffix_list(spark, args.exclusions) if args.exclusions else None
    return (listed.rows if listed else None), (corpora.constant_paths(spark, args.constant_paths) if args.constant_paths else None)


def _numbers(spark: SparkSession, args: argparse.Namespace) -> int:
    run = runs.refuse_control(runs.load_run(spark, args.run))
    exclusions, constant = _lists(spark, args)
    figures = numbers.all_numbers(run, corpora.registry(spark, args.registry), exclusions, constant is not None)
    if args.number is not None:
        figures = figures.filter(F.col("number") == args.number)
    if args.document:
        print(numbers.document(run, figures).first()[0])
    else:
        _print(figures.orderBy("number", "figure", "key"))
    return 0


def _disclosure(spark: SparkSession, args: argparse.Namespace) -> int:
    run = runs.load_run(spark, args.run)
    declared = corpora.declarations(spark, args.declared) if args.declared else None
    found = disclosure.check(run.flows, declared, _lists(spark, args)[0])
    for rows in (found.verdict, found.servers, found.launcher):
        _print(rows)
    return int(found.verdict.first()["verdict"] != disclosure.CLEAR)


def _control(spark: SparkSession, args: argparse.Namespace) -> int:
    subject = runs.load_run(spark, args.against)
    review = spark.createDataFrame([(h,) for h in args.host], "host string")
    found = control.compare(runs.load_run(spark, args.run).flows, subject.flows, args.server, review)
    for rows in (found.verdict, found.hosts, found.matching, found.carried):
        _print(rows)
    if args.publish:
        control.publishable(found, args.authorisation or "").write.json(args.publish)
    return 0


def _items(spark: SparkSession, path: str, purpose: str) -> DataFrame:
    rows = corpora.negative_corpus(spark, path, purpose)
    return rows.select("family", F.col("call_id").alias("item"), canonical_arguments(F.col("arguments")).alias("args"), F.encode("target", "UTF-8").alias("target"), F.encode("body", "UTF-8").alias("body"))


def _transfers(spark: SparkSession, path: str) -> DataFrame:
    rows = corpora.positive_corpus(spark, path)
    return rows.select(F.col("transfer_id").alias("transfer"), canonical_arguments(F.col("arguments")).alias("args"), F.encode("target", "UTF-8").alias("target"), "body", F.col("detectable_by_design").alias("detectable"), F.col("not_detectable_reason").alias("reason"))


def _ksweep(spark: SparkSession, args: argparse.Namespace) -> int:
    items = _items(spark, args.corpus, "calibration")
    for k in range(args.least, args.most + 1, args.step):
        _print(calibration.self_match_recall(items, k).filter("family IS NULL").withColumn("k", F.lit(k)))
        if args.transfers:
            _print(calibration.detection_recall(_transfers(spark, args.transfers), k).withColumn("k", F.lit(k)))
    return 0


def _rarity(spark: SparkSession, args: argparse.Namespace) -> int:
    files = corpora.background(spark, args.background, tuple(args.forbidden))
    frequency = matching.document_frequency(files, "path", "content", args.k)
    verdict = calibration.acceptance(_items(spark, args.held_out, "held_out"), frequency, args.k)
    _print(verdict)
    if args.calibration and args.transfers:
        ladder = calibration.sweep_mass(_items(spark, args.calibration, "calibration"), _transfers(spark, args.transfers), frequency, "calibration", args.k)
        _print(ladder.orderBy("min_mass"))
        _print(calibration.cheapest_clean(ladder))
    return int(verdict.first()["verdict"] != "kept")


def _inventory(spark: SparkSession, args: argparse.Namespace) -> int:
    _print(calibration.inventory(_items(spark, args.corpus, "calibration"), args.k))
    if args.context:
        _print(calibration.canaries(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(args.context), args.k))
    return 0


def _bench(spark: SparkSession, args: argparse.Namespace) -> int:
    plan, truth = (spark.read.schema(s).json(f"{args.run}/{name}.jsonl") if runs.exists(spark, f"{args.run}/{name}.jsonl") else spark.createDataFrame([], s) for name, s in (("bench_plan", PLAN), ("bench_truth", TRUTH)))
    found = bench.compute(plan, truth, runs.read_optional(spark, f"{args.run}/flows.jsonl", FLOWS))
    for rows in (found.capture, found.attribution, found.cells):
        _print(rows)
    return 0


def _backstop(spark: SparkSession, args: argparse.Namespace) -> int:
    _print(pcap.unobserved(pcap.syn_counts(spark, args.capture), runs.read_optional(spark, f"{args.run}/flows.jsonl", FLOWS)))
    _print(pcap.by_server(runs.read_optional(spark, f"{args.run}/calls.jsonl", CALLS), runs.read_optional(spark, f"{args.run}/flows.jsonl", FLOWS)))
    return 0


def _redact(spark: SparkSession, args: argparse.Namespace) -> int:
    got = redaction.redact(runs.load_run(spark, args.run), args.run_id, _lists(spark, args)[0])
    runs.write_records(got.calls, f"{args.out}/calls.jsonl", ["call_id"])
    runs.write_records(got.flows, f"{args.out}/flows.jsonl", ["ts"])
    spark.createDataFrame([(runs.write_manifest(got.manifest),)], "value string").coalesce(1).write.text(f"{args.out}/manifest.json")
    return 0


def _tokens(spark: SparkSession, args: argparse.Namespace) -> int:
    _print(tokens_of_request(spark.read.schema("id string, host string, target string, body string").json(args.requests), ["id"], "host", "target", "body"))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestrand", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, act, *options: tuple[str, dict], run: bool = True, lists: bool = False) -> None:
        p = commands.add_parser(name)
        p.set_defaults(act=act)
        if run:
            p.add_argument("--run", required=True)
        if lists:
            p.add_argument("--exclusions")
            p.add_argument("--constant-paths")
        for flag, how in options:
            p.add_argument(flag, **how)

    need, whole = {"required": True}, {"type": int, "default": matching.K}
    add("numbers", _numbers, ("--number", {"type": int}), ("--registry", {}), ("--document", {"action": "store_true"}), lists=True)
    add("disclosure", _disclosure, ("--declared", {}), lists=True)
    add("control", _control, ("--against", need), ("--server", need), ("--host", {"action": "append", "default": []}), ("--publish", {}), ("--authorisation", {}))
    add("ksweep", _ksweep, ("--corpus", need), ("--transfers", {}), ("--least", {"type": int, "default": 8}), ("--most", {"type": int, "default": 64}), ("--step", {"type": int, "default": 1}), run=False)
    add("rarity", _rarity, ("--background", need), ("--held-out", need), ("--calibration", {}), ("--transfers", {}), ("--forbidden", {"action": "append", "default": []}), ("--k", whole), run=False)
    add("inventory", _inventory, ("--corpus", need), ("--context", {}), ("--k", whole), run=False)
    add("bench", _bench)
    add("backstop", _backstop, ("--capture", need))
    add("redact", _redact, ("--run-id", need), ("--out", need), lists=True)
    add("tokens", _tokens, ("--requests", need), run=False)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.act(spark or SparkSession.builder.appName("lodestrand").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
