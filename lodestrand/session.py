"""What a session needs before Python code of this package runs on its workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> None:
    """Let workers on this machine import the package; a cluster ships it (--py-files) instead."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


_own_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it.

    Where the session names none, a temporary folder of our own, which goes at exit; but only if all runs
    on this machine, as executors elsewhere would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        if not _own_root:
            _own_root.append("file://" + tempfile.mkdtemp(prefix="lodestrand-"))
            atexit.register(shutil.rmtree, _own_root[0].removeprefix("file://"), ignore_errors=True)
        root = _own_root[0]
    return root.rstrip("/")
