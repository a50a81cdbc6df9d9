"""What is in flight, as a stream: keyed state, one set of calls for each key.

A change of state replaces the set of its key with the list of calls that it publishes, all of a wave at once;
a phase in which no call can run empties it, and a flow is given the set as it is. A flow after `drained` so belongs
to no call; it is kept, not dropped, and no watermark decides about it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrand.session import importable, scratch_root

OUTPUT = "event_id long, key string, in_flight array<string>"
STATE = "known boolean, phase string, active array<string>"
#: The phase in which calls run (fixed value of the records).
DRIVING = "driving"


def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The rows of one key in a micro-batch, in time, against the set that the batches before left."""
    known, phase, active = state.get if state.exists else (False, "", None)
    rows = pd.concat(list(batches), ignore_index=True)
    # At one time a state comes before a flow, and of states the last one holds.
    rows["flow"] = rows.phase.isna()
    rows = rows.sort_values(["ts", "flow", "event_id"], kind="stable")
    out = []
    for event, kind, calls in zip(rows.event_id.tolist(), rows.phase.tolist(), rows.active.tolist(), strict=True):
        if kind is None or kind != kind:
            out.append((event, key[0], list(active) if known else None))
        else:
            known, phase = True, kind
            active = list(calls) if phase == DRIVING and calls is not None else []
    state.update((known, phase, list(active) if active is not None else []))
    yield pd.DataFrame(out, columns=["event_id", "key", "in_flight"])


def in_flight(events: DataFrame) -> DataFrame:
    """The flows of a stream of (event_id, ts, key, phase, active), each with the calls in flight.

    A row with a phase is a change of state, one without is a flow. Before any state nothing is known: null.
    """
    importable(events.sparkSession)
    used = events.select("event_id", "ts", F.col("key").cast("string").alias("key"), "phase", "active")
    return used.groupBy("key").applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, path: str, as_log: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stored table through the stream once and return what it wrote. as_log: from its rows to those of `in_flight`."""
    schema = spark.read.parquet(path).schema
    root = f"{scratch_root(spark)}/lodestrand/stream-{uuid.uuid4().hex}"
    # A stream reads folders and patterns; the last letter as a class makes a pattern of a single file.
    source = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    writer = in_flight(as_log(source)).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{root}/out")
