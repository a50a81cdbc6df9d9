"""Chat formatting for preference training: shared prompt, paired completions, loss masks.

Two conversations of a pair agree up to some turn. That longest common prefix of turns is rendered
once, as the prompt; what follows in each is its completion. `segments` has a row a turn; `pairs` joins them to a
row a pair, and to further rows where a part has more than TURNS_A_ROW turns, so that every pair is there and no
row grows with a conversation. Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: How a turn is written (fixed values of the chat format).
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Turns of a part that are joined in one row.
TURNS_A_ROW = 64


def pairs_by_parity(conv_id: Column) -> tuple[Column, Column]:
    """(pair_id, side): conversations 2k and 2k + 1 are the chosen and rejected of pair k.

    A convention for tables without a column of pairs.
    """
    side = F.when(F.pmod(conv_id, F.lit(2)) == 0, "chosen").otherwise("rejected")
    return F.floor(conv_id / 2).cast("long").alias("pair_id"), side.alias("side")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def numbered(turns: DataFrame) -> DataFrame:
    """Add `position`, from 0, to turns (pair_id, side, turn, role, text): their place in their conversation.

    By turn (null first), then by digest, which settles turns of equal number. The table is sorted in
    ranges, so that a conversation of any length is spread over tasks; what of it lies in earlier ranges
    is added from a table of at most a row a range.
    """
    digest = F.md5(F.concat("role", F.lit("\n"), "text")).alias("digest")
    order = ["pair_id", "side", "turn", "digest", "role", "uid"]
    # Ids are made once and read from the written table, so that a repeated task sees the same ones.
    stored = materialise(turns.select("*", digest, F.monotonically_increasing_id().alias("uid")), "turns")
    dealt = stored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id())
    dealt = materialise(dealt.drop("uid"), "ordered-turns").withColumn("range", F.shiftright("ord", 33))
    spans = dealt.groupBy("pair_id", "side", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("pair_id", "side").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first conversation of a range can have begun in an earlier one.
    before = spans.withColumn("before", F.sum("n").over(earlier)).filter("before IS NOT NULL").drop("n")
    within = Window.partitionBy("pair_id", "side", "range").orderBy("ord")
    placed = dealt.withColumn("place", F.row_number().over(within)).join(F.broadcast(before), ["pair_id", "side", "range"], "left")
    position = F.col("place") - 1 + F.coalesce("before", F.lit(0))
    return placed.withColumn("position", position.cast("long")).drop("ord", "range", "place", "before")


def segments(conversations: DataFrame, pairs: DataFrame | None = None, trained_role: str = "assistant") -> DataFrame:
    """pair_id, part (prompt, chosen, rejected), position, turn, role, rendered, loss_start, loss_end.

    conversations: conv_id, turn, role, text; pairs: conv_id, pair_id, side, or None for `pairs_by_parity`.
    Null roles and texts count as empty; a null turn comes before all others; rows without a conv_id belong to
    no pair. Turns are numbered by position in their conversation, whatever their numbers are, and repeated
    rows are turns of their own. Those at one position are shared if both sides have one there, equal in
    role and text, and so is every position before: they are the prompt, which appears once. `position`
    counts from 0 within the part. A pair of which one side is missing has an empty prompt. Of a
    completion's turns by `trained_role`, the characters loss_start to loss_end of `rendered` (text and
    end mark) are trained on; all others, and the prompt, have 0 and 0.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).filter(F.col("conv_id").isNotNull())
    if pairs is None:
        turns = turns.select(*pairs_by_parity(F.col("conv_id")), "turn", "role", "text")
    else:
        turns = turns.join(pairs.select("conv_id", "pair_id", "side"), "conv_id").drop("conv_id")
    turns = numbered(turns)

    def said(side: str, what: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.struct("digest", "role"))).alias(what)

    aligned = turns.groupBy("pair_id", "position").agg(said("chosen", "a"), said("rejected", "b"))
    differs = F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("position"))
    first = aligned.groupBy("pair_id").agg(F.min(differs).alias("first"))
    turns = turns.join(first, "pair_id")
    shared = F.col("first").isNull() | (F.col("position") < F.col("first"))
    turns = turns.filter(~shared | (F.col("side") == "chosen"))
    rendered = render_turn(F.col("role"), F.col("text"))
    trained = ~shared & (F.col("role") == trained_role)
    head = F.char_length("role") + len(OPEN) + 1
    return turns.select(
        "pair_id",
        F.when(shared, "prompt").otherwise(F.col("side")).alias("part"),
        F.when(shared, F.col("position")).otherwise(F.col("position") - F.col("first")).alias("position"),
        "turn",
        "role",
        rendered.alias("rendered"),
        F.when(trained, head).otherwise(0).cast("long").alias("loss_start"),
        F.when(trained, F.char_length(rendered) - 1).otherwise(0).cast("long").alias("loss_end"),
    )


def pairs(rendered: DataFrame, turns_a_row: int = TURNS_A_ROW) -> DataFrame:
    """pair_id, chunk, prompt, chosen, rejected, chosen_loss, rejected_loss: every pair of `segments`.

    chunk is 0 for the first `turns_a_row` turns of each part, which are all of most pairs; longer parts go
    on in the rows of chunk 1, 2 and so on, to be joined in this order. The loss spans, (start, end) in characters,
    are those of the row's own completion. A part without turns is an empty text.
    """
    row = F.struct("position", "rendered", "loss_start", "loss_end")

    def rows(part: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("part") == part, row)))

    chunk = F.floor(F.col("position") / turns_a_row).cast("long").alias("chunk")
    grouped = rendered.groupBy("pair_id", chunk).agg(rows("prompt").alias("p"), rows("chosen").alias("c"), rows("rejected").alias("r"))

    def text(name: str) -> Column:
        return F.array_join(F.col(f"{name}.rendered"), "")

    def spans(name: str) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

        def add(acc: Column, x: Column) -> Column:
            span = F.struct((acc["at"] + x["loss_start"]).alias("start"), (acc["at"] + x["loss_end"]).alias("end"))
            more = F.when(x["loss_end"] > 0, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
            return F.struct((acc["at"] + F.char_length(x["rendered"])).alias("at"), more.alias("spans"))

        return F.aggregate(F.col(name), start, add, lambda acc: acc["spans"])

    return grouped.select("pair_id", "chunk", text("p").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"), spans("c").alias("chosen_loss"), spans("r").alias("rejected_loss"))


def report(paired: DataFrame) -> DataFrame:
    """The rows of `pairs` with their loss spans as text, start:end joined by commas."""

    def written(name: str) -> Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(name)

    return paired.select("pair_id", "chunk", "prompt", "chosen", "rejected", written("chosen_loss"), written("rejected_loss"))


ORACLE = f"""
WITH t AS (
  SELECT turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id,
         CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, md5(role || chr(10) || text), role) - 1 AS position FROM t
), a AS (
  SELECT coalesce(x.pair_id, y.pair_id) AS pair_id, min(coalesce(x.position, y.position)) AS first
  FROM (SELECT * FROM n WHERE side = 'chosen') x
  FULL JOIN (SELECT * FROM n WHERE side = 'rejected') y ON x.pair_id = y.pair_id AND x.position = y.position
  WHERE x.role IS DISTINCT FROM y.role OR x.text IS DISTINCT FROM y.text GROUP BY 1
), s AS (
  SELECT n.pair_id, CASE WHEN a.first IS NULL OR position < a.first THEN 'prompt' ELSE side END AS part,
         CASE WHEN a.first IS NULL OR position < a.first THEN position ELSE position - a.first END AS position,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered, length(role) AS head, side, role
  FROM n LEFT JOIN a ON n.pair_id = a.pair_id
), c AS (
  SELECT *, position // {TURNS_A_ROW} AS chunk,
         sum(length(rendered)) OVER (PARTITION BY pair_id, part, position // {TURNS_A_ROW} ORDER BY position) - length(rendered) AS ahead
  FROM s WHERE part <> 'prompt' OR side = 'chosen'
)
SELECT pair_id, CAST(chunk AS BIGINT) AS chunk,
       coalesce(string_agg(rendered, '' ORDER BY position) FILTER (WHERE part = 'prompt'), '') AS prompt,
       coalesce(string_agg(rendered, '' ORDER BY position) FILTER (WHERE part = 'chosen'), '') AS chosen,
       coalesce(string_agg(rendered, '' ORDER BY position) FILTER (WHERE part = 'rejected'), '') AS rejected,
       coalesce(string_agg(CAST(ahead + head + 13 AS BIGINT) || ':' || CAST(ahead + length(rendered) - 1 AS BIGINT), ',' ORDER BY position) FILTER (WHERE part = 'chosen' AND role = 'assistant'), '') AS chosen_loss,
       coalesce(string_agg(CAST(ahead + head + 13 AS BIGINT) || ':' || CAST(ahead + length(rendered) - 1 AS BIGINT), ',' ORDER BY position) FILTER (WHERE part = 'rejected' AND role = 'assistant'), '') AS rejected_loss
FROM c GROUP BY 1, 2
"""
