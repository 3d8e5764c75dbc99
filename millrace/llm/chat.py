"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation gets a rendering of it in which that speaker is the assistant and all others are
users with their names; the mask holds the spans of the assistant's words. Rendered with DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import written

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Turns that a task renders at a time; any number gives the same rows.
BLOCK = 256


def _placed(rows: DataFrame) -> DataFrame:
    """rows (conv_id, said) with `place`, their number from 0 in the order of said within conv_id.

    Rows are dealt by ranges and written; places are counted within each range and moved on by the counts of those
    before, so that a conversation with a large share of all rows is numbered by many tasks.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("said.turn").asc_nulls_first(), "said.role", "said.text"]
    ranged = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "turns")
    inside = ranged.withColumn("place", F.row_number().over(Window.partitionBy("range", "conv_id").orderBy(*order[1:])) - 1)
    counts = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("conv_id").alias("of"), F.col("range").alias("r"), before.alias("before")).where("before > 0")
    placed = inside.join(counts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("range") == F.col("r")), "left")
    return placed.select("conv_id", "said", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"))


def perspectives(turns: DataFrame, part_turns: int | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, part, n_turns, text, spans: the dialogue as each participant sees it.

    spans are array<struct<start,end>> in characters of the text. The role "system" is rendered as it is and takes no
    perspective; a conversation with nobody else has no rows. Null role: "unknown"; null text: empty; null turns come
    first. Turns with one number are ordered by role, then text; repeated rows are rendered each time. A null conv_id is
    a conversation of its own. No rows in, no rows out; other columns are ignored.

    BLOCK turns at a time are rendered by one task; running sums over a dialogue's blocks move their spans to where the
    block stands. A dialogue of any length is one part, 0, whose text is one value; part_turns asks for parts of so many
    turns instead, each with spans in its own text, which joined in order are the whole.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("said"),
    )
    part = F.floor(F.col("place") / part_turns) if part_turns else F.lit(0)
    within = F.col("place") % part_turns if part_turns else F.col("place")
    rows = _placed(rows).select("conv_id", "said", part.cast("long").alias("part"), F.floor(within / BLOCK).cast("long").alias("block"))
    blocks = rows.groupBy("conv_id", "part", "block").agg(F.sort_array(F.collect_list("said")).alias("said"))
    speakers = rows.select("conv_id", F.col("said.role").alias("perspective")).where("perspective <> 'system'").distinct().withColumnRenamed("conv_id", "of")
    both = blocks.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    head = f"concat('{BEGIN}', CASE WHEN s.role = 'system' THEN 'system' WHEN s.role = perspective THEN 'assistant' ELSE concat('user name=', s.role) END, '\\n')"
    end = END.replace("\n", "\\n")
    lines = both.withColumn("lines", F.expr(f"transform(said, s -> struct({head} AS head, s.text AS text, s.role = perspective AS own))"))
    spans = F.expr(
        "aggregate(lines, named_struct('at', 0L, 'spans', CAST(array() AS array<struct<start:bigint,end:bigint>>)),"
        " (acc, l) -> named_struct("
        f"'at', acc.at + length(l.head) + length(l.text) + {len(END)},"
        " 'spans', CASE WHEN l.own THEN concat(acc.spans, array(named_struct('start', acc.at + length(l.head), 'end', acc.at + length(l.head) + length(l.text)))) ELSE acc.spans END),"
        " acc -> acc.spans)"
    )
    rendered = lines.select("conv_id", "perspective", "part", "block", F.size("said").cast("long").alias("n"), F.expr(f"array_join(transform(lines, l -> concat(l.head, l.text, '{end}')), '')").alias("text"), spans.alias("spans"))
    before = Window.partitionBy("conv_id", "perspective", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    moved = rendered.withColumn("at", F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0).cast("long")))
    moved = moved.withColumn("spans", F.expr("transform(spans, s -> struct(s.start + at AS start, s.end + at AS end))"))
    whole = moved.groupBy("conv_id", "perspective", "part").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("block", "text", "spans"))).alias("blocks"))
    return whole.select("conv_id", "perspective", "part", "n_turns", F.array_join("blocks.text", "").alias("text"), F.flatten("blocks.spans").alias("spans"))
