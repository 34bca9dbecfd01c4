"""Chat rendering after collapsing cumulative snapshots.

Logs often keep a conversation again after each turn. Every turn gets rolling hashes of the turns up
to and with it; a conversation whose whole hash is among the proper prefixes of another is a snapshot
and goes (an anti-join), equal conversations are kept once, and the maximal ones are rendered.

Only DataFrame functions are used. Positions and hashes are running measures over slices of a
conversation, so one conversation with very many turns is spread over tasks; a rendered row holds at
most ``TURNS_PER_ROW`` turns, longer conversations go on in further rows (``part`` 0, 1, ...).

Defined cases: turns are ordered by turn, role and text, null first; repeated rows are turns of their
own. Rows with a null conv_id are one conversation with that id. A null role is rendered as
``unknown`` and a null text as empty, and compared so. Of equal conversations the smallest id stays
(null is smallest). An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.skew import block_of, running
from quarry.session import cut

TURNS_PER_ROW = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """conv (struct of the id), position, role, text, h1, h2 (of the turns so far), last."""
    rows = turns.select(F.struct(F.col(conv).alias("conv_id")).alias("conv"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = running(rows, ["conv"], ["turn", "role", "text"], block_of("turn"), position=("row_number", None))
    # a turn's hash has its place in it, so a sum of them tells orders apart
    hashes = {f"h{i}": ("sum", F.xxhash64(F.lit(i), "position", "role", "text").cast("decimal(20,0)")) for i in (1, 2)}
    rolled = running(placed, ["conv"], ["position"], block_of("position"), following=("lead", F.lit(1)), **hashes)
    return rolled.select("conv", "position", "role", "text", "h1", "h2", F.col("following").isNull().alias("last"))


def collapse(turns: DataFrame, **names: str) -> tuple[DataFrame, DataFrame]:
    """Maximal conversations (conv, n_turns, copies) and the turns of all (conv, position, role, text)."""
    rolled = cut(prefix_hashes(turns, **names), "chat-turns")
    whole = rolled.filter("last").groupBy("position", "h1", "h2").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies"))
    prefixes = rolled.filter("not last").select("position", "h1", "h2").distinct()
    maximal = whole.join(prefixes, ["position", "h1", "h2"], "left_anti")
    return (maximal.select("conv", F.col("position").alias("n_turns"), "copies"),
            rolled.select("conv", "position", "role", "text"))


def render(maximal: DataFrame, turns: DataFrame, per_row: int = TURNS_PER_ROW) -> DataFrame:
    """conv_id, part, n_turns, copies, text."""
    part = F.floor((F.col("position") - 1) / per_row)
    said = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE + "\n"))
    rows = turns.join(maximal, "conv").groupBy("conv", part.alias("part")).agg(
        F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"),
        F.sort_array(F.collect_list(F.struct("position", said.alias("said")))).alias("all"))
    return rows.select(F.col("conv.conv_id").alias("conv_id"), "part", "n_turns", "copies",
                       F.array_join(F.col("all.said"), "").alias("text"))
