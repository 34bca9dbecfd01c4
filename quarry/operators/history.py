"""Conversation memory. A conversation may be very long, so positions come from ``running`` and
look-back windows run on blocks of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import constants as C
from quarry.functions.text import has_text, order_id, strip
from quarry.operators.skew import block_of, halo, running, topk

KEYS = ["user_id", "conversation_id"]


def _named(turns: DataFrame) -> DataFrame:
    """Turns of a named conversation; blank ids carry no history."""
    return (turns.filter(has_text("conversation_id"))
            .withColumn("conversation_id", strip("conversation_id")))


def recent_turns(turns: DataFrame, n: int = C.HISTORY_TURNS) -> DataFrame:
    """Last n turns of each conversation: user_id, conversation_id, seq and the messages."""
    return topk(_named(turns), KEYS, [F.desc("seq")], n, "back")


def render_turn(user: str = "user_message", assistant: str = "assistant_message") -> Column:
    """One line per speaker, blank messages left out."""
    def line(label, message):
        return F.when(has_text(message), F.concat(F.lit(label), F.col(message), F.lit("\n")))

    return F.concat(F.coalesce(line(C.USER_LABEL, user), F.lit("")),
                    F.coalesce(line(C.ASSISTANT_LABEL, assistant), F.lit("")))


def history_at_turn(turns: DataFrame, n: int = C.HISTORY_TURNS, block: int = 4096) -> DataFrame:
    """Adds ``history``: the n turns before each turn, rendered, oldest first."""
    numbered = running(_named(turns), KEYS, ["seq"], block_of("seq", block),
                       position=("row_number", None))
    blocks = halo(numbered.withColumn("__line", render_turn()), "position", n, block)
    before = (Window.partitionBy(*KEYS, "__block").orderBy("position").rowsBetween(-n, -1))
    lines = F.array_join(F.collect_list("__line").over(before), "")
    return (blocks.withColumn("history", lines).filter("NOT __halo")
            .drop("__line", "__block", "__halo", "position"))


def compression_schedule(turns: DataFrame, keep: int = C.HISTORY_TURNS,
                         threshold: int = C.SUMMARY_THRESHOLD, block: int = 4096) -> DataFrame:
    """Adds per turn: ``retained`` turns after it, ``compressed`` (did this turn trigger it) and
    ``summaries`` so far, when every summary succeeds."""
    keep = max(1, keep)
    threshold = max(keep, threshold)
    period = threshold - keep + 1
    over = F.col("position") - threshold - 1
    numbered = running(_named(turns), KEYS, ["seq"], block_of("seq", block),
                       position=("row_number", None))
    return (numbered
            .withColumn("retained", F.when(over < 0, F.col("position")).otherwise(
                keep + F.pmod(over, F.lit(period))).cast("int"))
            .withColumn("compressed", (over >= 0) & (F.pmod(over, F.lit(period)) == 0))
            .withColumn("summaries", F.when(over < 0, 0).otherwise(
                F.floor(over / period) + 1).cast("int")))


def truncate_chat(messages: DataFrame, n: int = C.CHAT_MESSAGES,
                  key: str = "conversation_id") -> DataFrame:
    """Last n messages of each conversation."""
    return topk(messages, [key], [F.desc("seq")], n, "back")


def carry_entity(events: DataFrame, block: int = 4096) -> DataFrame:
    """Adds ``current_order_id``: the last order-like id seen in a user message or a successful tool
    result of the conversation, up to and including this event.

    ``events``: user_id, conversation_id, seq, kind (USER or TOOL), text, success.
    """
    stated = F.when(F.col("kind") == "USER", order_id("text"))
    returned = F.when((F.col("kind") == "TOOL") & F.col("success"),
                      F.get_json_object("text", "$.orderId"))
    found = events.withColumn("__found", F.coalesce(stated, returned))
    return running(found, KEYS, ["seq"], block_of("seq", block),
                   current_order_id=("last", "__found")).drop("__found")
