"""Chat formatting: an event log is folded into final messages, which are rendered with escaped control strings.

Everything is a window, an aggregate or an array function; no Python runs on the executors.

* An event is (conv_id, seq, message, kind, role, text). ``delta`` appends text to a message, ``edit`` replaces what the
  message held, ``regenerate`` discards the message and all later messages of its conversation, then starts it anew with
  its own text. Other kinds and null kinds count as ``delta``.
* Events are ordered by seq (null first), then role, then text, so ties have one result. A null role or text is empty.
  Events without a message are ignored. A null conv_id is a conversation of its own.
* The role of a message is that of its last event that is kept. A message whose events are all discarded is gone.
* Rows of one conversation meet in one task because its rendering is one value; its length is bounded by what a string
  can hold (2 GB), whatever the size of the corpus. Events are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    r"""``\`` becomes ``\\`` and ``<|`` becomes ``<\|``: no control string can be read inside."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_role(role: Column) -> Column:
    """As ``escaped``; line breaks get a backslash as well, since the first bare one ends the role."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def message_events(rows: DataFrame) -> DataFrame:
    """Finished messages (conv_id, turn, role, text) as a log with one delta for each of them."""
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    return rows.select("conv_id", number.cast("long").alias("seq"), number.cast("long").alias("message"), F.lit("delta").alias("kind"), "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the messages as they stand after the last event."""
    tie = [F.col("seq").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    in_order = Window.partitionBy("conv_id").orderBy(*tie)
    later = in_order.rowsBetween(1, Window.unboundedFollowing)
    # Regenerations that come later and start at this message or before it discard this event.
    restart = F.min(F.when(F.col("kind") == "regenerate", F.col("message"))).over(later)
    kept = (events.where(F.col("message").isNotNull()).withColumn("_n", F.row_number().over(in_order)).withColumn("_restart", restart)
            .where(F.col("_restart").isNull() | (F.col("_restart") > F.col("message"))))
    own = Window.partitionBy("conv_id", "message")
    kept = kept.withColumn("_edit", F.max(F.when(F.col("kind") == "edit", F.col("_n"))).over(own))
    kept = kept.where(F.col("_edit").isNull() | (F.col("_n") >= F.col("_edit")))
    parts = F.array_sort(F.collect_list(F.struct("_n", F.coalesce("text", F.lit("")).alias("text"))))
    return kept.groupBy("conv_id", "message").agg(
        F.coalesce(F.max_by("role", "_n"), F.lit("")).alias("role"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, segments, formatted); a segment is (text, loss), formatted is all of them joined.

    Only the text of ``trained_role`` lies under the loss; its header and end mark do not.
    """
    turn = F.struct("message", F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n")).alias("head"),
                    escaped(F.col("text")).alias("body"), (F.col("role") == trained_role).alias("loss"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        segment(t["head"], F.lit(False)), segment(t["body"], t["loss"]), segment(F.lit(END + "\n"), F.lit(False)))))
    return turns.select("conv_id", segments.alias("segments")).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold_events(events))


def parsed_turns(formatted: Column) -> Column:
    """The turns (role, text) that a rendering holds."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    tail = len(END) + 1
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: _turn(p, F.regexp_extract(p, r"^((?:[^\\\n]++|\\[\s\S])*+)\n", 1), tail))


def _turn(piece: Column, role: Column, tail: int) -> Column:
    head = F.length(role) + 1
    return F.struct(unescaped(role).alias("role"), unescaped(F.substr(piece, head + 1, F.length(piece) - head - tail)).alias("text"))


def loss_text(segments: Column) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def digests(chats: DataFrame) -> DataFrame:
    """What a reader of the renderings finds: turns, text under the loss, length."""
    turns = chats.select("conv_id", parsed_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
