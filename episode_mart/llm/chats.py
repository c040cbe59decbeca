"""Chat formatting from an event log.

Events are (conv_id, turn, seq, kind, role, text). A ``message`` opens a message of its turn; a ``delta``
appends to the turn's latest message; an ``edit`` replaces its text, and a ``regenerate`` empties it (or
sets the text it brings), after which deltas stream in again. An edit or a regeneration also takes back
what later turns said before it. Messages are then rendered in turn order between control strings; the
same strings inside a text or role are escaped with a backslash, so the rendering can be read back.

Events meet in chunks of neighbouring turns first and only the rendered chunks of a conversation meet in
one row, the conversation's formatted text. All is SQL functions.

Defined cases: null texts and roles are empty; a null conversation id is a conversation of its own; null
turns come first; events of one turn and number are ordered by kind (message, edit, regenerate, delta),
role and text, so repeated rows stay and results do not depend on their order; a turn without a message
opens one with its first event; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episode_mart.llm.spans import let

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings of this template and of others that a trainer may read.
CONTROL = (START, SEP, END, "[INST]", "[/INST]", "<s>", "</s>")
LOSS_ROLE = "assistant"
TURNS_PER_CHUNK = 32
KINDS = ("message", "edit", "regenerate", "delta")
_LEAST = -(1 << 62)


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    for c in CONTROL:
        text = F.replace(text, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _folded(events: Column) -> Column:
    """Messages (role, text) of sorted events of some turns."""
    def opens(e: Column, i: Column) -> Column:
        return (e["kind"] == 0) | (i == 0) | (F.get(events, i - 1)["turn"] != e["turn"])

    def fold(own: Column) -> Column:
        last = F.array_max(F.transform(own, lambda e, i: F.when(e["kind"] < 3, i).otherwise(0)))
        role = F.get(F.filter(own, lambda e: e["role"] != ""), F.lit(0))["role"]
        return let(last, lambda at: F.struct(
            F.coalesce(role, F.lit("")).alias("role"),
            F.array_join(F.transform(F.slice(own, at + 1, F.size(own)), lambda e: e["text"]), "").alias("text")))

    def messages(starts: Column) -> Column:
        return F.transform(starts, lambda s, i: let(
            F.slice(events, s + 1, F.coalesce(F.get(starts, i + 1), F.size(events)) - s), fold))

    numbered = F.transform(events, lambda e, i: F.when(opens(e, i), i))
    return let(F.filter(numbered, lambda i: i.isNotNull()), messages)


def render(events: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss, which alternates characters to skip and to learn.

    ``loss`` covers the (escaped) texts of LOSS_ROLE, once each and in order.
    """
    kind = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for n, k in enumerate(KINDS)],
                      F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null")))))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(_LEAST))
    rows = events.select(
        "conv_id", turn.alias("turn"),
        F.struct(turn.alias("turn"), F.coalesce(F.col("seq").cast("long"), F.lit(_LEAST)).alias("seq"),
                 kind.cast("int").alias("kind"), F.coalesce("role", F.lit("")).alias("role"),
                 F.coalesce("text", F.lit("")).alias("text")).alias("event"))
    taken_back = (events.where(F.col("kind").isin("edit", "regenerate"))
                  .groupBy("conv_id", turn.alias("turn")).agg(F.max(F.col("seq").cast("long")).alias("seq"))
                  .groupBy(F.col("conv_id").alias("_conv")).agg(F.collect_list(F.struct("turn", "seq")).alias("cuts")))
    # a conversation's share of the hash, then its chunks: neighbouring turns meet in one row
    chunks = rows.groupBy("conv_id", F.floor(F.col("turn") / TURNS_PER_CHUNK).alias("chunk")).agg(
        F.collect_list("event").alias("events"))
    alive = F.when(F.col("cuts").isNull(), F.col("events")).otherwise(F.filter("events", lambda e: ~F.exists(
        F.col("cuts"), lambda c: (c["turn"] < e["turn"]) & (c["seq"] > e["seq"]))))
    chunks = (chunks.join(taken_back, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
              .select("conv_id", "chunk", let(F.array_sort(alive), _folded).alias("messages")))
    parts = F.transform("messages", lambda m: F.struct(
        F.concat(F.lit(START), escape(m["role"]), F.lit(SEP)).alias("head"), escape(m["text"]).alias("body"),
        F.lit(f"{END}\n").alias("tail"), (m["role"] == LOSS_ROLE).alias("learn")))
    pieces = chunks.select("conv_id", "chunk", parts.alias("parts")).select(
        "conv_id",
        F.struct("chunk", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
                 .alias("formatted"),
                 F.flatten(F.transform("parts", lambda p: F.when(p["learn"], F.array(
                     F.length(p["head"]), F.length(p["body"]), F.length(p["tail"]), F.lit(0))).otherwise(F.array(
                         F.length(F.concat(p["head"], p["body"], p["tail"])), F.lit(0))))).alias("loss")).alias("piece"))
    return pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces")).select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["formatted"]), "").alias("formatted"),
        F.flatten(F.transform("pieces", lambda p: p["loss"])).alias("loss"))


def read_back(formatted: Column) -> Column:
    """Messages (role, text) of a formatted conversation."""
    parts = F.split(formatted, F.lit(r"\Q" + START + r"\E"))
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(
        unescape(F.substring_index(p, SEP, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, SEP, -1), END, 1)).alias("text")))
