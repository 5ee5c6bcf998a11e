"""Chat formatting from an event log, in DataFrame functions alone.

The log is dealt by conversation and sorted by sequence number; streamed deltas, edits and regenerations are folded
into final messages; a template renders them. What is inside a text can never look like the template's marks: control
strings get a backslash after their first character, and reading back takes it away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: How a control string goes on after its first character: "<|...", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>".
_REST = r"(\||/?s>|/?INST\]|</?SYS>>)"
_ESCAPE, _UNESCAPE = rf"([<\[])(\\*){_REST}", rf"([<\[])\\(\\*){_REST}"
#: Turns whose texts are put together before those of a whole conversation are.
BLOCK = 64

MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"


def escaped(text: Column) -> Column:
    """``text`` with its control strings broken; ``unescaped`` restores it exactly."""
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, seq, n, role, text) of a log (conv_id, seq, turn, kind, role, text).

    Within a turn, by ``seq``: a ``message`` opens a new message; a ``delta`` appends to the one open; an ``edit`` or a
    ``regenerate`` replaces its text; a ``regenerate`` also takes back the later turns logged before it. What comes
    before any message of its turn opens one. ``n`` numbers a turn's messages. A null text or role is empty, a null
    kind is a message; null turns and sequence numbers come first; rows alike in all columns are messages of their
    own. Columns beyond these are left out. An empty log gives no message.
    """
    log = events.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("seq").cast("long").alias("seq"),
        F.coalesce(F.col("kind"), F.lit(MESSAGE)).alias("kind"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    in_turn = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    log = log.withColumn("n", F.greatest(F.lit(1), F.count(F.when(F.col("kind") == MESSAGE, 1)).over(in_turn)))
    resets = F.col("kind") != DELTA
    parts = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    folded = log.groupBy("conv_id", "turn", "n").agg(parts.alias("parts"), F.max(F.when(resets, F.struct("seq", "kind", "role", "text"))).alias("reset"), F.min("seq").alias("seq"))
    last = F.col("reset")
    tail = F.filter("parts", lambda p: (p["kind"] == DELTA) & (last.isNull() | (F.struct(p["seq"], p["kind"], p["role"], p["text"]) > last) | (p["seq"] > last["seq"])))
    text = F.concat(F.coalesce(last["text"], F.lit("")), F.array_join(F.transform(tail, lambda p: p["text"]), ""))
    messages = folded.select("conv_id", "turn", "seq", "n", F.element_at("parts", 1)["role"].alias("role"), text.alias("text"))
    # what a message has to look at: the last regeneration logged of all blocks of turns before its own, and those of the
    # turns of its own block; a block has a bounded number of turns
    block = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK)
    regenerated = F.when(F.col("kind") == REGENERATE, F.col("seq"))
    turns = log.groupBy("conv_id", block.alias("block"), "turn").agg(F.max(regenerated).alias("cut"))
    blocks = turns.groupBy("conv_id", "block").agg(F.max("cut").alias("last"), F.collect_list(F.when(F.col("cut").isNotNull(), F.struct("turn", "cut"))).alias("cuts"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = blocks.withColumn("before", F.max("last").over(earlier)).where("before IS NOT NULL OR size(cuts) > 0")
    mine = messages.withColumn("block", block).alias("m")
    same = F.col("c.conv_id").eqNullSafe(F.col("m.conv_id")) & (F.col("c.block") == F.col("m.block"))
    near = F.exists("c.cuts", lambda c: (c["turn"] < F.col("m.turn")) & (c["cut"] > F.col("m.seq")))
    taken_back = F.coalesce(F.col("c.before") > F.col("m.seq"), F.lit(False)) | F.coalesce(near, F.lit(False))
    return mine.join(blocks.alias("c"), same, "left").where(~taken_back).select(*[F.col(f"m.{c}") for c in messages.columns])


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row for each conversation: conv_id, ``formatted`` and its loss mask ``loss``.

    A turn is OPEN, its role, a line break, its text, CLOSE. ``loss`` has for every turn of a role in ``learn`` the
    turn's index and the code points, counted from its OPEN, where its text starts and ends. Turns go by ``turn``,
    ``seq`` and ``n``; they are joined in blocks first, so that a long conversation's work is spread. No message gives no
    row; texts and roles are not null, as ``fold_events`` gives them.
    """
    role = F.regexp_replace(F.regexp_replace(escaped(F.col("role")), r"\\", r"\\\\"), "\n", r"\\n")
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    body = escaped(F.col("text"))
    loss = F.when(F.col("role").isin(*learn), F.struct(F.length(head).alias("start"), (F.length(head) + F.length(body)).alias("end")))
    rows = messages.select("conv_id", "turn", "seq", "n", F.concat(head, body, F.lit(CLOSE)).alias("piece"), loss.alias("loss"))
    block = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK)
    sorted_rows = F.array_sort(F.collect_list(F.struct("turn", "seq", "n", "piece", "loss")))
    blocks = rows.groupBy("conv_id", block.alias("block")).agg(sorted_rows.alias("rows"))
    blocks = blocks.select("conv_id", "block", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("text"), F.transform("rows", lambda r: r["loss"]).alias("loss"))
    whole = blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "text", "loss"))).alias("blocks"))
    spans = F.flatten(F.transform("blocks", lambda b: b["loss"]))
    spans = F.transform(spans, lambda s, i: F.when(s.isNotNull(), F.struct(i.alias("turn"), s["start"].alias("start"), s["end"].alias("end"))))
    return whole.select("conv_id", F.array_join(F.transform("blocks", lambda b: b["text"]), "").alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss"))


def format_events(events: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``fold_events`` and then ``render``."""
    return render(fold_events(events), learn)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, ``turns`` (role and text of each, unescaped) and ``learnt`` (the texts under the loss mask, unescaped).

    Everything comes from ``formatted`` and ``loss`` as ``render`` gives them; a conversation without turns has none, a
    null ``formatted`` gives nulls, an empty table an empty one.
    """
    pieces = F.split(F.col("formatted"), r"<\|end\|>\n", -1)
    rows = formatted.select("conv_id", F.slice(pieces, 1, F.size(pieces) - 1).alias("pieces"), "loss")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        role = F.substr(head, F.lit(len(OPEN) + 1))
        role = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
        role = unescaped(F.regexp_replace(role, r"\\\\", r"\\"))
        return F.struct(role.alias("role"), unescaped(F.substr(piece, F.length(head) + 2)).alias("text"))

    def learnt(s: Column) -> Column:
        return unescaped(F.substring(F.element_at("pieces", s["turn"] + 1), s["start"] + 1, s["end"] - s["start"]))

    return rows.select("conv_id", F.transform("pieces", turn).alias("turns"), F.transform("loss", learnt).alias("learnt"))
