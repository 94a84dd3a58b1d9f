"""Chat formatting, relational: sorted turn structs, merged same-role blocks, one string per conversation.

A conversation becomes ``<|im_start|>role\\ntext<|im_end|>\\n`` per block, where a block holds adjacent
turns of one role, their texts parted by ``<|im_sep|>``.  Inside roles and texts ``&`` is written ``&amp;`` and
``<|`` is written ``&lt;|`` (in roles also a line break, ``&#10;``), so no text can forge a mark and
``read_turns`` gives back exactly the rows that went in.  The loss mask is a list of spans (code points,
end exclusive) that cover the texts of the trained role and nothing between them.

Turns are collected in slices of the turn number first and the slices' strings are then joined, so a very long
conversation is formatted by many tasks; only finished strings meet in the row that the result asks for.

Defined results: a null role or text counts as empty; turns are ordered by (turn, role, text), a null turn first,
repeated rows stay repeated; a null conversation id is a conversation of its own; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled, let, running_sums

SLICE = 256
OPEN, CLOSE, PART = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def _between(before: Column, after: Column) -> Column:
    """What stands between a turn of role ``before`` and one of role ``after`` (roles escaped)."""
    return F.when(before == after, F.lit(PART)).otherwise(F.concat(F.lit(CLOSE + OPEN), after, F.lit("\n")))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)


def format_conversations(turns: DataFrame, loss_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text", slice_turns: int = SLICE) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans array<struct<start, end>> (in order)."""
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.floor(F.col(turn_col) / slice_turns).alias("slice"),
        F.struct(F.col(turn_col).alias("turn"), escape_role(filled(role_col)).alias("role"),
                 escape(filled(text_col)).alias("text")).alias("t"))
    slices = rows.groupBy("conv", "slice").agg(F.collect_list("t").alias("ts")).select(
        "conv", _slice(F.col("slice"), F.col("ts"), loss_role).alias("s"))
    out = slices.groupBy("conv").agg(F.collect_list("s").alias("ss")).select("conv", _conversation(F.col("ss")).alias("c"))
    return out.select(F.col("conv").alias(conv_col), "c.formatted", "c.loss_spans")


def _slice(number: Column, turns: Column, loss_role: str) -> Column:
    """struct<slice, first, last, body, size, spans> of turns in any order: its text without what leads into it, and its spans.

    Every array is built once (``let``) and walked once, so the work is near linear in the turns.
    """
    def led(ts: Column) -> Column:
        # Each turn with what leads into it (merged into the block of the turn before when the roles are the same).
        return F.transform(ts, lambda t, i: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.when(i == 0, F.lit("")).otherwise(
            _between(F.get(ts, i - 1)["role"], t["role"])).alias("lead")))

    def built(ts: Column) -> Column:
        sizes = F.transform(ts, lambda t: (F.length(t["lead"]) + F.length(t["text"])).cast("bigint"))
        return let(sizes, lambda size: let(running_sums(size), lambda before: F.struct(
            number.alias("slice"), F.get(ts, F.lit(0))["role"].alias("first"), F.element_at(ts, -1)["role"].alias("last"),
            F.array_join(F.transform(ts, lambda t: F.concat(t["lead"], t["text"])), "").alias("body"), _total(size).alias("size"),
            F.filter(F.transform(ts, lambda t, i: F.struct(
                (F.get(before, i) + F.length(t["lead"])).alias("start"), (F.get(before, i) + F.get(size, i)).alias("end"),
                t["role"].alias("role"))), lambda x: x["role"] == escape_role(F.lit(loss_role))).alias("spans"))))

    return let(F.sort_array(turns), lambda ts: let(led(ts), built))


def _conversation(slices: Column) -> Column:
    """struct<formatted, loss_spans> of slices in any order."""
    def built(ss: Column) -> Column:
        leads = F.transform(ss, lambda s, i: F.when(i == 0, F.concat(F.lit(OPEN), s["first"], F.lit("\n"))).otherwise(
            _between(F.get(ss, i - 1)["last"], s["first"])))
        return let(leads, lambda lead: let(running_sums(F.transform(ss, lambda s, i: s["size"] + F.length(F.get(lead, i)))),
                                           lambda before: F.struct(
            F.concat(F.array_join(F.transform(ss, lambda s, i: F.concat(F.get(lead, i), s["body"])), ""), F.lit(CLOSE)).alias("formatted"),
            F.flatten(F.transform(ss, lambda s, i: let(F.get(before, i) + F.length(F.get(lead, i)), lambda at: F.transform(
                s["spans"], lambda p: F.struct((p["start"] + at).alias("start"), (p["end"] + at).alias("end")))))).alias("loss_spans"))))

    return let(F.sort_array(slices), built)


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    blocks = F.split(F.substr(formatted, F.lit(len(OPEN) + 1)), r"<\|im_start\|>")
    return F.flatten(F.transform(blocks, lambda b: let(
        F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
                 F.split(F.replace(F.substr(b, F.instr(b, "\n") + 1), F.lit(CLOSE), F.lit("")),
                         r"<\|im_sep\|>").alias("texts")),
        lambda x: F.transform(x["texts"], lambda t: F.struct(x["role"].alias("role"), unescape(t).alias("text"))))))


def read_loss(formatted: Column, spans: Column, group: int = SLICE) -> Column:
    """The unescaped text under the loss spans, joined.  Spans are cut out of pieces of ``group`` spans,
    so that a long string is not walked from its start for every span."""
    starts = F.when(F.size(spans) > 0, F.sequence(F.lit(1), F.size(spans), F.lit(group))).otherwise(
        F.array().cast("array<int>"))

    def piece(first: Column) -> Column:
        own = F.slice(spans, first, F.lit(group))
        return let(own, lambda s: let(
            F.struct(F.get(s, F.lit(0))["start"].alias("at"), F.substr(
                formatted, (F.get(s, F.lit(0))["start"] + 1).cast("int"),
                (F.element_at(s, -1)["end"] - F.get(s, F.lit(0))["start"]).cast("int")).alias("text")),
            lambda x: F.array_join(F.transform(s, lambda p: unescape(F.substr(
                x["text"], (p["start"] - x["at"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")))), "")))

    return F.array_join(F.transform(starts, piece), "")


def chat_report(turns: DataFrame) -> DataFrame:
    """Digests read back from the formatted output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    out = format_conversations(turns).withColumn("turns", read_turns(F.col("formatted"))) \
        .withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    return out.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
               256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
