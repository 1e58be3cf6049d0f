"""Chat formatting as a relational job: Spark expressions only.

Turns are collected as structs per (conversation, run of ``chunk`` turn numbers),
sorted and merged with array aggregation, so the quadratic cost of appending in
an aggregation is bounded by the chunk; the chunks of a conversation, already
formatted, are then joined. Adjacent turns of one role share a block and are
parted by a boundary mark, so no turn is lost by merging:

    <|im_start|>role\\n text [<|im_next|> text ...] <|im_end|>\\n

Backslashes and ``<|`` inside texts and roles are escaped (``\\\\`` and ``<\\|``),
line feeds in roles as ``\\n``; the marks can therefore only come from the template and
``read_back`` restores roles and texts exactly. The loss mask is a list of
segments: ``segments`` holds the formatted text in pieces, each flagged.

Defined cases: null text or role is empty; turns are ordered by (turn, role,
text), null turns first; repeated rows stay separate turns; a null ``conv_id`` is
one conversation of its own; an empty table gives no rows; other columns are
ignored. One conversation is one output row, so its text must fit a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\", -1)  # pieces between escaped backslashes
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")),
                                                               F.lit("<\\|"), F.lit("<|"))), "\\")


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def format_conversations(rows: DataFrame, loss_role: str = "assistant", chunk: int = 64,
                         conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """(conv_id, segments array<struct<text, loss>>), one row per conversation."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chunks = (rows.select(F.col(conv_col).alias("conv_id"), F.floor(F.col(turn_col) / chunk).alias("part"), turn.alias("t"))
              .groupBy("conv_id", "part")
              .agg(F.sort_array(F.collect_list("t")).alias("turns")))
    block = "array<struct<role:string,texts:array<string>>>"

    def merge(acc: Column, t: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        fresh = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        return (F.when(F.size(acc) == 0, F.array(fresh))
                .when(last["role"] == t["role"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown)))
                .otherwise(F.concat(acc, F.array(fresh))))

    blocks = chunks.select("conv_id", "part", F.aggregate("turns", F.array().cast(block), merge).alias("blocks"))
    off = F.lit(False)

    def body(b: Column) -> Column:
        """A block's texts with boundary marks between them."""
        return F.flatten(F.transform(b["texts"], lambda x, i: F.when(
            i == 0, F.array(_segment(escape(x), b["role"] == loss_role))).otherwise(
            F.array(_segment(F.lit(NEXT), off), _segment(escape(x), b["role"] == loss_role)))))

    def opened(role: Column) -> Column:
        return _segment(F.concat(F.lit(START), escape_role(role), F.lit("\n")), off)

    inner = F.flatten(F.transform("blocks", lambda b, i: F.when(i == 0, body(b)).otherwise(
        F.concat(F.array(_segment(F.lit(END), off), opened(b["role"])), body(b)))))
    formatted = blocks.select("conv_id", F.struct(
        "part", F.element_at("blocks", 1)["role"].alias("first"),
        F.element_at("blocks", -1)["role"].alias("last"), inner.alias("segments")).alias("c"))
    whole = formatted.groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))

    def glue(c: Column, i: Column) -> Column:
        before = F.get(F.col("cs"), i - 1)
        return F.concat(F.when(i == 0, F.array(opened(c["first"])))
                        .when(before["last"] == c["first"], F.array(_segment(F.lit(NEXT), off)))
                        .otherwise(F.array(_segment(F.lit(END), off), opened(c["first"]))), c["segments"])

    return whole.select("conv_id", F.concat(F.flatten(F.transform("cs", glue)),
                                            F.array(_segment(F.lit(END), off))).alias("segments"))


def formatted_text(segments: str = "segments") -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted text holds."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda _, i: i > 0)

    def turns(b: Column) -> Column:
        cut = F.instr(b, "\n")
        role = unescape_role(F.substring(b, F.lit(1), cut - 1))
        text = F.substring(b, cut + 1, F.char_length(b) - cut - len(END))
        return F.transform(F.split(text, r"<\|im_next\|>", -1),
                           lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: str = "segments") -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
