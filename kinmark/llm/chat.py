"""Chat formatting with Spark expressions only.

Turns of a conversation are gathered as structs, sorted in the array, adjacent turns of one role merged by
an array aggregation, and the blocks concatenated. The template, with ``T`` for escaped texts::

    [INST]role\\nT[+]T[/INST]      blocks of every role but the trained one
    <s>role\\nT[+]T</s>            blocks of the trained role (assistant)

All control strings begin with ``<`` or ``[``. In roles and texts a backslash is doubled and a backslash is
put behind every ``<`` and ``[``, so no control string can appear inside them, whatever they contain; the
reverse gives back every text exactly. A line end within a role becomes ``[n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def _replace(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def escape(text: Column) -> Column:
    return _replace(_replace(_replace(text, "\\", "\\\\"), "<", "<\\"), "[", "[\\")


def unescape(text: Column) -> Column:
    return _replace(_replace(_replace(text, "<\\", "<"), "[\\", "["), "\\\\", "\\")


def escape_role(role: Column) -> Column:
    return _replace(escape(role), "\n", "[n")


def unescape_role(role: Column) -> Column:
    return unescape(_replace(role, "[n", "\n"))


_BLOCKS = "array<struct<role:string,texts:array<string>>>"


def _merge(left: Column, right: Column) -> Column:
    """Blocks of two neighbouring stretches of turns: the last block on the left and the first on the right are
    one where their roles are equal."""
    last, first = F.get(left, F.size(left) - 1), F.get(right, F.lit(0))
    one = F.struct(last["role"].alias("role"), F.concat(last["texts"], first["texts"]).alias("texts"))
    joined = F.concat(
        F.slice(left, F.lit(1), F.size(left) - 1), F.array(one), F.slice(right, F.lit(2), F.size(right))
    )
    return F.when((F.size(left) > 0) & (last["role"] == first["role"]), joined).otherwise(F.concat(left, right))


def merge_turns(turns: Column) -> Column:
    """Blocks ``(role, texts)`` of sorted turns: adjacent turns of one role are folded into one block. Stretches of
    about the square root of the turns are folded first, then the stretches, so that a conversation of very many
    turns does not copy its whole list at every turn."""
    none = F.array().cast(_BLOCKS)
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(turns))).cast("int"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(turns)), step)
    stretches = F.transform(starts, lambda at: F.slice(turns, at, step))

    def fold(stretch: Column) -> Column:
        return F.aggregate(
            stretch,
            none,
            lambda blocks, t: _merge(blocks, F.array(F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))),
        )

    return F.aggregate(F.transform(stretches, fold), none, _merge)


def _segments(block: Column, trained: str) -> Column:
    """Pieces of one block: its opening mark, its texts with ``[+]`` between them, its closing mark."""
    own = block["role"] == trained

    def mark(text: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(False).alias("loss"))

    opening = F.concat(F.when(own, F.lit("<s>")).otherwise(F.lit("[INST]")), escape_role(block["role"]), F.lit("\n"))
    texts = F.transform(
        block["texts"],
        lambda t, i: F.array(mark(F.when(i > 0, F.lit("[+]")).otherwise(opening)), F.struct(escape(t).alias("text"), own.alias("loss"))),
    )
    closing = F.when(own, F.lit("</s>")).otherwise(F.lit("[/INST]"))
    return F.concat(F.flatten(texts), F.array(mark(closing)))


def format_conversations(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row per ``conv_id``: ``formatted`` (the whole text) and ``segments``, its pieces with ``loss`` true on
    trained texts; the segments concatenated are ``formatted``.

    ``turns`` has ``conv_id, turn, role, text``; other columns are ignored. Turns go by ``turn`` (null first),
    ties by role and text; repeated rows stay. Null roles and texts read as empty. A null ``conv_id`` is a
    conversation of its own. An empty table gives an empty result. Texts of any length stay whole. Partial
    lists are built before the shuffle; a conversation is one output text, so its turns do meet in one row.
    """
    gathered = turns.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("turn").alias("turn"),
                    F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )
    blocks = gathered.select("conv_id", merge_turns(F.col("turns")).alias("blocks"))
    segments = F.flatten(F.transform("blocks", lambda b: _segments(b, trained_role)))
    return (
        blocks.select("conv_id", segments.alias("segments"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .select("conv_id", "formatted", "segments")
    )


def read_turns(formatted: Column) -> Column:
    """Turns ``(role, text)`` of a formatted conversation, read from its text alone."""
    blocks = F.filter(F.split(formatted, r"(?<=</s>|\[/INST\])"), lambda b: b != "")
    bodies = F.transform(blocks, lambda b: F.regexp_replace(b, r"^(<s>|\[INST\])|(</s>|\[/INST\])$", ""))

    def turns_of(body: Column) -> Column:
        cut = F.instr(body, "\n")
        role = unescape_role(F.substring(body, F.lit(1), cut - 1))
        texts = F.split(F.substring(body, cut + 1, F.length(body)), r"\[\+\]")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(bodies, turns_of))


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, one assistant text after the other."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
