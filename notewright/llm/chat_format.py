"""Chat formatting: a visitor flattens typed content parts (text, image, audio, document) into
ordered placeholders, records attachment references and expanded token counts, and marks which
bytes carry loss. Built-in DataFrame functions only.

A turn reads ``<s>role``, a line feed, its content and ``</s>``. Inside roles and texts ``&``,
``<`` and ``[`` are written as entities, so no control string (all of them hold ``<`` or ``[``)
can occur there, and unescaping gives the text back exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm.common import col

OPEN, CLOSE = "<s>", "</s>"
#: Characters written as entities, the ampersand first; a role's line feeds too.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ROLE_ENTITIES = (*ENTITIES, ("\n", "&#10;"))
#: Units (pixels, milliseconds, pages) for one token, or tokens for one unit, by kind of part.
UNITS_PER_TOKEN = {"image": 784, "audio": 40}
TOKENS_PER_UNIT = {"document": 256}


def escape(text: Column, entities: tuple = ENTITIES) -> Column:
    for plain, entity in entities:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column, entities: tuple = ENTITIES) -> Column:
    for plain, entity in reversed(entities):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """The typed parts of a turn that is text only."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            text.alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("long").alias("units"),
        )
    )


def _tokens(kind: Column, units: Column) -> Column:
    """Tokens that an attachment expands to, one at least."""
    n = F.coalesce(units, F.lit(0))
    out = F.lit(0)
    for name, per in UNITS_PER_TOKEN.items():
        out = F.when(kind == name, F.ceil(n / per)).otherwise(out)
    for name, each in TOKENS_PER_UNIT.items():
        out = F.when(kind == name, n * each).otherwise(out)
    return F.greatest(F.lit(1), out).cast("long")


def format_chats(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``n_turns``, ``formatted``, ``loss_spans`` (start and
    end in UTF-8 bytes of formatted), ``attachments`` (no, kind, ref, tokens, start, end) and
    ``expanded_tokens`` (of all attachments).

    parts_col holds array<struct<kind, text, ref, units>>; a kind other than text becomes the
    placeholder ``<kind:no>``, numbered through the conversation. Null parts are one empty text, a
    null text or role is empty, a null kind is text, an unknown kind is an attachment of one token.
    Rows with equal turn numbers (nulls first) are ordered by role and content, repeated rows all
    count. Null conversation ids form one conversation. Empty tables give empty results; other
    columns are not read.

    Plan: one exchange on the conversation serves all windows and the final gathering. A
    conversation is one row of the result, so its turns meet in one task; all work in it is linear
    in its bytes.
    """
    content = F.coalesce(col(parts_col), text_part(F.lit("")))
    content = F.when(F.size(content) == 0, text_part(F.lit(""))).otherwise(content)
    conv = Window.partitionBy("conv_id")
    rows = turns.select(
        col(conv_col).alias("conv_id"),
        col(turn_col).alias("turn"),
        F.coalesce(col(role_col), F.lit("")).alias("role"),
        content.alias("parts"),
    ).withColumn("row", F.row_number().over(conv.orderBy("turn", "role", F.to_json("parts"))))
    each = rows.select("conv_id", "row", "role", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "part"))
    kind = F.coalesce(F.lower("part.kind"), F.lit("text"))
    ordered = conv.orderBy("row", "at")
    each = (
        each.withColumn("kind", kind)
        .withColumn("attached", (F.col("kind") != "text").cast("int"))
        .withColumn("no", F.sum("attached").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(
            "body",
            F.when(F.col("attached") == 0, escape(F.coalesce("part.text", F.lit("")))).otherwise(
                F.concat(F.lit("<"), escape(F.col("kind")), F.lit(":"), F.col("no").cast("string"), F.lit(">"))
            ),
        )
        .withColumn(
            "head",
            F.when(F.col("at") == 0, F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ENTITIES), F.lit("\n"))).otherwise(""),
        )
        .withColumn("tail", F.when(F.col("at") == F.col("n") - 1, F.lit(CLOSE)).otherwise(""))
        .withColumn("piece", F.concat("head", "body", "tail"))
        .withColumn("upto", F.sum(F.octet_length("piece")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    )
    end = F.col("upto") - F.octet_length("tail")
    span = F.struct((end - F.octet_length("body")).alias("start"), end.alias("end"))
    loss = (F.col("role") == loss_role) & (F.col("attached") == 0)
    attachment = F.struct(
        "no", "kind", F.col("part.ref").alias("ref"), _tokens(F.col("kind"), F.col("part.units")).alias("tokens"),
        span["start"].alias("start"), span["end"].alias("end"),
    )
    gathered = each.groupBy("conv_id").agg(
        F.count_if(F.col("at") == 0).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("upto", "row", "at", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(loss, span))).alias("loss_spans"),
        F.sort_array(F.collect_list(F.when(F.col("attached") == 1, attachment))).alias("attachments"),
    )
    return gathered.select(
        "conv_id",
        "n_turns",
        F.array_join(F.col("pieces.piece"), "").alias("formatted"),
        "loss_spans",
        "attachments",
        F.aggregate("attachments.tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """Reads a formatted conversation back: array<struct<role, text>>, unescaped."""
    turns = F.split(formatted, CLOSE, -1)
    turns = F.slice(turns, 1, F.greatest(F.lit(0), F.size(turns) - 1))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = piece.substr(F.char_length(role) + 2, F.char_length(piece))
        role = role.substr(F.lit(len(OPEN) + 1), F.char_length(role))
        return F.struct(unescape(role, ROLE_ENTITIES).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    raw = formatted.cast("binary")
    part = lambda s: unescape(raw.substr(s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")).cast("string"))
    return F.array_join(F.transform(loss_spans, part), "")
