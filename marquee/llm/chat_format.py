"""Chat formatting of typed content parts, in DataFrame functions only.

A message has a role and an ordered list of parts ``struct<kind, text, ref,
units>``. Text parts are kept, escaped; image, audio and document parts become
placeholders in their place, are listed as attachment references, and count as
``units`` times the expansion of their kind. A turn is written as

    <|role|>\\n content <|end|>\\n

Inside roles and contents a backslash is put behind every ``<`` and ``[``, so
no control string of this or the usual other templates (``<|..|>``, ``</s>``,
``[INST]``) survives in them; dropping that backslash restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that one unit of an attachment expands to (an image
#: tile, a second of audio, a page).
EXPANSION = {"image": 256, "audio": 25, "document": 512}
END = "<|end|>\n"
PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\", "$1")


def _escape_role(role: Column) -> Column:
    """Roles stand before ``|>``, so ``|`` is escaped in them too."""
    return F.regexp_replace(role, r"([<\[|])", r"$1\\")


def _unescape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"([<\[|])\\", "$1")


def text_part(text: Column) -> Column:
    """A message of one text part (null text: empty)."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units")))


def _placeholder(kind: Column) -> Column:
    return F.concat(F.lit("<|"), kind, F.lit("|>"))


def _visit(part: Column) -> Column:
    """What one part becomes in the content."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    return F.when(kind.isin(*EXPANSION), _placeholder(kind)).otherwise(escape(part["text"]))


def _expanded(parts: Column) -> Column:
    cost = F.create_map(*[x for k, v in EXPANSION.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc + F.when(
        p["kind"].isin(*EXPANSION), F.try_element_at(cost, p["kind"]) * F.coalesce(p["units"], F.lit(1).cast("long"))
    ).otherwise(F.lit(0).cast("long")))


def format_chats(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``messages(conv_id, turn, role, parts)`` to one row per conversation:
    ``conv_id, n_turns, formatted, turns`` (in order: the written turn and the
    start and length, in code points, of the part of it under the loss),
    ``attachments`` (turn place, part place, kind, ref), ``attachment_tokens``.

    Turns go by turn number, then role, then content; null roles are empty,
    null parts or texts are empty, an unknown kind is text. A null conv_id is
    one conversation of its own. Placeholders are not under the loss-escape:
    they read back as themselves. Empty table: empty result.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit("<|"), _escape_role(role), F.lit("|>\n"))
    content = F.array_join(F.transform(parts, _visit), "")
    rows = messages.select(
        "conv_id", F.col("turn").alias("turn"), role.alias("role"), content.alias("content"), head.alias("head"),
        F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"))),
                 lambda x: x["kind"].isin(*EXPANSION)).alias("attached"),
        _expanded(parts).alias("tokens"))
    one = F.struct("turn", "role", "content", "head", "attached", "tokens")
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("m"))
    turns = F.transform("m", lambda t: F.struct(
        F.concat(t["head"], t["content"], F.lit(END)).alias("written"),
        F.length(t["head"]).alias("loss_start"),
        F.when(t["role"].isin(*loss_roles), F.length(t["content"])).otherwise(F.lit(0)).alias("loss_length")))
    attachments = F.flatten(F.transform("m", lambda t, i: F.transform(t["attached"], lambda a: F.struct(
        i.alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref")))))
    return (chats.select("conv_id", F.size("m").cast("long").alias("n_turns"), turns.alias("turns"),
                         attachments.alias("attachments"),
                         F.aggregate("m", F.lit(0).cast("long"), lambda s, t: s + t["tokens"]).alias("attachment_tokens"))
            .withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["written"]), "")))


def read_back(chats: DataFrame) -> DataFrame:
    """From :func:`format_chats`'s output alone: ``conv_id, said`` (the turns'
    roles and texts, read from the formatted text) and ``loss`` (the unescaped
    text under the loss mask)."""
    pieces = F.split("formatted", r"<\|end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    said = F.transform(pieces, lambda p: F.struct(
        _unescape_role(F.regexp_extract(p, r"(?s)\A<\|(.*?)\|>\n", 1)).alias("role"),
        unescape(F.regexp_replace(p, r"(?s)\A<\|.*?\|>\n", "")).alias("text")))
    loss = F.array_join(F.transform("turns", lambda t: unescape(
        F.substring(t["written"], t["loss_start"] + 1, t["loss_length"]))), "")
    return chats.withColumn("said", said).withColumn("loss", loss)
