"""Chat formatting with typed content parts, in built-in DataFrame functions only.

A turn's content is a list of parts: text, image, audio or document. Each part
is visited in order: text is escaped and written out, an attachment becomes an
ordered placeholder ``<|image:0|>`` and leaves a reference with its expanded
token count. Turns are marked ``<|turn|>role<|text|>...<|end|>``.

Escaping: every backslash in a text is doubled, then a backslash is put after the
first character of each control string. A single backslash can then only be such
a mark, so reading back is exact for any text.

Edge cases: a null text, role or part list counts as empty and keeps its turn; a
part of unknown type is kept as a placeholder of that type with no tokens; turns
that tie on their number are ordered by role, then by their first text, and repeated
rows all stay; rows without a conversation id form one conversation; an empty table
gives no rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Own marks start with the first; the others belong to common templates.
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]")
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Side of an image patch in pixels, audio tokens a second, tokens a page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for s in CONTROLS:
        c = F.replace(c, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}"))
    return c


def unescape(c: Column) -> Column:
    for s in CONTROLS:
        c = F.replace(c, F.lit(f"{s[0]}\\{s[1:]}"), F.lit(s))
    return F.replace(c, F.lit("\\\\"), F.lit("\\"))


def text_part(c: Column) -> Column:
    """A list of one text part."""
    none = F.lit(None)
    fields = [F.lit("text").alias("type"), F.coalesce(c, F.lit("")).alias("text"), *(none.alias(n) for n in ("ref", "width", "height", "seconds", "pages"))]
    return F.array(F.struct(*fields)).cast(f"array<{PART}>")


def attachment_tokens(p: Column) -> Column:
    """Tokens that an attachment expands to."""
    tiles = F.ceil(p["width"] / PATCH) * F.ceil(p["height"] / PATCH)
    n = (
        F.when(p["type"] == "image", tiles)
        .when(p["type"] == "audio", F.ceil(p["seconds"] * AUDIO_RATE))
        .when(p["type"] == "document", p["pages"].cast("long") * PAGE_TOKENS)
    )
    return F.coalesce(n, F.lit(0)).cast("long")


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, parts).

    Returns conv_id, formatted, loss_spans (start and length in code points of
    ``formatted``: the text parts of assistant turns), attachments (index, turn,
    type, ref, tokens, position of the placeholder) and expanded_tokens.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    parts = F.when(F.size(parts) == 0, text_part(F.lit(""))).otherwise(parts)
    turns = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    # equal turn numbers are told apart, so the parts of two such turns don't mix
    order = Window.partitionBy("conv_id").orderBy("turn", "role", F.col("parts")[0]["text"])
    turns = turns.withColumn("at", F.row_number().over(order))
    rows = turns.select("conv_id", "turn", "role", "at", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("k", "p"))

    p = F.col("p")
    kind = F.coalesce(p["type"], F.lit("text"))
    is_text = kind == "text"
    upto = Window.partitionBy("conv_id").orderBy("at", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("index", F.sum((~is_text).cast("int")).over(upto) - 1)
    head = F.when(F.col("k") == 0, F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))).otherwise(F.lit(""))
    holder = F.concat(F.lit("<|"), escape(kind), F.lit(":"), F.col("index").cast("string"), F.lit("|>"))
    rows = rows.select(
        "conv_id", "turn", "role", "at", "k", "index", kind.alias("kind"), p["ref"].alias("ref"), attachment_tokens(p).alias("tokens"),
        head.alias("head"), F.when(is_text, escape(p["text"])).otherwise(holder).alias("body"), F.when(F.col("k") == F.col("n_parts") - 1, F.lit(END)).otherwise(F.lit("")).alias("tail"),
    )
    piece = F.concat("head", "body", "tail")
    start = F.sum(F.length(piece)).over(upto) - F.length("body") - F.length("tail")
    rows = rows.withColumn("start", start).withColumn("piece", piece).withColumn("length", F.length("body"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "k", "piece", "kind", "role", "start", "length", "turn", "index", "ref", "tokens"))).alias("v"))
    spans = F.transform(F.filter("v", lambda x: (x["kind"] == "text") & (x["role"] == "assistant")), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    held = F.transform(
        F.filter("v", lambda x: x["kind"] != "text"),
        lambda x: F.struct(x["index"].alias("index"), x["turn"].alias("turn"), x["kind"].alias("type"), x["ref"].alias("ref"), x["tokens"].alias("tokens"), x["start"].alias("position")),
    )
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("v", lambda x: x["piece"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        held.alias("attachments"),
        F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, unescaped."""
    turns = F.filter(F.split(formatted, re.escape(TURN), -1), lambda x, i: i > 0)

    def parse(x: Column) -> Column:
        role = F.substring_index(x, TEXT, 1)
        body = F.substr(x, F.length(role) + len(TEXT) + 1, F.length(x) - F.length(role) - len(TEXT) - len(END))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, parse)


def loss_text(formatted: Column, spans: Column) -> Column:
    """What stands under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"]))), "")
