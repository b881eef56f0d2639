"""Chat formatting with typed content parts, in DataFrame operations only.

A turn is a list of parts (text, image, audio or document). A visitor flattens them, in order,
into one string in which an attachment is a placeholder such as ``<image>``; its reference and
the number of tokens it will expand to are recorded beside the text. Turns are framed as
``### role: content</turn>\\n``.

Escaping is reversible: in texts ``\\`` becomes ``\\b``, ``<`` becomes ``\\l`` and ``#`` becomes
``\\h`` (in roles also ``:`` becomes ``\\c`` and a line feed ``\\n``), so neither a frame nor a
placeholder can occur inside a text, and every backslash in the output starts an escape.

Defined results: a null text or part list is an empty content, a null role an empty role; rows
of one conversation are ordered by turn (nulls first), then role, then content, so ties and
repeated rows are all kept in a fixed order; rows with a null conversation id form one
conversation; a part of an unknown kind is treated as text; other columns are not read.
A conversation is one output row, so it must fit in memory, as its digest needs it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = "array<struct<kind:string,text:string,ref:string,units:double>>"
#: Tokens that one unit of an attachment expands to: an image tile, a second of audio, a document page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
END = "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), *(((":", "\\c"), ("\n", "\\n")) if role else ())):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for plain, code in (*(((":", "\\c"), ("\n", "\\n")) if role else ()), ("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"))).cast(PARTS)


def _visit(part: Column, tokens: dict[str, int]) -> Column:
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind in tokens:
        out = F.when(part["kind"] == kind, F.lit(f"<{kind}>")).otherwise(out)
    return out


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         parts: str = "parts", tokens: dict[str, int] = TOKENS_PER_UNIT,
                         loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_spans`` (start and length in
    code points of the contents to train on, in order), ``attachments`` (turn order, kind,
    reference, tokens, in placeholder order) and ``expanded_tokens`` (their sum)."""
    df = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                      F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
                      F.coalesce(F.col(f"`{parts}`"), F.array().cast(PARTS)).alias("parts"))
    df = df.withColumn("body", F.array_join(F.transform("parts", lambda p: _visit(p, tokens)), ""))
    df = df.withColumn("media", F.transform(
        F.filter("parts", lambda p: p["kind"].isin(*tokens)),
        lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"),
                           F.ceil(F.coalesce(p["units"], F.lit(1.0)) * _rate(p["kind"], tokens)).alias("tokens"))))
    df = df.select("conv_id", "turn", "role", "body", "media",
                   F.concat(F.lit("### "), escape(F.col("role"), True), F.lit(": ")).alias("head"))
    df = df.withColumn("segment", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("at", F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)))
    one = F.struct("at", "segment", F.col("role").isin(*loss_roles).alias("train"),
                   (F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"), "media")
    df = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    media = F.flatten(F.transform("turns", lambda t, i: F.transform(t["media"], lambda m: F.struct(
        i.alias("turn_index"), m["kind"].alias("kind"), m["ref"].alias("ref"), m["tokens"].alias("tokens")))))
    df = df.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["train"]),
                    lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
        media.alias("attachments"))
    return df.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, m: a + m["tokens"]))


def _rate(kind: Column, tokens: dict[str, int]) -> Column:
    out = F.lit(0)
    for k, n in tokens.items():
        out = F.when(kind == k, n).otherwise(out)
    return out


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text), unescaped; placeholders stay in the text."""
    pieces = F.split(formatted, END)  # what follows the last end is empty
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    def one(p):
        head = F.substring_index(p, ": ", 1)
        return F.struct(unescape(F.substring(head, F.lit(5), F.length(head)), True).alias("role"),
                        unescape(F.substring(p, F.length(head) + 3, F.length(p))).alias("text"))
    return F.transform(pieces, one)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
