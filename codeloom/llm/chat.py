"""Chat formatting (operator 7), in DataFrame functions only.

A turn's content is an array of typed parts.  The visitor turns each part into text, in order: a
text part into its escaped text, an image, audio or document part into a placeholder that names
its kind and its number in the turn.  Attachments are recorded with their reference and the number of
tokens that they expand to.

Template: a turn is ``<|role|>``, a line feed, the content, ``<|end|>`` and a line feed.  Inside
roles and texts the characters that control strings begin with are written as entities and
``&`` as ``&amp;``, so no text can end a turn, open one, or pass for a control string of another
template, and :func:`unescape` gives it back exactly.

The loss mask is the list of spans (start and length in code points) of the contents of the
turns whose role is trained on.

Defined results: a null text is an empty text and a null role an empty role; rows of a
conversation order by turn (null first), then role, then content, so ties and repeated rows
have one order; rows whose conversation is null form one conversation; empty texts are kept as turns; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Written as entities inside texts, in this order; ``&`` first, so that it is undone last.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("|", "&vert;"))
END = "<|end|>\n"
PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT_TYPE = "struct<turn:int,part:int,kind:string,ref:string,tokens:bigint>"

IMAGE_PATCH = 28
AUDIO_TOKENS_PER_SECOND = 25
DOCUMENT_TOKENS_PER_PAGE = 600


def escape(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """The content of a turn that is plain text."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages")))


def visit(part: Column, number: Column) -> Column:
    """The text that stands for a part."""
    kind = F.coalesce(part["type"], F.lit("text"))
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), escape(kind), F.lit(":"), number.cast("string"), F.lit("|>")))


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment takes in the model's input."""
    image = F.ceil(F.coalesce(part["width"], F.lit(0)) / IMAGE_PATCH) * F.ceil(F.coalesce(part["height"], F.lit(0)) / IMAGE_PATCH)
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_PER_SECOND)
    pages = F.coalesce(part["pages"], F.lit(0)).cast("long") * DOCUMENT_TOKENS_PER_PAGE
    return F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).when(part["type"] == "document", pages).otherwise(F.lit(0)).cast("long")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None, text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``formatted``, ``loss_mask``, ``attachments`` and ``expanded_tokens``.

    ``parts`` is a column of ``array<PART_TYPE>``; without it the content is the text of ``text_col``.
    """
    content = F.coalesce(parts, F.expr(f"CAST(array() AS array<{PART_TYPE}>)")) if parts is not None else text_part(F.col(text_col).cast("string"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), content.alias("parts"))
    flat = F.concat_ws("", F.transform("parts", visit))
    files = F.filter(
        F.transform("parts", lambda p, i: F.struct(i.alias("part"), p["type"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))),
        lambda a: a["kind"] != "text",
    )
    # Only the flattened content crosses the shuffle, once; pieces are put together behind it.
    rows = rows.select("conv_id", "turn", "role", flat.alias("content"), files.alias("files"))
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"))
    chars = (F.length(head) + F.length("content") + len(END)).cast("long")
    own = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc("role"), F.asc("content"), F.asc("files"))
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"number": F.row_number().over(own), "start": F.coalesce(F.sum(chars).over(before), F.lit(0).cast("long"))})
    span = F.when(F.col("role").isin(*loss_roles), F.struct((F.col("start") + F.length(head)).alias("start"), F.length("content").cast("long").alias("length")))
    each = F.struct("number", F.concat(head, F.col("content"), F.lit(END)).alias("piece"), span.alias("span"), "files")
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(each)).alias("turns"))
    numbered = F.transform("turns", lambda t: F.transform(t["files"], lambda a: F.struct(t["number"].alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))
    return grouped.select(
        "conv_id",
        F.concat_ws("", F.col("turns.piece")).alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_mask"),
        F.flatten(numbered).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text) structs, unescaped; placeholders stay."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda b: b != "")
    return F.transform(blocks, lambda b: F.struct(unescape(F.regexp_extract(b, r"(?s)^<\|(.*?)\|>\n", 1)).alias("role"), unescape(F.regexp_replace(b, r"(?s)^<\|.*?\|>\n", "")).alias("text")))


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.concat_ws("", F.transform(loss_mask, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader finds in formatted conversations."""
    told = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    all_turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
