"""Chat formatting with typed content parts, in DataFrame functions only.

A conversation is a set of turns, a turn an ordered list of typed parts. A visitor (one
branch per part kind) flattens the parts to text and ordered placeholders, records what each
placeholder refers to, and counts the tokens that it expands to. Control strings inside
texts and roles are escaped reversibly, so the formatted text can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Opens a turn, ends its role, ends the turn.
TURN, BODY, END = "<|turn|>", "\n", "<|end|>"
#: Open and end a placeholder.
PART, PART_END = "<|part:", "|>"
#: The escape character (a printable symbol that ordinary text hardly holds) and what follows it.
ESC = "␛"
#: Strings that may not stand in a text as they are: this template's and those of common others.
CONTROL = (TURN, END, PART, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>")
CODES = "abcdefghijklmopqrstuvwxyz"

#: One content part. units: pixels wide and high of an image, seconds of audio, pages of a document.
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"

#: Expansion: one token for each patch of an image, a fixed number for a second and for a page.
PATCH, AUDIO_TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 256


def _coded(text: Column) -> Column:
    """Every control string becomes the escape character and a letter; the text's own escape characters are coded already."""
    for string, code in zip(CONTROL, CODES, strict=False):
        text = F.replace(text, F.lit(string), F.lit(ESC + code))
    return text


def escape(text: Column, role: bool = False) -> Column:
    """Every control string becomes the escape character and a letter, the escape character itself that and 0."""
    out = _coded(F.replace(text, F.lit(ESC), F.lit(f"{ESC}0")))
    return F.replace(out, F.lit("\n"), F.lit(f"{ESC}n")) if role else out


def unescape(text: Column) -> Column:
    """The inverse of escape(): each escape character is followed by its own code, so the order doesn't matter but for the last."""
    out = F.replace(text, F.lit(f"{ESC}n"), F.lit("\n"))
    for string, code in zip(CONTROL, CODES, strict=False):
        out = F.replace(out, F.lit(ESC + code), F.lit(string))
    return F.replace(out, F.lit(f"{ESC}0"), F.lit(ESC))


def text_part(text: Column) -> Column:
    """A list of one text part."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), null("string").alias("ref"), null("int").alias("width"), null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")))


def part_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder expands to; 0 for text and unknown kinds, 1 at least for the others."""
    patches = lambda n: F.ceil(F.coalesce(n, F.lit(0)) / PATCH)
    return (
        F.when(part["kind"] == "image", F.greatest(patches(part["width"]) * patches(part["height"]), F.lit(1)))
        .when(part["kind"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_PER_SECOND), F.lit(1)))
        .when(part["kind"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(0)) * TOKENS_PER_PAGE, F.lit(1)))
        .otherwise(0).cast("long")
    )


def _attached(part: Column) -> Column:
    return ~F.coalesce(part["kind"], F.lit("text")).isin("text")


def _visit(parts: Column) -> Column:
    """The parts' text in order; attachment k of the turn becomes <|part:kind:k|>, other characters of a kind than letters, digits, _ and - becoming _.

    Control strings are found in the joined text, so that none arises where two parts meet. Until then a
    placeholder is marked by the escape character, which texts have coded, and which no control string holds.
    """
    rank = lambda i: F.size(F.filter(F.slice(parts, 1, i + 1), _attached)) - 1
    kind = lambda p: F.regexp_replace(p["kind"], "[^\\p{L}\\p{N}_-]", "_")
    spot = lambda p, i: F.concat(F.lit(f"{ESC}("), kind(p), F.lit(":"), rank(i).cast("string"), F.lit(f"{ESC})"))
    text = lambda p: F.replace(F.coalesce(p["text"], F.lit("")), F.lit(ESC), F.lit(f"{ESC}0"))
    joined = F.array_join(F.transform(parts, lambda p, i: F.when(_attached(p), spot(p, i)).otherwise(text(p))), "")
    return F.replace(F.replace(_coded(joined), F.lit(f"{ESC}("), F.lit(PART)), F.lit(f"{ESC})"), F.lit(PART_END))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_col, formatted, loss_spans, attachments.

    loss_spans: array of (start, length) in code points of formatted: the bodies of
    loss_role's turns, which a trainer learns. attachments: array of (turn_no, kind, ref,
    tokens) in the order of their placeholders.

    Turns are ordered by turn_col (nulls first), ties by role and content. Null roles, texts
    and part lists count as empty; a part of an unknown kind is an attachment of 0 tokens; a null
    conversation id is a conversation of its own; repeated rows are repeated turns. Other
    columns are ignored, and no turn gives no conversation. A conversation becomes one
    value, so it is gathered by one task; its length is bounded by that of a string.
    """
    t = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(parts_col), F.array().cast(PARTS)).alias("parts"))
    t = t.withColumn("body", _visit(F.col("parts"))).withColumn("head", F.concat(F.lit(TURN), escape(F.col("role"), role=True), F.lit(BODY)))
    t = t.withColumn("attached", F.transform(F.filter("parts", _attached), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))))
    in_order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "body", F.to_json("attached"))
    before = F.coalesce(F.sum(F.length("head") + F.length("body") + len(END)).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("no", F.row_number().over(in_order) - 1).withColumn("start", (before + F.length("head")).cast("int"))
    span = F.when(F.col("role") == loss_role, F.struct("start", F.length("body").alias("length")))
    rows = F.array_sort(F.collect_list(F.struct("no", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"), "attached")))
    out = t.groupBy("conv").agg(rows.alias("rows"))
    return out.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.transform(F.filter("rows", lambda r: r["span"].isNotNull()), lambda r: r["span"]).alias("loss_spans"),
        F.flatten(F.transform("rows", lambda r: F.transform(r["attached"], lambda a: F.struct(r["no"].alias("turn_no"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped; placeholders stay as text."""
    pieces = F.split(formatted, "<\\|turn\\|>")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces) - 1)  # a conversation starts with a turn
    role = lambda p: unescape(F.substring_index(p, BODY, 1))
    text = lambda p: unescape(F.substr(p, F.locate(BODY, p) + 1, F.length(p) - F.locate(BODY, p) - len(END)))
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))


def read_parts(formatted: Column) -> Column:
    """As read_back(), with the parts of each turn: array of (role, parts), a part being (kind, number, text).

    Texts have kind "text" and no number; what stood between two placeholders is one text, and no empty one is given. Placeholders have
    their kind and number and no text. Texts that look like placeholders are texts.
    """
    place = lambda s: F.split(F.substring_index(s, PART_END, 1), ":")
    text = lambda s: F.struct(F.lit("text").alias("kind"), F.lit(None).cast("int").alias("number"), unescape(s).alias("text"))
    rest = lambda s: F.substr(s, F.locate(PART_END, s) + len(PART_END))
    spot = lambda s: F.struct(F.get(place(s), F.lit(0)).alias("kind"), F.get(place(s), F.lit(1)).cast("int").alias("number"), F.lit(None).cast("string").alias("text"))
    pieces = F.split(formatted, "<\\|turn\\|>")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces) - 1)
    body = lambda p: F.split(F.substr(p, F.locate(BODY, p) + 1, F.length(p) - F.locate(BODY, p) - len(END)), "<\\|part:")
    parts = lambda b: F.filter(F.flatten(F.transform(b, lambda s, i: F.when(i == 0, F.array(text(s))).otherwise(F.array(spot(s), text(rest(s)))))), lambda x: (x["kind"] != "text") | x["number"].isNotNull() | (x["text"] != ""))
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(p, BODY, 1)).alias("role"), parts(body(p)).alias("parts")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped, in order with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
