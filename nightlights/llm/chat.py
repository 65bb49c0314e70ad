"""Chat formatting with DataFrame functions only: typed content parts, placeholders, loss spans and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
OPEN, BODY, CLOSE = "<|turn|>", "<|body|>", "<|end|>"
#: What one part of each kind adds to the expanded tokens where the part doesn't say.
PART_TOKENS = {"image": 256, "audio": 64, "document": 128}
PARTS = "array<struct<kind string, text string, ref string, tokens int>>"


def escape(text: Column) -> Column:
    """No '<' is left. Every control string begins with one, so none can arise from the result, whatever stands before or after
    it: parts that are escaped one by one stay escaped when they are joined."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_kind(kind: Column) -> Column:
    """A kind as a placeholder names it: without the signs that end the name, too."""
    return F.replace(F.replace(escape(kind), F.lit("|"), F.lit("&bar;")), F.lit(":"), F.lit("&colon;"))


def unescape_kind(kind: Column) -> Column:
    return unescape(F.replace(F.replace(kind, F.lit("&bar;"), F.lit("|")), F.lit("&colon;"), F.lit(":")))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part; null is empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))).cast(PARTS)


def _attachment(kind: Column) -> Column:
    return F.coalesce(kind, F.lit("text")) != "text"


def flatten_parts(parts: Column) -> tuple[Column, Column, Column]:
    """(text, attachments, expanded tokens) of typed parts: texts stand as they are, escaped; another part becomes the
    placeholder <|kind:k|>, k being its place among the attachments, which are listed with reference and tokens. Any kind but
    text is an attachment; one that PART_TOKENS doesn't name counts as one token unless it says otherwise. A null kind is text."""
    whole = F.coalesce(parts, F.array().cast(PARTS))
    tokens = lambda p: F.coalesce(p["tokens"], *[F.when(p["kind"] == k, n) for k, n in PART_TOKENS.items()], F.lit(1))
    attachments = F.transform(F.filter(whole, lambda p: _attachment(p["kind"])), lambda p, k: F.struct(k.alias("k"), p["kind"].alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    visited = F.aggregate(
        whole,
        F.struct(F.lit("").alias("text"), F.lit(0).alias("k")),
        lambda seen, p: F.struct(
            F.concat(seen["text"], F.when(_attachment(p["kind"]), F.concat(F.lit("<|"), escape_kind(p["kind"]), F.lit(":"), seen["k"].cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))).alias("text"),
            (seen["k"] + _attachment(p["kind"]).cast("int")).alias("k"),
        ),
    )["text"]
    return visited, attachments, F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"])


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted string, loss array<struct<start, length>> in code points of formatted,
    attachments with their turn's place, expanded_tokens.

    A turn is OPEN role BODY text CLOSE; loss spans cover exactly the texts of trained_role. Turns go by turn, then
    role, then text, so ties and repeated rows have one order; null turns first, a null role is empty, null parts are an
    empty text. Rows of a null conv form one conversation. A conversation is one row in the end, so it must fit in one.
    """
    text, attachments, tokens = flatten_parts(turns[parts_col])
    rows = turns.select(turns[conv_col].alias("conv"), F.struct(turns[turn_col].alias("turn"), F.coalesce(turns[role_col].cast("string"), F.lit("")).alias("role"), text.alias("text"), attachments.alias("files"), tokens.alias("tokens")).alias("t"))
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    piece = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(BODY), t["text"], F.lit(CLOSE))
    head = lambda t: F.length(escape(t["role"])) + len(OPEN) + len(BODY)
    seen = F.aggregate(
        "ts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start int, length int>>").alias("loss")),
        lambda s, t: F.struct(
            (s["at"] + head(t) + F.length(t["text"]) + len(CLOSE)).alias("at"),
            F.when(t["role"] == trained_role, F.concat(s["loss"], F.array(F.struct((s["at"] + head(t)).alias("start"), F.length(t["text"]).alias("length"))))).otherwise(s["loss"]).alias("loss"),
        ),
    )
    return whole.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("ts", piece), "").alias("formatted"),
        seen["loss"].alias("loss"),
        F.flatten(F.transform("ts", lambda t, i: F.transform(t["files"], lambda a: F.struct(i.alias("turn"), a["k"].alias("k"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate("ts", F.lit(0).cast("long"), lambda n, t: n + t["tokens"]).alias("expanded_tokens"),
    )


def _parsed_body(body: Column) -> Column:
    """array<struct<kind, text, k>> of an escaped text: what stands between placeholders, and the placeholders by kind and place.
    Only placeholders hold '<', so a text that spells one out stays text."""
    empty = "array<struct<kind string, text string, k int>>"
    piece = lambda kind, text, k: F.struct(kind.alias("kind"), text.alias("text"), k.cast("int").alias("k"))
    words = lambda t: F.when(F.length(t) > 0, F.array(piece(F.lit("text"), unescape(t), F.lit(None)))).otherwise(F.array()).cast(empty)

    def marked(p: Column, i: Column) -> Column:
        name = F.substring_index(p, "|>", 1)
        placeholder = F.array(piece(unescape_kind(F.substring_index(name, ":", 1)), F.lit(None).cast("string"), F.substring_index(name, ":", -1))).cast(empty)
        rest = F.substring(p, F.length(name) + 3, F.length(p))
        return F.when(i == 0, words(p)).otherwise(F.concat(placeholder, words(rest)))

    return F.flatten(F.transform(F.split(body, r"<\|"), marked))


def parse_chats(formatted: Column) -> Column:
    """array<struct<role, text, parts>> read back from a formatted string.

    text is all of a turn's text with placeholders as they stand; parts tells them apart: (kind, text, k), texts unescaped,
    and for attachments the place k in the turn's list. Texts that follow one another are one part, empty ones none.
    """
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda _, i: i > 0)
    body = lambda p: F.substring_index(F.substring_index(p, BODY, -1), CLOSE, 1)
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(p, BODY, 1)).alias("role"), unescape(body(p)).alias("text"), _parsed_body(body(p)).alias("parts")))


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss spans, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
