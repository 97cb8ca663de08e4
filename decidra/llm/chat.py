"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an ordered array of parts (text, image, audio, document). The visitor turns each
part into a piece of text: text is escaped, any other kind becomes a placeholder that counts as many
tokens as the attachment expands to, and its reference is recorded in order.

Template of a turn: ``<|im_start|>role\\ncontent<|im_end|>\\n``. Control strings start with ``<|``.
Inside texts and roles one backslash is put into every ``<``, any number of backslashes, ``|``; then
no text holds ``<|``, and taking one backslash out of each such run gives the text back. A line break
in a role is written ``<|nl|>``, which no escaped role can hold.

Turns are formatted row by row, then gathered in blocks of BLOCK_TURNS turns, and blocks into
conversations, so that a conversation with very many turns reaches its last task as a few long
strings and not as single rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
BLOCK_TURNS = 64
PART = "struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
#: Pixels of a side of one image token's patch; audio tokens a second; tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_part(text: Column) -> Column:
    """One text part as an array of parts."""
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
        )
    )


def part_tokens(part: Column) -> Column:
    """Tokens that an attachment expands to; 0 for text and for kinds that aren't known."""
    patches = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    count = (
        F.when(part["kind"] == "image", patches)
        .when(part["kind"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE))
        .when(part["kind"] == "document", part["pages"] * PAGE_TOKENS)
    )
    return F.coalesce(count, F.lit(0)).cast("long")


def visit(part: Column) -> Column:
    """A part's place in the text. A part of unknown or null kind without a text is a file placeholder."""
    text = F.coalesce(part["text"], F.lit(""))
    mark = F.when(part["kind"].isin("image", "audio", "document"), F.concat(F.lit("<|"), part["kind"], F.lit("|>")))
    return F.when(part["kind"] == "text", escape(text)).otherwise(F.coalesce(mark, F.lit("<|file|>")))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and parts become conv_id, turn, piece, content, trained, attachments, tokens."""
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    others = F.filter(parts, lambda p: ~p["kind"].eqNullSafe(F.lit("text")))
    role = F.replace(escape(F.coalesce(F.col("role"), F.lit(""))), F.lit("\n"), F.lit(NEWLINE))
    content = F.array_join(F.transform(parts, visit), "")
    return turns.select(
        "conv_id",
        "turn",
        role.alias("role_text"),
        content.alias("content"),
        F.col("role").eqNullSafe(F.lit("assistant")).alias("trained"),
        F.transform(others, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))).alias("attachments"),
    )


def format_blocks(turns: DataFrame) -> DataFrame:
    """One row for each conversation and block of turns.

    formatted is the text, loss_spans the places (start from 0, code points, within the block) of the
    assistants' contents, attachments the references in order, media_tokens their expanded tokens.
    Turns are ordered by turn, then role and text; repeated rows all stay. Null ids form one
    conversation, null turns its first block; null roles and texts count as empty. An empty table
    gives no rows; other columns are ignored.
    """
    each = format_turns(turns).withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    row = F.struct("turn", "role_text", "content", "trained", "attachments")
    got = each.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    head = lambda r: F.concat(F.lit(START), r["role_text"], F.lit("\n"))
    whole = lambda r: F.concat(head(r), r["content"], F.lit(END))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, size: bigint>>").alias("spans"))

    def step(state: Column, r: Column) -> Column:
        start = state["at"] + F.length(head(r))
        span = F.struct(start.cast("long").alias("start"), F.length(r["content"]).cast("long").alias("size"))
        spans = F.when(r["trained"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + F.length(whole(r))).cast("long").alias("at"), spans.alias("spans"))

    spans = F.aggregate("rows", zero, step, lambda s: s["spans"])
    return got.select(
        "conv_id",
        "block",
        F.array_join(F.transform("rows", whole), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.flatten(F.transform("rows", lambda r: r["attachments"])).alias("attachments"),
    ).withColumn("media_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation: formatted, loss_spans over the whole text, attachments, media_tokens."""
    blocks = format_blocks(turns).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "formatted", "loss_spans", "attachments", "media_tokens"))).alias("b"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<start: bigint, size: bigint>>>").alias("spans"))

    def step(state: Column, b: Column) -> Column:
        moved = F.transform(b["loss_spans"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), s["size"].alias("size")))
        return F.struct((state["at"] + F.length(b["formatted"])).cast("long").alias("at"), F.concat(state["spans"], F.array(moved)).alias("spans"))

    return blocks.select(
        "conv_id",
        F.array_join(F.transform("b", lambda x: x["formatted"]), "").alias("formatted"),
        F.flatten(F.aggregate("b", zero, step, lambda s: s["spans"])).alias("loss_spans"),
        F.flatten(F.transform("b", lambda x: x["attachments"])).alias("attachments"),
        F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x["media_tokens"]).alias("media_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text) with escapes undone."""
    pieces = F.slice(F.split(formatted, r"<\|im_end\|>\n"), 1, F.size(F.split(formatted, r"<\|im_end\|>\n")) - 1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = F.substring(piece, F.length(role) + 2, F.length(piece))
        name = F.substring(role, F.lit(len(START) + 1), F.length(role))
        return F.struct(unescape(F.replace(name, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, span by span, with escapes undone."""
    cut = lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["size"].cast("int")))
    return F.array_join(F.transform(spans, cut), "")


def digest(turns: DataFrame) -> DataFrame:
    """What can be read back from format_blocks(), by conversation. Null ids are one conversation, null texts and roles
    empty; repeated rows stay, equal turns go by role and text; an empty table gives no rows."""
    read = format_blocks(turns).select("conv_id", "block", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    parts = read.select(
        "conv_id",
        F.struct(
            "block",
            F.size("turns").cast("long").alias("n"),
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
            "loss",
            F.length("formatted").cast("long").alias("chars"),
        ).alias("part"),
    )
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("p"))
    join = lambda name: F.array_join(F.transform("p", lambda x: x[name]), "")
    total = lambda name: F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x[name])
    return whole.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(join("said"), 256).alias("turns_sha256"),
        F.length(join("loss")).cast("long").alias("loss_chars"),
        F.sha2(join("loss"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )
