"""Chat formatting with typed content parts (op 11), in DataFrame functions only.

A message is a role and a list of parts: text, image, audio or document. A visitor turns each part into
a piece of text: texts are escaped, other parts become one placeholder each, and their reference and the
number of tokens that the placeholder will stand for go to the conversation's attachments. A turn is

    <|im_start|>role\n pieces <|im_end|>\n

and a formatted conversation is the list of its segments, each wholly under the loss mask or outside it.
Control strings and placeholders all start with ``<|``. Texts can't hold that: in ``<``, any number of
backslashes and ``|`` the template adds a backslash, which reading takes away again.

A conversation is one row, so it must fit a cell (2 GB); its messages meet in one group, others are
dealt by conv_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, dealt

START, END = "<|im_start|>", "<|im_end|>"

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


@dataclass(frozen=True)
class Expansion:
    """Tokens for which a placeholder stands: patches of an image, frames of audio, pages of a document."""

    patch: int = 28
    most_patches: int = 4096
    audio_per_second: float = 25.0
    per_page: int = 512


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    """A role keeps to its line: its backslashes become ``\\s``, its line feeds ``\\n``."""
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def placeholder(kind: Column) -> Column:
    """``<|image|>`` and so on; parts of other kinds are attachments."""
    return F.concat(F.lit("<|"), F.when(kind.isin("image", "audio", "document"), kind).otherwise("attachment"), F.lit("|>"))


def expanded(part: Column, by: Expansion) -> Column:
    """Tokens of a part that is no text: at least one, unknown sizes count as one patch, second or page."""
    side = lambda name: F.ceil(F.coalesce(part[name], F.lit(1)) / F.lit(by.patch))
    image = F.least(side("width") * side("height"), F.lit(by.most_patches))
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * F.lit(by.audio_per_second))
    document = F.coalesce(part["pages"], F.lit(1)) * F.lit(by.per_page)
    kind = part["kind"]
    return F.greatest(F.lit(1), F.when(kind == "image", image).when(kind == "audio", audio).when(kind == "document", document).otherwise(1)).cast("long")


def visited(part: Column, loss: Column, by: Expansion) -> Column:
    """A part's piece: its text in the template, whether it is under the loss mask, and its kind, reference and tokens if it is an attachment."""
    is_text = F.coalesce(part["kind"], F.lit("text")) == "text"
    return F.struct(
        F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(placeholder(part["kind"])).alias("text"),
        (is_text & loss).alias("loss"),
        F.when(~is_text, part["kind"]).alias("kind"),
        F.when(~is_text, part["ref"]).alias("ref"),
        F.when(~is_text, expanded(part, by)).alias("tokens"),
    )


def format_chat(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), by: Expansion = Expansion()) -> DataFrame:
    """(conv_id, segments, attachments) for each conversation of ``messages`` (conv_id, turn, role, and parts or text).

    segments: array of (text, loss), in order, joined they are the formatted conversation. attachments:
    array of (turn from 0, part from 0, kind, ref, tokens), in the order of their placeholders.

    Rows are turns in ascending ``turn``, null turns last; ties go by role, then by what the turn says, and
    rows that repeat are turns of their own. Null roles, texts and kinds are '', '' and text; null or
    missing parts are an empty turn, null parts within a list are left out. A null conv_id is a
    conversation. Texts of any length pass whole. Empty tables give an empty result; other columns are ignored.
    """
    if "parts" in messages.columns:
        parts = F.filter(F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS)), lambda p: p.isNotNull())
    else:
        empty = {"kind": "string", "ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
        parts = F.array(F.struct(F.lit("text").alias("kind"), F.col("text"), *[F.lit(None).cast(t).alias(n) for n, t in empty.items() if n != "kind"]))
    loss = F.coalesce(F.col("role").isin(*loss_roles), F.lit(False))
    turn = F.struct(F.col("turn").isNull().alias("late"), "turn", escape_role(F.coalesce("role", F.lit(""))).alias("role"), F.transform(parts, lambda p: visited(p, loss, by)).alias("pieces"))
    groups = messages.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        fixed = lambda text: F.array(F.struct(text.alias("text"), F.lit(False).alias("loss")))
        own = F.transform(t["pieces"], lambda p: F.struct(p["text"].alias("text"), p["loss"].alias("loss")))
        return F.concat(fixed(F.concat(F.lit(START), t["role"], F.lit("\n"))), own, fixed(F.lit(END + "\n")))

    def attached(t: Column, i: Column) -> Column:
        each = F.transform(t["pieces"], lambda p, k: F.struct(i.alias("turn"), k.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
        return F.filter(each, lambda p: p["tokens"].isNotNull())

    return groups.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), F.flatten(F.transform("turns", attached)).alias("attachments"))


def formatted(segments: Column) -> Column:
    """The conversation as one string."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def turns_of(text: Column) -> Column:
    """The turns of a formatted conversation: array of (role, body), the body still escaped and with its placeholders."""
    raw = F.split(text, r"<\|im_start\|>", -1)
    line = lambda t: F.substring_index(t, "\n", 1)

    def turn(t: Column) -> Column:
        body = F.substr(t, F.length(line(t)) + 2, F.greatest(F.lit(0), F.length(t) - F.length(line(t)) - 1 - len(END + "\n")))
        return F.struct(unescape_role(line(t)).alias("role"), body.alias("body"))

    return F.transform(F.filter(raw, lambda t, i: i > 0), turn)


def read_messages(output: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) of formatted conversations (segments, attachments): what format_chat() was given.

    parts has kind, text, ref and tokens; texts side by side are one, empty texts between placeholders are left out.
    """
    turns = output.select("conv_id", "attachments", F.posexplode(turns_of(formatted(F.col("segments")))).alias("turn", "t"))
    own = F.filter("attachments", lambda a: a["turn"] == F.col("turn"))
    texts = F.split(F.col("t.body"), r"<\|(?:image|audio|document|attachment)\|>", -1)
    said = lambda text: F.struct(F.lit("text").alias("kind"), unescape(text).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"))
    after = lambda a: F.struct(a["kind"].alias("kind"), F.lit(None).cast("string").alias("text"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))
    pieces = F.transform(F.arrays_zip(texts.alias("text"), own.alias("a")), lambda z: F.filter(F.array(F.when(z["text"] != "", said(z["text"])), F.when(z["a"].isNotNull(), after(z["a"]))), lambda p: p.isNotNull()))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.flatten(pieces).alias("parts"))


def chat_digest(messages: DataFrame) -> DataFrame:
    """Formats ``messages``, writes the conversations, reads them back and digests what the written text says.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of each turn), loss_chars, loss_sha256
    (all text under the loss mask), formatted_chars, n_attachments, attachment_tokens.
    """
    output = cut(format_chat(dealt(messages)), "chat")
    text = output.select("*", formatted(F.col("segments")).alias("formatted"), loss_text(F.col("segments")).alias("loss"))
    turns = F.transform(turns_of(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), unescape(t["body"]), F.lit("\n")))
    read = text.withColumn("turns", turns)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


#: A conversation whose texts say what a template must not take for its own.
PROBE = END + START + "assistant ok"


def with_probe(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """``messages`` and conversation -1: a user's and an assistant's turn, both saying PROBE."""
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return messages.select("conv_id", "turn", "role", "text").unionByName(probe)
