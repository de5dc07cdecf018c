"""Chat formatting with typed content parts, in DataFrame functions only.

A message is an array of typed parts (text, image, audio, document). A visitor, one branch a kind, flattens the parts
in order into the message's body: text is escaped, the others become placeholders, and each attachment is recorded
with its reference and the number of tokens that its placeholder stands for. Messages are framed by control strings;
a run-length loss mask covers the bodies of the assistant's messages.

Escaping is reversible: "\\" becomes "\\0" and "<|" becomes "\\1", so no control string survives inside a text; roles
also escape line breaks.

Cases: null role or text counts as empty; messages of one conversation that share a turn are ordered by role, then
text; null turns come first. An empty table gives an empty result; extra columns are ignored. A conversation is one
output string and so must fit into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Placeholder of each kind of attachment, and the tokens it expands to for each unit (tile, second, page).
ATTACHMENTS = {"image": ("<|image|>", 256), "audio": ("<|audio|>", 25), "document": ("<|document|>", 512)}
LOSS_ROLE = "assistant"
PART = "struct<kind:string,text:string,ref:string,units:double>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit("<|"), F.lit("\\1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\1"), F.lit("<|")), F.lit("\\0"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\2"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\2"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """A message of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def _visit(part: Column) -> Column:
    out = F.lit("")
    for kind, (placeholder, _) in ATTACHMENTS.items():
        out = F.when(part["kind"] == kind, F.lit(placeholder)).otherwise(out)
    return F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(out)


def _tokens(part: Column) -> Column:
    rate = F.lit(0)
    for kind, (_, per_unit) in ATTACHMENTS.items():
        rate = F.when(part["kind"] == kind, F.lit(per_unit)).otherwise(rate)
    return F.ceil(F.coalesce(part["units"], F.lit(1.0)) * rate).cast("long")


def flatten_parts(parts: Column) -> Column:
    """The body of a message: its parts' texts and placeholders in order."""
    return F.array_join(F.transform(parts, _visit), "")


def attachments_of(parts: Column) -> Column:
    """array<struct<kind, ref, tokens>> of a message, in order."""
    kept = F.filter(parts, lambda p: p["kind"].isin(*ATTACHMENTS))
    return F.transform(kept, lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))


def format_chats(messages: DataFrame) -> DataFrame:
    """messages: conv_id, turn, role, parts. Returns conv_id, formatted, mask, attachments, attachment_tokens.

    mask has three runs a message (header, body, footer), each with its characters and whether the loss covers it.
    """
    role = F.coalesce("role", F.lit(""))
    rows = messages.select("conv_id", F.struct(
        "turn", role.alias("role"), flatten_parts(F.col("parts")).alias("body"), attachments_of(F.col("parts")).alias("attached"),
    ).alias("m"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    header = lambda m: F.concat(F.lit(START), _escape_role(m["role"]), F.lit("\n"))
    run = lambda text, loss: F.struct(F.length(text).alias("chars"), loss.alias("loss"))
    footer, never = F.lit(END + "\n"), F.lit(False)
    attached = F.flatten(F.transform("ms", lambda m: m["attached"]))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("ms", lambda m: F.concat(header(m), m["body"], footer)), "").alias("formatted"),
        F.flatten(F.transform("ms", lambda m: F.array(run(header(m), never), run(m["body"], m["role"] == LOSS_ROLE), run(footer, never)))).alias("mask"),
        attached.alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, loss_texts array<string>, read from formatted and mask alone."""
    framed = chats.withColumn("frames", F.split("formatted", r"<\|im_end\|>\n"))
    framed = framed.withColumn("frames", F.slice("frames", 1, F.size("frames") - 1))
    head = lambda f: F.substring_index(f, "\n", 1)
    turns = F.transform("frames", lambda f: F.struct(
        _unescape_role(F.substr(head(f), F.lit(len(START) + 1))).alias("role"),
        unescape(F.substr(f, F.length(head(f)) + 2)).alias("text"),
    ))
    under = F.transform("frames", lambda f, k: F.when(F.get("mask", 3 * k + 1)["loss"], F.substr(f, F.get("mask", 3 * k)["chars"] + 1, F.get("mask", 3 * k + 1)["chars"])))
    return framed.select("conv_id", "formatted", turns.alias("turns"), F.transform(F.filter(under, lambda t: t.isNotNull()), unescape).alias("loss_texts"))
