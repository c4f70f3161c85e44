"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are context, and only
that reply is trainable. A conversation that does not end with an assistant turn gives one more
example, without a trainable part, so that its last turns are not lost.

Template. A context turn is `[INST]role` + newline + text + `[/INST]`, with the role
percent-encoded; an assistant turn is `<s>` + text + `</s>`. In a text, a control string gets a
backslash after its first character (`</s>` becomes `<\\/s>`), and one that has backslashes there
gets one more, so that the escape can be undone without loss.

A conversation is one group because its examples are; the examples are made row by row from the
array of its turns, never as one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
_ESCAPE = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_UNESCAPE = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    """One turn in the template."""
    body = escape(text)
    return F.when(role == ASSISTANT, F.concat(F.lit("<s>"), body, F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST]"), F.url_encode(role), F.lit("\n"), body, F.lit("[/INST]")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Examples of a table (conv_id, turn, role, text).

    Columns: conv_id, example (from 0), n_turns (of the conversation), is_last, text,
    loss_start and loss_length (code points of the trainable reply without its marks; length 0 at
    the end of the text where nothing is trainable). Null texts and roles are empty; a role other than
    `assistant` is context. Turns are ordered by turn, nulls first; ties and repeated rows all
    stay, ordered by role and text. Rows with a null conv_id form one conversation. Other columns
    are not read. An empty table gives no example.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    ordered = turns.select(
        F.col("conv_id"), F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    grouped = ordered.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    pieces = grouped.select(
        "conv_id", F.size("ts").alias("n"),
        F.transform("ts", lambda t: render(t["role"], t["text"])).alias("pieces"),
        F.filter(F.transform("ts", lambda t, i: F.when((t["role"] == ASSISTANT) | (i == F.size("ts") - 1), i + 1)),
                 lambda i: i.isNotNull()).alias("ends"))
    rows = pieces.select("conv_id", "n", "pieces", F.posexplode("ends").alias("example", "end"))
    target = F.element_at("pieces", F.col("end"))
    trained = target.startswith("<s>")
    built = rows.select(
        "conv_id", "example", F.col("n").cast("long").alias("n_turns"), (F.col("end") == F.col("n")).alias("is_last"),
        F.array_join(F.slice("pieces", F.lit(1), F.col("end")), "").alias("text"),
        F.when(trained, F.length(target) - 7).otherwise(0).alias("loss_length"), trained.alias("trained"))
    return built.select(
        "conv_id", "example", "n_turns", "is_last", "text",
        F.when(F.col("trained"), F.length("text") - F.col("loss_length") - 4).otherwise(F.length("text")).alias("loss_start"),
        "loss_length")


def loss_text(examples_text: Column, start: Column, length: Column) -> Column:
    """The trainable reply of an example, unescaped."""
    return unescape(F.substring(examples_text, start + 1, length))


def parse(text: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    parts = F.filter(F.split(text, r"(?<=\[/INST\]|</s>)"), lambda p: F.length(p) > 0)

    def turn(p: Column) -> Column:
        reply = p.startswith("<s>")
        head = F.substring_index(p, "\n", 1)
        return F.struct(
            F.when(reply, F.lit(ASSISTANT)).otherwise(F.url_decode(F.substring(head, F.lit(7), F.length(head)))).alias("role"),
            unescape(F.when(reply, F.substring(p, F.lit(4), F.length(p) - 7)).otherwise(
                F.substring(p, F.length(head) + 2, F.length(p) - F.length(head) - 8))).alias("text"))

    return F.transform(parts, turn)


def conversation_digest(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, loss and length, as counts and digests."""
    turns = F.when(F.col("is_last"), parse(F.col("text")))
    whole = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id", F.length("text").alias("chars"), F.size(turns).alias("n"), F.sha2(whole, 256).alias("turns_sha256"),
        F.struct("example", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_length")).alias("loss")).alias("part"))
    summed = read.groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        F.sum("chars").cast("long").alias("formatted_chars"), F.array_sort(F.collect_list("part")).alias("parts"))
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return summed.select(
        "conv_id", "n_turns", "turns_sha256", F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
