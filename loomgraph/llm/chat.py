"""Chat formatting with a grammar round trip.

A conversation is written as turns, each with marks of its role, after a header that names its
escaping. It is parsed again by splitting at the marks; where the turns read back differ from those
written, the conversation is written once more with every text escaped, which no text can break. That
is parsed and compared too; a conversation that still differed would fail the job, not pass unnoticed.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks. A turn of a role of its own kind is opened by its name.
PLAIN, ESCAPED, OPEN, CLOSE, END = "<s>", "<s escaped>", "[INST ", "]", "[/INST]</s>"
#: What ends a text for the parser, wherever it stands.
ANY = r"\[INST |\[/INST\]|<s>|<s escaped>|</s>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    """No mark can occur in the result: every backslash, ``[`` and ``<`` becomes a backslash and a letter."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("["), F.lit("\\o")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\o"), F.lit("[")), F.lit("\\l"), F.lit("<"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("]"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit("]")))


def _after(text: Column, mark: str) -> Column:
    return F.when(F.instr(text, mark) > 0, F.substr(text, F.instr(text, mark) + F.lit(len(mark)))).otherwise(F.lit(""))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    escaped = F.startswith(formatted, F.lit(ESCAPED))
    body = F.when(escaped, F.substr(formatted, F.lit(len(ESCAPED) + 1))).otherwise(F.substr(formatted, F.lit(len(PLAIN) + 1)))
    parts = F.split(body, "\\Q" + END + "\\E", -1)
    turns = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        name = F.substring_index(F.substr(part, F.lit(len(OPEN) + 1)), CLOSE, 1)
        text = F.split(_after(part, CLOSE), ANY, 2)[0]
        return F.struct(unescape_role(name).alias("role"), F.when(escaped, unescape(text)).otherwise(text).alias("text"))

    return F.transform(turns, turn)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, escaped, n_turns.

    turns has conv_id, turn, role and text; a conversation's rows are ordered by turn, role and text.
    loss_spans are the places (from, length; code points from 1) of the assistant's texts in
    formatted, as they stand there. A null text is empty, as is a null role; null turns come first; a
    null conv_id is a conversation of its own. Repeated rows are turns like others. No rows give no
    conversations. A conversation is one row of the result, so it must fit in one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    order = F.struct("turn", "role", "text")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(order)).alias("turns"))

    def written(escaping: bool) -> Column:
        def one(t: Column) -> Column:
            return F.concat(F.lit(OPEN), escape_role(t.role), F.lit(CLOSE), escape(t.text) if escaping else t.text, F.lit(END))

        return F.concat(F.lit(ESCAPED if escaping else PLAIN), F.concat_ws("", F.transform("turns", one)))

    source = F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    plain = chats.withColumn("plain", written(False)).withColumn("escaped", parse(F.col("plain")) != source)
    written_out = plain.withColumn("formatted", F.when(F.col("escaped"), written(True)).otherwise(F.col("plain"))).drop("plain")
    differs = F.raise_error(F.concat(F.lit("not read back as written: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    out = written_out.withColumn("formatted", F.when(~F.col("escaped") | (parse(F.col("formatted")) == source), F.col("formatted")).otherwise(differs.cast("string")))
    return out.withColumn("loss_spans", _loss_spans()).withColumn("n_turns", F.size("turns").cast("long")).drop("turns")


def _loss_spans() -> Column:
    """Places of assistants' texts, from the lengths of all turns as written."""
    shown = lambda t: F.length(F.when(F.col("escaped"), escape(t.text)).otherwise(t.text))
    sized = F.transform(
        "turns",
        lambda t: F.struct(
            (F.length(escape_role(t.role)) + F.lit(len(OPEN) + len(CLOSE))).alias("before"), shown(t).alias("size"), (t.role == ASSISTANT).alias("loss")
        ),
    )
    start = F.struct(F.when(F.col("escaped"), F.lit(len(ESCAPED) + 1)).otherwise(F.lit(len(PLAIN) + 1)).alias("at"), F.array().cast("array<struct<at:int,size:int>>").alias("spans"))

    def add(done: Column, t: Column) -> Column:
        at = done.at + t.before
        spans = F.when(t.loss, F.concat(done.spans, F.array(F.struct(at.alias("at"), t.size.alias("size"))))).otherwise(done.spans)
        return F.struct((at + t.size + F.lit(len(END))).alias("at"), spans.alias("spans"))

    return F.aggregate(sized, start, add, lambda done: done.spans)


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from the formatted text and its spans."""
    turns = parse(F.col("formatted"))
    said = F.concat_ws("", F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    cut = F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), s.at, s["size"]))
    loss = F.concat_ws("", F.transform(cut, lambda t: F.when(F.col("escaped"), unescape(t)).otherwise(t)))
    return formatted.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
    )
