"""Rows as they travel: narrow nodes, decoded decisions, messages, and ids that sort by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import DECISION_DATA

#: Fixed value: Crockford's base 32.
DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def wire_nodes(nodes: DataFrame) -> DataFrame:
    """(id, kind, name, qualified_name, file_path, tier, status, data); data that is no JSON object is empty."""
    parsed = F.from_json("data", "map<string,string>")
    return nodes.select("id", "kind", "name", "qualified_name", "file_path", "tier", parsed["status"].alias("status"), F.when(parsed.isNull(), "{}").otherwise(F.col("data")).alias("data"))


def decisions(nodes: DataFrame) -> DataFrame:
    """Decisions with the fields of their JSON, in place of missing ones the defaults."""
    d = F.from_json("data", DECISION_DATA)
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = nodes.where("kind = 'decision'")
    alternatives = F.coalesce(d.alternatives, F.array().cast("array<struct<name:string,reason_rejected:string>>"))
    return rows.select("id", F.col("name").alias("title"), text(d.description).alias("description"), text(d.rationale).alias("rationale"), alternatives.alias("alternatives"), "tier", F.coalesce(d.status, F.lit("active")).alias("status"), d.superseded_by.alias("superseded_by"), d.created_by.alias("created_by"), "created_at", "updated_at")


def encode_messages(rows: DataFrame, kind: str) -> DataFrame:
    """A JSON message of a kind for each row."""
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), *rows.columns)).alias("message"))


def decode_client(message: Column) -> Column:
    """What a client asks: its type, and before_id and limit of a backfill; null for anything else."""
    parsed = F.from_json(message, "type string, before_id string, limit int")
    return F.when(parsed["type"].isin("ping", "backfill"), parsed)


def ulid(millis: Column, number: Column) -> Column:
    """26 digits that sort by time, then by number: 48 bits of milliseconds and 80 bits of which number fills the low 63."""

    def digits(value: Column, count: int) -> Column:
        places = F.transform(F.sequence(F.lit(count - 1), F.lit(0), F.lit(-1)), lambda k: F.substring(F.lit(DIGITS), F.call_function("shiftright", value, k * 5).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)))
        return F.array_join(places, "")

    return F.concat(digits(millis.cast("long"), 10), F.lit("000"), digits(number.cast("long"), 13))


def next_stamp(existing: Column) -> Column:
    """Now, at least a millisecond after what there was."""
    return F.greatest(F.current_timestamp(), existing + F.expr("interval 1 millisecond"))


def latest(log: DataFrame) -> DataFrame:
    """(key, value) of a log (seq, key, value): the last value of each key."""
    return log.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def escape_html(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text
