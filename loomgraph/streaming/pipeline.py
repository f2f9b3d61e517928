"""The event pipeline as a structured stream: persist, derive, hand on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType

from ..operators.events import append_new, derive
from ..sources.schema import EVENTS

#: Digits at the end of an id that do not tell the range of the log that it lies in: of an id by time, some 17 minutes are a range.
TAIL = 20
#: Ranges of the log that are named one by one; a batch that touches more reads what lies between its first and last.
NAMED = 1000
#: Ranges that a batch is written to, about: one that touches more is written to wider ones, of fewer first digits.
WRITTEN = 256
#: Numbers of first digits that a wider range can have, and what stands after them in its name.
WIDTHS, WIDE = range(1, 13), "~"


def id_range(event: Column | str) -> Column:
    """The range of the log in which an event id lies; short ids all lie in one."""
    event = F.col(event) if isinstance(event, str) else event
    return F.when(F.length(event) > TAIL, F.left(event, F.length(event) - TAIL)).otherwise("short")


def written_ranges(rows: DataFrame) -> Column:
    """The ranges to which a batch is written: those of its ids, or where they are more than WRITTEN, the narrowest wider ones that are not.

    A wider range is named by its first digits and WIDE, which no number ends with.
    """
    own = id_range("id")
    counts = rows.agg(F.approx_count_distinct(own), *(F.approx_count_distinct(F.left(own, F.lit(k))) for k in WIDTHS)).first()
    if counts[0] <= WRITTEN:
        return own
    width = max((k for k, n in zip(WIDTHS, counts[1:], strict=True) if n <= WRITTEN), default=WIDTHS[0])
    return F.when(own == "short", own).otherwise(F.concat(F.left(own, F.lit(width)), F.lit(WIDE)))


def _around(ranges: list[str]) -> set[str]:
    """The wider ranges in which ranges lie."""
    return {r[:k] + WIDE for r in ranges for k in WIDTHS}


def touched(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The part of a log (partitioned by range) in which ids of rows can lie: other ranges' files are not read."""
    ranges = rows.select(id_range("id").alias("range")).distinct()
    some = [r.range for r in ranges.limit(NAMED + 1).collect()]
    text = log.schema["range"].dataType == StringType()  # ranges that were read as numbers have no wider ones among them
    if len(some) <= NAMED:
        return log.where(F.col("range").isin(sorted({*some, *(_around(some) if text else ())})))
    first, last = ranges.agg(F.min("range"), F.max("range")).first()
    between = F.col("range").between(first, last)
    # of the wider ranges, only those around the first or the last can lie outside
    return log.where(between | F.col("range").isin(sorted(_around([first, last]))) if text else between)


def in_order(events: DataFrame, mutations: DataFrame) -> DataFrame:
    """(seq, pos, type, body) of what goes out: each event, at pos -1, and then the mutations that it stands for."""
    told = events.select(F.col("id").cast("string").alias("seq"), F.lit(-1).alias("pos"), F.lit("event").alias("type"), F.to_json(F.struct(*events.columns)).alias("body"))
    made = mutations.select(F.col("seq").cast("string").alias("seq"), "pos", F.lit("mutation").alias("type"), F.to_json(F.struct(*(c for c in mutations.columns if c not in ("seq", "pos")))).alias("body"))
    return told.unionByName(made).orderBy("seq", "pos")


def read_events(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Events as they arrive in JSON files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).json(folder)


def run_pipeline(events: DataFrame, nodes: Callable[[], DataFrame], log: str, mutations: str, checkpoint: str, hand_on: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append each batch's new events to the log and what they derive to the mutations, then hand on both, in order.

    nodes gives the current state at the time of the batch. Rows carry their batch, and a batch that
    is run again replaces what it wrote before, so events and mutations are stored once. The log is partitioned by
    range of ids, wider ones for a large batch, and a batch looks for its ids only in the ranges that they lie in, however long the log is.
    """
    spark = events.sparkSession
    stored = spark.createDataFrame([], EVENTS + ", batch long, range string").schema

    def persist(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(["id"])
        try:
            earlier = touched(spark.read.schema(stored).parquet(log), rows).where(F.col("batch") != number)
            rows = append_new(earlier, rows)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        rows = rows.persist()
        try:
            derived = derive(rows, nodes())
            ranged = rows.withColumns({"batch": F.lit(number).cast("long"), "range": written_ranges(rows)})
            # a batch has a folder of its own in every range it touches, with a file or more of a large one; run again, it replaces these
            ranged.hint("rebalance", "range").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("range", "batch").parquet(log)
            derived.write.mode("overwrite").parquet(f"{mutations}/batch={number}")
            if hand_on:
                hand_on(in_order(rows, derived), number)
        finally:
            rows.unpersist()

    return events.writeStream.foreachBatch(persist).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, count) of events by time of creation, each id once; for a stream or a batch."""
    timed = events.withColumn("time", F.timestamp_millis("created_at"))
    if events.isStreaming:
        timed = timed.withWatermark("time", late).dropDuplicatesWithinWatermark(["id"])
    else:
        timed = timed.dropDuplicates(["id"])
    return timed.groupBy(F.window("time", length).alias("w"), "kind").agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), "kind", "count")
