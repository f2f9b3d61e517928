"""Mixing sources to target weights by entropy balancing.

Each source's documents get the rates nearest to taking each once, by relative entropy, that take as
many words as the source's target says and no document more than ``MOST`` times. Such rates are
exponentially tilted: ``min(MOST, exp(tilt * size))``, where the tilt is the dual variable of the
source's token constraint. Newton's iterations on the convex dual find it, with sums over the
documents as Spark jobs. Rates are rounded into copies by the running sum of each source's documents
from the largest, so that roundings cannot add up to more than half of one document, and the words
still missing or too many then come from documents of the size that fits best.

Only DataFrame functions are used.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpoint, written

#: Weights of the sources in order, repeating; most copies of a document; documents ranked in one task.
WEIGHTS, MOST, RANKED = (1, 2, 3), 3, 2_000
#: Most iterations, and the share of the target from which a source counts as balanced.
ITERATIONS, PRECISE = 60, 1e-9
#: How often at most missing words are taken from a size of documents.
REPAIRS = 8


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (the source, telling null apart), size in words and a hash of the row that ranks it."""
    source, text = F.col("source").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    count = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"),
        count.cast("long").alias("size"), F.xxhash64("doc_id", text).alias("rank_hash"),
    )


def targets(sized: DataFrame) -> DataFrame:
    """key, source_size and target of each source.

    Targets are a level times the weight, at most MOST times the source's size. Sources in the order
    of size against weight reach that limit first, so the level follows from running sums: what the
    limited ones leave, shared by the weights of the others. These are rows of sources, not documents.
    """
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(number, F.lit(len(WEIGHTS))) + 1).cast("double")
    rows = sources.withColumn("weight", weight).withColumn("limit", MOST * F.col("source_size").cast("double"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, all_rows = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    rows = rows.withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("left") / F.sum("weight").over(after))
    free = F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.col("level"))
    rows = rows.withColumn("level", F.coalesce(F.max(free).over(all_rows), F.lit(0.0)))
    return rows.select("key", "source_size", F.least("limit", F.col("level") * F.col("weight")).alias("target"))


def tilted(tilt: Column, size: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(tilt * size))


def balance(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """counts: (key, size, n) of documents with words. Gives (key, tilt).

    A source's words are an increasing function of its tilt, and its smallest document bounds the tilt
    that meets the target; a step that leaves the bounds, which close in, goes to their middle.
    """
    least = counts.groupBy("key").agg(F.min("size").alias("least"))
    share = F.col("target") / F.col("source_size")
    low, high = F.least(F.lit(0.0), F.ln(share) / F.col("least")), F.when(share > 1, log(MOST) / F.col("least")).otherwise(0.0)
    now = wanted.where("source_size > 0").join(least, "key").select("key", "target", low.alias("low"), high.alias("high"), F.lit(0.0).alias("tilt"))
    now = written(now)
    for _ in range(ITERATIONS):
        each = counts.join(now, "key").withColumn("rate", tilted(F.col("tilt"), F.col("size")))
        words = F.col("n") * F.col("size") * F.col("rate")
        slope = F.when(F.col("rate") < MOST, words * F.col("size")).otherwise(0.0)
        # a source's own columns come along, so that they need not be joined again
        own = [F.first(c).alias(c) for c in ("target", "low", "high", "tilt")]
        sums = each.groupBy("key").agg(*own, F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        over = F.col("words") - F.col("target")
        step = sums.withColumn("miss", F.abs(over) / F.col("target"))
        step = step.withColumn("low", F.when(over < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(over > 0, F.col("tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") - F.try_divide(over, F.col("slope"))
        inside = (newton >= F.col("low")) & (newton <= F.col("high"))
        moved = F.when(F.col("miss") <= PRECISE, F.col("tilt")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        now = written(step.select("key", "target", "low", "high", moved.alias("tilt"), "miss"))
        if now.where(F.col("miss") > PRECISE).isEmpty():
            break
    return now.select("key", "tilt")


def rounded(counts: DataFrame, tilts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, size, n, rate, copies): how many copies all documents of a source and size get together.

    Sizes of a source are at most as many as its longest document has words.
    """
    from_largest = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    rates = counts.join(tilts, "key").withColumn("rate", tilted(F.col("tilt"), F.col("size")))
    upto = F.sum(F.col("n") * F.col("rate")).over(from_largest)
    made = rates.withColumn("upto", upto).withColumn("copies", F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - F.col("n") * F.col("rate") + 0.5))
    limit = MOST * F.col("n")
    made = made.join(wanted.select("key", "target"), "key")
    made = written(made.select("key", "size", "n", "rate", F.least(F.greatest("copies", F.lit(0)), limit).alias("copies"), "target"))
    for _ in range(REPAIRS):
        missing = made.groupBy("key").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("missing"))
        more = F.greatest(F.least(F.round(F.col("missing") / F.col("size")), limit - F.col("copies")), -F.col("copies")).cast("long")
        tried = made.join(missing, "key").withColumn("more", more).where("more <> 0")
        left = F.abs(F.col("missing") - F.col("more") * F.col("size"))
        best = tried.withColumn("left", left).where(F.col("left") < F.abs("missing")).groupBy("key").agg(F.min(F.struct("left", "size", "more")).alias("best"))
        best = written(best.select("key", "best.size", "best.more"))
        if best.isEmpty():
            break
        made = written(made.join(best, ["key", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more"))
    return made.drop("target")


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies, taken, rate.

    Null and empty texts have size 0 and are not copied. Null sources are one source, in order the
    last. Repeated rows each count; a null doc_id stays null. Without rows or words nothing is taken.
    The same rows give the same copies in any run. Other columns are ignored.

    Of the documents of one source and size all get the whole part of their mean copies, and those
    first by hash one more. They are ranked in parts of bounded length, each of which is due its share.
    """
    sized = checkpoint(sizes(docs))
    wanted = written(targets(sized))
    counts = written(sized.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")))
    made = rounded(counts, balance(counts, wanted), wanted)

    each = made.select("key", "size", "n", "rate", F.floor(F.col("copies") / F.col("n")).alias("all"), F.pmod("copies", "n").alias("extra"), F.ceil(F.col("n") / RANKED).alias("parts"))
    placed = sized.where("size > 0").join(each, ["key", "size"]).withColumn("part", F.pmod(F.xxhash64("rank_hash"), "parts"))
    parts = placed.groupBy("key", "size", "part").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("extra").alias("extra"))
    upto = F.sum("m").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    due = F.floor(F.col("upto") * F.col("extra") / F.col("n")) - F.floor((F.col("upto") - F.col("m")) * F.col("extra") / F.col("n"))
    due = parts.withColumn("upto", upto).select("key", "size", "part", due.alias("due"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("rank_hash", "doc_id"))
    ranked = placed.withColumn("rank", rank).join(due, ["key", "size", "part"])
    taking = ranked.select("doc_id", "key", "size", "rate", (F.col("all") + F.when(F.col("rank") <= F.col("due"), 1).otherwise(0)).cast("long").alias("copies"))
    none = sized.where("size = 0").select("doc_id", "key", "size", F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("copies"))
    out = taking.unionByName(none).join(wanted.select("key", "source_size", "target"), "key")
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "rate")
