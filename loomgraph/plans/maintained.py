"""A projection's edges kept up to date: a change of the graph changes the counts of the pairs that it touches, and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.buckets import BUCKETS, Buckets
from ..sources.session import checkpoint, tidy
from .projection import counted_pairs, shaped

_EDGE = ["source_id", "target_id", "relation"]
_PAIR = [*_EDGE, "raw"]
_END = ["node", "other", "relation", "out"]
#: Ends of edges to one that has changed, below which the changes are written into the ends.
FEW = 8


class EdgeView:
    """Edges between representatives as counts by pair, in buckets, beside each node's representative and edges.

    Edges are a set. ``apply`` takes edges that come and go and new representatives (null: a node that is not shown
    any more). It reads the buckets of what has changed and rewrites the buckets that it changes. Edges are kept at both
    ends (``incident``), and those that have come or gone since beside them (``changes``), so that a few do not write all anew.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark = spark
        self.reps = Buckets(spark, f"{folder}/reps", "id string, rep string", ("id",), buckets)
        self.incident = Buckets(spark, f"{folder}/incident", "node string, other string, relation string, out boolean", ("node",), buckets)
        self.changes = Buckets(spark, f"{folder}/changes", "node string, other string, relation string, out boolean, there boolean", ("node",), buckets)
        self.counts = Buckets(spark, f"{folder}/counts", "source_id string, target_id string, relation string, raw boolean, n long", ("source_id", "target_id"), buckets)

    def start(self, edges: DataFrame, representative: DataFrame) -> EdgeView:
        """The view of a whole graph: edges (source_id, target_id, relation) and representatives (id, rep)."""
        every = list(range(self.reps.number))
        with tidy(self.spark):
            self.reps.replace(representative, every)
            self.incident.replace(_by_node(edges.select(*_EDGE).distinct()), every)
            if self.changes.live():
                self.changes.replace(self.changes.read([]), every)
            self.counts.replace(counted_pairs(_edges(self.incident.read().where("out")), self.reps.read()), every)
        return self

    def apply(self, added: DataFrame, removed: DataFrame, representative: DataFrame) -> DataFrame:
        """Take in a change; gives the pairs (source_id, target_id) whose counts it changed."""
        with tidy(self.spark):
            return self._apply(added, removed, representative)

    def _apply(self, added: DataFrame, removed: DataFrame, representative: DataFrame) -> DataFrame:
        said = representative.select("id", F.col("rep").alias("new"))
        old = self.reps.read(self.reps.touched(said, "id"))
        moved = checkpoint(said.join(old, "id", "left").where(~F.col("new").eqNullSafe(F.col("rep"))).select("id", "new"))
        at_nodes = moved.select(F.col("id").alias("node"))

        asked = checkpoint(added.select(*_EDGE, F.lit(1).alias("sign")).unionByName(removed.select(*_EDGE, F.lit(-1).alias("sign"))).groupBy(*_EDGE).agg(F.max("sign").alias("sign")))
        sources = asked.select(F.col("source_id").alias("node"))
        there = _edges(self._ends(sources).where("out")).withColumn("there", F.lit(True))
        fresh = checkpoint(asked.join(there, _EDGE, "left").where((F.col("sign") > 0) == F.col("there").isNull()).select(*_EDGE, "sign"))
        gone = fresh.where("sign < 0").select(*_EDGE)
        before = checkpoint(_edges(self._ends(at_nodes)).unionByName(gone).distinct())
        after = before.join(gone, _EDGE, "left_anti").unionByName(fresh.where("sign > 0").select(*_EDGE))

        ends = checkpoint(before.unionByName(after).select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct())
        known = self.reps.read(self.reps.touched(ends, "id")).join(ends, "id", "left_semi")
        changed = known.join(moved, "id", "left_anti").unionByName(moved.where("new is not null").select("id", F.col("new").alias("rep")))
        signed = lambda rows, sign: rows.withColumn("n", F.col("n") * sign)
        both = signed(counted_pairs(before, known), -1).unionByName(signed(counted_pairs(after, changed), 1))
        delta = checkpoint(both.groupBy(*_PAIR).agg(F.sum("n").alias("n")).where("n <> 0"))

        self._add(self.counts, delta)
        self._put(self.reps, moved.select("id", F.col("new").alias("rep")), list(self.reps.key), "rep is not null")
        self._put(self.changes, _by_node(fresh, (F.col("sign") > 0).alias("there")), _END)
        if self.changes.read().count() * FEW > self.incident.read().count():
            every = list(range(self.incident.number))
            self.incident.replace(self._ends(), every)
            self.changes.replace(self.changes.read([]), every)
        return delta.select("source_id", "target_id").distinct()

    def edges(self, pairs: DataFrame | None = None) -> DataFrame:
        """The projection's edges, as aggregate_edges gives them; of some pairs alone if they are given."""
        if pairs is None:
            return shaped(self.counts.read())
        return shaped(self.counts.read(self.counts.touched(pairs)).join(pairs, ["source_id", "target_id"], "left_semi"))

    def _ends(self, nodes: DataFrame | None = None) -> DataFrame:
        """The ends of edges as they are now, at all nodes or at some (node)."""
        buckets = None if nodes is None else self.incident.touched(nodes, "node")
        own = lambda rows: rows if nodes is None else rows.join(nodes, "node", "left_semi")
        kept = own(self.incident.read(buckets))
        if not self.changes.live():
            return kept
        since = own(self.changes.read(buckets))
        return kept.join(since.select(*_END), _END, "left_anti").unionByName(since.where("there").select(*_END))

    @staticmethod
    def _add(table: Buckets, delta: DataFrame) -> None:
        buckets = table.touched(delta)
        merged = table.read(buckets).unionByName(delta.select("source_id", "target_id", "relation", "raw", "n")).groupBy(*_PAIR).agg(F.sum("n").alias("n"))
        table.replace(merged.where("n <> 0"), buckets)

    @staticmethod
    def _put(table: Buckets, rows: DataFrame, key: list[str], keep: str = "true") -> None:
        """Rows in place of those of the same key."""
        buckets = table.touched(rows)
        table.replace(table.read(buckets).join(rows.select(*key), key, "left_anti").unionByName(rows.where(keep)), buckets)


def _by_node(edges: DataFrame, *more: Column) -> DataFrame:
    """Each edge at both its ends, a loop once."""
    end = lambda node, other, out: F.struct(F.col(node).alias("node"), F.col(other).alias("other"), F.lit(out).alias("out"))
    there, back = end("source_id", "target_id", True), end("target_id", "source_id", False)
    both = F.when(F.col("source_id") == F.col("target_id"), F.array(there)).otherwise(F.array(there, back))
    return edges.select(F.explode(both).alias("end"), "relation", *more).select("end.node", "end.other", "relation", "end.out", *(["there"] if more else []))


def _edges(ends: DataFrame) -> DataFrame:
    """The edges whose ends these are; one with both its ends twice."""
    return ends.select(F.when(F.col("out"), F.col("node")).otherwise(F.col("other")).alias("source_id"), F.when(F.col("out"), F.col("other")).otherwise(F.col("node")).alias("target_id"), "relation")
