"""A full-text index of immutable segments: changes add a segment, searches read the buckets of their terms.

An update writes the postings of the changed documents as a new segment, and says in delete sets which documents of
older segments are not valid any more. Nothing that is written changes. When FANOUT segments are of about one size, they are
merged to one of the next, so there are few, and a posting is written again a few times in all. Numbers of documents
and words are kept by segment, so a search need not count the documents.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.buckets import BUCKETS, Buckets
from ..sources.session import checkpoint, tidy
from .fulltext import Query, rank_hits, row_postings, word_counts

FANOUT = 4
#: First characters of a term by which it has its bucket; a search for starts that short or shorter reads all buckets.
LEAD = 2
_POSTINGS = "node_id string, column string, term string, tf long, at array<int>, words long, bucket int"
_CHANGES = "version int, segment int, docs long, words long, retired boolean"


class SegmentedIndex:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, columns: tuple[str, ...] = ("title", "description", "rationale"), buckets: int = BUCKETS):
        self.spark, self.folder, self.columns, self.buckets = spark, folder, columns, buckets
        self.documents = Buckets(spark, f"{folder}/documents", "node_id string, segment int, words long", ("node_id",), buckets)

    def _saved(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def segments(self) -> dict[int, tuple[int, int]]:
        """Valid documents and their words of each segment in use."""
        rows = self._saved("changes", _CHANGES).groupBy("segment").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"), F.bool_or("retired").alias("retired"))
        return {r.segment: (r.docs, r.words) for r in rows.where("not retired").collect()}  # FANOUT to a size

    def _next(self) -> int:
        return (self._saved("changes", _CHANGES).agg(F.max("version")).first()[0] or 0) + 1

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(F.left(term, F.lit(LEAD))), F.lit(self.buckets)).cast("int")

    def _write(self, postings: DataFrame, segment: int) -> None:
        rows = postings.select("node_id", "column", "term", "at", "words").withColumn("bucket", self._bucket(F.col("term"))).hint("rebalance", "bucket")
        rows.select("node_id", "column", "term", F.size("at").cast("long").alias("tf"), "at", "words", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/segments/segment={segment}")

    def _say(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, _CHANGES).coalesce(1).write.mode("append").parquet(f"{self.folder}/changes")

    def _valid(self, segments: list[int], buckets: list[int] | None = None) -> DataFrame:
        """Postings of some segments and buckets whose documents are still the valid ones."""
        parts = [self.spark.read.schema(_POSTINGS).parquet(f"{self.folder}/segments/segment={s}").withColumn("segment", F.lit(s)) for s in segments]
        if not parts:
            return self.spark.createDataFrame([], f"{_POSTINGS}, segment int")
        rows = reduce(DataFrame.unionByName, parts)
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        gone = self._saved("deletes", "segment int, node_id string").where(F.col("segment").isin(segments))
        return rows.join(gone, ["segment", "node_id"], "left_anti")

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """Take in documents (node_id, each once, and the columns), new or in place of what they were; removed ids (node_id) go."""
        with tidy(self.spark):
            self._update(changed, removed)

    def _update(self, changed: DataFrame, removed: DataFrame | None) -> None:
        number = self._next()
        sizes = checkpoint(word_counts(changed, self.columns))
        self._write(row_postings(changed, self.columns), number)
        ids = sizes.select("node_id")
        ids = checkpoint(ids if removed is None else ids.unionByName(removed.select("node_id")).distinct())
        buckets = self.documents.touched(ids)
        before = self.documents.read(buckets)
        old = checkpoint(before.join(ids, "node_id", "left_semi"))
        old.select("segment", "node_id").write.mode("overwrite").parquet(f"{self.folder}/deletes/version={number}")
        new = sizes.select("node_id", F.lit(number).alias("segment"), "words")
        self.documents.replace(before.join(ids, "node_id", "left_anti").unionByName(new), buckets)
        docs, words = sizes.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
        less = old.groupBy("segment").agg(F.count("*").alias("docs"), F.sum("words").alias("words")).collect()  # a row a segment
        self._say([(number, number, docs, words, False), *((number, r.segment, -r.docs, -r.words, False) for r in less)])
        self._merge()

    def _merge(self) -> None:
        while True:
            sizes: dict[int, list[int]] = {}
            held = self.segments()
            for segment, (docs, _) in held.items():
                sizes.setdefault(int(math.log(max(1, docs), FANOUT)), []).append(segment)
            many = next((s for _, s in sorted(sizes.items()) if len(s) >= FANOUT), None)
            if many is None:
                return
            number = self._next()
            self._write(self._valid(many), number)
            inside = F.col("segment").isin(many)
            documents = self.documents.read()
            buckets = self.documents.touched(documents.where(inside))
            moved = self.documents.read(buckets).withColumn("segment", F.when(inside, number).otherwise(F.col("segment")))
            self.documents.replace(moved, buckets)
            docs, words = (sum(held[s][k] for s in many) for k in (0, 1))
            self._say([(number, number, docs, words, False), *((number, s, 0, 0, True) for s in many)])

    def postings(self, query: Query) -> DataFrame:
        """The valid postings of a query's terms, from their buckets alone."""
        words, starts = query.terms()
        keys = [w[:LEAD] for w in words] + [s for s in starts if len(s) >= LEAD]
        read = None
        if all(len(s) >= LEAD for s in starts):
            read = [r.b for r in self.spark.createDataFrame([(k,) for k in keys], "k string").select(self._bucket(F.col("k")).alias("b")).distinct().collect()]
        wanted = reduce(Column.__or__, [F.startswith("term", F.lit(s)) for s in starts], F.col("term").isin(words))
        return self._valid(sorted(self.segments()), read).where(wanted)

    def search(self, query: str) -> DataFrame:
        """(node_id, rank) of the documents that a query finds, as fulltext.search gives them from an index of all."""
        parsed, held = Query(query), self.segments().values()
        docs, words = sum(d for d, _ in held), sum(w for _, w in held)
        return rank_hits(checkpoint(self.postings(parsed)), parsed, docs, words / docs if docs else 0.0)
