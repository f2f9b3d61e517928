"""A graph kept in a folder: its tables under a schema version, opened, migrated, listed and changed."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import BUCKETS, Buckets
from .schema import ANNOTATIONS, EDGES, EVENTS, NODES
from .session import checkpoint

Tables = dict[str, DataFrame]

#: The tables of each schema version, and the columns by which they are dealt to buckets. The last is in use.
VERSIONS: dict[int, dict[str, str]] = {
    1: {"nodes": "id string, kind string, name string, qualified_name string, file_path string, data string, created_at string", "edges": "source_id string, target_id string, relation string, created_at string"},
    2: {"nodes": NODES, "edges": EDGES},
    3: {"nodes": NODES, "edges": EDGES, "annotations": ANNOTATIONS, "events": EVENTS},
}
KEYS = {"nodes": ("id",), "edges": ("id",), "annotations": ("id",), "events": ("id",)}


def _second(tables: Tables) -> Tables:
    """Nodes get a tier and the time of their last change; edges get data, and an id that stands for what they join, so equal edges become one."""
    nodes = tables["nodes"].withColumns({"tier": F.lit("personal"), "updated_at": F.col("created_at")})
    name = F.concat_ws("\x00", *(F.coalesce(c, F.lit("")) for c in ("source_id", "relation", "target_id")))
    edges = tables["edges"].withColumns({"id": F.concat(F.lit("e-"), F.sha2(name, 256)), "data": F.lit("{}")})
    return {"nodes": nodes, "edges": edges.groupBy("id", "source_id", "target_id", "relation", "data").agg(F.min("created_at").alias("created_at"))}


def _third(tables: Tables) -> Tables:
    """Annotations and events begin empty."""
    spark = tables["nodes"].sparkSession
    return tables | {name: spark.createDataFrame([], VERSIONS[3][name]) for name in ("annotations", "events")}


#: How the tables of the version before become those of a version.
STEPS: dict[int, Callable[[Tables], Tables]] = {2: _second, 3: _third}


class SavedGraph:
    """The tables of a folder that all executors share, the newest state of each in buckets of its ids.

    What a version of the schema holds stands in a folder of its own, and the version is written down last: a migration that fails is begun
    anew by whoever opens the graph next, and the older tables stay as they were. A change reads and rewrites the buckets of its ids alone.
    Tables are seen by SQL as ``{name}_nodes`` and so on.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str = "graph", buckets: int = BUCKETS, version: int = max(VERSIONS)):
        """Open the graph, or begin an empty one; version is the one that is wanted, and no newer one is opened."""
        self.spark, self.folder, self.name = spark, folder, name
        found, self.number = self._said() or (None, buckets)
        if found is not None and found > version:
            raise ValueError(f"the graph has schema version {found}, newer than {version}")
        self.version = found or version
        if found is None:
            self._say(version)
        while self.version < version:
            self._migrate(self.version + 1)
        self._show()

    def _said(self) -> tuple[int, int] | None:
        """The schema version and the number of buckets of what the folder holds."""
        try:
            row = self.spark.read.schema("version int, buckets int").parquet(f"{self.folder}/schema").agg(F.max(F.struct("version", "buckets")).alias("last")).first()
            return (row["last"].version, row["last"].buckets) if row["last"] else None
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def _say(self, version: int) -> None:
        self.spark.createDataFrame([(version, self.number)], "version int, buckets int").coalesce(1).write.mode("append").parquet(f"{self.folder}/schema")
        self.version = version

    def _table(self, table: str, version: int | None = None) -> Buckets:
        version = version or self.version
        return Buckets(self.spark, f"{self.folder}/v{version}/{table}", VERSIONS[version][table], ("source_id", "target_id") if version == 1 and table == "edges" else KEYS[table], self.number)

    def _migrate(self, version: int) -> None:
        before = {table: self.read(table) for table in VERSIONS[self.version]}
        for table, rows in STEPS[version](before).items():
            self._table(table, version).replace(rows, list(range(self.number)))
        self._say(version)

    def _show(self) -> None:
        for table in VERSIONS[self.version]:
            self.read(table).createOrReplaceTempView(f"{self.name}_{table}")

    def list_tables(self) -> list[str]:
        """Names of the tables that SQL sees."""
        own = {f"{self.name}_{table}" for table in VERSIONS[self.version]}
        return sorted(t.name for t in self.spark.catalog.listTables() if t.isTemporary and t.name in own)

    def columns(self, table: str) -> list[tuple[str, str]]:
        """(name, type) of a table's columns, as the catalog has them."""
        return [(c.name, c.dataType) for c in self.spark.catalog.listColumns(f"{self.name}_{table}")]

    def read(self, table: str, ids: DataFrame | None = None) -> DataFrame:
        """A table's rows; if ids (id) are given, those of them, from their buckets alone."""
        kept = self._table(table)
        return kept.read() if ids is None else kept.read(kept.touched(ids)).join(ids.select("id"), "id", "left_semi").select(*kept.read([]).columns)

    def load(self, table: str, rows: DataFrame) -> None:
        """rows are from now on all that a table holds."""
        self._table(table).replace(rows, list(range(self.number)))
        self._show()

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Take in rows, new or in place of those of their ids. Of several with one id the one that is greatest, column by column, counts."""
        kept = self._table(table)
        columns = kept.read([]).columns
        last = [c for c in ("updated_at", "created_at") if c in columns]
        order = F.struct(*last, *(c for c in columns if c not in last))
        new = checkpoint(rows.select(*columns).groupBy("id").agg(F.max(order).alias("row")).select(*(F.col(f"row.{c}").alias(c) for c in columns)))
        buckets = kept.touched(new)
        kept.replace(kept.read(buckets).join(new, "id", "left_anti").unionByName(new), buckets)
        self._show()

    def _remove(self, table: str, gone: DataFrame) -> None:
        kept = self._table(table)
        gone = checkpoint(gone.select("id").distinct())
        buckets = kept.touched(gone)
        kept.replace(kept.read(buckets).join(gone, "id", "left_anti"), buckets)

    def remove_nodes(self, ids: DataFrame) -> None:
        """Remove nodes (id) with their edges, and the annotations by them or of those edges.

        What depends goes first, so a removal that fails midway leaves no edge without its ends and can be made again.
        """
        ids = checkpoint(ids.select("id").distinct())
        ends = [self.read("edges").join(ids.select(F.col("id").alias(end)), end, "left_semi").select("id") for end in ("source_id", "target_id")]
        edges = checkpoint(reduce(DataFrame.unionByName, ends).distinct())
        if "annotations" in VERSIONS[self.version]:
            by = [self.read("annotations").join(of.select(F.col("id").alias(c)), c, "left_semi").select("id") for c, of in (("decision_id", ids), ("edge_id", edges))]
            self._remove("annotations", by[0].unionByName(by[1]))
        self._remove("edges", edges)
        self._remove("nodes", ids)
        self._show()
