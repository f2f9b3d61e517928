"""The graph's live state as a stream: mutations fold into keyed state, and what changes comes out.

A node's fields lie at the node's key. An edge lies at both its ends, so that a node that goes takes its edges with it
without a look elsewhere; an edge is there while both ends say so. The edges of a node are spread over SALTS keys, each
of which hears when the node goes, so that a hub is no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from ..sources.session import ship

#: Keys over which the edges of a node are spread.
SALTS = 8
FIELDS = ("kind", "name", "status", "data")
#: What comes out: a node with all its fields, or one end of an edge; version counts what its key has heard.
CHANGES = "part string, id string, alive boolean, kind string, name string, status string, data string, source_id string, target_id string, relation string, side string, seq long, pos int, version long"
_NODE = "alive boolean, kind string, name string, status string, data string, version long"
_EDGE, _END = "side string, source_id string, target_id string, relation string", "seq long, pos int"


def _keyed(mutations: DataFrame) -> DataFrame:
    """Each mutation at the keys that must hear of it: (key, side, ...)."""
    salt = F.pmod(F.xxhash64("source_id", "target_id", "relation"), F.lit(SALTS)).cast("string")
    end = lambda node, side: F.struct(F.concat(salt, F.lit("/"), node).alias("key"), F.lit(side).alias("side"))
    at_node = F.struct(F.concat(F.lit("node/"), "id").alias("key"), F.lit(None).cast("string").alias("side"))
    everywhere = F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.struct(F.concat(k.cast("string"), F.lit("/"), "id").alias("key"), F.lit(None).cast("string").alias("side")))
    to = F.when(F.col("op").isin("add_edge", "remove_edge"), F.array(end(F.col("source_id"), "source"), end(F.col("target_id"), "target"))).when(F.col("op") == "remove_node", F.concat(F.array(at_node), everywhere)).otherwise(F.array(at_node))
    return mutations.withColumn("to", F.explode(to)).select("to.key", "to.side", "seq", "pos", "op", "id", *FIELDS, "source_id", "target_id", "relation")


class _Fold(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.node = handle.getValueState("node", _NODE)
        self.edges = handle.getMapState("edges", _EDGE, _END)

    def handleInputRows(self, key, rows: Iterator[Row], timer) -> Iterator[Row]:  # noqa: ANN001
        ordered = sorted(rows, key=lambda r: (r.seq, r.pos))
        if key[0].startswith("node/"):
            yield from self._fold_node(ordered)
        else:
            yield from self._fold_edges(ordered)

    def _fold_node(self, rows: list[Row]) -> Iterator[Row]:
        held = self.node.get() if self.node.exists() else None
        alive, fields, version = (held[0], dict(zip(FIELDS, held[1:5], strict=True)), held[5]) if held else (False, dict.fromkeys(FIELDS), 0)
        for r in rows:
            version += 1
            if r.op == "remove_node":
                alive, fields = False, dict.fromkeys(FIELDS)
            elif r.op == "add_node":
                alive, fields = True, {f: r[f] for f in FIELDS}
            elif alive:
                fields |= {f: r[f] for f in FIELDS if r[f] is not None}
        self.node.update((alive, *(fields[f] for f in FIELDS), version))
        last = rows[-1]
        yield Row(part="node", id=last.id, alive=alive, **fields, source_id=None, target_id=None, relation=None, side=None, seq=last.seq, pos=last.pos, version=version)

    def _fold_edges(self, rows: list[Row]) -> Iterator[Row]:
        changed: dict[tuple, tuple] = {}
        for r in rows:
            if r.op == "remove_node":
                gone = [tuple(k) for k in self.edges.keys()]
                for k in gone:
                    self.edges.removeKey(k)
                    changed[k] = (False, r.seq, r.pos)
                continue
            edge = (r.side, r.source_id, r.target_id, r.relation)
            if r.op == "add_edge":
                self.edges.updateValue(edge, (r.seq, r.pos))
            elif self.edges.containsKey(edge):
                self.edges.removeKey(edge)
            changed[edge] = (r.op == "add_edge", r.seq, r.pos)
        none = dict.fromkeys(FIELDS)
        for (side, source, target, relation), (alive, seq, pos) in changed.items():
            yield Row(part="edge", id=None, alive=alive, **none, source_id=source, target_id=target, relation=relation, side=side, seq=seq, pos=pos, version=None)

    def close(self) -> None:
        pass


def live_changes(mutations: DataFrame) -> DataFrame:
    """What mutations (see MUTATIONS; a stream, in the order of seq over its batches) change: rows of CHANGES.

    A batch gives a node at most once and each end of an edge at most once, as they are after it.
    """
    ship(mutations.sparkSession)
    return _keyed(mutations).groupBy("key").transformWithState(_Fold(), CHANGES, "Update", "None")


def live_nodes(changes: DataFrame) -> DataFrame:
    """(id, kind, name, status, data) of the nodes that are there after all changes, as fold_nodes gives them."""
    last = changes.where("part = 'node'").groupBy("id").agg(F.max_by(F.struct("alive", *FIELDS), F.struct("seq", "pos")).alias("x"))
    return last.where("x.alive").select("id", *(F.col(f"x.{f}").alias(f) for f in FIELDS))


def live_edges(changes: DataFrame) -> DataFrame:
    """(source_id, target_id, relation) of the edges that are there after all changes, as fold_edges gives them."""
    last = changes.where("part = 'edge'").groupBy("source_id", "target_id", "relation", "side").agg(F.max_by("alive", F.struct("seq", "pos")).alias("alive"))
    return last.groupBy("source_id", "target_id", "relation").agg(F.count_if("alive").alias("ends")).where("ends = 2").drop("ends")
