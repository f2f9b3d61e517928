"""Batches of writes: a table of commands becomes a log of mutations and events, by joins and not one by one.

A batch gives what its commands would give in the order of ``seq``. An id is never used twice, so a node lives from
one command to one other at most, and whether it lives at a command is a join with two numbers. A new decision whose
references do not live is refused, and with it what refers to it: that is looked for in rounds, as many as such
references follow one another. All else is a fixed chain of joins, however many commands there are.

Commands (see COMMANDS) are, by ``op``:

- ``create`` a decision of this id, with what it governs (ids, else paths, else new paths) and refers to (ids)
- ``update`` its title, description, rationale, alternatives, status or superseded_by; null leaves a field as it is
- ``delete`` a decision, ``promote`` it to a tier, ``link`` it to a target (GOVERNS, as above, or another relation)
- ``add_node``, ``remove_node``, ``add_edge`` (id is its source), ``remove_edge``
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import base_name
from ..functions.wire import ulid
from ..sources.schema import DECISION_DATA, TIERS
from ..sources.session import checkpoint
from .events import fold_edges, fold_nodes
from .joins import without_node

ALTERNATIVES = "array<struct<name:string,reason_rejected:string>>"
COMMANDS = f"seq long, op string, id string, title string, description string, rationale string, alternatives {ALTERNATIVES}, status string, superseded_by string, reason string, author string, tier string, governs array<string>, references array<string>, target string, relation string, kind string, file_path string"
#: What a mutation of a batch says of a node.
FIELDS = ("kind", "name", "file_path", "tier", "status", "data")
#: Fields of a decision that updates set.
OWN = ("title", "description", "rationale", "alternatives", "status", "superseded_by", "author", "tier")
#: Commands on one decision that are put in order together.
WIDTH = 8192


def _none() -> Column:
    return F.lit(None).cast("string")


def carried(rows: DataFrame, key: str, order: str, columns: tuple[str, ...], width: int = WIDTH) -> DataFrame:
    """rows with the last value of each column in earlier rows of the key, as ``<column>_before``; order is a long, unique in its key.

    Values are carried within blocks of ``width`` numbers, and the blocks' last ones from block to block, so
    a key that has a large part of all rows is spread over many tasks.
    """
    rows = rows.withColumn("block", F.floor(F.col(order) / width))
    inside = Window.partitionBy(key, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumns({f"{c}_before": F.last(c, ignorenulls=True).over(inside) for c in columns})
    ends = rows.groupBy(key, "block").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))
    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = ends.select(key, "block", *(F.last(c, ignorenulls=True).over(earlier).alias(f"{c}_far") for c in columns))
    both = near.join(far, [key, "block"])
    return both.withColumns({f"{c}_before": F.coalesce(f"{c}_before", f"{c}_far") for c in columns}).drop("block", *(f"{c}_far" for c in columns))


def _uuid(*parts: str | Column) -> Column:
    """An id made from what it stands for, so that a batch that runs again makes the same."""
    h = F.md5(F.concat_ws("\x00", *(F.lit(p) if isinstance(p, str) else p for p in parts)))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def _data() -> Column:
    """The JSON of a decision, from columns of its fields; absent ones are left out."""
    return F.to_json(F.struct("description", "rationale", "alternatives", "status", "superseded_by", "author"))


class Lives:
    """When each node that a batch speaks of lives: (id, kind, born, died), -1 for those there before."""

    def __init__(self, commands: DataFrame, state: DataFrame, births: DataFrame):
        known = state.select("id", "kind", F.lit(-1).cast("long").alias("born")).unionByName(births.select("id", "kind", F.col("seq").alias("born")))
        ends = commands.where(F.col("op").isin("delete", "remove_node")).select("id", "seq", "op").join(known, "id")
        died = ends.where((F.col("seq") > F.col("born")) & ((F.col("op") == "remove_node") | (F.col("kind") == "decision"))).groupBy("id").agg(F.min("seq").alias("died"))
        self.rows = checkpoint(known.join(died, "id", "left"))

    def look(self, rows: DataFrame, column: str, prefix: str) -> DataFrame:
        """rows with whether the node named in a column lives at seq, and its kind.

        The join goes by a form of the id that neither side is dealt by, so that an id that very many rows name can be split.
        """
        found = self.rows.select(F.concat(F.lit("~"), "id").alias("form"), F.col("kind").alias(f"{prefix}_kind"), "born", "died")
        joined = rows.withColumn("form", F.concat(F.lit("~"), column)).join(found, "form", "left")
        lives = F.coalesce((F.col("born") < F.col("seq")) & (F.col("died").isNull() | (F.col("seq") <= F.col("died"))), F.lit(False))
        return joined.withColumn(f"{prefix}_lives", lives).drop("form", "born", "died")


def _births(commands: DataFrame, state: DataFrame) -> DataFrame:
    """(seq, id, kind, file_path) of the nodes that commands make, without those whose references do not live."""
    made = commands.where(F.col("op").isin("create", "add_node") & F.col("id").isNotNull())
    first = made.groupBy("id").agg(F.min_by(F.struct("seq", "op", "kind", "file_path"), "seq").alias("x")).select("id", "x.*")
    new = first.join(state.select("id"), "id", "left_anti")
    births = checkpoint(new.select("seq", "id", F.when(F.col("op") == "create", "decision").otherwise(F.col("kind")).alias("kind"), F.when(F.col("op") == "add_node", F.col("file_path")).alias("file_path")))
    asked = commands.where("op = 'create'").select("seq", F.explode("references").alias("reference"))
    while True:
        missing = Lives(commands, state, births).look(asked, "reference", "reference").where("not reference_lives").select("seq").distinct()
        refused = checkpoint(births.select("seq").join(missing, "seq", "left_semi"))
        if refused.isEmpty():
            return births
        births = checkpoint(births.join(refused, "seq", "left_anti"))


def _resolved(asked: DataFrame, lives: Lives, paths: DataFrame, batch: str) -> DataFrame:
    """(seq, at, target, new): what each asked target (seq, at, target) is: a node's id, else the least id of a living node of this path, else a new path."""
    by_id = checkpoint(lives.look(asked, "target", "target"))
    left = by_id.where("not target_lives").select("seq", "at", "target")
    living = left.withColumn("form", F.concat(F.lit("~"), "target")).join(paths.withColumn("form", F.concat(F.lit("~"), "file_path")), "form").where("born < seq and (died is null or seq <= died)")
    found = living.groupBy("seq", "at").agg(F.min("id").alias("found"))
    named = checkpoint(left.join(found, ["seq", "at"], "left").withColumn("made", _uuid(batch, "path", F.col("target"))))
    firsts = named.where("found is null").groupBy("made").agg(F.min(F.struct("seq", "at")).alias("x")).select("x.seq", "x.at", F.lit(True).alias("new"))
    told = named.join(firsts, ["seq", "at"], "left").select("seq", "at", F.coalesce("found", "made").alias("node"), F.when(F.col("new"), F.col("target")).alias("new_path"))
    return by_id.where("target_lives").select("seq", "at", F.col("target").alias("node"), _none().alias("new_path")).unionByName(told)


def _mutation(rows: DataFrame, pos: Column | int, op: str, **fields: Column) -> DataFrame:
    names = ("id", *FIELDS, "source_id", "target_id", "relation")
    return rows.select("seq", (F.lit(pos) if isinstance(pos, int) else pos).cast("int").alias("pos"), F.lit(op).alias("op"), *((fields[n] if n in fields else _none()).cast("string").alias(n) for n in names))


def _event(rows: DataFrame, kind: str, now: int, payload: Column) -> DataFrame:
    return rows.select(ulid(F.lit(now), F.col("seq")).alias("id"), F.lit(kind).alias("kind"), F.coalesce("author", F.lit("user")).alias("actor"), F.lit(now).cast("long").alias("created_at"), F.lit("").alias("project_id"), F.to_json(payload).alias("payload"), "seq")


def run_batch(commands: DataFrame, nodes: DataFrame, edges: DataFrame, batch: str, now: int) -> dict[str, DataFrame]:
    """What a batch of commands does to a graph: ``mutations``, ``events`` and ``refused`` (seq, op, id).

    batch names it: new paths get ids made from the name and the path, so a batch that runs again gives the same. now: its time in milliseconds.
    """
    c = checkpoint(commands)
    none = F.array().cast("array<string>")
    listed = F.concat(F.array("id", "superseded_by", "target"), F.coalesce("governs", none), F.coalesce("references", none))
    named = checkpoint(c.select(F.explode(listed).alias("id")).where("id is not null").distinct())
    state = checkpoint(nodes.join(named, "id", "left_semi"))
    births = _births(c, state)
    lives = Lives(c, state, births)

    other = F.when(F.col("op") == "update", F.col("superseded_by")).when((F.col("op") == "add_edge") | ((F.col("op") == "link") & (F.coalesce("relation", F.lit("GOVERNS")) != "GOVERNS")), F.col("target"))
    told = lives.look(lives.look(c.withColumn("other", other), "id", "id"), "other", "other").join(births.select("seq", F.lit(True).alias("made")), "seq", "left")
    op, ours = F.col("op"), F.col("id_lives") & (F.col("id_kind") == "decision")
    fine = (
        F.when(op.isin("create", "add_node"), F.col("made"))
        .when(op == "update", ours & (F.col("superseded_by").isNull() | F.col("other_lives")))
        .when(op == "delete", ours)
        .when(op == "promote", ours & F.col("tier").isin(*TIERS[1:]))
        .when(op == "link", F.col("id_lives") & F.col("target").isNotNull() & ((F.coalesce("relation", F.lit("GOVERNS")) == "GOVERNS") | F.col("other_lives")))
        .when(op == "add_edge", F.col("id_lives") & F.col("other_lives") & F.col("relation").isNotNull())
        .when(op == "remove_node", F.col("id_lives"))
        .when(op == "remove_edge", F.lit(True))
    )
    judged = checkpoint(told.withColumn("fine", F.coalesce(fine, F.lit(False))).drop("id_lives", "id_kind", "other_lives", "other_kind", "other", "made"))
    good = judged.where("fine")
    of = lambda *ops: good.where(F.col("op").isin(*ops))

    # what decisions say before each command
    parsed = state.where("kind = 'decision'").join(c.where(op.isin("update", "promote", "delete")).select("id").distinct(), "id", "left_semi").withColumn("d", F.from_json("data", DECISION_DATA))
    base = parsed.select("id", F.lit(-1).cast("long").alias("seq"), F.lit("base").alias("op"), F.col("name").alias("title"), *(F.col(f"d.{x}").alias(x) for x in ("description", "rationale", "alternatives")), F.coalesce("d.status", F.lit("active")).alias("status"), "d.superseded_by", "d.author", "tier")
    # a promotion alone sets the tier, and other fields of it say nothing
    set_ = {x: F.when(op != "promote", F.col(x)) for x in OWN if x != "tier"} | {"tier": F.when(op == "promote", F.col("tier")).when(op == "create", F.lit("personal")), "status": F.when(op == "create", F.lit("active")).when(op == "update", F.col("status"))}
    said = base.unionByName(of("create", "update", "promote", "delete").select("id", "seq", "op", *(v.alias(k) for k, v in set_.items())).select(*base.columns))
    before = checkpoint(carried(said, "id", "seq", OWN).where("op <> 'base'"))

    changes = before.where("op = 'update'")
    differs = lambda x: F.col(x).isNotNull() & ~F.col(x).eqNullSafe(F.col(f"{x}_before"))
    fields = F.array_compact(F.array(*(F.when(differs(x) if x not in ("alternatives", "superseded_by") else F.col(x).isNotNull(), F.lit(x)) for x in OWN[:6])))
    updates = changes.withColumn("changed", fields).withColumns({x: F.coalesce(x, f"{x}_before") for x in OWN})
    superseding = changes.where("superseded_by is not null").select("seq", F.col("superseded_by").alias("source_id"), F.col("id").alias("target_id"))
    once = superseding.groupBy("source_id", "target_id").agg(F.min("seq").alias("seq")).join(edges.where("relation = 'SUPERSEDES'").select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")

    asked = of("create").select("seq", F.posexplode("governs").alias("at", "target")).unionByName(of("link").where("coalesce(relation, 'GOVERNS') = 'GOVERNS'").select("seq", F.lit(0).alias("at"), "target"))
    wanted = asked.select(F.col("target").alias("file_path")).distinct()
    there = nodes.where("kind = 'path'").select("id", "file_path").join(wanted, "file_path", "left_semi").withColumn("born", F.lit(-1).cast("long")).unionByName(births.where("kind = 'path' and file_path is not null").select("id", "file_path", F.col("seq").alias("born")))
    ended = lives.rows.select("id", "died")  # every node that a command removes is named by it
    resolved = checkpoint(_resolved(asked.where("target is not null"), lives, there.join(ended, "id", "left"), batch))

    new, link = F.col, good.select("seq", "op", F.col("id").alias("decision"), F.size(F.coalesce("governs", none)).alias("n"))
    governed = resolved.join(link, "seq")
    place = F.col("at") * 2 + 1
    refers = of("create").select("seq", "id", F.size(F.coalesce("governs", none)).alias("n"), F.posexplode("references").alias("at", "reference"))
    mutations = [
        _mutation(of("create"), 0, "add_node", id=new("id"), kind=F.lit("decision"), name=new("title"), tier=F.lit("personal"), status=F.lit("active"), data=F.to_json(F.struct("description", "rationale", F.coalesce("alternatives", F.array().cast(ALTERNATIVES)).alias("alternatives"), F.lit("active").alias("status"), "author"))),
        _mutation(of("add_node"), 0, "add_node", id=new("id"), kind=new("kind"), name=new("title"), file_path=new("file_path"), tier=F.coalesce("tier", F.lit("personal")), data=F.lit("{}")),
        _mutation(governed.where("new_path is not null"), place, "add_node", id=new("node"), kind=F.lit("path"), name=base_name(new("new_path")), file_path=new("new_path"), tier=F.lit("public"), data=F.lit("{}")),
        _mutation(governed, place + 1, "add_edge", source_id=new("decision"), target_id=new("node"), relation=F.lit("GOVERNS")),
        _mutation(refers, F.col("n") * 2 + 1 + F.col("at"), "add_edge", source_id=new("id"), target_id=new("reference"), relation=F.lit("REFERENCES")),
        _mutation(updates, 0, "update_node", id=new("id"), name=new("title"), status=new("status"), data=_data()),
        _mutation(once, 1, "add_edge", source_id=new("source_id"), target_id=new("target_id"), relation=F.lit("SUPERSEDES")),
        _mutation(of("promote"), 0, "update_node", id=new("id"), tier=new("tier")),
        _mutation(of("delete", "remove_node"), 0, "remove_node", id=new("id")),
        _mutation(of("add_edge").unionByName(of("link").where("relation <> 'GOVERNS'")), 0, "add_edge", source_id=new("id"), target_id=new("target"), relation=new("relation")),
        _mutation(of("remove_edge"), 0, "remove_edge", source_id=new("id"), target_id=new("target"), relation=new("relation")),
    ]
    files = resolved.join(of("create").select("seq"), "seq", "left_semi").groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("x")).select("seq", F.col("x").node.alias("files"))
    created = of("create").join(files, "seq", "left").withColumn("files", F.coalesce("files", none))
    events = [
        _event(created, "decision.created", now, F.struct(F.col("id").alias("decision_id"), "title", "rationale", F.col("files").alias("governed_file_ids"), none.alias("tags"))),
        _event(updates.join(of("update").where("superseded_by is not null").select("seq", "reason"), "seq"), "decision.superseded", now, F.struct(F.col("id").alias("old_id"), F.col("superseded_by").alias("new_id"), F.coalesce("reason", F.lit("")).alias("reason"))),
        _event(updates.where("size(changed) > 0 and not array_contains(changed, 'superseded_by')"), "decision.updated", now, F.struct(F.col("id").alias("decision_id"), F.col("changed").alias("changed_fields"))),
        _event(before.where("op = 'delete'").withColumn("author", F.col("author_before")), "decision.deleted", now, F.struct(F.col("id").alias("decision_id"), F.col("title_before").alias("title"))),
        _event(before.where("op = 'promote'").withColumn("author", F.col("author_before")), "decision.promoted", now, F.struct(F.col("id").alias("decision_id"), F.col("tier_before").alias("from_tier"), F.col("tier").alias("to_tier"))),
    ]
    return {"mutations": checkpoint(reduce(DataFrame.unionByName, mutations)), "events": checkpoint(reduce(DataFrame.unionByName, events)), "refused": judged.where("not fine").select("seq", "op", "id")}


def apply_mutations(nodes: DataFrame, edges: DataFrame, mutations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (id and FIELDS) and edges (source_id, target_id, relation) after a batch's mutations; only touched nodes are folded."""
    fields = [f for f in FIELDS if f in nodes.columns]
    touched = mutations.where("op in ('add_node', 'update_node', 'remove_node')").select("id").distinct()
    start = nodes.join(touched, "id", "left_semi").select(F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("pos"), F.lit("add_node").alias("op"), "id", *fields)
    folded = fold_nodes(start.unionByName(mutations.select("seq", "pos", "op", "id", *fields)), tuple(fields))
    after = nodes.join(touched, "id", "left_anti").select("id", *fields).unionByName(folded.select("id", *fields))
    gone = mutations.where("op = 'remove_node'").select("id").distinct()
    cut = mutations.where("op = 'remove_edge'").select("source_id", "target_id", "relation").distinct()
    triple = ["source_id", "target_id", "relation"]
    kept = without_node(edges.select(*triple), gone).join(cut, triple, "left_anti")
    added = fold_edges(mutations).join(kept, triple, "left_anti")
    return after, kept.unionByName(added)
