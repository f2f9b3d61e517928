"""The event log: pages, derived mutations, and the graph folded from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import edge_key
from ..sources.schema import EVENT_PAYLOAD

MUTATION = "struct<op:string,id:string,kind:string,name:string,status:string,data:string,source_id:string,target_id:string,relation:string>"


def page(events: DataFrame, before: str | None = None, size: int = 50) -> tuple[DataFrame, bool]:
    """The newest events by id, below an id if given, and whether there are more."""
    rows = events if before is None else events.where(F.col("id") < before)
    more = rows.orderBy(F.desc("id")).limit(size + 1)
    return more.orderBy(F.desc("id")).limit(size), more.count() > size


def missed(events: DataFrame, last_seen: str) -> DataFrame:
    """What came after the last event seen, oldest first."""
    return events.where(F.col("id") > last_seen).orderBy("id")


def append_new(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of a batch that the log has not; of repeated ids one."""
    return batch.dropDuplicates(["id"]).join(log.select("id"), "id", "left_anti")


def _mutation(op: str, **fields: Column) -> Column:
    names = [f.split(":")[0] for f in MUTATION[7:-1].split(",")]
    return F.struct(F.lit(op).alias("op"), *((fields[n] if n in fields else F.lit(None).cast("string")).cast("string").alias(n) for n in names[1:]))


def derive(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seq, pos, op, id, ...) of the mutations that events stand for, in order of event and place.

    events has id, kind and payload (JSON); nodes is the current state (id, kind, name, status, data),
    joined from the left, so an event about a missing decision gives nothing. Payloads that are no JSON
    give nothing either. Works on batches and on streams.
    """
    p = F.col("p")
    looked = nodes.select(F.col("id").alias("node_id"), F.col("kind").alias("node_kind"), "name", "status", "data")
    parsed = events.withColumn("p", F.from_json("payload", EVENT_PAYLOAD)).withColumn("node_key", F.col("p.decision_id"))
    joined = parsed.join(looked, F.col("node_key") == F.col("node_id"), "left")
    there, node = F.col("node_id").isNotNull(), _mutation("add_node", id=F.col("node_id"), kind=F.col("node_kind"), name=F.col("name"), status=F.col("status"), data=F.col("data"))
    none = F.array().cast(f"array<{MUTATION}>")
    edges = F.transform(F.coalesce(p.governed_file_ids, F.array().cast("array<string>")), lambda f: _mutation("add_edge", source_id=F.col("node_key"), target_id=f, relation=F.lit("GOVERNS")))
    has = lambda f: F.array_contains(p.changed_fields, f)
    changed = _mutation("update_node", id=F.col("node_key"), name=F.when(has("title"), F.col("name")), status=F.when(has("status"), F.col("status")), data=F.when(has("data"), F.col("data")))
    kind = F.col("kind")
    made = (
        F.when((kind == "decision.created") & there, F.concat(F.array(node), edges))
        .when((kind == "decision.updated") & there & (has("title") | has("status") | has("data")), F.array(changed))
        .when((kind == "decision.deleted") & F.col("node_key").isNotNull(), F.array(_mutation("remove_node", id=F.col("node_key"))))
        .when(
            (kind == "decision.superseded") & p.old_id.isNotNull(),
            F.array(_mutation("update_node", id=p.old_id, status=F.lit("superseded")), _mutation("add_edge", source_id=p.new_id, target_id=p.old_id, relation=F.lit("SUPERSEDES"))),
        )
        .when((kind == "decision.promoted") & F.col("node_key").isNotNull(), F.array(_mutation("update_node", id=F.col("node_key"), data=F.to_json(F.struct(p.to_tier.alias("tier"))))))
        .when((kind == "decision.proposed") & there, F.array(node))
        .otherwise(none)
    )
    return joined.select(F.col("id").alias("seq"), F.posexplode(made).alias("pos", "m")).select("seq", "pos", "m.*")


def fold_nodes(mutations: DataFrame, fields: tuple[str, ...] = ("kind", "name", "status", "data")) -> DataFrame:
    """(id, kind, name, status, data), or other fields, after all mutations, in the order of seq and pos.

    What counts of a node is its last add or remove. If that is an add, each field has its value in the
    last update after it that sets it, else the added one. Updates of a missing node do nothing.
    """
    order = F.struct("seq", "pos")
    own = mutations.where(F.col("op").isin("add_node", "update_node", "remove_node")).withColumn("at", order)
    placed = own.where("op <> 'update_node'").groupBy("id").agg(F.max("at").alias("base"))
    # by another form of the id than that of the aggregate, so that a node of very many updates can be split
    form = lambda rows: rows.withColumn("form", F.concat(F.lit("~"), "id"))
    live = form(own).join(form(placed).drop("id"), "form").where("at >= base")
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    folded = live.groupBy("id").agg(F.min_by("op", "at").alias("first"), *(last(c) for c in fields))
    return folded.where("first = 'add_node'").drop("first")


def fold_edges(mutations: DataFrame) -> DataFrame:
    """(source_id, target_id, relation) after all mutations: those whose last add follows the last
    removal of the edge and of either end."""
    order = F.struct("seq", "pos")
    rows = mutations.where(F.col("op").isin("add_edge", "remove_edge")).withColumn("at", order)
    edges = rows.groupBy("source_id", "target_id", "relation").agg(F.max(F.when(F.col("op") == "add_edge", F.col("at"))).alias("added"), F.max(F.when(F.col("op") == "remove_edge", F.col("at"))).alias("removed"))
    gone = mutations.where("op = 'remove_node'").groupBy("id").agg(F.max(order).alias("gone"))
    for end in ("source_id", "target_id"):
        edges = edges.join(gone.select(F.col("id").alias(end), F.col("gone").alias(f"{end}_gone")), end, "left")
    later = lambda c: F.col(c).isNull() | (F.col("added") > F.col(c))
    return edges.where(F.col("added").isNotNull() & later("removed") & later("source_id_gone") & later("target_id_gone")).select("source_id", "target_id", "relation")


def as_of(mutations: DataFrame, seq: Column | str | int) -> DataFrame:
    """The mutations up to an event, to be folded into the state of that time."""
    return mutations.where(F.col("seq") <= seq)


def export_state(edges: DataFrame) -> DataFrame:
    """Edges by key, the last of each."""
    return edges.withColumn("key", edge_key("source_id", "target_id", "relation")).dropDuplicates(["key"])


def parse_git_log(lines: DataFrame) -> DataFrame:
    """(hash, message, author, timestamp, files) of commits from log lines (source, line_no, text).

    A header has four fields with NUL between; lines of a status letter and tab-separated paths follow.
    The header numbers of a source are a running sum, so its log stays with its lines; a renamed or
    copied file is listed under its last path.
    """
    is_header = F.contains("text", F.lit("\x00"))
    number = F.sum(is_header.cast("int")).over(Window.partitionBy("source").orderBy("line_no"))
    rows = lines.withColumn("commit", number).where("commit > 0")
    head, parts = F.split("text", "\x00"), F.split("text", "\t")
    files = F.when(~is_header & (F.size(parts) > 1) & F.col("text").rlike("^[AMDRCT]"), F.struct(F.element_at(parts, -1).alias("path"), F.substring(parts[0], 1, 1).alias("status")))
    grouped = rows.groupBy("source", "commit").agg(
        F.first(F.when(is_header, head), ignorenulls=True).alias("h"),
        F.array_sort(F.collect_list(F.when(files.isNotNull(), F.struct("line_no", files.alias("f"))))).alias("files"),
    )
    return grouped.select("source", "commit", F.col("h")[0].alias("hash"), F.col("h")[1].alias("message"), F.col("h")[2].alias("author"), F.try_to_number(F.col("h")[3], F.lit("9999999999999")).cast("long").alias("timestamp"), F.transform("files", lambda x: x.f).alias("files"))


def scan_git(lines: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New commits of logs (source, line_no, text; newest first), and the (source, hash) to take as seen next time.

    seen has the last commit seen of each source. A source without one only starts from its head, without
    history; so does one whose last commit is not in its log any more.
    """
    commits = parse_git_log(lines)
    last = commits.join(seen, ["source", "hash"], "left_semi").groupBy("source").agg(F.min("commit").alias("last"))
    new = commits.join(last, "source").where("commit < last").drop("last")
    heads = commits.where("commit = 1").select("source", "hash")
    return new, heads.unionByName(seen.select("source", "hash").join(heads, "source", "left_anti"))


def commit_events(commits: DataFrame, links: DataFrame) -> DataFrame:
    """Events of commits, oldest first, with the decisions (hash, decision_id) that govern their files, which an event lists."""
    listed = links.groupBy("hash").agg(F.array_sort(F.collect_set("decision_id")).alias("decision_ids"))
    linked = commits.join(listed, "hash", "left")
    payload = F.to_json(F.struct("hash", "message", "files", F.coalesce("decision_ids", F.array().cast("array<string>")).alias("decision_links")))
    return linked.select("hash", F.lit("commit").alias("kind"), F.coalesce(F.nullif("author", F.lit("")), F.lit("unknown")).alias("actor"), (F.col("timestamp") * 1000).alias("created_at"), payload.alias("payload")).orderBy("created_at")
