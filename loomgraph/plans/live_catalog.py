"""Queries of the catalog over what is written and streamed: batches of commands, logs and live state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.wire import ulid
from ..operators import commands, segments
from ..sources import connector, saved
from ..sources.schema import MUTATIONS
from ..sources.session import checkpoint, shared_folder
from ..sources.tables import graph_edges, graph_nodes, table
from ..streaming import git, live, pipeline
from . import maintained, projection
from .catalog import _BM25, _FOLD, GRAPH, _project_sql, mutation_log, query
from .view_catalog import SQL

#: Of each document: a decision is made, perhaps changed and superseded, promoted and deleted. Some refer to what is not there.
_MADE = """with n as (select count(*) as customers from customer), d as (select doc_id as d from documents),
c as (select d, d % 50 = 7 or (d % 3 = 1 and ((d - 1) % 50 = 7 or (d - 1) % 11 = 0 or not exists (select 1 from documents where doc_id = d - 1))) as bad from d),
u as (select *, d % 5 = 0 and not bad and (d % 10 <> 0 or (d - 1) % 11 <> 0 and exists (select 1 from c o where o.d = c.d - 1 and not o.bad)) as updated from c),
s as (select *, (select count(*) from u o where o.d = u.d + 1 and o.updated and o.d % 10 = 0 and o.d % 11 <> 0) as supersedes from u)"""


def document_commands(spark: SparkSession, d: str) -> DataFrame:
    docs, customers = table(spark, d, "documents").select(F.col("doc_id").alias("d")), table(spark, d, "customer").count()
    n, text = F.col("d"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    refers = F.when(n % 50 == 7, F.array(F.lit("x-none"))).when(n % 3 == 1, F.array(text("x-", n - 1)))
    made = {
        0: {"op": F.lit("create"), "title": text("D", n), "rationale": F.lit("r"), "governs": F.array(text("c-", n * 7 % customers), text("new/", n % 10, "/")), "references": refers},
        1: {"op": F.when(n % 5 == 0, "update"), "title": text("E", n), "superseded_by": F.when(n % 10 == 0, text("x-", n - 1))},
        2: {"op": F.when(n % 4 == 0, "promote"), "tier": F.lit("team")},
        3: {"op": F.when(n % 11 == 0, "delete")},
    }
    rows = spark.createDataFrame([], commands.COMMANDS)
    for k, fields in made.items():
        own = docs.select((n * 4 + k).alias("seq"), text("x-", n).alias("id"), *(v.alias(c) for c, v in fields.items()))
        rows = rows.unionByName(own.where("op is not null"), allowMissingColumns=True)
    return rows


@query("decision_batch", _MADE + """
    select 'decision' as part, 'x-' || d as id, case when updated then 'E' || d else 'D' || d end as name, case when d % 4 = 0 then 'team' else 'personal' end as tier, 2 + (case when d % 3 = 1 then 1 else 0 end) + supersedes as count from s where not bad and d % 11 <> 0
    union all select 'path', 'new/' || (d % 10) || '/', null, 'public', count(*) filter (where d % 11 <> 0) from s where not bad group by d % 10
    union all select 'event', kind, null, null, count(*) from (select unnest(['decision.created', case when updated and d % 10 = 0 then 'decision.superseded' when updated then 'decision.updated' end, case when d % 4 = 0 then 'decision.promoted' end, case when d % 11 = 0 then 'decision.deleted' end]) as kind from s where not bad) where kind is not null group by kind
    union all select 'refused', op, null, null, count(*) from (select unnest([case when bad then 'create' end, case when d % 5 = 0 and not updated then 'update' end, case when bad and d % 4 = 0 then 'promote' end, case when bad and d % 11 = 0 then 'delete' end]) as op from s) where op is not null group by op""")  # fmt: skip
def decision_batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch of writes for every document: what is in the graph after it, its events, and what it refuses."""
    nodes = graph_nodes(spark, d, ("path", "file")).select("id", "kind", "name", "file_path", F.lit("personal").alias("tier"), F.lit(None).cast("string").alias("status"), F.lit("{}").alias("data"))
    out = commands.run_batch(document_commands(spark, d), nodes, graph_edges(spark, d, ("GOVERNS",)), "documents", 0)
    after, edges = commands.apply_mutations(nodes, graph_edges(spark, d, ("GOVERNS",)), out["mutations"])
    none = F.lit(None).cast("string")
    degree = edges.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("count"))
    decisions = after.where("kind = 'decision'").join(degree, "id", "left").select(F.lit("decision").alias("part"), "id", "name", "tier", F.coalesce("count", F.lit(0)).alias("count"))
    new = after.where("kind = 'path' and file_path like 'new/%'").select("id", "file_path", "tier")
    into = edges.where("relation = 'GOVERNS'").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("count"))
    paths = new.join(into, "id", "left").select(F.lit("path").alias("part"), F.col("file_path").alias("id"), none.alias("name"), "tier", F.coalesce("count", F.lit(0)).alias("count"))
    tally = lambda rows, part, key: rows.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("count")).select(F.lit(part).alias("part"), "id", none.alias("name"), none.alias("tier"), "count")
    return decisions.unionByName(paths).unionByName(tally(out["events"], "event", "kind")).unionByName(tally(out["refused"], "refused", "op"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


@query("git_stream", SQL["git_log"])
def git_stream(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits of twenty logs: a stream starts when each has all but its three newest, and runs again when it has these."""
    folder = _folder(spark, "git")
    source = F.col("o_custkey") % 20
    first = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("part"))
    rows = table(spark, d, "orders").withColumns({"source": source, "n": F.row_number().over(Window.partitionBy(source).orderBy("o_orderkey"))}).join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    key = F.col("o_orderkey").cast("string")
    head = F.concat_ws("\x00", F.concat(F.lit("h"), key), F.concat(F.lit("order "), key), "o_orderpriority", key)
    entry = rows.select("source", "n", F.concat_ws("\n", head, F.concat(F.lit("M\tparts/"), F.col("part").cast("string"), F.lit(".ts"))).alias("value"))
    for least in (4, 1):  # a log is one file in the order of n, newest first
        told = entry.where(F.col("n") >= least).repartitionByRange("source").sortWithinPartitions("source", "n")
        told.select("source", "value").write.mode("overwrite").partitionBy("source").text(f"{folder}/logs")
        stream = git.git_stream(spark, f"{folder}/logs").writeStream.format("parquet")
        stream.option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(git.COMMITS).parquet(f"{folder}/out")
    return found.select("hash", "message", "author", "timestamp", F.explode_outer(F.col("files").path).alias("path"))


_LIVE = _FOLD.format(where="")


@query("live_state", _LIVE + """, e as (select u, max(seq) as added from m where op = 'purchase' group by u)
    select 'node' as part, 'u-' || live.u as id, coalesce('s' || max(m.seq) filter (where op = 'click' and seq > added), 'new') as value from live join m on m.u = live.u group by live.u
    union all select 'edge', 'u-' || e.u, 'u-' || (e.u + 1) from e left join base a on a.u = e.u left join base b on b.u = e.u + 1 where (a.removed is null or a.removed < e.added) and (b.removed is null or b.removed < e.added)""")  # fmt: skip
def live_state(spark: SparkSession, d: str) -> DataFrame:
    """The events' mutations as they arrive in three parts, folded in the state of a stream that stops after each."""
    folder, provider = _folder(spark, "live"), "spark.sql.streaming.stateStore.providerClass"
    log = mutation_log(spark, d)
    names = [f.split()[0] for f in MUTATIONS.split(", ")]
    log = log.select(*(F.col(c) if c in log.columns else F.lit(None).cast("string").alias(c) for c in names))
    part = F.ntile(3).over(Window.orderBy("number"))
    cut = log.groupBy(F.floor(F.col("seq") / 1000).alias("number")).agg(F.min("seq").alias("seq")).withColumn("part", part).groupBy("part").agg(F.min("seq").alias("from")).orderBy("part").collect()  # three numbers
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        bounds = [r["from"] for r in cut] + [None]
        for low, high in zip(bounds, bounds[1:], strict=False):
            own = log.where(F.col("seq") >= low)
            (own if high is None else own.where(F.col("seq") < high)).write.mode("append").parquet(f"{folder}/in")
            stream = live.live_changes(spark.readStream.schema(log.schema).parquet(f"{folder}/in")).writeStream.outputMode("update")
            write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
            stream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    changes = spark.read.schema(live.CHANGES).parquet(f"{folder}/out")
    nodes, edges = live.live_nodes(changes), live.live_edges(changes)
    return nodes.select(F.lit("node").alias("part"), "id", F.col("status").alias("value")).unionByName(edges.select(F.lit("edge").alias("part"), F.col("source_id").alias("id"), F.col("target_id").alias("value")))


@query("event_pipeline", """with e as (select event_id, event_type as kind from events), m as (select 'event' as type, kind, event_id from e union all select 'mutation', kind, event_id from e where event_id % 3 = 0)
    select type, kind, count(*) as count, count(distinct event_id) as ids from m group by all""")  # fmt: skip
def event_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Events through the pipeline, the last third of them twice: each is stored and handed on once, with the mutations that it stands for after it."""
    folder = _folder(spark, "events")
    at = F.col("event_id").cast("long")
    payload = F.when(at % 3 == 0, F.concat(F.lit('{"decision_id":"d-'), at.cast("string"), F.lit('"}'))).otherwise("{}")
    rows = table(spark, d, "events").select(ulid(F.lit(1_700_000_000_000) + at * 1000, at).alias("id"), F.lit("decision.deleted").alias("kind"), F.col("event_type").alias("actor"), (at * 1000).alias("created_at"), F.lit("").alias("project_id"), payload.alias("payload"))
    nodes = spark.createDataFrame([], "id string, kind string, name string, status string, data string")
    hand_on = lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/sent/batch={number}")
    for part in (rows, rows.where(at % 3 == 2)):
        part.write.mode("append").json(f"{folder}/in")
        pipeline.run_pipeline(pipeline.read_events(spark, f"{folder}/in", 1_000_000), lambda: nodes, f"{folder}/log", f"{folder}/mutations", f"{folder}/state", hand_on).awaitTermination()
    sent = spark.read.parquet(f"{folder}/sent")
    actors = spark.read.parquet(f"{folder}/log").select(F.col("id").alias("seq"), "actor")
    return sent.join(actors, "seq").groupBy("type", F.col("actor").alias("kind")).agg(F.count("*").alias("count"), F.count_distinct("seq").alias("ids"))


@query("maintained_edges", _project_sql(1.5, "edges").replace("from part\n", "from part where p_partkey % 5 <> 0\n").replace("where next is not null", "where next is not null and o_orderkey % 11 <> 0"))
def maintained_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges of files' groups, kept up to date: a third of the parts come, a fifth and some calls go."""
    nodes, edges = checkpoint(graph_nodes(spark, d)), graph_edges(spark, d)
    none = spark.createDataFrame([], edges.schema)
    number = F.regexp_extract("id", "[0-9]+", 0).cast("long")
    at = lambda k: (F.col("kind") == "component") & (number % k == 0)
    represented = lambda rows: projection.project(rows, none, 1.5).representative
    view = maintained.EdgeView(spark, _folder(spark, "view")).start(edges, represented(nodes.where(~at(3))))
    gone = nodes.where(at(5)).select("id", F.lit(None).cast("string").alias("rep"))
    cut = graph_edges(spark, d, ("CALLS",)).where(F.regexp_extract("source_id", "[0-9]+", 0).cast("long") % 11 == 0)
    view.apply(none, cut, represented(nodes.where(at(3) & ~at(5))).unionByName(gone))
    return view.edges().select("source_id", "target_id", "aggregate", "count", "relation", F.size("relations").cast("long").alias("relations"))


@query("bm25_segments", _BM25)
def bm25_segments(spark: SparkSession, d: str) -> DataFrame:
    """Documents indexed in five updates: halves with other words first, then all as they are, and some that come and go."""
    text = table(spark, d, "documents").select(F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("node_id"), F.col("text").alias("description"), "doc_id")
    kept = segments.SegmentedIndex(spark, _folder(spark, "segments"), ("description",))
    other = lambda rows, word: rows.withColumn("description", F.concat_ws(" ", F.lit(word), "node_id"))
    kept.update(other(text.where("doc_id % 2 = 0"), "the old"))
    kept.update(other(text.where("doc_id % 3 = 0"), "and new"))
    kept.update(other(text.where("doc_id % 5 = 0").withColumn("node_id", F.concat(F.lit("x"), "node_id")), "the and"))
    kept.update(text.where("doc_id % 2 = 1"), text.where("doc_id % 5 = 0").select(F.concat(F.lit("x"), "node_id").alias("node_id")))
    kept.update(text.where("doc_id % 2 = 0"))
    return kept.search("the OR and").select("node_id", F.round("rank", 9).alias("rank"))


@query("saved_graph", f"""{GRAPH}, n as (select *, cast(substr(id, 3) as bigint) as k from g_nodes where kind in ('decision', 'path', 'file')), left_nodes as (select * from n where kind <> 'decision' or k % 7 <> 0)
    select 'node' as part, id, case when kind = 'decision' and k % 5 = 0 then 'renamed' else name end as value, case when kind = 'decision' and k % 5 = 0 then 'team' else 'personal' end as tier from left_nodes
    union all select distinct 'edge', source_id, target_id, relation from g_edges where relation in ('GOVERNS', 'SUPERSEDES') and source_id in (select id from left_nodes) and target_id in (select id from left_nodes)
    union all select 'annotation', id, 'e', 'e' from left_nodes where kind = 'decision' and k % 3 = 0""")  # fmt: skip
def saved_graph(spark: SparkSession, d: str) -> DataFrame:
    """Decisions and what they govern, saved under the first schema version, opened by another session under the last, changed, and opened again."""
    folder, kinds = _folder(spark, "saved"), ("decision", "path", "file")
    number = F.substring("id", 3, 20).cast("long")
    none, at = F.lit(None).cast("string"), F.lit("2020-01-01T00:00:00.000Z")
    old = saved.SavedGraph(spark, folder, buckets=16, version=1)
    old.load("nodes", graph_nodes(spark, d, kinds).select("id", "kind", "name", "qualified_name", "file_path", none.alias("data"), at.alias("created_at")))
    old.load("edges", graph_edges(spark, d, ("GOVERNS", "SUPERSEDES")).withColumn("created_at", at))
    kept = saved.SavedGraph(spark.newSession(), folder)
    decisions = kept.read("nodes").where("kind = 'decision'")
    kept.upsert("nodes", decisions.where(number % 5 == 0).withColumns({"name": F.lit("renamed"), "tier": F.lit("team"), "updated_at": F.lit("2020-01-02T00:00:00.000Z")}))
    kept.upsert("annotations", decisions.where(number % 3 == 0).select(F.col("id"), F.col("id").alias("decision_id"), F.lit("e").alias("edge_id"), at.alias("created_at")))
    kept.remove_nodes(decisions.where(number % 7 == 0))
    again = saved.SavedGraph(spark, folder, "reopened")
    assert again.list_tables() == ["reopened_annotations", "reopened_edges", "reopened_events", "reopened_nodes"]
    return spark.sql("""select 'node' as part, id, name as value, tier from reopened_nodes union all select 'edge', source_id, target_id, relation from reopened_edges
        union all select 'annotation', decision_id, edge_id, edge_id from reopened_annotations""")


@query("connector_search", """select 'search' as asked, cast(doc_id as varchar) as id, 'docs://' || doc_id as url, '{"length":' || length(text) || '}' as metadata from documents where contains(text, 'of the') and contains(text, 'and')
    union all select 'resolve', cast(item_id as varchar), 'bench://' || item_id, '{"length":' || length(text) || '}' from benchmark where item_id in (3, 5)""")  # fmt: skip
def connector_search(spark: SparkSession, d: str) -> DataFrame:
    """Two systems outside behind one interface: documents that are searched, items that are resolved."""
    docs = connector.Connector(spark, "docs", f"{d}/documents.parquet", "doc_id", url="docs://")
    items = connector.Connector(spark, "bench", f"{d}/benchmark.parquet", "item_id", url="bench://")
    columns = ("id", "url", "metadata")
    found = docs.search("of the").where(F.contains("title", F.lit("and")))
    return found.select(F.lit("search").alias("asked"), *columns).unionByName(items.resolve("3", "5", "none").select(F.lit("resolve").alias("asked"), *columns))
