import json
import random

from pyspark.sql import functions as F

from loomgraph.operators.events import derive, fold_edges, fold_nodes
from loomgraph.sources.schema import MUTATIONS
from loomgraph.streaming import pipeline
from loomgraph.streaming.git import COMMITS, GitLogReader, git_stream
from loomgraph.streaming.live import live_changes, live_edges, live_nodes
from loomgraph.streaming.pipeline import event_windows, read_events, run_pipeline, touched


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = [{"id": f"{i:03d}", "kind": "decision.created", "actor": "a", "created_at": i * 1000, "project_id": "", "payload": json.dumps({"decision_id": f"d{i % 4}", "governed_file_ids": ["f"]})} for i in range(10)]
    source = tmp_path / "in"
    source.mkdir()
    for k in range(2):
        (source / f"{k}.json").write_text("\n".join(map(json.dumps, rows[: 5 + 5 * k])))  # the second repeats the first
    nodes = spark.createDataFrame([(f"d{i}", "decision", f"D{i}", "active", "{}") for i in range(3)], "id string, kind string, name string, status string, data string")
    log, made = str(tmp_path / "log"), str(tmp_path / "mutations")
    run_pipeline(read_events(spark, str(source), 1), lambda: nodes, log, made, str(tmp_path / "check")).awaitTermination()
    stored = spark.read.parquet(log)
    assert stored.count() == 10 and stored.select("id").distinct().count() == 10
    batch = derive(spark.createDataFrame(rows), nodes)
    key = ["seq", "pos", "op", "id"]
    assert sorted(map(tuple, spark.read.parquet(made).select(*key).collect()), key=str) == sorted(map(tuple, batch.select(*key).collect()), key=str)
    assert fold_nodes(spark.read.parquet(made)).count() == 3
    assert event_windows(stored, "5 seconds").agg(F.sum("count")).first()[0] == 10


def run_stream(stream, folder, out, **options):
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(folder)).option("path", str(out)).trigger(availableNow=True).options(**options).start()
    query.awaitTermination()


def test_git_logs_give_each_commit_once(spark, tmp_path):
    logs, out, state = tmp_path / "logs", tmp_path / "out", tmp_path / "state"
    logs.mkdir()

    def log(name, *hashes):
        (logs / f"{name}.log").write_text("".join(f"{h}\x00about {h}\x00ann\x00{h[1:]}\n\nM\tsrc/{h}.ts\nR100\told\tnew.ts\n" for h in hashes))

    def seen():
        return sorted((r.source, r.hash) for r in spark.read.schema(COMMITS).parquet(str(out)).collect())

    log("a", "h2", "h1")
    log("rebased", "h5", "h4")
    run_stream(git_stream(spark, str(logs)), state, out)
    assert seen() == []  # heads only
    log("a", "h4", "h3", "h2", "h1")
    log("rebased", "h9", "h8")
    log("new", "h1")
    run_stream(git_stream(spark, str(logs)), state, out)
    assert seen() == [("a", "h3"), ("a", "h4")]
    run_stream(git_stream(spark, str(logs)), state, out)  # a restart with nothing new
    log("a", "h6", "h5", "h4", "h3", "h2", "h1")
    log("new", "h2", "h1")
    run_stream(git_stream(spark, str(logs)), state, out)
    assert seen() == [("a", f"h{k}") for k in (3, 4, 5, 6)] + [("new", "h2")]
    row = spark.read.parquet(str(out)).where("hash = 'h3'").first()
    assert (row.message, row.author, row.timestamp, [tuple(f) for f in row.files]) == ("about h3", "ann", 3, [("src/h3.ts", "M"), ("new.ts", "R")])


def test_a_range_of_commits_stays_as_it_was_when_the_log_grows(tmp_path):
    (tmp_path / "a.log").write_text("".join(f"h{k}\x00m\x00x\x00{k}\n" for k in (5, 4, 3, 2, 1)))
    reader = GitLogReader(str(tmp_path))
    found = [r[1] for p in reader.partitions({"a": "h1"}, {"a": "h3"}) for r in reader.read(p)]
    assert found == ["h3", "h2"] and reader.latestOffset() == {"a": "h5"}


def test_live_state_is_the_fold_however_batches_are_cut(spark, tmp_path):
    rnd = random.Random(6)
    rows = []
    for seq in range(240):
        op = rnd.choice(("add_node", "add_node", "update_node", "remove_node", "add_edge", "add_edge", "add_edge", "remove_edge"))
        node, ends = f"n{rnd.randint(0, 7)}", {"source_id": f"n{rnd.randint(0, 7)}", "target_id": f"n{rnd.randint(0, 7)}", "relation": rnd.choice("XY")}
        own = {"id": node} if "node" in op else ends
        if op in ("add_node", "update_node"):
            own |= {f: rnd.choice((None, f"{f}{seq}")) for f in ("kind", "name", "status", "data")}
        rows.append({"seq": seq // 2, "pos": seq % 2, "op": op, **own})
    names = [f.split()[0] for f in MUTATIONS.split(", ")]
    frame = lambda part: spark.createDataFrame([tuple(r.get(n) for n in names) for r in part], MUTATIONS)
    want_nodes, want_edges = fold_nodes(frame(rows)).collect(), fold_edges(frame(rows)).collect()
    assert want_nodes and want_edges
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for cuts in ([], [3], sorted(rnd.sample(range(1, 240), 4))):
            folder = tmp_path / f"cut{len(cuts)}"
            (folder / "in").mkdir(parents=True)
            stream = spark.readStream.schema(MUTATIONS).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
            for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, 240], strict=True)):
                (folder / "in" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[a:b]))
                # a new run for each file: the state is read back after a restart
                run_update(live_changes(stream), folder)
            changes = spark.read.parquet(str(folder / "out"))
            assert sorted(live_nodes(changes).collect()) == sorted(want_nodes)
            assert sorted(live_edges(changes).collect()) == sorted(want_edges)
            ever = {r.id: r.v for r in changes.where("part = 'node'").groupBy("id").agg(F.max("version").alias("v")).collect()}
            assert ever == {n: sum(r.get("id") == n for r in rows) for n in ever}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run_update(stream, folder):
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def test_a_batch_reads_only_the_ranges_that_its_ids_lie_in(spark, tmp_path):
    source, log = tmp_path / "in", tmp_path / "log"
    source.mkdir()
    nodes = spark.createDataFrame([], "id string, kind string, name string, status string, data string")
    sent = []
    event = lambda minute, k: {"id": f"{minute:06d}" + f"{k:020d}", "kind": "decision.deleted", "actor": "a", "created_at": k, "project_id": "", "payload": '{"decision_id":"d"}'}
    for k in range(5):
        # the events of two ranges, one of them again
        (source / f"{k}.json").write_text("\n".join(json.dumps(event(m, i)) for m, i in ((k, 1), (k, 2), (max(0, k - 1), 2))))
        run_pipeline(read_events(spark, str(source), 1), lambda: nodes, str(log), str(tmp_path / "made"), str(tmp_path / "state"), lambda rows, n: sent.append([(r.seq, r.pos, r.type) for r in rows.collect()])).awaitTermination()
    stored = spark.read.parquet(str(log))
    assert stored.count() == 10 == stored.select("id").distinct().count()
    last = spark.createDataFrame([event(4, 1), event(3, 2)])
    kept = touched(stored, last)
    assert kept.count() == 4 and {f.split("range=")[1][:6] for f in kept.inputFiles()} >= {"000003", "000004"}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "range" in plan.split("PartitionFilters")[1].split("]")[0]
    assert [(pos, kind) for rows in sent for _, pos, kind in rows] == [(-1, "event"), (0, "mutation")] * 10
    assert all(rows == sorted(rows) for rows in sent)


def test_a_large_batch_goes_to_few_ranges_and_is_found_in_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pipeline, "WRITTEN", 8)
    source, log = tmp_path / "in", tmp_path / "log"
    source.mkdir()
    nodes = spark.createDataFrame([], "id string, kind string, name string, status string, data string")
    sent = []
    event = lambda minute, k: {"id": f"{minute:06d}" + f"{k:020d}", "kind": "decision.deleted", "actor": "a", "created_at": k, "project_id": "", "payload": '{"decision_id":"d"}'}
    # many ranges; then one of them, a new one, and a short id; then many again, of which some are known
    batches = [[event(m, 1) for m in range(60)], [event(17, 1), event(17, 2), event(90, 1), event(0, 1) | {"id": "s"}], [event(m, k) for m in range(50, 100) for k in (1, 2)] + [event(0, 1) | {"id": "s"}]]
    for named in (1000, 3):
        monkeypatch.setattr(pipeline, "NAMED", named)
        for k, rows in enumerate(batches):
            (source / f"{named}-{k}.json").write_text("\n".join(map(json.dumps, rows)))
            run_pipeline(read_events(spark, str(source), 1), lambda: nodes, str(log), str(tmp_path / "made"), str(tmp_path / "state"), lambda rows, n: sent.append(rows.where("type = 'event'").count())).awaitTermination()
        if named == 1000:
            assert len([f for f in log.rglob("*.parquet") if "batch=0" in str(f)]) <= 8
    want = {r["id"] for rows in batches for r in rows}
    stored = spark.read.parquet(str(log))
    assert stored.count() == len(want) and {r.id for r in stored.select("id").collect()} == want
    assert sent == [60, 3, 100 - 10 - 1, 0, 0, 0]
