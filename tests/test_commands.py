"""Batches of commands against the same commands one by one."""

import json
import random

from pyspark.sql import functions as F

from loomgraph.operators import commands as C

NAMES = [f.split()[0] for f in C.COMMANDS.replace(C.ALTERNATIVES, "x").split(", ")]


def batch_of(spark, rows):
    return spark.createDataFrame([tuple({"seq": k, **r}.get(n) for n in NAMES) for k, r in enumerate(rows)], C.COMMANDS)


def one_by_one(nodes, edges, rows, used):
    """nodes: id -> dict; edges: set of triples. Returns events and refused numbers; changes nodes and edges."""
    told, refused, used = [], [], set(used)
    lives = lambda i: i in nodes

    def target(t):
        if lives(t):
            return t
        found = sorted(i for i, n in nodes.items() if n["kind"] == "path" and n["file_path"] == t)
        if not found:
            nodes[f"new:{t}"] = {"kind": "path", "name": t.split("/")[-1] or t, "file_path": t, "tier": "public"}
            found = [f"new:{t}"]
        return found[0]

    for k, r in enumerate(rows):
        op, i = r["op"], r.get("id")
        ours = lives(i) and nodes[i]["kind"] == "decision"
        relation = r.get("relation") or "GOVERNS"
        if op in ("create", "add_node"):
            fresh = i not in used
            used.add(i)
            if not fresh or any(not lives(x) for x in r.get("references") or ()):
                refused.append(k)
                continue
            if op == "add_node":
                nodes[i] = {"kind": r["kind"], "name": r.get("title"), "file_path": r.get("file_path"), "tier": r.get("tier") or "personal"}
                continue
            nodes[i] = {"kind": "decision", "name": r["title"], "tier": "personal", "status": "active", "description": r.get("description"), "rationale": r.get("rationale")}
            files = [target(t) for t in r.get("governs") or ()]
            edges |= {(i, t, "GOVERNS") for t in files} | {(i, t, "REFERENCES") for t in r.get("references") or ()}
            told.append(("decision.created", {"decision_id": i, "files": files}))
        elif op == "update":
            newer = r.get("superseded_by")
            if not ours or (newer and not lives(newer)):
                refused.append(k)
                continue
            n = nodes[i]
            old = {"title": n["name"], **{x: n.get(x) for x in ("description", "rationale", "status")}}
            changed = [x for x in old if r.get(x) is not None and r[x] != old[x]]
            n |= {("name" if x == "title" else x): r[x] for x in old if r.get(x) is not None}
            if newer:
                edges.add((newer, i, "SUPERSEDES"))
                told.append(("decision.superseded", {"old_id": i, "new_id": newer}))
            elif changed:
                told.append(("decision.updated", {"decision_id": i, "changed": changed}))
        elif op == "promote":
            if not ours or r.get("tier") not in ("team", "public"):
                refused.append(k)
                continue
            told.append(("decision.promoted", {"decision_id": i, "from": nodes[i]["tier"], "to": r["tier"]}))
            nodes[i]["tier"] = r["tier"]
        elif op in ("delete", "remove_node"):
            if not (ours if op == "delete" else lives(i)):
                refused.append(k)
                continue
            if op == "delete":
                told.append(("decision.deleted", {"decision_id": i, "title": nodes[i]["name"]}))
            del nodes[i]
            for e in [e for e in edges if i in e[:2]]:
                edges.discard(e)
        elif op == "remove_edge":
            edges.discard((i, r["target"], relation))
        elif not lives(i) or (op == "link" and not r.get("target")) or ((op == "add_edge" or relation != "GOVERNS") and not lives(r.get("target"))):
            refused.append(k)
        else:
            edges.add((i, target(r["target"]) if op == "link" and relation == "GOVERNS" else r["target"], relation))
    return told, refused


def made_up(rnd, n):
    ids = [f"d{k}" for k in range(14)] + ["p0", "p1", "f0", "gone"]
    out = []
    for _ in range(n):
        op = rnd.choice(("create",) * 4 + ("update",) * 4 + ("delete", "promote", "link", "add_node", "remove_node", "add_edge", "remove_edge"))
        r = {"op": op, "id": rnd.choice(ids)}
        if op == "create":
            r |= {"id": rnd.choice(ids[:14]), "title": rnd.choice("xyz"), "description": "d", "rationale": rnd.choice("rs"), "governs": [rnd.choice((*ids, "src/a.ts", "src/new/", "lib/b")) for _ in range(rnd.randint(0, 3))], "references": [rnd.choice(ids) for _ in range(rnd.choice((0, 0, 1, 2)))]}
        elif op == "update":
            r |= {x: rnd.choice((None, *v)) for x, v in (("title", "xyz"), ("rationale", "rs"), ("status", ("active", "deprecated")))}
            if rnd.random() < 0.3:
                r["superseded_by"] = rnd.choice(ids)
        elif op == "promote":
            r["tier"] = rnd.choice(("team", "public", "personal"))
        elif op == "add_node":
            r |= {"id": f"n{rnd.randint(0, 5)}", "kind": rnd.choice(("path", "file")), "title": "t", "file_path": rnd.choice(("src/a.ts", "lib/b"))}
        elif op in ("link", "add_edge", "remove_edge"):
            r |= {"target": rnd.choice((*ids, "src/a.ts", "lib/b")), "relation": rnd.choice(("GOVERNS", "REFERENCES")) if op != "link" else rnd.choice((None, "GOVERNS", "REFERENCES"))}
        out.append(r)
    return out


def test_batches_against_one_by_one(spark):
    rnd = random.Random(4)
    for _ in range(4):
        start = {"d0": ("decision", "D0", None, "personal", '{"description":"a","rationale":"r","status":"active"}'), "p0": ("path", "a.ts", "src/a.ts", "public", "{}"), "p1": ("path", "a.ts", "src/a.ts", "public", "{}"), "f0": ("file", "f", "f.ts", "personal", "{}")}
        nodes = spark.createDataFrame([(i, *v[:4], None, v[4]) for i, v in start.items()], "id string, kind string, name string, file_path string, tier string, status string, data string")
        edges = spark.createDataFrame([("d0", "f0", "GOVERNS"), ("f0", "p0", "CALLS")], "source_id string, target_id string, relation string")
        rows = made_up(rnd, 60)
        mine = {i: {"kind": v[0], "name": v[1], "file_path": v[2], "tier": v[3], **json.loads(v[4])} for i, v in start.items()}
        links = {("d0", "f0", "GOVERNS"), ("f0", "p0", "CALLS")}
        told, refused = one_by_one(mine, links, rows, start)
        out = C.run_batch(batch_of(spark, rows), nodes, edges, "b", 1000)
        assert sorted(r.seq for r in out["refused"].collect()) == refused
        made = {r.id: f"new:{r.file_path}" for r in out["mutations"].where("op = 'add_node' and kind = 'path' and tier = 'public'").collect()}
        name = lambda i: made.get(i, i)
        after, left = C.apply_mutations(nodes, edges, out["mutations"])
        assert sorted((name(r.id), r.kind, r.name, r.tier) for r in after.collect()) == sorted((i, n["kind"], n["name"], n["tier"]) for i, n in mine.items())
        assert sorted((name(a), name(b), c) for a, b, c in left.collect()) == sorted(links)
        data = {r.id: json.loads(r.data) for r in after.where("kind = 'decision'").collect()}
        assert {i: (d.get("rationale"), d.get("status")) for i, d in data.items()} == {i: (n["rationale"], n["status"]) for i, n in mine.items() if n["kind"] == "decision"}
        got = []
        for r in out["events"].orderBy("seq").collect():
            p = json.loads(r.payload)
            got.append((r.kind, {
                "decision.created": lambda p: {"decision_id": p["decision_id"], "files": [name(x) for x in p["governed_file_ids"]]}, "decision.superseded": lambda p: {"old_id": p["old_id"], "new_id": p["new_id"]},
                "decision.updated": lambda p: {"decision_id": p["decision_id"], "changed": p["changed_fields"]}, "decision.promoted": lambda p: {"decision_id": p["decision_id"], "from": p["from_tier"], "to": p["to_tier"]},
                "decision.deleted": lambda p: {"decision_id": p["decision_id"], "title": p["title"]},
            }[r.kind](p)))
        assert got == told


def test_values_carried_over_blocks(spark):
    rnd = random.Random(9)
    rows = [(k, rnd.choice("ab"), rnd.choice((None, None, k))) for k in range(200)]
    got = C.carried(spark.createDataFrame(rows, "seq long, key string, v long"), "key", "seq", ("v",), 7)
    last, want = {}, {}
    for k, key, v in rows:
        want[k] = last.get(key)
        last[key] = v if v is not None else last.get(key)
    assert {r.seq: r.v_before for r in got.collect()} == want


def test_jobs_do_not_grow_with_commands(spark):
    nodes = spark.createDataFrame([], "id string, kind string, name string, file_path string, tier string, status string, data string")
    edges = spark.createDataFrame([], "source_id string, target_id string, relation string")

    def jobs(n):
        spark.sparkContext.setJobGroup(f"batch-{n}", "")
        made = spark.range(n).select(F.col("id").alias("seq"), F.lit("create").alias("op"), F.concat(F.lit("x"), "id").alias("id"), F.lit("t").alias("title"), F.array(F.concat(F.lit("p/"), (F.col("id") % 7).cast("string"))).alias("governs"))
        out = C.run_batch(spark.createDataFrame([], C.COMMANDS).unionByName(made, allowMissingColumns=True), nodes, edges, "b", 0)
        assert out["events"].count() == n and out["mutations"].where("kind = 'path'").count() == 7
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"batch-{n}"))

    few, many = jobs(30), jobs(3000)
    assert many <= few + 10
