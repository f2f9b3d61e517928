from loomgraph.operators.api import Service
from loomgraph.operators.store import Store
from loomgraph.sources import schema


def service(spark):
    nodes = [
        (1, "mill", "Function", "grindBeans", "mill.core.grinder.grindBeans", "core/grinder.ts", 12, 30, "{}"),
        (2, "mill", "Function", "weighDose", "mill.core.scale.weighDose", "core/scale.js", 2, 4, "{}"),
        (3, "mill", "Class", "Hopper", "mill.core.hopper.Hopper", "core/hopper.ts", 5, 44, "{}"),
    ]
    edges = [(1, "mill", 1, 2, "CALLS", "{}"), (2, "mill", 3, 1, "CALLS", "{}")]
    index = {
        "projects": spark.createDataFrame([("mill", "2024", "/mill")], schema.INDEX_PROJECTS),
        "nodes": spark.createDataFrame(nodes, schema.INDEX_NODES),
        "edges": spark.createDataFrame(edges, schema.INDEX_EDGES),
    }
    return Service(Store(spark), index, "mill")


def test_code_operations(spark):
    s = service(spark)
    files = spark.createDataFrame([("core/scale.js", "// grams\nfunction weighDose(g) {\n  return g\n}\n// done")], "file_path string, text string")
    assert s.trace_path("grindBeans").text == "Function core/scale.js::weighDose (core/scale.js:2-4) [d=1]"
    assert s.trace_path("grindBeans", "callers").text.startswith("Class core/hopper.ts::Hopper")
    assert s.trace_path("x", "sideways").is_error
    assert s.search_graph("DOSE").text.startswith("Function core/scale.js::weighDose")
    assert s.get_code_snippet("core/scale.js::weighDose", files).text.splitlines()[1] == "  return g"
    assert s.search_code("return|done", files).text.splitlines() == ["core/scale.js:3:  return g [weighDose]", "core/scale.js:5:// done"]
    assert "label Function: 2" in s.get_graph_schema().text and s.list_projects().text == "mill /mill (2024)"
    assert s.index_status("/q").text.startswith("No results") and not s.delete_project("mill").is_error
    assert Service(Store(spark)).search_graph().text.startswith("ERROR reason=project_not_found")


def test_decision_operations(spark):
    s = service(spark)
    decision = s.create_decision("Weigh every dose", "steady taste", "no guessing", governs=["core/"]).text
    assert decision in s.why_was_this_built("core/burr/steel.ts").text
    assert s.search_decisions("steady").text == f"Weigh every dose ({decision})"
    assert s.search_decisions("steady", scope="core/scale.js").text == f"Weigh every dose ({decision})"
    assert s.search_decisions("steady", scope="lib/scale.js").text.startswith("No results")
    assert "governs " in s.get_decision(decision).text
    assert s.promote_decision(decision, "team").text.startswith("promoted") and s.promote_decision(decision, "personal").is_error
    assert s.update_decision("none", title="x").text.startswith("No results") and s.create_decision("a", "b", "c", references=["none"]).is_error
    assert s.delete_decision(decision).text == f"deleted {decision}" and s.get_decision(decision).text.startswith("No results")
