"""Tables, the graph views derived from them, and the union of a local graph with a code index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import LABEL_KINDS
from .session import checkpoint

#: Characters by which short items are looked for.
ANCHOR = 8
#: Numbers of words by which other items are looked for, the most that an item has.
GRAMS = (6, 3, 1)
#: Items, and bytes of their texts, up to which every task gets all of them.
ITEM_ROWS, ITEM_BYTES = 200_000, 32 << 20
RELATIONS = ("CALLS", "IMPORTS", "GOVERNS", "SUPERSEDES", "REFERENCES")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _keyed(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix + "-"), F.col(column).cast("string"))


def graph_nodes(spark: SparkSession, folder: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(id, kind, label, name, qualified_name, file_path) of the star schema; only the kinds asked for are read."""
    none = F.lit(None).cast("string")
    places = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, folder, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    path = F.concat_ws("/", "r_name", "n_name", "c_mktsegment", F.concat("c_name", F.lit(".ts")))

    def rows(df: DataFrame, id_: Column, kind: str, label: str, name: Column, qn: Column = none, file: Column = none) -> DataFrame:
        return df.select(id_.alias("id"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), name.alias("name"), qn.alias("qualified_name"), file.alias("file_path"))

    def orders() -> DataFrame:
        joined = table(spark, folder, "orders").join(customers.select("c_custkey", path.alias("path")), F.col("o_custkey") == F.col("c_custkey"))
        name = F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string"))
        return rows(joined, _keyed("o", "o_orderkey"), "function", "Function", name, F.concat("path", F.lit("::"), name), F.col("path"))

    def parts() -> DataFrame:
        file = F.concat(F.lit("parts/"), "p_brand", F.lit("/"), "p_type", F.lit(".ts"))
        symbol = F.concat(F.col("p_name"), F.lit("#"), F.col("p_partkey").cast("string"))
        return rows(table(spark, folder, "part"), _keyed("p", "p_partkey"), "component", "Class", F.col("p_name"), F.concat(file, F.lit("::"), symbol), file)

    made = {
        "path": lambda: rows(places, _keyed("n", "n_nationkey"), "path", "Folder", F.col("n_name"), file=F.concat("r_name", F.lit("/"), "n_name", F.lit("/"))),
        "file": lambda: rows(customers, _keyed("c", "c_custkey"), "file", "File", F.concat("c_name", F.lit(".ts")), file=path),
        "function": orders,
        "component": parts,
        "reference": lambda: rows(table(spark, folder, "benchmark"), _keyed("b", "item_id"), "reference", "Reference", F.concat(F.lit("Bench#"), F.col("item_id").cast("string"))),
        "decision": lambda: rows(table(spark, folder, "documents"), _keyed("d", "doc_id"), "decision", "Decision", F.substring("text", 1, 40)),
    }
    out = None
    for kind in kinds or tuple(made):
        out = made[kind]() if out is None else out.unionByName(made[kind]())
    return out


def graph_edges(spark: SparkSession, folder: str, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """(source_id, target_id, relation) of the star schema; only the relations asked for are read."""

    def calls() -> DataFrame:
        following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        return table(spark, folder, "orders").withColumn("next", following).where("next is not null").select(_keyed("o", "o_orderkey").alias("source_id"), _keyed("o", "next").alias("target_id"))

    def imports() -> DataFrame:
        return table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").distinct().select(_keyed("o", "l_orderkey").alias("source_id"), _keyed("p", "l_partkey").alias("target_id"))

    def governs() -> DataFrame:
        customers = table(spark, folder, "customer").agg(F.count("*")).scalar()
        odd = F.concat(F.lit("c-"), (F.col("doc_id") * 7 % customers).cast("string"))
        even = F.concat(F.lit("n-"), (F.col("doc_id") % 25).cast("string"))
        return table(spark, folder, "documents").select(_keyed("d", "doc_id").alias("source_id"), F.when(F.col("doc_id") % 2 == 0, even).otherwise(odd).alias("target_id"))

    def supersedes() -> DataFrame:
        previous = F.lag("doc_id").over(Window.partitionBy(F.md5("text")).orderBy("doc_id"))
        return table(spark, folder, "documents").withColumn("old", previous).where("old is not null").select(_keyed("d", "doc_id").alias("source_id"), _keyed("d", "old").alias("target_id"))

    made = {"CALLS": calls, "IMPORTS": imports, "GOVERNS": governs, "SUPERSEDES": supersedes, "REFERENCES": lambda: quotes(table(spark, folder, "documents"), table(spark, folder, "benchmark"))}
    out = None
    for relation in relations:
        rows = made[relation]().withColumn("relation", F.lit(relation))
        out = rows if out is None else out.unionByName(rows)
    return out


def quotes(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that contain an item's whole text.

    All but the first and last word of an item stand whole, next to one another, in a text that contains it. So an item of three words or more is
    looked for by some of these (GRAMS), those that the fewest items have; shorter ones by their first characters, ANCHOR at most, among
    all windows of the texts of as many characters. Where the items fit into every task, a text is compared with those that it may contain
    where it is read, and nothing is shuffled; else candidates are joined first. An empty item is no reference.
    """
    words = lambda c: F.split(c, r"[ \n]+")
    grams = lambda k: F.expr(f"transform(sequence(0, size(own) - {k}), i -> struct(own[i] as first, xxhash64({', '.join(f'own[i + {j}]' for j in range(k))}) as key))")
    cut = items.where("text <> ''").select("item_id", F.col("text").alias("item"), words(F.col("text")).alias("w"))
    size = F.size("w") - 2
    most = reduce(lambda found, k: found.when(size >= k, F.lit(k)), GRAMS, F.when(F.lit(False), F.lit(0)))
    long = cut.where(size >= GRAMS[-1]).withColumns({"own": F.expr("slice(w, 2, size(w) - 2)"), "k": most})
    every = reduce(DataFrame.unionByName, [long.where(F.col("k") == k).select("item_id", "k", F.explode(grams(k)).alias("gram")) for k in GRAMS])
    seen = every.groupBy("k", "gram").agg(F.count("*").alias("seen"))
    rarest = every.join(seen, ["k", "gram"]).groupBy("item_id", "k").agg(F.min(F.struct("seen", "gram")).alias("least"))
    keyed = cut.join(rarest.select("item_id", "k", F.col("least.gram.first").alias("first"), F.col("least.gram.key").alias("key")), "item_id").select("item_id", "item", "k", "first", "key")
    start = F.left("item", F.lit(ANCHOR))
    short = cut.where(size < GRAMS[-1]).select("item_id", "item", (-F.length(start)).alias("k"), start.alias("first"), F.xxhash64(start).alias("key"))
    held = checkpoint(keyed.unionByName(short))
    rows, letters = held.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("item") + 64), F.lit(0))).first()
    small = rows <= ITEM_ROWS and letters <= ITEM_BYTES
    texts = docs.where("text is not null").select("doc_id", "text")
    found = []
    for k in sorted(r.k for r in held.select("k").distinct().collect()):  # GRAMS and ANCHOR rows at most
        wanted = held.where(F.col("k") == k)
        if k > 0:
            placed = texts.withColumn("w", words(F.col("text"))).select("doc_id", "text", "w", F.posexplode("w").alias("at", "first"))
            if small:  # only where a key may begin
                placed = placed.join(F.broadcast(wanted.select("first").distinct()), "first", "left_semi")
            at = placed.select("doc_id", "text", F.xxhash64("first", *(F.get("w", F.col("at") + j) for j in range(1, k))).alias("key"))
        else:
            windows = F.expr(f"array_distinct(transform(sequence(1, length(text) + {k} + 1), i -> xxhash64(substr(text, i, {-k}))))")
            at = texts.where(F.length("text") >= -k).select("doc_id", "text", F.explode(windows).alias("key"))
        if small:
            found.append(at.join(F.broadcast(wanted.select("item_id", "item", "key")), "key").where(F.contains("text", "item")).select("doc_id", "item_id"))
        else:
            pairs = at.select("doc_id", "key").join(wanted.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
            found.append(pairs.join(texts, "doc_id").join(wanted.select("item_id", "item"), "item_id").where(F.contains("text", "item")).select("doc_id", "item_id"))
    if not found:
        found = [texts.join(items.select("item_id").limit(0), F.lit(True)).select("doc_id", "item_id")]
    return reduce(DataFrame.unionByName, found).distinct().select(_keyed("d", "doc_id").alias("source_id"), _keyed("b", "item_id").alias("target_id"))


def attach_index(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """The code index's projects, nodes and edges, read-only; None unless all three are there."""
    found = {}
    for name in ("projects", "nodes", "edges"):
        try:
            found[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
    return found


def discover_index(spark: SparkSession, folders: list[str], root: str, explicit: str | None = None) -> str | None:
    """The index folder named, or the first one with a project of this root; folders that cannot be read are passed over."""
    if explicit is not None:
        return explicit if attach_index(spark, explicit) else None
    for folder in sorted(folders):
        index = attach_index(spark, folder)
        if index and not index["projects"].where(F.col("root_path") == root).isEmpty():
            return folder
    return None


def label_kind(label: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LABEL_KINDS.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(label)), F.lower(label))


def unified_nodes(local: DataFrame, index: dict[str, DataFrame] | None = None, project: str | None = None) -> DataFrame:
    """Local nodes and, if an index and a project are given, that project's nodes, personal ones, under ids of their own.

    Columns that local nodes lack are null, as are the data of an index without properties.
    """
    columns = ("id", "kind", "name", "qualified_name", "file_path", "data", "tier", "created_at", "updated_at")
    local = local.select(*(F.col(c) if c in local.columns else F.lit(None).cast("string").alias(c) for c in columns))
    if not index or project is None:
        return local
    times = index["projects"].where(F.col("name") == project).select(F.col("name").alias("project"), "indexed_at")
    outer = index["nodes"].where(F.col("project") == project).join(times, "project", "left").select(
        F.concat(F.lit("cbm-"), F.col("id").cast("string")).alias("id"), label_kind(F.col("label")).alias("kind"), "name", "qualified_name", "file_path",
        (F.col("properties") if "properties" in index["nodes"].columns else F.lit(None).cast("string")).alias("data"), F.lit("personal").alias("tier"), F.col("indexed_at").alias("created_at"), F.col("indexed_at").alias("updated_at"),
    )
    return local.unionByName(outer)


def unified_edges(local: DataFrame, index: dict[str, DataFrame] | None = None, project: str | None = None) -> DataFrame:
    local = local.select("source_id", "target_id", "relation")
    if not index or project is None:
        return local
    outer = index["edges"].where(F.col("project") == project)
    prefixed = [F.concat(F.lit("cbm-"), F.col(c).cast("string")).alias(c) for c in ("source_id", "target_id")]
    return local.unionByName(outer.select(*prefixed, F.col("type").alias("relation")))


def with_aliases(edges: DataFrame) -> DataFrame:
    """Edges as exported: source and target beside source_id and target_id."""
    return edges.withColumn("source", F.col("source_id")).withColumn("target", F.col("target_id"))


def text_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, text) of every line, counted from 1."""
    return texts.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("at", "text")).select(key, (F.col("at") + 1).alias("line"), "text")
