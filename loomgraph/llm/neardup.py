"""Near-duplicate vectors by sorted projection passes.

Equal vectors stand as one with their number. Each pass gives every distinct vector the concatenated signs of its products with random vectors. Vectors are
put in the order of those signs, and each is compared with a bounded number of its followers; pairs
of cosine 0.93 or more, verified in double precision, are united over all passes into components.
The number of passes follows the label's size, as for vectors spread evenly. Then recall is measured in each label: some of its
vectors are compared with all of it. Where links between components turn up, as many more passes follow as these
links call for, and measured again; where that would compare as much as all pairs do, all pairs are compared, in blocks.

The window bounds what is compared while searching, not what is linked: within a component every
pair counts. Vectors within half the angle of its first vector link with one another for certain and
are only counted; each other vector is compared with all of the component, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .session import bucket, checkpoint, ship

COSINE, PASSES, BITS, WINDOW, SEED = 0.93, 16, 62, 48, 7
#: What share of lone pairs of cosine COSINE may be missed, and the chance that such a pair has a sign in common.
MISSED, AGREE = 0.001, 1 - np.arccos(COSINE) / np.pi
#: Vectors in a block of a component or label.
BLOCK = 1024
#: Vectors of a label that are compared with all of it, the share of their links that must be in components, and rounds of passes before all pairs are compared.
SAMPLE, RECALL, ROUNDS = 128, 0.99, 2
#: Cosine of half the angle of COSINE, and a margin for rounding on the side of comparing.
HALF = np.sqrt((1 + COSINE) / 2) + 1e-9
_VALID = "vec_id long, part string, vector binary"


def _valid(vectors: DataFrame) -> DataFrame:
    """vec_id, part (label and length) and the vector's doubles, for those that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            column = batch.column(2)
            for i, (vec, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                values = column[i].values
                if values is None or not len(values) or values.null_count:
                    continue
                x = values.to_numpy().astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    x = x / np.abs(x).max()  # lest squares leave the range of doubles
                    out.append((vec, f"{label}/{len(x)}", (x / np.sqrt(x @ x)).tobytes()))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary())], ["vec_id", "part", "vector"])

    usable = vectors.where("label is not null and embedding is not null and vec_id is not null")
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding").mapInArrow(run, _VALID)


def passes(rows: int) -> int:
    """Passes to begin with for a label of so many vectors (_searched has the same in columns): where about log2(rows / WINDOW) leading signs in common bring a pair together."""
    alike = AGREE ** max(1.0, np.log2(max(1, rows) / WINDOW))
    return max(PASSES, int(np.ceil(np.log(MISSED) / np.log(1 - alike))))


def _signed(rows: DataFrame) -> DataFrame:
    """A row for each pass from low to high of rows (vec_id, part, vector, low, high), with the signs as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = 1 << np.arange(BITS, dtype=np.int64)[::-1]
        for batch in batches:
            raw, low, high = batch.column(2).to_pylist(), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            sizes = np.array([len(r) // 8 for r in raw])
            for k in range(int(low.min(initial=0)), int(high.max(initial=0))):
                for d in np.unique(sizes[(low <= k) & (k < high)]).tolist():
                    which = np.flatnonzero((sizes == d) & (low <= k) & (k < high))
                    own = batch.take(pa.array(which))
                    x = np.frombuffer(b"".join(raw[i] for i in which), np.float64).reshape(-1, d)
                    if (d, k) not in planes:
                        planes[d, k] = np.random.default_rng([SEED, d, k]).standard_normal((d, BITS))
                    signs = x @ planes[d, k] > 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), own.column(1), pa.array(signs @ weights), own.column(0), own.column(2)], ["pass", "part", "signs", "vec_id", "vector"])

    return rows.select("vec_id", "part", "vector", F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high")).mapInArrow(run, "pass int, part string, signs long, vec_id long, vector binary")


def _matrix(column: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw[i] for i in rows), np.float64).reshape(len(rows), -1)


def _all_links(rows: DataFrame) -> DataFrame:
    """(a, b): the links of whole parts, rows (vec_id, part, vector, n), as far as they connect anew; block by block."""

    def compare(found: pa.Table) -> pa.Table:
        sides, ids = found.column("side").to_numpy(), found.column("vec_id").to_numpy()
        one, two = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        pairs: set[tuple[int, int]] = set()
        if len(one) and len(two):
            i, j = np.nonzero(_matrix(found.column("vector"), one) @ _matrix(found.column("vector"), two).T >= COSINE)
            other = ids[one[i]] != ids[two[j]]
            pairs = _connecting(ids[one[i[other]]], ids[two[j[other]]])
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    blocks = F.ceil(F.col("n") / BLOCK)
    placed = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(bucket("vec_id"), "blocks"))
    unit = ("part", "first", "second", "side", "vec_id", "vector")
    lower = placed.withColumn("second", F.explode(F.expr("sequence(block, blocks - 1)"))).withColumn("first", F.col("block")).withColumn("side", F.lit(0)).select(*unit)
    upper = placed.withColumn("first", F.explode(F.expr("sequence(0L, block)"))).withColumn("second", F.col("block")).withColumn("side", F.lit(1)).select(*unit)
    return lower.unionByName(upper).groupBy("part", "first", "second").applyInArrow(compare, "a long, b long")


def _sampled_links(rows: DataFrame) -> DataFrame:
    """(part, a, b): all links of some vectors of each part, rows (vec_id, part, vector, n)."""
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("vec_id"), "vec_id"))
    some = rows.withColumn("rank", rank).where(F.col("rank") <= SAMPLE)
    unit = ("part", "block", "side", "vec_id", "vector")
    blocks = F.ceil(F.col("n") / BLOCK)
    asked = rows.withColumn("block", F.pmod(bucket("vec_id"), blocks)).withColumn("side", F.lit(1)).select(*unit)
    asking = some.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).withColumn("side", F.lit(0)).select(*unit)

    def compare(found: pa.Table) -> pa.Table:
        sides, ids = found.column("side").to_numpy(), found.column("vec_id").to_numpy()
        one, two = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        a = b = np.zeros(0, np.int64)
        if len(one) and len(two):
            i, j = np.nonzero(_matrix(found.column("vector"), one) @ _matrix(found.column("vector"), two).T >= COSINE)
            other = ids[one[i]] != ids[two[j]]
            a, b = ids[one[i[other]]], ids[two[j[other]]]
        part = found.column("part")[0].as_py()
        return pa.table({"part": pa.array([part] * len(a), pa.string()), "a": a, "b": b})

    return asked.unionByName(asking).groupBy("part", "block").applyInArrow(compare, "part string, a long, b long")


def _searched(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect the vectors of each component, found by passes as many as each part needs."""
    spark = distinct.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["pass", "part", "signs", "vec_id"]
    sizes = distinct.groupBy("part").agg(F.count("*").alias("n"))
    alike = F.pow(F.lit(AGREE), F.greatest(F.lit(1.0), F.log2(F.col("n") / WINDOW)))
    first = F.greatest(F.lit(PASSES), F.ceil(F.lit(np.log(MISSED)) / F.log(1 - alike)))
    plan = checkpoint(sizes.withColumn("low", F.lit(0)).withColumn("high", first.cast("int")))
    links = None
    for last in [*(False for _ in range(ROUNDS)), True]:
        # of what is compared, all pairs have n / 2 to a vector and passes WINDOW each
        every = F.lit(last) if last else F.col("n") <= 4 * WINDOW * F.col("high")
        wanted = distinct.join(plan.withColumn("every", every), "part")
        signed = _signed(wanted.where("not every"))
        found = _window_links(signed.repartitionByRange(parts, *order).sortWithinPartitions(*order)).unionByName(_all_links(wanted.where("every")))
        links = checkpoint(found if links is None else links.unionByName(found))
        plan = plan.where(~every)
        if last or plan.isEmpty():
            return links
        roots = components(links).select("id", "root")
        end = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
        true = _sampled_links(distinct.join(plan.select("part", "n"), "part")).join(end("a"), "a", "left").join(end("b"), "b", "left")
        there = F.count_if(F.coalesce(F.col("a_root") == F.col("b_root"), F.lit(False))) / F.count("*")
        short = true.groupBy("part").agg(there.alias("recall")).where(F.col("recall") < RECALL)
        # a link is found in a pass with the chance that this recall after so many passes shows
        chance = 1 - F.pow(1 - F.greatest(F.col("recall"), F.lit(0.01)), 1 / F.col("high"))
        more = F.ceil(F.lit(np.log(MISSED)) / F.log(1 - chance)).cast("int")
        plan = checkpoint(plan.join(short, "part").select("part", "n", F.col("high").alias("low"), F.greatest(more, F.col("high") * 2).alias("high")))
        if plan.isEmpty():
            return links
    return links


def _window_links(ordered: DataFrame) -> DataFrame:
    """(a, b): what links within the window of an order, as far as it connects anew.

    The last vectors of a partition are not compared with the next one's first; every pass is cut
    elsewhere, and what is missed so counts in the recall that is measured.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            rows = held + list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            held = rows[-WINDOW:]
            groups: dict[tuple, list[tuple]] = {}
            for r in rows:
                groups.setdefault((r[0], r[1]), []).append(r)
            pairs = set()
            for own in groups.values():
                x = np.frombuffer(b"".join(r[4] for r in own), np.float64).reshape(len(own), -1)
                ids = np.array([r[3] for r in own])
                for at in range(0, len(own), 256):
                    cosine = x[at : at + 256] @ x[at : at + 256 + WINDOW].T
                    i, j = np.nonzero(cosine >= COSINE)
                    near = (j > i) & (j - i <= WINDOW)
                    pairs |= _connecting(ids[at + i[near]], ids[at + j[near]])
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def _connecting(a: np.ndarray, b: np.ndarray) -> set[tuple[int, int]]:
    """Of each vector the link to the smallest of its connected vectors among these."""
    up: dict[int, int] = {}

    def top(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        i, j = top(i), top(j)
        up[max(i, j)] = min(i, j)
    return {(top(i), i) for i in list(up) if top(i) != i}


def _links(members: DataFrame) -> DataFrame:
    """(vec_id, n_links) of members (component, vec_id, vector, times), each standing for times equal vectors."""
    heads = members.where("vec_id = component").select("component", F.col("vector").alias("head"))

    def cored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = [bool(np.frombuffer(v, np.float64) @ np.frombuffer(h, np.float64) >= HALF) for v, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(core, pa.bool_())], ["component", "vec_id", "vector", "times", "core"])

    told = checkpoint(members.join(heads, "component").select("component", "vec_id", "vector", "head", "times").mapInArrow(cored, "component long, vec_id long, vector binary, times long, core boolean"))
    size = told.groupBy("component").agg(F.count("*").alias("size"), F.count_if("core").alias("cores"), F.sum(F.when(F.col("core"), F.col("times"))).alias("certain")).withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    sized = told.join(size, "component")
    own = sized.select("vec_id", (F.when(F.col("core"), F.col("certain")).otherwise(F.col("times")) - 1).alias("n"))
    placed = sized.where("cores < size").withColumn("block", F.pmod(bucket("vec_id"), "blocks"))
    every = F.explode(F.expr("sequence(0L, blocks - 1)"))
    unit = ("component", "first", "second", "side", "vec_id", "vector", "times", "core")
    asking = placed.where("not core").withColumn("second", every).withColumn("first", F.col("block")).withColumn("side", F.lit(0)).select(*unit)
    asked = placed.withColumn("first", every).withColumn("second", F.col("block")).withColumn("side", F.lit(1)).select(*unit)

    def compare(found: pa.Table) -> pa.Table:
        sides, core = found.column("side").to_numpy(), np.array(found.column("core").to_pylist())
        x = np.frombuffer(b"".join(found.column("vector").to_pylist()), np.float64).reshape(len(sides), -1)
        ids, times = found.column("vec_id").to_numpy(), found.column("times").to_numpy()
        one, two = sides == 0, sides == 1
        linked = (x[one] @ x[two].T >= COSINE) & (ids[one][:, None] != ids[two][None, :])
        # of two vectors outside the core each asks for itself
        n = np.concatenate([linked @ times[two], (times[one] @ linked)[core[two]]])
        return pa.table({"vec_id": np.concatenate([ids[one], ids[two][core[two]]]), "n": n.astype(np.int64)})

    units = asking.unionByName(asked)
    counted = units.groupBy("component", "first", "second").applyInArrow(compare, "vec_id long, n long")
    return own.unionByName(counted).groupBy("vec_id").agg(F.sum("n").alias("n_links"))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors without a label, and null, empty or zero vectors and those with null or non-finite
    components link with nothing; neither do vectors of different lengths. A row without a vec_id
    links with nothing and is kept. Rows that repeat a vec_id stand for one vector, the least of
    theirs, and each get its figures. Other columns are ignored.
    """
    ship(vectors.sparkSession)
    least = _valid(vectors).groupBy("vec_id").agg(F.min(F.struct("part", "vector")).alias("x"))
    valid = checkpoint(least.select("vec_id", "x.part", "x.vector", F.sha2("x.vector", 256).alias("same")))
    # equal vectors would fill a window with one another
    distinct = checkpoint(valid.groupBy("part", "same").agg(F.min("vec_id").alias("vec_id"), F.first("vector").alias("vector"), F.count("*").alias("times")))
    links = _searched(distinct)
    roots = checkpoint(components(links))
    members = distinct.join(roots.select(F.col("id").alias("vec_id"), F.col("root").alias("component")), "vec_id").select("component", "vec_id", "vector", "times")
    counts = _links(members)
    linked = roots.join(counts, roots.id == counts.vec_id).select(F.col("id").alias("first"), "root", "n_links")
    figures = distinct.select("part", "same", F.col("vec_id").alias("first"), "times").join(linked, "first", "left")
    figures = checkpoint(figures.select("part", "same", F.coalesce("root", "first").alias("root"), F.coalesce("n_links", F.col("times") - 1).alias("n_links")))
    found = checkpoint(valid.select(F.col("vec_id").alias("id"), "part", "same").join(figures, ["part", "same"]).select("id", "root", "n_links"))
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = ids.join(found, ids.vec_id == found.id, "left").withColumn("component_id", F.coalesce("root", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
