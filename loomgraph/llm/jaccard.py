"""N-gram Jaccard join by signature trees.

No link is lost at any step:

1. *Partners.* Of a document that links, at least 75 of 100 shingles occur in another document.
   Blocks of documents send their shingles, 32 bits each, to shards by hash; a shard finds those that
   several blocks or several of a block's sets have; blocks add the counts up. Sets with fewer shared
   shingles are alone. (Equal 32-bit parts within a shard, and a copy of a set in another block, only
   keep a set that could have gone.) What is sent besides the shingles is a byte or two for each.
2. *Families.* Two sets that link share one of their first ``n - ceil(0.75 n) + 1`` shingles in any
   common order. With the rarest first, passages that many documents share come last. Sets are of
   one family if such first shingles connect them.
3. *Trees.* A family, in blocks of bounded size, is joined by signature trees: a node has the
   OR of its sets' bitmaps and their range of sizes, and a pair of nodes is left if even the
   largest possible overlap is too small, or if all their sets are connected already. A large family
   is first joined within blocks and with its first block; then only pairs of blocks that are
   neither connected nor excluded by their roots are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .session import bucket, checkpoint, ship, text_bytes
from .words import Words, chunks, mix, split

WORDS, SIMILAR = 5, 75
#: Bytes of text a block and a shard hold, shingles a block of a family holds, and sets under a leaf.
BLOCK_BYTES, SHARD_BYTES, FAMILY_SHINGLES, LEAF = 8 << 20, 32 << 20, 1 << 18, 8
_U = np.uint64
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def windows(words: Words, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows within texts, and the first word of each."""
    at = np.arange(len(words.hash) - n + 1)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = at[words.text[at] == words.text[at + n - 1]]
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total = mix(total * _STEPS[4] + words.hash[at + k] * _STEPS[k % 4])
    return total, at


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct shingles; of fewer words, of all words together."""
    words = split(data, bounds, lower=True)
    hashes, at = windows(words)
    first = words.first
    cut = np.searchsorted(at, first)
    sets = []
    for i in range(len(bounds) - 1):
        own = hashes[cut[i] : cut[i + 1]]
        if not len(own) and first[i + 1] > first[i]:
            short = np.zeros(1, np.uint64)
            for h in words.hash[first[i] : first[i + 1]]:
                short = mix(short * _STEPS[3] + h)
            own = short
        sets.append(np.unique(own))
    return sets


def set_key(shingles: np.ndarray) -> int:
    """64 bits that stand for the whole set."""
    total = int(np.add.reduce(mix(shingles + _STEPS[1]))) ^ len(shingles) * int(_STEPS[0])
    return int(np.array(total & (1 << 64) - 1, np.uint64).view(np.int64))


def _batch_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for at, _, data, bounds in chunks(batch.column(1)):
        yield from enumerate(shingle_sets(data, bounds), at)


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key) of every document; the key is null for no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in _batch_sets(batch)]
            keys = [set_key(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "n_shingles", "set_key"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key long")


def _narrow(x: np.ndarray) -> bytes:
    """Numbers below 2**32 in as few bytes each as the largest needs, which the first byte tells."""
    width = 1 if not len(x) or x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _sent(docs: DataFrame, shards: int) -> DataFrame:
    """A row for each block of documents and shard in which it has any shingle: the shingles there, and of each how far its set's number is from the last one's.

    Shingles that several of the block's sets have are sent once, as common. One row of a block also
    tells its distinct sets: their keys, sizes, and how many of their shingles are common.
    """

    def message(block: int, sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for s in sets.values()])
        tokens, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(tokens, kind="stable")
        run = np.flatnonzero(np.append(True, np.diff(tokens[order]) != 0))
        times = np.diff(np.append(run, len(order)))  # in different sets, as each set is distinct
        common, local = tokens[order][run[times > 1]], np.zeros(len(order), bool)
        local[order] = np.repeat(times > 1, times)
        shared = np.bincount(owner[local], minlength=len(sizes))
        shift = _U(64 - shards.bit_length() + 1)
        of_shard = lambda x: (x >> shift).astype(np.int64) if shards > 1 else np.zeros(len(x), np.int64)
        tokens, owner = tokens[~local], owner[~local]
        shard = of_shard(tokens)
        by_shard = np.argsort(shard, kind="stable")
        tokens, owner, shard, common_shard = tokens[by_shard].astype(np.uint32), owner[by_shard], shard[by_shard], of_shard(common)
        home = block % shards
        met = np.unique(np.concatenate([shard, common_shard, [home]]))  # no row for a shard in which the block has nothing
        ends, common_ends = ((np.searchsorted(x, met), np.searchsorted(x, met, "right")) for x in (shard, common_shard))
        rows = []
        for i, s in enumerate(met.tolist()):
            own = owner[ends[0][i] : ends[1][i]]
            told = (np.array(list(sets), np.int64).tobytes(), _narrow(sizes), _narrow(shared)) if s == home else (None, None, None)
            rows.append((s, block, *told, _narrow(np.diff(own, prepend=0)), tokens[ends[0][i] : ends[1][i]].tobytes(), common[common_ends[0][i] : common_ends[1][i]].astype(np.uint32).tobytes()))
        for at in range(0, len(rows), 16):
            cols = list(zip(*rows[at : at + 16], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], names)

    names = ["shard", "block", "keys", "sizes", "shared", "owners", "shingles", "common"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets, held = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for _, s in _batch_sets(batch):
                if len(s) and (key := set_key(s)) not in sets:
                    sets[key] = s
                    held += len(s)
                    if held * 6 > BLOCK_BYTES:
                        yield from message(block, sets)
                        block, sets, held = block + 1, {}, 0
        if sets:
            yield from message(block, sets)

    return docs.select("doc_id", "text").mapInArrow(run, "shard long, block long, " + ", ".join(f"{c} binary" for c in names[2:]))


def _count_shared(sent: DataFrame, shards: int) -> DataFrame:
    """Keys of the sets of which 75 in 100 shingles also occur in another set, or in another block's copy of their own."""

    def shard(found: pa.Table) -> pa.Table:
        rows = found.select(["block", "keys", "sizes", "shared"]).to_pylist()
        owners = [np.cumsum(_wide(x)) for x in found.column("owners").to_pylist()]
        tokens = np.concatenate([np.frombuffer(x, np.uint32) for x in found.column("shingles").to_pylist()])
        common = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in found.column("common").to_pylist()]))
        order = np.argsort(tokens, kind="stable")
        run = np.flatnonzero(np.append(True, np.diff(tokens[order]) != 0)) if len(order) else order
        times = np.diff(np.append(run, len(order)))
        shared = np.zeros(len(order), bool)
        if len(run):
            # a block sends none of them twice
            shared[order] = np.repeat((times > 1) | np.isin(tokens[order][run], common), times)
        out, at = [], 0
        for r, own in zip(rows, owners, strict=True):
            which, n = np.unique(own[shared[at : at + len(own)]], return_counts=True)
            at += len(own)
            if len(which) or r["keys"] is not None:
                out.append((r["block"], r["keys"], r["sizes"], r["shared"], _narrow(np.diff(which, prepend=0)), _narrow(n)))
        cols = list(zip(*out, strict=True)) or [()] * len(counted)
        return pa.table({c: pa.array(x, pa.binary() if i else pa.int64()) for i, (c, x) in enumerate(zip(counted, cols, strict=True))})

    counted = ["block", "keys", "sizes", "shared", "owners", "counts"]

    def block(found: pa.Table) -> pa.Table:
        keys, sizes, total = next(r for r in zip(*(found.column(c).to_pylist() for c in counted[1:4]), strict=True) if r[0] is not None)
        total = _wide(total)
        for own, n in zip(found.column("owners").to_pylist(), found.column("counts").to_pylist(), strict=True):
            total[np.cumsum(_wide(own))] += _wide(n)
        return pa.table({"set_key": np.frombuffer(keys, np.int64)[100 * total >= SIMILAR * _wide(sizes)]})

    made = sent.groupBy("shard").applyInArrow(shard, "block long, " + ", ".join(f"{c} binary" for c in counted[1:]))
    return made.groupBy("block").applyInArrow(block, "set_key long").distinct()


def _sets(docs: DataFrame) -> DataFrame:
    """(id, shingles, n), where the set's key is the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in chunks(batch.column(1)):
                sets = shingle_sets(data, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(list(map(set_key, sets)), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(list(map(len, sets)), pa.int64())], ["id", "shingles", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, shingles array<long>, n long")


def _families(sets: DataFrame) -> DataFrame:
    """(id, family) of the sets that share one of their rarest shingles with another."""
    each = sets.select("id", F.explode("shingles").alias("shingle"))
    seen = each.groupBy("shingle").agg(F.count("*").alias("seen")).where("seen > 1")
    ranked = each.join(seen, "shingle").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seen", "shingle"))).alias("shared"))
    # the shingles that no other set has come first of all; what they leave of the prefix is taken from the others
    allowed = F.expr(f"n - ceil(n * {SIMILAR} / 100) + 1 - (n - size(shared))").cast("int")
    prefix = sets.select("id", "n").join(ranked, "id").withColumn("take", allowed).where("take > 0")
    firsts = checkpoint(prefix.select("id", F.explode(F.expr("slice(shared, 1, take).shingle")).alias("shingle")))
    hubs = firsts.groupBy("shingle").agg(F.min("id").alias("hub"))
    links = firsts.join(hubs, "shingle").select("id", "hub").distinct()
    return components(links, "id", "hub").select("id", F.col("root").alias("family"))


class Tree:
    """Sets under nodes of OR-ed bitmaps and size ranges, in the order of their smallest shingles."""

    def __init__(self, sets: list[np.ndarray], members: list[int], bits: int):
        self.sets = sets
        members = sorted(members, key=lambda i: (int(sets[i][0]), i))
        self.levels = [[self._leaf(i, bits) for i in members]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([self._join(range(k, min(k + LEAF, len(below))), below) for k in range(0, len(below), LEAF)])

    def _leaf(self, i: int, bits: int) -> tuple:
        on = np.zeros(bits, np.uint8)
        on[self.sets[i] & _U(bits - 1)] = 1
        bitmap = int.from_bytes(np.packbits(on).tobytes(), "big")
        n = len(self.sets[i])
        return bitmap, n, n, n - bitmap.bit_count(), [i]

    @staticmethod
    def _join(parts: range, below: list[tuple]) -> tuple:
        bitmap = 0
        for k in parts:
            bitmap |= below[k][0]
        own = [below[k] for k in parts]
        return bitmap, min(x[1] for x in own), max(x[2] for x in own), max(x[3] for x in own), [i for x in own for i in x[4]]

    @property
    def root(self) -> tuple[int, int]:
        return len(self.levels) - 1, 0

    def below(self, node: tuple[int, int]) -> list[tuple[int, int]]:
        level, k = node
        return [(level - 1, j) for j in range(k * LEAF, min((k + 1) * LEAF, len(self.levels[level - 1])))]


def hopeless(a: tuple, b: tuple) -> bool:
    """Whether no set of one node can link with one of the other.

    A common shingle sets a bit in both, and as many more common shingles as a set has collisions can
    share those bits. An overlap o of sizes m and n links if 100 o >= 75 (m + n - o).
    """
    if 100 * a[2] < SIMILAR * b[1] or 100 * b[2] < SIMILAR * a[1]:
        return True
    most = min((a[0] & b[0]).bit_count() + min(a[3], b[3]), a[2], b[2])
    return (100 + SIMILAR) * most < SIMILAR * (a[1] + b[1])


def links(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= SIMILAR * (len(x) + len(y) - common)


def tree_join(sets: list[np.ndarray], sides: list[int], within: bool) -> list[int]:
    """For each set the smallest number of the sets it is connected with.

    Joins the sets of side 0 with those of side 1, and those of a side with each other if within.
    """
    up = list(range(len(sets)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    bits = 1 << max(8, min(16, 3 + max(map(len, sets)).bit_length()))
    trees = [Tree(sets, m, bits) for s in (0, 1) if (m := [i for i, x in enumerate(sides) if x == s])]
    todo = [(a, a.root, b, b.root) for k, a in enumerate(trees) for b in trees[k:] if within or a is not b]
    while todo:
        a, p, b, q = todo.pop()
        x, y = a.levels[p[0]][p[1]], b.levels[q[0]][q[1]]
        same = a is b and p == q
        if same and not p[0] or not same and hopeless(x, y):
            continue
        if len({top(i) for i in x[4]} | {top(i) for i in y[4]}) == 1:
            continue
        if not p[0] and not q[0]:
            i, j = top(x[4][0]), top(y[4][0])
            if links(sets[x[4][0]], sets[y[4][0]]):
                up[max(i, j)] = min(i, j)
        elif same:
            parts = a.below(p)
            # the last is done first: parts by themselves before parts with others
            todo += [(a, u, a, v) for k, u in enumerate(parts) for v in parts[k + 1 :]] + [(a, u, a, u) for u in parts]
        elif p[0] >= q[0]:
            todo += [(a, u, b, q) for u in a.below(p)]
        else:
            todo += [(a, p, b, v) for v in b.below(q)]
    return [top(i) for i in range(len(sets))]


def _join_units(units: DataFrame, within: bool) -> DataFrame:
    """units: (family, first, second, side, id, shingles), a pair of blocks each; gives (a, b) that connect what links."""

    def unit(found: pa.Table) -> pa.Table:
        ids = found.column("id").to_numpy()
        order = np.argsort(ids)
        shingles, sides = found.column("shingles").combine_chunks(), found.column("side").to_pylist()
        sets = [np.sort(shingles[int(i)].values.to_numpy(zero_copy_only=False).view(np.uint64)) for i in order]
        roots = tree_join(sets, [sides[i] for i in order], within)
        pairs = [(ids[order[i]], ids[order[r]]) for i, r in enumerate(roots) if i != r]
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return units.groupBy("family", "first", "second").applyInArrow(unit, "a long, b long")


def _link_families(members: DataFrame) -> DataFrame:
    """members: (id, family, shingles, n). Edges (a, b) with the same components as all links."""
    size = members.groupBy("family").agg(F.sum("n").alias("held"), F.count("*").alias("sets")).where("sets > 1")
    blocks = F.ceil(F.col("held") / FAMILY_SHINGLES)
    placed = checkpoint(members.join(size, "family").withColumn("blocks", blocks).withColumn("block", F.pmod(bucket("id"), "blocks")).drop("held", "sets"))
    unit = ("family", "first", "second", "side", "id", "shingles")
    own = placed.select("family", F.col("block").alias("first"), F.col("block").alias("second"), F.lit(0).alias("side"), "id", "shingles")
    edges = _join_units(own, within=True)
    large = placed.where("blocks > 1")
    if large.isEmpty():
        return edges
    pivot = large.where("block = 0").withColumn("second", F.explode(F.expr("sequence(1L, blocks - 1)")))
    pivot = pivot.withColumn("first", F.lit(0).cast("long")).withColumn("side", F.lit(0))
    others = large.where("block > 0").withColumn("second", F.col("block")).withColumn("first", F.lit(0).cast("long")).withColumn("side", F.lit(1))
    edges = checkpoint(edges.unionByName(_join_units(pivot.select(*unit).unionByName(others.select(*unit)), within=False)))
    if large.where("blocks > 2").isEmpty():
        return edges
    roots = components(edges)
    known = large.where("block > 0").select("family", "block", "n", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    about = known.groupBy("family", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("root").alias("low"), F.max("root").alias("high"))
    other = about.select("family", *(F.col(c).alias(f"{c}_2") for c in ("block", "least", "most", "low", "high")))
    # a row for each two blocks, which hold thousands of sets each, and only where a link between them could tell something
    pairs = about.join(other, "family").where("block < block_2").where("not (low = high and low_2 = high_2 and low = low_2)")
    pairs = pairs.where(f"100 * most >= {SIMILAR} * least_2 and 100 * most_2 >= {SIMILAR} * least").select("family", F.col("block").alias("first"), F.col("block_2").alias("second"))
    sides = [large.join(pairs.withColumn("block", F.col(c)), ["family", "block"]).withColumn("side", F.lit(s)).select(*unit) for s, c in enumerate(("first", "second"))]
    return edges.unionByName(_join_units(sides[0].unionByName(sides[1]), within=False))


def jaccard(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    A text's set is its distinct 5-word shingles, A-Z lower-cased; of fewer words, the words as one
    shingle. Null and empty texts and texts without words have size 0 and link with nothing: their
    component is their own id. Equal sets always link. A row without a doc_id gets the component of
    its set's other rows, null if there are none, and links no others. Repeated rows each give a row. Other columns
    are ignored.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    shards = 1 << max(0, (text_bytes(docs) // SHARD_BYTES).bit_length())
    described = checkpoint(describe(docs))
    linked = _count_shared(_sent(docs, shards), shards)
    reps = described.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"))
    wanted = reps.join(linked, "set_key").select("id")
    texts = docs.join(wanted, docs.doc_id == wanted.id, "left_semi").dropDuplicates(["doc_id", "text"])
    sets = checkpoint(_sets(texts))
    roots = components(_link_families(sets.join(_families(sets), "id")))
    grouped = reps.join(roots.select(F.col("id").alias("set_key"), "root"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    least = grouped.groupBy("root").agg(F.min("id").alias("component_id"))
    best = grouped.join(least, "root").select("set_key", "component_id")
    return described.join(best, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
