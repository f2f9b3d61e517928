"""Ranked lexical search, document at a time, over shards of compressed postings.

``build`` makes an index: a row for each shard of up to SHARD terms, with its documents in the order of doc_id.
A term's postings are the gaps between its documents' places and its counts there, as bytes of seven bits.
``search`` takes queries in blocks of bounded size. In a shard, the postings of a query's terms are merged by
a heap on the document, the best are kept in a heap of k keyed by score, then doc_id, and the heaps of all shards
are merged. Once the heap is full, terms that together cannot lift a document over its least score no longer
lead the merge and are only looked up; that leaves the result as it is.

Terms are the 64-bit hashes of words.py; two terms of one hash would count as one.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import checkpoint, ship
from .words import buffers, split

#: Terms of a shard, unless one document has more; characters of a block of queries, unless one has more.
SHARD, BLOCK = 1 << 20, 4 << 20
TOP = 20
#: Fixed values of the score.
SCALE, GAIN, SHARE = 1000, 12, 25
#: ASCII other than digits and letters stands between terms.
BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_INDEX = "docs long, terms long, ids binary, sizes binary, hashes binary, starts binary, counts binary, postings binary"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of 0 and more as bytes of seven bits, the lowest first, all but a value's last with the high bit; and how many bytes each has."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        which = np.flatnonzero(size > k)
        more = np.where(size[which] > k + 1, 128, 0).astype(np.uint8)
        out[at[which] + k] = ((values[which] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, size


def unpack(raw: np.ndarray) -> np.ndarray:
    """The values that pack wrote."""
    end = np.flatnonzero(raw < 128)
    if not len(end):
        return np.zeros(0, np.int64)
    start = np.concatenate(([0], end[:-1] + 1))
    place = (np.arange(len(raw)) - np.repeat(start, end - start + 1)).astype(np.uint64)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (np.uint64(7) * place), start).astype(np.int64)


def _shard(ids: list[int | None], number: np.ndarray, hashes: np.ndarray) -> dict:
    """A row of the index: number has the document in ids of each term in hashes."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    place = np.zeros(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    by = np.lexsort((place[number], hashes))
    term, doc = hashes[by], place[number][by]
    new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])))) if len(term) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate((new, [len(term)])))
    term, doc = term[new], doc[new]
    first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
    gaps = np.diff(doc, prepend=-1) - 1
    gaps[first] = doc[first]
    both = np.empty(2 * len(doc), np.int64)
    both[0::2], both[1::2] = gaps, times
    postings, size = pack(both)
    ends = np.concatenate(([0], np.cumsum(size)))
    return {
        "docs": int((np.bincount(number, minlength=len(ids)) > 0).sum()), "terms": len(hashes),
        "ids": np.array([-1 if ids[i] is None else ids[i] for i in order], np.int64).tobytes() + bytes(ids[i] is None for i in order),
        "sizes": pack(np.bincount(number, minlength=len(ids))[order])[0].tobytes(),
        "hashes": term[first].tobytes(), "starts": ends[2 * first].astype(np.int64).tobytes(), "counts": pack(np.diff(np.concatenate((first, [len(doc)]))))[0].tobytes(), "postings": postings.tobytes(),
    }


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("docs", pa.int64()), ("terms", pa.int64()), *((c, pa.binary()) for c in ("ids", "sizes", "hashes", "starts", "counts", "postings"))])
    ids: list[int | None] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def row() -> pa.RecordBatch:
        out = _shard(ids, np.concatenate([n for n, _ in held]), np.concatenate([h for _, h in held]))
        ids.clear()
        held.clear()
        return pa.RecordBatch.from_pylist([out], schema)

    for batch in batches:
        own = batch.column(0).to_pylist()
        data, bounds = buffers(batch.column(1))
        at = 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 2 * SHARD, "right")) - 1)
            words = split(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], True, BREAKS)
            if held and sum(len(h) for _, h in held) + len(words.hash) > SHARD:
                yield row()
            held.append((words.text + len(ids), words.hash))
            ids += own[at:to]
            at = to
    if held:
        yield row()


def build(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text), a row for each shard; documents without a term are in it but never found."""
    ship(docs.sparkSession)
    return checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_built, _INDEX))


def query_terms(text: str | None) -> Counter:
    """The terms of a query by hash, with how often each stands there."""
    data, bounds = buffers(pa.array([text], pa.string()))
    return Counter(split(data, bounds, True, BREAKS).hash.tolist())


def _postings(row: dict, wanted: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and counts in the shard of each wanted term that is there."""
    hashes = np.frombuffer(row["hashes"], np.uint64)
    starts = np.concatenate((np.frombuffer(row["starts"], np.int64), [len(row["postings"])]))
    raw = np.frombuffer(row["postings"], np.uint8)
    at = np.searchsorted(hashes, wanted)
    found = {}
    for k in np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == wanted) if len(hashes) else ():
        both = unpack(raw[starts[at[k]] : starts[at[k] + 1]])
        found[int(wanted[k])] = np.cumsum(both[0::2] + 1) - 1, both[1::2]
    return found


def best(lists: list[tuple[list[int], list[int], int]], top: int) -> list[tuple[int, int]]:
    """(score, place) of the ``top`` places of the highest sums above 0, equal sums by place, from lists (places ascending, what each adds, the most of that)."""
    lists = sorted((x for x in lists if x[0]), key=lambda x: x[2])
    bound = np.cumsum([most for _, _, most in lists]).tolist()  # what the lists up to each add at most
    lead, least, kept = 0, 0, []  # lists below lead do not lead; kept: (score, -place), its least first
    at = [0] * len(lists)
    merge = [(places[0], k) for k, (places, _, _) in enumerate(lists)]
    heapq.heapify(merge)
    while merge:
        place, score = merge[0][0], 0
        while merge and merge[0][0] == place:
            k = merge[0][1]
            places, adds, _ = lists[k]
            i = at[k]
            score += adds[i]
            at[k] = i = i + 1
            if i < len(places):
                heapq.heapreplace(merge, (places[i], k))
            else:
                heapq.heappop(merge)
        for k in range(lead - 1, -1, -1):
            if score + bound[k] <= least:
                break
            places, adds, _ = lists[k]
            at[k] = i = bisect_left(places, place, at[k])
            if i < len(places) and places[i] == place:
                score += adds[i]
        if score > least:
            heapq.heappush(kept, (score, -place))
            if len(kept) > top:
                heapq.heappop(kept)
            if len(kept) == top:
                least = kept[0][0]
                before = lead
                while lead < len(lists) and bound[lead] <= least:
                    lead += 1
                if lead > before:
                    merge = [x for x in merge if x[1] >= lead]
                    heapq.heapify(merge)
    return sorted(((score, -place) for score, place in kept), key=lambda x: (-x[0], x[1]))


def _searched(items: list[tuple[int, dict[int, int]]], weight: dict[int, int], docs: int, terms: int, top: int):
    """A function from rows of the index to (item, doc_id, score) of the best of each shard."""
    wanted = np.array(sorted(weight), np.uint64)
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                sizes = unpack(np.frombuffer(row["sizes"], np.uint8))
                if int(sizes.max(initial=0)) * SHARE * docs >= 1 << 63:
                    sizes = sizes.astype(object)
                m = (100 - SHARE + SHARE * sizes * docs // terms).astype(np.int64)
                lists = {}
                for term, (places, times) in _postings(row, wanted).items():
                    adds = weight[term] * (1_000_000 * SCALE * times // (SCALE * times + GAIN * m[places]))
                    lists[term] = places.tolist(), adds.tolist(), int(adds.max())
                number = np.frombuffer(row["ids"], np.int64, len(row["ids"]) // 9)
                none = row["ids"][8 * len(number) :]
                out = []
                for item, asked in items:
                    own = [(lists[t][0], [x * n for x in lists[t][1]] if n > 1 else lists[t][1], lists[t][2] * n) for t, n in asked.items() if t in lists]
                    out += [(item, None if none[p] else int(number[p]), score) for score, p in best(own, top)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], schema=schema)

    return run


def _counted(wanted: np.ndarray):
    """A function from rows of the index to (term, df) of the wanted terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                hashes = np.frombuffer(batch.column(0)[k].as_py(), np.uint64)
                df = unpack(np.frombuffer(batch.column(1)[k].as_py(), np.uint8))
                own = np.flatnonzero(np.isin(hashes, wanted))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[own].view(np.int64)), pa.array(df[own])], ["term", "df"])

    return run


def _blocks(queries: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The queries in runs of up to BLOCK characters."""
    held, size = [], 0
    for number, text in queries.toLocalIterator():
        if held and size + len(text or "") > BLOCK:
            yield held
            held, size = [], 0
        held.append((number, text))
        size += len(text or "")
    if held:
        yield held


def search(index: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of the best documents of each query (item_id, text), by score, equal ones by doc_id.

    A query without terms, or whose terms are in no document, finds nothing; so does one of a null text. Rows that repeat an
    item_id are queries of their own and get ranks of their own, which cannot be told apart. Rows that repeat a doc_id are documents of their own; those
    without one stand last among equal scores. Other columns are ignored.
    """
    spark = index.sparkSession
    ship(spark)
    total = index.agg(F.sum("docs"), F.sum("terms")).first()
    docs, terms = total[0] or 0, total[1] or 0
    numbered = checkpoint(queries.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()))
    found = spark.createDataFrame([], "item long, doc_id long, score long")
    for block in _blocks(numbered.select("item", "text")) if terms else ():
        items = [(number, dict(query_terms(text))) for number, text in block]
        wanted = np.array(sorted({t for _, asked in items for t in asked}), np.uint64)
        df = index.select("hashes", "counts").mapInArrow(_counted(wanted), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # terms of the block
        weight = {r.term % (1 << 64): math.floor(1000 * math.log((2 * docs + 2) / (2 * r.df + 1))) for r in df}
        shards = index.select("ids", "sizes", "hashes", "starts", "postings").mapInArrow(_searched(items, weight, docs, terms, top), "item long, doc_id long, score long")
        found = found.unionByName(checkpoint(shards))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= top)
    return numbered.select("item", "item_id").join(ranked, "item").select("item_id", "rank", "doc_id", "score")
