"""Periodic runs of words: every lag of every document, compared with numpy over many documents at once.

At a lag q the words of all documents that are long enough are compared with the words q places on. A run of
period q is a stretch of at least LEAST and TIMES * q words, so at least ``need - q`` places in a row agree.
Looking at every fourth part of that many places finds each such stretch (four looks in a row agree), and only
there the stretch is measured to its ends. A stretch whose words have a smaller period is that period's run, known already.

Texts of more than a range of lags are dealt out by text and range, so that one long document keeps no task alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import ship
from .words import buffers

#: A run has LEAST words or more and TIMES periods or more.
LEAST, TIMES = 24, 3
#: Lags of a document that one task takes at once.
LAGS = 4096
#: Bytes of texts that are compared together.
CHUNK = 1 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


def _stretch(ids: np.ndarray, i: int, q: int, end: int) -> tuple[int, int]:
    """The largest range of places around i at which ids agree with those q on."""
    a = b = i
    size = 64
    while b < end - q:
        same = ids[b : min(b + size, end - q)] == ids[b + q : min(b + size + q, end)]
        if not same.all():
            b += int(same.argmin())
            break
        b, size = b + len(same), size * 2
    size = 64
    while a > 0:
        low = max(0, a - size)
        same = ids[low:a] == ids[low + q : a + q]
        if not same.all():
            a -= int(same[::-1].argmin())
            break
        a, size = low, size * 2
    return a, b


def _smallest(ids: np.ndarray, a: int, b: int, q: int) -> int:
    """The smallest period of ids[a:b], which has period q and at least 3 q places, so that it divides q."""
    rest, f = q, 2
    while rest > 1:
        f = f if f * f <= rest else rest
        while rest % f == 0:
            rest //= f
            if (ids[a : b - q // f] == ids[a + q // f : b]).all():
                q //= f
        f += 1
    return q


def runs(ids: np.ndarray, bounds: np.ndarray, low: int = 0, high: int | None = None) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs with low < period <= high.

    bounds: where each document begins in ids, longest first, and the end; no two documents have an id in common.
    """
    sizes = np.diff(bounds)
    most = int(sizes[0]) // TIMES if len(sizes) else 0
    lags = np.arange(low + 1, min(most, high or most) + 1)
    need = np.maximum(LEAST, TIMES * lags)
    ends = bounds[np.searchsorted(-sizes, -need, "right")]
    found: list[tuple[int, int, int]] = []
    known: list[tuple[int, int, int]] = []
    for q, least, end in zip(lags.tolist(), (need - lags).tolist(), ends.tolist(), strict=True):
        if not end:
            break
        step = least // 4
        same = ids[: end - q : step] == ids[q:end:step]
        at = np.flatnonzero(same[:-3] & same[1:-2] & same[2:-1] & same[3:]) * step
        if not len(at):
            continue
        if known:
            start, stop, period = np.array(sorted(known)).T
            mine = (q % period == 0) & (stop - start > q)
            if mine.any():
                start, stop = start[mine], stop[mine] - q
                which = np.searchsorted(start, at, "right") - 1
                at = at[(which < 0) | (at >= stop[which])]
        i = 0
        while i < len(at):
            a, b = _stretch(ids, int(at[i]), q, end)
            if b - a >= least:
                period = _smallest(ids, a, b + q, q)
                known.append((a, b + q, period))
                if period > low:
                    found.append((a, b + q, period))
            i = int(np.searchsorted(at, max(b, int(at[i]) + 1)))
    return found


def _found(texts: list[list[bytes]], low: int = 0, high: int | None = None) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text's words, by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    bounds = np.cumsum([0, *(len(texts[i]) for i in order)])
    ids = np.zeros(bounds[-1], np.int64)
    for k, i in enumerate(order):
        known = defaultdict(count(int(bounds[k])).__next__)
        ids[bounds[k] : bounds[k + 1]] = np.fromiter(map(known.__getitem__, texts[i]), np.int64, len(texts[i]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b, q in runs(ids, bounds, low, high):
        k = int(np.searchsorted(bounds, a, "right")) - 1
        while len(texts[order[k]]) == 0:
            k -= 1
        out[order[k]].append((a - int(bounds[k]), b - a, q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of runs of texts: number of the first text, words by text."""
    data, bounds = buffers(batch.column(batch.schema.get_field_index(column)))
    raw, at = data.tobytes(), 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
        # bytes are split at exactly these six: space and \x09 to \x0D
        yield at, [raw[bounds[i] : bounds[i + 1]].split() for i in range(at, to)]
        at = to


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(same, start, length, period) of the runs in a range of lags of each text (same, range, text)."""
    for batch in batches:
        same, number = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, texts in _chunks(batch, "text"):
            rows = [(same[at + i], *r) for i, words in enumerate(texts) for r in _found([words], number[at + i] * LAGS, (number[at + i] + 1) * LAGS)[0]]
            yield pa.RecordBatch.from_pylist([dict(zip(("same", "start", "length", "period"), r, strict=True)) for r in rows], pa.schema([("same", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, runs, text) of (doc_id, text, runs); runs that are null are looked for."""
    for batch in batches:
        given = batch.column(2).to_pylist()
        for at, texts in _chunks(batch, "text"):
            todo = [i for i in range(len(texts)) if given[at + i] is None]
            found = dict(zip(todo, _found([texts[i] for i in todo]), strict=True))
            rows, kept = [], []
            for i, words in enumerate(texts):
                own = found[i] if i in found else [(r["start"], r["length"], r["period"]) for r in given[at + i]]
                if own:
                    stay = np.ones(len(words), bool)
                    for start, length, period in own:
                        stay[start + period : start + length] = False
                    words = [words[k] for k in np.flatnonzero(stay).tolist()]
                rows.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                kept.append(b" ".join(words))
            n = pa.array([len(words) for words in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), n, pa.array(rows, pa.list_(_RUN)), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "text"])


def collapse(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (start, length, period; by start, then period), and the text without repeats.

    A word is dropped if a run has it after its first period; the rest are joined by one space. Null and
    empty texts have no words and give an empty text; ids may be null or repeat, as rows are taken one
    by one; other columns are ignored. A document must fit one row, and so must its runs.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("ranges", F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / F.lit(2 * TIMES * LAGS)))
    short = rows.where("ranges <= 1").select("doc_id", "text", F.lit(None).cast(RUNS).alias("runs"))
    long = rows.where("ranges > 1").withColumn("same", F.sha2("text", 256))
    dealt = long.select("same", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ranges") - 1)).alias("range"), "text").repartition("same", "range")
    found = dealt.mapInArrow(_ranged, "same string, start long, length long, period long")
    order = F.array_sort(F.collect_set(F.struct("start", "period", "length")))
    listed = found.groupBy("same").agg(order.alias("x")).select(F.upper("same").alias("key"), F.transform("x", lambda r: F.struct(r.start.alias("start"), r["length"].alias("length"), r.period.alias("period"))).alias("found"))
    # by another form of the key than that of the aggregate, so that a text with very many copies can be split
    joined = long.withColumn("key", F.upper("same")).join(listed, "key", "left").select("doc_id", "text", F.coalesce("found", F.array().cast(RUNS)).alias("runs"))
    return short.unionByName(joined).mapInArrow(_collapsed, f"doc_id long, n_words long, runs {RUNS}, text string")


def planted(docs: DataFrame) -> DataFrame:
    """docs with a period written into a tenth of the texts, by a rule of their ids; null ids and empty texts stay as they are."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    cut = docs.withColumn("planted_words", F.when(h % 10 == 0, words)).withColumn("planted_g", F.floor(h / 10))
    w, g, n = F.col("planted_words"), F.col("planted_g"), F.size("planted_words")
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), a), again), F.lit(1), n), " ")
    return cut.withColumn("text", F.when(n > 0, text).otherwise(F.col("text"))).drop("planted_words", "planted_g")


def digests(collapsed: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and digests of the runs and of the text."""
    by_exponent = lambda x, y: F.when(x["length"] * y.period > y["length"] * x.period, -1).when(x["length"] * y.period < y["length"] * x.period, 1).otherwise(
        F.when((x.start < y.start) | ((x.start == y.start) & (x.period < y.period)), -1).otherwise(1))
    best = F.get(F.array_sort("runs", by_exponent), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r["length"], r.period), F.lit("\n")))
    told = collapsed.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"), "n_words")
    exponent = F.expr("(1000 * best.length) div best.period").alias("exponent_milli")
    return told.select("doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), exponent, "runs_sha256", "collapsed_sha256", "n_words")
