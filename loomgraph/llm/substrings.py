"""Removal of passages that stand earlier in the corpus, by suffix automata of reference shards.

A window of WINDOW words goes to its minimizer, the least hash of GRAM words in it, so equal windows go to equal
minimizers at equal places. The windows of one minimizer's place are a stretch. What happens:

1. Minimizers are counted over all documents. Windows of one that occurs once stand nowhere else, and are left out.
2. Equal stretches are taken together, with the first of them; of the others every window stands earlier.
3. The first stretches of minimizers that have several stretches are the reference, dealt into shards by minimizer.
   A suffix automaton of each shard's stretches, in document order, knows where each run of words first ended; the
   stretches are streamed through it, and a window whose matching run first ended before it stands earlier.
4. A minimizer of more than HOT stretches is dealt over all shards by stretch. There the automata say what is
   first in a shard, and the first of each window over all shards is taken in one more round.

Broadcasting every automaton to every document, as the plain form of the method has it, would grow with the square of
the corpus; so what can match meets in a shard instead, whose automaton is bounded by SHARD stretches or so.
Words are told apart by the 64-bit hashes of words.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpoint, ship
from .words import Words, chunks, mix, split

WINDOW, GRAM = 20, 8
#: Windows that can share a minimizer's place.
SHARED = WINDOW - GRAM + 1
#: Repeated stretches to a shard, and stretches of a minimizer beyond which it is dealt over all shards.
SHARD, HOT = 4000, 500
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """A suffix automaton of several sequences: every run of their symbols is a path, and each state knows where its runs first ended."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first, self.places = [-1], [0], [-1], 0

    def _state(self, follow: dict[int, int], link: int, length: int, first: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _target(self, state: int, symbol: int) -> int:
        """The state of exactly one symbol more than state, split off if it is held together with longer runs."""
        there = self.next[state][symbol]
        if self.length[there] == self.length[state] + 1:
            return there
        own = self._state(dict(self.next[there]), self.link[there], self.length[state] + 1, self.first[there])
        self.link[there] = own
        while state >= 0 and self.next[state].get(symbol) == there:
            self.next[state][symbol] = own
            state = self.link[state]
        return own

    def add(self, symbols: list[int]) -> int:
        """Take in one more sequence; gives the place of its first symbol."""
        began, last = self.places, 0
        for symbol in symbols:
            if symbol in self.next[last]:
                last = self._target(last, symbol)
            else:
                new = self._state({}, 0, self.length[last] + 1, self.places)
                at = last
                while at >= 0 and symbol not in self.next[at]:
                    self.next[at][symbol] = new
                    at = self.link[at]
                if at >= 0:
                    self.link[new] = self._target(at, symbol)
                last = new
            self.places += 1
        return began

    def match(self, symbols: list[int], most: int) -> Iterator[tuple[int, int]]:
        """For each place the length, up to ``most``, of the longest run that ends there and is in the automaton, and where that run first ended."""
        state = length = 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            while length >= most and self.length[self.link[state]] >= most:
                state = self.link[state]
            length = min(length, most)
            yield length, self.first[state]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _ODD + b)


class Stretches:
    """The stretches of some texts: minimizer, hash of all words, place of the first window in its text and among all words, number of windows, and text."""

    def __init__(self, words: Words):
        h, text = words.hash, words.text
        count = max(0, len(h) - WINDOW + 1)
        two = _pairs(h[:-1], h[1:])
        four = _pairs(two[:-2], two[2:])
        eight = _pairs(four[:-4], four[4:])
        self.window = _pairs(_pairs(eight[:-8], eight[8:])[:count], four[16:]) if count else np.zeros(0, np.uint64)
        least = np.arange(len(eight))
        for step in (1, 2, 4, SHARED - 8):  # of 2, 4, 8 and all of a window's grams the least, the first of equal ones
            a, b = least[:-step], least[step:]
            least = np.where(eight[b] < eight[a], b, a)
        valid = text[:count] == text[WINDOW - 1 :] if count else np.zeros(0, bool)
        least = least[:count]
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        self.at = np.flatnonzero(begins)
        self.count = np.bincount(np.cumsum(begins)[valid] - 1, minlength=len(self.at)).astype(np.int64) if len(self.at) else np.zeros(0, np.int64)
        self.text = text[self.at]
        self.start = self.at - words.first[self.text]
        self.minimizer = eight[least[self.at]].view(np.int64)
        self.content = _pairs(self.window[self.at], self.window[self.at + self.count - 1]).view(np.int64)


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, Words, Stretches]]:
    for at, _, data, bounds in chunks(batch.column(batch.schema.get_field_index(column))):
        words = split(data, bounds, False)
        yield at, data, bounds, words, Stretches(words)


def _batch(schema: str, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema.split())


def _minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, _, _, s in _texts(batch, "text"):
            found, n = np.unique(s.minimizer, return_counts=True)
            yield _batch("minimizer n", found, n.astype(np.int64))


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, minimizer) of every text, each pair once."""
    for batch in batches:
        key = batch.column(0).to_numpy()
        for at, _, _, _, s in _texts(batch, "text"):
            order = np.lexsort((s.minimizer, s.text))
            m, t = s.minimizer[order], s.text[order]
            once = np.ones(len(m), bool)
            once[1:] = (m[1:] != m[:-1]) | (t[1:] != t[:-1])
            yield _batch("key minimizer", key[at + t[once]], m[once])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists and the rows that they are of; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(minimizer, content, doc_id, key, start, count) of the stretches that have a wanted minimizer."""
    for batch in batches:
        key, ids, wanted = batch.column(0).to_numpy(), batch.column(1), batch.column(3)
        for at, _, bounds, _, s in _texts(batch, "text"):
            # whether a minimizer is repeated does not depend on the text
            own = np.flatnonzero(np.isin(s.minimizer, _flat(wanted.slice(at, len(bounds) - 1))[1].to_numpy()))
            rows = at + s.text[own]
            yield _batch("minimizer content doc_id key start count", s.minimizer[own], s.content[own], ids.take(pa.array(rows)), key[rows], s.start[own], s.count[own])


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked stretches (start, shard, hot) of each text with their words and windows."""
    for batch in batches:
        key, ids, asked = batch.column(0).to_numpy(), batch.column(1), batch.column(3)
        for at, _, bounds, words, s in _texts(batch, "text"):
            text, what = _flat(asked.slice(at, len(bounds) - 1))
            place = (text << 40) | what.field("start").to_numpy()
            which = np.searchsorted((s.text << 40) | s.start, place)
            rows = at + text
            n = s.count[which]
            raw = pa.array([words.hash[a : a + k + WINDOW - 1].tobytes() for a, k in zip(s.at[which], n, strict=True)], pa.binary())
            windows = pa.array([s.window[a : a + k].tobytes() for a, k in zip(s.at[which], n, strict=True)], pa.binary())
            yield _batch("shard hot minimizer doc_id key start words windows", what.field("shard"), what.field("hot"), s.minimizer[which], ids.take(pa.array(rows)), key[rows], s.start[which], raw, windows)


_FIRST = "hot boolean, one long, two long, none boolean, doc_id long, key long, start long, mask long"


def _streamed(shard: pa.Table) -> pa.Table:
    """What is first in a shard: a row with the mask of a stretch's first windows; of a hot minimizer's stretch one for each of them, by minimizer and window."""
    once = {(r["key"], r["start"]): r for r in shard.to_pylist()}  # equal rows of documents give equal stretches
    rows = sorted(once.values(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["key"], r["start"]))
    automaton, out = Automaton(), []
    sequences = [np.frombuffer(r["words"], np.uint64).tolist() for r in rows]
    places = [automaton.add(x) for x in sequences]
    for r, symbols, began in zip(rows, sequences, places, strict=True):
        ended = [began + k == first for k, (_, first) in enumerate(automaton.match(symbols, WINDOW))][WINDOW - 1 :]
        own = r["doc_id"] is None, r["doc_id"], r["key"], r["start"]
        if r["hot"]:
            windows = np.frombuffer(r["windows"], np.int64).tolist()
            out += [(True, r["minimizer"], w, *own, 1 << k) for k, (w, keep) in enumerate(zip(windows, ended, strict=True)) if keep]
        else:
            out.append((False, r["key"], r["start"], *own, sum(1 << k for k, keep in enumerate(ended) if keep)))
    names = [c.split()[0] for c in _FIRST.split(", ")]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]
    return pa.table({n: pa.array([r[i] for r in out], kinds[i]) for i, n in enumerate(names)})


_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, removed, text): windows of wanted minimizers go, unless a first stretch's mask has them."""
    for batch in batches:
        ids, wanted, firsts = batch.column(1), batch.column(3), batch.column(4)
        for at, data, bounds, words, s in _texts(batch, "text"):
            docs = len(bounds) - 1
            gone = np.where(np.isin(s.minimizer, _flat(wanted.slice(at, docs))[1].to_numpy()), (1 << s.count) - 1, 0)
            text, what = _flat(firsts.slice(at, docs))
            which = np.searchsorted((s.text << 40) | s.start, (text << 40) | what.field("start").to_numpy())
            masks = np.zeros(len(gone), np.int64)
            np.bitwise_or.at(masks, which, what.field("mask").to_numpy())
            gone &= ~masks
            change = np.zeros(len(words.hash) + WINDOW + 1, np.int64)
            for k in range(SHARED):
                places = s.at[(gone >> k) & 1 == 1] + k
                np.add.at(change, places, 1)
                np.add.at(change, places + WINDOW, -1)
            covered = np.cumsum(change)[: len(words.hash)] > 0
            first, raw = np.append(words.first[:docs], len(words.hash)), data.tobytes()
            spans, kept = [], []
            for i in range(docs):
                own, mine = raw[bounds[i] : bounds[i + 1]].split(), covered[first[i] : first[i + 1]]
                if mine.any():
                    edges = np.flatnonzero(np.diff(mine, prepend=False, append=False))
                    spans.append([{"start": a, "length": b - a} for a, b in edges.reshape(-1, 2).tolist()])
                    own = [own[k] for k in np.flatnonzero(~mine).tolist()]
                else:
                    spans.append([])
                kept.append(b" ".join(own))
            yield _batch("doc_id n_words removed text", ids.slice(at, docs), np.diff(first), pa.array(spans, pa.list_(_SPAN)), pa.array(kept, pa.binary()).cast(pa.string()))


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, removed (start, length; runs of words), and the text of the words that stay, joined by one space.

    A word goes if a window of WINDOW words over it stands earlier: in a document of a smaller doc_id, or before in
    the same one. Null, empty and short texts have no windows. Rows without a doc_id come last; they, and rows that
    share a doc_id but not a text, are ordered by a hash of both. Equal rows stand for one document and each get its
    result. Other columns are ignored.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = docs.select("text").mapInArrow(_minimizers, "minimizer long, n long").groupBy("minimizer").agg(F.sum("n").alias("n"))
    repeated = checkpoint(counted.where("n > 1").select("minimizer"))
    # by another form of the key than that of the aggregate, so that a very common minimizer can be split
    owned = texts.select("key", "text").mapInArrow(_owned, "key long, minimizer long").withColumn("form", F.bitwise_not("minimizer"))
    found = owned.join(repeated.select(F.bitwise_not("minimizer").alias("form")), "form").groupBy("key").agg(F.collect_set("minimizer").alias("wanted"))
    wanted = checkpoint(found)
    shards = int((wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) / SHARD) + 1

    fields = "minimizer long, content long, doc_id long, key long, start long, count long"
    stretches = texts.join(wanted, "key").select("key", "doc_id", "text", "wanted").mapInArrow(_repeated, fields)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "start", "count"))
    first = stretches.groupBy("minimizer", "content").agg(least.alias("x")).select("minimizer", "content", "x.key", "x.start", "x.count")
    number = first.groupBy("minimizer").agg(F.count("*").alias("n")).select(F.bitwise_not("minimizer").alias("form"), "n")
    told = first.withColumn("form", F.bitwise_not("minimizer")).join(number, "form")
    alone = told.where("n = 1").select("key", "start", F.expr("shiftleft(1L, cast(count as int)) - 1").alias("mask"))

    hot = F.col("n") > HOT
    shard = F.pmod(F.when(hot, F.xxhash64("minimizer", "content")).otherwise(F.xxhash64("minimizer")), F.lit(shards))
    asked = told.where("n > 1").groupBy("key").agg(F.collect_list(F.struct("start", shard.alias("shard"), hot.alias("hot"))).alias("asked"))
    reference = texts.join(asked, "key").select("key", "doc_id", "text", "asked").mapInArrow(_with_words, "shard long, hot boolean, minimizer long, doc_id long, key long, start long, words binary, windows binary")
    streamed = reference.groupBy("shard").applyInArrow(_streamed, _FIRST)
    merged = streamed.groupBy("hot", "one", "two").agg(F.min(F.struct("none", "doc_id", "key", "start", "mask")).alias("x")).select("x.key", "x.start", "x.mask")

    masks = alone.unionByName(merged).groupBy("key").agg(F.collect_list(F.struct("start", "mask")).alias("firsts"))
    joined = texts.join(wanted, "key", "left").join(masks, "key", "left").select("key", "doc_id", "text", "wanted", "firsts")
    return joined.mapInArrow(_kept, "doc_id long, n_words long, removed array<struct<start:long,length:long>>, text string")


def digests(kept: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept text."""
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["length"])
    return kept.select("doc_id", "n_words", total.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
