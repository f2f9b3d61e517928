"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are words and the starts of words, all of them. The examples' unit vectors stand in an inverted
index in blocks of examples; each common term has its largest weight in each block, which with the
exact sums of the others bounds every cosine in the block, and a search leaves out the blocks whose
bound cannot enter the nearest. The nearest vote, weighted by their cosine, by how far the terms in
common tell the labels apart (a G-test over the examples) and by how many labelled rows each stands for.
Each example is scored by the others too, and a logistic curve through those scores calibrates all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bucket, checkpoint, give_back, ship
from .words import chunks, mix, split

#: Most examples of each label that the index holds, margin of a telling term's G over twice the log of the
#: number of terms, how many times as frequent it must be with one label, and starts of words in bytes.
EXAMPLES, MARGIN_G, RATIO, STARTS = 1000, 2.0, 5.0, (4, 5, 6)
#: Examples in a block, voters, weight of the prior against a voter of cosine 1, and the score that predicts 1.
BLOCK, NEAREST, PRIOR, TOXIC = 64, 15, 0.3, 0.7
#: Texts searched at a time, and the share of the examples from which a term is a common one.
TEXTS, COMMON = 64, 1 / 16
#: Smallest hashes of terms that examples have in common which together count as one in the G-test.
SKETCH = 8
#: How much the calibrating curve is held to the scores themselves, in labelled rows.
HELD = 1.0
_U = np.uint64


def _terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of every occurrence."""
    words = split(data, bounds, lower=True)
    texts, terms = [words.text], [words.hash]
    for length in STARTS:
        hashes, which = words.prefix(length)
        texts.append(words.text[which])
        terms.append(hashes ^ _U(0x5851F42D4C957F2D))
    return np.concatenate(texts), np.concatenate(terms).view(np.int64)


class Postings(NamedTuple):
    """Where each term's entries start, and of each entry the example and the weight."""

    start: np.ndarray
    who: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(dense: np.ndarray) -> Postings:
        at, who = np.nonzero(dense)
        return Postings(np.searchsorted(at, np.arange(len(dense) + 1)), who, dense[at, who])


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after another, and how many each has."""
    size = end - start
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size), size


@dataclass
class Index:
    """Examples as unit vectors, by term and block of examples. Signs are the G of the terms that tell the labels apart, else 0."""

    terms: np.ndarray
    idf: np.ndarray
    weights: Postings | np.ndarray
    toxic: np.ndarray
    stands: np.ndarray
    ids: list[int]
    prior: float
    without: float
    signs: np.ndarray | None = None
    unseen: float = 0.0
    curve: tuple[float, float] = (0.0, 1.0)

    def __post_init__(self):
        if not isinstance(self.weights, Postings):
            self.weights = Postings.of(self.weights)

    @cached_property
    def blocks(self) -> int:
        return -(-max(1, len(self.ids)) // BLOCK)

    @cached_property
    def common(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each term its row or -1, the common terms' weights by example and their largest by block."""
        start, who, weight = self.weights
        size = np.diff(start)
        row = np.where(size > COMMON * len(self.ids), 0, -1)
        which = np.flatnonzero(row == 0)
        row[which] = np.arange(len(which))
        dense = np.zeros((len(which), self.blocks * BLOCK))
        at, times = _ranges(start[which], start[which + 1])
        dense[np.repeat(np.arange(len(which)), times), who[at]] = weight[at]
        return row, dense, dense.reshape(len(which), self.blocks, BLOCK).max(2)

    @cached_property
    def telling(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each term its number among the telling or -1, where each example's telling terms start, those, and weight times G."""
        number = np.full(len(self.terms), -1)
        if self.signs is not None:
            number[self.signs > 0] = np.arange(np.count_nonzero(self.signs > 0))
        which = np.flatnonzero(number >= 0)
        at, times = _ranges(self.weights.start[which], self.weights.start[which + 1])
        term = np.repeat(which, times)
        order = np.argsort(self.weights.who[at], kind="stable")
        at, term = at[order], term[order]
        signs = self.signs[term] if len(term) else np.zeros(0)
        return number, np.searchsorted(self.weights.who[at], np.arange(len(self.ids) + 1)), number[term], self.weights.weight[at] * signs

    @cached_property
    def places(self) -> tuple[np.ndarray, np.uint64, int]:
        """Where the terms of each leading bits start, how far those are shifted, and the most terms of one."""
        shift = _U(63 - max(1, len(self.terms)).bit_length())
        start = np.searchsorted(self._lead(self.terms, shift), np.arange((1 << (64 - int(shift))) + 1, dtype=np.uint64))
        return start, shift, int(np.diff(start).max())

    @staticmethod
    def _lead(terms: np.ndarray, shift: np.uint64) -> np.ndarray:
        return (terms.view(np.uint64) ^ _U(1 << 63)) >> shift

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The number of each term, or -1."""
        start, shift, most = self.places
        found, first = np.full(len(terms), -1), start[self._lead(terms, shift)]
        for k in range(most):
            at = np.minimum(first + k, len(self.terms) - 1)
            found = np.where(self.terms[at] == terms, at, found)
        return found

    def vectors(self, text: np.ndarray, at: np.ndarray, tf: np.ndarray, others: np.ndarray) -> np.ndarray:
        """TF-IDF of each term over the norm of its whole text, of which others are the squares of the terms in no example."""
        w = (1 + np.log(tf)) * self.idf[at]
        return w / np.sqrt(np.bincount(text, w * w, len(others)) + others)[text]

    def vector(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return self.vectors(np.zeros(len(at), int), at, tf, np.zeros(1))

    def search(self, text: np.ndarray, at: np.ndarray, vector: np.ndarray, n: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, example, cosine) of the highest cosines above 0 of each text, from the highest; of equal ones the earlier example.

        Each text leaves out its example of skip, if that is given.
        """
        row, dense, highest = self.common
        width, many = self.blocks * BLOCK, row[at] >= 0
        q = np.zeros((n, len(dense)))
        q[text[many], row[at[many]]] = vector[many]
        entry, times = _ranges(self.weights.start[at[~many]], self.weights.start[at[~many] + 1])
        rest = np.bincount(np.repeat(text[~many] * width, times) + self.weights.who[entry], np.repeat(vector[~many], times) * self.weights.weight[entry], n * width).reshape(n, width)
        bounds = q @ highest + rest.reshape(n, self.blocks, BLOCK).max(2)
        cosine = np.zeros((n, width))

        def visit(wanted: np.ndarray) -> np.ndarray:
            for b in np.flatnonzero(wanted.any(0)):
                texts, own = np.flatnonzero(wanted[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                cosine[texts, own] = q[texts] @ dense[:, own] + rest[texts, own]
            if skip is not None:
                cosine[np.arange(n), skip] = 0
            return np.partition(cosine, width - NEAREST, axis=1)[:, width - NEAREST]

        first = np.arange(self.blocks) == bounds.argmax(1)[:, None]
        least = visit(first)
        least = visit(~first & (bounds > 0) & (bounds >= least[:, None] - 1e-11))
        # rounded, lest the order of equal ones hang on what else is searched
        which, example = np.nonzero((cosine >= least[:, None] - 1e-11) & (cosine > 0))
        found = np.round(cosine[which, example], 12)
        order = np.lexsort((example, -found, which))
        which, example, found = which[order], example[order], found[order]
        kept = np.arange(len(which)) - np.searchsorted(which, which) < NEAREST
        return which[kept], example[kept], found[kept]

    def nearest(self, at: np.ndarray, vector: np.ndarray) -> list[tuple[float, int]]:
        """The nearest of one text."""
        _, example, cosine = self.search(np.zeros(len(at), int), at, vector, 1)
        return list(zip(cosine.tolist(), example.tolist(), strict=True))

    def score(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Score and the nearest examples' ids of each text."""
        n = len(bounds) - 1
        text, term = _terms(data, bounds)
        at = self.find(term) if len(self.terms) else np.full(len(term), -1)
        hit, every = at >= 0, max(1, len(self.terms))
        pairs, tf = np.unique(text[hit] * every + at[hit], return_counts=True)
        alone, times = np.unique((text[~hit].astype(np.uint64) << _U(48)) | (term[~hit].view(np.uint64) >> _U(16)), return_counts=True)
        others = np.bincount((alone >> _U(48)).astype(int), ((1 + np.log(times)) * self.unseen) ** 2, n)
        scores, near, example = self.voted(pairs // every, pairs % every, tf, others)
        scores = self.calibrated(scores)
        scores[np.bincount(text, minlength=n) == 0] = self.without
        cut = np.searchsorted(near, np.arange(n + 1))
        return scores, [[self.ids[i] for i in example[a : min(b, a + 3)]] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def voted(self, which: np.ndarray, at: np.ndarray, tf: np.ndarray, others: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Share of the votes for label 1 of each text, and (text, example) of the nearest."""
        n, vector = len(others), self.vectors(which, at, tf, others)
        near, example, cosine = self.search(which, at, vector, n, skip)
        number, start, told, weight = self.telling
        own = number[at] >= 0
        signed = np.zeros((n, max(1, number.max(initial=-1) + 1)))
        signed[which[own], number[at[own]]] = vector[own]
        entry, times = _ranges(start[example], start[example + 1])
        telling = np.bincount(np.repeat(np.arange(len(near)), times), signed[np.repeat(near, times), told[entry]] * weight[entry], len(near))
        votes = cosine * (1 + telling / cosine) ** 2 * self.stands[example] / (self.stands.mean() if len(self.stands) else 1)
        return (np.bincount(near, votes * self.toxic[example], n) + PRIOR * self.prior) / (np.bincount(near, votes, n) + PRIOR), near, example

    def calibrated(self, scores: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-a - b * _logit(scores)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def curve(scores: np.ndarray, toxic: np.ndarray, stands: np.ndarray) -> tuple[float, float]:
    """a and b of the logistic curve a + b logit(score), by Newton's iterations; few rows leave the scores as they are."""
    x, at = np.stack([np.ones(len(scores)), _logit(scores)]), np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-at @ x))
        slope = x @ (stands * (p - toxic)) + HELD * (at - [0, 1])
        step = np.linalg.solve((x * (stands * p * (1 - p))) @ x.T + HELD * np.eye(2), slope)
        at = at - step / max(1, np.abs(step).max())
        at[1] = max(at[1], 0.1)
    return float(at[0]), float(at[1])


def training(ids) -> F.Column:
    """Rows that labels may be learnt from; not those held out, where the remainder is 1."""
    return F.crc32(ids.cast("string")) % 3 != 1


def _by_text(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of the distinct terms of each text."""
    text, term = _terms(data, bounds)
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    start = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (np.diff(term) != 0))) if len(term) else np.zeros(0, int)
    return text[start], term[start], np.diff(np.append(start, len(term)))


def examples(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, terms, tf) of at most EXAMPLES training rows of each label, and how many rows each label has.

    They are those of the smallest hash of doc_id, so any run takes the same. Rows with a null id or
    label are left out; of several texts of one id the least by its terms is taken.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    usable = usable.where(training(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [usable.where(F.col("toxic") == y).orderBy(bucket("doc_id"), "doc_id").limit(EXAMPLES) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in chunks(batch.column(2)):
                text, term, size = _by_text(data, bounds)
                cut = np.searchsorted(text, np.arange(to - at + 1))
                rows = [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                ids, toxic = (batch.column(i).slice(at, to - at) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, toxic, pa.array([term[r] for r in rows], pa.list_(pa.int64())), pa.array([size[r].astype(np.int32) for r in rows], pa.list_(pa.int32()))], ["doc_id", "toxic", "terms", "tf"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text")
    found = found.mapInArrow(run, "doc_id long, toxic int, terms array<long>, tf array<int>")
    return checkpoint(found.groupBy("doc_id").agg(F.min(F.struct("terms", "tf", "toxic")).alias("x")).select("doc_id", "x.toxic", "x.terms", "x.tf")), counts


def frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each of the sorted terms occurs, and the number of documents; all rows of docs count."""
    wanted = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Index(wanted.value, terms[:0], Postings(np.zeros(len(wanted.value) + 1, int), np.zeros(0, int), np.zeros(0)), terms[:0], terms[:0], [], 0.0, 0.0)
        seen, n = np.zeros(len(known.terms), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, data, bounds in chunks(batch.column(0)):
                at = known.find(_by_text(data, bounds)[1]) if len(known.terms) else np.zeros(0, int)
                seen += np.bincount(at[at >= 0], minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], ["term", "n"])

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    wanted.destroy()
    at, n = got["term"].to_numpy(), got["n"].to_numpy()
    found = np.zeros(len(terms), np.int64)
    found[at[at >= 0]] = n[at >= 0]
    return found, int(n[at < 0].sum())


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    """Build the index from the examples, weigh their terms by all documents, find the terms that tell the labels apart, and calibrate.

    What reaches the driver is bounded by EXAMPLES and the lengths of those texts. A term in no example
    counts as what the terms of a single example weigh on average.
    """
    spark = docs.sparkSession
    ship(spark)
    found, counts = examples(docs, labels)
    rows = found.toArrow()
    toxic, ids = rows["toxic"].to_numpy().astype(float), rows["doc_id"].to_numpy()
    each, term, tf = (pc.list_value_length(rows["terms"]).to_numpy().astype(int), *(pc.list_flatten(rows[c]).to_numpy() for c in ("terms", "tf")))
    terms, at = np.unique(term, return_inverse=True)
    at, who, tf = at.astype(np.int32), np.repeat(np.arange(len(ids), dtype=np.int32), each), tf.copy()
    del rows, term
    told = _telling(toxic, at, who, terms)
    n = {y: max(1, int((toxic == y).sum())) for y in (0, 1)}
    stands = np.array([counts[int(y)] / n[int(y)] for y in toxic])
    seen = np.bincount(at, minlength=len(terms))
    df, total = frequencies(docs, terms)
    idf = np.log(1 + total / np.maximum(1, df))
    unseen = float(idf[seen == 1].mean()) if (seen == 1).any() else 1.0
    # examples that begin alike in their common terms stand in one block, which makes its bounds tight
    common = seen[at] > COMMON * len(ids)
    cut = np.searchsorted(who[common], np.arange(len(ids) + 1))
    own = at[common]
    order = sorted(range(len(ids)), key=lambda i: (np.sort(own[cut[i] : cut[i + 1]]).astype(">i4").tobytes(), ids[i]))
    del common, own
    place = np.empty(len(ids), np.int32)
    place[order] = np.arange(len(ids))
    toxic, stands, ids, who = toxic[order], stands[order], ids[order], place[who]
    index = Index(terms, idf, Postings(np.zeros(len(terms) + 1, int), np.zeros(0, int), np.zeros(0)), toxic, stands, ids.tolist(), 0.0, 0.0, told, unseen)
    weight = index.vectors(who, at, tf, np.zeros(len(ids)))
    by = np.lexsort((who, at))
    index.weights = Postings(np.append(0, np.cumsum(seen)), who[by], weight[by])
    del at, tf, weight, by  # the driver holds little besides the index
    index.prior = float(stands @ toxic / stands.sum()) if len(ids) else 0.5
    bare = np.bincount(who, minlength=len(ids)) == 0
    del who
    index.without = float((stands[bare] @ toxic[bare] + index.prior) / (stands[bare].sum() + 1))
    if len(ids):
        by_others = _left_out(found, index)
        index.curve = curve(np.array([by_others[i] for i in index.ids]), toxic, stands)
    return index


def _telling(toxic: np.ndarray, at: np.ndarray, who: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """G of each term that tells the labels apart, 0 of the others. Copies count as one, lest their chance words tell."""
    sketches = {}
    for i, own in enumerate(np.split(terms[at], np.searchsorted(who, np.arange(1, len(toxic))))) if len(toxic) else ():
        sketches.setdefault(np.sort(mix(own.view(np.uint64)))[:SKETCH].tobytes(), []).append(i)
    part = np.zeros(len(toxic))
    for same in sketches.values():
        part[same] = 1 / len(same)
    n1 = float(part @ toxic)
    n0 = float(part.sum()) - n1
    a, seen = np.bincount(at, (part * toxic)[who], len(terms)), np.bincount(at, part[who], len(terms))
    g, total = np.zeros(len(terms)), max(1.0, n0 + n1)
    for c, of in ((a, n1), (seen - a, n0)):
        for had, expected in ((c, seen * of / total), (of - c, (total - seen) * of / total)):
            some = (had > 1e-9) & (expected > 1e-9)
            g += np.where(some, 2 * had * np.log(np.where(some, had, 1) / np.where(some, expected, 1)), 0.0)
    # far enough out that of so many terms none is expected to get there by chance
    least = 2 * math.log(1 + len(terms)) + MARGIN_G
    # and a common trait of, say, one language is no sign: a term must be several times as frequent with one label
    one, other = (a + 0.5) * max(1.0, n0), (seen - a + 0.5) * max(1.0, n1)
    told = ((one >= RATIO * other) | (other >= RATIO * one)) & (seen >= 3) & (g >= least)
    return np.where(told, g, 0.0)


def _left_out(found: DataFrame, index: Index) -> dict[int, float]:
    """The votes of the other examples on each example."""
    shared = found.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        number = {i: k for k, i in enumerate(own.ids)}
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                each, term, tf = (pc.list_value_length(part["terms"]).to_numpy().astype(int), *(pc.list_flatten(part[c]).to_numpy() for c in ("terms", "tf")))
                which = np.repeat(np.arange(part.num_rows), each)
                skip = np.array([number[i] for i in part["doc_id"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(own.voted(which, own.find(term), tf, np.zeros(part.num_rows), skip)[0])], ["doc_id", "score"])

    scores = {r.doc_id: r.score for r in found.select("doc_id", "terms", "tf").mapInArrow(run, "doc_id long, score double").collect()}
    shared.destroy()
    return scores


def toxicity(docs: DataFrame, labels: DataFrame, carry: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, and the ids of the nearest examples.

    Scores depend on the text alone. Null and empty texts, like all texts without a term, get
    the rate of label 1 among the examples without one; without labels every score is 0.5. A null
    doc_id stays null and is not held out. Repeated rows each give a row; other columns are ignored,
    but for a column of longs to carry along, if one is named.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    give_back()  # the driver needs neither the index nor what it was made of any more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for at, to, data, bounds in chunks(batch.column(1)):
                for a in range(0, to - at, TEXTS):
                    own = bounds[a : a + TEXTS + 1]
                    scores, near = index.score(data[own[0] : own[-1]], own - own[0])
                    ids, carried = (batch.column(i).slice(at + a, len(own) - 1) for i in (0, 2))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64())), carried], ["doc_id", "score", "evidence", "carried"])

    kept = F.col(carry) if carry else F.lit(None)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", kept.cast("long").alias("carried")).mapInArrow(run, "doc_id long, score double, evidence array<long>, carried long")
    held = F.coalesce(~training(F.col("doc_id")), F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence", *([F.col("carried").alias(carry)] if carry else []))
