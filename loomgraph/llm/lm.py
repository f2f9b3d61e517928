"""Language-model scores: the marginal likelihood of texts over all segmentations into subwords.

A word is a lattice: its arcs are the pieces of an existing vocabulary, weighted by the vocabulary's
own scores, and a forward recursion in log space over its bytes sums all ways to cut it. A training
word also is an arc of its own, from start to end, that weighs what its count says; the vocabulary
stands in with as many tokens as there are different ones (``(c + V q) / (N + V)``), so its part grows
smaller with the corpus. A text's probability is the product over its words and its end.

Words are counted over the whole corpus. The commonest of them, ``HEAD`` at most, are sent to the
executors and scored where they stand; occurrences of all others are joined with the word table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpoint, ship
from .words import Words, chunks, split

#: Most words sent to the executors, and steps of their counts' logarithm in which those are told apart.
HEAD, STEPS = 1 << 17, 8
#: Longest word, in bytes, of the recursion over many words at once, and bytes of words in one such run.
TOGETHER, RUN = 256, 1 << 18
SMOOTH = 0.1
START = "▁".encode()


@dataclass
class Pieces:
    """Pieces of a vocabulary with natural log probabilities, and that of a text's end."""

    texts: list[bytes]
    log: np.ndarray
    end: float

    @staticmethod
    def read(path: str) -> Pieces:
        """From a sentencepiece model.

        Scores that are ranks (of merges) become probabilities by Zipf's law. Bytes that are no piece
        weigh a hundredth of the rarest one; the end, which has no score, weighs as the commonest.
        """
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        weights: dict[bytes, float] = {}
        every = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        ranks = min((model.get_score(i) for i in every), default=0) < -1000
        for i in every:
            score = model.get_score(i)
            weights[model.id_to_piece(i).encode()] = 1 / (10 - score) if ranks else float(np.exp(score))
        least, most = min(weights.values()) / 100, max(weights.values())
        for byte in range(256):
            weights.setdefault(bytes([byte]), least)
        total = sum(weights.values()) + most
        return Pieces(list(weights), np.log(np.array(list(weights.values())) / total), math.log(most / total))

    @cached_property
    def tree(self) -> tuple[np.ndarray, np.ndarray]:
        """The pieces as a tree: next node by node and byte (0: none), and each node's log probability (-inf: no piece).

        Only nodes with children have a row of their own; the others follow behind them.
        """
        children: dict[tuple[int, int], int] = {}
        scores, inner = [-math.inf], {0}
        for text, log in zip(self.texts, self.log, strict=True):
            node = 0
            for byte in text:
                if (to := children.get((node, byte))) is None:
                    to = children[node, byte] = len(scores)
                    scores.append(-math.inf)
                    inner.add(node)
                node = to
            scores[node] = log
        order = [*sorted(inner), *(i for i in range(len(scores)) if i not in inner)]
        number = np.empty(len(scores), np.int32)
        number[order] = np.arange(len(scores))
        following = np.zeros((len(inner) + 1, 256), np.int32)
        for (node, byte), to in children.items():
            following[number[node], byte] = number[to]
        return following.ravel(), np.array(scores)[order]

    def arcs(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, log probability) of every occurrence of a piece; none goes across a white space."""
        following, scores = self.tree
        rows = len(following) // 256 - 1
        at, node, length = np.flatnonzero(data != 32), np.zeros(0, np.int32), 0
        node = np.zeros(len(at), np.int32)
        starts, ends, logs = [], [], []
        padded = np.append(data, np.uint8(32))
        while len(at):
            byte = padded[at + length]
            node = following[(np.minimum(node, rows).astype(np.int64) << 8) | byte]
            go = np.flatnonzero((node > 0) & (byte != 32))
            at, node, length = at[go], node[go], length + 1
            log = scores[node]
            piece = np.flatnonzero(log > -math.inf)
            starts.append(at[piece])
            ends.append(at[piece] + length)
            logs.append(log[piece])
            more = np.flatnonzero(node < rows)
            at, node = at[more], node[more]
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(logs)

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """Natural log probability of each word over all its segmentations."""
        out = np.zeros(len(words))
        short = [i for i, w in enumerate(words) if len(w) <= TOGETHER]
        at = 0
        while at < len(short):
            to, held = at, 0
            while to < len(short) and held < RUN:
                held += len(words[short[to]]) + 1
                to += 1
            out[short[at:to]] = self._together([words[i] for i in short[at:to]])
            at = to
        for i, w in enumerate(words):
            if len(w) > TOGETHER:
                out[i] = self._alone(w)
        return out

    def _together(self, words: list[bytes]) -> np.ndarray:
        """The recursion over many words: all places that are as far from their word's start at once."""
        data = np.frombuffer(b" ".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size + 1) - size - 1
        start, end, log = self.arcs(data)
        own = np.repeat(first, size + 1)  # of every byte, and the white space behind, where its word starts
        far = end - own[start]
        order = np.lexsort((end, far))
        start, end, log, far = start[order], end[order], log[order], far[order]
        new = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
        cut = np.searchsorted(far[new], np.arange(1, size.max(initial=0) + 2))
        forward = np.zeros(len(data) + 1)
        begin = np.append(new, len(end))
        for k in range(len(cut) - 1):
            runs = begin[cut[k] : cut[k + 1] + 1]
            arcs = slice(runs[0], runs[-1])
            forward[end[runs[:-1]]] = np.logaddexp.reduceat(forward[start[arcs]] + log[arcs], runs[:-1] - runs[0])
            # a word's end is the next one's white space, so no place serves two words
        return forward[first + size]

    def _alone(self, word: bytes) -> float:
        start, end, log = self.arcs(np.frombuffer(word, np.uint8))
        order = np.argsort(end, kind="stable")
        cut = np.searchsorted(end[order], np.arange(1, len(word) + 2)).tolist()
        start, log = start[order].tolist(), log[order].tolist()
        forward = [0.0] * (len(word) + 1)
        for b in range(len(word)):
            into = [forward[start[i]] + log[i] for i in range(cut[b], cut[b + 1])]
            most = max(into)
            forward[b + 1] = most + math.log(sum(math.exp(x - most) for x in into)) if len(into) > 1 else most
        return forward[-1]


def _train(ids: F.Column) -> F.Column:
    return F.coalesce(F.crc32(ids.cast("string")) % 10 != 0, F.lit(True))


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(words.hash, return_index=True, return_inverse=True)


def word_table(docs: DataFrame) -> DataFrame:
    """(hash, word, c, seen) of every word of docs (doc_id, text, train); c counts training texts only, seen all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in chunks(batch.column(0), 2 << 20):
                train = batch.column(1).slice(at, to - at).to_numpy(zero_copy_only=False).astype(bool)
                words = split(data, bounds, lower=True)
                keys, first, which = _distinct(words)
                c = np.bincount(which, train[words.text], len(keys)).astype(np.int64)
                raw = data.tobytes().lower()
                texts = [raw[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(texts, pa.binary()), pa.array(c), pa.array(np.bincount(which, minlength=len(keys)))], ["hash", "word", "c", "seen"])

    made = docs.select("text", "train").mapInArrow(run, "hash long, word binary, c long, seen long")
    return made.groupBy("hash").agg(F.min("word").alias("word"), F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def _head(words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, c and log of the commonest words, HEAD at most: those above the least count that leaves so many.

    The driver first gets numbers of words by steps of the counts' logarithm, some hundred rows.
    """
    step = F.floor(F.log2("seen") * STEPS)
    sizes = words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    least, held = math.inf, 0
    for r in sizes:
        held += r.n
        if held > HEAD:
            break
        least = r.step
    top = words.where(step >= least).select("hash", "c", "log").toPandas().sort_values("hash") if least < math.inf else None
    return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) if top is None else tuple(top[c].to_numpy() for c in top)


def score(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10. Null and empty texts consist of their end alone. Rows of equal id and text get
    the same scores, a row each; a null doc_id stays null and counts as training. Without training
    rows every count is 0 and the lattices have the vocabulary's pieces alone. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("train", _train(F.col("doc_id")))
    spark = docs.sparkSession
    ship(spark)
    counted = checkpoint(word_table(docs))
    ends = docs.where("train").count()
    sums = counted.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = (sums.n or 0) + ends, sums.v + (ends > 0)
    pieces, stands = Pieces.read(path), max(1, v)
    shared = spark.sparkContext.broadcast(pieces)

    def weighed(c, log):
        """log10 of (c + stands q) / (n + stands), where log is q's natural logarithm."""
        with np.errstate(divide="ignore"):
            return (np.logaddexp(np.log(c), math.log(stands) + log) - math.log(n + stands)) / math.log(10)

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = shared.value.marginals([START + w for w in batch.column(1).to_pylist()])
            c = batch.column(2)
            yield pa.RecordBatch.from_arrays([batch.column(0), c, batch.column(3), pa.array(weighed(c.to_numpy().astype(float), logs))], ["hash", "c", "seen", "log"])

    words = checkpoint(counted.mapInArrow(marginal, "hash long, c long, seen long, log double"))
    head = spark.sparkContext.broadcast(_head(words))
    below = float(np.log10(n + SMOOTH * (v + 1)))
    end_base, end_log = float(np.log10(ends + SMOOTH) - below), float(weighed(np.float64(ends), pieces.end))
    fields = "doc_id long, same long, copies long, n_tokens long, n_known long, base double, log double, hash long, times long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, c, log = head.value
        for batch in batches:
            for at, to, data, bounds in chunks(batch.column(1)):
                words, m = split(data, bounds, lower=True), to - at
                own = words.hash.view(np.int64)
                where = np.minimum(np.searchsorted(hashes, own), max(0, len(hashes) - 1))
                hit = hashes[where] == own if len(hashes) else np.zeros(len(own), bool)
                text, where = words.text[hit], where[hit]
                ids, same = (batch.column(i).slice(at, m) for i in (0, 2))
                known = np.bincount(text, c[where] > 0, m).astype(np.int64) + (ends > 0)
                base = np.bincount(text, np.log10(c[where] + SMOOTH) - below, m) + end_base
                logs = np.bincount(text, log[where], m) + end_log
                # a text's own row has no times; its key, the text's, only spreads such rows over the join
                yield pa.RecordBatch.from_arrays([ids, same, pa.array(np.ones(m, np.int64)), pa.array(np.diff(words.first) + 1), pa.array(known), pa.array(base), pa.array(logs), same, pa.nulls(m, pa.int64())], names)
                rest = np.flatnonzero(~hit)
                order = rest[np.lexsort((own[rest], words.text[rest]))]
                begin = np.flatnonzero(np.append(True, (np.diff(own[order]) != 0) | (np.diff(words.text[order]) != 0))) if len(order) else order
                times, which = np.diff(np.append(begin, len(order))), pa.array(words.text[order[begin]])
                k = len(begin)
                zeros = pa.array(np.zeros(k, np.int64))
                yield pa.RecordBatch.from_arrays([ids.take(which), same.take(which), zeros, zeros, zeros, pa.array(np.zeros(k)), pa.array(np.zeros(k)), pa.array(own[order[begin]]), pa.array(times)], names)

    names = [f.split()[0] for f in fields.split(", ")]
    parts = docs.select("doc_id", "text", F.xxhash64("text", "doc_id").alias("same")).mapInArrow(run, fields)
    smoothed = F.log10(F.coalesce("c", F.lit(0)) + SMOOTH) - below
    rare = F.col("times").isNotNull()
    joined = parts.join(words.select("hash", "c", F.col("log").alias("word_log")), "hash", "left")
    scored = joined.groupBy("doc_id", "same").agg(
        F.sum("copies").alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(rare & (F.col("c") > 0), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.when(rare, F.col("times") * smoothed).otherwise(0.0)).alias("base"),
        F.sum(F.col("log") + F.when(rare, F.col("times") * F.col("word_log")).otherwise(0.0)).alias("log"),
    )
    each = scored.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    of = lambda c, kind: (F.col(c) / F.col("copies")).cast(kind)
    return each.select("doc_id", (~_train(F.col("doc_id"))).alias("held_out"), of("n_tokens", "long").alias("n_tokens"), of("n_known", "long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), of("base", "double").alias("base_score"), of("log", "double").alias("score"))
