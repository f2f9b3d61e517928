"""Ranked full-text search over an inverted index."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.session import checkpoint

#: The ranking's constants, the least weight of a term, and how near NEAR is if it does not say.
K1, B, LEAST_IDF, NEAR = 1.2, 0.75, 1e-6, 10
BREAKS = r"[^\p{L}\p{N}]+"
MARKS = "[\u0300-\u0331]"


def _accented() -> dict[str, str]:
    """Letters that are an ASCII one with one mark, by that letter; those with two marks stay as they are."""
    parted = {chr(code): unicodedata.normalize("NFD", chr(code)) for code in range(0xC0, 0x1F00)}
    return {c: cut[0] for c, cut in parted.items() if len(cut) == 2 and cut[0] in "abcdefghijklmnopqrstuvwxyz" and unicodedata.combining(cut[1])}


ACCENTED = _accented()


def words_of(text: Column) -> Column:
    """The words of a text in lower case, without accents and marks; none of a null."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "".join(ACCENTED), "".join(ACCENTED.values()))
    return F.filter(F.split(F.regexp_replace(plain, MARKS, ""), BREAKS), lambda w: w != "")


def _words(text: str) -> tuple[str, ...]:
    """The same of a query's text."""
    plain = re.sub(MARKS, "", text.lower().translate(str.maketrans(ACCENTED)))
    return tuple("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in plain).split())


def index(docs: DataFrame, columns: tuple[str, ...] = ("title", "description", "rationale")) -> DataFrame:
    """(node_id, column, term, tf, at): the places of each term in each column, counted from 0."""
    parts = [docs.select("node_id", F.lit(c).alias("column"), words_of(F.col(c)).alias("words")) for c in columns]
    each = reduce(DataFrame.unionByName, parts).select("node_id", "column", F.posexplode("words").alias("p", "term"))
    return each.groupBy("node_id", "column", "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("p")).alias("at"))


def word_counts(docs: DataFrame, columns: tuple[str, ...] = ("title", "description", "rationale")) -> DataFrame:
    """(node_id, words) of every document, from its texts."""
    return docs.select("node_id", reduce(Column.__add__, [F.size(words_of(F.col(c))) for c in columns]).cast("long").alias("words"))


def row_postings(docs: DataFrame, columns: tuple[str, ...] = ("title", "description", "rationale")) -> DataFrame:
    """(node_id, column, term, at, words): the index of documents no two of which have one id, each made where it is read, without a shuffle.

    A column's words are sorted with their places, and a term is a run of them. words is the number in all columns.
    """
    placed = lambda c: F.sort_array(F.transform(words_of(F.col(c)), lambda w, p: F.struct(w.alias("term"), p.alias("p"))))
    split = docs.select("node_id", F.array(*(F.struct(F.lit(c).alias("column"), placed(c).alias("s")) for c in columns)).alias("parts"))
    split = split.withColumn("words", F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + F.size(x.s)))
    each = split.select("node_id", "words", F.explode("parts").alias("part")).select("node_id", "words", "part.column", "part.s").where(F.size("s") > 0)
    first = lambda i: (i == 1) | (F.get("s", i - 1).term != F.get("s", i - 2).term)
    runs = each.withColumn("runs", F.concat(F.filter(F.sequence(F.lit(1), F.size("s")), first), F.array(F.size("s") + 1)))
    run = lambda k: F.struct(F.get("s", F.get("runs", k) - 1).term.alias("term"), F.slice("s", F.get("runs", k), F.get("runs", k + 1) - F.get("runs", k)).p.alias("at"))
    made = F.transform(F.sequence(F.lit(0), F.size("runs") - 2), run)
    return runs.select("node_id", "column", "words", F.inline(made)).select("node_id", "column", "term", "at", "words")


def lengths(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """(node_id, words) of every document, those without a word among them."""
    counted = postings.groupBy("node_id").agg(F.sum("tf").alias("words"))
    return docs.select("node_id").join(counted, "node_id", "left").select("node_id", F.coalesce("words", F.lit(0)).alias("words"))


def refresh(postings: DataFrame, changed: DataFrame, columns: tuple[str, ...] = ("title", "description", "rationale")) -> DataFrame:
    """The index after some documents changed; one that is only to go has null columns."""
    return postings.join(changed.select("node_id"), "node_id", "left_anti").unionByName(index(changed, columns))


class Query:
    """What a query asks for: ``tree`` over ``parts`` (phrases) and ``nears`` (phrases that stand close together).

    Phrases side by side are all required and bind closest; then come NOT, AND and OR, and brackets. A phrase is a word, words
    in quotes or joined by +; with * its last word is a start of words, with ^ before it it begins a column. ``NEAR(a "b c", 5)``
    asks for phrases with at most 5 words between the first and the last of them. ``title:``, ``{title rationale}:`` and ``- title:`` name the columns
    of what follows. Words and columns are told apart by words, without case and accents. A phrase without a word is left out. What cannot be
    read is a ValueError.
    """

    _TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([\w\u0300-\u0331]+)|([(){}:,+*^-]))')

    def __init__(self, text: str):
        self._tokens, at, text = [], 0, text.strip()
        while at < len(text):
            m = self._TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at]!r} in a query")
            quoted, word, sign = m.groups()
            self._tokens.append(("text", quoted.replace('""', '"')) if quoted is not None else ("word", word) if word else ("sign", sign))
            at = m.end()
        self.parts: list[tuple] = []
        self.nears: list[tuple] = []
        self.tree = self._any(())
        if self._tokens:
            raise ValueError(f"unexpected {self._tokens[0][1]!r} in a query")
        if self.tree is None:
            raise ValueError("a query must ask for something")

    def _next(self, kind: str, *values: str) -> str | None:
        """Take the next token if it is of this kind and one of these values."""
        if self._tokens and self._tokens[0][0] == kind and (not values or self._tokens[0][1] in values):
            return self._tokens.pop(0)[1]
        return None

    def _must(self, sign: str) -> None:
        if not self._next("sign", sign):
            raise ValueError(f"a query lacks {sign!r}")

    @staticmethod
    def _join(how: str, found: list) -> tuple | None:
        found = [f for f in found if f is not None]
        return (how, tuple(found)) if len(found) > 1 else found[0] if found else None

    def _any(self, columns: tuple) -> tuple | None:
        found = [self._all(columns)]
        while self._next("word", "OR"):
            found.append(self._all(columns))
        return self._join("or", found)

    def _all(self, columns: tuple) -> tuple | None:
        found = [self._without(columns)]
        while self._next("word", "AND"):
            found.append(self._without(columns))
        return self._join("and", found)

    def _without(self, columns: tuple) -> tuple | None:
        out = self._beside(columns)
        while self._next("word", "NOT"):
            no = self._beside(columns)
            if out is None:
                raise ValueError("NOT needs something before it")
            out = out if no is None else ("not", (out, no))
        return out

    def _beside(self, columns: tuple) -> tuple | None:
        own = columns + self._columns()
        if self._next("sign", "("):
            out = self._any(own)
            self._must(")")
            return out
        found = [self._near(own)]
        while self._tokens and self._tokens[0] not in (("word", "OR"), ("word", "AND"), ("word", "NOT"), ("sign", ")")):
            found.append(self._near(columns + self._columns()))
        return self._join("and", found)

    def _columns(self) -> tuple:
        """((keep, names),) of a column filter that comes next, else nothing."""
        names, drop = [], self._next("sign", "-") is not None
        if self._next("sign", "{"):
            while word := self._next("word"):
                names.append(word)
            self._must("}")
        elif self._tokens[1:2] == [("sign", ":")]:
            names = [self._next("word") or self._next("text")]
        elif not drop:
            return ()
        self._must(":")
        return ((not drop, tuple(str(n).lower() for n in names)),)

    def _near(self, columns: tuple) -> tuple | None:
        if self._tokens[:2] != [("word", "NEAR"), ("sign", "(")]:
            k = self._phrase(columns, self._next("sign", "^") is not None)
            return None if k is None else ("part", k)
        del self._tokens[:2]
        found, distance = [], str(NEAR)
        while self._tokens and self._tokens[0][1] not in (",", ")") or self._tokens and self._tokens[0][0] == "text":
            found.append(self._phrase(columns, False))
        if self._next("sign", ","):
            distance = self._next("word") or ""
            if not distance.isdigit():
                raise ValueError("NEAR needs a number of words")
        self._must(")")
        found = [k for k in found if k is not None]
        if len(found) < 2:
            return ("part", found[0]) if found else None
        self.nears.append((tuple(found), int(distance)))
        return ("near", len(self.nears) - 1)

    def _phrase(self, columns: tuple, first: bool) -> int | None:
        words: tuple[str, ...] = ()
        while True:
            text = self._next("text")
            text = self._next("word") if text is None and self._tokens[:1] not in ([("word", o)] for o in ("AND", "OR", "NOT")) else text
            if text is None:
                raise ValueError("a query lacks a word")
            words += _words(text)
            if not self._next("sign", "+"):
                break
        part = (words, self._next("sign", "*") is not None, columns, first)
        if not words:
            return None
        if part not in self.parts:
            self.parts.append(part)
        return self.parts.index(part)

    def terms(self) -> tuple[list[str], list[str]]:
        """The words that must stand whole, and those of which a start is asked for."""
        words = [w for part, star, *_ in self.parts for w in (part[:-1] if star else part)]
        return sorted(set(words)), sorted({part[-1] for part, star, *_ in self.parts if star})

    @property
    def counts(self) -> list[str]:
        """Columns of counts that a rank is made from: each part's places, and of those in a NEAR the ones that are near the others."""
        return [f"tf{k}" for k in range(len(self.parts))] + [f"near{g}_{i}" for g, (phrases, _) in enumerate(self.nears) for i in range(len(phrases))]


def _allowed(column: str, columns: tuple) -> bool:
    return all((column.lower() in names) == keep for keep, names in columns)


def _starts(postings: DataFrame, part: tuple) -> DataFrame:
    """(node_id, column, from) of every place at which a part begins."""
    words, star, columns, first = part
    own = reduce(lambda rows, f: rows.where(F.lower("column").isin(*f[1]) == f[0]), columns, postings)
    last = F.startswith("term", F.lit(words[-1])) if star else F.col("term") == words[-1]
    placed = [own.where(last if k == len(words) - 1 else F.col("term") == w).select("node_id", "column", F.explode(F.expr(f"transform(at, p -> p - {k})")).alias("from")) for k, w in enumerate(words)]
    found = reduce(lambda a, b: a.join(b, ["node_id", "column", "from"]), placed)
    return found.where(F.col("from") == 0) if first else found


def _hits(postings: DataFrame, part: tuple) -> DataFrame:
    """(node_id, tf) of the documents in which a part stands."""
    return _starts(postings, part).groupBy("node_id").agg(F.count("*").alias("tf"))


def _near(starts: list[DataFrame], lengths: list[int], distance: int) -> DataFrame:
    """(node_id, i, tf) of the places of each phrase i that lie in a stretch with all the phrases.

    A stretch ends where a phrase begins, and every phrase begins at most its length and the distance before that. So a place is an end if
    each phrase's last place up to it is that close, and a place counts if the next end at or after it is. Both are windows over a column's
    places in order.
    """
    placed = reduce(DataFrame.unionByName, [s.select("node_id", "column", "from", F.lit(i).alias("i"), F.lit(n + distance).alias("reach")) for i, (s, n) in enumerate(zip(starts, lengths, strict=True))])
    own = Window.partitionBy("node_id", "column").orderBy("from")
    before, after = own.rangeBetween(Window.unboundedPreceding, 0), own.rangeBetween(0, Window.unboundedFollowing)
    close = [F.coalesce(F.max(F.when(F.col("i") == i, F.col("from"))).over(before) >= F.col("from") - (n + distance), F.lit(False)) for i, n in enumerate(lengths)]
    ends = placed.withColumn("end", reduce(Column.__and__, close)).withColumn("end", F.min(F.when(F.col("end"), F.col("from"))).over(after))
    return ends.where(F.col("from") >= F.col("end") - F.col("reach")).groupBy("node_id", "i").agg(F.count("*").alias("tf"))


def _near_counts(parsed: Query, starts: dict[int, DataFrame]) -> list[DataFrame]:
    """(node_id, count, tf) of each NEAR from the places of its phrases."""
    return [_near([starts[k] for k in phrases], [len(parsed.parts[k][0]) for k in phrases], distance).select("node_id", F.concat(F.lit(f"near{g}_"), F.col("i").cast("string")).alias("count"), "tf") for g, (phrases, distance) in enumerate(parsed.nears)]


def search(postings: DataFrame, sizes: DataFrame, query: str) -> DataFrame:
    """(node_id, rank) of the documents that a query finds in a kept index, the best, of the lowest rank, first."""
    parsed = Query(query)
    return _ranked(sizes.join(_counted(postings, parsed), "node_id", "left").fillna(0), parsed)


def rank_hits(postings: DataFrame, parsed: Query, docs: int, mean: float) -> DataFrame:
    """(node_id, rank) from the postings (with words) of a query's terms alone, and the number and mean words of all documents."""
    words = postings.groupBy("node_id").agg(F.max("words").alias("words"))
    return _ranked(_counted(postings, parsed).join(words, "node_id"), parsed, docs, mean)


def _counted(postings: DataFrame, parsed: Query) -> DataFrame:
    """(node_id, and the query's counts) of the documents that have any."""
    starts = {k: _starts(postings, parsed.parts[k]) for phrases, _ in parsed.nears for k in phrases}
    found = [_hits(postings, part).select("node_id", F.lit(f"tf{k}").alias("count"), "tf") for k, part in enumerate(parsed.parts)]
    return _by_document(found + _near_counts(parsed, starts), parsed.counts)


def _by_document(found: list[DataFrame], counts: list[str]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, found)
    return rows.groupBy("node_id").agg(*(F.coalesce(F.sum(F.when(F.col("count") == c, F.col("tf"))), F.lit(0)).alias(c) for c in counts))


def search_texts(docs: DataFrame, query: str, columns: tuple[str, ...] = ("title", "description", "rationale")) -> DataFrame:
    """The same without an index: one pass counts the words and each part's places, and nothing but those counts is kept.

    A NEAR keeps the places of its phrases too.
    """
    parsed = Query(query)
    split = docs.select("node_id", *(words_of(F.col(c)).alias(c) for c in columns))
    plus = lambda found: reduce(Column.__add__, found, F.lit(0).cast("long"))
    placed = {k: {c: _places(F.col(c), part) for c in columns if _allowed(c, part[2])} for k, part in enumerate(parsed.parts)}
    counts = [plus(F.size(p) for p in placed[k].values()).alias(f"tf{k}") for k in placed]
    close = sorted({k for phrases, _ in parsed.nears for k in phrases})
    kept = [F.array(*(F.struct(F.lit(c).alias("column"), p.alias("at")) for c, p in placed[k].items())).cast("array<struct<column:string,at:array<int>>>").alias(f"at{k}") for k in close]
    counted = checkpoint(split.select("node_id", plus(F.size(c) for c in columns).alias("words"), *counts, *kept))
    if parsed.nears:
        starts = {k: counted.select("node_id", F.inline(f"at{k}")).select("node_id", "column", F.explode("at").alias("from")) for k in close}
        near = _by_document(_near_counts(parsed, starts), parsed.counts[len(parsed.parts):])
        counted = counted.drop(*(f"at{k}" for k in close)).join(near, "node_id", "left").fillna(0)
    return _ranked(counted, parsed)


def _places(words: Column, part: tuple) -> Column:
    """The places at which a part begins in an array of words."""
    wanted, star, _, first = part
    last = lambda w: F.startswith(w, F.lit(wanted[-1])) if star else w == wanted[-1]
    at = lambda i: reduce(Column.__and__, [F.get(words, i + k) == w for k, w in enumerate(wanted[:-1])] + [last(F.get(words, i + len(wanted) - 1))])
    starts = F.array(F.lit(0)) if first else F.sequence(F.lit(0), F.size(words) - len(wanted))
    return F.when(F.size(words) >= len(wanted), F.filter(starts, at)).otherwise(F.array().cast("array<int>"))


def _ranked(counted: DataFrame, parsed: Query, docs: int | None = None, mean: float | None = None) -> DataFrame:
    """(node_id, rank) from every document's number of words and the query's counts; if docs and mean are given, of those that have any.

    A part counts as often as it is asked for, where all that stands around it in the query holds; what is behind a NOT does not count.
    """
    parts = range(len(parsed.parts))
    corpus = (F.count("*"), F.avg("words")) if docs is None else (F.lit(docs), F.lit(mean))
    total = counted.agg(corpus[0].alias("n"), corpus[1].alias("mean"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"docs{k}") for k in parts))

    def weight(k: int, tf: Column) -> Column:
        docs = F.col(f"docs{k}")
        idf = F.greatest(F.log((F.col("n") - docs + 0.5) / (docs + 0.5)), F.lit(LEAST_IDF))
        return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("words") / F.col("mean")))).otherwise(0.0)

    def hit(node: tuple) -> Column:
        how, of = node
        if how in ("part", "near"):
            return F.col(f"tf{of}" if how == "part" else f"near{of}_0") > 0
        first, *rest = map(hit, of)
        return reduce(Column.__or__ if how == "or" else Column.__and__, [~r for r in rest] if how == "not" else rest, first)

    def score(node: tuple) -> Column:
        how, of = node
        if how == "part":
            return weight(of, F.col(f"tf{of}"))
        if how == "near":
            return reduce(Column.__add__, [weight(k, F.col(f"near{of}_{i}")) for i, k in enumerate(parsed.nears[of][0])])
        if how == "not":
            return score(of[0])
        return reduce(Column.__add__, [F.when(hit(n), score(n)).otherwise(0.0) if how == "or" and n[0] not in ("part", "near") else score(n) for n in of])

    hits = counted.where(hit(parsed.tree)).join(F.broadcast(total))  # one row
    return hits.select("node_id", (-score(parsed.tree)).alias("rank")).orderBy("rank", "node_id")


def search_decisions(docs: DataFrame, nodes: DataFrame, edges: DataFrame, query: str, scope: str | None = None) -> DataFrame:
    """(id, name, rank) of decisions that a query finds, of those that govern the scope if there is one."""
    from .joins import governs_scope

    decisions = nodes.where("kind = 'decision'")
    if scope is not None:
        decisions = governs_scope(decisions, nodes, edges, scope)
    return decisions.join(search_texts(docs, query), F.col("id") == F.col("node_id")).select("id", "name", "rank").orderBy("rank", "id")
