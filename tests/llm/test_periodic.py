"""Periodic runs against a plain search of every lag."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

from loomgraph.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def texts():
    rnd = random.Random(11)
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 23), (5, "a " * 24), (6, "x y z\x1fz " * 30), (None, "a b " * 40), (None, None), (7, "p q r " * 20), (7, "p q r " * 20), (7, "s t " * 30)]
    for i in range(8, 120):
        words = []
        while len(words) < rnd.randint(1, 400):
            if rnd.random() < 0.5:
                words += rnd.choices("ab" if rnd.random() < 0.5 else "abcdefgh", k=rnd.randint(1, 30))
            else:
                words += rnd.choices("abcü", k=rnd.randint(1, 12)) * rnd.randint(1, 9)
        out.append((i, rnd.choice((" ", "\n", " \t")).join(words)))
    base = [f"word{rnd.randint(0, 10**6)}" for _ in range(1500)]
    out.append((500, " ".join((base * 4)[:5600])))  # a text of several ranges of lags, twice
    out.append((501, " ".join((base * 4)[:5600])))
    return out


def test_runs_against_every_lag(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, runs string, ranges int, same string")
    got = periodic.digests(periodic.collapse(periodic.planted(docs.select("doc_id", "text"))))
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = sorted((tuple(r)[:8] for r in got.collect()), key=str)
    assert found == sorted((plain(i, t) for i, t in rows), key=str)
    bare = periodic.collapse(docs)
    assert {(r.doc_id, r.n_words) for r in bare.collect()} == {(i, len(WORD.findall(t or ""))) for i, t in rows}


def test_ranges_give_what_one_pass_gives():
    rnd = random.Random(3)
    for _ in range(60):
        words = [x.encode() for x in (rnd.choices("ab", k=rnd.randint(0, 9)) * rnd.randint(1, 20) + rnd.choices("abc", k=rnd.randint(0, 80)))]
        want, m = plain_runs(words), rnd.randint(1, 30)
        got = [r for low in range(0, len(words) // 3 + 1, m) for r in periodic._found([words], low, low + m)[0]]
        assert sorted(got, key=lambda r: (r[0], r[2])) == want == periodic._found([words])[0]


def test_no_documents(spark):
    assert periodic.digests(periodic.collapse(periodic.planted(spark.createDataFrame([], "doc_id long, text string")))).count() == 0


def test_the_query_against_every_lag(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = sorted((tuple(r)[:8] for r in queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert found == sorted((plain(r.doc_id, r.text) for r in docs), key=str)
