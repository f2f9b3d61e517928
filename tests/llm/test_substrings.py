"""Substring dedup against a plain search for every window."""

import hashlib
import random
import re

from loomgraph.llm import queries, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """Rows (doc_id, text) of different ids."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if (window := tuple(w[i : i + 20])) in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(12)
    free = lambda n: [f"w{rnd.randint(0, 5000)}" for _ in range(n)]
    passages = [free(n) for n in (19, 20, 21, 25, 33, 60, 200)] + [["a"] * 50, ["a", "b"] * 30, ["Ü", "c"] * 9]
    rows = []
    for k in range(150):
        words = []
        for _ in range(rnd.randint(0, 5)):
            words += free(rnd.randint(0, 40)) if rnd.random() < 0.5 else rnd.choice(passages)
        rows.append((rnd.randint(0, 10**6) * 151 + k, rnd.choice((" ", "\n", "\t ")).join(words)))
    near = free(120)
    for k in range(40):  # near copies
        own = list(near)
        own[rnd.randrange(120)] = f"x{k}"
        rows.append((2 * 10**9 + k, " ".join(own)))
    rows += [(3 * 10**9 + k, " ".join(passages[6])) for k in range(30)]  # exact copies
    # a passage in so many contexts that its borders are dealt over all shards
    rows += [(4 * 10**9 + k, " ".join([*free(15), *passages[5], *free(15)])) for k in range(700)]
    rows += [(-3, None), (-2, ""), (-1, " \n"), (None, " ".join(passages[4]))]
    rnd.shuffle(rows)
    return rows


def test_windows_against_all_earlier_ones(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, wanted string, key int, start int").repartition(5)
    kept = substrings.without_repeats(docs)
    found = substrings.digests(kept)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def test_rows_that_repeat(spark):
    text = " ".join(f"v{k}" for k in range(40))
    rows = [(1, text), (1, text), (2, text), (2, "short"), (None, text), (None, text), (3, text + " more")]
    found = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, 40, [], text)] * 2 + [(2, 40, [(0, 40)], ""), (2, 1, [], "short"), (3, 41, [(0, 40)], "more")] + [(None, 40, [(0, 40)], "")] * 2
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.removed], r.text) for r in found), key=str) == sorted(want, key=str)


def test_automaton_against_all_runs():
    rnd = random.Random(5)
    for _ in range(300):
        automaton, seen, at = substrings.Automaton(), {}, 0
        for _ in range(rnd.randint(1, 6)):
            symbols = rnd.choices(range(rnd.choice((1, 2, 5))), k=rnd.randint(0, 25))
            assert automaton.add(symbols) == at
            for j in range(len(symbols)):
                for i in range(j + 1):
                    seen.setdefault(tuple(symbols[i : j + 1]), at + j)
            at += len(symbols)
        asked, most = rnd.choices(range(6), k=30), rnd.randint(1, 12)
        for j, (length, first) in enumerate(automaton.match(asked, most)):
            runs = [asked[j + 1 - n : j + 1] for n in range(1, min(most, j + 1) + 1)]
            want = max((len(r) for r in runs if tuple(r) in seen), default=0)
            assert length == want and (not want or first == seen[tuple(asked[j + 1 - want : j + 1])])


def test_no_documents(spark):
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_query_against_all_earlier_windows(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:4] for r in queries.op12_substring_dedup(spark, "/root/testdata/sf0.001").collect()), key=str) == plain(rows)
