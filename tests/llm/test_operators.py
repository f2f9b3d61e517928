"""Each operator against a plain version on a small table, and on tables with every odd row."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from loomgraph.llm import bpe, chat, extract, jaccard, licenses, lm, mixing, neardup, quality, toxicity
from loomgraph.llm import words as words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = make(60)
    texts = [make(rng.randint(50, 200)) for _ in range(30)]
    for i in range(30):
        words = texts[i % 6].split()
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [make(10) + "\n" + passage + "\n" + make(rng.randint(5, 60)) for _ in range(12)]
    texts += [texts[0], texts[0].upper(), "one two", "one  two", "alone", "# $ % a\n\nx x\nx x\nx x", "Released under the MIT License. General Public License!", "it's we'll  \n 'st"]
    return [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]


def odd_rows():
    long = "word " * 60_000 + "x" * 2000
    return [(1, None, None, None, None), (None, "a b c d e f", "en", None, 3), (2, "", "", "", 0), (3, long, "en", "s", 1), (4, "same text of six words here", "en", "s", 1), (4, "same text of six words here", "en", "s", 1), (None, None, None, None, None), (5, "\x00   é 漢字 🙂", "en", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def operators(spark):
    labels = labels_of(spark, [(1, 1, 0), (4, 1, 1), (None, 1, 1), (3, None, None)])
    return {
        "bpe": lambda d: bpe.encode(d, RANKS, ids=True), "toxicity": lambda d: toxicity.toxicity(d, labels), "quality": quality.quality, "licenses": licenses.scan,
        "mixing": mixing.mix, "jaccard": jaccard.jaccard, "lm": lambda d: lm.score(d, PIECES),
    }


@pytest.mark.parametrize("name", ["bpe", "toxicity", "quality", "licenses", "mixing", "jaccard", "lm"])
def test_odd_rows_each_give_a_row(spark, name):
    run = operators(spark)[name]
    clash = spark.createDataFrame(odd_rows(), DOCS)
    for extra in ("id", "words", "hash", "key", "size", "component_id", "score", "part", "label"):
        clash = clash.selectExpr("*", f"1 as {extra}")
    assert sorted(str(r.doc_id) for r in run(clash).collect()) == sorted(str(r[0]) for r in odd_rows())
    assert run(clash.limit(0)).collect() == []


def test_bpe_as_the_library(docs, spark):
    ranks = bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe.PATTERN == public_tokenizers.PATTERN
    rng = random.Random(1)
    strange = [(i, "".join(rng.choice("abt hein éß漢🙂\n\t'.,01  \x1c srevld½") for _ in range(rng.randint(0, 50))), "", "", 0) for i in range(1000, 1400)]
    rows = corpus() + strange + odd_rows()[-1:]
    want = collections.Counter()
    for r in rows:
        ids = library.encode_ordinary(r[1])
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, bpe.encode(spark.createDataFrame(rows, DOCS), RANKS).collect())) == want


def thue_morse():
    """Two words that a polynomial hash modulo a power of two cannot tell apart, amid some text."""
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    return a, b


def test_bpe_where_hashes_collide(spark, monkeypatch):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    a, b = thue_morse()
    text = f"{a} {a} {b}"
    got = bpe.encode(spark.createDataFrame([(1, text, "", "", 0)], DOCS), RANKS).first()
    assert got.ids_sha256 == hashlib.sha256(np.array(library.encode_ordinary(text), "<u4").tobytes()).hexdigest() and got.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    exact = bpe.spans
    monkeypatch.setattr(bpe, "spans", lambda *x: exact(*x) & np.uint64(7))
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), bpe.PATTERN)
    text = " ".join(t for _, t, *_ in corpus())
    assert encoder.encode(*words_of.buffers(pa.array([text])))[0].tolist() == library.encode_ordinary(text)


def test_counts_of_words_that_collide_elsewhere(spark):
    a, b = thue_morse()
    rest = [f"w{i}" for i in range(60)]
    texts = [" ".join([a, *rest]), " ".join([b, *rest]), "\n".join([*rest, a, b]), " ".join([a, b, "x"] * 3 + rest)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    assert [r.n_shingles for r in jaccard.jaccard(frame).orderBy("doc_id").collect()] == list(map(len, sets))
    got = quality.quality(frame).orderBy("doc_id").collect()
    assert [(r.n_dup_lines, r.n_repeat_words) for r in got] == [(0, 0), (0, 0), (0, 0), (0, 9)]
    scored = lm.score(frame, PIECES).orderBy("doc_id").collect()
    train = [i for i in range(4) if zlib.crc32(str(i).encode()) % 10]
    counts = collections.Counter(w for i in train for w in texts[i].split())
    assert [r.n_known for r in scored] == [sum(counts[w] > 0 for w in t.split()) + 1 for t in texts]
    assert lm.word_table(frame.withColumn("train", F.lit(True))).count() == len({w for t in texts for w in t.split()})


def test_bpe_prefix_table_edits():
    v = bpe.Vocabulary(bpe.read_ranks(RANKS))
    rng = random.Random(2)
    for _ in range(200):
        piece, new = (bytes(rng.choice(b"thein aer\xc3\xa9") for _ in range(rng.randint(1, n))) for n in (60, 6))
        i = rng.randrange(len(piece) + 1)
        j = rng.randint(i, len(piece))
        table = bpe.Prefixes(v, piece).replace(i, j, new)
        assert table.last == bpe.Prefixes(v, piece[:i] + new + piece[j:]).last and table.tokens() == v.merged(table.piece)
        assert bpe.Prefixes(v, piece).append(new).tokens() == v.merged(piece + new)


def test_main_text():
    weights = extract.learnt()
    page = (
        "<html><head><title>t</title><style>x{}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class='site-ad'>Buy this now please</div><article><h1>A  title</h1><p>One &amp; two three"
        "<p>four <b>five</b> six<script>var x = '<p>no</p>'</script><form><input> name</form><div class=comments><p>I like it all very much</div><p>End.</p></article><footer>Foot &copy;</footer>"
    )
    assert extract.main_text(page, weights) == "A title\nOne & two three\nfour five six\nEnd."
    assert [extract.main_text(x, weights) for x in (None, "", "<div>", "plain  text", "<a \"" * 5000)] == ["", "", "", "plain text", ""]


def test_best_run_by_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(rng.randint(0, 25))]
        start, end = extract.best_run(scores)
        totals = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
        assert sum(scores[start:end]) == max([0, *totals])


def test_main_text_in_other_pages():
    """Pages that no weight was learnt from; m words are main text, x words are not."""
    weights, m, x = extract.learnt(), "m " * 30, "x " * 12
    pages = [
        f"<body><div id=page class='hfeed site'><div class='header-wrap'><p>{x}</p></div><article class='feature-list-page'><header class=entry-header><h1>m m</h1></header><ul class=feature-list><li>m m<li>m</ul><p>{m}</p><p>m</p></article><div class='post-comments'><p>{x}</p></div></div>",
        f"<body><nav>{x}</nav><div class='comments-open post'><p>{m}</p><p>m m</p></div><div id=comments><p>{x}</p></div><div class=site-footer>{x}</div>",
        f"<body><aside><ul><li><a>x</a><li><a>x x</a></ul></aside><main><p>{m}</p><div class='ad-slot ad'>{x * 9}</div><p>m m m</p><form><label>x</label></form><p>m</p></main><footer>{x}</footer>",
        f"<body><div class='overlay'><div class=wrap><article><p>{m}</p></article></div></div><div class=sidebar>{x}</div>",
        f"<body><div class=menu>{x}</div><div><h1>m m m</h1><p>{m}<p>{m}<p>m</div><div class='cookie-notice'>{x}</div>",
        f"<body><main><article><p>{m}</p></article><section class=comments><article class=comment><p>{x}</p></article></section></main>",
    ]
    got = [extract.main_text(p, weights).split() for p in pages]
    want = [p.split(">", 1)[1] for p in pages]
    found = [(w.count("m"), w.count("x"), len(re.findall(r"\bm\b", p))) for w, p in zip(got, want, strict=True)]
    assert all(x == 0 and m == of for m, x, of in found), found


def test_hostile_pages_take_linear_time():
    weights = extract.learnt()
    for page in ("<b>" * 300_000, "<b>" * 150_000 + "</i>" * 150_000, "<p><b>" * 100_000, "<div class=a-b>" * 60_000 + "w", "<li><a>" * 100_000):
        began = time.process_time()
        extract.main_text(page, weights)
        assert time.process_time() - began < 10


def test_pages_of_documents(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = extract.extract(spark.read.parquet(f"{folder}/pages.parquet")).collect()
    words = lambda t: collections.Counter(WORD.findall(t))
    alike = []
    for r in got:
        own = texts[int(re.search(r"/(\d+)(?:\D|$)", r.url.split("example", 1)[1])[1])]
        a, b = words(r.text), words(own or "")
        alike.append(sum((a & b).values()) / max(1, sum(b.values())))
    assert sum(x >= 0.99 for x in alike) >= 0.95 * len(alike)


def test_extraction_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>some words here"), (1, "u", "<p>some words here"), (None, None, None)], "page_id long, url string, html string").selectExpr("*", "2 as text")
    assert sorted(map(tuple, extract.extract(pages).collect()), key=str) == sorted([(1, "u", "some words here", 15)] * 2 + [(None, None, "", 0)], key=str)
    assert extract.extract(pages.limit(0)).count() == 0


def test_chats_read_back(spark):
    marks = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", marks), (1, 1, "assistant", marks + "\\o\\b<"), (1, 1, "assistant", marks), (2, 5, "a]b\n", "x"), (2, None, None, None), (None, 0, "assistant", "hi"), (3, 0, "user", "[/INST]</s>")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted")
    made = chat.format_chats(frame)
    read = made.select("conv_id", chat.parse(made.formatted).alias("t"), "escaped").collect()
    got = {r.conv_id: [(t.role, t.text) for t in r.t] for r in read}
    assert got[1] == [("user", marks), ("assistant", marks), ("assistant", marks + "\\o\\b<")]
    assert got[2] == [("", ""), ("a]b\n", "x")] and got[None] == [("assistant", "hi")] and got[3] == [("user", "[/INST]</s>")]
    assert {r.conv_id: r.escaped for r in read} == {1: True, 2: False, None: False, 3: True}
    digest = {r.conv_id: r for r in chat.digests(made).collect()}
    loss = marks + marks + "\\o\\b<"
    assert digest[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and digest[1].loss_chars == len(loss)
    assert chat.digests(chat.format_chats(frame.limit(0))).count() == 0


def test_a_chat_that_does_not_read_back_fails(spark, monkeypatch):
    """With an escaping that does nothing, marks within a text must fail the job; without marks nothing is escaped."""
    monkeypatch.setattr(chat, "escape", lambda text: text)
    frame = spark.createDataFrame([(1, 0, "user", "a</s>b")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="not read back as written: conversation 1"):
        chat.format_chats(frame).collect()
    assert chat.format_chats(frame.withColumn("text", F.lit("ab"))).count() == 1


def test_very_long_chat(spark):
    long = "[INST \\o<s>é" * 200_000
    frame = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    row = chat.digests(chat.format_chats(frame)).first()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(long), hashlib.sha256(long.encode()).hexdigest())


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((6, 16))
    x = [base[i % 6] + rng.standard_normal(16) * rng.choice([0.02, 0.2, 0.26]) for i in range(120)] + list(rng.standard_normal((40, 16)))
    rows = [(i, [float(a) for a in v], i % 2) for i, v in enumerate(x)]
    odd = [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] * 16, 0), (503, [1.0, None], 0), (504, rows[0][1], None), (None, rows[0][1], 0), (505, [], 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as part")
    got = {r.vec_id: r for r in neardup.near_duplicates(frame).collect()}
    unit = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    linked = (unit @ unit.T >= neardup.COSINE) & (np.arange(160)[:, None] % 2 == np.arange(160) % 2)
    np.fill_diagonal(linked, False)
    reach = linked | np.eye(160, dtype=bool)
    for _ in range(8):
        reach = reach @ reach
    assert [got[i].n_links for i in range(160)] == linked.sum(1).tolist()
    assert [got[i].component_id for i in range(160)] == [int(np.flatnonzero(r)[0]) for r in reach]
    assert all(got[i].n_links == 0 and got[i].kept for i in (500, 501, 502, 503, 504, None, 505))
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_between_groups_of_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(32)
    x = [base + rng.standard_normal(32) * 0.24 for _ in range(6)]
    rows = [(i, [float(a) for a in x[i % 6]], 0) for i in range(600)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    unit = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= neardup.COSINE
    assert 6 < linked.sum() < 36
    reach = np.linalg.matrix_power(linked.astype(int), 6) > 0
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (100 * int(linked[i % 6].sum()) - 1, int(np.flatnonzero(reach[i % 6])[0])) for i in range(600)}
    assert neardup.passes(1000) == neardup.PASSES < neardup.passes(10**6) < neardup.passes(10**8)


def test_toxicity_finds_held_out(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    rows, marked = [], []
    for i in range(400):
        own = [rng.choice(words) for _ in range(60)]
        bad = i % 5 == 0
        for _ in range(4 if bad else 0):
            own[rng.randrange(60)] = rng.choice(["nasty", "vilest", "vilely"])
        rows.append((i, " ".join(own), "en", "s", 1))
        marked.append((i, 1, int(bad)))
    got = toxicity.toxicity(spark.createDataFrame(rows, DOCS), labels_of(spark, marked)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == int(r.doc_id % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.toxicity(spark.createDataFrame(rows[:3], DOCS), labels_of(spark, [])).collect()} == {0.5}


def test_block_bounds_give_the_exact_nearest():
    rng = np.random.default_rng(1)
    weights = rng.random((20, 500)) * (rng.random((20, 500)) < 0.2)
    weights /= np.maximum(1e-9, np.linalg.norm(weights, axis=0))
    index = toxicity.Index(np.arange(20), np.ones(20), weights, np.zeros(500), np.ones(500), list(range(500)), 0, 0)
    for _ in range(50):
        at = np.sort(rng.choice(20, 5, replace=False))
        q = index.vector(at, rng.integers(1, 5, 5).astype(float))
        cosine = q @ weights[at]
        want = sorted(((-c, i) for i, c in enumerate(cosine) if c > 0))[: toxicity.NEAREST]
        assert np.allclose([c for c, _ in index.nearest(at, q)], [-c for c, _ in want])


def test_toxicity_cosine_takes_all_terms(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(600)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)) + (" vil" if i % 2 else ""), "en", "s", 1) for i in range(300)]
    frame = spark.createDataFrame(rows, DOCS)
    index = toxicity.fit(frame, labels_of(spark, [(i, 1, i % 2) for i in range(300)]))
    text = {i: collections.Counter(t.split()) for i, t, *_ in rows}
    counted = collections.Counter(w for i in index.ids for w in text[i])
    stands = dict(zip(index.ids, index.stands, strict=True))
    assert len(index.terms) == len(counted) > 256 and set(stands) == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1}
    idf = {w: math.log(1 + 300 / sum(w in text[i] for i in text)) for w in counted}
    once = [idf[w] for w in counted if sum(w in text[i] for i in index.ids) == 1]
    assert math.isclose(index.unseen, sum(once) / len(once) if once else 1.0)
    unit = lambda c: {w: (1 + math.log(n)) * idf.get(w, index.unseen) for w, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    texts = [" ".join(rng.choice(words) for _ in range(50)) + " zzz zzz yyy" for _ in range(20)]
    data, bounds = words_of.buffers(pa.array(texts))
    _, near = index.score(data, bounds)
    for t, got in zip(texts, near, strict=True):
        q = unit(collections.Counter(t.split()))
        cosine = {i: sum(x * q.get(w, 0) for w, x in unit(text[i]).items()) / norm(q) / norm(unit(text[i])) for i in index.ids}
        assert np.allclose([cosine[i] for i in got], sorted(cosine.values(), reverse=True)[:3], atol=1e-9)
    # texts without a telling term differ, and one toxic word in a long clean text is none of its weight
    plain = [rows[0][1], rows[2][1], " ".join(rng.choice(words) for _ in range(20_000)) + " vil", rows[0][1] + " vil"]
    data, bounds = words_of.buffers(pa.array(plain))
    scores, _ = index.score(data, bounds)
    assert scores[0] != scores[1] and scores[2] < scores[3] and scores[3] >= toxicity.TOXIC


def test_every_labelled_copy_is_an_example(spark):
    rows = [(i, f"same words in every text {'' if i < 40 else i}", "en", "s", 1) for i in range(90)]
    index = toxicity.fit(spark.createDataFrame(rows, DOCS), labels_of(spark, [(i, 1, i % 2) for i in range(90)]))
    train = [i for i in range(90) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(index.ids) == train and [index.toxic[index.ids.index(i)] for i in train] == [i % 2 for i in train]


def test_scores_are_calibrated():
    rng = np.random.default_rng(2)
    p = rng.random(4000)
    toxic = (rng.random(4000) < p).astype(float)
    a, b = toxicity.curve(1 / (1 + ((1 - p) / p) ** 0.4), toxic, np.ones(4000))
    assert abs(a) < 0.2 and abs(b - 2.5) < 0.3
    assert toxicity.curve(np.full(3, 0.4), np.zeros(3), np.zeros(3)) == (0.0, 1.0)


def test_quality_counts(docs):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for i, t, *_ in corpus():
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        cover = {j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert tuple(getattr(got[i], c) for c in quality.COUNTS) == want
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (got[i].base_failed and got[i].kept)


def test_quality_rejects_outliers(spark):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(120))
    rows = [(i, text() if i % 10 else " | ".join(text().split()), "en", "s", 1) for i in range(200)]
    assert all(r.kept == bool(r.doc_id % 10) for r in quality.quality(spark.createDataFrame(rows, DOCS)).collect())


def test_least_determinant_of_all_halves(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((8, 4)) @ np.diag([0.3, 0.5, 0.4, 0.6]), rng.standard_normal((4, 4)) + 6])
    rows = [("p", i % 3, int(i * 7919), *map(float, v)) for i, v in enumerate(x)]
    names = ", ".join(f"{v} double" for v in quality.FLOORS)
    got = quality.estimates(spark.createDataFrame(rows, "part string, salt int, h long, " + names)).first()
    half = quality.chi_square_at(0.5, 2)
    factor = 0.5 / quality.chi_square(half, 3)
    found = []
    for half in itertools.combinations(range(12), 6):
        found.append(np.linalg.slogdet(quality.raised(factor * np.cov(x[list(half)].T, bias=True)))[1])
    # a local minimum at worst: no outlier is in it, and few of the 924 halves are better
    assert np.abs(np.array(got.centre)).max() < 1 and sum(f < got.logdet - 1e-9 for f in found) <= 0.03 * len(found)
    away = [(v - got.centre) @ np.array(got.inverse).reshape(4, 4) @ (v - got.centre) for v in x]
    assert min(away[8:]) > quality.chi_square_at(1 - quality.TAIL, 2) and set(np.argsort(away)[:6]) <= set(range(8))


def test_license_base(docs):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t, *_ in corpus():
        words = cut.findall(lower(t))
        at = sorted((k, label) for label, p in licenses.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_notices_with_gaps(spark):
    text = "Foo. Redistribution and use in source and binary forms, with or without small modification, are permitted provided that the following conditions are met: bar"
    got = licenses.scan(spark.createDataFrame([(1, text, "", "", 1)], DOCS)).first()
    assert got.labels == "bsd" and got.n_base == 0 and got.score > 0.7


def wanted_of(total):
    """Targets by taking out the sources above three times their size until none is."""
    weight = {s: 1 + k % 3 for k, s in enumerate([*sorted(s for s in total if s), *([None] if None in total else [])])}
    target, free = {}, set(total)
    while free:
        left = sum(total.values()) - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * total[s]]
        target |= {s: 3 * total[s] for s in over} if over else {s: level * weight[s] for s in free}
        free -= set(over) if over else free
    return target


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), "en", [None, "a", "b", "c", "tiny"][min(4, i % 40)] if i % 40 < 5 else "big", 1) for i in range(1200)]
    # a source with a document that is most of it, and null ids with equal sizes
    rows += [(2000 + i, "w " * n, "en", "giant", 1) for i, n in enumerate([3000, 700, 90, 40, 20, 7, 3])] + [(None, "w " * 10 + str(i), "en", "c", 1) for i in range(20)]
    frame = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(frame).collect()
    total = collections.Counter()
    for r in rows:
        total[r[3]] += len(r[1].split())
    target = wanted_of(total)
    by_size = {v: k for k, v in total.items()}
    assert len(by_size) == len(total) and len(got) == len(rows)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), len(r[1].split())) for r in rows)
    taken, sizes = collections.Counter(), collections.defaultdict(list)
    for r in got:
        source = by_size[r.source_size]
        assert math.isclose(r.target, target[source], rel_tol=1e-9) and r.taken <= 3 * r.size and r.taken % r.size == 0
        taken[source] += r.taken
        sizes[source].append((r.size, r.rate))
    assert {s: (taken[s], target[s]) for s in target if abs(taken[s] - target[s]) > max(3, (0.01 if s == "giant" else 0.001) * target[s])} == {}
    for s, own in sizes.items():
        low, high = -10.0, 10.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * min(3, math.exp(min(50, mid * n))) for n, _ in own) < target[s] else (low, mid)
        assert all(math.isclose(rate, min(3, math.exp(min(50, low * n))), rel_tol=1e-5) for n, rate in own)
        # the tilt tells documents of different sizes apart, unless all are taken three times
        assert len({round(rate, 6) for _, rate in own}) > 1 or target[s] == 3 * total[s]
    assert sorted(str(r[:2]) for r in mixing.mix(frame.repartition(7)).select("doc_id", "taken").collect()) == sorted(str((r.doc_id, r.taken)) for r in got)


def test_mix_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 7)
    rows = [(i if i % 3 else None, "w " * (5 + i % 2), "en", "a" if i % 5 else "b", 1) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    taken = collections.Counter()
    for r in got:
        taken[r.source_size, r.target] += r.taken
    assert len(got) == 400 and all(abs(n - target) <= 5 for (_, target), n in taken.items())


@pytest.mark.parametrize("held", [1 << 18, 400])
def test_jaccard_against_all_pairs(docs, monkeypatch, held):
    monkeypatch.setattr(jaccard, "FAMILY_SHINGLES", held)
    sets = {}
    for i, t, *_ in corpus():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def top(i):
        return i if up[i] == i else top(up[i])

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    assert sum(top(i) != i for i in sets) > 15
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard(docs).collect()} == {i: (len(s), top(i)) for i, s in sets.items()}


def test_jaccard_messages_do_not_grow_with_shards(docs, monkeypatch):
    def held(shards):
        return jaccard._sent(docs, shards).select(F.sum(F.coalesce(F.octet_length("owners"), F.lit(0)) - 1), F.sum(F.octet_length("shingles")), F.sum(F.octet_length("keys"))).first()

    few, many = held(16), held(1024)
    assert few[1] == many[1] and few[2] == many[2] and many[0] <= few[1] / 2
    want = {r.set_key for r in jaccard._count_shared(jaccard._sent(docs, 16), 16).collect()}
    assert {r.set_key for r in jaccard._count_shared(jaccard._sent(docs, 1024), 1024).collect()} == want
    monkeypatch.setattr(jaccard, "SHARD_BYTES", 64)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 6000)
    test_jaccard_against_all_pairs(docs, monkeypatch, 1 << 18)


def test_jaccard_sends_no_empty_rows(spark, docs, monkeypatch):
    """With more shards than shingles there are as many rows as shingles at most, and a row for each block; so rows grow as the input does."""
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 6000)

    def sent(times):
        many = docs.select((F.col("doc_id") * times + F.col("k")).alias("doc_id"), F.regexp_replace("text", r"(\s)", F.concat(F.col("k").cast("string"), F.lit("$1"))).alias("text")) if times > 1 else docs
        rows = jaccard._sent(many, 1 << 20)
        got = rows.agg(F.count("*"), F.sum(F.octet_length("shingles") + F.octet_length("common")) / 4, F.count_distinct("block")).first()
        assert got[2] > 1 and got[0] <= got[1] + got[2]
        assert rows.where("keys is null and octet_length(shingles) + octet_length(common) = 0").isEmpty()
        return got[0], got[1]

    once = sent(1)
    docs = docs.crossJoin(spark.range(4).withColumnRenamed("id", "k"))
    four = sent(4)
    assert four[1] > 3 * once[1]
    assert four[0] / once[0] <= 1.1 * four[1] / once[1]


def plain_lattice(pieces):
    log = dict(zip(pieces.texts, pieces.log, strict=True))

    def total(word):
        return sum((math.exp(log[word[:k]]) * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in log), 0.0) if word else 1.0

    return total


def test_lattice_sums_all_segmentations():
    pieces = lm.Pieces.read(PIECES)
    total = plain_lattice(pieces)
    words = [lm.START + w for w in (b"the", b"there", "é".encode(), b"a", b"zqx", b"x" * 80, b"y" * 2000)]
    got = pieces.marginals(words)
    assert np.allclose(got[:5], [math.log(total(w)) for w in words[:5]]) and np.isfinite(got).all()
    assert np.allclose([pieces._alone(w) for w in words], got)
    assert math.isclose(sum(map(math.exp, pieces.log)) + math.exp(pieces.end), 1)
    long = pieces.marginals([bytes(random.Random(1).choices(b"abcABC012+/", k=200_000))])
    assert np.isfinite(long).all() and long[0] < -200_000


@pytest.mark.parametrize("head", [1 << 17, 5])
def test_lm_scores(docs, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t, *_ in corpus()}
    train = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    c = collections.Counter(t for i, own in tokens.items() if train(i) for t in own)
    n, v = sum(c.values()), len(c)
    pieces = lm.Pieces.read(PIECES)
    total = plain_lattice(pieces)
    q = {t: total(lm.START + t.encode()) if t else math.exp(pieces.end) for own in tokens.values() for t in own}
    got = {r.doc_id: r for r in lm.score(docs, PIECES).collect()}
    for i, own in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not train(i), len(own), sum(c[t] > 0 for t in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10((c[t] + v * q[t]) / (n + v)) for t in own), rel_tol=1e-9)


def test_commonest_words_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 10)
    frame = spark.range(1000).selectExpr("id as hash", "id % 7 as c", "1000 div (id + 1) + 1 as seen", "0.0D as log")
    hashes, _, _ = lm._head(frame)
    assert 0 < len(hashes) <= 10 and hashes.tolist() == list(range(len(hashes)))
