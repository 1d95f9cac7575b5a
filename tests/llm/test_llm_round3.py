"""Vector codes, page text and importance resampling: brute force, page by page cases, nulls, ties, repeats, empties."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waygraph.llm import importance, page_text, vector_codes
from waygraph.llm.neardup import parities
from waygraph.llm.page_text import Ratios, content

VECTORS = "vec_id long, embedding array<float>, label int, code string, __label string"


def brute_codes(rows, parts, entries, rounds):
    """Lloyd's rounds by plain loops."""
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: r[0])
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in rows[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(v, p)[1] for _, v in rows]
            books[p] = [[sum(c) // len(c) for c in zip(*(cut(v, p) for (_, v), j in zip(rows, own, strict=True) if j == e), strict=True)] or books[p][e] for e in range(len(books[p]))]
    got = {i: [near(v, p) for p in range(parts)] for i, v in rows}
    return {i: ("".join(f"{j:02x}" for _, j in g), sum(d for d, _ in g)) for i, g in got.items()}, books


def test_vector_codes_are_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 11 % 301, [float(x) for x in np.round(rng.normal(0, 0.1, 8), 2)], i % 3 if i % 5 else None, "x", "y") for i in range(300)]
    rows += [(900, None, 1, "x", "y"), (901, [None] * 8, 1, "x", "y"), (902, [float("nan")] * 8, None, "x", "y"), (903, [float("inf")] + [0.0] * 7, 1, "x", "y")]
    rows += [(1000 + i, rows[0][1], 7, "x", "y") for i in range(50)]
    codes, books = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(5), 4, 16, 3)
    got = {r.vec_id: (r.code, r.error) for r in codes.collect()}
    want, brute = brute_codes(rows, 4, 16, 3)
    assert got == want
    assert books.entries.tolist() == brute
    assert books.sha256() == hashlib.sha256(",".join(str(x) for p in brute for e in p for x in e).encode()).hexdigest()
    assert codes.agg(F.sum("computed")).first()[0] < 350 * 4 * 16 / 2  # the bounds pass most entries over
    sums = {}
    for i, _, label, *_ in rows:
        if i in want:
            sums[label] = sums.get(label, 0) + want[i][1]
    by_id = {i: label for i, _, label, *_ in rows}
    for most in (100, 0):  # broadcast, and salted
        assert all(r.label_error == sums[by_id[r.vec_id]] for r in vector_codes.with_label_errors(codes, most).collect())
    near = {r.vec_id: r.approximation for r in vector_codes.decode(codes, books).collect()}
    i, v = rows[0][0], [math.floor(256 * x) for x in rows[0][1]]
    assert round(sum((a - b * 256) ** 2 for a, b in zip(v, near[i], strict=True))) == want[i][1]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12), st.integers(1, 40))
def test_pruned_is_full(seed, k, n):
    """Small integers, so that ties are many."""
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-4, 5, (n, 2)), rng.integers(-4, 5, (k, 2))
    code, upper, lower = vector_codes.full(x, book)
    for _ in range(3):
        after = book + rng.integers(-1, 2, book.shape)
        shift = vector_codes.Books.of(after[None], book[None]).moved[0]
        packed, unit = vector_codes.pack(lower)
        assert (vector_codes.unpack(packed, unit) <= lower).all()
        code, upper, lower, _ = vector_codes.pruned(x, after, shift, code, upper, vector_codes.unpack(packed, unit))
        want = ((x[:, None] - after[None]) ** 2).sum(-1)
        assert (code == want.argmin(1)).all()
        assert (upper**2 >= want.min(1) - 1e-6).all() and (lower**2 <= want + 1e-6).all()
        book = after


def test_vector_codes_edges(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress(none)[0].count() == 0
    few = spark.createDataFrame([(None, [0.5, 0.25], None, "x", "y"), (1, [0.5, 0.25], 1, "x", "y"), (1, [0.5, 0.25], 1, "x", "y"), (0, [0.1], 1, "x", "y")], VECTORS).where("vec_id is null or vec_id = 1")
    codes, books = vector_codes.compress(few, 2, 64, 2)
    assert [(r.vec_id, r.code, r.error) for r in codes.orderBy("vec_id").collect()] == [(None, "0000", 0), (1, "0000", 0), (1, "0000", 0)]


TEXT = "The town has long kept its bridge, which was built of stone; the river, as they say, never minds. "
PAGE = """<html><body class="has-sidebar"><header><h1>Daily Paper</h1><p>All the news, every day, for all.</p></header>
<div id="mainMenu"><a href="/">Home</a> <a href="/x">Others</a></div>
<div class="content"><h1>A bridge</h1><p>{0}</p><p>Short.</p><h2>Then</h2><p>{0}<b>Bold</b> and <i>slanted</i>&amp;more&nbsp;text<br>here</p>
<ul><li>{0}<li>{0}</ul><div class="ad-box"><p>{0}</p></div><table><tr><td>{0}<td>{0}</table></div>
<aside><p>{0}</p></aside><section id="comments"><h3>Comments</h3><p>{0}</p><form><p>{0}</p></form></section>
<div class="cookieNotice">{0}</div><div>Top of page</div><script>if (a < b) document.write("<p>{0}</p>")</script><footer><p>{0}</p></footer>"""


def test_page_text():
    line = TEXT.strip()
    got, _ = content(PAGE.format(TEXT), Ratios())
    assert got.split("\n") == ["A bridge", line, "Short.", "Then", f"{line} Bold and slanted&more text here", line, line, line, line]


@pytest.mark.parametrize(
    "source, want",
    [
        (None, ""),
        ("", ""),
        ("just text &lt;3", "just text <3"),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ("<p>one<p>two<div>three</div>four", "one\ntwo\nthree\nfour"),
        ("<p>open <a href='x>y'>tag</a> <b unclosed", "open tag"),
        ('<p title="never closed>one</p><p>two</p>', "one\ntwo"),
        ("<script>var a = '<p>x</p>';", ""),
        ("<p>x</p><!-- <p>y</p> --><p>z</p><!-- open", "x\nz"),
        ("</div></p><p>kept</p></span>", "kept"),
        ("<p>&#65;&#x42;&notanentity; &amp;amp;</p>", "AB¬anentity; &amp;"),
        ("<nav>a</nav><footer>b</footer>", ""),
        ("<article><header><h1>Title of it</h1></header><p>Body of it.</p></article>", "Title of it\nBody of it."),
        (f"<div>{'A long line, of a site. ' * 9}</div><main><p>{'Its story, told. ' * 40}</p></main>", ("Its story, told. " * 40).strip()),
        ("<article><p>It is told.</p></article><article class='comment'><p>It is not.</p></article>", "It is told."),
        ("<p>hidden <span class='ad'>advert</span>tail</p>", "hidden\ntail"),
    ],
)
def test_page_text_cases(source, want):
    assert content(source, Ratios())[0] == want


def test_page_text_of_low_ratio_goes():
    body = "".join(f"<p>{TEXT * 3}</p>" for _ in range(8))
    got, left = content(f"<body><div class='x1'>Print</div><div class='x2'><a href='#'>More of this</a></div><div class='story'><h2>On it</h2>{body}</div><div class='x3'>Up</div></body>", Ratios())
    assert got.split("\n") == ["On it", *[(TEXT * 3).strip()] * 8] and left == 3


def test_page_text_is_linear():
    for source in ("<b>" * 60_000 + "x", "<div>" * 60_000 + "x" + "</div>" * 60_000, '<a "' * 60_000, "<" * 200_000, "<p>x" * 60_000, "<li><p>" * 40_000, "<script" * 60_000):
        content(source, Ratios())


def test_page_text_rows(spark):
    rows = [(1, "u", PAGE.format(TEXT), "x"), (1, "u", PAGE.format(TEXT), "x"), (None, None, None, "x"), (2, "v", "", "x"), (3, "w", f"<p>{TEXT * 20_000}", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(page_text.extract(pages).collect(), key=str)
    assert len(got) == 5 and {r.page_id: r.n_chars for r in got}[3] == len((TEXT * 20_000).strip())
    assert page_text.extract(pages.limit(0)).count() == 0
    paths = {r.path: r for r in page_text.tag_paths(pages.where("page_id = 1").limit(1)).collect()}
    assert paths["html/body/div.content/p"].blocks == 3 and paths["html/body/div.content/h2"].kept and not paths["html/body/div"].kept


def brute_draw(docs, target, r):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    def buckets(text):
        w = split(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % r.buckets for n in range(1, r.longest + 1) for i in range(len(w) - n + 1)]

    s, t = np.zeros(r.buckets), np.zeros(r.buckets)
    for _, text in docs:
        np.add.at(s, buckets(text), 1)
    for text in target:
        np.add.at(t, buckets(text), 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + r.buckets) / ((a + 1) * (t.sum() + r.buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in docs:
        own = buckets(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{r.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(split(text))))
    able = sorted((x for x in out if x[4] >= r.least_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    return sorted((x[:4] for x in out), key=str), [x[0] for x in able[: r.percent * len(able) // 100]]


@pytest.mark.parametrize("longest", [1, 3])
def test_importance_is_brute_force(spark, longest, monkeypatch):
    r = importance.Resampling(buckets=101, longest=longest, percent=40, least_words=5)
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"W{x}é" for x in rng.integers(0, 40, rng.integers(0, 30)))) for i in range(200)] + [(None, "a b c d e f"), (500, None), (501, ""), (7, "x y z x y z")] + [(3, "one of many rows of one id")] * 60
    target = ["w1é w2é w3é, W1é", None, "w1é"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("clash")).repartition(6)
    monkeypatch.setattr(importance, "PIECE", 16)  # words of a text come in many pieces
    list_of = lambda: importance.resample(frame, spark.createDataFrame([(x,) for x in target], "text string"), r).collect()
    got = list_of()
    want, drawn = brute_draw(docs, target, r)
    assert sorted(((x.doc_id, x.n_features, x.weight, x.score) for x in got), key=str) == want
    ranked = sorted((x.rank, x.doc_id) for x in got if x.rank is not None)
    assert [k for k, _ in ranked] == list(range(1, len(drawn) + 1)) and [i for _, i in ranked] == drawn


def test_draw_of_hot_scores(spark):
    """One score and one id hold most rows: segments are cut by id, then by place."""
    rows = [(i if i % 3 else 7, 100 if i % 4 else i % 9) for i in range(600)] + [(None, 100)] * 30
    frame = spark.createDataFrame(rows, "doc_id long, score long").repartition(5)
    for count in (0, 1, 250, 600, 1000):
        got = importance.draw(frame, F.lit(True), count, 0, segment=20).collect()
        want = sorted(rows, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:count]
        assert [(x.doc_id, x.score) for x in sorted((x for x in got if x.rank is not None), key=lambda x: x.rank)] == want
        assert len(got) == len(rows)


def test_importance_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none.select("text")).count() == 0
    some = spark.createDataFrame([(1, "w " * 30), (2, None)], "doc_id long, text string")
    assert {x.doc_id: x.rank for x in importance.resample(some, none.select("text"), importance.Resampling(percent=100)).collect()} == {1: 1, 2: None}


def test_tournament():
    runs = [[(1, 0), (4, 1)], [], [(2, 2)], [(1, 3), (1, 4), (9, 5)], [(0, 6)]]
    tree, got = importance.Tournament(runs), []
    while (x := tree.pop()) is not None:
        got.append(x)
    assert got == sorted(x for r in runs for x in r)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(0, 3000), st.integers(0, 400), st.integers(0, 400))
def test_parities_never_exceed_the_difference(seed, common, one, other):
    codes = np.unique(np.random.default_rng(seed).integers(0, 2**63, common + one + other).astype(np.uint64) * np.uint64(2))
    a, b = codes[: common + one], np.concatenate([codes[:common], codes[common + one :]])
    differ = sum(int(x).bit_count() for x in (parities(a) ^ parities(b)).view(np.uint64))
    assert differ <= len(np.setxor1d(a, b))


def test_quality_score_is_all_pairs_of_features(spark):
    """Words and structure of each text, one weight a feature and one product a pair, by plain loops."""
    from collections import Counter

    from waygraph.llm import quality_fm

    rng = np.random.default_rng(8)
    texts = ["A plain line of Plain words, a few.", "x", "", None, "# $ % & | < >\nA line\nA line\n" * 3, "Ünïcode wörter ohne Ende 日本語"]
    machine = quality_fm.fit(texts * 4, [len(t or "") for t in texts] * 4, [1, 0, 0, 1, 0, 1] * 4)
    machine.vectors += rng.normal(0, 0.3, machine.vectors.shape)
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.score for r in quality_fm.score(docs, machine).collect()}
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        counts = Counter(zlib.crc32(w.lower()) % quality_fm.BUCKETS for w in words)
        norm = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values())) or 1.0
        features = [(b, math.log1p(n) / norm) for b, n in counts.items()] + [(int(b), 0.5) for b in quality_fm.structure((text or "").encode(), words, len(text or ""))]
        raw = machine.bias + sum(float(machine.weights[b]) * x for b, x in features)
        for a, (p, x) in enumerate(features):
            for q, y in features[a + 1 :]:
                raw += float(machine.vectors[p].astype(float) @ machine.vectors[q].astype(float)) * x * y
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, raw)))), abs=1e-4)


def test_toxic_score_is_all_label_sequences(spark):
    """Marginals of short texts over all sequences of labels, pooled and weighed by hand."""
    from itertools import product

    from waygraph.llm import toxicity

    rng = np.random.default_rng(9)
    chain = toxicity.ToxicChain(rng.normal(0, 1.0, toxicity.BUCKETS).astype(np.float32), rng.normal(0, 1.0, (2, 2)), -1.0, np.array([-1.0, 0.7, 2.0, -0.5]))
    texts = ["one two three four", "a", "", None, "Some of these words are odd ones", "tab\tand\nline  breaks"]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chain).collect()}
    for i, text in enumerate(texts):
        words = (text or "").split()
        odds = [float(chain.weights[np.array(toxicity.features(w))].sum()) for w in words]
        total, toxic = 0.0, np.zeros(len(words))
        for labels in product((0, 1), repeat=len(words)):
            energy = (chain.start if words and labels[0] else 0.0) + sum(o for o, y in zip(odds, labels, strict=True) if y)
            energy += sum(chain.moves[a][b] for a, b in zip(labels, labels[1:], strict=False))
            total += math.exp(energy)
            toxic += math.exp(energy) * np.array(labels)
        m = toxic / total
        pools = (math.log1p(m.sum()), m.max(), m.mean()) if words else (0.0, 0.0, 0.0)
        z = chain.head[0] + sum(w * p for w, p in zip(chain.head[1:], pools, strict=True))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)
        assert len(got[i].spans) == (int((m >= 0.5).sum()) if words else 0)
