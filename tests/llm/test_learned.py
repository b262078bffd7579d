"""Learned operators: held-out accuracy, laws of the parts, odd rows."""

from __future__ import annotations

import collections
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from fenland.llm import html_extract, lm_score, quality

SF = "/root/testdata/sf0.01"


def test_isotonic_is_the_nearest_rising_line():
    rng = np.random.default_rng(1)
    for _ in range(30):
        w, y = rng.integers(1, 5, 12).astype(float), rng.random(12)
        got = quality.isotonic(w, w * y)
        assert (np.diff(got) >= -1e-12).all()
        # the minimax form of isotonic regression
        mean = lambda a, b: (w[a:b] * y[a:b]).sum() / w[a:b].sum()  # noqa: E731, B023
        want = [max(min(mean(a, b) for b in range(k + 1, 13)) for a in range(k + 1)) for k in range(12)]
        assert np.allclose(got, want)


def test_normal_equations_are_the_whole_tables(spark):
    """Partition sums give the weights of one least-squares fit over all rows."""
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.random(len(quality.NAMES))]) for k in range(400)]
    features = spark.createDataFrame(rows, "doc_id long, statistics array<double>").repartition(5)
    labels = spark.createDataFrame([(k, int(x[0] > 0.5)) for k, x in rows], "doc_id long, label int")
    model = quality.fit(features, labels)
    x = model.mapped(np.array([s for _, s in rows]))
    y = np.array([float(s[0] > 0.5) for _, s in rows])
    penalty = np.full(x.shape[1], quality.RIDGE * len(rows))
    penalty[-1] = 1e-9 * len(rows)
    assert np.allclose(model.weights, np.linalg.solve(x.T @ x + np.diag(penalty), x.T @ y), atol=1e-6)


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.98
    assert got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.7)).all()


def test_quality_of_odd_rows(spark, odd_docs, odd_rows, odd_folder):
    labels = spark.read.parquet(f"{odd_folder}/labels.parquet")
    got = quality.score_quality(odd_docs, labels).collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    assert sorted((str(r.doc_id), r.held_out) for r in got) == sorted((str(i), fold(i)) for i, *_ in odd_rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(odd_docs.limit(0), labels).count() == 0
    none = quality.score_quality(odd_docs, labels.limit(0)).collect()
    assert len(none) == len(odd_rows) and {r.score for r in none} == {0.5}
    assert quality.keep_good(odd_docs, labels).columns == odd_docs.columns


def test_scores_never_see_labels_of_the_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(string(doc_id)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a, b = (quality.score_quality(docs, x).orderBy("doc_id").toPandas() for x in (labels, other))
    assert np.allclose(a.score, b.score)


def pages(n: int) -> list[str]:
    return [r[0] for r in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet' ORDER BY page_id LIMIT {n}").fetchall()]


@pytest.fixture(scope="module")
def extractor():
    return html_extract.train(html_extract.labelled_pages(pages(120), 150), rounds=120)


def test_viterbi_is_the_best_sequence():
    rng = random.Random(6)
    for _ in range(50):
        model = html_extract.Model(np.array([rng.uniform(-2, 2) for _ in range(8)]), np.array([[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)]))
        rows = [[k] for k in range(rng.randint(1, 8))]

        def score(labels):
            own = sum(model.weights[k] for k, label in enumerate(labels) if label)  # noqa: B023
            return own + sum(model.steps[a, b] for a, b in zip(labels, labels[1:], strict=False))  # noqa: B023

        best = max(np.ndindex(*[2] * len(rows)), key=score)
        assert model.labels(rows) == list(best)


def test_blocks_are_decoded_and_joined():
    page = "<html><head><title>t</title><style>p{}</style></head><body><p>a &amp;\n  <b>b</b><br>c<script>var x='<p>no</p>'</script> d<p>é&eacute;&#x41;<li>one<li>two</body>"
    assert [b.text for b in html_extract.leaf_blocks(page)] == ["a & b c d", "ééA", "one", "two"]
    for odd in ("", "<", "<p", "text only", "</p></div>", "<!-- open", "<script>never closed", "<p class='x>a", "<div>" * 3000 + "deep"):
        html_extract.leaf_blocks(odd)


def test_raw_tags_end_where_they_end():
    read = lambda page: [b.text for b in html_extract.leaf_blocks(page)]
    assert read("<article><p>one <svg class='i'/> two</p><p>three</p></article>") == ["one two", "three"]
    assert read("<p>one<svg aria-label='a>b' class=i /><p>two<svg/><p>three") == ["one", "two", "three"]
    assert read("<p>one</p><svg-icon name='x'></svg-icon><title-bar>two</title-bar><p>three</p>") == ["one", "two", "three"]
    assert read('<p>one <svg aria-label="x/>y"><text>no</text></svg>two<script>no</script></p><title>no</title>') == ["one two"]


def test_attribute_values_follow_the_markup_rules():
    read = lambda page: [b.text for b in html_extract.leaf_blocks(page)]
    assert read("<p title=it's>one</p><p>two</p><p>don't</p><p>three</p>") == ["one", "two", "don't", "three"]
    assert read("""<p title="a > b" alt='c > "d'>one</p><p a='x"y' b = "q>r" c=d>two</p>""") == ["one", "two"]
    assert read("<p title='open>one</p><p>two</p>") == ["one", "two"]  # a quote that nothing closes ends with its tag
    assert read("a < b <p>1<2</p> <3 & x< y <b>c</b>") == ["a < b", "1<2", "<3 & x< y c"]
    names = [b.path for b in html_extract.leaf_blocks("<div class=big-menu id='x y' role=\"z\">t</div>")]
    assert names == [(("div", "big menu x y z"),)]


def test_formulas_and_fallback_text_stay_in_their_sentence():
    read = lambda page: [b.text for b in html_extract.leaf_blocks(page)]
    page = "<article><p>see <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here</p><object>fallback text</object><p>play <audio>it <a>there</a></audio><video></video></p></article>"
    assert read(page) == ["see x=1 here", "fallback text", "play it there"]


def test_hostile_pages_take_linear_time():
    import time

    start = time.perf_counter()
    for piece in ("<a ", "<a '", '<a x="', "<", "<!", "</", "<p x='>", '<p "\'>', "<p a=b=", "<svg ", "<!--", "<script>", "<a x='\">"):
        html_extract.leaf_blocks(piece * (1_000_000 // len(piece)))
        html_extract.leaf_blocks(piece * (1_000_000 // len(piece)) + ">")
    assert time.perf_counter() - start < 40


def test_main_text_of_unseen_pages(extractor):
    import re

    unseen = [r[0] for r in duckdb.sql(f"SELECT html FROM '{SF}/pages.parquet' ORDER BY page_id DESC LIMIT 100").fetchall()]
    for page in unseen:
        article = re.search("<article>(.*)</article>", page, re.DOTALL)[1]
        assert html_extract.main_text(page, extractor) == "\n".join(b.text for b in html_extract.leaf_blocks(article))


def test_layouts_that_the_table_does_not_have(extractor):
    text = "A sentence of the article that runs on for a while, as sentences do. And another one, not much shorter than the first."
    page = f"""<body><header class="site-header"><a href="/">Name</a></header><nav><ul><li><a href="/a">a</a></li></ul></nav>
    <div class="cookie-notice">We use cookies. <button>ok</button></div>
    <div class="content"><h1>The title of it</h1><p>{text}</p><div class="ad">Buy now</div><p>{text}</p></div>
    <aside class="sidebar"><h3>Popular</h3><ul><li><a href="/x">Read this too</a></li></ul></aside>
    <form class="search"><label>Search</label><input></form>
    <div id="comments"><h3>2 comments</h3><div class="comment"><p>I read this and liked it a lot.</p></div></div>
    <footer>&copy; 2020 Name</footer></body>"""
    assert html_extract.main_text(page, extractor) == f"The title of it\n{text}\n{text}"


def test_pages_with_nulls(spark, extractor):
    rows = [(1, "u", pages(1)[0], "x"), (None, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, None, "<p>", "x"), (4, "u", "<p>a</p>" * 3000, "x")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), extractor).collect()
    assert [r.page_id for r in got] == [1, None, 2, 2, 3, 4]
    assert [r.text == "" for r in got[1:5]] == [True] * 4
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_force_base(rows):
    learned = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    counts = collections.Counter(w for t in learned for w in lm_score.tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    each = math.log10(total + 0.5 * (distinct + 1))
    return total, [(len(w), sum(counts[x] > 0 for x in w), sum(math.log10(counts[x] + 0.5) - each for x in w)) for w in (lm_score.tokens(t) for _, t in rows)]


def test_tokens_know_ascii_only():
    assert lm_score.tokens("A\x0bB\xa0C\x1cD É\n") == ["a".encode(), "b\xa0c\x1cd".encode(), "É".encode(), b""]


def test_many_texts_are_split_as_one(monkeypatch):
    monkeypatch.setattr(lm_score, "RUN_BYTES", 40)
    texts = ["A\x0bB\xa0C\x1cD É\n", None, "", " \n\t ", "b b  B a", "x" * 90, " lead and trail ", "Ünïcödé 日本語 \x00 İ"]
    seen = [[different[k].as_py() for k in which] for different, which, _ in lm_score._spelled(pa.array(texts))]
    sizes = [n for _, _, counts in lm_score._spelled(pa.array(texts)) for n in counts]
    want = [lm_score.tokens(t) for t in texts]
    assert len(seen) > 2 and sum(seen, []) == sum(want, []) and sizes == [len(w) for w in want]
    assert not [*lm_score._spelled(pa.array([], pa.string()))]


def test_words_of_the_model():
    own, hot = {lm_score.END: 0, b"the": 1, b"of": 2}, {lm_score.END: 3.0, b"the": 2.0, b"seldom": 1.0}
    words = [b"the", b"of", b"", b"seldom", b"x", "é".encode(), b"other", b"seldom"]
    model = lm_score.Words(own, hot)
    bucket, code, known = model.of(pa.array(words, pa.binary()))
    assert bucket.tolist() == [lm_score.bucket_of(w, own) for w in words]
    assert code.tolist() == [xxhash.xxh32_intdigest(w) | 1 for w in words]
    assert np.array_equal(known, [hot.get(w, np.nan) for w in words], equal_nan=True)
    assert model.are_hot(pa.array(words, pa.binary())).tolist() == [w in hot for w in words]


def test_places_follow_the_texts(monkeypatch):
    """Texts are cut into chunks by tokens, however they are split."""
    texts = [" ".join(["w"] * n) for n in (3, 0, 7, 2, 2, 9, 1)]
    for size in (1, 20, 1000):
        monkeypatch.setattr(lm_score, "RUN_BYTES", size)
        chunks = [*lm_score._placed(pa.array(texts), lm_score.Words({lm_score.END: 0}, {}), 8)]
        assert [c[4].tolist() for c in chunks] == [[4, 1, 8], [3, 3, 10], [2]]
        for _, codes, _, at, sizes in chunks:
            assert len(codes) == sum(sizes) + lm_score.START * len(sizes) and (codes[at] > 0).all() and (np.delete(codes, at) == 0).all()


def test_gradients_of_a_row_are_added_once_however_often_it_occurs():
    rng = np.random.default_rng(5)
    for n in (1, 2, lm_score.FEW, lm_score.FEW + 1, 3000):
        rows = np.minimum(rng.zipf(1.3, n), lm_score.ROWS - 1).astype(np.uint32)
        gaps = rng.integers(-50, 50, (n, lm_score.SUBS)).astype(np.float32)
        sums, used = lm_score._sums(rows, gaps)
        assert len(set(used.tolist())) == len(used) == len(set(rows.tolist()))
        assert all((total == gaps[rows == row].sum(axis=0)).all() for row, total in zip(used, sums, strict=True))


def test_base_score_and_model(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HOT", 200)  # so that most tokens take the join
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    total, want = brute_force_base(rows)
    got = lm_score.score_documents(docs).orderBy("doc_id").toPandas()
    assert set(got.train_tokens) == {total}
    assert got.n_tokens.tolist() == [n for n, _, _ in want] and got.n_known.tolist() == [n for _, n, _ in want]
    assert np.allclose(got.base_score, [s for _, _, s in want])
    held = got[got.held_out]
    assert held.score.sum() / held.n_tokens.sum() > held.base_score.sum() / held.n_tokens.sum() + 0.05


def test_the_model_is_a_distribution(spark):
    """Known tokens and one unknown one per bucket sum to one in any context."""
    rng = np.random.default_rng(3)
    words = [f"w{k}".encode() for k in range(300)]
    counts = {w: int(rng.integers(1, 9)) for w in words}
    own = {lm_score.END: 0, words[0]: 1, words[1]: 2}
    buckets = np.array([lm_score.bucket_of(w, own) for w in words])
    n = np.array([counts[w] for w in words])
    inside = np.bincount(buckets, weights=n, minlength=lm_score.BUCKETS) + 0.5 * (np.bincount(buckets, minlength=lm_score.BUCKETS) + 1)
    weights = lm_score.parts_of(rng.standard_normal(lm_score.ROWS * (lm_score.CLASSES + lm_score.SUBS)).astype(np.float32))
    codes = rng.integers(1, 2**32, 8, dtype=np.uint32)
    rows = [np.repeat(r, lm_score.BUCKETS) for r in lm_score._features(codes, np.array([5]))]
    all_buckets = np.arange(lm_score.BUCKETS)
    classes, subs, _, upper, lower = lm_score._chances(weights, rows, all_buckets)
    chance = upper[all_buckets, classes] * lower[all_buckets, subs]
    total = (chance[buckets] * (n + 0.5) / inside[buckets]).sum() + (chance * 0.5 / inside).sum()
    assert abs(total - 1) < 1e-5


def test_gradient_steps_fit_the_data():
    rng = np.random.default_rng(5)
    codes = rng.choice(np.array([3, 5, 9], np.uint32), 4000)
    at = np.arange(2, 4000)
    buckets = (codes[at - 1] * 7 % lm_score.BUCKETS).astype(np.int64)  # the token before decides
    weights, squares = (lm_score.parts_of(np.zeros(lm_score.ROWS * (lm_score.CLASSES + lm_score.SUBS), np.float32)) for _ in range(2))
    for _ in range(60):
        lm_score._step(weights, squares, lm_score._features(codes, at), buckets)
    classes, subs, _, upper, lower = lm_score._chances(weights, lm_score._features(codes, at), buckets)
    n = np.arange(len(at))
    assert (upper[n, classes] * lower[n, subs]).min() > 0.9


def test_the_token_three_back_counts():
    rng = np.random.default_rng(7)
    codes = rng.choice(np.array([3, 5, 9], np.uint32), 4000)
    at = np.arange(3, 4000)
    buckets = (codes[at - 3] * 7 % lm_score.BUCKETS).astype(np.int64)
    weights, squares = (lm_score.parts_of(np.zeros(lm_score.ROWS * (lm_score.CLASSES + lm_score.SUBS), np.float32)) for _ in range(2))
    for _ in range(60):
        lm_score._step(weights, squares, lm_score._features(codes, at), buckets)
    classes, subs, _, upper, lower = lm_score._chances(weights, lm_score._features(codes, at), buckets)
    n = np.arange(len(at))
    assert (upper[n, classes] * lower[n, subs]).min() > 0.9


def test_scores_of_odd_rows(odd_docs, odd_rows):
    total, want = brute_force_base([(i, t) for i, t, *_ in odd_rows])
    got = lm_score.score_documents(odd_docs).collect()
    key = lambda i, n, k, s: (str(i), n, k, round(s, 6))
    assert sorted(key(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got) == sorted(key(i, *w) for (i, *_), w in zip(odd_rows, want, strict=True))
    assert {r.train_tokens for r in got} == {total}
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert lm_score.score_documents(odd_docs.limit(0)).count() == 0
