import random

import numpy as np
import pytest

from corpusloom.llm import hnsw, html_text


def brute(rows, every, k):
    rows = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in rows:
        if q % every == 0:
            s = sorted((-float(rows[i] @ rows[q] / (np.linalg.norm(rows[i]) * np.linalg.norm(rows[q]))), i) for i in rows if i != q and len(rows[i]) == len(rows[q]))
            out[q] = s[:k]
    return out


@pytest.mark.parametrize("shard", [hnsw.SHARD, 300])
def test_recall_and_exact_scores(spark, shard):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 0.5, 3) for i, v in rows], "vec_id long, embedding array<float>, score double, rank int")
    want = brute(rows, 50, 5)
    by = {}
    for r in hnsw.nearest(df, shard=shard).collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(want)
    hits = 0
    for q, got in by.items():
        got.sort()
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        hits += len({i for _, i, _ in got} & {i for _, i in want[q]})
        for _, i, s in got:
            assert s == pytest.approx(float(x[i].astype(float) @ x[q].astype(float) / np.linalg.norm(x[i].astype(float)) / np.linalg.norm(x[q].astype(float))), abs=1e-12)
    assert hits / (5 * len(by)) >= 0.95


def test_copies_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(0, 40)] + [(50, [0.0, 1.0]), (51, None), (52, [0.0, 0.0]), (53, [nan, 1.0]), (54, [inf, 1.0]), (55, [None, 1.0]), (None, [1.0, 1.0]), (100, [1.0, 2.0, 3.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    by = {}
    for r in hnsw.nearest(df).orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert by == {0: [(i, 1.0) for i in range(1, 6)], 50: [(i, 0.0) for i in range(5)]}  # 100 has no other vector of its length
    assert hnsw.nearest(df.limit(0)).count() == 0
    two = hnsw.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in two] == [(0, 1, 1)]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
        at = sorted(html_text.common(a, b))
        assert len(at) == lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in at)


def test_common_with_repeated_lines():
    import time

    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(1, 60))] for _ in range(2))
        at = sorted(html_text._halved(a, b))
        assert len(at) == lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in at)
    began = time.time()
    assert len(html_text.common([1] * 20_000 + [2], [3] + [1] * 20_000)) == 20_000
    assert len(html_text.common([1, 2] * 4000, [2, 1, 1] * 3000)) > 5000
    assert time.time() - began < 20


def test_doubles_keep_their_precision(spark):
    rows = [(0, [1.0, 1e-9]), (1, [1.0, 2e-9]), (2, [1e300, 1e300]), (3, [1.0, 1.0])]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got][:1] == [(0, 1)] and len(got) == 3


DECLARED = """<html><head><title>T</title><style>x</style></head><body><nav>menu</nav><div class="cookie-notice">We use cookies</div><article class="post"><header>By me</header><h1>Head &amp; more</h1>
<p>One <b>bold</b>&nbsp;word<p>Two</p><div class="share">Share</div><script>no()</script><form><input>Sign up</form><section id="comments"><p>I disagree</p></section></article><aside>Side</aside><footer>&copy;</footer></body></html>"""


def page(own, menu=("Home", "News", "About us")):
    return "<body>" + "".join(f"<div>{m}</div>" for m in menu) + "".join(f"<p>{x}</p>" for x in own) + "<div>All rights</div></body>"


def test_declared_article_and_differencing(spark):
    rows = [
        (1, "http://a.com/x", DECLARED), (2, "http://b.com/news/1", page(["First story", "Its end"])), (3, "http://b.com/news/2", page(["Second story"])), (4, "http://c.com/only", page(["Alone"])),
        (5, None, None), (6, "http://d.com/", ""), (7, "http://b.com/news/2", page(["Second story"])), (8, "x", "plain text &lt;here&gt; \n and  there"), (9, "http://e.com/1", "<p>" * 3000 + "deep"),
    ]
    df = spark.createDataFrame([(i, u, h, "old", 0) for i, u, h in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    assert got[1].text == "Head & more One bold word Two" or got[1].text == "Head & more One bold word Two"
    assert got[2].text == "First story Its end" and got[3].text == got[7].text == "Second story"
    assert got[4].text == "Home News About us Alone All rights"  # no page to compare with
    assert got[5].text == got[6].text == "" and got[5].url is None
    assert got[8].text == "plain text <here> and there" and got[9].text == "deep"
    assert html_text.extract(df.limit(0)).count() == 0


def test_every_page_with_a_differing_page_in_its_host_is_paired(spark):
    rows = [(i, f"http://a.com/p{i:02d}", page(["Copied story"])) for i in range(12)] + [(12, "http://a.com/p12", page(["Other story"]))]
    rows += [(20 + i, f"http://b.com/q{i:02d}", page(["Opening story" if i == 0 else "Repeated story"])) for i in range(9)] + [(40 + i, f"http://h{i}.com/{j}", page([f"Page {j}"])) for i in range(5) for j in (1, 2)]
    rows += [(60 + i, "http://c.com/same", page(["Lonely story"])) for i in range(6)]
    df = spark.createDataFrame([(i, u, h) for i, u, h in rows], "page_id long, url string, html string")
    want = {(u, h): " ".join(x for x in ("Copied story", "Other story", "Opening story", "Repeated story", "Page 1", "Page 2") if x in h) for _, u, h in rows}
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for n in ("1", "3", "17"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = sorted((r.page_id, r.url, r.text) for r in html_text.extract(df).collect())
            lonely = "Home News About us Lonely story All rights"  # no differing page in its host
            assert got == sorted((i, u, want[u, h] or lonely) for i, u, h in rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_broken_tags_and_marks_in_prose():
    text = lambda page: " ".join(html_text.page_lines(page)[1])
    assert text('<article><p title="x>one</p><p>two</p></article>') == "one two"
    assert text("<article><p title='it's>one</p><a href=\"b\">two</a></article>") == "one two"
    assert text('<article><p title="a>b">one</p></article>') == "one"
    assert text('<article><p>A <span class="search-term">word</span> here <i hidden>not</i><span class="ad">Buy</span></p><div class="search-box">go</div></article>') == "A word here"
