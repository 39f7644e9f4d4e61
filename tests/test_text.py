import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import quality as Q
from corpusloom.functions import text as T
from corpusloom.operators import dedup
from corpusloom.operators import extract as X
from corpusloom.plans import corpus


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).head()[0]


def score(spark, text, readable=False, paragraphs=1, titled=False):
    df = dedup.once(spark.createDataFrame([(text,)], "x string"), **Q.counts(F.col("x")))
    return df.select(Q.html_score(F.lit(readable), F.lit(paragraphs), F.lit(titled))).head()[0]


@pytest.mark.parametrize(("text", "most", "want"), [("hello", 3, "hel"), ("日本語テキスト", 3, "日本語"), ("a😀b", 2, "a😀"), ("abc", 0, "abc"), ("abc", -1, "abc"), ("ab", 5, "ab")])
def test_truncation_counts_characters(spark, text, most, want):
    assert one(spark, text, lambda c: T.truncate(c, most)) == want


def test_cleaning_and_counts(spark):
    assert one(spark, " a\t\nb  c ", T.clean) == "a b c"
    assert one(spark, None, T.clean) == ""
    assert one(spark, "One. Two!! Three?! a b", T.count_words) == 5
    assert one(spark, "One. Two!! Three?!", T.count_sentences) == 3
    assert one(spark, "a\n\n \n\nb", T.count_paragraphs) == 2
    assert one(spark, " EN-us", T.primary_language) == "en"


def test_titles_and_descriptions(spark):
    assert one(spark, "Hi\nA proper title line\nmore", T.plain_title) == "A proper title line"
    assert one(spark, "x" * 300, T.plain_title) == "x" * 50 + "..."
    text = "This is the first sentence of a text that goes on for a while. " + "word " * 60
    assert one(spark, text, T.plain_description) == text[:62]
    assert one(spark, "word " * 60, T.xml_description) == ("word " * 40).strip() + "..."
    assert T.frequent_words("apple apple apple pears pears pears plums plums to to to", 3, 10) == ["apple", "pears"]


def test_prose_beats_link_dumps(spark):
    prose = "The people of the town were glad that it had rained, and so they went out to see what was left of the old mill. It was not much. But they had all been there before, and it was theirs."
    dump = "Home Products Pricing Login Register Contact Careers Blog Docs Support Status Twitter Github LinkedIn Sitemap Terms Privacy"
    assert score(spark, prose, True, 3, True) >= 0.6 > 0.3 >= score(spark, dump)
    assert score(spark, "") == 0.0 and score(spark, dump * 20, True, 9, True) == pytest.approx(0.2)


def test_function_words_are_whole_tokens_without_punctuation(spark):
    n = lambda t: one(spark, t, Q.function_words)
    assert n("The cat, (and) \"the\" dog. Don't we?") == 5
    assert n("there's athe thea 'the and-the") == 0
    assert n("the  the\nthe") == 3


def test_fingerprints_follow_the_bytes(spark):
    assert dedup.simhash_of("") == 0 and dedup.simhash_of(None) == 0
    assert dedup.simhash_of("Hello   World") == dedup.simhash_of("hello world")
    assert dedup.simhash_of("hello world") != dedup.simhash_of("hello world ")
    h = 14695981039346656037
    for b in b"ab":
        h = (h ^ b) * 1099511628211 % 2**64
    assert dedup.simhash_of("AB") == h
    votes = [0] * 64
    for g in (b"abc", b"bcd"):
        h = 14695981039346656037
        for b in g:
            h = (h ^ b) * 1099511628211 % 2**64
        for k in range(64):
            votes[k] += 1 if h >> k & 1 else -1
    assert dedup.simhash_of("abcd") == sum(1 << k for k in range(64) if votes[k] > 0)


def plain_greedy(fps):
    kept, out = [], {}
    for i, f in fps:
        out[i] = any((f ^ k).bit_count() <= 3 for k in kept)
        if not out[i]:
            kept.append(f)
    return out


def test_greedy_near_duplicates_equal_the_sequential_scan(spark):
    import random

    rng = random.Random(4)
    fps = []
    for i in range(160):
        f = rng.choice([0, 0xFFFF, 0xABCDEF0123456789 & (2**63 - 1)])
        for _ in range(rng.randrange(8)):
            f ^= 1 << rng.randrange(12)
        fps.append((i, f))
    df = spark.createDataFrame([(i, f, i) for i, f in fps], "id long, fp long, seq long")
    got = {r.id: r.near_duplicate for r in dedup.greedy_keep(df).collect()}
    assert got == plain_greedy(fps)
    assert {r.id: r.near_duplicate for r in dedup.greedy_keep(df, hot_rows=20).collect()} == got
    pairs = {(r.earlier, r.later) for r in dedup.near_pairs(df).collect()}
    assert pairs == {(a, b) for a, x in fps for b, y in fps if a < b and (x ^ y).bit_count() <= 3}


@pytest.mark.parametrize("most", [1000, 1])
def test_first_rows_of_hot_null_and_single_keys(spark, monkeypatch, most):
    monkeypatch.setattr(dedup, "HOT_KEYS", most)
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"k{i % 4}") for i in range(90)] + [(90, "alone")] + [(91 + i, "warm") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, k string")
    seen, want = set(), {}
    for i, k in rows:
        want[i] = k is None or k not in seen
        seen.add(k)
    for hot in (10, dedup.HOT_ROWS):
        got = dedup.first_wins(df, F.col("k"), ["id"], hot_rows=hot)
        assert got.columns == ["id", "k", "is_first"]
        assert {r.id: r.is_first for r in got.collect()} == want


def test_output_order_of_stages(spark):
    rows = [("u1", "same text", "fr", 1), ("u2", "same text", "en", 2), ("u3", "other words", "en-US", 3), ("u4", "", "en", 4), ("u5", "", "en", 5), ("u6", "more of it", None, 6)]
    df = spark.createDataFrame(rows, "url string, t string, lang string, seq long")
    got = {r.url: r.outcome for r in corpus.classify(df, "url", "t", "lang", "seq", near=True, languages=("en",)).collect()}
    assert got == {"u1": "wrong_language", "u2": "duplicate", "u3": "kept", "u4": "kept", "u5": "kept", "u6": "kept"}


@pytest.mark.parametrize(("w", "h", "px", "large"), [("150", "", 150, True), ("99", "99px", 99, False), ("50%", "", None, True), ("auto", "", None, True), ("", "", None, True), (" 10px ", "x", 10, False), ("5", "100", 5, True)])
def test_dimensions(spark, w, h, px, large):
    row = spark.createDataFrame([(w, h)], "w string, h string").select(X.pixels(F.col("w")), X.is_large(F.col("w"), F.col("h"))).head()
    assert tuple(row) == (px, large)


def test_hash_stores(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("http://a", "h1"), ("http://b", "h2")], "url string, hash string")
    dedup.remember(df, path, "content", "hash")
    dedup.remember(df.where("hash = 'h1'").withColumn("url", F.lit("http://later")), path, "content", "hash")
    store = spark.read.parquet(path)
    assert dict(dedup.original_url(store, "content").collect()) == {"h1": "http://later", "h2": "http://b"}
    assert dedup.original_url(store, "simhash").count() == 0
    assert [r.hash for r in dedup.seen_filter(spark.createDataFrame([("h1",), ("h9",)], "hash string"), store, "hash").collect()] == ["h9"]


def test_one_pass_counts_keywords_by_the_row(spark):
    rows = spark.createDataFrame([("alpha alpha alpha gamma gamma", 3), ("alpha alpha alpha gamma gamma", 2), (None, 2)], "t string, n int")
    assert [r[0] for r in rows.select(T.keywords(F.col("t"), F.col("n"))).collect()] == [["alpha"], ["alpha", "gamma"], []]


def test_bodies_hold_printable_latin_1(spark):
    from corpusloom.plans.site_queries import _bare

    every = "".join(map(chr, [*range(0x250), 0x2028, 0x20AC, 0xD7FF, 0xE000, 0xFFFD, 0x1F600, 0x10FFFF]))
    rows = spark.createDataFrame([(every,), (None,)], "text string")
    assert [r[0] for r in rows.select(_bare()).collect()] == [re.sub("[^ -~\u00a1-\u00ff\n]", "", every), ""]


def test_extraction_sends_texts_to_one_keyword_count(spark):
    got = X.extract(spark.createDataFrame([("http://a/", "text/plain", b"x")], "url string, content_type string, body binary"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [run(") == 1 and plan.split("ArrowEvalPython [")[1].split("]")[0].count("run(") == 1


def test_near_pairs_are_dealt_out_by_their_number(spark):
    rows = spark.range(2 * dedup.PAIR_ROWS).select("id", F.xxhash64("id").alias("fp"), F.col("id").alias("seq"))
    plan = dedup.near_pairs(rows)._jdf.queryExecution().optimizedPlan().toString()
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 3)
    assert re.search(rf"RepartitionByExpression \[band#\d+L?\], {tasks}\b", plan)
