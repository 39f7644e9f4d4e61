import pytest

from corpusloom import config
from corpusloom.functions.urls import Rules
from corpusloom.operators.extract import Options
from corpusloom.streaming import live


def test_precedence(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("# top\ncrawler:\n  max_pages: 7\n  max_depth: 2\n  allowed_domains:\n    - a.com\n    - 'b.com'\ncontent:\n  languages: [de, fr]\n  deduplication:\n    enabled: false\n")
    c = config.load(str(f), {"crawler.max_depth": 4}, {"CRAWLER_CRAWLER_MAX_PAGES": "9", "CRAWLER_CRAWLER_MAX_DEPTH": "3"})
    assert (c.crawler.max_pages, c.crawler.max_depth, c.crawler.allowed_domains, c.content.languages, c.content.deduplication.enabled) == (9, 4, ["a.com", "b.com"], ["de", "fr"], False)
    assert config.load(env={}).crawler.max_pages == 10_000


@pytest.mark.parametrize(("flags", "word"), [({"crawler.max_pages": 0}, "max_pages"), ({"content.languages": "xx"}, "language"), ({"crawler.include_patterns": "["}, "pattern"), ({"storage.type": "redis"}, "storage.type"), ({"content.quality_threshold": 2}, "quality")])
def test_problems_are_named(flags, word):
    with pytest.raises(ValueError, match=word):
        config.load(flags=flags, env={})


def test_secrets_are_hidden():
    c = config.Config()
    c.redis.password, c.storage.connection_string = "hunter2", "postgres://u:hunter2@h/db"
    assert "hunter2" not in str(c) and "postgres://u:***@h/db" in str(c)


def test_overlays():
    c = config.Config()
    c.content.min_text_length, c.content.quality_threshold, c.content.remove_boilerplate = 0, 0.0, False
    o = config.extractor_options(c)
    assert (o.min_text_length, o.quality_threshold, o.remove_boilerplate) == (Options().min_text_length, Options().quality_threshold, False)
    c.crawler.blocked_domains = ["x.com"]
    assert config.url_rules(c).block == (*Rules().block, "x.com")


def test_stream_deduplicates_with_state(spark, tmp_path):
    prose = "The people of the town were glad that it had rained, and so they went out to see what was left of the old mill. It was not much. " * 3
    rows = [("http://h.com/a?utm_source=x", prose), ("http://h.com/a", prose), ("http://h.com/b", prose), ("http://h.com/c", "other " + prose), ("http://h.com/d.pdf", prose)]
    df = spark.createDataFrame([(u, "text/plain", t.encode()) for u, t in rows], "url string, content_type string, body binary").selectExpr("*", "timestamp'2024-01-01 00:00:00' as fetched_at")
    src = str(tmp_path / "in")
    df.repartition(2).write.parquet(src)
    stream = live.records(live.admitted(live.pages(spark, src), Rules()).drop("normalized"), Options(quality_threshold=0.1), watermark=None)
    progress = live.Progress()
    spark.streams.addListener(progress)
    q = live.write(stream.select("url", "content.clean_text"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    spark.streams.removeListener(progress)
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert len(got) == 2 and len({r.clean_text for r in got}) == 2
