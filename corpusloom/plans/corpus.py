"""The output branch: exact duplicates, near duplicates, languages, and records, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup

FIELDS = ("url", "status_code", "title", "language", "quality_score", "word_count", "link_count", "text", "crawled_at", "rendered")


def language_allowed(lang, allowed: tuple[str, ...]):
    """Keeps all without a list, rows without a language, and rows whose primary subtag is listed."""
    mine = sorted({a.strip().lower().replace("_", "-").split("-")[0] for a in allowed if a.strip()})
    return F.lit(True) if not mine else F.coalesce(lang, F.lit("")).isin("", *mine) | T.primary_language(F.coalesce(lang, F.lit(""))).isin(*mine)


def classify(rows: DataFrame, id_col: str, text_col: str, lang_col: str, order_col: str, exact: bool = True, near: bool = True, languages: tuple[str, ...] = (), unique_ids: bool = False) -> DataFrame:
    """Sets ``outcome``: ``duplicate``, ``near_duplicate``, ``wrong_language`` or ``kept``.

    Each stage registers what reaches it before later stages drop it, so a row dropped for its
    language still holds back later copies.  Rows without text skip both duplicate stages.  Rows that
    tie in order and id, as repeated rows do, are told apart by a row number, so one of them stays;
    ``unique_ids`` says that there are none, which saves writing the rows down for it.
    """
    text, first, row, near_dup = (dedup.hidden(x) for x in ("text", "first", "row", "near"))
    has = F.coalesce(F.col(text_col), F.lit("")) != ""
    rows = rows.withColumns({text: F.when(has, F.col(text_col)), row: F.monotonically_increasing_id()})
    if not unique_ids or near:
        rows = dedup.written(rows, "numbered")
    tie = [order_col, id_col] if unique_ids else [order_col, id_col, row]
    if exact:
        rows = dedup.first_wins(rows, dedup.content_hash(F.col(text)), tie, first)
    else:
        rows = rows.withColumn(first, F.lit(True))
    if near:
        rows = dedup.written(rows, "exact")
        prints = rows.where(F.col(first) & F.col(text).isNotNull()).select(F.col(row).alias("id"), dedup.simhash(text).alias("fp"), F.struct(F.col(order_col).alias("a"), F.col(id_col).alias("b"), F.col(row).alias("c")).alias("seq"))
        flags = dedup.greedy_keep(dedup.written(prints, "prints"))
        rows = rows.join(flags.select(F.col("id").alias(row), F.col("near_duplicate").alias(near_dup)), row, "left")
    else:
        rows = rows.withColumn(near_dup, F.lit(False))
    outcome = F.when(~F.col(first), "duplicate").when(F.coalesce(near_dup, F.lit(False)), "near_duplicate").when(~language_allowed(F.col(lang_col), languages), "wrong_language").otherwise("kept")
    return rows.withColumn("outcome", outcome).drop(text, first, row, near_dup)


def records(results: DataFrame) -> DataFrame:
    """Output records of crawl results that have content and no error; empty optional fields are null."""
    c = F.col("content")
    blank = lambda x: F.when(x != "", x)
    return results.where("error is null and content is not null").select(
        "url", "status_code", blank(c["title"]).alias("title"), blank(c["metadata"]["language"]).alias("language"), c["quality_score"].alias("quality_score"), c["metadata"]["word_count"].alias("word_count"),
        F.size("links").alias("link_count"), c["clean_text"].alias("text"), F.date_format(F.to_utc_timestamp("completed_at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("crawled_at"), F.when(F.col("rendered"), True).alias("rendered"),
    )
