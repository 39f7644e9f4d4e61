"""Text columns: white space, truncation, counts, titles, descriptions and keywords.

Lengths named ``bytes`` are UTF-8 bytes, others are code points.  Three kinds of white space occur:
``GAP`` for collapsing, ``SPACE`` (Unicode) for splitting and trimming, and the ASCII space.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

_ODD = re.compile("[^0-9A-Za-z_]")
GAP = "[\\t\\n\\f\\r ]"
SPACE = "[\\t\\n\\x0B\\f\\r \\x{85}\\p{Z}]"
NOT_SPACE = "[^" + SPACE[1:]
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def truncate(c: Column, most: int) -> Column:
    """The first ``most`` code points; 0 or less sets no limit."""
    return F.substring(c, 1, most) if most > 0 else c


def clean(c: Column, normalize: bool = True, most: int = 100_000) -> Column:
    """Collapsed, trimmed and truncated text; null gives the empty string."""
    c = F.coalesce(c, F.lit(""))
    return truncate(strip(F.regexp_replace(c, f"{GAP}{{2,}}|[\\t\\n\\f\\r]", " ")) if normalize else c, most)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda x: x != "")


def count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"{NOT_SPACE}+"))


def count_sentences(c: Column) -> Column:
    """Runs of sentence ends."""
    return F.regexp_count(c, F.lit("[.!?]+"))


def count_paragraphs(c: Column) -> Column:
    """Blocks between blank lines that aren't blank."""
    return F.size(F.filter(F.split(c, "\n\n"), lambda x: strip(x) != ""))


def primary_language(c: Column) -> Column:
    return F.regexp_extract(F.lower(strip(c)), "^([^-_]*)", 1)


def _ellipsis(c: Column, most: int) -> Column:
    return F.concat(strip(F.substring(c, 1, most)), F.lit("..."))


def plain_title(c: Column) -> Column:
    """The first line of 6 to 199 bytes with under a tenth of special characters, else the beginning."""
    odd = lambda x: F.char_length(F.regexp_replace(x, "[A-Za-z0-9 :-]", ""))
    fits = lambda x: (F.octet_length(x) > 5) & (F.octet_length(x) < 200) & (odd(x).cast("double") / F.octet_length(x) < 0.1)
    lines = F.filter(F.transform(F.split(c, "\n"), strip), fits)
    return F.when(F.size(lines) > 0, F.get(lines, 0)).when(F.char_length(c) > 50, _ellipsis(c, 50)).otherwise(strip(c))


def plain_description(c: Column) -> Column:
    """Up to 200 characters, cut after the last sentence end that lies beyond byte 50."""
    head = F.substring(c, 1, 200)
    upto = F.regexp_extract(head, "(?s)^(.*)[.!?]", 1)
    whole = F.regexp_extract(head, "(?s)^(.*[.!?])", 1)
    return F.when(F.char_length(c) <= 200, strip(c)).when((whole != "") & (F.octet_length(upto) > 50), strip(whole)).otherwise(F.concat(strip(head), F.lit("...")))


def xml_description(c: Column) -> Column:
    return F.when(F.char_length(c) > 200, _ellipsis(c, 200)).otherwise(strip(c))


def frequent_words(text: str | None, least: int, top: int) -> list[str]:
    count = Counter(_ODD.sub("", w) for w in (text or "").lower().split())
    found = [(-n, w) for w, n in count.items() if n >= least and len(w) > 4]
    return [w for _, w in sorted(found)[:top]]


def keywords(c: Column, least: Column | int = 3, top: int = 10) -> Column:
    """Words over four characters that occur ``least`` times or more, most frequent first, then by word.

    Counting inside a row has no linear form in built-in functions, so it runs in Arrow batches, a text at a time.
    """

    @F.arrow_udf("array<string>")
    def run(texts, least):
        import pyarrow as pa

        return pa.array([frequent_words(t.as_py(), n.as_py(), top) for t, n in zip(texts, least)], pa.list_(pa.string()))

    return run(c, least if isinstance(least, Column) else F.lit(least))
