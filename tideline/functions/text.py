"""Text statistics, chunks, cleaning, tokens and extracted events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line breaks and blanks as Python's splitlines() and split() see them. Latin
# characters are listed one by one and the rest by category: Java tests such a class several
# times faster than a union of ranges.
BREAKS = r"\n\u000b\u000c\r\u001c\u001d\u001e\u0085\u2028\u2029"
LINE_BREAK = r"\r\n?|[\n\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
WORD = r"[^\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f\u0085\p{Z}]+"

TOKEN = r"[\p{L}\p{N}]+"

# HTML entities replaced by the cleaner, in this order (ampersand last).
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

# A date, then what happens on it, up to the end of the sentence.
DATED_EVENT = r"(\d{4}-\d{2}-\d{2})[:,]?\s+([^.\n]+)"


def line_count(text: str) -> Column:
    """Lines of the text; a break at the end does not open another line."""
    open_end = F.when(F.substring(text, -1, 1).rlike(f"[^{BREAKS}]"), 1).otherwise(0)
    return F.regexp_count(text, F.lit(LINE_BREAK)) + open_end


def word_count(text: str) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def tokens(text: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def chunks(text: str, size: int, overlap: int = 0) -> Column:
    """Pieces of ``size`` characters that share ``overlap`` characters with the next.

    One pass over the text: each match moves on by size - overlap and captures a whole
    piece ahead of it. A last piece that holds nothing new is left out.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1))
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(step))).cast("int")
    return F.slice(pieces, 1, count)


def clean_html(html: str) -> Column:
    """Readable text: no scripts, styles, comments, tags or entities; single blanks."""
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style[^>]*>.*?</style>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def dated_events(text: str, pattern: str = DATED_EVENT) -> Column:
    """``array<struct<date,event>>`` of the dated statements in a text."""
    dates = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    events = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(dates, events, lambda d, e: F.struct(d.alias("date"), F.trim(e).alias("event")))
