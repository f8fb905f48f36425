"""Site-relative line deduplication.

A line is boilerplate on a host when the share of the host's pages that hold it exceeds a ratio. Counts are per
(host, line) and combine on the map side, so a host with a third of all pages or a line on every page shuffles one
small row per task; where such keys meet their totals or their lines, they are salted. Digests of lines move, not
lines; page texts are shuffled once, to meet the places of the lines that they lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest, written

#: A line on more than this share of a host's pages goes.
MAX_RATIO = 0.1
#: ... if it is on at least so many of them: a line on one page repeats nothing.
MIN_PAGES = 2
#: Parts that the lines of a host, and the pages with a line, are dealt into where they meet.
SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user, port or path; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(host, F.lit(""))


def html_lines(html: Column) -> Column:
    """Text of a page, a line for each block: scripts, styles, comments and the head go, block tags end lines."""
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"(?i)</?(?:p|div|li|ul|ol|nav|article|section|header|footer|aside|main|h[1-6]|br|hr|tr|td|th|table|pre|blockquote|body|html)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    return F.btrim(F.regexp_replace(text, r"[ \t\r]*\n\s*", "\n"), F.lit(" \t\r\n"))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _salt(of: Column) -> Column:
    return F.pmod(of, F.lit(SALTS)).cast("int")


def _every_salt() -> Column:
    return F.explode(F.array(*map(F.lit, range(SALTS))))


def boilerplate_lines(
    pages: DataFrame, id_col: str, host: Column, text: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, by_text: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(lines, boilerplate): every (host, t1, t2, id, at, h1, h2) line that occurs, with the digest of its page's text
    and its place in it; and the (host, h1, h2, n, pages) to drop.

    Lines are compared without the white space around them. Empty lines never count. A page counts once for a line and
    for its host, however many rows it has; pages are told apart by id, or, by_text, by their texts.
    """
    t1, t2 = digest(F.col("text"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), text.alias("text")).where("host is not null")
    rows = rows.select("*", t1.alias("t1"), t2.alias("t2"))
    page = ["t1", "t2"] if by_text else ["id"]
    totals = rows.select("host", *page).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    keyed = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.alias("at"), (line_key(x) == "").alias("blank"), *digest(line_key(x))))
    lines = rows.where("text is not null").select("host", "t1", "t2", "id", F.inline(keyed)).where("not blank").drop("blank")
    lines = written(lines, "lines")  # read for the counts, and again for the pages that hold a line to drop
    once = lines.select("host", "h1", "h2", *page).distinct()
    counts = once.groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    salted = counts.withColumn("salt", _salt(F.col("h1"))).join(totals.withColumn("salt", _every_salt()), ["host", "salt"])
    drop = salted.where(F.col("n") > F.lit(max_ratio) * F.col("pages"))
    return lines, drop.select("host", "h1", "h2", "n", "pages")


def line_dedup(
    pages: DataFrame,
    id_col: str = "page_id",
    host: Column | None = None,
    text_col: str = "html",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    by_text: bool = False,
) -> DataFrame:
    """pages with boilerplate lines taken out of text_col, and `lines_dropped` (int), how many went.

    host: the site of a page, by default that of its `url`. Lines are split at LF; the kept ones are joined by LF.
    A line occurring several times in a page counts once for the ratio, and every occurrence goes. Rows of one id and
    host are one page for the ratio; with by_text, pages of one text are, so that copies do not make their own lines
    boilerplate. Rows with a null id are one page together. Pages whose host or text is null keep their text. A line
    that only one page of a host has stays. Empty input gives an empty result; other columns pass through, but for one
    named lines_dropped, which gives way to the new one.
    """
    host = host_of(F.col("url")) if host is None else host
    lines, drop = boilerplate_lines(pages, id_col, host, F.col(text_col), max_ratio, min_pages, by_text)
    drop = written(drop.select("host", "h1", "h2"), "boilerplate")
    hit = lines.withColumn("salt", _salt(F.col("t1"))).join(drop.withColumn("salt", _every_salt()), ["host", "h1", "h2", "salt"])
    # Rows that repeat a page are one here, so a page gathers its own places only.
    places = hit.select("host", "t1", "t2", "id", "at").distinct().groupBy("host", "t1", "t2", "id").agg(F.collect_list("at").alias("gone"))
    t1, t2 = digest(F.col(text_col))
    named = pages.select(F.struct(*[F.col(c) for c in pages.columns]).alias("page"), F.col(id_col).alias("id"), host.alias("host"), t1.alias("t1"), t2.alias("t2"))
    on = (named["host"] == places["host"]) & (named["t1"] == places["t1"]) & (named["t2"] == places["t2"]) & named["id"].eqNullSafe(places["id"])
    joined = named.join(places, on, "left").select("page", "gone")
    text, cut = F.col("page").getField(text_col), F.col("gone").isNotNull()
    split = joined.withColumn("lines", F.when(cut, lines_of(text)))  # once a page, not once a line
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    columns = [F.when(cut, kept).otherwise(text).alias(c) if c == text_col else F.col("page").getField(c).alias(c) for c in pages.columns if c != "lines_dropped"]
    return split.select(*columns, F.when(cut, F.size("gone")).otherwise(F.lit(0)).alias("lines_dropped"))
