"""Scalar functions over texts, JSON and results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: an image reference with a URL in Markdown.
IMAGE_URL = r"!\[[^\]]*\]\((https?://[^\s)]+)\)"
#: What a URL in running text is made of, up to white space, a bracket, a quote or an angle.
RUNNING_URL = r"https?://[^\s<>()\[\]\"']+"

# Content types by file extension.
CONTENT_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it: lambdas would compute it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def doc_id(name: Column) -> Column:
    return F.substring(F.md5(name), 1, 16)


def to_number(x: Column) -> Column:
    """A number for what reads as one, else 0."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def first_json_object(text: Column) -> Column:
    """The first flat JSON object in a text, or an empty string."""
    return F.regexp_extract(text, r"\{[^{}]*\}", 0)


def score_in(text: Column) -> Column:
    """(score, reason) from a judge's reply; (0.0, "") if none can be read."""
    parsed = F.from_json(F.nullif(first_json_object(text), F.lit("")), "score double, reason string")
    return F.struct(F.coalesce(parsed["score"], F.lit(0.0)).alias("score"), F.coalesce(parsed["reason"], F.lit("")).alias("reason"))


def image_urls_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IMAGE_URL), F.lit(1)))


def image_context(markdown: Column, ref: Column, window: int = 200) -> Column:
    """Up to `window` characters before an image reference `![](ref)`, from the last blank line or other image on;
    empty where there is no such reference."""
    at = F.call_function("locate", F.concat(F.lit("![]("), ref, F.lit(")")), markdown)
    before = F.substring(markdown, F.greatest(at - window, F.lit(1)), F.least(at - 1, F.lit(window)))
    parts = F.split(before, r"\n\n|!\[\]\([^)]*\)")
    return F.when(at > 0, F.btrim(F.element_at(parts, -1), F.lit(" \t\r\n"))).otherwise(F.lit(""))


def sanitized_images(answer: Column, valid: Column) -> Column:
    """Image references that are not in `valid`, or whose URL has an ellipsis, become their alt text; a bare URL whose host
    is no host but an ellipsis goes, with the space before it."""
    known = F.coalesce(valid, F.array().cast("array<string>"))
    found = F.regexp_extract_all(answer, F.lit(IMAGE_URL), F.lit(0))
    url = lambda x: F.regexp_extract(x, r"\(([^)]*)\)$", 1)
    bad = F.array_distinct(F.filter(found, lambda x: url(x).contains("..") | ~F.array_contains(known, url(x))))
    cut = F.aggregate(bad, answer, lambda text, x: F.replace(text, x, F.trim(F.regexp_extract(x, r"^!\[([^\]]*)\]", 1))))
    return let(cut, _without_hostless_urls)


def _without_hostless_urls(text: Column) -> Column:
    host = lambda url: F.substring_index(F.substring_index(url, "://", -1), "/", 1)
    gone = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(RUNNING_URL), F.lit(0))), lambda u: host(u).startswith(".."))
    # Longer ones first, as one may begin with another.
    longest = F.reverse(F.transform(F.array_sort(F.transform(gone, lambda u: F.struct(F.length(u), u.alias("u")))), lambda s: s["u"]))
    return F.aggregate(longest, text, lambda t, u: F.replace(F.replace(t, F.concat(F.lit(" "), u), F.lit("")), u, F.lit("")))


def normalized_table(html: Column) -> Column:
    """A table's text without tags and white space."""
    return F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", ""), r"\s+", "")


def normalized_formula(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s$]+", "")


def content_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(known, ext), F.lit("image/jpeg"))


def decoded_image(data: Column) -> Column:
    """The bytes of base64 text, with or without a data URI before it."""
    return F.unbase64(F.regexp_replace(data, r"^data:[^,]*,", ""))


def date_context(ts: Column) -> dict[str, Column]:
    return {"day": F.date_format(ts, "yyyy-MM-dd"), "weekday": F.date_format(ts, "EEEE"), "quarter": F.concat(F.lit("Q"), F.quarter(ts))}


def score_text(score: Column) -> Column:
    return F.format_number(score, 2)


def ellipsis(text: Column, n: int = 100) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def trace_id() -> Column:
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)


def client_key(user: Column, host: Column) -> Column:
    return F.coalesce(F.nullif(user, F.lit("")), F.nullif(host, F.lit("")), F.lit("anon"))


def sampled(id_: Column, share: float) -> Column:
    """A fixed share of ids."""
    return F.pmod(F.xxhash64(id_), F.lit(1000)) < int(share * 1000)


def round_half_even(x: Column, places: int) -> Column:
    """x rounded as the exact value of the double says, halves to the even digit; `round` goes by its decimal text.

    The product with 10^places is taken with its rounding error (by splitting both factors), which decides where the
    product itself looks like a half.
    """
    scale = 10.0**places
    high = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    scale_high = scale * 134217729.0 - (scale * 134217729.0 - scale)
    scale_low = scale - scale_high

    def rounded(v: Column) -> Column:
        p, h = v * scale, high(v)
        low = v - h
        error = ((h * scale_high - p) + h * scale_low + low * scale_high) + low * scale_low
        half = F.abs(p - F.rint(p)) == 0.5
        whole = F.when(half & (error > 0), F.ceil(p)).when(half & (error < 0), F.floor(p)).otherwise(F.rint(p))
        return whole.cast("double") / scale

    return let(x.cast("double"), rounded)


def column_of(name: Column) -> Column:
    """The column of `table.column`: what follows the last dot. Names have one dot; of one with more, what is between
    the first and the last belongs to neither table nor column."""
    return F.substring_index(name, ".", -1)


def table_of(name: Column) -> Column:
    """The table of `table.column`: what comes before the first dot."""
    return F.split_part(name, F.lit("."), F.lit(1))
