"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment confirms.

Templates are put in length classes of L = 6, 8, 12, 16, 24, 32, ... words, where a template has more than two thirds
of L. A text's windows of a class hold L + S words and start S = L / 4 words apart, so a template of up to L words lies
whole in some window. All distinct shingles of that window then resemble the template's with a Jaccard similarity of
1/2 or more, or of 0.36 if only 80 % of the template are there, and its MinHash signature in BANDS bands of one row
agrees with the template's in some band but for a chance of (1 - 0.36)^32 = 6e-7. Windows of the templates retrieved
so are compared shingle by shingle, no others.

A band of a window can only agree with a template's if the window holds the shingle that has the template's least
value there. Windows without any such shingle, nearly all, are not signed at all: the bands could not retrieve
anything for them. DataFrame functions only. Past that point the work is in rows (document, window), so a very long
document is spread out, and the last aggregate combines on the map side. The templates are the only thing broadcast:
their size is that of the list passed in, which MAX_TEMPLATE_SHINGLES bounds.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .license_templates import NOTICES, TEMPLATES  # noqa: F401

SHINGLE = 5
#: Bands of one row each.
BANDS = 32
#: Share of a template's shingles that a window has to hold.
MIN_CONTAINMENT = 0.8
MAX_TEMPLATE_SHINGLES = 100_000
#: Length classes in words.
CLASSES = tuple(sorted(x << k for k in range(20) for x in (6, 8)))
#: Class and number of a window in one integer.
_WINDOW_BITS = 40


def words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9; null text: none."""
    return F.array_remove(F.split(F.coalesce(F.lower(text), F.lit("")), "[^a-z0-9]+"), "")


def shingles(ws: Column, k: int = SHINGLE) -> Column:
    """64-bit hashes of k words in a row, by place; of a shorter text all words as one; of none an empty array."""
    n = F.size(ws)
    runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)]))
    return F.when(n >= k, runs).when(n > 0, F.array(F.xxhash64(F.array_join(ws, " ")))).otherwise(F.array().cast("array<bigint>"))


def stride(span: int) -> int:
    return max(1, span // 4)


def _part(start: Column, n: Column | int) -> Column:
    """Up to n of the words `ws` from a place on; slice() would go through all words of the text each time."""
    return F.transform(F.sequence(start, F.least(start + n, F.size("ws")) - 1), lambda i: F.get("ws", i))


def template_shingles(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, pos, shingle, run, m, n): the shingles of each template by place with their words, how many distinct
    ones and how many words it has."""
    listed = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("t")) for k, v in templates.items()])
    # Written, as Spark would split a text of literals again for each of its words.
    t = written(spark.range(1).select(F.inline(listed)).select("license", words(F.col("t")).alias("ws")), "license-words")
    t = t.select("license", "ws", shingles(F.col("ws")).alias("s"))
    t = written(t.select("*", F.size(F.array_distinct("s")).alias("m"), F.size("ws").alias("n")), "license-shingles")
    at = F.transform("s", lambda x, i: F.struct(i.alias("pos"), x.alias("shingle"), _part(i, SHINGLE).alias("run")))
    return t.select("license", F.inline(at), "m", "n")


def band(shingle: Column, j: int) -> Column:
    return F.xxhash64(F.lit(j), shingle)


def _signature(s: Column, bands: int) -> Column:
    """(band, value) of an array of shingles."""
    of = lambda j: F.array_min(F.transform(s, lambda x: band(x, j)))
    return F.array(*[F.struct(F.lit(j).alias("band"), of(j).alias("value")) for j in range(bands)])


def retrieved(docs: DataFrame, id_col: str, text_col: str, ts: DataFrame, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """(windows, candidates): (doc_id, part, span, w, start, s) of the windows that are signed, and the (doc_id, part,
    span, w, license) that the bands retrieve. part tells rows of one id apart. ts: template_shingles, of a bounded
    number of rows."""
    span = F.array_min(F.filter(F.array(*map(F.lit, CLASSES)), lambda c: c >= F.col("n")))
    sets = written(ts.groupBy("license", "n").agg(F.collect_set("shingle").alias("s")), "license-sets")
    sets = written(sets.select("license", span.cast("long").alias("span"), F.inline(_signature(F.col("s"), bands))), "license-keys")
    own = [r.asDict() for r in sets.collect()]  # BANDS rows for each template
    # The shingles that have a template's least value in some band, with their words and the classes they count for.
    valued = ts.select("license", "shingle", "run", F.posexplode(F.array(*[band(F.col("shingle"), j) for j in range(bands)])).alias("band", "value"))
    signed = valued.join(F.broadcast(sets), ["license", "band", "value"]).groupBy("shingle").agg(F.first("run").alias("run"), F.collect_set("span").alias("spans")).collect()
    spans_of = {r["shingle"]: r["spans"] for r in signed}
    spans = sorted({r["span"] for r in own})
    # A run of words can only be such a shingle if each word stands at its place in one: sets of words tell that
    # without hashing every run.
    runs = [r["run"] for r in signed if len(r["run"]) == SHINGLE] or [[""] * SHINGLE]
    heads = [sorted({w[j] for w in runs}) for j in range(SHINGLE)]
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("part"), words(F.col(text_col)).alias("ws"))
    n = F.size("ws")
    likely = F.filter(F.sequence(F.lit(0), n - SHINGLE), lambda i: reduce(and_, [F.get("ws", i + j).isin(heads[j]) for j in range(SHINGLE)]))
    run_at = F.transform(likely, lambda i: F.struct(i.cast("long").alias("pos"), F.xxhash64(*[F.get("ws", i + j) for j in range(SHINGLE)]).alias("shingle")))
    short = F.transform(shingles(F.col("ws")), lambda x, i: F.struct(i.cast("long").alias("pos"), x.alias("shingle")))
    hits = F.filter(F.when(n >= SHINGLE, run_at).otherwise(short), lambda h: h["shingle"].isin(sorted(spans_of)))
    classes = F.create_map(*[x for k, v in sorted(spans_of.items()) for x in (F.lit(k), F.array(*[F.lit(spans.index(s)) for s in sorted(v)]))])
    lengths, strides = F.array(*map(F.lit, spans)), F.array(*[F.lit(stride(s)) for s in spans])

    def around(h: Column) -> Column:
        def of_class(c: Column) -> Column:
            size, step = F.get(lengths, c), F.get(strides, c)
            low = F.greatest(F.ceil((h["pos"] - (size + step - SHINGLE - 1)) / step), F.lit(0)).cast("long")
            return F.transform(F.sequence(low, F.floor(h["pos"] / step).cast("long")), lambda w: F.shiftleft(c.cast("long"), _WINDOW_BITS) + w)

        return F.flatten(F.transform(F.element_at(classes, h["shingle"]), of_class))

    def cut(k: Column) -> Column:
        c, w = F.shiftright(k, _WINDOW_BITS).cast("int"), k.bitwiseAND(F.lit((1 << _WINDOW_BITS) - 1))
        start, size, step = w * F.get(strides, c), F.get(lengths, c), F.get(strides, c)
        return F.struct(size.cast("long").alias("span"), w.alias("w"), start.alias("start"), _part(start.cast("int"), size + step - 1).alias("ws"))

    # Windows are cut out before rows are made of them: a row carries its window, not the text.
    numbers = F.array_distinct(F.flatten(F.transform(hits, around)))
    found = texts.select("doc_id", "part", F.inline(F.transform(numbers, cut)))
    windows = written(found.select("doc_id", "part", "span", "w", "start", shingles(F.col("ws")).alias("s")), "license-windows")

    keys = windows.select("doc_id", "part", "span", "w", F.inline(_signature(F.col("s"), bands)))
    candidates = keys.join(F.broadcast(sets), ["span", "band", "value"]).select("doc_id", "part", "span", "w", "license").distinct()
    return windows, written(candidates, "license-candidates")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, min_containment: float = MIN_CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """(doc_id, license, containment, word_pos): each template that a document holds.

    containment: largest share of the template's distinct shingles in one window; word_pos: the first such place,
    in words from 0. Words are runs of a-z and 0-9 of the lower-cased text, shingles SHINGLE of them. Rows of the
    same id are looked at one by one and the best counts. Null ids are left out; null and empty texts hold nothing;
    empty input or no templates give an empty result; other columns are not used.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    schema = "doc_id long, license string, containment double, word_pos long"
    ts = written(template_shingles(spark, templates), "license-templates") if templates else None
    n = ts.count() if ts is not None else 0
    if n > MAX_TEMPLATE_SHINGLES:
        raise ValueError(f"the templates have {n} shingles; at most {MAX_TEMPLATE_SHINGLES} can be broadcast")
    if not n:
        return spark.createDataFrame([], schema)
    windows, candidates = retrieved(docs, id_col, text_col, ts, bands)
    asked = windows.join(candidates, ["doc_id", "part", "span", "w"]).select("doc_id", "part", "span", "w", "start", "license", F.posexplode("s").alias("at", "shingle"))
    held = asked.join(F.broadcast(ts.select("license", "shingle", "m").distinct()), ["license", "shingle"]).groupBy("doc_id", "part", "span", "w", "license", "m")
    held = held.agg(F.count_distinct("shingle").alias("n"), F.min(F.col("start") + F.col("at")).alias("pos")).where(F.col("n") >= F.lit(min_containment) * F.col("m"))
    top = held.groupBy("doc_id", "license").agg(F.min(F.struct((-F.col("n") / F.col("m")).alias("c"), "pos")).alias("b"))
    return top.select("doc_id", "license", (-F.col("b.c")).alias("containment"), F.col("b.pos").alias("word_pos"))


def oracle(templates: dict[str, str] | None = None, min_containment: float = MIN_CONTAINMENT) -> str:
    """The same rows in DuckDB SQL, by brute force over all windows, without retrieval."""
    listed = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in kv)) for kv in (templates or TEMPLATES).items())
    run = " || ' ' || ".join(f"ws[i + {j}]" for j in range(SHINGLE))

    def cut(source: str, key: str, text: str) -> str:
        return f"(SELECT {key}, ws, unnest(CASE WHEN len(ws) >= {SHINGLE} THEN range(1, len(ws) - {SHINGLE - 2}) WHEN len(ws) > 0 THEN [1] ELSE [] END) AS i FROM (SELECT {key}, list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM {source}))"

    shingle = f"CASE WHEN len(ws) >= {SHINGLE} THEN {run} ELSE array_to_string(ws, ' ') END"
    return f"""
WITH t(license, body) AS (VALUES {listed}),
ts0 AS (SELECT DISTINCT license, len(ws) AS n_words, {shingle} AS shingle FROM {cut('t', 'license', 'body')}),
ts AS (SELECT license, shingle, count(*) OVER (PARTITION BY license) AS m, list_min(list_filter({list(CLASSES)}, lambda c: c >= n_words)) AS span FROM ts0),
s AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, {shingle} AS shingle FROM {cut('documents', 'doc_id', 'text')} WHERE doc_id IS NOT NULL),
h AS (SELECT s.doc_id, s.pos, ts.*, greatest(1, span // 4) AS step FROM s JOIN ts USING (shingle)),
v AS (SELECT *, unnest(range(CAST(greatest(ceil((pos - (span + step - {SHINGLE + 1})) / step), 0) AS BIGINT), pos // step + 1)) AS w FROM h),
c AS (SELECT doc_id, license, w, count(DISTINCT shingle) / any_value(m) AS containment, min(pos) AS pos FROM v GROUP BY ALL
  HAVING count(DISTINCT shingle) >= {min_containment} * any_value(m))
SELECT doc_id, license, max(containment) AS containment, arg_min(pos, (-containment, pos)) AS word_pos FROM c GROUP BY ALL"""
