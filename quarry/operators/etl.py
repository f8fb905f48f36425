"""Document ETL: split, merge, embed, align originals, upsert. Chunks are rows (doc_id, chunk_index, text, ...)."""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.functions.text import content_type, doc_id, image_urls_in, normalized_formula, normalized_table

# Sizes and separators of the splitters, limits of the merge and of stored texts.
CHUNK, OVERLAP, PARENT, PARENT_OVERLAP = 512, 64, 2048, 128
SEPARATORS = ("\n\n", "\n", "。", "；", "，", " ")
SHORT, MERGED_MAX, STORED_MAX, EMBED_MAX, MIN_TEXT = 200, 800, 65000, 6000, 10
DIM = 64
WORDS = re.compile(r"\w+")
#: Texts that are embedded at once, and words whose slots a task keeps.
EMBED_ROWS, WORDS_KNOWN = 256, 200_000


def split_text(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that fits, each starting with up to `overlap`
    characters of the one before."""
    sep = next((s for s in separators if s in text), "")
    finer = separators[separators.index(sep) + 1 :] if sep else ()
    parts = text.split(sep) if sep else [text[i : i + size] for i in range(0, len(text), size)]
    units: list[str] = []
    for p in parts:
        units += [p] if len(p) <= size else split_text(p, size, 0, finer)
    out: list[str] = []
    held: deque[str] = deque()
    length = -len(sep)  # of the held units, joined
    for u in units:
        more = len(sep) + len(u)
        if held and length + more > size:
            out.append(sep.join(held))
            while held and (length > overlap or length + more > size):
                length -= len(sep) + len(held.popleft())
        held.append(u)
        length += more
    if held:
        out.append(sep.join(held))
    return [x for x in (o.strip() for o in out) if x]


def chunked(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """docs (doc_id, text) as (doc_id, chunk_index, text). Texts of fewer than MIN_TEXT characters are left out."""

    def pieces(columns: list[list], known: dict[str, int]) -> Iterator[list[tuple[int, str]]]:
        for t in columns[0]:
            yield list(enumerate(split_text(t, size, overlap, separators)))

    rows = docs.where(F.length(F.trim("text")) >= MIN_TEXT)
    return _pieces(rows.select("doc_id", "text"), pieces, "int")


def parent_child(docs: DataFrame) -> DataFrame:
    """Parents of paragraphs, children inside them: (doc_id, parent_index, chunk_index, text, parent_text)."""
    parents = chunked(docs, PARENT, PARENT_OVERLAP, ("\n\n", "\n")).select("doc_id", F.col("chunk_index").alias("parent_index"), F.col("text").alias("parent_text"))

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(split_text)

    children = parents.select("doc_id", "parent_index", "parent_text", F.posexplode(pieces("parent_text")).alias("pos", "text"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("parent_index", "pos")) - 1
    return children.select("doc_id", "parent_index", nth.alias("chunk_index"), "text", "parent_text")


def embedded_texts(texts: Iterable[str | None], dim: int, known: dict[str, int]) -> np.ndarray:
    """The vectors of hashed_embedding, a row for each text. known: slots of words seen before, bounded here."""
    slots: list[int] = []
    ends: list[int] = []
    for t in texts:
        for w in WORDS.findall((t or "").lower()):
            slot = known.get(w)
            if slot is None:
                if len(known) >= WORDS_KNOWN:
                    known.clear()
                slot = known[w] = zlib.crc32(w.encode()) % dim
            slots.append(slot)
        ends.append(len(slots))
    n = np.diff(ends, prepend=0)
    at = np.repeat(np.arange(len(n)), n) * dim + np.array(slots, np.int64)
    v = np.bincount(at, minlength=len(n) * dim).reshape(len(n), dim).astype(np.float32)
    return v / np.maximum(np.sqrt((v * v).sum(axis=1)), np.float32(1e-12))[:, None]


def whole_texts(dim: int = DIM) -> Callable[[list], np.ndarray]:
    """hashed_embedding of whole texts, for what embeds where it works on vectors; a task keeps its words' slots."""
    known: dict[str, int] = {}
    return lambda texts: embedded_texts(texts, dim, known)


def hashed_embedding(text: Column, dim: int = DIM, most: int | None = EMBED_MAX) -> Column:
    """The default embedder: normalised counts of token hashes. Texts are cut to `most` characters, as remote embedders
    cut chunks; None takes them whole."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for batch in texts:
            out: list[np.ndarray] = []
            for i in range(0, len(batch), EMBED_ROWS):
                out += list(embedded_texts(batch.iloc[i : i + EMBED_ROWS], dim, known))
            yield pd.Series(out, index=batch.index, dtype=object)

    return embed(text if most is None else F.left(text, F.lit(most)))


def semantic_chunks(docs: DataFrame, percentile: float = 0.3) -> DataFrame:
    """Sentences in a row until the distance to the next is above the given percentile (0 to 100) of a document's.

    A document's sentences are an array of its row, so nothing is shuffled. The first sentence has no distance.
    """

    def pieces(columns: list[list], known: dict[str, int]) -> Iterator[list[tuple[int, str]]]:
        places, sentences = ([x or [] for x in c] for c in columns)
        for doc in zip(places, sentences, _distances(sentences, known), strict=True):
            yield _grouped(*doc, percentile / 100)

    split = F.transform(F.split("text", r"(?<=[.!?。！？])\s+"), lambda s, i: F.struct(i.alias("pos"), s.alias("s")))
    rows = docs.select("doc_id", F.filter(split, lambda x: F.trim(x["s"]) != "").alias("x"))
    return _pieces(rows.select("doc_id", F.col("x.pos").alias("pos"), F.col("x.s").alias("s")), pieces, "bigint")


def _pieces(rows: DataFrame, cut: Callable[[list[list], dict[str, int]], Iterable[list[tuple[int, str]]]], index: str) -> DataFrame:
    """(doc_id, chunk_index, text): what cut makes of the other columns of rows (doc_id, ...), EMBED_ROWS documents at a
    time, so that a task does not hold the pieces of a whole Arrow batch."""
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(f"chunk_index {index}, text string")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for whole in batches:
            for i in range(0, len(whole), EMBED_ROWS):
                batch = whole.slice(i, EMBED_ROWS)
                made = list(cut([c.to_pylist() for c in batch.columns[1:]], known))
                at = np.repeat(np.arange(len(batch)), [len(m) for m in made])
                flat = [x for m in made for x in m]
                columns = [pa.array([x[j] for x in flat], arrow.field(j + 1).type) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)).cast(arrow.field(0).type), *columns], schema=arrow)

    return rows.mapInArrow(run, schema)


def _grouped(places: list[int], sentences: list[str], d: np.ndarray, share: float) -> list[tuple[int, str]]:
    """A document's sentences as chunks: a sentence begins one if its distance is above the percentile, taken between
    two distances as F.percentile does, and it is not at place 0."""
    inner = sorted(float(x) for x, at in zip(d, places, strict=True) if at > 0)
    limit = np.inf
    if inner:
        place = (len(inner) - 1) * share
        low, high = int(np.floor(place)), int(np.ceil(place))
        limit = inner[low] if inner[low] == inner[high] else (high - place) * inner[low] + (place - low) * inner[high]
    nth, held, out = 0, [], []
    for at, s, far in zip(places, sentences, d, strict=True):
        if at > 0 and far > limit:
            if held:
                out.append((nth, " ".join(held)))
            nth, held = nth + 1, []
        held.append(s)
    return [*out, (nth, " ".join(held))] if held else out


def _distances(docs: list, known: dict[str, int]) -> list[np.ndarray]:
    """For each document's sentences 1 - cosine of a sentence's vector and the one before, 0 for the first and where a
    vector is zero. Summed place by place in double precision, as retrieval.cosine does."""
    sizes = [len(s) for s in docs]
    every = [s for doc in docs for s in doc]
    d = np.zeros(len(every))
    last = np.zeros((1, DIM))
    for i in range(0, len(every), 8 * EMBED_ROWS):
        v = np.concatenate((last, embedded_texts((s[:EMBED_MAX] for s in every[i : i + 8 * EMBED_ROWS]), DIM, known).astype(np.float64))).T.copy()
        norm, dot = np.zeros(v.shape[1]), np.zeros(v.shape[1] - 1)
        for x in v:
            norm += x * x
            dot += x[1:] * x[:-1]
        both = np.sqrt(norm[1:]) * np.sqrt(norm[:-1])
        d[i : i + len(both)] = np.where(both > 0, 1 - dot / np.where(both > 0, both, 1), 0)
        last = v[:, -1:].T
    ends = np.cumsum(sizes)
    d[(ends - sizes)[np.array(sizes, np.int64) > 0].astype(np.int64)] = 0
    return np.split(d, ends[:-1].astype(np.int64))


def merge_short(chunks: DataFrame, short: int = SHORT, most: int = MERGED_MAX) -> DataFrame:
    """Folds each document's chunks from the left: neighbours merge if one is short, both fit into `most` and their
    parents are the same (or one has none). Merged texts are joined by a blank line and renumbered.

    chunks: doc_id, chunk_index, parent_index (may be null), text. Chunks pass sorted by document, and a task holds a
    batch and the chunk that may still grow, whatever a document's length.
    """
    rows = chunks.select("doc_id", "chunk_index", F.col("parent_index").cast("int").alias("parent_index"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, nth, parent, text, held = None, 0, None, "", False
        for batch in _then_none(batches):
            done: list[tuple] = []
            columns = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "parent_index", "text")), strict=True) if batch is not None else ()
            for d, p, t in columns:
                if held and d == doc and (parent is None or p is None or parent == p) and len(text) + len(t) <= most and (len(text) < short or len(t) < short):
                    text += "\n\n" + t
                    continue
                if held:
                    done.append((doc, nth, parent, text))
                nth = nth + 1 if held and d == doc else 0
                doc, parent, text, held = d, p, t, True
            if batch is None and held:
                done.append((doc, nth, parent, text))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    result = f"doc_id {dict(rows.dtypes)['doc_id']}, chunk_index int, parent_index int, text string"
    schema = to_arrow_schema(T.StructType.fromDDL(result))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "chunk_index").mapInArrow(run, result)


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def chunk_records(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of the chunk collection: ids, stored texts, page (of the block the chunk comes from, else 0), images, vector."""
    rows = chunks.join(docs.select("doc_id", "doc_name", "pages"), "doc_id", "left")
    page = F.coalesce(F.get("pages", F.col("chunk_index")), F.lit(0))
    text = F.left("text", F.lit(STORED_MAX))
    return rows.select(
        F.concat_ws("_", "doc_id", "chunk_index").alias("id"), "doc_id", "doc_name", page.cast("long").alias("page_number"), F.col("chunk_index").cast("long").alias("chunk_index"),
        text.alias("text"), (F.left("parent_text", F.lit(STORED_MAX)) if "parent_text" in rows.columns else F.lit("")).alias("parent_text"), F.to_json(image_urls_in(F.col("text"))).alias("image_urls"), hashed_embedding(F.col("text")).alias("embedding"),
    )


def upserted_documents(index: DataFrame, records: DataFrame) -> DataFrame:
    """The index with all chunks of the incoming documents replaced: running it again changes nothing."""
    return index.join(records.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(records, allowMissingColumns=True)


def without_documents(index: DataFrame, gone: DataFrame) -> DataFrame:
    return index.join(gone.select("doc_id"), "doc_id", "left_anti")


def aligned_originals(docs: DataFrame, kind: str) -> DataFrame:
    """docs (doc_id, markdown, blocks) with the references of blocks put after the tables or formulas they show.

    blocks: array of (page_idx, y, body, ref), taken in order of page and height. Tables match if the normalised body
    is contained, formulas if it is equal; places only move forward. A table block without a body continues the last
    one that matched. What matches nothing goes to an appendix.
    """
    table = kind == "table"
    pattern = r"(?is)<table.*?</table>" if table else r"(?s)\$\$.+?\$\$"
    norm = normalized_table if table else normalized_formula
    title = "Table originals" if table else "Formula originals"
    d = docs.select("doc_id", "markdown", F.array_sort("blocks").alias("blocks"), F.regexp_extract_all("markdown", F.lit(pattern), F.lit(0)).alias("found"), F.split("markdown", pattern).alias("between"))
    d = d.withColumn("norms", F.transform("found", norm))
    state = "struct<next:int,last:int,places:array<int>>"
    start = F.struct(F.lit(0).alias("next"), F.lit(-1).alias("last"), F.array().cast("array<int>").alias("places")).cast(state)

    def put(s: Column, b: Column) -> Column:
        body = norm(F.coalesce(b["body"], F.lit("")))
        hit = F.col("norms")
        n = F.size(hit)
        ahead = F.when(s["next"] < n, F.sequence(s["next"], n - 1)).otherwise(F.array().cast("array<int>"))
        same = (lambda i: F.get(hit, i).contains(body)) if table else (lambda i: (F.get(hit, i) == body) | (body == ""))
        at = F.coalesce(F.array_min(F.filter(ahead, same)), F.lit(-1))
        step = lambda nxt, last, place: F.struct(nxt.cast("int").alias("next"), last.cast("int").alias("last"), F.concat(s["places"], F.array(place.cast("int"))).alias("places"))
        matched = F.when(at >= 0, step(at + 1, at, at)).otherwise(step(n, F.lit(-1), F.lit(-1)))
        return F.when(F.coalesce(b["body"], F.lit("")) == "", step(s["next"], s["last"], s["last"])).otherwise(matched) if table else matched

    d = d.withColumn("places", F.aggregate("blocks", start, put)["places"])
    refs = lambda i: F.array_join(F.transform(F.filter(F.zip_with("blocks", "places", lambda b, p: F.struct(b["ref"].alias("ref"), p.alias("p"))), lambda x: x["p"] == i), lambda x: F.concat(F.lit("\n\n"), x["ref"], F.lit("\n"))), "")
    body = F.array_join(F.transform("between", lambda x, i: F.concat(x, F.when(i < F.size("found"), F.concat(F.get("found", i), refs(i))).otherwise(F.lit("")))), "")
    left = F.transform(F.filter(F.zip_with("blocks", "places", lambda b, p: F.struct(b["ref"].alias("ref"), p.alias("p"))), lambda x: x["p"] == -1), lambda x: x["ref"])
    appendix = F.when(F.size(left) > 0, F.concat(F.lit(f"\n\n## {title}\n"), F.array_join(left, "\n\n"))).otherwise(F.lit(""))
    return d.select("doc_id", F.concat(body, appendix).alias("markdown"))


#: Splitters by name. Each takes docs (doc_id, text) and gives doc_id, chunk_index, text and maybe more.
CHUNKERS: dict[str, Callable[[DataFrame], DataFrame]] = {"fixed": chunked, "parent_child": parent_child, "semantic": semantic_chunks}


def chunker(strategy: str | None) -> Callable[[DataFrame], DataFrame]:
    """The splitter of a strategy; fixed sizes for an unknown one."""
    return CHUNKERS.get(strategy or "fixed", chunked)


def rewritten_images(docs: DataFrame, base_url: str, title: str = "Document images") -> DataFrame:
    """docs (doc_id, markdown, images) with references to images as URLs below base_url.

    images: array of (name, summary). References `![](images/name)` and `![](name)` get the summary as their text;
    images without a reference are appended under a heading.
    """
    url = lambda x: F.concat(F.lit(base_url.rstrip("/") + "/images/"), F.col("doc_id").cast("string"), F.lit("/"), x["name"])
    summary = lambda x: F.coalesce(x["summary"], F.lit(""))
    refs = lambda x: (F.concat(F.lit("images/"), x["name"]), x["name"])

    def put(text: Column, x: Column) -> Column:
        for ref in refs(x):
            text = F.replace(text, F.concat(F.lit("![]("), ref, F.lit(")")), F.concat(F.lit("!["), summary(x), F.lit("]("), ref, F.lit(")")))
            text = F.replace(text, F.concat(F.lit("]("), ref, F.lit(")")), F.concat(F.lit("]("), url(x), F.lit(")")))
        return text

    images = F.coalesce("images", F.array().cast(docs.schema["images"].dataType))
    known = lambda x: F.col("markdown").contains(F.concat(F.lit("]("), refs(x)[0], F.lit(")"))) | F.col("markdown").contains(F.concat(F.lit("]("), refs(x)[1], F.lit(")")))
    rest = F.transform(F.filter(images, lambda x: ~known(x)), lambda x: F.concat(F.lit("!["), summary(x), F.lit("]("), url(x), F.lit(")")))
    appendix = F.when(F.size(rest) > 0, F.concat(F.lit(f"\n\n## {title}\n"), F.array_join(rest, "\n\n"))).otherwise(F.lit(""))
    return docs.select("doc_id", F.concat(F.aggregate(images, F.col("markdown"), put), appendix).alias("markdown"))


_FILE = "struct<md_content:string,md:string,blocks:array<struct<page_number:int>>,content_list:string>"


def decoded_responses(responses: DataFrame) -> DataFrame:
    """Parse responses (doc_id, raw JSON) as (doc_id, markdown, pages, content_list), whatever their form.

    `results` by file name: the first file with text; `results` as a list: its first entry, with the pages of its
    blocks; else `md` or `md_content` of the response; else the response itself. Results without text give "".
    """
    results = F.get_json_object("raw", "$.results")
    files = F.map_values(F.from_json(results, f"map<string,{_FILE}>"))
    listed = F.get(F.from_json(results, f"array<{_FILE}>"), F.lit(0))
    text = lambda x, first, second: F.coalesce(F.nullif(x[first], F.lit("")), x[second], F.lit(""))
    of_file = F.get(F.filter(files, lambda x: text(x, "md_content", "md") != ""), F.lit(0))
    flat = F.coalesce(F.get_json_object("raw", "$.md"), F.get_json_object("raw", "$.md_content"), F.col("raw"))
    keyed, as_list = F.coalesce(results.startswith("{"), F.lit(False)), F.coalesce(results.startswith("[") & (results != "[]"), F.lit(False))
    markdown = F.when(keyed, text(of_file, "md_content", "md")).when(as_list, text(listed, "md", "md_content")).otherwise(flat)
    pages = F.when(as_list, F.transform(listed["blocks"], lambda b: F.coalesce(b["page_number"], F.lit(0))))
    return responses.select("doc_id", markdown.alias("markdown"), F.coalesce(pages, F.array().cast("array<int>")).alias("pages"), F.when(keyed, of_file["content_list"]).alias("content_list"))


def joined_pages(parts: DataFrame) -> DataFrame:
    """(doc_id, text, pages) of a file that a reader gave in parts (doc_id, part, text, page_label): texts joined by a
    blank line, labels as numbers, 0 where they are none."""
    page = F.coalesce(F.col("page_label").try_cast("int"), F.lit(0))
    listed = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", F.coalesce("text", F.lit("")).alias("text"), page.alias("page")))).alias("p"))
    return listed.select("doc_id", F.array_join("p.text", "\n\n").alias("text"), F.col("p.page").alias("pages"))


def ingest_records(uploads: DataFrame) -> DataFrame:
    """Document records of uploads (doc_name, ...): id from the name, type from its extension, queued."""
    return uploads.withColumns({"doc_id": doc_id(F.col("doc_name")), "content_type": content_type(F.col("doc_name")), "status": F.lit("queued")})


def registered(documents: DataFrame, uploads: DataFrame) -> DataFrame:
    """Document records with those of uploads in place of older ones of the same name."""
    fresh = ingest_records(uploads)
    return documents.join(fresh.select("doc_id"), "doc_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def soft_deleted(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """Document records (doc_id, status, ...) with the status `deleted` for those of gone (doc_id); their chunks go for
    good, by without_documents."""
    told = gone.select("doc_id").distinct().withColumn("_gone", F.lit("deleted"))
    return documents.join(told, "doc_id", "left").withColumn("status", F.coalesce("_gone", "status")).select(*documents.columns)


def with_stage(jobs: DataFrame, stage: str, percent: int) -> DataFrame:
    return jobs.withColumns({"stage": F.lit(stage), "progress": F.lit(percent)})


def parsed_blocks(content: DataFrame) -> DataFrame:
    """Content lists (doc_id, raw JSON) as rows (doc_id, kind, page_idx, y, body): tables and equations. Bad JSON: none."""
    schema = "array<struct<type:string,page_idx:int,bbox:array<double>,table_body:string,text:string>>"
    rows = content.select("doc_id", F.explode(F.from_json("raw", schema)).alias("b")).where(F.col("b.type").isin("table", "equation"))
    body = F.when(F.col("b.type") == "table", F.col("b.table_body")).otherwise(F.col("b.text"))
    return rows.select("doc_id", F.col("b.type").alias("kind"), F.coalesce("b.page_idx", F.lit(0)).alias("page_idx"), F.coalesce(F.get("b.bbox", F.lit(1)), F.lit(0.0)).alias("y"), body.alias("body"))


def parse_files(files: DataFrame, primary=None, fallback=None) -> DataFrame:
    """binaryFile rows as (path, text): the primary parser, or the fallback if it raises or gives 10 characters or fewer."""
    as_text = lambda data: data.decode("utf-8", "replace")
    first, second = primary or as_text, fallback or as_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for data in pdf["content"]:
                try:
                    text = first(bytes(data))
                except Exception:  # noqa: BLE001  any failure of a parser sends the file to the other one
                    text = ""
                texts.append(text if len("".join(text.split())) > 10 else second(bytes(data)))
            yield pd.DataFrame({"path": pdf["path"], "text": texts})

    return files.select("path", "content").mapInPandas(run, "path string, text string")
