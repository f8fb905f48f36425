"""From raw documents to token ids: language ID, line dedup, near-duplicate removal, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns the documents for the next one, which reads them back from
Parquet. All but the last return the columns of documents. Ids may be null or repeat: stages tell rows apart by a
digest of all their columns, so that no text is lost for another one's id, and equal rows by their number.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, language_id, line_dedup, mixing, ngram_jaccard
from quarry.llm.common import WORD, clear, digest, intermediates, numbered, table, written
from quarry.session import ship


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows in one struct `doc`, whatever their columns are called, but for the text, with the columns that stages work on
    and what tells rows apart: `row` and `row2`, together a 128-bit digest of all columns."""
    row, row2 = digest(*[x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"), row.alias("row"), row2.alias("row2"), "doc_id", "text", "source")


def _again(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs from the struct and the text, with new values for some."""
    return rows.select(*[new.get(c, F.col("text") if c == "text" else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays ambiguous; fills in a missing lang."""
    ship(spark)
    model = language_id.learn(docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(_keyed(docs), model, "text", keep=["doc", "text"])
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.col("ambiguous"))
    return _again(kept, docs, lang=F.coalesce("doc.lang", "lang_pred"))


#: A line goes if more than one in twenty distinct texts of its source hold it. Sources hold many sites and kinds of
#: text, so what is boilerplate there is on a smaller share than on one host.
LINE_RATIO = 0.05


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that a large share of a source's distinct texts hold; n_chars follows the text.

    Null is a source like any other; copies of a text count once, so they do not make their own lines boilerplate.
    """
    pages = _keyed(docs).withColumn("source", F.coalesce(F.concat(F.lit("of "), F.col("source")), F.lit("none")))
    cut = line_dedup.line_dedup(pages, id_col="row", host=F.col("source"), text_col="text", max_ratio=LINE_RATIO, by_text=True)
    n = F.when(F.col("lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("doc.n_chars"))
    return _again(cut, docs, n_chars=n)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest id (an id before none). Documents
    without words are in no group and stay."""
    ship(spark)
    wordless = ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    # Equal rows are near-duplicates of each other; the first of them is found before texts are shuffled.
    keyed = _keyed(docs.where(~wordless))
    groups = ngram_jaccard.ngram_jaccard_join(keyed, id_col="row", keep=["doc_id", "row2"])
    order = F.struct(F.col("kept.doc_id").isNull(), F.col("kept.doc_id"), F.col("doc_id"), F.col("kept.row2"))
    first = groups.groupBy("class").agg(F.min_by(F.struct(F.col("doc_id").alias("row"), F.col("kept.row2").alias("row2")), order).alias("f")).select("f.*")
    kept = keyed.select("doc", "row", "row2", "text").dropDuplicates(["row", "row2"]).join(first, ["row", "row2"], "left_semi")
    return _again(kept, docs).unionByName(docs.where(wordless))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources' words come near their targets."""
    ship(spark)
    keyed = _keyed(docs).withColumn("key", F.concat_ws(" ", "row", "row2"))
    taken = mixing.mix(keyed, id_col="key").groupBy(F.col("doc_id").alias("key"))
    taken = written(taken.agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")), "copies")
    due = keyed.select("doc", "key", "text").join(taken, "key")
    # Equal rows share their copies, the first ones taking what is over.
    again = numbered(due.where("rows > 1"), ["key"])
    due = due.where("rows = 1").withColumn("nth", F.lit(0).cast("long")).unionByName(again)
    own = F.floor(F.col("copies") / F.col("rows")) + (F.col("nth") < F.col("copies") % F.col("rows")).cast("long")
    return _again(due.select("doc", "text", F.explode(F.array_repeat(F.lit(1), own.cast("int")))), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, tokens, and whether the tokens decode to the text."""
    ship(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe_encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Classifiers, seeded rounding and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with intermediates() as made:
            staged = stage(spark, docs, sf_dir)
        docs = written(staged, name)
        clear(spark, made)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
