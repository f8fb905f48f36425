"""Rows that few tables have: very long texts, repeated rows, ties, labels that must not be learned."""

import random
import weakref

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, common, language_id, mixing, ngram_jaccard
from quarry.llm.components import connected_components
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_held_out_labels_are_never_learned(spark):
    """Labels of the held-out quarter, however wrong, change no prediction; those of the others do."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in language_id.identify_languages(docs).collect()}
    wrong = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("wrong")).otherwise(F.col("lang")))
    assert {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in language_id.identify_languages(wrong).collect()} == before
    other = docs.withColumn("lang", F.when(~language_id.held_out(F.col("doc_id")), F.lit("wrong")).otherwise(F.col("lang")))
    assert {r.lang_pred for r in language_id.identify_languages(other).collect()} <= {"wrong", "und"}


def test_languages_that_tie_and_rows_that_repeat(spark):
    rows = [(i, "the same words in both", lang, "s", 0) for i, lang in enumerate(["aa", "bb"] * 40)]
    model = language_id.learn(spark.createDataFrame(rows, DOCS))
    asked = spark.createDataFrame([(1000, "the same words in both", None, "s", 0)] * 3, DOCS)
    out = [(r.doc_id, r.lang_pred, r.score, r.ambiguous) for r in language_id.predict(asked, model).collect()]
    assert out == [(1000, "aa", 0.5, True)] * 3  # the first in order


def test_mixing_of_a_very_long_text(spark):
    rng = random.Random(1)
    rows = [(0, "w " * 400_000, "en", "a", 0)] + [(i, "w " * rng.randrange(1, 60), "en", "ab"[i % 2], 0) for i in range(1, 400)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    size = {r.doc_id: r["size"] for r in out}
    assert size[0] == 400_000 and all(0 <= r.taken <= 3 * r["size"] for r in out)
    for source in "ab":
        taken, target = sum(r.taken for r in out if r.source == source), next(r.target for r in out if r.source == source)
        assert abs(taken - target) <= max(size[r.doc_id] for r in out if r.source == source)


def test_pipeline_of_very_long_texts(spark):
    import corpus_pipeline as C

    rng = random.Random(2)
    words = ["the", "cat", "and", "dog", "house", "wood", "in", "a", "of", "with"]
    long = "\n".join(" ".join(rng.choice(words) for _ in range(50)) + f" {i}" for i in range(4000))
    rows = [(0, long, "en", "s", len(long)), (1, long + " more", "en", "s", 0)] + [(i, " ".join(rng.choice(words) for _ in range(30)) + f" {i}", "en", "s", 0) for i in range(2, 40)]
    docs = spark.createDataFrame(rows, DOCS)
    for name, stage in C.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        lengths = {r.doc_id: len(r.text) for r in docs.collect()}
        assert max(lengths.values()) == len(long) + (5 if name != "ngram_jaccard" else 0)
    assert 0 in lengths and 1 not in lengths and len(lengths) == 39


@pytest.mark.parametrize("start", ["encode", "learn", "ngrams"])
def test_texts_go_to_python_in_small_batches(spark, start):
    """Under Spark's own bound, 2,500 texts of 4,000 bytes are one batch of 10 MB; a lower bound of the user's stays."""
    docs = spark.range(0, 2500, 1, 1).selectExpr("id AS doc_id", "repeat('ab c ', 800) AS text", "'en' AS lang")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    begin = {"encode": lambda: bpe.bpe_encode(docs, path, public_tokenizers.PATTERN), "learn": lambda: language_id.learn(docs.limit(2)), "ngrams": lambda: ngram_jaccard.ngram_jaccard_join(docs.limit(2))}[start]

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    before = spark.conf.get(common.BATCH_CONF)
    try:
        for bound, most in (("64m", common.BATCH_BYTES), ("1m", 1 << 20)):
            spark.conf.set(common.BATCH_CONF, bound)
            begin()
            got = docs.mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r.n for r in got) == 2500 and max(r.bytes for r in got) <= 1.1 * most
    finally:
        spark.conf.set(common.BATCH_CONF, before)


def test_encoding_lets_a_batch_go_before_the_next(spark):
    alive = []

    def batches():
        for i in range(3):
            assert not [r for r in alive if r() is not None]
            batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array([f"text {i} {k}" for k in range(1500)])], names=["kept", "text"])
            alive.append(weakref.ref(batch))
            held = [batch]
            del batch
            yield held.pop()

    run = bpe._encoded(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, False)
    assert sum(out.num_rows for out in run(batches())) == 4500 and len(alive) == 3


def test_words_met_before_are_not_merged_again(monkeypatch):
    path, merged = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), []
    encode = bpe.Vocabulary.encode_pieces
    monkeypatch.setattr(bpe.Vocabulary, "encode_pieces", lambda self, pieces: merged.append(len(pieces)) or encode(self, pieces))
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 100)
    texts = [" ".join(["qzxwv", f"qzxwv{k % 3}.", f"vwxzq\n\n  {k % 2}"] * 5) for k in range(200)]
    ids = list(bpe.encode_texts(texts, path, public_tokenizers.PATTERN))
    assert sum(merged) < 100 and bytes(bpe.encoder(path, public_tokenizers.PATTERN)[0].decode(ids[7])).decode() == texts[7]
    monkeypatch.setattr(bpe, "MEMO", 3)  # what is kept is bounded, and forgotten chunks give the same ids
    again = list(bpe.encode_texts([*texts, "z" * 1000], path, public_tokenizers.PATTERN))
    assert [x.tolist() for x in again[:-1]] == [x.tolist() for x in ids]
    kept = bpe._encoder(path, public_tokenizers.PATTERN)
    assert len(kept.first) + len(kept.spaced) < 20 and "z" * 1000 not in kept.first


def test_stars_take_no_step(spark):
    """Each step is a table and seven jobs of the driver; op2's links are stars in most runs."""
    for edges, tables in (([(1, 0), (2, 0), (3, 1), (9, 5)], 2), ([(1, 0), (2, 0), (9, 5)], 1), ([], 1)):
        with common.intermediates() as made:
            out = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.id: r.component for r in out} == {x: 5 if x in (5, 9) else 0 for e in edges for x in e}
        assert (len(made) == 1) == (tables == 1)
        common.clear(spark, made)
