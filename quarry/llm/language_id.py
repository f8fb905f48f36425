"""Language ID by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over byte trigrams (naive Bayes: the log odds
of a trigram among the languages with the bit set against the others) gives a margin. Decoding sums, for each
language, the logistic loss of all margins against its codeword and takes the least; a small lead over the second
marks a text as ambiguous.

Learning is one aggregate of trigram counts over all labelled rows, and what comes to the driver is a count for each
language and slot: at most MAX_LANGUAGES * SLOTS numbers, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, small_batches, tidied
from .shingles import mix, slices

SLOTS = 1 << 15
MAX_LANGUAGES = 1000
#: Up to so many languages have the exhaustive code of 2^(n-1) - 1 bits; more have random codewords.
EXHAUSTIVE = 7
#: Trigrams of evidence after which longer texts get no surer, and the weight of the evidence.
FULL_EVIDENCE, WEIGHT = 200, 0.5
#: A text is ambiguous when the softmax of its two best languages differs by less than this.
AMBIGUOUS = 0.1
UNKNOWN = "und"

_MAP = np.arange(256, dtype=np.uint64)
_MAP[:128] = 32
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        columns = [(1, *rest) for rest in product((-1, 1), repeat=n - 1) if -1 in rest]
        return np.array(columns, float).T
    rng = np.random.default_rng(0)
    bits = int(np.ceil(15 * np.log2(n)))
    tries = [rng.choice([-1.0, 1.0], (n, bits)) for _ in range(20)]
    return max(tries, key=lambda m: -(m @ m.T - bits * np.eye(n)).max())


def _trigrams(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Slot of the trigram at each byte; 0 where there is none: at a text's end, and runs without a letter."""
    b = _MAP[buf]
    slot = np.zeros(len(b), np.int64)
    if len(b) > 2:
        code = b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]
        slot[:-2] = 1 + (mix(code) % np.uint64(SLOTS - 1)).astype(np.int64)
        slot[:-2][code == 0x202020] = 0
    for back in (1, 2):
        at = offs[1:] - back
        slot[at[at >= offs[:-1]]] = 0
    return slot


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for i, j, buf, offs in slices(batch.column("text")):
            slot = _trigrams(buf, offs)
            for d in range(j - i):
                total = seen.setdefault(langs[i + d], np.zeros(SLOTS, np.int64))
                total += np.bincount(slot[offs[d] : offs[d + 1]], minlength=SLOTS)
    for lang, total in seen.items():
        at = np.flatnonzero(total[1:]) + 1
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "slot", "n"])


class Model:
    """Languages in order, their codewords, and for each bit a weight for each slot."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        self.codes = codewords(len(self.languages))
        table = np.array([counts[x] for x in self.languages]) if counts else np.zeros((0, SLOTS))
        # A language weighs by its shares, not by how much text there is of it.
        share = (table + 0.5) / (table + 0.5).sum(axis=1, keepdims=True) if counts else table
        self.weights = np.zeros((self.codes.shape[1] if counts else 0, SLOTS), np.float32)
        if len(self.languages) > 1:
            for b, column in enumerate(self.codes.T):
                self.weights[b] = np.log(share[column > 0].mean(axis=0)) - np.log(share[column < 0].mean(axis=0))
            self.weights[:, 0] = 0

    def margins(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(texts, bits): the mean weight of a text's trigrams, as much as its number of trigrams lets it count."""
        slot = _trigrams(buf, offs)
        full = np.flatnonzero(np.diff(offs))
        n, margins = np.zeros(len(offs) - 1), np.zeros((len(offs) - 1, len(self.weights)))
        n[full] = np.add.reduceat((slot > 0).astype(np.int64), offs[:-1][full])
        for b, w in enumerate(self.weights):
            margins[full, b] = np.add.reduceat(w[slot], offs[:-1][full], dtype=np.float64)
        return margins * (WEIGHT * np.minimum(n, FULL_EVIDENCE) / np.maximum(n, 1) / len(self.weights) * 4)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its share of the softmax of negative losses, lead over the second) for rows of margins."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None]).sum(axis=2)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)  # of equal ones the first in order
        top = np.sort(p, axis=1)
        return best, top[:, -1], top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the rows whose lang is not null."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.mapInArrow(tidied(_counts), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # A row for each language, with up to SLOTS numbers.
    listed = counts.groupBy("lang").agg(F.collect_list("slot").alias("slot"), F.collect_list("n").alias("n")).limit(MAX_LANGUAGES + 1).toArrow()
    if listed.num_rows > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    found = {}
    for i, lang in enumerate(listed.column("lang").to_pylist()):
        found[lang] = np.zeros(SLOTS)
        found[lang][listed.column("slot")[i].values.to_numpy()] = listed.column("n")[i].values.to_numpy()
    return Model(found)


def _predicted(model, ambiguous: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            letters = batch.column("letter").to_numpy(zero_copy_only=False)
            for i, j, buf, offs in slices(batch.column("text")):
                n_docs = j - i
                lang, score, unsure = [UNKNOWN] * n_docs, np.zeros(n_docs), np.ones(n_docs, bool)
                known = letters[i:j] & (len(m.languages) > 0)
                if known.any():
                    best, p, lead = m.decode(m.margins(buf, offs))
                    for d in np.flatnonzero(known):
                        lang[d], score[d], unsure[d] = m.languages[best[d]], p[d], lead[d] < ambiguous
                yield pa.RecordBatch.from_arrays([batch.column("kept").slice(i, n_docs), pa.array(lang), pa.array(score), pa.array(unsure)], names=["kept", *PREDICTED])

    return run


PREDICTED = ("lang_pred", "score", "ambiguous")


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """The columns `keep` (all by default) with lang_pred (string), score (double, 0 to 1) and ambiguous (boolean).

    Texts that are null or hold no letter, and all texts if nothing was learned, get `und`, 0.0 and true. Only the
    text is looked at. Repeated rows stay. Columns of docs named like a new one give way to it; empty input gives an
    empty result.
    """
    rows, kept = carried(docs, F.col(text_col), keep, list(PREDICTED))
    rows = rows.withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = T.StructType([rows.schema["kept"], *T.StructType.fromDDL("lang_pred string, score double, ambiguous boolean")])
    return rows.mapInArrow(tidied(_predicted(docs.sparkSession.sparkContext.broadcast(model), ambiguous)), schema).select(*kept, *PREDICTED)


def held_out(id_: Column) -> Column:
    """A fixed quarter of the ids; null ids are not in it."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string")), F.lit(4)) == 2, F.lit(False))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of each row, by a model of the rows that are not held out."""
    model = learn(docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model, "text", ["doc_id", "held_out"])
