"""Vector compression by product codebooks of integers.

Components become integers, vectors are cut into PARTS equal consecutive parts, and each part position has a codebook of
ENTRIES entries, so that a vector is a few small indexes. The codebooks are learned in rounds: they are broadcast
(PARTS * ENTRIES parts of a vector, whatever the table's size), each task finds all distances of an Arrow batch at
once, |x|^2 + |c|^2 - 2 x.c with int64 products, takes the first least one, and adds its parts up for each entry; a
grouped shuffle merges the tasks' sums. So a round moves a few hundred rows for each task, and a vector that a third of
the rows have costs no more than others. All sums are exact.

Vectors of different lengths do not compare: each length has codebooks of its own. A length that the number of parts
does not divide is filled up with zeros, which change no distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import finite

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers in all codebooks, at most: they are broadcast and merged on the driver.
MAX_INTEGERS = 4_000_000
#: Vectors whose distances are held at once.
AT_ONCE = 4096
#: A label is hot if it has more than one in so many rows; fewer labels than that can be.
HOT_SHARE = 1000

#: length -> (parts, entries, part length)
Codebooks = dict[int, np.ndarray]


def integers(vectors: DataFrame, vec_col: str, scale: int) -> DataFrame:
    """vectors with `v`: floor(scale * x) of each component; those without a finite vector are left out."""
    kept = vectors.where(finite(F.col(vec_col)))
    return kept.withColumn("v", F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for each length in a list column without nulls."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    ends = np.cumsum(lengths)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, flat[(ends[rows] - d)[:, None] + np.arange(d)]


def exact(v: np.ndarray) -> np.ndarray:
    """v, if squared distances of such vectors fit into 64 bits."""
    if v.size and 4 * v.shape[1] * max(int(v.max()), -int(v.min())) ** 2 >= 1 << 62:
        raise ValueError("components are too large: squared distances would not fit into a long")
    return v


def in_parts(v: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts, part length), filled up with zeros."""
    missing = -v.shape[1] % parts
    return exact(np.pad(v, ((0, 0), (0, missing))) if missing else v).reshape(len(v), parts, -1)


def assigned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts): the nearest entry of each part, the first one of equals, and its squared distance."""
    near, least = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
    for p in range(x.shape[1]):
        part = x[:, p]
        d = (part * part).sum(axis=1)[:, None] + (book[p] * book[p]).sum(axis=1)[None] - 2 * (part @ book[p].T)
        near[:, p] = d.argmin(axis=1)
        least[:, p] = np.take_along_axis(d, near[:, p : p + 1], axis=1)[:, 0]
    return near, least


def _smallest(k: int):
    """Each task's k smallest ids of each length, with the smallest vector of each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict[int, list[int]]] = {}
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for d, rows, v in by_length(batch.column("v")):
                best = found.setdefault(d, {})
                near = np.unique(ids[rows])[:k]
                for i in np.flatnonzero(np.isin(ids[rows], near)):
                    x, own = int(ids[rows[i]]), v[i].tolist()
                    best[x] = min(best.get(x, own), own)
                found[d] = {x: best[x] for x in sorted(best)[:k]}
        out = [(d, x, v) for d, best in found.items() for x, v in best.items()]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))], names=["d", "vec_id", "v"])

    return run


def start(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids, ascending. rows: vec_id, v."""
    small = rows.where("vec_id is not null").select("vec_id", "v").mapInArrow(_smallest(entries), "d int, vec_id long, v array<long>")
    small = small.groupBy("d", "vec_id").agg(F.min("v").alias("v"))
    named = small.groupBy("d").agg(F.slice(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), 1, entries).alias("first"))
    size = named.agg(F.sum(F.col("d").cast("long") + parts)).first()[0] or 0
    if size * entries > MAX_INTEGERS:
        raise ValueError(f"codebooks of all lengths hold {size * entries} integers, more than {MAX_INTEGERS}")
    books = {}
    for d, first in named.select("d", "first.v").collect():
        books[d] = in_parts(np.array(first, np.int64), parts).transpose(1, 0, 2).copy()
    return books


def _sums(books, parts: int):
    """Each task's number and sum of the parts that go to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(0, len(batch), AT_ONCE):
                for d, _, v in by_length(batch.column("v").slice(i, AT_ONCE)):
                    if d not in books.value:
                        continue
                    book = books.value[d]
                    n, s = total.setdefault(d, (np.zeros(book.shape[:2], np.int64), np.zeros_like(book)))
                    x = in_parts(v, parts)
                    near, _ = assigned(x, book)
                    for p in range(parts):
                        np.add.at(s[p], near[:, p], x[:, p])
                        n[p] += np.bincount(near[:, p], minlength=book.shape[1])
        out = [(d, p, e, int(n[p, e]), s[p, e].tolist()) for d, (n, s) in total.items() for p, e in np.argwhere(n > 0).tolist()]
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["d", "part", "entry", "n", "sums"])

    return run


def learned(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after some rounds over all rows (vec_id, v), which are read once a round."""
    books = start(rows, parts, entries)
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(books)
        sums = rows.select("v").mapInArrow(_sums(sent, parts), "d int, part int, entry int, n long, sums array<long>")
        merged = sums.select("d", "part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("d", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        new = {d: book.copy() for d, book in books.items()}
        for d, part, entry, at, n, s in merged.collect():  # parts * entries * part length rows
            new[d][part, entry, at] = s // n
        sent.unpersist()
        if all((new[d] == books[d]).all() for d in books):
            break
        books = new
    return books


def _coded(books, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), AT_ONCE):
                part = batch.slice(i, AT_ONCE)
                code, error = np.full(len(part), None, object), np.full(len(part), None, object)
                sha = np.full(len(part), None, object)
                for d, at, v in by_length(part.column("v")):
                    if d in books.value:
                        book, digest = books.value[d]
                        near, least = assigned(in_parts(v, parts), book)
                        code[at] = [bytes(r).hex() for r in near.astype(np.uint8)]
                        error[at] = least.sum(axis=1)
                        sha[at] = digest
                yield pa.RecordBatch.from_arrays([part.column("kept"), pa.array(code, pa.string()), pa.array(error, pa.int64()), pa.array(sha, pa.string())], names=["kept", "code", "error", "codebooks_sha256"])

    return run


def digest(book: np.ndarray) -> str:
    """sha256 over all components as decimals, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def encoded(rows: DataFrame, books: Codebooks, parts: int = PARTS) -> DataFrame:
    """rows (kept, v) as (kept, code, error, codebooks_sha256)."""
    sent = rows.sparkSession.sparkContext.broadcast({d: (b, digest(b)) for d, b in books.items()})
    kind = rows.schema["kept"].dataType.simpleString()
    return rows.select("kept", "v").mapInArrow(_coded(sent, parts), f"kept {kind}, code string, error long, codebooks_sha256 string")


def decoded(code: str, length: int, book: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """A vector near the one that a code stands for: the middle of each entry's cell."""
    entries = np.frombuffer(bytes.fromhex(code), np.uint8)
    return (book[np.arange(len(entries)), entries].ravel()[:length] + 0.5) / scale


def with_total(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows with the sum of `value` over those that agree in `key`, nulls together.

    The few keys that may be hot, under HOT_SHARE of them, meet their rows by broadcast, so none of them gathers its
    rows in one task; the others, each with a small share, are joined as Spark chooses.
    """
    n = rows.count()
    totals = written(rows.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias(name), F.count(F.lit(1)).alias("_n")), "totals")
    hot = F.broadcast(totals.where(F.col("_n") * HOT_SHARE > n).drop("_n").withColumn("_hot", F.lit(True)))
    met = rows.join(hot, rows[key].eqNullSafe(hot["_key"]), "left").drop("_key")
    cold = totals.where(F.col("_n") * HOT_SHARE <= n).drop("_n")
    rest = met.where("_hot is null").drop(name, "_hot").join(cold, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    return met.where("_hot").drop("_hot").unionByName(rest)


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row with a finite vector.

    Rows with a null or empty vector or a component that is null or not finite are left out. Every other row is coded,
    repeated rows each; rows with a null id too, though none starts an entry. Of an id with several vectors the smallest
    may start one. With fewer ids than entries the codebooks have fewer; without any id, code and error are null. Entries
    that no part goes to stay as they are. Equal distances go to the lower index, null labels are one label. Other
    columns are not used. Components too large for exact sums are an error. Empty input gives an empty result.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: entries is 1 to 256")
    rows = integers(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("embedding")), "embedding", scale)
    rows = written(rows.select(F.struct("vec_id", "label").alias("kept"), "v"), "vectors-as-integers")
    books = learned(rows.select("kept.vec_id", "v"), parts, entries, rounds)
    coded = written(encoded(rows, books, parts).select("kept.vec_id", "kept.label", "code", "error", "codebooks_sha256"), "codes")
    return with_total(coded, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", "codebooks_sha256")
