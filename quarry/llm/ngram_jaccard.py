"""N-gram Jaccard join by a token-group matrix.

Documents with equal shingle sets are one node from the start. The other steps:

1. Grouping. MinHash keys bring similar documents together; each is compared, exactly, with the first document of
   its keys. What is linked so is one component. A component of half a block or more is a group; smaller ones that
   share their most frequent key are a group together, linked or not, so that documents which resemble one text
   without linking do not meet one by one. Groups are kept in blocks of about BLOCK documents.
2. Token-group matrix. If two documents link, the rarest fifth of the one's tokens meets that of the other, whatever
   the order of tokens is, as long as there is one; with k tokens more each, they share k there. So each document
   enters that prefix only, and the matrix has a row for each token and block of a group. Tokens seen in one
   component only are dropped at once.
3. Bound. A document and a block with a smaller component that share k prefix tokens are candidates. A block's token union
   is kept as a bitmap of hashed columns; bits that the document has and the union lacks are tokens it lacks, which
   bounds their overlap from above. Blocks where the bound is below 80 % of the document's tokens stay closed.
4. Opening. The document is compared with members of smaller components in the blocks left: by their own bitmaps,
   then exactly.

Links inside a component need no further comparison, as the result is a document's component: a group of copies of any
size costs a comparison a document, not one a pair. Common tokens come last in the token order, so a passage that
many documents share is in no prefix but where nearly all of a document is common. The order only decides what is
compared, never the result, which is exact up to collisions of 64-bit token hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, tidied, written
from .components import connected_components
from .shingles import K, mix, shingle_sets, slices

#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: MinHash keys of a document, and values in a key.
KEYS, ROWS = 3, 3
#: Documents in a block of a group, on average.
BLOCK = 512
#: Documents that meet a block at once, and members of a block that each is compared with first.
TILE, LIKELIEST = 512, 2
#: A prefix has an eighth of the tokens more than it takes to share one, so linked documents share an eighth in it.
SPARE = 8
#: Columns of a bitmap.
BITS = 4096
#: A token is common when it is in so many documents; of the common ones, so many are told to all tasks (3 MB).
COMMON, COMMON_KEPT = 16, 200_000
#: Tokens that a task counts together when it looks for common ones.
POOL = 2_000_000
#: Pairs up to this number (8 MB) are sent to all tasks for the first half of a comparison; more are joined.
PAIRS_SENT = 500_000
#: Parts that the documents asking for one block are dealt into.
SALTS = 16
#: The most frequent tokens, whose entries are dealt into parts too.
HOT = 2000
#: Size of the filter that tells tasks which documents are needed (1 MB); beyond its capacity it only lets more pass.
FILTER_BITS = 1 << 23

_SEEDS = mix(np.arange(1, KEYS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, buf, offs in slices(batch.column("text")):
        yield i, j, *shingle_sets(buf, offs)


def _signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


_FEATURES = "id long, kept {}, n int, sig binary, keys array<bigint>, common array<bigint>, seen array<bigint>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; after so many tokens, a row with those that several of the documents hold."""
    pool: list[np.ndarray] = []
    known: set[bytes] = set()
    kind = None

    def row(ids, kept, n, sig, keys, common, seen):
        return pa.RecordBatch.from_arrays([ids, kept, n, sig, keys, common, seen], names=["id", "kept", "n", "sig", "keys", "common", "seen"])

    def flush():
        if not pool:
            return
        t, c = np.unique(np.concatenate(pool), return_counts=True)
        pool.clear()
        known.clear()
        t, c = t[c > 2], c[c > 2]
        ends = np.array([0, len(t)])
        yield row(pa.nulls(1, pa.int64()), pa.nulls(1, kind), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int64())), _lists(t, ends), _lists(c.astype(np.int64), ends))

    for batch in batches:
        kind = batch.column("kept").type
        for i, j, tokens, offs in _sets(batch):
            n = np.diff(offs)
            full = np.flatnonzero(n)
            keys = np.zeros((j - i, KEYS), np.uint64)
            if len(full):
                with np.errstate(over="ignore"):
                    for k in range(KEYS):
                        for r in range(ROWS):
                            low = np.minimum.reduceat(mix(tokens * _SEEDS[k * ROWS + r]) if r == 0 else tokens * _SEEDS[k * ROWS + r], offs[:-1][full])
                            keys[full, k] = mix(keys[full, k] * np.uint64(31) + low)
            sigs = [_signature(tokens[offs[d] : offs[d + 1]]) if n[d] else b"" for d in range(j - i)]
            for d in full:
                if sigs[d] not in known:
                    known.add(sigs[d])
                    pool.append(tokens[offs[d] : offs[d + 1]])
            key_offs = np.arange(j - i + 1) * KEYS
            yield row(batch.column("id").slice(i, j - i), batch.column("kept").slice(i, j - i), pa.array(n.astype(np.int32)), pa.array(sigs, pa.binary()), _lists(keys.ravel(), key_offs), pa.nulls(j - i, pa.list_(pa.int64())), pa.nulls(j - i, pa.list_(pa.int64())))
            if sum(map(len, pool)) > POOL:
                yield from flush()
    yield from flush()


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n tokens with one it links to."""
    return -(-n * percent // 100)


def _spare(n):
    """The k of a set of n tokens; never more than it has to share with one it links to."""
    return n // SPARE


def _prefixes(common, percent: int):
    """common: broadcast of (sorted tokens, class 1, 2, ... of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind = common.value
        for batch in batches:
            for i, j, tokens, offs in _sets(batch):
                n = np.diff(offs)
                length = np.where(n > 0, n - _needed(n, percent) + np.maximum(1, np.minimum(_spare(n), _needed(n, percent))), 0)
                doc = np.repeat(np.arange(j - i), n)
                if len(known) and len(tokens):
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    cls = np.where(known[at] == tokens, kind[at], 0)
                    tokens = tokens[np.argsort(doc * 64 + cls, kind="stable")]
                place = np.arange(len(tokens)) - np.repeat(offs[:-1], n)
                kept = tokens[place < np.repeat(length, n)]
                sigs = [_signature(np.sort(tokens[offs[d] : offs[d + 1]])) if n[d] else b"" for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(sigs, pa.binary()), _lists(kept, np.concatenate(([0], np.cumsum(length))))], names=["id", "sig", "prefix"])

    return run


def _fetch(needed, bitmaps: bool):
    """Sets, or bitmaps, of the documents that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(needed.value, bitorder="little").view(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bits[batch.column("slot").to_numpy()]))
            for i, j, tokens, offs in _sets(batch):
                if bitmaps:
                    flat = np.zeros((j - i, BITS), bool)
                    flat[np.repeat(np.arange(j - i), np.diff(offs)), (tokens >> np.uint64(20)).astype(np.int64) % BITS] = True
                    data = [x.tobytes() for x in np.packbits(flat, axis=1)]
                else:
                    data = [tokens[offs[d] : offs[d + 1]].tobytes() for d in range(j - i)]
                sigs = [_signature(tokens[offs[d] : offs[d + 1]]) for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(sigs, pa.binary()), pa.array(data, pa.binary())], names=["id", "sig", "data"])

    return run


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 500):
                batch = whole.slice(i, 500)
                ok = np.zeros(len(batch), bool)
                for x, (p, q) in enumerate(zip(batch.column("left"), batch.column("right"), strict=True)):
                    p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                    if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                        both = np.intersect1d(p, q, assume_unique=True).size
                        ok[x] = 100 * both >= percent * (len(p) + len(q) - both)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _unite(table: pa.Table) -> pa.Table:
    """The token union of one block as a bitmap, and the range of its sets' sizes."""
    rows = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint8).reshape(-1, BITS // 8)
    one = table.slice(0, 1).select(["group", "block"])
    n = pc.min_max(table.column("n")).as_py()
    return one.append_column("least", pa.array([n["min"]], pa.int32())).append_column("most", pa.array([n["max"]], pa.int32())).append_column("union", pa.array([np.bitwise_or.reduce(rows, axis=0).tobytes()], pa.binary()))


def _open_blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            own = np.frombuffer(b"".join(batch.column("data").to_pylist()), np.uint8).reshape(-1, BITS // 8)
            union = np.frombuffer(b"".join(batch.column("union").to_pylist()), np.uint8).reshape(-1, BITS // 8)
            n = batch.column("n").to_numpy().astype(np.int64)
            bound = n - np.bitwise_count(own & ~union).sum(axis=1, dtype=np.int64)
            yield batch.select(["q", "n", "own", "group", "block"]).filter(pa.array(bound >= _needed(n, percent)))

    return run


def _alike(asking: DataFrame, members: DataFrame, bitmaps: DataFrame, percent: int, most: int | None) -> DataFrame:
    """(q, node, component, group): members of a block that may link to a document as far as their bitmaps tell, or the
    `most` likeliest of each component in it. Only components smaller than the document's own count, so that a pair
    of components meets from one side. Documents meet a block in tiles of about TILE, however many ask. Bitmaps (node, data)
    come last, so tiles are dealt, and blocks that nobody asks for left out, without them."""
    tiles = asking.groupBy("group", "block").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    left = asking.join(tiles, ["group", "block"]).withColumn("tile", F.pmod(F.xxhash64(F.lit("tile"), "q"), F.col("tiles")).cast("int"))
    right = members.join(tiles, ["group", "block"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    keys = ["group", "block", "tile"]

    def compare(qs: pa.Table, ms: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if qs.num_rows and ms.num_rows:
            member = np.frombuffer(b"".join(ms.column("data").to_pylist()), np.uint8).reshape(-1, BITS // 8)
            ids, size, component = (ms.column(c).to_numpy().astype(np.int64) for c in ("node", "n", "component"))
            for q, n, own, data in zip(*(qs.column(c).to_pylist() for c in ("q", "n", "own", "data")), strict=True):
                bits = np.frombuffer(data, np.uint8)
                bound = np.minimum(n - np.bitwise_count(bits & ~member).sum(axis=1, dtype=np.int64), size - np.bitwise_count(member & ~bits).sum(axis=1, dtype=np.int64))
                may = np.flatnonzero(((100 + percent) * bound >= percent * (n + size)) & (component < own))
                if most is not None and len(may) > most:
                    may = may[np.lexsort((ids[may], -bound[may] / (n + size[may] - bound[may]), component[may]))]
                    at = np.arange(len(may))
                    new = np.append(True, np.diff(component[may]) != 0)
                    may = may[at - np.maximum.accumulate(np.where(new, at, 0)) < most]
                out.append((np.full(len(may), q, np.int64), ids[may], component[may]))
        q, i, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        group = qs.column("group")[0].as_py() if qs.num_rows else None
        return pa.table({"q": pa.array(q), "node": pa.array(i), "component": pa.array(c), "group": pa.array([group] * len(q), pa.int64())})

    # toDF gives the columns identities of their own: both sides come from the same tables.
    left, right = left.join(bitmaps.withColumnRenamed("node", "q"), "q"), right.join(bitmaps, "node")
    asked = left.select(*keys, "q", "n", "own", "data").toDF(*keys, "q", "n", "own", "data")
    told = right.select(*keys, "node", "n", "component", "data").toDF(*keys, "node", "n", "component", "data")
    return asked.groupBy(*keys).cogroup(told.groupBy(*keys)).applyInArrow(compare, "q long, node long, component long, group long")


class _Documents:
    """The input, read again for the sets, prefixes or bitmaps that a step needs rather than kept with all of them."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, keep: list[str]):
        kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("boolean")
        self.rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), kept.alias("kept"))
        self.spark = docs.sparkSession
        self.nodes: DataFrame | None = None

    def data_of(self, nodes: DataFrame, bitmaps: bool = False) -> DataFrame:
        """(node, data) of the nodes in nodes (node), each from the document that stands for it."""
        wanted = self.nodes.select("node", F.col("id").alias("_id"), F.col("sig").alias("_sig")).join(nodes, "node", "left_semi")
        wanted = written(wanted, "wanted")
        slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
        pages = wanted.select((F.pmod(F.xxhash64("_id"), F.lit(FILTER_BITS)) + 1).alias("s"))
        pages = pages.groupBy(F.bitmap_bucket_number("s").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
        bits = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
        for r in pages.collect():  # 256 pages of 4 KB at most
            bits[r["page"] - 1] = np.frombuffer(r["bits"], np.uint8)
        rows = self.rows.select("id", "text").where("id is not null").withColumn("slot", slot)
        found = rows.mapInArrow(tidied(_fetch(self.spark.sparkContext.broadcast(bits.ravel()), bitmaps)), "id long, sig binary, data binary")
        return found.join(wanted, (F.col("id") == F.col("_id")) & (F.col("sig") == F.col("_sig"))).select("node", "data")


def _verified(pairs: DataFrame, source: _Documents, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Sets are written once; the sets of a travel to those of b, of which there are fewer."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = written(source.data_of(ends), "sets")
    few = pairs.count() <= PAIRS_SENT
    sent = F.broadcast if few else (lambda df: df)
    left = sets.select(F.col("node").alias("a"), F.col("data").alias("left"))
    right = sets.join(sent(pairs.select(F.col("b").alias("node")).distinct()), "node", "left_semi").select(F.col("node").alias("b"), F.col("data").alias("right"))
    return left.join(sent(pairs), "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(tidied(_links(percent)), "a long, b long")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, keep: list[str] | None = None) -> DataFrame:
    """A row for each document: doc_id, n_shingles (size of its set of 5-word shingles), component_id, class, and the
    columns `keep` of the input as a struct `kept` (null without any).

    component_id is the smallest doc_id that links lead to, its own included; two documents link when
    100 * intersection >= percent * union of their sets. class is a number that the documents of a component share and
    no others have. Words are lower-cased (A-Z); fewer than 5 are one shingle. Documents without words, null or empty
    text included, link with nothing and have no class, nor do rows with a null id, whose component_id is null. Rows of
    one id are documents of their own; they are in one class if their sets are equal or link. Empty input gives an
    empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = _Documents(docs, id_col, text_col, keep or [])
    kind = source.rows.schema["kept"].dataType.simpleString()
    features = written(source.rows.mapInArrow(tidied(_features), _FEATURES.format(kind)), "features")
    sets = features.where("sig is not null and n > 0 and id is not null")
    # A node is a set, numbered as it is written: an id may have several.
    nodes = sets.groupBy("sig").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("keys").alias("keys"))
    nodes = source.nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # 1: groups.
    keyed = nodes.select("node", F.posexplode("keys").alias("k", "key"))
    first = keyed.groupBy("k", "key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1")
    together = written(keyed.join(first, ["k", "key"]).select("node", "b", "c"), "together")
    near = written(together.where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "near")
    links = written(_verified(near, source, percent), "links")
    components = written(connected_components(links).withColumnRenamed("id", "node"), "components")
    sizes = written(components.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    busiest = together.groupBy(F.col("node").alias("component")).agg(F.max_by("b", F.struct("c", "b")).alias("near"))
    grouped = nodes.select("node", "n").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = grouped.join(sizes, "component", "left").join(busiest, "component", "left")
    group = F.when(F.col("size") * 2 >= BLOCK, F.col("component")).otherwise(F.coalesce("near", "component"))
    grouped = written(grouped.select("node", "n", "component", group.alias("group")), "grouped")
    # Written, so that the join with them is a stage of its own and Spark can split a large group's partition.
    shared_groups = written(grouped.groupBy("group").agg(F.count(F.lit(1)).alias("together")).where("together > 1"), "groups")
    size = F.coalesce("together", F.lit(1))
    block = F.pmod(F.xxhash64(F.lit("block"), "node"), F.ceil(size / BLOCK)).cast("int")
    # Components are numbered anew, those of large groups first.
    number = F.shiftleft(F.lit(31).cast("long") - F.floor(F.log2(size)), 57) + F.col("component")
    members = written(grouped.join(shared_groups, "group", "left").select("node", "n", number.alias("component"), "group", block.alias("block")), "members")

    # 2: tokens that several components have in their prefixes.
    seen = features.where("sig is null").select(F.inline(F.arrays_zip("common", "seen"))).groupBy("common").agg(F.sum("seen").alias("c"))
    often = seen.where(F.col("c") >= COMMON).orderBy(F.desc("c"), "common").limit(COMMON_KEPT).toPandas()
    order = np.argsort(often["common"].to_numpy(np.int64).view(np.uint64))
    common = spark.sparkContext.broadcast((often["common"].to_numpy(np.int64).view(np.uint64)[order], 1 + np.log2(often["c"].to_numpy(float)[order]).astype(np.int64)))
    prefixes = source.rows.select("id", "text").where("id is not null").mapInArrow(tidied(_prefixes(common, percent)), "id long, sig binary, prefix array<bigint>")
    named = nodes.select("id", "sig", "node").join(members.select("node", "component"), "node")
    entries = prefixes.join(named, ["id", "sig"]).select(F.explode("prefix").alias("token"), "node", "component")
    hot = spark.createDataFrame(often[["common"]].head(HOT).rename(columns={"common": "token"}), "token long")
    shared = _in_several_components(entries, hot)
    # What a block's smallest set is travels with its members: a block has a bounded number of them, but not of askers.
    smallest = members.groupBy("group", "block").agg(F.min("n").alias("smallest"))
    told = members.select("node", "n", "group", "block").join(smallest, ["group", "block"])
    shared = written(shared.join(told, "node"), "matrix")

    # 3: documents against blocks. Of two components, the one with the larger number sends its documents: that of the
    # smaller group, so that a few single documents meet a large group's blocks, not all its documents each of them.
    rows = shared.groupBy("token", "group", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("low"), F.min("smallest").alias("smallest"))
    fits = (F.col("n") * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= F.col("n") * percent)
    asked = shared.select("token", F.col("node").alias("q"), "n", F.col("component").alias("own"))
    met = asked.join(rows, "token").where((F.col("own") > F.col("low")) & fits).groupBy("q", "n", "own", "group", "block")
    met = met.agg(F.count(F.lit(1)).alias("shared"), F.min("smallest").alias("smallest"))
    # k of the smaller set; with a percentage that low, what they have to share at least.
    k = F.floor(F.least("n", "smallest") * min(1 / SPARE, percent / 100))
    could = written(met.where(F.col("shared") >= k).select("q", "n", "own", "group", "block"), "candidates")
    blocks = could.select("group", "block").distinct()
    inside = members.join(blocks, ["group", "block"]).select("node", "n", "group", "block")
    asked_for = could.select(F.col("q").alias("node")).unionByName(inside.select("node")).distinct()
    bitmaps = written(source.data_of(asked_for, bitmaps=True), "bitmaps")
    unions = inside.join(bitmaps, "node").groupBy("group", "block").applyInArrow(_unite, "group long, block int, least int, most int, union binary")
    asking = could.join(bitmaps.withColumnRenamed("node", "q"), "q").withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "q"), F.lit(SALTS)))
    bounds = asking.join(unions.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["group", "block", "salt"]).where(fits)
    opened = written(bounds.select("q", "n", "own", "group", "block", "data", "union").mapInArrow(tidied(_open_blocks(percent)), "q long, n int, own long, group long, block int"), "opened")

    # 4: exact comparison with members of the blocks left. One link joins a document to a component, so its likeliest
    # members come first, and the others only for documents that these do not link.
    tried = written(_alike(opened, members, bitmaps, percent, most=LIKELIEST), "likeliest")
    # What is linked so far is told by its components: stars, which are found to be done at once if nothing joins them.
    links = components.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    later: DataFrame | None = None
    for pairs in (tried, None):
        if pairs is None:
            open_yet = tried.join(later, ["q", "component"], "left_anti").select("q", "group").distinct()
            rest = _alike(opened.join(open_yet, ["q", "group"], "left_semi"), members, bitmaps, percent, most=None)
            pairs = written(rest.join(tried.select("q", "node"), ["q", "node"], "left_anti").join(later, ["q", "component"], "left_anti"), "others")
        pairs = pairs.select(F.col("q").alias("a"), F.col("node").alias("b"), "component")
        if pairs.isEmpty():
            break
        found = written(_verified(pairs.select("a", "b"), source, percent), "links")
        links = links.unionByName(found)
        later = found.join(pairs, ["a", "b"]).select(F.col("a").alias("q"), "component").distinct()
    classes = connected_components(links).withColumnRenamed("id", "node")
    named = nodes.select("sig", "id", "node").join(classes, "node", "left")
    named = written(named.select("sig", "id", F.coalesce("component", "node").alias("class")), "classes")
    least = named.groupBy("class").agg(F.min("id").alias("component_id"))
    named = named.select("sig", "class").join(least, "class")
    worded = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("sig"))  # the others meet nothing, and spread out
    out = features.where("sig is not null").withColumn("key", F.coalesce(worded, F.encode(F.concat(F.lit("-"), F.xxhash64("id", "sig", "kept").cast("string")), "UTF-8")))
    out = out.join(named.withColumnRenamed("sig", "key"), "key", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "class", "kept")


def _in_several_components(entries: DataFrame, often: DataFrame) -> DataFrame:
    """Entries (token, node, component) of the tokens that more than one component has; one shuffle of the entries.

    often: the HOT tokens that most documents have, in which case their entries are dealt by salt, and their components
    are found by an aggregate; every other token has a share below 1 / HOT.
    """
    hot = F.broadcast(often.withColumn("hot", F.lit(True)))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(F.lit("salt"), "node"), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = entries.join(hot, "token", "left").withColumn("salt", salt).repartition("token", "salt")
    ends = dealt.where("hot").groupBy("token").agg(F.min("component").alias("first"), F.max("component").alias("last"))
    of_part = Window.partitionBy("token", "salt")
    wide = dealt.withColumns({"low": F.min("component").over(of_part), "high": F.max("component").over(of_part)})
    wide = wide.join(F.broadcast(ends), "token", "left")
    return wide.where(F.coalesce("first", "low") < F.coalesce("last", "high")).select("token", "node", "component")
