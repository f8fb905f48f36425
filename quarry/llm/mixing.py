"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source is due the same real number of copies, target / source size. The whole part is taken at
once; the fractional parts are rounded by the pivotal method: two documents meet, words move from one to the other
at random until one of them has a whole number of copies, and the other meets the next. Moves keep the sum of words,
so the words taken from a source miss its target by less than one document. The last document of a source is
rounded against up to four others of its group, which leaves a few words.

Documents meet inside leaves of LEAF documents on average; every leaf leaves at most one document undecided, and those
meet again in groups of FAN_IN up a reduction tree until one per source is left. No leaf or group grows with the data:
a source with a third of all rows merely has more leaves, and rows that repeat are dealt to leaves by their number
among their like, so an id that a third of all rows have is in no leaf more often than others are.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, written

WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MAX_COPIES = 3
#: Documents in a leaf, on average, and undecided documents that meet in a group of the tree.
LEAF, FAN_IN = 512, 256
#: Up to so many targets (a few MB) are sent to all tasks; more are joined.
SOURCES_SENT = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """sizes (source, source_size, ...) with `target`, a row for each source; there is one row of work per source.

    Sources in code-point order, null last, weigh `weights` in turn. The targets share the sum of all sizes by weight;
    one that would pass max_copies * source_size stops there and the excess is shared again by weight. With the
    sources in order of cap / weight, the capped ones come first; the level of the others is what is left over their
    weights, and a source is capped while its cap / weight is at most that level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    w = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), nth + 1).cast("double"))
    w = w.withColumns({"_cap": F.lit(float(max_copies)) * F.col("source_size"), "_n": F.row_number().over(order)})
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    rest = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    w = w.withColumns({"_level": left / rest, "_pos": F.row_number().over(by_ratio)})
    # The first source that stays under its cap sets the level, and all after it stay under theirs.
    opens = F.when(F.col("_cap") > F.col("_w") * F.col("_level"), F.struct("_pos", "_level"))
    w = w.withColumn("_first", F.min(opens).over(whole))
    target = F.when(F.col("_pos") >= F.col("_first._pos"), F.col("_w") * F.col("_first._level")).otherwise(F.col("_cap"))
    return w.select(*sizes.columns, target.alias("target"))


def _meet(size: np.ndarray, part: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds parts (in 0 .. 1) of documents in their order: (0 or 1 each, index of the one left undecided or -1).

    size: words, all above 0. u: a number in 0 .. 1 for each meeting. parts come back through `part`.
    """
    whole = np.zeros(len(size), np.int64)
    at = -1
    for k in range(len(size)):
        if part[k] <= 1e-12 or part[k] >= 1 - 1e-12:
            whole[k] = int(part[k] >= 0.5)
            continue
        if at < 0:
            at = k
            continue
        # Words can move until a document is all in or all out; odds keep each document's expectation.
        up = min((1 - part[at]) * size[at], part[k] * size[k])  # from k to at
        down = min(part[at] * size[at], (1 - part[k]) * size[k])  # from at to k
        move = up if u[k] * (up + down) < down else -down
        part[at] += move / size[at]
        part[k] -= move / size[k]
        for j in (at, k):
            if part[j] <= 1e-9 or part[j] >= 1 - 1e-9:
                whole[j] = int(part[j] >= 0.5)
                part[j] = whole[j]
        open_ = [j for j in (at, k) if 0 < part[j] < 1]
        at = open_[0] if open_ else -1
    return whole, at


def _close(size: np.ndarray, part: np.ndarray, whole: np.ndarray, flips: int = 4) -> None:
    """Takes back what rounding a source's last document is off by, through up to `flips` documents of its group."""
    off = (size * whole).sum() - (size * part).sum()
    for _ in range(flips):
        can = (part > 1e-12) & (whole == int(off > 0))
        gain = np.where(can, np.abs(off) - np.abs(np.abs(off) - size), 0.0)
        j = int(gain.argmax())
        if gain[j] <= 0:
            return
        whole[j] = 1 - whole[j]
        off += size[j] * (2 * whole[j] - 1)


def _round_group(last: bool, level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mark", "doc_id", "size"], kind="stable").reset_index(drop=True)
        part = rows["part"].to_numpy(float, copy=True)
        u = (rows["mark"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * level) >> np.uint64(11)).astype(float) / 2**53
        whole, at = _meet(rows["size"].to_numpy(float), part, u)
        done = np.ones(len(rows), bool)
        if at >= 0:
            if last:  # the one document that ends between copies
                whole[at] = int(u[at] < part[at])
                _close(rows["size"].to_numpy(float), rows["part"].to_numpy(float), whole)
            else:
                done[at] = False
        return rows.assign(part=np.where(done, 0.0, part), copies=rows["copies"] + np.where(done, whole, 0), done=done)

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 0, leaf: int = LEAF, fan_in: int = FAN_IN) -> DataFrame:
    """A row for each document: doc_id, size, source, source_size, target (its source's), copies (int) and taken (words).

    size: words of the whole text, null text: 0. A document is taken 0 to max_copies times whole, never in part.
    The same rows, weights and seed give the same result at any partitioning. Documents without words are taken 0
    times. Null sources are a source of their own; null ids are allowed; repeated rows are documents of their own.
    One task orders the sources, a row for each; everything else is spread over their documents.
    Empty input gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = written(numbered(written(rows, "mix-sizes"), ["doc_id", "source", "size"]), "mix-numbered")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    goals = written(targets(sizes, weights, max_copies), "targets")
    sources, most = goals.agg(F.count(F.lit(1)), F.max("source_docs")).first()
    mark = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("nth"))
    told = F.broadcast(goals) if sources <= SOURCES_SENT else goals
    due = rows.join(told, rows["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    real = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    due = due.withColumns({"_real": real}).withColumns({"copies": F.floor(F.col("_real") + F.lit(1e-12)).cast("long")})
    due = due.withColumns({
        "part": F.greatest(F.col("_real") - F.col("copies"), F.lit(0.0)), "mark": mark,
        "leaves": F.ceil(F.col("source_docs") / leaf).cast("long"),
    }).withColumn("node", F.pmod(F.xxhash64(F.lit("leaf"), "mark"), F.col("leaves")))
    due = due.select("doc_id", "source", "size", "source_size", "target", "copies", "part", "mark", "node", "leaves").withColumn("done", F.lit(False))
    settled = due.where((F.col("part") <= 1e-12) | (F.col("size") == 0))
    open_ = due.where((F.col("part") > 1e-12) & (F.col("size") > 0))
    ends = [settled]
    nodes = -(-(most or 0) // leaf)
    for level in count():
        last = nodes <= 1
        open_ = open_.groupBy("source", "node").applyInPandas(_round_group(last, level), due.schema)
        if last:
            ends.append(open_)
            break
        open_ = written(open_, "mix-level")
        ends.append(open_.where("done"))
        nodes = -(-nodes // fan_in)
        open_ = open_.where("not done").withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
    out = ends[0]
    for x in ends[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
