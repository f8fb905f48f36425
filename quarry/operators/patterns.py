"""Paths in a graph that match a pattern of labelled steps, as joins of edge tables.

A pattern is a start and steps; each step follows the edges of a label, forward or back, to nodes of a kind. Before
edges are joined to paths, they are reduced by semi-joins, back from the end, so paths are only extended by edges from
which the end is reached; the join itself leaves those that the start does not reach. Edges that are not small are dealt
by node into as many partitions as their bytes need, so what a task holds does not grow with them. Paths do not repeat a
node of one kind, and their length is the pattern's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import read_bytes

#: Patterns that are tried for a question, and paths that an answer lists.
ATTEMPTS, LISTED = 3, 20
#: Bytes of files that edges or nodes are sent to all tasks up to, and that a partition of larger ones comes from.
SENT_BYTES, PART_BYTES = 4 << 20, 4 << 20
#: Sizes from here on are Spark's word for unknown.
UNKNOWN_BYTES = 1 << 60


@dataclass(frozen=True)
class Step:
    """An edge label and the kind of node it leads to; `times` is how often it may be followed, least and most."""

    label: str
    to: str
    back: bool = False
    times: tuple[int, int] = (1, 1)


@dataclass(frozen=True)
class Pattern:
    start: str
    steps: tuple[Step, ...]


class Graph:
    """Edges (src, dst) by label, and nodes (id, ...) by kind where their attributes matter."""

    def __init__(self, edges: Mapping[str, DataFrame], nodes: Mapping[str, DataFrame] | None = None):
        self.edges, self.nodes = edges, nodes or {}

    def step(self, step: Step) -> DataFrame:
        """Edges (a, b) in the direction of a step, repeated ones too."""
        if step.label not in self.edges:
            raise ValueError(f"no edges are labelled {step.label}")
        a, b = ("dst", "src") if step.back else ("src", "dst")
        return self.edges[step.label].select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")

    def chosen(self, kind: str, condition: Column | None) -> DataFrame | None:
        """Ids of the nodes of a kind that meet a condition; None for all."""
        if condition is None:
            return None
        if kind not in self.nodes:
            raise ValueError(f"no nodes are of kind {kind}")
        return self.nodes[kind].where(condition).select("id")


class _Dealt:
    """Joins of a pattern's edges: small sides are sent, others dealt by the joined node into the same partitions."""

    def __init__(self, edges: Sequence[DataFrame]):
        spark, sizes = edges[0].sparkSession, [read_bytes(e) for e in edges]
        known = [n for n in sizes if n < UNKNOWN_BYTES]
        least = int(spark.conf.get("spark.sql.shuffle.partitions")) if len(known) < len(sizes) else spark.sparkContext.defaultParallelism
        self.parts = max(least, -(-max(known, default=0) // PART_BYTES))

    def by(self, df: DataFrame, node: str) -> DataFrame:
        return df.repartition(self.parts, node)

    def among(self, edges: DataFrame, end: str, ids: DataFrame) -> DataFrame:
        """Edges whose end is among ids (id)."""
        ids = ids.withColumnRenamed("id", end)
        # Spark deals the edges as the ids are dealt; a semi-join would be pushed below a dealing of theirs.
        return edges.join(F.broadcast(ids) if small(ids) else self.by(ids, end), end, "left_semi")

    def distinct(self, edges: DataFrame, end: str) -> DataFrame:
        """Distinct edges, dealt by an end unless they are small: what is repeated meets in that partition."""
        return (edges if small(edges) else self.by(edges, end)).distinct()


def small(df: DataFrame) -> bool:
    return read_bytes(df) <= SENT_BYTES


def _fixed(pattern: Pattern) -> list[Pattern]:
    """The pattern without repeated steps, once for each number of times they may be followed."""
    out: list[tuple[Step, ...]] = [()]
    for s in pattern.steps:
        least, most = s.times
        if not 1 <= least <= most:
            raise ValueError(f"a step is followed once at least: {s}")
        out = [(*head, *[Step(s.label, s.to, s.back)] * n) for head in out for n in range(least, most + 1)]
    return [Pattern(pattern.start, steps) for steps in out]


def match(graph: Graph, pattern: Pattern, where: Mapping[int, Column] | None = None) -> DataFrame:
    """(n0, n1, ..., nk): the distinct paths of a pattern, null beyond the end of those that repeat a step less often.

    where: conditions on the attributes of the node at a place, 0 for the start, of a pattern whose steps are all
    followed once; -1 is the end of any.
    """
    plans = _fixed(pattern)
    longest = max(len(p.steps) for p in plans)
    found = [_paths(graph, p, where or {}) for p in plans]
    names = [f"n{i}" for i in range(longest + 1)]
    whole = [f.select(*[F.col(c) if c in f.columns else F.lit(None).cast(f.schema[f"n{len(f.columns) - 1}"].dataType).alias(c) for c in names]) for f in found]
    return reduce(DataFrame.unionByName, whole)


def _paths(graph: Graph, pattern: Pattern, where: Mapping[int, Column]) -> DataFrame:
    kinds = [pattern.start, *[s.to for s in pattern.steps]]
    last = len(kinds) - 1
    conditions = [where.get(i, where.get(-1) if i == last else None) for i in range(len(kinds))]
    chosen = [graph.chosen(k, c) for k, c in zip(kinds, conditions, strict=True)]
    edges = [graph.step(s) for s in pattern.steps]
    dealt = _Dealt(edges)
    for i, ids in enumerate(chosen):  # what the nodes themselves exclude
        if ids is not None and i > 0:
            edges[i - 1] = dealt.among(edges[i - 1], "b", ids)
        if ids is not None and i < last:
            edges[i] = dealt.among(edges[i], "a", ids)
    for i in range(len(edges) - 2, 0, -1):  # edges that end where one after begins; the first ones meet those in the join
        edges[i] = dealt.among(edges[i], "b", edges[i + 1].select(F.col("a").alias("id")))
    paths = dealt.distinct(edges[0], "b").select(F.col("a").alias("n0"), F.col("b").alias("n1"))
    paths, by = _unrepeated(paths, kinds, 1), "n1" if not small(edges[0]) else None
    for i, e in enumerate(edges[1:], 2):
        at = f"n{i - 1}"
        more = dealt.distinct(e, "a").select(F.col("a").alias(at), F.col("b").alias(f"n{i}"))
        if small(e):
            more = F.broadcast(more)
        elif by != at:
            paths, by = dealt.by(paths, at), at
        paths = paths.join(more, at)
        paths = _unrepeated(paths.select(*[f"n{j}" for j in range(i + 1)]), kinds, i)
    return paths


def _unrepeated(paths: DataFrame, kinds: Sequence[str], at: int) -> DataFrame:
    for j in range(at):
        if kinds[j] == kinds[at]:
            paths = paths.where(F.col(f"n{j}") != F.col(f"n{at}"))
    return paths


def first_answer(graph: Graph, patterns: Sequence[tuple[Pattern, Mapping[int, Column]]], attempts: int = ATTEMPTS, listed: int = LISTED) -> tuple[int, DataFrame] | None:
    """(which, paths): the first of up to `attempts` patterns that fits the graph and has paths, with its first `listed`
    paths in order; None if none has. A pattern that names unknown labels, kinds or attributes is passed over."""
    for i, (pattern, where) in enumerate(patterns[:attempts]):
        try:
            paths = match(graph, pattern, where)
            rows = paths.orderBy(*paths.columns).limit(listed)
            if rows.take(1):
                return i, rows
        except Exception:  # noqa: BLE001  the next pattern may fit
            continue
    return None
