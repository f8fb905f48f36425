"""The semantic catalog: tables, columns, metrics and the columns a metric needs.

A catalog is four small tables. `Catalog` holds it on the driver for planning; `frames` gives it as DataFrames, which
the merge of two snapshots and the lookups work on.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store

TABLE_SCHEMA = "name string, role string, description string"
COLUMN_SCHEMA = "id string, table_name string, name string, role string, type string, description string, aliases array<string>, examples array<string>, sync boolean, ref_table string, ref_column string, label_column string"
METRIC_SCHEMA = "name string, table_name string, expression string, description string, aliases array<string>, relevant_columns array<string>"
LINK_SCHEMA = "metric string, column_id string"
KEY_ROLES = ("primary_key", "foreign_key")


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    role: str = "dimension"
    type: str = "string"
    description: str = ""
    aliases: tuple[str, ...] = ()
    examples: tuple[str, ...] = ()
    sync: bool = False
    ref_table: str | None = None
    ref_column: str | None = None
    label_column: str | None = None


@dataclass(frozen=True)
class TableInfo:
    name: str
    role: str = "dim"
    description: str = ""
    columns: tuple[ColumnInfo, ...] = ()

    def pk(self) -> list[str]:
        return [c.name for c in self.columns if c.role == "primary_key"]

    def fks(self) -> list[ColumnInfo]:
        return [c for c in self.columns if c.role == "foreign_key"]

    def key_columns(self) -> list[str]:
        return [c.name for c in self.columns if c.role in KEY_ROLES]

    def column(self, name: str) -> ColumnInfo | None:
        return next((c for c in self.columns if c.name == name), None)


@dataclass(frozen=True)
class MetricInfo:
    name: str
    table_name: str
    expression: str
    description: str = ""
    aliases: tuple[str, ...] = ()
    relevant_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Catalog:
    tables: tuple[TableInfo, ...] = ()
    metrics: tuple[MetricInfo, ...] = field(default=())

    @classmethod
    def from_dict(cls, d: dict) -> Catalog:
        """Absent texts are "", lists empty, flags false."""
        column = lambda c: ColumnInfo(c["name"], c.get("role", "dimension"), c.get("type", "string"), c.get("description", ""), tuple(c.get("aliases") or ()), tuple(c.get("examples") or ()), bool(c.get("sync", False)), c.get("ref_table"), c.get("ref_column"), c.get("label_column"))
        tables = tuple(TableInfo(t["name"], t.get("role", "dim"), t.get("description", ""), tuple(map(column, t.get("columns") or ()))) for t in d.get("tables") or ())
        metrics = tuple(MetricInfo(m["name"], m.get("table_name", ""), m.get("expression", "COUNT(*)"), m.get("description", ""), tuple(m.get("aliases") or ()), tuple(m.get("relevant_columns") or ())) for m in d.get("metrics") or ())
        return cls(tables, metrics)

    @classmethod
    def from_file(cls, path: str) -> Catalog:
        """From JSON, or YAML where a YAML reader is installed."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.from_dict(yaml.safe_load(text) or {})
        return cls.from_dict(json.loads(text))

    def table(self, name: str) -> TableInfo | None:
        return next((t for t in self.tables if t.name == name), None)

    def metric(self, name: str) -> MetricInfo | None:
        return next((m for m in self.metrics if m.name == name), None)

    def all_columns(self) -> list[tuple[str, ColumnInfo]]:
        return [(t.name, c) for t in self.tables for c in t.columns]

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """tables, columns (id = table.column), metrics and links as DataFrames."""
        columns = [(f"{t}.{c.name}", t, c.name, c.role, c.type, c.description, list(c.aliases), list(c.examples), c.sync, c.ref_table, c.ref_column, c.label_column) for t, c in self.all_columns()]
        metrics = [(m.name, m.table_name, m.expression, m.description, list(m.aliases), list(m.relevant_columns)) for m in self.metrics]
        return {
            "tables": spark.createDataFrame([(t.name, t.role, t.description) for t in self.tables], TABLE_SCHEMA),
            "columns": spark.createDataFrame(columns, COLUMN_SCHEMA),
            "metrics": spark.createDataFrame(metrics, METRIC_SCHEMA),
            "links": spark.createDataFrame([(m.name, c) for m in self.metrics for c in m.relevant_columns], LINK_SCHEMA),
        }


def columns_of(columns: DataFrame, table: str) -> DataFrame:
    return columns.where(F.col("table_name") == table)


def key_columns(columns: DataFrame, table: str) -> DataFrame:
    return columns_of(columns, table).where(F.col("role").isin(*KEY_ROLES))


def nested_table(tables: DataFrame, columns: DataFrame, name: str) -> DataFrame:
    """One table with its columns as an array, in order of name."""
    cols = columns_of(columns, name).groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("name", "role", "type", "description"))).alias("columns"))
    return tables.where(F.col("name") == name).join(cols, F.col("name") == F.col("table_name"), "left").drop("table_name")


def metrics_of(metrics: DataFrame, name: str | None = None) -> DataFrame:
    """All metrics, or that of a name; absent lists are empty."""
    rows = metrics if name is None else metrics.where(F.col("name") == name)
    empty = F.array().cast("array<string>")
    return rows.withColumns({c: F.coalesce(c, empty) for c in ("aliases", "relevant_columns")})


def value_index(columns: DataFrame) -> DataFrame:
    """(id, table_name, column_name, value): a row for each alias of the columns that are kept in sync."""
    rows = columns.where("sync and size(aliases) > 0").select("id", "table_name", F.col("name").alias("column_name"), F.explode("aliases").alias("value"))
    return rows.select(F.concat_ws(".", "id", "value").alias("id"), "table_name", "column_name", "value")


def distinct_values(rows: DataFrame, table: str, column: str) -> DataFrame:
    """The value index of a column's own values instead of its aliases."""
    value = rows.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    return value.select(F.concat_ws(".", F.lit(table), F.lit(column), "value").alias("id"), F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "value")


def profile(catalog: Catalog, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(id, n_rows, n_values, n_distinct) of every column of the catalog whose table is given, in one pass over each."""
    found = []
    for t in catalog.tables:
        if t.name not in tables:
            continue
        figures = [F.struct(F.lit(f"{t.name}.{c.name}").alias("id"), F.count(F.lit(1)).alias("n_rows"), F.count(c.name).alias("n_values"), F.count_distinct(c.name).alias("n_distinct")) for c in t.columns]
        found.append(tables[t.name].agg(F.array(*figures).alias("f")).select(F.inline("f")))
    return reduce(DataFrame.unionByName, found)


def embedding_text(name: SparkColumn, description: SparkColumn, aliases: SparkColumn) -> SparkColumn:
    """The text that stands for a column or metric in a vector index."""
    return F.concat_ws("; ", name, F.nullif(description, F.lit("")), F.nullif(F.array_join(aliases, ", "), F.lit("")))


def merge_plan(old: DataFrame, new: DataFrame, key: Iterable[str], compared: Iterable[str]) -> DataFrame:
    """key columns and action (insert, update, delete, keep) that lead from one snapshot to another: a dry run."""
    key, compared = list(key), list(compared)
    o = old.select(*key, F.struct(*compared).alias("_old"))
    n = new.select(*key, F.struct(*compared).alias("_new"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update").otherwise("keep")
    return o.join(n, key, "full_outer").select(*key, action.alias("action"))


def merged(old: DataFrame, new: DataFrame, key: Iterable[str], delete_missing: bool = True) -> DataFrame:
    """The state after the merge: new's rows, and unless what is missing is deleted, the rows that only old has."""
    if delete_missing:
        return new
    return old.join(new, list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def cascaded(links: DataFrame, owners: DataFrame, column: str, key: str) -> DataFrame:
    """Links whose owner (column of links, key of owners) is still there."""
    return links.join(owners.select(F.col(key).alias(column)).distinct(), column, "left_semi")


def applied(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame], keys: Mapping[str, list[str]], compared: Mapping[str, list[str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables after an incremental build, counts by table and action). The table `links` follows its metrics and
    columns: those of deleted ones go with them."""
    plans = [merge_counts(merge_plan(old[t], new[t], keys[t], compared[t])).withColumn("table", F.lit(t)) for t in keys]
    after = {t: merged(old[t], new[t], keys[t]) for t in keys}
    links = merged(old["links"], new["links"], new["links"].columns)
    after["links"] = cascaded(cascaded(links, after["metrics"], "metric", "name"), after["columns"], "column_id", "id")
    return after, reduce(DataFrame.unionByName, plans).select("table", "action", "n")


#: Key columns of a catalog's tables, and those that tell whether a row has changed.
KEYS = {"tables": ["name"], "columns": ["id"], "metrics": ["name"], "links": ["metric", "column_id"]}


def compatible(stored: DataFrame, wanted: DataFrame, key: Iterable[str]) -> bool:
    """Whether stored rows can take wanted ones: the same key types, and all columns of these there with their types."""
    have, need = dict(stored.dtypes), dict(wanted.dtypes)
    return all(have.get(k) == need.get(k) for k in key) and all(have.get(c) == t for c, t in need.items())


def committed(store: Store, new: Mapping[str, DataFrame], rebuild: bool = False, dry_run: bool = False) -> DataFrame:
    """(table, action, n): brings a stored catalog (tables, columns, metrics, links) to `new` in one commit.

    Incremental by default: rows that are new, changed or gone are written, by the buckets they are in, and links follow
    their metrics and columns. A store without a catalog, or with tables of another form, is built whole, as with
    rebuild. A dry run tells what would happen. Readers see all four tables of one version, whatever happens half-way.
    """
    based_on = store.version()
    links = cascaded(cascaded(new["links"].distinct(), new["metrics"], "metric", "name"), new["columns"], "column_id", "id")
    after = {**{t: new[t] for t in KEYS if t != "links"}, "links": links}
    there = set(KEYS) <= set(store.tables())
    if rebuild or not there or not all(compatible(store.read(t), after[t], KEYS[t]) for t in KEYS):
        counts = reduce(DataFrame.unionByName, [after[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), F.lit("rebuild").alias("action"), "n") for t in KEYS])
        changes = [] if dry_run else [store.replaced(t, after[t], KEYS[t]) for t in KEYS]
    else:
        plans = {t: merge_plan(store.read(t, based_on), after[t], KEYS[t], [c for c in after[t].columns if c not in KEYS[t]] or KEYS[t]) for t in KEYS}
        counts = reduce(DataFrame.unionByName, [merge_counts(p).select(F.lit(t).alias("table"), "action", "n") for t, p in plans.items()])
        changes = []
        for t, plan in plans.items() if not dry_run else ():
            fresh = after[t].join(plan.where("action in ('insert', 'update')").select(*KEYS[t]), KEYS[t], "left_semi")
            changes.append(store.upserted(t, fresh.select(*after[t].columns), plan.where("action <> 'keep'").select(*KEYS[t]), based_on))
    counts = counts.sparkSession.createDataFrame(counts.collect(), "table string, action string, n long")  # before it changes
    if changes:
        store.commit(changes, based_on)
    return counts


def merge_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def link_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links to add and to drop between two snapshots of a link table."""
    on = old.columns
    return new.join(old, on, "left_anti").withColumn("action", F.lit("insert")).unionByName(old.join(new, on, "left_anti").withColumn("action", F.lit("delete")))


def without_stale(index: DataFrame, current: DataFrame, id_col: str = "id") -> DataFrame:
    return index.join(current.select(id_col).distinct(), id_col, "left_semi")


def upserted(index: DataFrame, rows: DataFrame, id_col: str = "id") -> DataFrame:
    return index.join(rows.select(id_col), id_col, "left_anti").unionByName(rows, allowMissingColumns=True)
