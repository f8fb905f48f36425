"""The star schema of the sample tables as a catalog, and the tables as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import Catalog

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _c(name: str, role: str, type_: str = "string", aliases: tuple[str, ...] = (), ref: str | None = None, label: str | None = None, sync: bool = False) -> dict:
    table, _, column = (ref or "").partition(".")
    return {"name": name, "role": role, "type": type_, "aliases": aliases, "ref_table": table or None, "ref_column": column or None, "label_column": label, "sync": sync}


STAR = Catalog.from_dict({
    "tables": [
        {"name": "region", "role": "dim", "description": "baselines", "columns": [_c("r_regionkey", "primary_key", "int"), _c("r_name", "dimension", aliases=("baseline", "baselines"), sync=True)]},
        {"name": "nation", "role": "dim", "description": "responsible domains", "columns": [_c("n_nationkey", "primary_key", "int"), _c("n_name", "dimension", aliases=("domain", "domains", "responsible domain"), sync=True), _c("n_regionkey", "foreign_key", "int", ref="region.r_regionkey", label="r_name")]},
        {"name": "customer", "role": "dim", "description": "reporters and their business line", "columns": [_c("c_custkey", "primary_key", "long"), _c("c_name", "dimension"), _c("c_nationkey", "foreign_key", "int", ref="nation.n_nationkey", label="n_name"), _c("c_acctbal", "measure", "double"), _c("c_mktsegment", "dimension", aliases=("business line", "line", "segment"), sync=True)]},
        {"name": "supplier", "role": "dim", "description": "configuration items", "columns": [_c("s_suppkey", "primary_key", "long"), _c("s_name", "dimension", aliases=("config item",)), _c("s_nationkey", "foreign_key", "int", aliases=("category",), ref="nation.n_nationkey", label="n_name"), _c("s_acctbal", "measure", "double", aliases=("safety",))]},
        {"name": "part", "role": "dim", "description": "requirements", "columns": [_c("p_partkey", "primary_key", "long"), _c("p_name", "dimension", aliases=("requirement",)), _c("p_brand", "dimension", aliases=("model", "model code"), sync=True), _c("p_type", "dimension", aliases=("type",)), _c("p_size", "dimension", "int", aliases=("priority",)), _c("p_retailprice", "measure", "double")]},
        {"name": "orders", "role": "fact", "description": "issues", "columns": [_c("o_orderkey", "primary_key", "long"), _c("o_custkey", "foreign_key", "long", ref="customer.c_custkey", label="c_name"), _c("o_orderstatus", "dimension", aliases=("issue status", "status"), sync=True), _c("o_totalprice", "measure", "double"), _c("o_orderdate", "date", "timestamp_ntz", aliases=("issue date",)), _c("o_orderpriority", "dimension", aliases=("severity", "source"), sync=True)]},
        {"name": "lineitem", "role": "fact", "description": "change requests", "columns": [_c("l_orderkey", "foreign_key", "long", ref="orders.o_orderkey"), _c("l_partkey", "foreign_key", "long", ref="part.p_partkey", label="p_name"), _c("l_suppkey", "foreign_key", "long", ref="supplier.s_suppkey", label="s_name"), _c("l_linenumber", "dimension", "int"), _c("l_quantity", "measure", "double"), _c("l_extendedprice", "measure", "double"), _c("l_discount", "measure", "double"), _c("l_tax", "measure", "double"), _c("l_returnflag", "dimension"), _c("l_linestatus", "dimension", aliases=("change status",), sync=True), _c("l_shipdate", "date", "timestamp_ntz", aliases=("change date",))]},
    ],
    "metrics": [
        {"name": "issue_count", "table_name": "orders", "expression": "COUNT(*)", "aliases": ("issues", "number of issues"), "relevant_columns": ("orders.o_orderkey",)},
        {"name": "cr_count", "table_name": "lineitem", "expression": "COUNT(*)", "aliases": ("change requests", "changes"), "relevant_columns": ("lineitem.l_orderkey",)},
        {"name": "requirement_count", "table_name": "part", "expression": "COUNT(*)", "aliases": ("requirements",), "relevant_columns": ("part.p_partkey",)},
        {"name": "item_count", "table_name": "supplier", "expression": "COUNT(*)", "aliases": ("config items", "configuration items"), "relevant_columns": ("supplier.s_suppkey",)},
    ],
})
