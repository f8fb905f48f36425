"""The analytic questions over the star schema. "Recent" counts back from the last date in the data."""

from __future__ import annotations

from .semantic import QuerySpec

_LINE = ("lineitem.l_shipdate", "lineitem.l_orderkey", "lineitem.l_linenumber", "lineitem.l_partkey", "lineitem.l_suppkey", "lineitem.l_quantity", "lineitem.l_extendedprice")
_LINE_ORDER = ("l_shipdate DESC", "l_orderkey DESC", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")

QUESTIONS: dict[str, tuple[str, QuerySpec]] = {
    "q01_issues_by_line": ("How many issues does each business line have?", QuerySpec("orders", "issue_count", ("customer.c_mktsegment",))),
    "q02_urgent_issues": ("How many urgent issues are there?", QuerySpec("orders", "issue_count", filters=("orders.o_orderpriority = '1-URGENT'",))),
    "q03_status_last_month": ("Issue status in the last month", QuerySpec("orders", "issue_count", ("orders.o_orderstatus",), since=("orders.o_orderdate", "1 MONTH"))),
    "q04_issues_by_domain": ("Issues per responsible domain, ranked", QuerySpec("orders", "issue_count", ("customer.c_nationkey",), order=("issue_count DESC", "n_name"), limit=100)),
    "q05_latest_issues": ("The latest 10 issues", QuerySpec("orders", None, ("orders.o_orderdate", "orders.o_orderkey", "orders.o_orderstatus"), order=("o_orderdate DESC", "o_orderkey DESC"), limit=10)),
    "q06_source_share": ("Share of issues by source", QuerySpec("orders", "issue_count", ("orders.o_orderpriority",), share=True)),
    "q07_closed_by_line": ("Closed issues by business line", QuerySpec("orders", "issue_count", ("customer.c_mktsegment",), filters=("orders.o_orderstatus = 'F'",))),
    "q08_issues_by_model": ("Issues per model code", QuerySpec("lineitem", "cr_count", ("part.p_brand",), distinct="lineitem.l_orderkey")),
    "q09_changes_by_line": ("Change requests by business line", QuerySpec("lineitem", "cr_count", ("customer.c_mktsegment",))),
    "q10_pending_changes": ("Pending change requests", QuerySpec("lineitem", None, _LINE, filters=("lineitem.l_linestatus = 'O'",), order=_LINE_ORDER, limit=100)),
    "q11_change_trend": ("Monthly trend of change requests over three months", QuerySpec("lineitem", "cr_count", (("lineitem.l_shipdate", "month"),), since=("lineitem.l_shipdate", "3 MONTH"))),
    "q12_change_status": ("Change requests by status", QuerySpec("lineitem", "cr_count", ("lineitem.l_returnflag", "lineitem.l_linestatus"))),
    "q13_recent_changes": ("Recent change requests", QuerySpec("lineitem", None, _LINE, order=_LINE_ORDER, limit=100)),
    "q14_requirements_by_type": ("Requirements by line", QuerySpec("part", "requirement_count", ("part.p_type",))),
    "q15_high_priority": ("High-priority requirements", QuerySpec("part", "requirement_count", filters=("part.p_size >= 40",))),
    "q16_requirement_status": ("Requirements by status", QuerySpec("part", "requirement_count", ("part.p_brand",))),
    "q17_latest_requirements": ("The latest requirements", QuerySpec("part", None, ("part.p_partkey", "part.p_name", "part.p_brand"), order=("p_partkey DESC",), limit=20)),
    "q19_baselines": ("Domains and their baselines", QuerySpec("nation", None, ("nation.n_name", "nation.n_regionkey"))),
    "q20_items_by_category": ("Configuration items by category", QuerySpec("supplier", "item_count", ("supplier.s_nationkey",))),
    "q21_safety_items": ("Safety-related configuration items", QuerySpec("supplier", "item_count", filters=("supplier.s_acctbal < 0",))),
}
