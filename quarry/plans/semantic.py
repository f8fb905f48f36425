"""Questions as specifications: a metric by dimensions, under filters, planned over the catalog's keys.

A specification names columns only. The joins follow from the catalog: from the metric's table along foreign keys to
the tables of the columns, each joined once. A foreign key as a dimension shows its label instead. The result is one
SELECT, which the guard checks like any other.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from quarry.sources.catalog import Catalog


@dataclass(frozen=True)
class QuerySpec:
    """metric: of the catalog, or None for a listing. dims: table.column, or (table.column, date grain).

    filters are SQL conditions on table.column. since: (table.column, interval) back from the column's last value.
    """

    table: str
    metric: str | None = None
    dims: tuple[str | tuple[str, str], ...] = ()
    filters: tuple[str, ...] = ()
    since: tuple[str, str] | None = None
    distinct: str | None = None
    order: tuple[str, ...] = ()
    limit: int | None = None
    share: bool = False


def _path(catalog: Catalog, start: str, goal: str) -> list[tuple[str, str, str, str]]:
    """(table, column, other table, other column) of the foreign keys that lead from one table to another."""
    todo, seen = deque([(start, [])]), {start}
    while todo:
        name, path = todo.popleft()
        if name == goal:
            return path
        for c in catalog.table(name).fks():
            if c.ref_table and c.ref_table not in seen:
                seen.add(c.ref_table)
                todo.append((c.ref_table, [*path, (name, c.name, c.ref_table, c.ref_column)]))
    raise ValueError(f"no foreign keys lead from {start} to {goal}")


def labelled(catalog: Catalog, dim: str) -> str:
    """The column to show for a dimension: a foreign key's label, or itself."""
    table, _, name = dim.partition(".")
    c = catalog.table(table).column(name)
    return f"{c.ref_table}.{c.label_column}" if c and c.role == "foreign_key" and c.label_column else dim


def compile_spec(catalog: Catalog, spec: QuerySpec) -> str:
    dims = [(labelled(catalog, d), None) if isinstance(d, str) else (d[0], d[1]) for d in spec.dims]
    used = [d for d, _ in dims] + [w for f in spec.filters for w in f.replace("(", " ").replace(")", " ").split() if "." in w and catalog.table(w.partition(".")[0])]
    joins: dict[str, tuple[str, str, str, str]] = {}
    for column in used:
        for step in _path(catalog, spec.table, column.partition(".")[0]):
            joins.setdefault(step[2], step)
    shown = [f"date_trunc('{grain}', {d}) AS {grain}" if grain else f"{d} AS {d.partition('.')[2]}" for d, grain in dims]
    grouped = [f"date_trunc('{grain}', {d})" if grain else d for d, grain in dims]
    value = []
    if spec.metric:
        expression = f"COUNT(DISTINCT {spec.distinct})" if spec.distinct else catalog.metric(spec.metric).expression
        value = [f"{expression} AS {spec.metric}"]
        if spec.share:
            value.append(f"CAST({expression} AS DOUBLE) / SUM({expression}) OVER () AS share")
    where = list(spec.filters)
    if spec.since:
        column, span = spec.since
        where.append(f"{column} >= (SELECT MAX({column}) FROM {column.partition('.')[0]}) - INTERVAL {span}")
    sql = f"SELECT {', '.join(shown + value)} FROM {spec.table}"
    sql += "".join(f" JOIN {other} ON {table}.{column} = {other}.{key}" for table, column, other, key in joins.values())
    sql += f" WHERE {' AND '.join(where)}" if where else ""
    sql += f" GROUP BY {', '.join(grouped)}" if spec.metric and grouped else ""
    sql += f" ORDER BY {', '.join(spec.order)}" if spec.order else ""
    return sql + (f" LIMIT {spec.limit}" if spec.limit is not None else "")
