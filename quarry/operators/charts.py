"""Data behind charts: which one fits a result, and its series, slices or cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import to_number

MAX_BARS, MAX_SLICES = 12, 6
#: Categories on an axis of series and heatmaps; more are an error, not a cut.
MAX_CATEGORIES = 10_000


def axis(df: DataFrame, x: str | None, y: str | None) -> tuple[str, str]:
    """Columns to draw: an unknown x is the first, an unknown y the last."""
    return x if x in df.columns else df.columns[0], y if y in df.columns else df.columns[-1]


def recommend(df: DataFrame) -> str:
    """line over time, scatter of two numbers, pie of few shares, bar of some categories, heatmap of two, else table."""
    kinds = [f.dataType for f in df.schema]
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    others = [f.name for f in df.schema if f.name not in numeric]
    if not numeric or len(df.columns) < 2:
        return "table"
    if any(isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType)) for k in kinds):
        return "line"
    if not others:
        return "scatter" if len(numeric) == 2 else "table"
    if len(others) == 2 and len(numeric) == 1:
        return "heatmap"
    n = df.select(F.approx_count_distinct(others[0])).first()[0]
    if "share" in df.columns and n <= MAX_SLICES:
        return "pie"
    return "bar" if n <= MAX_BARS else "table"


def series(rows: DataFrame, x: str, group: str, value: str, order: list[str]) -> DataFrame:
    """(group, x, value) for every group and category: the first row of each pair in `order`, 0 where there is none."""
    first = rows.groupBy(group, x).agg(F.min_by(to_number(F.col(value)), F.struct(*order)).alias("value"))
    xs = [r[0] for r in rows.select(x).distinct().limit(MAX_CATEGORIES + 1).collect()]
    if len(xs) > MAX_CATEGORIES:
        raise ValueError(f"{x} has more than {MAX_CATEGORIES} categories, which no chart can show")
    grid = rows.select(group).distinct().withColumn(x, F.explode(F.array(*map(F.lit, xs)))) if xs else first.select(group, x)
    return grid.join(first, [group, x], "left").select(group, x, F.coalesce("value", F.lit(0.0)).alias("value"))


def pivot(rows: DataFrame, y: str, x: str, value: str, columns: list | None = None) -> DataFrame:
    return rows.groupBy(y).pivot(x, columns).sum(value)


def cells(rows: DataFrame, x: str, y: str, value: str, order: list[str]) -> DataFrame:
    """Heatmap cells (xi, yi, value) with places in the order in which `order` first shows a category, and the largest
    value. Places are numbered over the categories, a bounded number."""
    summed = rows.groupBy(x, y).agg(F.sum(value).alias("value"), F.min(F.struct(*order)).alias("_at"))

    def places(c: str, name: str) -> DataFrame:
        firsts = summed.groupBy(c).agg(F.min("_at").alias("_at")).orderBy("_at", c).limit(MAX_CATEGORIES + 1).select(c).collect()
        if len(firsts) > MAX_CATEGORIES:
            raise ValueError(f"{c} has more than {MAX_CATEGORIES} categories, which no chart can show")
        return rows.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(firsts)], f"`{c}` {dict(rows.dtypes)[c]}, {name} int")

    most = summed.agg(F.max("value").alias("most"))
    return summed.join(F.broadcast(places(x, "xi")), x).join(F.broadcast(places(y, "yi")), y).crossJoin(F.broadcast(most)).select("xi", "yi", "value", "most")


def correlations(df: DataFrame) -> DataFrame:
    """(a, b, corr) of all pairs of numeric columns in one pass."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    listed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.inline(listed))


def serializable(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as text, bytes as UTF-8."""

    def shown(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return c.cast("string").alias(f.name)
        return F.decode(c, "UTF-8").alias(f.name) if isinstance(f.dataType, T.BinaryType) else c

    return df.select(*map(shown, df.schema))


def number(value: object) -> float | int:
    """A value as a number, a whole one as an int; 0 for what reads as none."""
    try:
        x = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return 0
    return int(x) if x.is_integer() else x


def _lines(kind: str):
    """One series, or one for each value of `by`: the first row of a category counts, a missing one is 0."""

    def build(data: list[dict], x: str, y: str, by: str | None) -> dict:
        if by is None:
            return {"type": kind, "x": [r[x] for r in data], "series": [{"name": y, "data": [number(r[y]) for r in data]}]}
        names = list(dict.fromkeys(r[x] for r in data))
        values: dict = {}
        for r in data:
            values.setdefault(r[by], {}).setdefault(r[x], number(r[y]))
        return {"type": kind, "x": names, "series": [{"name": g, "data": [v.get(n, 0) for n in names]} for g, v in values.items()]}

    return build


def _heatmap(data: list[dict], x: str, y: str, by: str | None) -> dict:
    """Cells (place of x, place of y, value) over the categories of x and `by`, and the greatest value."""
    if by is None:
        return _table(data, x, y, by) | {"type": "heatmap"}
    xs, ys = ({v: i for i, v in enumerate(dict.fromkeys(r[c] for r in data))} for c in (x, by))
    cells: dict[tuple[int, int], float] = {}
    for r in data:
        at = xs[r[x]], ys[r[by]]
        cells[at] = cells.get(at, 0) + number(r[y])
    return {"type": "heatmap", "x": list(xs), "y": list(ys), "data": [[i, j, number(v)] for (i, j), v in cells.items()], "max": number(max(cells.values(), default=0))}


def _table(data: list[dict], x: str, y: str, by: str | None) -> dict:
    return {"type": "table", "columns": list(data[0]) if data else [], "rows": data}


#: Builders of descriptions by kind of chart; unknown kinds are tables.
BUILDERS = {
    "bar": _lines("bar"), "line": _lines("line"), "heatmap": _heatmap, "table": _table,
    "pie": lambda data, x, y, by: {"type": "pie", "data": [{"name": r[x], "value": number(r[y])} for r in data]},
    "scatter": lambda data, x, y, by: {"type": "scatter", "data": [[number(r[x]), number(r[y])] for r in data]},
}


def option(df: DataFrame, kind: str, x: str | None = None, y: str | None = None, rows: int = 1000, by: str | None = None) -> dict:
    """A chart description with its data, the rows in their order. by: a column whose values are series of their own, or the
    other axis of a heatmap. More than `rows` rows are an error: a chart of that many is to be aggregated first."""
    x, y = axis(df, x, y)
    data = [r.asDict() for r in serializable(df).limit(rows + 1).collect()]
    if len(data) > rows:
        raise ValueError(f"more than {rows} rows to draw")
    return BUILDERS.get(kind, _table)(data, x, y, by if by in df.columns else None)
