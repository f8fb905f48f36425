"""Where to crop a table or a formula out of a page: arithmetic over boxes, joined by page.

Blocks come in coordinates of a page NORM wide; pages and their text blocks in points. Pixels are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The width of a page in a parser's coordinates; margins of a table and of a formula (left, above, right,
# below) in points; the least side of a crop.
NORM = 842.0
MARGINS = {"table": (0.0, 0.0, 30.0, 60.0), "formula": (6.0, 14.0, 20.0, 18.0)}
LEAST = 20.0


def crops(blocks: DataFrame, pages: DataFrame, texts: DataFrame) -> DataFrame:
    """(block_id, doc_id, page, kind, x0, y0, x1, y1) in points, of the blocks whose crop has two sides of LEAST.

    blocks: block_id, doc_id, page, kind (table or formula), bbox (four numbers); pages: doc_id, page, width, height;
    texts: doc_id, page, x0, y0, x1, y1. A table's box is often too short, so it has wide margins and grows right and
    down to the text blocks that it overlaps with them. Crops end with the page. Text blocks meet the blocks of their
    page only; the greatest ends are taken before rows leave the join. Blocks of unknown pages, without a box or of
    another kind are left out.
    """
    whole = blocks.where((F.size("bbox") == 4) & F.forall("bbox", lambda x: x.isNotNull()) & F.col("kind").isin(*MARGINS))
    placed = whole.join(pages.select("doc_id", "page", F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h")), ["doc_id", "page"])
    margin = lambda i: F.when(F.col("kind") == "table", MARGINS["table"][i]).otherwise(MARGINS["formula"][i])
    at = lambda i: F.get("bbox", i).cast("double") * F.col("w") / NORM
    placed = placed.select("block_id", "doc_id", "page", "kind", "w", "h", *[(at(i) + (-margin(i) if i < 2 else margin(i))).alias(f"p{i}") for i in range(4)])
    overlap = (F.col("x0") < F.col("p2")) & (F.col("x1") > F.col("p0")) & (F.col("y0") < F.col("p3")) & (F.col("y1") > F.col("p1"))
    tables = placed.where("kind = 'table'").select("block_id", "doc_id", "page", *[f"p{i}" for i in range(4)])
    snapped = tables.join(texts, ["doc_id", "page"]).where(overlap).groupBy("block_id").agg(F.max("x1").alias("right"), F.max("y1").alias("low"))
    grown = placed.join(snapped, "block_id", "left")
    edge = {"x0": F.greatest("p0", F.lit(0.0)), "y0": F.greatest("p1", F.lit(0.0)), "x1": F.least(F.greatest("p2", F.coalesce("right", "p2")), "w"), "y1": F.least(F.greatest("p3", F.coalesce("low", "p3")), "h")}
    out = grown.select("block_id", "doc_id", "page", "kind", *[c.alias(n) for n, c in edge.items()])
    return out.where((F.col("x1") - F.col("x0") >= LEAST) & (F.col("y1") - F.col("y0") >= LEAST))
