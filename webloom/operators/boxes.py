"""Page layout boxes: hit test (J7) and visible nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 64.0  # edge of the finest grid cells; each level is four times as coarse
LEVELS = 8
# Tags that are never shown, and tags shown without text.
NOT_SHOWN = ("html", "head", "meta", "link", "title", "body")
SHOWN_EMPTY = ("article", "section", "img")


_CELL = ["page_id", "_level", "_cx", "_cy"]


def cell_boxes(boxes: DataFrame) -> DataFrame:
    """The boxes of every grid cell that can be the smallest one at some point of it: _CELL, node_id, _x, _y, _w, _h.

    A box goes to the level whose cells are about its size, so it is listed in at most 25 cells. The smallest of the
    boxes that cover a whole cell contains every point of it, so larger boxes fall out of the cell.
    """
    longest = F.greatest("w", "h")
    level = F.least(
        F.lit(LEVELS - 1), F.greatest(F.lit(0), F.ceil(F.log(4.0, longest / F.lit(CELL * 4))))
    ).cast("int")
    solid = boxes.filter((F.col("w") > 0) & (F.col("h") > 0)).withColumn("_level", level)
    size = _size()

    def cells(start: str, length: str) -> Column:
        return F.sequence(F.floor(F.col(start) / size), F.floor((F.col(start) + F.col(length)) / size))

    listed = (
        solid.withColumn("_cx", F.explode(cells("x", "w")))
        .withColumn("_cy", F.explode(cells("y", "h")))
        .select("page_id", "_level", "_cx", "_cy", "node_id", *[F.col(c).alias(f"_{c}") for c in "xywh"])
    )
    x, y = F.col("_cx") * size, F.col("_cy") * size
    covers = (F.col("_x") <= x) & (F.col("_x") + F.col("_w") >= x + size) & (F.col("_y") <= y) & (F.col("_y") + F.col("_h") >= y + size)
    order = F.struct((F.col("_w") * F.col("_h")).alias("area"), F.col("node_id"))
    least = listed.filter(covers).groupBy(*_CELL).agg(F.min(order).alias("_least"))
    # Estimates know nothing of the cells a box is listed in; without the hint the boxes may be broadcast.
    known = listed.join(least.hint("merge"), _CELL, "left")
    return known.filter(F.col("_least").isNull() | (order <= F.col("_least"))).drop("_least")


def _size() -> Column:
    return F.lit(CELL) * F.pow(F.lit(4.0), F.col("_level"))


def hit_test(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Smallest box with an area that contains each point, first one on ties.

    ``points``: page_id, point_id, x, y; ``boxes``: page_id, node_id, x, y, w, h. Both sides meet on
    (page, grid level, cell); a point looks into its cell of every level. A page with very many points is
    spread over its cells, and a point meets only boxes near it.
    """
    size = _size()
    placed = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).withColumns(
        {"_cx": F.floor(F.col("x") / size), "_cy": F.floor(F.col("y") / size)}
    )
    inside = F.col("x").between(F.col("_x"), F.col("_x") + F.col("_w")) & F.col("y").between(
        F.col("_y"), F.col("_y") + F.col("_h")
    )
    best = F.min(F.struct((F.col("_w") * F.col("_h")).alias("area"), F.col("node_id"))).alias("_b")
    return (
        placed.join(cell_boxes(boxes).hint("merge"), _CELL)
        .filter(inside)
        .groupBy("page_id", "point_id")
        .agg(best)
        .select("page_id", "point_id", F.col("_b.node_id").alias("node_id"), F.col("_b.area").alias("area"))
    )


def visible_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes a reader sees (P12): shown tag, a box with an area where boxes are known, and some text."""
    text = F.when(F.col("own_text") != "", F.col("own_text")).otherwise(F.col("text"))
    out = nodes.filter(~F.col("tag").isin(*NOT_SHOWN)).withColumn("text", F.substring(text, 1, 80))
    if "box" in nodes.columns:
        out = out.filter((F.col("box.w") > 0) & (F.col("box.h") > 0))
    return out.filter((F.trim("text") != "") | F.col("tag").isin(*SHOWN_EMPTY))
