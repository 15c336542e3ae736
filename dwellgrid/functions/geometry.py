"""Box and polygon expressions over plain columns; all evaluate inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_TOLERANCE = 1.0


def box_area(box: Column) -> Column:
    return (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for disjoint boxes or an empty union."""
    zero = F.lit(0.0)
    width = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    height = F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    inter = width * height
    union = box_area(a) + box_area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(zero)


def foot_x(box: Column) -> Column:
    return (box["x1"] + box["x2"]) / 2


def foot_y(box: Column) -> Column:
    return box["y2"]


def polygon_edges(polygon: Column) -> Column:
    """Edges of the closed ring with their direction and squared length; empty below three vertices."""
    following = F.concat(F.slice(polygon, F.lit(2), F.size(polygon)), F.slice(polygon, 1, 1))

    def edge(a: Column, b: Column) -> Column:
        dx, dy = b[0] - a[0], b[1] - a[1]
        return F.struct(
            a[0].alias("ax"), a[1].alias("ay"), b[1].alias("by"), dx.alias("dx"), dy.alias("dy"),
            F.when(dx * dx + dy * dy > 0, dx * dx + dy * dy).otherwise(1.0).alias("len2"),
            F.when(dy != 0, dx / F.when(dy != 0, dy)).otherwise(0.0).alias("slope"),
        )

    edges = F.zip_with(polygon, following, edge)
    return F.when(F.size(polygon) >= 3, edges).otherwise(F.slice(edges, 1, 0))


def polygon_bounds(polygon: Column) -> Column:
    """Bounding box, wide enough for the edge tolerance."""
    xs, ys = F.transform(polygon, lambda v: v[0]), F.transform(polygon, lambda v: v[1])
    t = EDGE_TOLERANCE
    return F.struct(
        (F.array_min(xs) - t).alias("x1"), (F.array_min(ys) - t).alias("y1"),
        (F.array_max(xs) + t).alias("x2"), (F.array_max(ys) + t).alias("y2"),
    )


def in_bounds(x: Column, y: Column, box: Column) -> Column:
    return (x >= box["x1"]) & (x <= box["x2"]) & (y >= box["y1"]) & (y <= box["y2"])


def _offset(x: Column, y: Column, e: Column) -> Column:
    """Point relative to the edge's start, and where along the edge (0..1) the nearest point lies."""
    along = ((x - e["ax"]) * e["dx"] + (y - e["ay"]) * e["dy"]) / e["len2"]
    return F.struct(
        (x - e["ax"]).alias("px"), (y - e["ay"]).alias("py"), e["dx"].alias("dx"), e["dy"].alias("dy"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)).alias("t"),
    )


def inside_edges(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd test; points closer than one pixel to an edge count as inside."""
    crossed = F.filter(
        edges, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < e["slope"] * (y - e["ay"]) + e["ax"])
    )
    near = F.exists(
        F.transform(edges, lambda e: _offset(x, y, e)),
        lambda o: F.hypot(o["px"] - o["t"] * o["dx"], o["py"] - o["t"] * o["dy"]) < EDGE_TOLERANCE,
    )
    return (F.size(crossed) % 2 == 1) | near


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    return inside_edges(x, y, polygon_edges(polygon))
