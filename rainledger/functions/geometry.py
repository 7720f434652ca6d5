"""Areas and interior points of polygons given as rings of (x: longitude, y: latitude), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rainledger.functions.projection import metric_grid
from rainledger.functions.text import let


def ring_area_km2(ring: Column) -> Column:
    """Area within a closed ring on the metric grid (shoelace rule); 0 for fewer than three points, null for a null ring."""

    def on_grid(p: Column) -> Column:
        x, y = metric_grid(p["y"], p["x"])
        return F.struct(x.alias("x"), y.alias("y"))

    def shoelace(pts: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.size(pts) - 1), F.lit(0.0), lambda a, i: a + F.get(pts, i - 1)["x"] * F.get(pts, i)["y"] - F.get(pts, i)["x"] * F.get(pts, i - 1)["y"])

    return F.when(F.size(ring) < 3, F.lit(0.0)).when(ring.isNotNull(), F.abs(let(F.transform(ring, on_grid), shoelace)) / 2e6)


def polygon_area_km2(rings: Column) -> Column:
    """The outline less its holes; null for null rings, 0 for none."""
    whole = F.aggregate(F.transform(rings, ring_area_km2), F.lit(0.0), lambda a, x: a + x)
    outline = F.coalesce(ring_area_km2(F.get(rings, F.lit(0))), F.lit(0.0))
    return F.when(rings.isNotNull(), 2 * outline - whole)


def interior_point(rings: Column) -> Column:
    """struct (x, y) within a polygon: the middle of the widest stretch inside it at half its height; null if there is none."""
    ys = F.transform(F.flatten(rings), lambda p: p["y"])
    half = (F.array_min(ys) + F.array_max(ys)) / 2

    def at(y: Column) -> Column:
        edges = F.flatten(F.transform(rings, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), lambda i: F.struct(F.get(r, i - 1).alias("p"), F.get(r, i).alias("q")))))
        crossed = F.filter(edges, lambda e: (e["p"]["y"] > y) != (e["q"]["y"] > y))
        xs = F.array_sort(F.transform(crossed, lambda e: e["p"]["x"] + (y - e["p"]["y"]) * (e["q"]["x"] - e["p"]["x"]) / (e["q"]["y"] - e["p"]["y"])))

        def widest(x: Column) -> Column:
            pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / 2).cast("int") - 1), lambda i: F.struct((F.get(x, 2 * i + 1) - F.get(x, 2 * i)).alias("width"), ((F.get(x, 2 * i + 1) + F.get(x, 2 * i)) / 2).alias("x")))
            return F.when(F.size(x) > 1, F.struct(F.array_max(pairs)["x"].alias("x"), y.alias("y")))

        return let(xs, widest)

    return let(half, at)
