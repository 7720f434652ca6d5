"""Points in polygons and points near points, without pairing everything with everything.

Polygons are covered by cells of an adaptive quadtree. A cell wholly inside accepts its points by
the equi-join alone; only points in a boundary cell take the exact test, and that test walks just
the edges that can cross the ray to the east of the cell. The finest cell size bounds the boundary
share whatever the number of points.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainledger.storage import Workspace

EARTH_RADIUS_M = 6_371_008.8
#: Quadtree levels at which cells are joined; level n has 2^n columns and rows.
LEVELS = (8, 10, 12)
#: Rows and edges of a cell table up to which it is broadcast (64 MB); above it the join shuffles on the cell.
BROADCAST_ROWS, BROADCAST_EDGES = 200_000, 1_500_000
_CELL_SCHEMA = "region_id string, cell bigint, inside boolean, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"


def _maybe_broadcast(df: DataFrame, edges: str | None = None) -> DataFrame:
    """For a written table: broadcast if its counted rows and the edges they carry allow it."""
    size = df.agg(F.count("*").alias("rows"), (F.sum(F.size(edges)) if edges else F.lit(0)).alias("edges")).first()
    return F.broadcast(df) if size["rows"] <= BROADCAST_ROWS and (size["edges"] or 0) <= BROADCAST_EDGES else df


def _code(level: int, ix, iy):
    return (level << 48) | (ix << 24) | iy


def _cell_code(level: int, x: Column, y: Column) -> Column:
    n = 1 << level
    at = lambda v, low, span: F.least(F.floor((v - low) / span * n), F.lit(n - 1))
    return F.lit(level << 48) + at(x, -180.0, 360.0) * F.lit(1 << 24) + at(y, -90.0, 180.0)


def _crosses_box(edges: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Which edges touch the closed box (Liang-Barsky clipping)."""
    ax, ay = edges[:, 0], edges[:, 1]
    dx, dy = edges[:, 2] - ax, edges[:, 3] - ay
    low, high = np.zeros(len(edges)), np.ones(len(edges))
    ok = np.ones(len(edges), bool)
    for p, q in ((-dx, ax - x0), (dx, x1 - ax), (-dy, ay - y0), (dy, y1 - ay)):
        flat = p == 0
        ok &= ~(flat & (q < 0))
        t = np.divide(q, p, out=np.zeros_like(q), where=~flat)
        low = np.where(~flat & (p < 0), np.maximum(low, t), low)
        high = np.where(~flat & (p > 0), np.minimum(high, t), high)
    return ok & (low <= high)


def _inside(edges: np.ndarray, x: float, y: float) -> bool:
    a, b = edges[:, 1], edges[:, 3]
    up = (a > y) != (b > y)
    e = edges[up]
    return bool(np.count_nonzero(x < (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0]) % 2)


def _cover(edges: np.ndarray, levels: tuple[int, ...]):
    """Yields (code, inside, edges for the ray test) of the cells that meet the polygon."""
    pad = 1e-9
    xs, ys = edges[:, [0, 2]], edges[:, [1, 3]]
    n = 1 << levels[0]
    span = lambda low, high, start, width: range(max(0, int((low - start) / width * n)), min(n - 1, int((high - start) / width * n)) + 1)
    todo = [(0, ix, iy, edges) for ix in span(xs.min(), xs.max(), -180, 360) for iy in span(ys.min(), ys.max(), -90, 180)]
    while todo:
        at, ix, iy, near = todo.pop()
        level = levels[at]
        w, h = 360 / (1 << level), 180 / (1 << level)
        x0, y0 = -180 + ix * w, -90 + iy * h
        near = near[_crosses_box(near, x0 - pad, y0 - pad, x0 + w + pad, y0 + h + pad)]
        if not len(near):
            if _inside(edges, x0 + w / 2, y0 + h / 2):
                yield _code(level, ix, iy), True, np.empty((0, 4))
        elif at + 1 < len(levels):
            step = 1 << (levels[at + 1] - level)
            todo.extend((at + 1, ix * step + i, iy * step + j, near) for i in range(step) for j in range(step))
        else:
            band = (ys.max(axis=1) >= y0 - pad) & (ys.min(axis=1) <= y0 + h + pad) & (xs.max(axis=1) >= x0 - pad)
            yield _code(level, ix, iy), False, edges[band]


def polygon_cells(regions: DataFrame, id_col: str, rings_col: str = "rings", levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """The adaptive cover of every polygon, one row per cell; null or empty rings cover nothing."""

    edge = pa.struct([(name, pa.float64()) for name in ("x1", "y1", "x2", "y2")])
    schema = pa.schema([("region_id", pa.string()), ("cell", pa.int64()), ("inside", pa.bool_()), ("edges", pa.list_(edge))])

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                parts = []
                for ring in row["rings"] or ():
                    at = [(p["x"], p["y"]) for p in ring or () if p is not None and p["x"] is not None and p["y"] is not None]
                    if len(at) > 2:
                        at = np.array(at if at[0] == at[-1] else [*at, at[0]], float)
                        parts.append(np.hstack([at[:-1], at[1:]]))
                if parts:
                    for code, inside, edges in _cover(np.vstack(parts), levels):
                        rows.append({"region_id": row["region_id"], "cell": code, "inside": inside, "edges": [dict(zip(("x1", "y1", "x2", "y2"), map(float, e))) for e in edges]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return regions.select(F.col(id_col).cast("string").alias("region_id"), F.col(rings_col).alias("rings")).where("region_id is not null").mapInArrow(run, _CELL_SCHEMA)


def valid_point(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def points_in_regions(points: DataFrame, regions: DataFrame, key: str, lat: str, lon: str, region_id: str, rings: str = "rings", levels: tuple[int, ...] = LEVELS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, region_id, *keep) of each point strictly within a polygon by the even-odd rule over all its rings.

    Points with a null, NaN or impossible coordinate match nothing. A point on an edge belongs to at
    most one side. Polygons may overlap: then a point has a row for each. Repeated keys give repeated rows.
    """
    at = points.select(F.col(key).alias("__key"), F.col(lon).alias("__x"), F.col(lat).alias("__y"), *[F.col(c).alias(f"__keep_{c}") for c in keep]).where(valid_point(F.col("__y"), F.col("__x")))
    at = at.withColumn("cell", F.explode(F.array(*[_cell_code(level, F.col("__x"), F.col("__y")) for level in levels])))
    e_crosses = lambda e: ((e["y1"] > F.col("__y")) != (e["y2"] > F.col("__y"))) & (F.col("__x") < (e["x2"] - e["x1"]) * (F.col("__y") - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    covered = Workspace(points.sparkSession, "cover").write("cells", polygon_cells(regions, region_id, rings, levels))
    hit = F.col("inside") | (F.size(F.filter("edges", e_crosses)) % 2 == 1)
    return at.join(_maybe_broadcast(covered, "edges"), "cell").where(hit).select(F.col("__key").alias(key), F.col("region_id"), *[F.col(f"__keep_{c}").alias(c) for c in keep])


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def points_near_sites(points: DataFrame, sites: DataFrame, key: str, lat: str, lon: str, site_id: str, site_lat: str, site_lon: str, metres: float) -> DataFrame:
    """(key, site_id, metres) of each point and site at most so far apart by great circle.

    A site is copied to every grid cell its circle can touch and a point lies in one cell, so the
    join is an equi-join on the cell and each pair meets once. Null coordinates match nothing.
    """
    reach = math.degrees(metres / EARTH_RADIUS_M)
    columns = max(1, math.floor(360 / max(reach, 1e-4)))
    size = 360 / columns  # the circle of longitude is cut evenly, so it closes at the date line
    site = sites.select(F.col(site_id).alias("__site"), F.col(site_lat).cast("double").alias("__sy"), F.col(site_lon).cast("double").alias("__sx")).where(valid_point(F.col("__sy"), F.col("__sx")))
    polar = F.abs("__sy") + reach >= 89.9
    spread = F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(reach)) / F.cos(F.radians("__sy"))))) + 1e-9
    column = lambda v: F.floor((v + 180.0) / size)
    xs = F.when(polar | (spread >= 180), F.sequence(F.lit(0), F.lit(columns - 1))).otherwise(F.array_distinct(F.transform(F.sequence(column(F.col("__sx") - spread), column(F.col("__sx") + spread)), lambda c: F.pmod(c, F.lit(columns)))))
    ys = F.sequence(F.floor((F.col("__sy") - reach - 1e-9 + 90.0) / size), F.floor((F.col("__sy") + reach + 1e-9 + 90.0) / size))
    cells = Workspace(points.sparkSession, "sites").write("cells", site.withColumn("__cx", F.explode(xs)).withColumn("__cy", F.explode(ys)))
    at = points.select(F.col(key).alias("__key"), F.col(lat).alias("__y"), F.col(lon).alias("__x")).where(valid_point(F.col("__y"), F.col("__x")))
    at = at.withColumns({"__cx": F.pmod(column(F.col("__x")), F.lit(columns)), "__cy": F.floor((F.col("__y") + 90.0) / size)})
    apart = great_circle_m(F.col("__y"), F.col("__x"), F.col("__sy"), F.col("__sx"))
    return at.join(_maybe_broadcast(cells), ["__cx", "__cy"]).withColumn("metres", apart).where(F.col("metres") <= metres).select(F.col("__key").alias(key), F.col("__site").alias(site_id), "metres")


def nearest_region(points: DataFrame, regions: DataFrame, key: str, lat: str, lon: str, region_id: str, rings: str, metres: float) -> DataFrame:
    """(key, region_id, metres): the region whose outline comes nearest, within the given distance (ties: the smaller id).

    Outlines are edges, an edge is copied to the grid cells it can reach, and a point lies in one cell; distances
    are metric on the plane that touches the sphere at the point. Meant for points outside all regions.
    """
    size = max(0.05, 2 * math.degrees(metres / EARTH_RADIUS_M))
    edge = regions.select(F.col(region_id).alias("__r"), F.explode(rings).alias("ring"))
    edge = edge.select("__r", F.explode(F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("p"), F.slice("ring", 2, F.size("ring") - 1).alias("q"))).alias("e"))
    edge = edge.select("__r", *[F.col(f"e.{p}.{c}").alias(f"{c}{i}") for i, p in ((1, "p"), (2, "q")) for c in "xy"])
    reach_y = math.degrees(metres / EARTH_RADIUS_M)
    reach_x = F.lit(reach_y) / F.cos(F.radians(F.least(F.greatest(F.abs("y1"), F.abs("y2")) + reach_y, F.lit(89.0))))
    steps = lambda low, high: F.sequence(F.floor(low / size), F.floor(high / size))
    cells = edge.withColumn("__cx", F.explode(steps(F.least("x1", "x2") - reach_x, F.greatest("x1", "x2") + reach_x))).withColumn("__cy", F.explode(steps(F.least("y1", "y2") - reach_y, F.greatest("y1", "y2") + reach_y)))
    cells = Workspace(points.sparkSession, "outlines").write("cells", cells)
    at = points.select(F.col(key).alias("__key"), F.col(lat).alias("__y"), F.col(lon).alias("__x")).where(valid_point(F.col("__y"), F.col("__x")))
    at = at.withColumns({"__cx": F.floor(F.col("__x") / size), "__cy": F.floor(F.col("__y") / size)})
    k = math.radians(1) * EARTH_RADIUS_M
    flat = lambda x, y: ((F.col(x) - F.col("__x")) * k * F.cos(F.radians("__y")), (F.col(y) - F.col("__y")) * k)
    (ax, ay), (bx, by) = flat("x1", "y1"), flat("x2", "y2")
    met = at.join(_maybe_broadcast(cells), ["__cx", "__cy"]).withColumns({"ax": ax, "ay": ay, "dx": bx - ax, "dy": by - ay})
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(F.col("ax") * F.col("dx") + F.col("ay") * F.col("dy")) / F.nullif(F.col("dx") ** 2 + F.col("dy") ** 2, F.lit(0.0))))
    t = F.coalesce(t, F.lit(0.0))
    apart = F.sqrt((F.col("ax") + t * F.col("dx")) ** 2 + (F.col("ay") + t * F.col("dy")) ** 2)
    near = met.withColumn("metres", apart).where(F.col("metres") <= metres)
    return near.groupBy("__key").agg(F.min(F.struct("metres", F.col("__r").alias("r"))).alias("m")).select(F.col("__key").alias(key), F.col("m.r").alias("region_id"), F.col("m.metres").alias("metres"))


def zonal(points: DataFrame, regions: DataFrame, key: str, lat: str, lon: str, value: str, region_id: str, rings: str = "rings") -> DataFrame:
    """(region_id, mean, low, high, std, n) of the values of the points (cell centres of a raster) in each region; std is
    that of the population, null and NaN values don't count."""
    inside = points_in_regions(points, regions, key, lat, lon, region_id, rings, keep=(value,))
    v = F.col(value)
    return inside.where(v.isNotNull() & ~F.isnan(v.cast("double"))).groupBy("region_id").agg(F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_pop(v).alias("std"), F.count("*").alias("n"))


def overlay_areas(a: DataFrame, b: DataFrame, a_id: str, b_id: str, rings: str = "rings", step: float = 0.01) -> DataFrame:
    """(a_id, b_id, area_km2, share): area of each meeting of two polygon layers and its share of all meetings of the a.

    Areas are counted in cells of `step` degrees by the cell-centre rule, each with its size on the sphere. A cell's
    centre is looked up in both layers by the cover and the two results meet by cell: nothing is paired by geometry.
    """
    ring = F.flatten(F.col(rings))
    box = a.where(F.size(rings) > 0).select(F.transform(ring, lambda p: p["x"]).alias("xs"), F.transform(ring, lambda p: p["y"]).alias("ys"))
    steps = lambda c: F.sequence(F.floor(F.array_min(c) / step), F.floor(F.array_max(c) / step))
    cells = box.select(F.explode(steps(F.col("xs"))).alias("ix"), "ys").select("ix", F.explode(steps(F.col("ys"))).alias("iy")).distinct()
    cells = cells.select(F.col("ix") * F.lit(1 << 31) + F.col("iy") + F.lit(1 << 30)).toDF("cell_no")
    lat = (F.pmod(F.col("cell_no"), F.lit(1 << 31)) - (1 << 30) + 0.5) * step
    lon = (F.floor(F.col("cell_no") / (1 << 31)) + 0.5) * step
    at = cells.withColumns({"lat": lat, "lon": lon})
    in_a = points_in_regions(at, a, "cell_no", "lat", "lon", a_id, rings).withColumnRenamed("region_id", a_id)
    in_b = points_in_regions(at, b, "cell_no", "lat", "lon", b_id, rings).withColumnRenamed("region_id", b_id)
    side = math.radians(step) * EARTH_RADIUS_M / 1000
    met = in_a.join(in_b, "cell_no").groupBy(a_id, b_id).agg((F.sum(F.cos(F.radians(lat))) * side * side).alias("area_km2"))
    return met.join(met.groupBy(a_id).agg(F.sum("area_km2").alias("__all")), a_id).withColumn("share", F.col("area_km2") / F.col("__all")).drop("__all")
