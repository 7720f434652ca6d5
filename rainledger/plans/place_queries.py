"""Regions, rasters and overlays: the assignment cascade, zonal statistics, areas and fractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainledger.functions import domain
from rainledger.functions import projection as grid
from rainledger.functions.geometry import polygon_area_km2
from rainledger.operators import nearby, outlines, places
from rainledger.plans.impact_queries import ORACLES as _IMPACTS
from rainledger.plans.impact_queries import name_of_sql
from rainledger.storage import Workspace, table

#: A raster of the clip box: south-west corner, cells east and north, size in degrees.
_WEST, _SOUTH, _EAST_CELLS, _NORTH_CELLS, _CELL = 3.4, 50.7, 76, 58, 0.05
_OVERLAY_STEP = 0.04
_NEAR_M = 25_000.0
#: Names for sets of level-3 regions; one id is unknown and dropped.
MACROS = [("De Noordelijke Streken", ["NX331", "NX332", "NX999"]), ("Het Rivierengebied", ["NX121", "NX122", "NX131"])]


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "impacts_geocoded_points").select("row_id", F.col("geocoded_latitude").alias("lat"), F.col("geocoded_longitude").alias("lon"), "confidence", "location", "geocoded_country_code", "geocoded_place_level")


def _regions(spark: SparkSession, sf_dir: str, level: int | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "nuts_regions")
    return rows if level is None else rows.where(F.col("level") == level)


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "place_list").where("kind = 'region'").select(F.col("ref_id").alias("nuts_id"), F.explode("aliases").alias("alias"))


def _rounded(stats: DataFrame) -> DataFrame:
    return stats.select("region_id", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high", "std")], "n")


def zonal_stats(spark, sf_dir):
    """Mean, extremes, population deviation and count of the confidences of points in each region by containment."""
    return _rounded(nearby.zonal(_points(spark, sf_dir), _regions(spark, sf_dir, 3), "row_id", "lat", "lon", "confidence", "nuts_id"))


def zonal_raster(spark, sf_dir):
    """The same of the cells of a raster, each in the region that holds its centre; cells without data (every 97th) don't count."""
    cells = spark.range(_EAST_CELLS * _NORTH_CELLS).select("id", (F.col("id") % _EAST_CELLS).alias("i"), F.floor(F.col("id") / _EAST_CELLS).alias("j"))
    value = F.when(F.col("id") % 97 != 0, ((F.col("i") * 31 + F.col("j") * 17) % 89).cast("double"))
    cells = cells.select("id", (_SOUTH + (F.col("j") + 0.5) * _CELL).alias("lat"), (_WEST + (F.col("i") + 0.5) * _CELL).alias("lon"), value.alias("v"))
    return _rounded(nearby.zonal(cells, _regions(spark, sf_dir, 3), "id", "lat", "lon", "v", "nuts_id"))


def region_cascade(spark, sf_dir):
    """Branch, region and weight of each impact: name before point, inside before near (25 km)."""
    points, level3 = _points(spark, sf_dir), _regions(spark, sf_dir, 3)
    ws = Workspace(spark, "cascade")
    inside = ws.write("inside", nearby.points_in_regions(points, level3, "row_id", "lat", "lon", "nuts_id"))
    outside = points.join(inside.select("row_id"), "row_id", "left_anti")
    near = nearby.nearest_region(outside, level3, "row_id", "lat", "lon", "nuts_id", "rings", _NEAR_M)
    located = inside.withColumn("how", F.lit("inside")).unionByName(near.select("row_id", "region_id", F.lit("near").alias("how")))
    mentions = points.select("row_id", "location", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("geocoded_country_code").alias("country_code"), F.col("geocoded_place_level").alias("place_level"), F.lit("nl").alias("home"))
    out = places.assign_regions(mentions, places.name_index(_regions(spark, sf_dir), _aliases(spark, sf_dir)), located)
    return out.select("row_id", "branch", "region_id", F.round("weight", 8).alias("weight"))


def point_match(spark, sf_dir):
    """Stage, region, parent and distance of each point: inside, inside the parent, near, near the parent."""
    return places.match_points(_points(spark, sf_dir), _regions(spark, sf_dir), "row_id", "lat", "lon", _NEAR_M)


def parents_by_point(spark, sf_dir):
    """The level-2 region that holds a point inside each level-3 region."""
    return places.parents_by_point(_regions(spark, sf_dir))


def name_index_macro(spark, sf_dir):
    """Names, aliases and macro names with their level-3 targets and weight."""
    macros = spark.createDataFrame(MACROS, "name string, targets array<string>")
    index = places.name_index(_regions(spark, sf_dir), _aliases(spark, sf_dir), macros)
    return index.select("name", "level", F.explode("targets").alias("nuts_id"), F.round(1.0 / F.size("targets"), 8).alias("weight"))


def name_index_parents(spark, sf_dir):
    """The same with coarser levels first, so that a name of two levels is split among the children."""
    index = places.name_index(_regions(spark, sf_dir), _aliases(spark, sf_dir), None, True)
    return index.select("name", "level", F.explode("targets").alias("nuts_id"), F.round(1.0 / F.size("targets"), 8).alias("weight"))


def geocode_format(spark, sf_dir):
    """Coordinates as text and the box joined by bars, of the first row of each place id."""
    rows = table(spark, sf_dir, "impacts_geocoded_points").where("geocoded_osm_id is not null")
    first = rows.groupBy("geocoded_osm_id").agg(F.min_by(F.struct(F.col("location").alias("mention"), "geocoded_latitude", "geocoded_longitude", "geocoded_boundingbox"), "row_id").alias("r"))
    box = F.transform(F.split("r.geocoded_boundingbox", "[|]"), lambda x: x.cast("double"))
    return places.formatted(first.select("r.mention", F.col("geocoded_osm_id").alias("osm_id"), F.col("r.geocoded_latitude").alias("latitude"), F.col("r.geocoded_longitude").alias("longitude"), box.alias("box")))


def field_completion(spark, sf_dir):
    """Levels, breadths and ranks filled in where they are missing, none for rows without coordinates."""
    rows = table(spark, sf_dir, "impacts_geocoded_points").select("row_id", "location", "geocoded_latitude", "geocoded_longitude", "geocoded_place_type", F.when(F.col("row_id") % 3 > 0, F.col("geocoded_place_level")).alias("level"), F.when(F.col("row_id") % 3 > 0, F.col("geocoded_is_broad")).alias("broad"), F.when(F.col("row_id") % 3 > 0, F.col("geocoded_place_rank")).alias("rank"))
    return places.completed(rows, "geocoded_latitude", "geocoded_longitude", "geocoded_place_type", "location", "level", "broad", "rank").select("row_id", "level", "broad", "rank")


def overlay_fractions(spark, sf_dir):
    """Area of each meeting of level-2 and level-3 regions by cells, with its share of the level-2 region and whether it is the largest."""
    a = _regions(spark, sf_dir, 2).select(F.col("nuts_id").alias("a_id"), "rings")
    b = _regions(spark, sf_dir, 3).select(F.col("nuts_id").alias("b_id"), "rings")
    met = nearby.overlay_areas(a, b, "a_id", "b_id", step=_OVERLAY_STEP)
    most = met.groupBy("a_id").agg(F.min(F.struct((-F.round("area_km2", 4)).alias("s"), "b_id")).alias("m")).select("a_id", F.col("m.b_id").alias("most"))
    return met.join(F.broadcast(most), "a_id").select("a_id", "b_id", F.round("area_km2", 4).alias("area_km2"), F.round("share", 8).alias("share"), (F.col("b_id") == F.col("most")).alias("dominant"))


def class_count_area(spark, sf_dir):
    """Number and area of the regions of each parent, those without a parent included."""
    return _regions(spark, sf_dir).groupBy("parent_id").agg(F.count("*").alias("n"), F.round(F.sum(polygon_area_km2(F.col("rings"))), 3).alias("area_km2"))


def spatial_summary(spark, sf_dir):
    """Number, total, mean and largest area, corners of the box and points of all level-3 outlines."""
    area = polygon_area_km2(F.col("rings"))
    return _regions(spark, sf_dir, 3).agg(F.count("*").alias("n"), F.round(F.sum(area), 3).alias("total_km2"), F.round(F.avg(area), 3).alias("mean_km2"), F.round(F.max(area), 3).alias("most_km2"), F.min("xmin").alias("west"), F.min("ymin").alias("south"), F.max("xmax").alias("east"), F.max("ymax").alias("north"), F.sum(F.size(F.flatten("rings"))).alias("n_points"))


def land_fractions(spark, sf_dir):
    """Share of each theme among the valid rows of a region, and the region's share of all rows, in and out of regions."""
    rows = table(spark, sf_dir, "impacts_geocoded_points").where("classification is not null").select("nuts3_id", domain.theme_of(F.col("classification")).alias("theme"))
    themes = sorted(set(domain.THEMES.values()))
    by = rows.groupBy("nuts3_id").agg(F.count("*").alias("n"), *[F.round(F.avg(F.when(F.col("theme") == t, 1.0).otherwise(0.0)), 8).alias(f"{t}_fraction") for t in themes])
    total = F.broadcast(rows.agg(F.count("*").alias("total")))
    return by.crossJoin(total).where("nuts3_id is not null").select("nuts3_id", "n", *[f"{t}_fraction" for t in themes], F.round(F.col("n") / F.col("total"), 8).alias("row_fraction"))


def grid_round_trip(spark, sf_dir):
    """Stations to the metric grid and back: degrees to four digits."""
    x, y = grid.metric_grid(F.col("latitude"), F.col("longitude"))
    rows = table(spark, sf_dir, "cdd_stations").where("latitude between 50.5 and 53.7 and longitude between 3.2 and 7.3").select("staid", x.alias("x"), y.alias("y"))
    lat, lon = grid.degrees_of_grid(F.col("x"), F.col("y"))
    return rows.select("staid", F.round(lat, 4).alias("latitude"), F.round(lon, 4).alias("longitude"))


def prepared_regions(spark, sf_dir):
    """Points of the outlines before and after simplification by 250 m, and the change of area."""
    rows = _regions(spark, sf_dir)
    area = lambda: polygon_area_km2(F.col("rings"))
    after = outlines.prepared(rows, "NX").select("nuts_id", F.size(F.flatten("rings")).alias("points_after"), area().alias("after"))
    both = rows.select("nuts_id", F.size(F.flatten("rings")).alias("points_before"), area().alias("before")).join(after, "nuts_id")
    return both.select("nuts_id", "points_before", "points_after", F.round(F.abs(F.col("after") / F.col("before") - 1), 4).alias("area_change"))


QUERIES = {f.__name__: f for f in (zonal_stats, zonal_raster, region_cascade, point_match, parents_by_point, name_index_macro, name_index_parents, geocode_format, field_completion, overlay_fractions, class_count_area, spatial_summary, land_fractions, grid_round_trip, prepared_regions)}

_I = "impacts_geocoded_points"
_EDGES = """e AS (SELECT nuts_id, level, ring[i].x AS x1, ring[i].y AS y1, ring[i + 1].x AS x2, ring[i + 1].y AS y2 FROM (SELECT nuts_id, level, ring, unnest(range(1, len(ring))) AS i FROM (SELECT nuts_id, level, unnest(rings) AS ring FROM nuts_regions)))"""
_VALID = f"p AS (SELECT row_id, geocoded_latitude AS y, geocoded_longitude AS x, confidence AS v FROM {_I} WHERE geocoded_latitude BETWEEN -90 AND 90 AND geocoded_longitude BETWEEN -180 AND 180)"


def _in(points: str, name: str, key: str = "row_id", level: str = "level = 3", keep: str = "") -> str:
    return f"{name} AS (SELECT {key}, nuts_id{keep} FROM {points} JOIN e ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 WHERE {level} GROUP BY ALL HAVING count(*) % 2 = 1)"


def _near(points: str, name: str, level: int) -> str:
    """Nearest outline on the plane that touches the sphere at the point."""
    k = f"(radians(1) * {nearby.EARTH_RADIUS_M})"
    return f"""{name}_q AS (SELECT row_id, nuts_id, (x1 - x) * {k} * cos(radians(y)) AS ax, (y1 - y) * {k} AS ay, (x2 - x1) * {k} * cos(radians(y)) AS dx, (y2 - y1) * {k} AS dy FROM {points} JOIN e ON level = {level}),
    {name}_d AS (SELECT row_id, nuts_id, sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)) AS m FROM (SELECT *, coalesce(least(1.0, greatest(0.0, -(ax * dx + ay * dy) / nullif(dx * dx + dy * dy, 0))), 0.0) AS t FROM {name}_q)),
    {name} AS (SELECT row_id, nuts_id, m FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY m, nuts_id) AS k FROM {name}_d WHERE m <= {_NEAR_M}) WHERE k = 1)"""


_STATS = "round(avg(v), 6) AS mean, round(min(v), 6) AS low, round(max(v), 6) AS high, round(stddev_pop(v), 6) AS std, count(*) AS n"
_POLYNOMIAL = lambda terms, a, b: " + ".join(f"({v}) * pow({a}, {p}) * pow({b}, {q})" for p, q, v in terms)
_GRID_X = lambda lat, lon: f"({grid._X0} + {_POLYNOMIAL(grid._X, f'(0.36 * ({lat} - {grid._LAT0}))', f'(0.36 * ({lon} - {grid._LON0}))')})"
_GRID_Y = lambda lat, lon: f"({grid._Y0} + {_POLYNOMIAL(grid._Y, f'(0.36 * ({lat} - {grid._LAT0}))', f'(0.36 * ({lon} - {grid._LON0}))')})"
_AREAS = f"""r AS (SELECT nuts_id, unnest(rings) AS ring, unnest(range(len(rings))) AS k FROM nuts_regions), v AS (SELECT nuts_id, k, i, {_GRID_X('ring[i].y', 'ring[i].x')} AS x, {_GRID_Y('ring[i].y', 'ring[i].x')} AS y FROM (SELECT *, unnest(range(1, len(ring) + 1)) AS i FROM r)),
    s AS (SELECT nuts_id, k, x * lead(y) OVER w - lead(x) OVER w * y AS c FROM v WINDOW w AS (PARTITION BY nuts_id, k ORDER BY i)), g AS (SELECT nuts_id, k, abs(sum(c)) / 2e6 AS km2 FROM s GROUP BY ALL), area AS (SELECT nuts_id, sum(CASE WHEN k = 0 THEN km2 ELSE -km2 END) AS km2 FROM g GROUP BY 1)"""
_PARENTS = f"""h AS (SELECT nuts_id AS row_id, (min(least(y1, y2)) + max(greatest(y1, y2))) / 2 AS y FROM e WHERE level = 3 GROUP BY 1),
    c AS (SELECT row_id, y, list_sort(list(x1 + (y - y1) * (x2 - x1) / (y2 - y1))) AS xs FROM h JOIN e ON e.nuts_id = h.row_id AND (y1 > y) <> (y2 > y) GROUP BY ALL),
    w AS (SELECT row_id, y, (xs[2 * i + 1] + xs[2 * i + 2]) / 2 AS x, xs[2 * i + 2] - xs[2 * i + 1] AS width FROM (SELECT *, unnest(range(len(xs) // 2)) AS i FROM c)),
    o AS (SELECT row_id, arg_max(x, (width, x)) AS x, any_value(y) AS y FROM w GROUP BY 1), {_in("o", "u", level="level = 2")}, parents AS (SELECT row_id AS nuts_id, min(nuts_id) AS parent_id FROM u GROUP BY 1)"""
_NAMES = _IMPACTS["name_index"]

ORACLES = {
    "zonal_stats": f"WITH {_EDGES}, {_VALID}, {_in('p', 'd', keep=', v')} SELECT nuts_id AS region_id, {_STATS} FROM d WHERE v IS NOT NULL GROUP BY 1",
    "zonal_raster": f"""
        WITH {_EDGES}, k AS (SELECT id, id % {_EAST_CELLS} AS i, id // {_EAST_CELLS} AS j FROM range({_EAST_CELLS * _NORTH_CELLS}) t(id)),
        p AS (SELECT id, {_SOUTH}::DOUBLE + (j + 0.5::DOUBLE) * {_CELL}::DOUBLE AS y, {_WEST}::DOUBLE + (i + 0.5::DOUBLE) * {_CELL}::DOUBLE AS x, CASE WHEN id % 97 <> 0 THEN CAST((i * 31 + j * 17) % 89 AS DOUBLE) END AS v FROM k), {_in('p', 'd', 'id', keep=', v')}
        SELECT nuts_id AS region_id, {_STATS} FROM d WHERE v IS NOT NULL GROUP BY 1""",
    "region_cascade": f"""
        WITH {_EDGES}, {_VALID}, {_in('p', 'd')}, q AS (SELECT * FROM p WHERE row_id NOT IN (SELECT row_id FROM d)), {_near('q', 'f', 3)},
        z AS (SELECT row_id, nuts_id, 'inside' AS how FROM d UNION ALL SELECT row_id, nuts_id, 'near' FROM f),
        n AS (SELECT name, list(nuts_id) AS targets FROM ({_NAMES}) GROUP BY 1),
        b AS (SELECT i.row_id, targets, z.nuts_id AS region, CASE WHEN geocoded_latitude IS NULL OR geocoded_longitude IS NULL THEN 'none' WHEN coalesce(geocoded_country_code, '') <> '' AND lower(geocoded_country_code) <> 'nl' THEN 'abroad' WHEN geocoded_place_level = 'country' THEN 'country'
                WHEN targets IS NOT NULL THEN 'name' WHEN z.nuts_id IS NOT NULL THEN how ELSE 'none' END AS branch FROM {_I} i LEFT JOIN n ON n.name = {name_of_sql('location')} LEFT JOIN z ON z.row_id = i.row_id)
        SELECT row_id, branch, unnest(targets) AS region_id, round(1.0::DOUBLE / len(targets), 8) AS weight FROM b WHERE branch = 'name' UNION ALL SELECT row_id, branch, CASE WHEN branch IN ('inside', 'near') THEN region END, 1.0 FROM b WHERE branch <> 'name'""",
    "point_match": f"""
        WITH {_EDGES}, {_VALID}, {_in('p', 'd3')}, {_in('p', 'd2', level='level = 2')}, {_PARENTS},
        i AS (SELECT row_id, max(a) AS nuts3_id, max(b) AS nuts2_id FROM (SELECT row_id, min(nuts_id) AS a, NULL AS b FROM d3 GROUP BY 1 UNION ALL SELECT row_id, NULL, min(nuts_id) FROM d2 GROUP BY 1) GROUP BY 1),
        q AS (SELECT * FROM p WHERE row_id NOT IN (SELECT row_id FROM i)), {_near('q', 'f3', 3)}, q2 AS (SELECT * FROM q WHERE row_id NOT IN (SELECT row_id FROM f3)), {_near('q2', 'f2', 2)}
        SELECT row_id, CASE WHEN nuts3_id IS NOT NULL THEN 'inside' ELSE 'inside_parent' END AS stage, nuts3_id, nuts2_id, 0 AS distance_m FROM i
        UNION ALL SELECT row_id, 'near', f3.nuts_id, parent_id, CAST(floor(m) AS INT) FROM f3 LEFT JOIN parents ON parents.nuts_id = f3.nuts_id UNION ALL SELECT row_id, 'near_parent', NULL, nuts_id, CAST(floor(m) AS INT) FROM f2""",
    "parents_by_point": f"WITH {_EDGES}, {_PARENTS} SELECT nuts_id, parent_id FROM parents",
    "name_index_macro": f"""
        WITH o AS ({_NAMES}), m AS (SELECT {name_of_sql('name')} AS name, unnest(targets) AS nuts_id FROM (VALUES {", ".join(f"('{n}', {t!r})" for n, t in MACROS)}) v(name, targets)),
        k AS (SELECT name, nuts_id FROM m WHERE name NOT IN (SELECT name FROM o) AND nuts_id IN (SELECT nuts_id FROM nuts_regions WHERE level = 3))
        SELECT name, level, nuts_id, weight FROM o UNION ALL SELECT name, 0, nuts_id, round(1.0::DOUBLE / count(*) OVER (PARTITION BY name), 8) FROM k""",
    "name_index_parents": _NAMES.replace("ORDER BY level DESC, turn", "ORDER BY level, turn"),
    "geocode_format": f"""
        WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY geocoded_osm_id ORDER BY row_id) AS k FROM {_I} WHERE geocoded_osm_id IS NOT NULL) WHERE k = 1)
        SELECT location AS mention, geocoded_osm_id AS osm_id, printf('%.7f', geocoded_latitude) AS lat, printf('%.7f', geocoded_longitude) AS lon, geocoded_boundingbox AS boundingbox FROM f""",
    "field_completion": f"""
        WITH r AS (SELECT *, CASE WHEN row_id % 3 > 0 THEN geocoded_place_level END AS l, CASE WHEN row_id % 3 > 0 THEN geocoded_is_broad END AS b, CASE WHEN row_id % 3 > 0 THEN geocoded_place_rank END AS k, coalesce(lower(trim(location)) = 'de jordaan', false) AS forced, geocoded_latitude IS NOT NULL AND geocoded_longitude IS NOT NULL AS placed FROM {_I}),
        q AS (SELECT *, {{level}} AS fresh, CASE WHEN forced THEN 1 WHEN trim(geocoded_place_type) <> '' THEN {{rank}} END AS fresh_rank FROM r)
        SELECT row_id, CASE WHEN placed THEN coalesce(l, fresh) END AS level, CASE WHEN placed THEN coalesce(b, fresh IN ('country', 'region')) END AS broad, CASE WHEN placed THEN coalesce(k, fresh_rank) END AS rank FROM q""",
    "overlay_fractions": f"""
        WITH {_EDGES}, b AS (SELECT min(xmin) AS w, max(xmax) AS x, min(ymin) AS s, max(ymax) AS n FROM nuts_regions WHERE level = 2),
        k AS (SELECT i * 100000 + j AS row_id, (i + 0.5::DOUBLE) * {_OVERLAY_STEP}::DOUBLE AS x, (j + 0.5::DOUBLE) * {_OVERLAY_STEP}::DOUBLE AS y FROM b, unnest(range(CAST(floor(w / {_OVERLAY_STEP}) AS INT), CAST(floor(b.x / {_OVERLAY_STEP}) AS INT) + 1)) t(i), unnest(range(CAST(floor(s / {_OVERLAY_STEP}) AS INT), CAST(floor(n / {_OVERLAY_STEP}) AS INT) + 1)) u(j)),
        {_in('k', 'd2', level='level = 2', keep=', y')}, {_in('k', 'd3')}, m AS (SELECT d2.nuts_id AS a_id, d3.nuts_id AS b_id, sum(cos(radians(y))) * pow(radians({_OVERLAY_STEP}) * {nearby.EARTH_RADIUS_M} / 1000, 2) AS km2 FROM d2 JOIN d3 USING (row_id) GROUP BY 1, 2)
        SELECT a_id, b_id, round(km2, 4) AS area_km2, round(km2 / sum(km2) OVER (PARTITION BY a_id), 8) AS share, row_number() OVER (PARTITION BY a_id ORDER BY round(km2, 4) DESC, b_id) = 1 AS dominant FROM m""",
    "class_count_area": f"WITH {_AREAS} SELECT parent_id, count(*) AS n, round(sum(km2), 3) AS area_km2 FROM nuts_regions JOIN area USING (nuts_id) GROUP BY 1",
    "spatial_summary": f"WITH {_AREAS} SELECT count(*) AS n, round(sum(km2), 3) AS total_km2, round(avg(km2), 3) AS mean_km2, round(max(km2), 3) AS most_km2, min(xmin) AS west, min(ymin) AS south, max(xmax) AS east, max(ymax) AS north, CAST(sum(len(flatten(rings))) AS BIGINT) AS n_points FROM nuts_regions JOIN area USING (nuts_id) WHERE level = 3",
    "land_fractions": "WITH r AS (SELECT nuts3_id, {theme} AS theme FROM impacts_geocoded_points WHERE classification IS NOT NULL) SELECT nuts3_id, count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN theme = '{t}' THEN 1.0::DOUBLE ELSE 0 END), 8) AS {t}_fraction" for t in sorted(set(domain.THEMES.values()))) + ", round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM r), 8) AS row_fraction FROM r WHERE nuts3_id IS NOT NULL GROUP BY 1",
    "grid_round_trip": "SELECT staid, round(latitude, 4) AS latitude, round(longitude, 4) AS longitude FROM cdd_stations WHERE latitude BETWEEN 50.5 AND 53.7 AND longitude BETWEEN 3.2 AND 7.3",
}
ORACLES["field_completion"] = ORACLES["field_completion"].replace("{level}", _IMPACTS["place_quality"].split("any_value(")[1].split(") AS place_level")[0]).replace("{rank}", _IMPACTS["place_quality"].split("<> '' THEN ")[1].split(" END) AS place_rank")[0])
ORACLES["land_fractions"] = ORACLES["land_fractions"].replace("{theme}", _IMPACTS["theme_rollup"].split("SELECT ")[2].split(" AS theme")[0])
