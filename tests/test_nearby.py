import pytest
import math
import random

from rainledger.operators.nearby import nearest_region, overlay_areas, points_in_regions, points_near_sites

RINGS = "rid string, rings array<array<struct<x:double,y:double>>>, row_id string"


def square(x, y, w):
    return [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]


REGIONS = [("A", [square(4.0, 51.0, 1.0), square(4.4, 51.4, 0.2)], "z"), ("B", [square(4.4, 51.4, 0.2)], "z"), ("C", None, "z"), ("D", [], "z"), (None, [square(0.0, 0.0, 1.0)], "z"), ("E", [[(5.0, 51.0), (6.0, 51.0), (5.5, 52.0)]], "z")]


def inside(rings, x, y):
    odd = 0
    for r in rings or []:
        r = r if r[0] == r[-1] else [*r, r[0]]
        for (x1, y1), (x2, y2) in zip(r, r[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd ^= 1
    return bool(odd)


def test_points_in_regions_equals_brute_force_with_holes_nulls_and_clashing_names(spark):
    random.seed(3)
    rows = [(i, random.uniform(50.8, 52.2), random.uniform(3.8, 6.2), "x", True) for i in range(3000)]
    rows += [(9001, None, 4.5, "x", True), (9002, float("nan"), 4.5, "x", True), (9003, 95.0, 4.5, "x", True), (9004, 51.1, 200.0, "x", True), (9005, 51.2, 4.2, "x", True), (9005, 51.2, 4.2, "x", True)]
    points = spark.createDataFrame(rows, "row_id long, lat double, lon double, cell string, inside boolean")
    regions = spark.createDataFrame(REGIONS, RINGS)
    got = sorted((r[0], r[1]) for r in points_in_regions(points, regions, "row_id", "lat", "lon", "rid").collect())
    want = sorted((i, rid) for i, y, x, *_ in rows if y is not None and -90 <= y <= 90 and -180 <= x <= 180 for rid, rings, _ in REGIONS if rid and inside(rings, x, y))
    assert got == want


def test_empty_tables(spark):
    points = spark.createDataFrame([], "row_id long, lat double, lon double")
    assert points_in_regions(points, spark.createDataFrame([], RINGS), "row_id", "lat", "lon", "rid").count() == 0
    assert points_near_sites(points, spark.createDataFrame([], "sid int, a double, o double"), "row_id", "lat", "lon", "sid", "a", "o", 5000.0).count() == 0


def metres(a, b):
    (y1, x1), (y2, x2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * 6_371_008.8 * math.asin(math.sqrt(min(1, h)))


def test_sites_equal_brute_force_also_at_the_date_line_and_poles(spark):
    random.seed(5)
    sites = [(1, 52.0, 5.0), (2, 52.03, 5.02), (3, 0.0, 179.99), (4, 0.0, -179.99), (5, 89.99, 10.0), (6, -90.0, 0.0), (7, None, 5.0), (8, 52.0, 5.0)]
    points = [(i, 52.0 + random.gauss(0, 0.05), 5.0 + random.gauss(0, 0.08)) for i in range(800)]
    points += [(1000 + i, random.gauss(0, 0.03), random.choice([-1, 1]) * (180 - abs(random.gauss(0, 0.04)))) for i in range(300)]
    points += [(2000 + i, 90 - abs(random.gauss(0, 0.04)), random.uniform(-180, 180)) for i in range(300)] + [(3000, -89.97, 120.0), (3001, 0.0, 180.0), (3002, 0.0, -180.0)]
    p = spark.createDataFrame(points, "row_id long, lat double, lon double")
    s = spark.createDataFrame(sites, "sid int, a double, o double")
    got = sorted((r[0], r[1]) for r in points_near_sites(p, s, "row_id", "lat", "lon", "sid", "a", "o", 5000.0).collect())
    want = sorted((i, sid) for i, y, x in points for sid, a, o in sites if a is not None and metres((y, x), (a, o)) <= 5000)
    assert got == want and len(want) > 500


def test_nearest_region_within_distance(spark):
    regions = spark.createDataFrame([("A", [square(4.0, 51.0, 1.0)], "z"), ("B", [square(5.2, 51.0, 1.0)], "z")], RINGS)
    points = spark.createDataFrame([(1, 51.5, 3.9), (2, 51.5, 5.08), (3, 51.5, 5.15), (4, 51.5, 3.0), (5, None, 3.0)], "row_id long, lat double, lon double")
    got = {r["row_id"]: (r["region_id"], r["metres"]) for r in nearest_region(points, regions, "row_id", "lat", "lon", "rid", "rings", 25_000.0).collect()}
    assert set(got) == {1, 2, 3} and got[1][0] == "A" and got[2][0] == "A" and got[3][0] == "B"
    assert abs(got[1][1] - 0.1 * math.pi / 180 * 6_371_008.8 * math.cos(math.radians(51.5))) < 1


def test_overlay_areas(spark):
    a = spark.createDataFrame([("A", [square(4.0, 51.0, 1.0)], "z")], RINGS)
    b = spark.createDataFrame([("L", [square(3.0, 50.5, 1.5)], "z"), ("R", [[(4.5, 51.0), (6.0, 51.0), (6.0, 52.0), (4.5, 52.0), (4.5, 51.0)]], "z")], RINGS).withColumnRenamed("rid", "bid")
    got = {r["bid"]: r for r in overlay_areas(a, b, "rid", "bid", step=0.02).collect()}
    k = math.radians(1) * 6371.0088
    assert abs(got["R"]["area_km2"] - 0.5 * k * k * math.cos(math.radians(51.5))) < 20 and abs(got["L"]["share"] + got["R"]["share"] - 1) < 1e-9
    assert abs(got["L"]["area_km2"] - 0.5 * k * k * math.cos(math.radians(51.5))) < 3200


def test_outlines_are_repaired_and_simplified(spark):
    from rainledger.operators import outlines

    square = [(5.0, 52.0), (5.05, 52.00001), (5.1, 52.0), (5.1, 52.0), (5.1, 52.1), (5.0, 52.1)]
    assert outlines.repaired_ring(square) == [*square[:3], *square[4:], square[0]] and outlines.repaired_ring([(0, 0), (1, 1), (0, 0)]) == []
    assert outlines.simplified_ring(square, 250) == [(5.0, 52.0), (5.1, 52.0), (5.1, 52.1), (5.0, 52.1), (5.0, 52.0)]
    tiny = [(5.0, 52.0), (5.0001, 52.0), (5.0001, 52.0001), (5.0, 52.0001), (5.0, 52.0)]
    assert outlines.simplified_ring(tiny, 250) == tiny
    rows = spark.createDataFrame([("A", 1, [square, [(0.0, 0.0)]]), ("B", 1, None), ("C", 1, [])], "nuts_id string, level int, rings array<array<struct<x:double,y:double>>>")
    got = {r["nuts_id"]: r["rings"] for r in outlines.simplified(rows, 250.0).collect()}
    assert len(got["A"]) == 1 and len(got["A"][0]) == 5 and got["B"] is None and got["C"] == []
    with pytest.raises(ValueError):
        outlines.prepared(rows)
