"""Picking geocode candidates and assigning places to regions with fractional weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainledger.functions.domain import FORCED_LOW, is_broad, is_low_quality, place_level, place_rank
from rainledger.functions.geometry import interior_point
from rainledger.functions.text import plain_name
from rainledger.operators.nearby import nearest_region, points_in_regions
from rainledger.operators.relations import first_by
from rainledger.storage import Workspace


def pick_candidates(candidates: DataFrame) -> DataFrame:
    """(mention, osm_id, addresstype, rank, low_quality): the best candidate of each mention.

    candidates: (mention, scope {global, nl}, pos, osm_id, addresstype). The highest type rank wins, then the earliest
    position. Where that is of low quality, the national candidates compete too, one per osm_id, the global ones first.
    """
    rank = F.coalesce(place_rank(F.col("addresstype")), F.lit(50))
    rows = candidates.withColumns({"rank": rank, "low_quality": is_low_quality(F.col("addresstype")), "turn": F.when(F.col("scope") == "global", 0).otherwise(1)})
    keep = ["osm_id", "addresstype", "rank", "low_quality"]
    order = [-F.col("rank"), F.col("turn"), F.col("pos")]
    best = first_by(rows.where("turn = 0"), ["mention"], order, keep)
    weak = best.where("low_quality").select("mention")
    none = rows.select("mention").distinct().join(best, "mention", "left_anti")
    wider = first_by(rows, ["mention", "osm_id"], [F.col("turn"), F.col("pos")], ["addresstype", "rank", "low_quality", "turn", "pos"])
    again = first_by(wider.join(weak.unionAll(none), "mention", "left_semi"), ["mention"], order, keep)
    return best.join(again.select("mention"), "mention", "left_anti").unionByName(again)


def quality_fields(df: DataFrame, kind: str, location: str) -> DataFrame:
    """Adds place level, breadth, rank and low-quality flag, with the forced names last."""
    forced = F.coalesce(plain_name(F.col(location)).isin([n.replace("de ", "", 1) for n in FORCED_LOW]) & F.lower(F.trim(F.col(location))).startswith("de "), F.lit(False))
    level = place_level(F.col(kind))
    return df.withColumns({"place_level": level, "is_broad": is_broad(level), "place_rank": F.when(forced, 1).otherwise(place_rank(F.col(kind))), "low_quality": forced | is_low_quality(F.col(kind))})


def formatted(candidates: DataFrame) -> DataFrame:
    """(mention, osm_id, lat, lon, boundingbox): numbers as text with seven digits, the corners of the box joined by a bar;
    what is missing is null. candidates: (mention, osm_id, latitude, longitude, box array<double>)."""
    number = lambda c: F.when(c.isNotNull(), F.format_string("%.7f", c))
    box = F.when(F.size("box") > 0, F.array_join(F.transform("box", lambda x: F.format_string("%.4f", x)), "|"))
    return candidates.select("mention", "osm_id", number(F.col("latitude")).alias("lat"), number(F.col("longitude")).alias("lon"), box.alias("boundingbox"))


def completed(df: DataFrame, lat: str, lon: str, kind: str, location: str, level: str, broad: str, rank: str) -> DataFrame:
    """The geocode fields of sparse rows: null without coordinates, else level, breadth and rank from the place type
    where they are missing, what is there kept."""
    placed = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    fresh = quality_fields(df, kind, location)
    return fresh.select(*[c for c in df.columns if c not in (level, broad, rank)], F.when(placed, F.coalesce(F.col(level), "place_level")).alias(level), F.when(placed, F.coalesce(F.col(broad), "is_broad")).alias(broad), F.when(placed, F.coalesce(F.col(rank), "place_rank")).alias(rank))


def name_index(regions: DataFrame, aliases: DataFrame, macros: DataFrame | None = None, parents_first: bool = False) -> DataFrame:
    """(name, level, targets): one row per normalised name, aliases before official names, finer levels first (or coarser
    ones with `parents_first`, so that a broad place is split among children). Weights are 1 / number of targets.

    A parent's name stands for all its level-3 children with equal weights; a parent without children keeps itself.
    macros: (name, targets array) of names for sets of level-3 regions, level 0; they come after all regions, and
    targets that are no region are left out.
    """
    children = regions.where("level = 3").groupBy(F.col("parent_id").alias("nuts_id")).agg(F.array_sort(F.collect_list("nuts_id")).alias("children"))
    named = regions.select(plain_name(F.col("name")).alias("name"), "level", "nuts_id", F.lit(1).alias("turn"))
    named = named.unionAll(aliases.join(regions.select("nuts_id", "level"), "nuts_id").select(plain_name(F.col("alias")).alias("name"), "level", "nuts_id", F.lit(0).alias("turn")))
    rows = named.where("name <> ''").join(children, "nuts_id", "left").withColumn("targets", F.when(F.col("level") == 3, F.array("nuts_id")).otherwise(F.coalesce("children", F.array("nuts_id"))))
    rows = rows.select("name", "level", "turn", "nuts_id", "targets")
    if macros is not None:
        each = macros.select(plain_name(F.col("name")).alias("name"), F.explode(F.array_distinct("targets")).alias("nuts_id")).join(regions.where("level = 3").select("nuts_id"), "nuts_id", "left_semi")
        sets = each.where("name <> ''").groupBy("name").agg(F.array_sort(F.collect_set("nuts_id")).alias("targets"))
        rows = rows.unionByName(sets.select("name", F.lit(0).alias("level"), F.lit(2).alias("turn"), F.lit("").alias("nuts_id"), "targets"))
    finer = [F.col("level") == 0, F.col("level") if parents_first else -F.col("level")]
    return first_by(rows, ["name"], [*finer, F.col("turn"), F.col("nuts_id")], ["level", "targets"])


def parents_by_point(regions: DataFrame, child: int = 3, parent: int = 2) -> DataFrame:
    """(nuts_id, parent_id): the region of the parent level that holds a point inside each child region (the smaller id
    if there are several), whatever the ids say."""
    point = regions.where(F.col("level") == child).select("nuts_id", interior_point(F.col("rings")).alias("p")).select("nuts_id", F.col("p.y").alias("lat"), F.col("p.x").alias("lon"))
    inside = points_in_regions(point, regions.where(F.col("level") == parent).select(F.col("nuts_id").alias("parent"), "rings"), "nuts_id", "lat", "lon", "parent")
    return inside.groupBy("nuts_id").agg(F.min("region_id").alias("parent_id"))


def match_points(points: DataFrame, regions: DataFrame, key: str, lat: str, lon: str, metres: float = 25_000.0) -> DataFrame:
    """(key, stage, nuts3_id, nuts2_id, distance_m) of every point with a region, by the first stage that holds.

    inside: in a level-3 region, whose parent is the level-2 region that holds the point; inside_parent: in a level-2
    region only; near: a level-3 region within `metres`, whose parent is found by a point inside it; near_parent: a level-2
    region within `metres`. Distances are whole metres, 0 inside. Points without a valid coordinate have no row.
    """
    ws = Workspace(points.sparkSession, "match")
    of = lambda level: regions.where(F.col("level") == level)
    both = points_in_regions(points, regions.where("level in (2, 3)").select(F.concat(F.col("level").cast("string"), F.lit(":"), "nuts_id").alias("at"), "rings"), key, lat, lon, "at")
    pick = lambda level: F.min(F.when(F.col("region_id").startswith(f"{level}:"), F.substring("region_id", 3, 1 << 20)))
    inside = ws.write("inside", both.groupBy(key).agg(pick(3).alias("nuts3_id"), pick(2).alias("nuts2_id")))
    found = inside.select(key, F.when(F.col("nuts3_id").isNotNull(), "inside").otherwise("inside_parent").alias("stage"), "nuts3_id", "nuts2_id", F.lit(0).alias("distance_m"))
    outside = ws.write("outside", points.select(key, lat, lon).join(inside.select(key), key, "left_anti"))
    near = ws.write("near", nearest_region(outside, of(3), key, lat, lon, "nuts_id", "rings", metres))
    parents = parents_by_point(regions).withColumnRenamed("nuts_id", "region_id")
    near3 = near.join(F.broadcast(parents), "region_id", "left").select(key, F.lit("near").alias("stage"), F.col("region_id").alias("nuts3_id"), F.col("parent_id").alias("nuts2_id"), F.floor("metres").cast("int").alias("distance_m"))
    rest = nearest_region(outside.join(near.select(key), key, "left_anti"), of(2), key, lat, lon, "nuts_id", "rings", metres)
    near2 = rest.select(key, F.lit("near_parent").alias("stage"), F.lit(None).cast("string").alias("nuts3_id"), F.col("region_id").alias("nuts2_id"), F.floor("metres").cast("int").alias("distance_m"))
    return found.unionByName(near3).unionByName(near2)


def assign_regions(mentions: DataFrame, index: DataFrame, located: DataFrame) -> DataFrame:
    """(row_id, branch, region_id, weight): the cascade no place, abroad, country, name, point, none.

    mentions: (row_id, location, latitude, longitude, country_code, place_level, home country code in `home`);
    located: (row_id, region_id, how) of the points that lie in or near a region. Rows of the branches without a
    region have one row with a null region and weight 1; the weights of a name's regions add up to 1.
    """
    named = mentions.join(index.withColumnRenamed("name", "__n"), plain_name(F.col("location")) == F.col("__n"), "left").join(located, "row_id", "left")
    placed = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    abroad = (F.coalesce("country_code", F.lit("")) != "") & (F.lower("country_code") != F.col("home"))
    branch = F.when(~placed, "none").when(abroad, "abroad").when(F.col("place_level") == "country", "country").when(F.col("targets").isNotNull(), "name").when(F.col("region_id").isNotNull(), F.col("how")).otherwise("none")
    targets = F.when(branch == "name", F.col("targets")).when(branch.isin("inside", "near"), F.array("region_id"))
    out = named.select("row_id", branch.alias("branch"), targets.alias("targets"))
    return out.select("row_id", "branch", F.explode_outer("targets").alias("region_id"), (F.lit(1.0) / F.greatest(F.size(F.coalesce("targets", F.array(F.lit("")))), F.lit(1))).alias("weight"))
