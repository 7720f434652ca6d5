"""Queries over the geocoded impact table: filters, aggregates, shares, co-occurrence, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainledger.functions import domain
from rainledger.functions.dates import month_of
from rainledger.operators import places, relations
from rainledger.storage import table


def _impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "impacts_geocoded_points")


def region_month_weighted(spark, sf_dir):
    """Weighted impacts, rows and articles of each region and month with its share of the month and leading class."""
    rows = _impacts(spark, sf_dir).where("nuts3_id is not null and nuts3_id <> '' and publication_date is not null")
    rows = rows.select("nuts3_id", month_of(F.col("publication_date")).alias("year_month"), "mention_weight", "article_id", "classification")
    keys = ["nuts3_id", "year_month"]
    sums = rows.groupBy(*keys).agg(F.round(F.sum("mention_weight"), 6).alias("impact_weight"), F.count("*").alias("row_count"), F.count_distinct("article_id").alias("article_count"))
    shared = relations.share_of(sums, "row_count", ["year_month"], "month_share")
    lead = relations.dominant(rows, keys, "classification").select(*keys, F.col("dominant").alias("leading_class"))
    return shared.join(lead, keys).select(*keys, "impact_weight", "row_count", "article_count", F.round("month_share", 8).alias("month_share"), "leading_class")


def location_dominant(spark, sf_dir):
    """Per location: first coordinates, count, classes, leading class and its share, radius and opacity of its mark."""
    rows = _impacts(spark, sf_dir).where("location is not null")
    first = relations.first_by(rows, ["location"], [F.col("row_id")], ["geocoded_latitude", "geocoded_longitude"])
    classes = rows.groupBy("location").agg(F.array_join(F.array_sort(F.collect_set("classification")), ", ").alias("classes"))
    lead = relations.dominant(rows, ["location"], "classification")
    out = first.join(classes, "location").join(lead, "location")
    share = F.coalesce(F.col("dominant_count") / F.col("total"), F.lit(1.0))
    return out.select("location", "geocoded_latitude", "geocoded_longitude", F.col("total").alias("impact_count"), "classes", "dominant", F.round(share, 6).alias("dominant_share"), (2500 + 1500 * F.col("total")).alias("radius"), F.floor(80 + 120 * share + 1e-9).alias("alpha"))


def region_aggregate(spark, sf_dir):
    """Per level-3 region: weighted and plain counts, articles, classes, leading class, heat bucket."""
    rows = _impacts(spark, sf_dir).where("nuts_level = 'nuts3' and nuts3_id is not null and nuts3_id <> ''")
    sums = rows.groupBy("nuts3_id").agg(F.round(F.sum("mention_weight"), 6).alias("impact_count"), F.count("*").alias("row_count"), F.count_distinct("id").alias("article_count"), F.array_join(F.array_sort(F.collect_set("classification")), ", ").alias("classes"))
    lead = relations.dominant(rows, ["nuts3_id"], "classification").select("nuts3_id", F.col("dominant").alias("leading_class"))
    most = sums.agg(F.max("impact_count").alias("most"))
    return sums.join(lead, "nuts3_id").crossJoin(F.broadcast(most)).select("nuts3_id", "impact_count", "row_count", "article_count", "classes", "leading_class", domain.heat_bucket(F.col("impact_count"), F.col("most")).alias("heat"))


def region_zero_fill(spark, sf_dir):
    """Every level-3 region with its impact count, zero where it has none."""
    counts = _impacts(spark, sf_dir).where("nuts3_id is not null").groupBy(F.col("nuts3_id").alias("nuts_id")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "nuts_regions").where("level = 3").select("nuts_id", "name").join(counts, "nuts_id", "left").fillna(0, ["n"])


def content_filter(spark, sf_dir):
    """Severity, class, recency (unknown included) and confidence filters in one conjunction."""
    rows = _impacts(spark, sf_dir)
    low, high = domain.recency_bounds("0–6 months")
    return rows.where(rows.classification.isin("Irrigation Shortage", "Wildfire Occurrence") & rows.severity.between(2, 3) & domain.in_recency(F.col("recency_in_months"), low, high, True)).select("row_id", "classification", "severity", "recency_in_months")


def recency_preset_counts(spark, sf_dir):
    """Rows in each named range of recency, the range cut to the largest value; presets meet the counts by value."""
    rows = _impacts(spark, sf_dir)
    counts = rows.where("recency_in_months is not null").groupBy("recency_in_months").agg(F.count("*").alias("n"))
    presets = domain.recency_presets(rows, F.col("recency_in_months"))
    met = F.broadcast(presets).withColumn("recency_in_months", F.explode(F.sequence("low", "high"))).join(counts, "recency_in_months", "left")
    return met.groupBy("preset", "low", "high").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def quality_counts(spark, sf_dir):
    """Rows in the content filter, and those of them that the geocode-quality filter drops, in one pass; an unknown
    rank passes."""
    good = ~F.coalesce(F.col("geocoded_is_low_quality"), F.lit(False)) & (F.col("geocoded_place_rank").isNull() | (F.col("geocoded_place_rank") >= 40))
    return _impacts(spark, sf_dir).where("severity >= 2").agg(F.count("*").alias("n_content"), F.count_if(~good).alias("n_dropped"))


def month_window_filter(spark, sf_dir):
    """Rows within two months of June 2024."""
    centre = F.to_date(F.lit("2024-06-01"))
    m = month_of(F.col("publication_date"))
    return _impacts(spark, sf_dir).where(m.between(F.add_months(centre, -2), F.add_months(centre, 2))).groupBy(m.alias("year_month")).agg(F.count("*").alias("n"))


def class_share(spark, sf_dir):
    """Weighted count and share of each class."""
    sums = _impacts(spark, sf_dir).where("classification is not null").groupBy("classification").agg(F.sum("mention_weight").alias("w"))
    return relations.share_of(sums, "w", []).select("classification", F.round("w", 6).alias("weighted_count"), F.round(100 * F.col("share"), 6).alias("share_pct"))


def theme_rollup(spark, sf_dir):
    """Classes rolled up to themes; unknown classes to the default theme."""
    by = _impacts(spark, sf_dir).groupBy(domain.theme_of(F.col("classification")).alias("theme")).agg(F.sum("mention_weight").alias("w"), F.count("*").alias("n"))
    return relations.share_of(by, "w", []).select("theme", F.round("w", 6).alias("weighted_count"), "n", F.round(100 * F.col("share"), 6).alias("share_pct"))


def class_cooccurrence_article(spark, sf_dir):
    return relations.cooccurrence(_impacts(spark, sf_dir), ["article_id"], "classification")


def class_cooccurrence_region_month(spark, sf_dir):
    rows = _impacts(spark, sf_dir).where("nuts3_id is not null and publication_date is not null").withColumn("m", month_of(F.col("publication_date")))
    return relations.cooccurrence(rows, ["nuts3_id", "m"], "classification")


def severity_histogram(spark, sf_dir):
    """Counts of the fixed severities 1 to 5, zero where there are none."""
    counts = _impacts(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))
    return relations.filled(counts, "severity", [1, 2, 3, 4, 5], ["n"]).select("severity", "n")


def yearly_volume(spark, sf_dir):
    rows = _impacts(spark, sf_dir).where("publication_date is not null and nuts_level = 'nuts3' and recency_in_months = 0")
    return rows.groupBy(F.year("publication_date").alias("year")).agg(F.count("*").alias("n"), F.count_distinct("article_id").alias("articles"))


def seasonality(spark, sf_dir):
    """Shares of rows in May to September, July and August, December to February."""
    m = F.month("publication_date")
    rows = _impacts(spark, sf_dir).where("publication_date is not null")
    part = lambda months: F.round(F.count_if(m.isin(months)) / F.count("*"), 8)
    return rows.agg(part([5, 6, 7, 8, 9]).alias("may_sep"), part([7, 8]).alias("jul_aug"), part([12, 1, 2]).alias("dec_feb"))


def top_regions(spark, sf_dir):
    """The five regions with the most rows."""
    by = _impacts(spark, sf_dir).where("nuts3_id is not null").groupBy("nuts3_id").agg(F.count("*").alias("n"))
    return by.orderBy(F.desc("n"), "nuts3_id").limit(5)


def top_bottom_classes(spark, sf_dir):
    """Three classes with the highest and three with the lowest mean severity in each theme."""
    by = _impacts(spark, sf_dir).where("classification is not null and severity is not null").groupBy("classification").agg(F.avg("severity").alias("s"))
    by = by.withColumns({"theme": domain.theme_of(F.col("classification")), "mean_severity": F.round("s", 8)})
    return relations.top_and_bottom(by, ["theme"], "mean_severity", "classification").select("theme", "classification", "mean_severity", "side", "place")


def missingness_profile(spark, sf_dir):
    columns = ["publication_date", "severity", "evidence", "geocoded_place_type", "nuts3_id"]
    return relations.profile(_impacts(spark, sf_dir), columns)


def place_quality(spark, sf_dir):
    """Rank, level and quality recomputed from the place type, counted."""
    rows = places.quality_fields(_impacts(spark, sf_dir), "geocoded_place_type", "location")
    return rows.groupBy("geocoded_place_type").agg(F.first("place_level").alias("place_level"), F.max("place_rank").alias("place_rank"), F.count("*").alias("n"), F.count_if("low_quality").alias("n_low"))


def place_rank_pick(spark, sf_dir):
    """The best candidate of each location by type rank, then by row."""
    rows = _impacts(spark, sf_dir).where("location is not null").select(F.col("location").alias("mention"), F.lit("global").alias("scope"), F.col("row_id").alias("pos"), F.col("geocoded_osm_id").alias("osm_id"), F.col("geocoded_place_type").alias("addresstype"))
    return places.pick_candidates(rows).select("mention", "osm_id", F.col("addresstype").alias("place_type"), F.col("rank").alias("place_rank"))


def location_cache_join(spark, sf_dir):
    """The first row's coordinates of a location given to all its rows (N:1), rows that differ counted per location."""
    rows = _impacts(spark, sf_dir).where("location is not null").select("row_id", "location", "geocoded_latitude")
    first = relations.first_by(rows, ["location"], [F.col("row_id")], ["geocoded_latitude"]).withColumnRenamed("geocoded_latitude", "first_latitude")
    both = rows.join(first, "location")
    return both.groupBy("location").agg(F.count("*").alias("n"), F.count_if(~F.col("geocoded_latitude").eqNullSafe(F.col("first_latitude"))).alias("n_other"))


def late_rows_last(spark, sf_dir):
    """Of rows delivered again the last loaded one, per article, model and impact."""
    keys = ["article_id", "model_name", "impact_index"]
    return relations.first_by(_impacts(spark, sf_dir), keys, [-F.unix_micros(F.col("loaded_at").cast("timestamp")), F.col("row_id")], ["row_id"])


def pivot_class_month(spark, sf_dir):
    """Rows of three classes by calendar month as columns, zero where there are none."""
    classes = ["Irrigation Shortage", "Wildfire Occurrence", "Social Impacts"]
    rows = _impacts(spark, sf_dir).where("publication_date is not null").where(F.col("classification").isin(classes)).withColumn("month", F.month("publication_date"))
    wide = rows.groupBy("month").pivot("classification", classes).count().fillna(0)
    return wide.select("month", *[F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in classes])


def category_fractions(spark, sf_dir):
    """Share of each nuts_level among a region's rows, as columns that add up to 1."""
    levels = ["nuts3", "nuts2", "country", "non_nl", "none"]
    rows = _impacts(spark, sf_dir).where("nuts3_id is not null").where(F.col("nuts_level").isin(levels))
    wide = rows.groupBy("nuts3_id").pivot("nuts_level", levels).count().fillna(0)
    total = sum((F.col(x) for x in levels), F.lit(0))
    return wide.select("nuts3_id", *[F.round(F.col(x) / total, 8).alias(f"{x}_fraction") for x in levels])


def mention_weights(spark, sf_dir):
    """A parent region's rows split among its level-3 children, weights per row adding up to its own."""
    children = table(spark, sf_dir, "nuts_regions").where("level = 3").groupBy(F.col("parent_id").alias("nuts2_id")).agg(F.array_sort(F.collect_list("nuts_id")).alias("children"))
    rows = _impacts(spark, sf_dir).where("nuts2_id is not null").select("nuts2_id", "mention_weight")
    split = rows.groupBy("nuts2_id").agg(F.sum("mention_weight").alias("w")).join(children, "nuts2_id")
    return split.select("nuts2_id", F.explode("children").alias("nuts3_id"), F.round(F.col("w") / F.size("children"), 8).alias("weight"))


def name_index(spark, sf_dir):
    """Names and aliases of regions with their level-3 targets and weight."""
    regions = table(spark, sf_dir, "nuts_regions")
    aliases = table(spark, sf_dir, "place_list").where("kind = 'region'").select(F.col("ref_id").alias("nuts_id"), F.explode("aliases").alias("alias"))
    index = places.name_index(regions, aliases)
    return index.select("name", "level", F.explode("targets").alias("nuts_id"), F.round(1.0 / F.size("targets"), 8).alias("weight"))


QUERIES = {f.__name__: f for f in (region_month_weighted, location_dominant, region_aggregate, region_zero_fill, content_filter, recency_preset_counts, quality_counts, month_window_filter, class_share, theme_rollup, class_cooccurrence_article, class_cooccurrence_region_month, severity_histogram, yearly_volume, seasonality, top_regions, top_bottom_classes, missingness_profile, place_quality, place_rank_pick, location_cache_join, late_rows_last, pivot_class_month, category_fractions, mention_weights, name_index)}

_I = "impacts_geocoded_points"
_THEME = "CASE " + " ".join(f"WHEN classification = '{c}' THEN '{t}'" for c, t in domain.THEMES.items()) + f" ELSE '{domain.DEFAULT_THEME}' END"
_RANK = "CASE " + " ".join(f"WHEN lower(trim(geocoded_place_type)) = '{k}' THEN {v}" for k, v in domain.PLACE_RANKS.items()) + " ELSE 50 END"
_LEVEL = "CASE " + " ".join(f"WHEN lower(coalesce(geocoded_place_type, '')) = '{k}' THEN '{level}'" for level, kinds in domain.LEVELS.items() for k in kinds) + " ELSE 'other' END"
_NAME = "trim(regexp_replace(regexp_replace(translate(lower(trim({0})), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '^(in de|in het|de|het|den)\\s+', ''), '[^a-z0-9]+', ' ', 'g'))"


def name_of_sql(column: str) -> str:
    """SQL of functions.text.plain_name."""
    return _NAME.format(column)


def _lead(keys: str, source: str) -> str:
    return f"(SELECT {keys}, classification AS lead_class FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, classification) AS k FROM (SELECT {keys}, classification, count(*) AS n FROM {source} WHERE classification IS NOT NULL GROUP BY ALL)) WHERE k = 1)"


ORACLES = {
    "region_month_weighted": f"""
        WITH r AS (SELECT nuts3_id, CAST(date_trunc('month', publication_date) AS DATE) AS year_month, mention_weight, article_id, classification FROM {_I}
                   WHERE nuts3_id IS NOT NULL AND nuts3_id <> '' AND publication_date IS NOT NULL),
        s AS (SELECT nuts3_id, year_month, round(sum(mention_weight), 6) AS impact_weight, count(*) AS row_count, count(DISTINCT article_id) AS article_count FROM r GROUP BY ALL),
        c AS {_lead("nuts3_id, year_month", "r")}
        SELECT s.nuts3_id, s.year_month, impact_weight, row_count, article_count, round(row_count / sum(row_count) OVER (PARTITION BY s.year_month), 8) AS month_share, lead_class AS leading_class
        FROM s LEFT JOIN c USING (nuts3_id, year_month)""",
    "location_dominant": f"""
        WITH r AS (SELECT * FROM {_I} WHERE location IS NOT NULL),
        f AS (SELECT location, geocoded_latitude, geocoded_longitude FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY row_id) AS k FROM r) WHERE k = 1),
        t AS (SELECT location, count(*) AS total, coalesce(array_to_string(list_sort(list(DISTINCT classification) FILTER (classification IS NOT NULL)), ', '), '') AS classes FROM r GROUP BY location),
        n AS (SELECT location, classification, count(*) AS n FROM r WHERE classification IS NOT NULL GROUP BY ALL),
        d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY n DESC, classification) AS k FROM n) WHERE k = 1)
        SELECT t.location, geocoded_latitude, geocoded_longitude, total AS impact_count, classes, d.classification AS dominant, round(coalesce(CAST(d.n AS DOUBLE) / total, 1.0), 6) AS dominant_share,
               2500 + 1500 * total AS radius, CAST(floor(80 + 120 * coalesce(CAST(d.n AS DOUBLE) / total, 1.0) + 1e-9) AS BIGINT) AS alpha
        FROM t JOIN f USING (location) LEFT JOIN d USING (location)""",
    "region_aggregate": f"""
        WITH r AS (SELECT * FROM {_I} WHERE nuts_level = 'nuts3' AND nuts3_id IS NOT NULL AND nuts3_id <> ''),
        s AS (SELECT nuts3_id, round(sum(mention_weight), 6) AS impact_count, count(*) AS row_count, count(DISTINCT id) AS article_count,
                     coalesce(array_to_string(list_sort(list(DISTINCT classification) FILTER (classification IS NOT NULL)), ', '), '') AS classes FROM r GROUP BY nuts3_id),
        c AS {_lead("nuts3_id", "r")}, m AS (SELECT max(impact_count) AS most FROM s)
        SELECT s.*, lead_class AS leading_class, CASE WHEN impact_count <= 0 THEN 0 WHEN impact_count / most < 0.25 THEN 1 WHEN impact_count / most < 0.5 THEN 2 WHEN impact_count / most < 0.75 THEN 3 ELSE 4 END AS heat
        FROM s LEFT JOIN c USING (nuts3_id), m""",
    "region_zero_fill": f"SELECT nuts_id, name, coalesce(n, 0) AS n FROM nuts_regions LEFT JOIN (SELECT nuts3_id AS nuts_id, count(*) AS n FROM {_I} GROUP BY 1) USING (nuts_id) WHERE level = 3",
    "content_filter": f"SELECT row_id, classification, severity, recency_in_months FROM {_I} WHERE classification IN ('Irrigation Shortage', 'Wildfire Occurrence') AND severity BETWEEN 2 AND 3 AND (recency_in_months BETWEEN 0 AND 6 OR recency_in_months IS NULL)",
    "recency_preset_counts": f"""
        WITH t AS (SELECT greatest(max(recency_in_months), 1) AS top FROM {_I}), p AS (SELECT preset, least(low, top) AS low, least(coalesce(high, top), top) AS high FROM (VALUES {", ".join(f"('{n}', {a}, {'NULL' if b is None else b})" for n, a, b in domain.RECENCY_PRESETS)}) v(preset, low, high), t)
        SELECT preset, CAST(low AS INT) AS low, CAST(high AS INT) AS high, (SELECT count(*) FROM {_I} WHERE recency_in_months BETWEEN p.low AND p.high) AS n FROM p""",
    "quality_counts": f"SELECT count(*) AS n_content, count(*) FILTER (NOT (NOT coalesce(geocoded_is_low_quality, false) AND (geocoded_place_rank IS NULL OR geocoded_place_rank >= 40))) AS n_dropped FROM {_I} WHERE severity >= 2",
    "month_window_filter": f"SELECT CAST(date_trunc('month', publication_date) AS DATE) AS year_month, count(*) AS n FROM {_I} WHERE publication_date >= DATE '2024-04-01' AND publication_date < DATE '2024-09-01' GROUP BY 1",
    "class_share": f"SELECT classification, round(w, 6) AS weighted_count, round(100 * w / sum(w) OVER (), 6) AS share_pct FROM (SELECT classification, sum(mention_weight) AS w FROM {_I} WHERE classification IS NOT NULL GROUP BY 1)",
    "theme_rollup": f"SELECT theme, round(w, 6) AS weighted_count, n, round(100 * w / sum(w) OVER (), 6) AS share_pct FROM (SELECT {_THEME} AS theme, sum(mention_weight) AS w, count(*) AS n FROM {_I} GROUP BY 1)",
    "class_cooccurrence_article": f"WITH d AS (SELECT DISTINCT article_id AS k, classification AS c FROM {_I} WHERE classification IS NOT NULL) SELECT a.c AS source, b.c AS target, count(*) AS weight FROM d a JOIN d b ON a.k IS NOT DISTINCT FROM b.k AND a.c < b.c GROUP BY ALL",
    "class_cooccurrence_region_month": f"WITH d AS (SELECT DISTINCT nuts3_id AS k, date_trunc('month', publication_date) AS m, classification AS c FROM {_I} WHERE classification IS NOT NULL AND nuts3_id IS NOT NULL AND publication_date IS NOT NULL) SELECT a.c AS source, b.c AS target, count(*) AS weight FROM d a JOIN d b ON a.k = b.k AND a.m = b.m AND a.c < b.c GROUP BY ALL",
    "severity_histogram": f"SELECT severity, coalesce(n, 0) AS n FROM (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INT) AS severity) LEFT JOIN (SELECT severity, count(*) AS n FROM {_I} GROUP BY 1) USING (severity)",
    "yearly_volume": f"SELECT CAST(year(publication_date) AS INT) AS year, count(*) AS n, count(DISTINCT article_id) AS articles FROM {_I} WHERE publication_date IS NOT NULL AND nuts_level = 'nuts3' AND recency_in_months = 0 GROUP BY 1",
    "seasonality": "SELECT " + ", ".join(f"round(CAST(count(*) FILTER (month(publication_date) IN ({m})) AS DOUBLE) / count(*), 8) AS {n}" for m, n in (("5,6,7,8,9", "may_sep"), ("7,8", "jul_aug"), ("12,1,2", "dec_feb"))) + f" FROM {_I} WHERE publication_date IS NOT NULL",
    "top_regions": f"SELECT nuts3_id, count(*) AS n FROM {_I} WHERE nuts3_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "top_bottom_classes": f"""
        WITH s AS (SELECT classification, {_THEME} AS theme, round(avg(severity), 8) AS mean_severity FROM {_I} WHERE classification IS NOT NULL AND severity IS NOT NULL GROUP BY 1, 2),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY theme ORDER BY mean_severity DESC, classification) AS INT) AS t, CAST(row_number() OVER (PARTITION BY theme ORDER BY mean_severity, classification) AS INT) AS b FROM s)
        SELECT theme, classification, mean_severity, 'top' AS side, t AS place FROM k WHERE t <= 3 UNION ALL SELECT theme, classification, mean_severity, 'bottom', b FROM k WHERE b <= 3""",
    "missingness_profile": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_missing, round(100.0 * (count(*) - count({c})) / count(*), 2) AS pct_missing, count(DISTINCT {c}) AS n_distinct FROM {_I}" for c in ("publication_date", "severity", "evidence", "geocoded_place_type", "nuts3_id")),
    "place_quality": f"""
        SELECT geocoded_place_type, any_value({_LEVEL}) AS place_level, max(CASE WHEN forced THEN 1 WHEN trim(geocoded_place_type) <> '' THEN {_RANK} END) AS place_rank, count(*) AS n,
               count(*) FILTER (forced OR lower(trim(geocoded_place_type)) IN ({", ".join(f"'{k}'" for k in domain.LOW_QUALITY)})) AS n_low
        FROM (SELECT *, coalesce(lower(trim(location)) = 'de jordaan', false) AS forced FROM {_I}) GROUP BY 1""",
    "place_rank_pick": f"""
        WITH r AS (SELECT location AS mention, row_id, geocoded_osm_id AS osm_id, geocoded_place_type AS place_type, CASE WHEN trim(geocoded_place_type) <> '' THEN {_RANK} ELSE 50 END AS place_rank FROM {_I} WHERE location IS NOT NULL)
        SELECT mention, osm_id, place_type, place_rank FROM (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY place_rank DESC, row_id) AS k FROM r) WHERE k = 1""",
    "location_cache_join": f"SELECT location, count(*) AS n, count(*) FILTER (geocoded_latitude IS DISTINCT FROM f) AS n_other FROM (SELECT location, geocoded_latitude, first_value(geocoded_latitude) OVER (PARTITION BY location ORDER BY row_id) AS f FROM {_I} WHERE location IS NOT NULL) GROUP BY 1",
    "late_rows_last": f"SELECT article_id, model_name, impact_index, row_id FROM (SELECT *, row_number() OVER (PARTITION BY article_id, model_name, impact_index ORDER BY loaded_at DESC NULLS LAST, row_id) AS k FROM {_I}) WHERE k = 1",
    "pivot_class_month": f"SELECT CAST(month(publication_date) AS INT) AS month, " + ", ".join(f"count(*) FILTER (classification = '{c}') AS {c.lower().replace(' ', '_')}" for c in ("Irrigation Shortage", "Wildfire Occurrence", "Social Impacts")) + f" FROM {_I} WHERE publication_date IS NOT NULL AND classification IN ('Irrigation Shortage', 'Wildfire Occurrence', 'Social Impacts') GROUP BY 1",
    "category_fractions": "SELECT nuts3_id, " + ", ".join(f"round(CAST(count(*) FILTER (nuts_level = '{x}') AS DOUBLE) / count(*), 8) AS {x}_fraction" for x in ("nuts3", "nuts2", "country", "non_nl", "none")) + f" FROM {_I} WHERE nuts3_id IS NOT NULL AND nuts_level IN ('nuts3', 'nuts2', 'country', 'non_nl', 'none') GROUP BY 1",
    "mention_weights": f"""
        WITH w AS (SELECT nuts2_id, sum(mention_weight) AS w FROM {_I} WHERE nuts2_id IS NOT NULL GROUP BY 1),
        c AS (SELECT parent_id AS nuts2_id, nuts_id AS nuts3_id, count(*) OVER (PARTITION BY parent_id) AS k FROM nuts_regions WHERE level = 3)
        SELECT nuts2_id, nuts3_id, round(w / k, 8) AS weight FROM w JOIN c USING (nuts2_id)""",
    "name_index": f"""
        WITH n AS (SELECT {_NAME.format("name")} AS name, level, nuts_id, 1 AS turn FROM nuts_regions
                   UNION ALL SELECT {_NAME.format("alias")}, level, ref_id, 0 FROM (SELECT ref_id, unnest(aliases) AS alias FROM place_list WHERE kind = 'region') JOIN nuts_regions ON nuts_id = ref_id),
        f AS (SELECT name, level, nuts_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY level DESC, turn, nuts_id) AS k FROM n WHERE name <> '') WHERE k = 1),
        t AS (SELECT f.name, f.level, coalesce(c.nuts_id, f.nuts_id) AS nuts_id FROM f LEFT JOIN nuts_regions c ON f.level < 3 AND c.parent_id = f.nuts_id AND c.level = 3)
        SELECT name, level, nuts_id, round(1.0 / count(*) OVER (PARTITION BY name), 8) AS weight FROM t""",
}
