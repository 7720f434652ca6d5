"""Queries p6 and p7: points in regions and near stations, nested answers as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainledger.operators.interval_nesting import answer_nodes, nodes_of, within
from rainledger.operators.nearby import points_in_regions, points_near_sites
from rainledger.storage import Workspace, table

NEAR_M = 5_000.0


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, ref_kind, ref_id): the level-3 region holding each point and every station within 5 km."""
    points = table(spark, sf_dir, "impacts_geocoded_points")
    regions = table(spark, sf_dir, "nuts_regions").where("level = 3")
    stations = table(spark, sf_dir, "cdd_stations")
    inside = points_in_regions(points, regions, "row_id", "geocoded_latitude", "geocoded_longitude", "nuts_id")
    near = points_near_sites(points, stations, "row_id", "geocoded_latitude", "geocoded_longitude", "staid", "latitude", "longitude", NEAR_M)
    return inside.select("row_id", F.lit("region").alias("ref_kind"), F.col("region_id").alias("ref_id")).unionAll(
        near.select("row_id", F.lit("station").alias("ref_kind"), F.col("staid").cast("string").alias("ref_id"))
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(extraction_id, event_pos, impact_pos): every impact by interval containment, -1 for an event without one."""
    # written once: the event and the impact table are read from it, so no answer is parsed twice
    nodes = Workspace(spark, "answers").write("nodes", answer_nodes(table(spark, sf_dir, "drought_extractions"), "extraction_id", "payload"))
    linked = within(nodes_of(nodes, "impact"), nodes_of(nodes, "event"), "right")
    return linked.select(
        F.col("answer_id").alias("extraction_id"), F.col("outer_pos").alias("event_pos"), F.coalesce("pos", F.lit(-1)).alias("impact_pos")
    )


def p7_answer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table of drought_extractions with its interval and its answer."""
    nodes = answer_nodes(table(spark, sf_dir, "drought_extractions"), "extraction_id", "payload")
    return nodes_of(nodes, "event").withColumnRenamed("answer_id", "extraction_id").withColumnRenamed("pos", "event_pos")


def _article_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Node table of the nested column of sample_impacts and the answers (answer_id, article_id, model_name) it belongs to."""
    rows = table(spark, sf_dir, "sample_impacts").select(F.col("features.article_id").alias("article_id"), "model_name", F.col("features.llm_drought_impacts").alias("events")).distinct()
    ws = Workspace(spark, "article-answers")
    rows = ws.write("rows", rows.select(F.monotonically_increasing_id().alias("answer_id"), "article_id", "model_name", F.to_json(F.struct("events")).alias("payload")))
    return ws.write("nodes", answer_nodes(rows, "answer_id", "payload")), rows.drop("payload")


def p7_article_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested column of sample_impacts as a flat impact table, linked by intervals; an event without impacts keeps one row (-1)."""
    nodes, answers = _article_nodes(spark, sf_dir)
    linked = within(nodes_of(nodes, "impact"), nodes_of(nodes, "event"), "right").join(answers, "answer_id")
    return linked.select(
        "article_id", "model_name", F.col("outer_pos").alias("event_pos"), F.coalesce("pos", F.lit(-1)).alias("impact_pos"), "classification", F.col("severity").cast("int").alias("severity"), "evidence",
        F.col("confidence").cast("double").alias("confidence"), F.col("evidence_found_verbatim").cast("boolean").alias("evidence_found_verbatim"),
    )


def p7_article_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the nested column of sample_impacts with all their fields."""
    nodes, answers = _article_nodes(spark, sf_dir)
    rows = nodes_of(nodes, "event").join(answers, "answer_id")
    return rows.select("article_id", "model_name", F.col("pos").alias("event_pos"), "reasoning", "location", F.col("recency_in_months").cast("int").alias("recency_in_months"))


QUERIES = {"p6_found": p6_found, "p7_found": p7_found, "p7_answer_events": p7_answer_events, "p7_article_impacts": p7_article_impacts, "p7_article_events": p7_article_events}

_ARTICLE_EVENTS = """
        WITH r AS (SELECT DISTINCT features.article_id AS article_id, model_name, features.llm_drought_impacts AS events FROM sample_impacts),
        e AS (SELECT article_id, model_name, CAST(i - 1 AS INT) AS event_pos, events[i] AS event FROM (SELECT *, unnest(range(1, len(events) + 1)) AS i FROM r)),
        k AS (SELECT * FROM e WHERE event IS NOT NULL)"""
ORACLES = {
    "p7_article_events": _ARTICLE_EVENTS + " SELECT article_id, model_name, event_pos, event.reasoning AS reasoning, event.location AS location, event.recency_in_months AS recency_in_months FROM k",
    "p7_article_impacts": _ARTICLE_EVENTS + """,
        x AS (SELECT article_id, model_name, event_pos, CAST(j - 1 AS INT) AS impact_pos, event.impacts[j] AS impact FROM (SELECT *, unnest(range(1, len(event.impacts) + 1)) AS j FROM k))
        SELECT article_id, model_name, event_pos, impact_pos, impact.classification AS classification, impact.severity AS severity, impact.evidence AS evidence, impact.confidence AS confidence, impact.evidence_found_verbatim AS evidence_found_verbatim FROM x WHERE impact IS NOT NULL
        UNION ALL
        SELECT article_id, model_name, event_pos, -1, NULL, NULL, NULL, NULL, NULL FROM k WHERE len(list_filter(coalesce(event.impacts, []), lambda i: i IS NOT NULL)) = 0""",
    "p6_found": """
        WITH p AS (SELECT row_id, geocoded_latitude AS y, geocoded_longitude AS x FROM impacts_geocoded_points WHERE geocoded_latitude BETWEEN -90 AND 90 AND geocoded_longitude BETWEEN -180 AND 180),
        r AS (SELECT nuts_id, unnest(rings) AS ring FROM nuts_regions WHERE level = 3),
        e AS (SELECT nuts_id, ring[i].x AS x1, ring[i].y AS y1, ring[i + 1].x AS x2, ring[i + 1].y AS y2 FROM (SELECT nuts_id, ring, unnest(range(1, len(ring))) AS i FROM r)),
        d AS (SELECT row_id, nuts_id FROM p JOIN e ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
        s AS (SELECT row_id, staid FROM p JOIN cdd_stations t ON abs(p.y - t.latitude) < 0.05
              WHERE 2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(t.latitude - y) / 2), 2) + cos(radians(y)) * cos(radians(t.latitude)) * pow(sin(radians(t.longitude - x) / 2), 2)))) <= 5000)
        SELECT row_id, 'region' AS ref_kind, nuts_id AS ref_id FROM d UNION ALL SELECT row_id, 'station', CAST(staid AS VARCHAR) FROM s""",
}
