"""Writers. Every one writes part files in parallel; nothing is gathered on the driver but small manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainledger.operators.extraction import flat_impacts
from rainledger.storage import Folder


def write_articles(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Fields in the given order, others left out, missing ones empty."""
    out = df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])
    out.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def point_rows(articles: DataFrame) -> DataFrame:
    """One row per article, event and impact; an event without impacts still has one."""
    keep = ["id", "model_name", F.col("features.article_id").alias("article_id"), F.col("features.publication_date").alias("publication_date"), F.col("features.source_file").alias("source_file"), F.col("features.llm_drought_impacts").alias("events")]
    rows = articles.select(*keep)
    return flat_impacts(rows, "events", [c for c in rows.columns if c != "events"])


def region_rows(impacts: DataFrame, assignments: DataFrame, regions: DataFrame, first_parent: bool = False) -> DataFrame:
    """Impacts times their regions, each child with its own parent; with `first_parent` all rows of an impact carry the
    parent of its first region, as older files have it."""
    parents = regions.select(F.col("nuts_id").alias("nuts2_id"), F.col("name").alias("nuts2_name"))
    r = regions.select(F.col("nuts_id").alias("nuts3_id"), F.col("name").alias("nuts3_name"), F.col("parent_id").alias("nuts2_id"))
    named = assignments.withColumnRenamed("region_id", "nuts3_id").join(r, "nuts3_id", "left")
    if first_parent:
        first = named.where("nuts3_id is not null").groupBy("row_id").agg(F.min_by("nuts2_id", "nuts3_id").alias("nuts2_id"))
        named = named.drop("nuts2_id").join(first, "row_id", "left")
    return impacts.join(named.join(parents, "nuts2_id", "left"), "row_id")


def append_checkpoint(batch: DataFrame, path: str) -> None:
    batch.write.mode("append").json(path)


def batch_summary(df: DataFrame, batch: str, date: str, thresholds: dict) -> DataFrame:
    """Counts and date range of each batch with the thresholds in force."""
    return df.groupBy(batch).agg(F.count("*").alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), *[F.lit(v).alias(k) for k, v in thresholds.items()])


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """A small JSON document (best setting, run summary), whole or not at all."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    Folder(spark, folder).write_text(name, json.dumps(document, ensure_ascii=False, indent=2, sort_keys=True))


def read_document(spark: SparkSession, path: str) -> dict:
    folder, name = path.rstrip("/").rsplit("/", 1)
    return json.loads(Folder(spark, folder).read_text(name))


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
