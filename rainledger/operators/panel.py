"""Gap-free region x month panels, lags, forward targets and leakage-safe splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def grid(regions: DataFrame, region: str, start: str, end: str) -> DataFrame:
    """Every region in every month. The months are an array exploded per region, so nothing is paired by a join."""
    months = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 month"))
    return regions.select(region).distinct().select(region, F.explode(months).alias("year_month"))


def labelled(panel: DataFrame, events: DataFrame, region: str, classes: list[str], class_col: str = "classification") -> DataFrame:
    """Adds has_impact and one 0/1 column per class: at least one event of the class in the region and month."""
    flags = [F.max(F.when(F.col(class_col) == c, 1).otherwise(0)).alias(f"class_{i}") for i, c in enumerate(classes)]
    by = events.groupBy(region, "year_month").agg(F.lit(1).alias("has_impact"), *flags)
    return panel.join(by, [region, "year_month"], "left").fillna(0, ["has_impact", *[f"class_{i}" for i in range(len(classes))]])


def with_lag_and_targets(panel: DataFrame, region: str, columns: list[str], horizons: range = range(4)) -> DataFrame:
    """Adds <c>_lag1 and <c>_h0.. for each column; the panel must have no gap. One window serves all."""
    w = W.partitionBy(region).orderBy("year_month")
    return panel.withColumns({f"{c}_lag1": F.lag(c, 1).over(w) for c in columns} | {f"{c}_h{h}": F.lead(c, h).over(w) for c in columns for h in horizons})


def complete(panel: DataFrame, columns: list[str]) -> DataFrame:
    return panel.na.drop(subset=columns)


def split_of(horizon: int, train_until: int, test_years: list[int]):
    """train, test or null by the year of the target month."""
    year = F.year(F.add_months("year_month", horizon))
    return F.when(year <= train_until, "train").when(year.isin(test_years), "test")


def expanding_folds(panel: DataFrame, horizon: int, valid_years: list[int]) -> DataFrame:
    """(fold, valid_year, part) beside the rows: for each year train on all target years before it, valid on it.
    A fold without train or valid rows is left out."""
    folds = panel.sparkSession.createDataFrame([(i, y) for i, y in enumerate(valid_years)], "fold int, valid_year int")
    year = F.year(F.add_months("year_month", horizon))
    rows = panel.withColumn("target_year", year).join(F.broadcast(folds), F.col("target_year") <= F.col("valid_year"))
    rows = rows.withColumn("part", F.when(F.col("target_year") == F.col("valid_year"), "valid").otherwise("train"))
    good = rows.groupBy("fold").agg(F.count_if(F.col("part") == "train").alias("t"), F.count_if(F.col("part") == "valid").alias("v")).where("t > 0 and v > 0").select("fold")
    return rows.join(F.broadcast(good), "fold", "left_semi")


def leaks(folds: DataFrame) -> DataFrame:
    """Rows of a fold that are both in train and valid or whose train target isn't before the valid year; must be empty."""
    return folds.where("part = 'train' and target_year >= valid_year or part = 'valid' and target_year <> valid_year")
