"""Models on the whole panel: folds, trials, predictions at every horizon, attributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainledger.functions import domain
from rainledger.functions.dates import month_wave
from rainledger.operators import learning, metrics
from rainledger.plans.panel_queries import panel_all_classes
from rainledger.storage import Workspace

CLASSES = [f"class_{i}" for i in range(len(domain.THEMES))]
#: Features by group, as a manifest gives them.
MANIFEST = {"temporal": ["month_sin", "month_cos"], "impact_lag": ["has_impact_lag1", *[f"{c}_lag1" for c in CLASSES]]}
FEATURES = learning.subsets(MANIFEST, {"temporal": True, "impact_lag": True})
FOLD_YEARS, TRAIN_UNTIL, TEST_YEARS = [2020, 2021, 2022, 2023], 2023, (2024, 2025)
SETTINGS = [{"c": c} for c in (0.001, 0.01, 0.1, 1.0)]


def _rows(spark: SparkSession, sf_dir: str, horizon: int) -> DataFrame:
    """(nuts3_id, year_month, target_year, features, class, y) of every class at a horizon."""
    s, c = month_wave(F.month("year_month"))
    wide = panel_all_classes(spark, sf_dir).withColumns({"month_sin": s, "month_cos": c, "target_year": F.year(F.add_months("year_month", horizon))})
    wide = wide.select("nuts3_id", "year_month", "target_year", *FEATURES, *[F.col(f"{k}_h{horizon}").alias(f"__{k}") for k in CLASSES])
    wide = Workspace(spark, "model-panel").write("rows", wide.toDF(*[n.removeprefix("__") if n.startswith("__") else n for n in wide.columns]))
    return learning.long_targets(wide, ["nuts3_id", "year_month", "target_year", *FEATURES], CLASSES)


def _split(rows: DataFrame) -> DataFrame:
    """Target years until TRAIN_UNTIL train, TEST_YEARS are held out."""
    part = F.when(F.col("target_year") <= TRAIN_UNTIL, "train").when(F.col("target_year").isin(*TEST_YEARS), "valid")
    return rows.withColumn("part", part).where("part is not null")


def _rounded(df: DataFrame, *exact: str) -> DataFrame:
    return df.select(*[c if c in exact else F.round(c, 6).alias(c) for c in df.columns])


def horizon_scores(spark, sf_dir):
    """Seven metrics of each class at each horizon on held-out years, one model per class and horizon."""
    rows = None
    for h in range(4):
        one = _split(_rows(spark, sf_dir, h)).withColumn("horizon", F.lit(h))
        rows = one if rows is None else rows.unionByName(one)
    held = Workspace(spark, "predictions").write("held", learning.fit_predict(rows, FEATURES, ["horizon", "class"], ["nuts3_id", "year_month"], 0.01))
    return _rounded(metrics.evaluated(held, ["horizon", "class"], "y", "y_score"), "horizon", "class", "n", "n_pos")


def macro_by_horizon(spark, sf_dir):
    """Means over classes of the seven metrics at each horizon."""
    return _rounded(metrics.macro_means(horizon_scores(spark, sf_dir), ["horizon"]), "horizon", "n_classes")


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workspace(spark, "trials").write("trials", learning.trials(_rows(spark, sf_dir, 1), FEATURES, FOLD_YEARS, SETTINGS))


def search_trials(spark, sf_dir):
    """Settings by mean macro average precision over expanding folds, with the pruner's marks."""
    return _rounded(learning.trial_table(_trials(spark, sf_dir)), "trial", "params", "n_folds", "pruned", "place")


def class_settings(spark, sf_dir):
    """The best setting of each class."""
    return _rounded(learning.best_per_class(_trials(spark, sf_dir)), "class", "trial", "params")


def class_prevalence(spark, sf_dir):
    """Mean over folds of each class's share of positives at a horizon of one month."""
    return _rounded(learning.class_prevalence(_rows(spark, sf_dir, 1), FOLD_YEARS), "class")


def feature_attributions(spark, sf_dir):
    """Mean absolute attribution of each feature over classes and the classes it matters in."""
    train = _split(_rows(spark, sf_dir, 1)).where("part = 'train'")
    return _rounded(learning.attribution_summary(learning.attributions(train, FEATURES, 0.01)), "feature", "n_classes")


def logit_binary_relevance(spark, sf_dir):
    """Average precision of each class on held-out years at a horizon of one month, beside its prevalence."""
    held = learning.fit_predict(_split(_rows(spark, sf_dir, 1)), FEATURES, ["class"], ["nuts3_id", "year_month"], 0.01)
    out = metrics.predictable(metrics.slices(held, ["class"], "y", "y_score"))
    return _rounded(out.select("class", "n", "n_pos", "prevalence", "ap", "skill", "predictable"), "class", "n", "n_pos", "predictable")


QUERIES = {f.__name__: f for f in (horizon_scores, macro_by_horizon, search_trials, class_settings, class_prevalence, feature_attributions, logit_binary_relevance)}

_FLAGS = ", ".join("max(CASE WHEN classification = '" + c.replace("'", "''") + f"' THEN 1 ELSE 0 END) AS class_{i}" for i, c in enumerate(domain.THEMES))
ORACLES = {
    "class_prevalence": f"""
        WITH e AS (SELECT nuts3_id, CAST(date_trunc('month', publication_date) AS DATE) AS m, {_FLAGS} FROM impacts_geocoded_points WHERE nuts3_id IS NOT NULL AND publication_date IS NOT NULL AND recency_in_months = 0 GROUP BY 1, 2),
        l AS (SELECT * FROM (UNPIVOT e ON {', '.join(CLASSES)} INTO NAME class VALUE y)),
        p AS (SELECT class, year(m) AS y, sum(l.y) / (12.0::DOUBLE * (SELECT count(*) FROM nuts_regions WHERE level = 3)) AS p FROM l WHERE nuts3_id IN (SELECT nuts_id FROM nuts_regions WHERE level = 3) AND year(m) BETWEEN 2020 AND 2023 GROUP BY 1, 2)
        SELECT class, round(sum(p) / 4, 6) AS prevalence FROM (SELECT * FROM p UNION ALL SELECT 'class_' || i, 2020, 0 FROM range({len(CLASSES)}) t(i)) GROUP BY 1""",
}
