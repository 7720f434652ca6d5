"""Panels, splits, metrics, calendars and zonal statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainledger.functions import domain
from rainledger.functions.dates import month_of, month_wave
from rainledger.functions.projection import metric_grid
from rainledger.operators import metrics, panel, relations
from rainledger.storage import table

#: The months of the panel; those it is made over, for the first lag and the last targets.
FIRST, LAST = "2018-01-01", "2025-12-01"
BEFORE, AFTER = "2017-12-01", "2026-03-01"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "impacts_geocoded_points").where("nuts3_id is not null and publication_date is not null and recency_in_months = 0")
    return rows.select("nuts3_id", month_of(F.col("publication_date")).alias("year_month"), "classification")


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every level-3 region in every month of the panel."""
    regions = table(spark, sf_dir, "nuts_regions").where("level = 3").select(F.col("nuts_id").alias("nuts3_id"))
    return panel.grid(regions, "nuts3_id", FIRST, LAST)


def panel_lag_lead(spark, sf_dir):
    """Region x month grid with the flag, lag and forward targets of any impact."""
    return panel_all_classes(spark, sf_dir).select("nuts3_id", "year_month", "has_impact", "has_impact_lag1", *[f"has_impact_h{h}" for h in range(4)])


def panel_all_classes(spark, sf_dir):
    """The whole panel: 96 months, every class (class_<i> in the order of domain.THEMES) with flag, lag and targets.
    Lags and targets are made on a grid one month longer before and three after, so that trimming costs none."""
    regions = table(spark, sf_dir, "nuts_regions").where("level = 3").select(F.col("nuts_id").alias("nuts3_id"))
    classes = list(domain.THEMES)
    rows = panel.labelled(panel.grid(regions, "nuts3_id", BEFORE, AFTER), _events(spark, sf_dir), "nuts3_id", classes)
    wide = panel.with_lag_and_targets(rows, "nuts3_id", ["has_impact", *[f"class_{i}" for i in range(len(classes))]])
    return wide.where(F.col("year_month").between(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date")))


def panel_complete(spark, sf_dir):
    """Complete rows of the panel by year."""
    whole = panel.complete(panel_all_classes(spark, sf_dir), [f"{c}{x}" for c in _ALL for x in ("_lag1", "_h0", "_h1", "_h2", "_h3")])
    return whole.groupBy(F.year("year_month").alias("year")).agg(F.count("*").alias("n"), F.sum(F.col("has_impact").cast("bigint")).alias("n_impact"))


def panel_waves(spark, sf_dir):
    """Months with their sine and cosine."""
    s, c = month_wave(F.month("year_month"))
    return _months(spark, sf_dir).select("year_month").distinct().select("year_month", (F.round(s, 8) + 0.0).alias("month_sin"), (F.round(c, 8) + 0.0).alias("month_cos"))


def expanding_folds(spark, sf_dir):
    """Rows of each fold's parts at a horizon of one month."""
    folds = panel.expanding_folds(_months(spark, sf_dir), 1, [2020, 2021, 2022, 2023])
    return folds.groupBy("fold", "valid_year", "part").agg(F.count("*").alias("n"), F.min("year_month").alias("first_month"), F.max("year_month").alias("last_month"))


def target_year_split(spark, sf_dir):
    """Rows by train and test part at each horizon."""
    rows = _months(spark, sf_dir).select("year_month")
    parts = None
    for h in range(4):
        one = rows.select(F.lit(h).alias("horizon"), panel.split_of(h, 2023, [2024, 2025]).alias("part"))
        parts = one if parts is None else parts.unionAll(one)
    return parts.where("part is not null").groupBy("horizon", "part").agg(F.count("*").alias("n"))


def fold_leaks(spark, sf_dir):
    """Leaking rows of the folds: none."""
    return panel.leaks(panel.expanding_folds(_months(spark, sf_dir), 1, [2020, 2021, 2022, 2023])).select("nuts3_id", "year_month", "fold")


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed score beside a truth: severity 2 or more."""
    rows = table(spark, sf_dir, "impacts_geocoded_points").where("severity is not null and classification is not null")
    score = (F.col("row_id") * 7919 + F.col("severity") * 211) % 1000 / 1000.0
    return rows.select(F.col("classification").alias("class"), F.when(F.col("severity") >= 2, 1).otherwise(0).alias("y_true"), score.alias("y_score"), F.month("publication_date").alias("month"), domain.drought_bin(F.col("confidence") * 4 - 2).alias("drought_bin"), "nuts3_id")


def avg_precision_by_class(spark, sf_dir):
    return metrics.average_precision(_predictions(spark, sf_dir), ["class"], "y_true", "y_score").select("class", F.round("ap", 8).alias("ap"))


def roc_auc_by_class(spark, sf_dir):
    return metrics.roc_auc(_predictions(spark, sf_dir), ["class"], "y_true", "y_score").select("class", F.round("auc", 8).alias("auc"))


def brier_skill(spark, sf_dir):
    """Point scores, average precision and skill of each class."""
    out = metrics.predictable(metrics.slices(_predictions(spark, sf_dir), ["class"], "y_true", "y_score"))
    return out.select("class", "n", "n_pos", *[F.round(c, 8).alias(c) for c in ("prevalence", "mean_pred", "brier", "precision", "recall", "f1", "ap", "skill")], "predictable")


def macro_by_bin(spark, sf_dir):
    """Macro means over classes in each drought bin."""
    out = metrics.macro(metrics.slices(_predictions(spark, sf_dir), ["class", "drought_bin"], "y_true", "y_score"), ["drought_bin"])
    return out.select("drought_bin", "n", "n_pos", "n_classes", "n_scored", *[F.round(c, 8).alias(c) for c in ("macro_ap", "macro_skill", "macro_brier")])


def season_vs_all(spark, sf_dir):
    """Scores of all months and of June to August side by side with their difference."""
    rows = _predictions(spark, sf_dir)
    a = metrics.average_precision(rows, ["class"], "y_true", "y_score").withColumnRenamed("ap", "ap_all")
    b = metrics.average_precision(rows.where(F.col("month").isin(6, 7, 8)), ["class"], "y_true", "y_score").withColumnRenamed("ap", "ap_jja")
    return a.join(b, "class", "full").select("class", F.round("ap_all", 8).alias("ap_all"), F.round("ap_jja", 8).alias("ap_jja"), F.round(F.col("ap_jja") - F.col("ap_all"), 8).alias("delta"))


def prediction_long(spark, sf_dir):
    """Wide flags of the panel as (region, month, class, y), counted per class, all classes."""
    names = [f"class_{i}" for i in range(len(domain.THEMES))]
    wide = panel_all_classes(spark, sf_dir).select("nuts3_id", "year_month", *names)
    return wide.unpivot(["nuts3_id", "year_month"], names, "class", "y_true").groupBy("class").agg(F.count("*").alias("n"), F.sum(F.col("y_true").cast("bigint")).alias("n_pos"))


def _slices(keys: list[str]):
    def query(spark, sf_dir):
        out = metrics.slices(_predictions(spark, sf_dir).where("nuts3_id is not null and month is not null"), keys, "y_true", "y_score")
        return out.select(*keys, "n", "n_pos", *[F.round(c, 8).alias(c) for c in ("prevalence", "mean_pred", "brier", "ap", "skill")])

    query.__name__, query.__doc__ = "slices_by_" + "_".join(keys), f"Slice metrics by {', '.join(keys)}."
    return query


#: Key lists of the slice diagnostics.
SLICES = [["month"], ["drought_bin"], ["nuts3_id"], ["class", "month"], ["class", "drought_bin"], ["class", "nuts3_id"]]
SLICE_QUERIES = [_slices(keys) for keys in SLICES]


def macro_by_month(spark, sf_dir):
    """Macro means over classes in each calendar month."""
    out = metrics.macro(metrics.slices(_predictions(spark, sf_dir).where("month is not null"), ["class", "month"], "y_true", "y_score"), ["month"])
    return out.select("month", "n", "n_pos", "n_classes", "n_scored", *[F.round(c, 8).alias(c) for c in ("macro_ap", "macro_skill", "macro_brier")])


def month_spine_fill(spark, sf_dir):
    """Orders of every month from 1994 to 2002, zero where there are none, scaled to 0..1."""
    by = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.count("*").alias("n"))
    return relations.min_max(relations.month_spine(by, "month", ["n"], "1994-01-01", "2002-12-01"), "n", "scaled").select("month", "n", F.round("scaled", 8).alias("scaled"))


def series_corr(spark, sf_dir):
    """Correlation of monthly order counts with monthly prices."""
    by = table(spark, sf_dir, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("p"))
    return by.agg(F.round(F.corr("n", "p"), 6).alias("r"))


def season_end_value(spark, sf_dir):
    """The last order value of each season: that of 30 September, else the last from April on."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("v"))
    return relations.season_end(days, "date", "v")


def quartile_dominance(spark, sf_dir):
    """Parts by price quartile band and the leading type of each band."""
    banded = relations.quartile_band(table(spark, sf_dir, "part"), "p_retailprice", "band")
    return relations.dominant(banded, ["band"], "p_type").select("band", F.col("dominant").alias("leading_type"), "dominant_count", "total")


def metric_points(spark, sf_dir):
    """Stations on the metric grid."""
    x, y = metric_grid(F.col("latitude"), F.col("longitude"))
    return table(spark, sf_dir, "cdd_stations").where("latitude is not null and longitude is not null").select("staid", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def bbox_clip(spark, sf_dir):
    """Impacts in the clip box of the climate grids."""
    return table(spark, sf_dir, "impacts_geocoded_points").where(F.col("geocoded_latitude").between(50.75, 53.55) & F.col("geocoded_longitude").between(3.35, 7.25)).select("row_id")


QUERIES = {f.__name__: f for f in (panel_lag_lead, panel_all_classes, panel_complete, panel_waves, expanding_folds, target_year_split, fold_leaks, avg_precision_by_class, roc_auc_by_class, brier_skill, macro_by_bin, season_vs_all, prediction_long, month_spine_fill, series_corr, season_end_value, quartile_dominance, metric_points, bbox_clip, macro_by_month, *SLICE_QUERIES)}

_MONTHS = f"""m AS (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 MONTH)) AS DATE) AS year_month), g AS (SELECT DISTINCT nuts_id AS nuts3_id, m.year_month FROM nuts_regions, m WHERE level = 3)"""
_P = """p AS (SELECT classification AS class, CASE WHEN severity >= 2 THEN 1 ELSE 0 END AS y, (row_id * 7919 + severity * 211) % 1000 / 1000.0::DOUBLE AS s, month(publication_date) AS month,
    CASE WHEN confidence * 4 - 2 <= -1 THEN 'dry' WHEN confidence * 4 - 2 >= 1 THEN 'wet' ELSE 'near_normal' END AS drought_bin, nuts3_id FROM impacts_geocoded_points WHERE severity IS NOT NULL AND classification IS NOT NULL)"""


def _ap(keys: str, source: str, name: str) -> str:
    return f"""{name}_g AS (SELECT {keys}, s, CAST(sum(y) AS DOUBLE) AS tp, CAST(count(*) AS DOUBLE) AS n FROM {source} GROUP BY ALL),
    {name}_c AS (SELECT {keys}, tp, n, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY {keys}) AS pos, sum(n) OVER (PARTITION BY {keys}) AS al FROM {name}_g WINDOW w AS (PARTITION BY {keys} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
    {name} AS (SELECT {keys}, CASE WHEN max(pos) > 0 AND max(pos) < max(al) THEN sum(tp / pos * ctp / cn) END AS ap, sum((ctp - tp) * (n - tp) + tp * (n - tp) / 2) / nullif(max(pos) * (max(al) - max(pos)), 0) AS auc FROM {name}_c GROUP BY ALL)"""


def _scores(keys: str, source: str = "p") -> str:
    return f"""q AS (SELECT {keys}, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, avg(y) AS prevalence, avg(s) AS mean_pred, avg((s - y) * (s - y)) AS brier, CAST(count(*) FILTER (s >= 0.5 AND y = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (s >= 0.5 AND y = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (s < 0.5 AND y = 1) AS DOUBLE) AS fn FROM {source} GROUP BY ALL),
    r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM q),
    z AS (SELECT r.*, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, CASE WHEN n_pos >= 5 THEN a.ap END AS ap, CASE WHEN n_pos >= 5 THEN a.ap END - prevalence AS skill FROM r JOIN a USING ({keys}))"""


_ALL = ["has_impact", *[f"class_{i}" for i in range(len(domain.THEMES))]]


def _all_classes() -> str:
    """By joins with the months before and after, no window."""
    flags = ", ".join("max(CASE WHEN classification = '" + c.replace("'", "''") + f"' THEN 1 ELSE 0 END) AS class_{i}" for i, c in enumerate(domain.THEMES))
    shifts = {"": 0, "_lag1": -1} | {f"_h{h}": h for h in range(4)}
    joins = " ".join(f"LEFT JOIN e AS e{s} ON e{s}.nuts3_id = g.nuts3_id AND e{s}.year_month = g.year_month + to_months({n})" for s, n in shifts.items())
    cols = ", ".join(f"coalesce(e{s}.{c}, 0) AS {c}{s}" for c in _ALL for s in shifts)
    return f"""
        WITH e AS (SELECT nuts3_id, CAST(date_trunc('month', publication_date) AS DATE) AS year_month, 1 AS has_impact, {flags} FROM impacts_geocoded_points WHERE nuts3_id IS NOT NULL AND publication_date IS NOT NULL AND recency_in_months = 0 GROUP BY 1, 2),
        m AS (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 MONTH)) AS DATE) AS year_month),
        g AS (SELECT DISTINCT nuts_id AS nuts3_id, m.year_month FROM nuts_regions, m WHERE level = 3)
        SELECT g.nuts3_id, g.year_month, {cols} FROM g {joins}"""


ORACLES = {
    "panel_all_classes": _all_classes(),
    "panel_lag_lead": "SELECT nuts3_id, year_month, has_impact, has_impact_lag1, has_impact_h0, has_impact_h1, has_impact_h2, has_impact_h3 FROM (" + _all_classes() + ")",
    "panel_complete": "SELECT CAST(year(year_month) AS INT) AS year, count(*) AS n, CAST(sum(has_impact) AS BIGINT) AS n_impact FROM (" + _all_classes() + ") GROUP BY 1",
    "panel_waves": f"WITH {_MONTHS} SELECT year_month, round(sin(month(year_month) * 2 * pi() / 12), 8) + 0.0 AS month_sin, round(cos(month(year_month) * 2 * pi() / 12), 8) + 0.0 AS month_cos FROM m",
    "expanding_folds": f"""
        WITH {_MONTHS}, t AS (SELECT year_month, year(year_month + INTERVAL 1 MONTH) AS ty FROM g), k AS (SELECT CAST(i AS INT) AS fold, CAST(2020 + i AS INT) AS valid_year FROM range(4) r(i))
        SELECT fold, valid_year, CASE WHEN ty = valid_year THEN 'valid' ELSE 'train' END AS part, count(*) AS n, min(year_month) AS first_month, max(year_month) AS last_month FROM t JOIN k ON ty <= valid_year GROUP BY ALL""",
    "target_year_split": f"""
        WITH {_MONTHS}, h AS (SELECT CAST(i AS INT) AS horizon FROM range(4) r(i)), t AS (SELECT horizon, year(year_month + to_months(horizon)) AS ty FROM g, h)
        SELECT horizon, CASE WHEN ty <= 2023 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM t WHERE ty <= 2025 GROUP BY ALL""",
    "fold_leaks": "SELECT CAST(NULL AS VARCHAR) AS nuts3_id, CAST(NULL AS DATE) AS year_month, CAST(NULL AS INT) AS fold WHERE false",
    "avg_precision_by_class": f"WITH {_P}, {_ap('class', 'p', 'a')} SELECT class, round(ap, 8) AS ap FROM a",
    "roc_auc_by_class": f"WITH {_P}, {_ap('class', 'p', 'a')} SELECT class, round(auc, 8) AS auc FROM a",
    "brier_skill": f"WITH {_P}, {_ap('class', 'p', 'a')}, {_scores('class')} SELECT class, n, n_pos, " + ", ".join(f"round({c}, 8) AS {c}" for c in ("prevalence", "mean_pred", "brier", "precision", "recall", "f1", "ap", "skill")) + ", coalesce(skill >= 0.15 AND ap >= 0.25, false) AS predictable FROM z",
    "macro_by_bin": f"WITH {_P}, {_ap('class, drought_bin', 'p', 'a')}, {_scores('class, drought_bin')} SELECT drought_bin, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_pos) AS BIGINT) AS n_pos, count(*) AS n_classes, count(ap) AS n_scored, round(avg(ap), 8) AS macro_ap, round(avg(skill), 8) AS macro_skill, round(avg(brier), 8) AS macro_brier FROM z GROUP BY 1",
    "season_vs_all": f"WITH {_P}, j AS (SELECT * FROM p WHERE month IN (6, 7, 8)), {_ap('class', 'p', 'a')}, {_ap('class', 'j', 'b')} SELECT coalesce(a.class, b.class) AS class, round(a.ap, 8) AS ap_all, round(b.ap, 8) AS ap_jja, round(b.ap - a.ap, 8) AS delta FROM a FULL JOIN b ON a.class = b.class",
    "prediction_long": " UNION ALL ".join(f"SELECT 'class_{i}' AS class, count(*) AS n, CAST(sum(class_{i}) AS BIGINT) AS n_pos FROM ({_all_classes()})" for i in range(len(domain.THEMES))),
    "macro_by_month": f"WITH {_P}, pm AS (SELECT * FROM p WHERE month IS NOT NULL), {_ap('class, month', 'pm', 'a')}, {_scores('class, month', 'pm')} SELECT CAST(month AS INT) AS month, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_pos) AS BIGINT) AS n_pos, count(*) AS n_classes, count(ap) AS n_scored, round(avg(ap), 8) AS macro_ap, round(avg(skill), 8) AS macro_skill, round(avg(brier), 8) AS macro_brier FROM z GROUP BY 1",
    **{f"slices_by_{'_'.join(k)}": f"WITH {_P}, pm AS (SELECT * FROM p WHERE month IS NOT NULL AND nuts3_id IS NOT NULL), {_ap(', '.join(k), 'pm', 'a')}, {_scores(', '.join(k), 'pm')} SELECT {', '.join('CAST(month AS INT) AS month' if x == 'month' else x for x in k)}, n, n_pos, " + ", ".join(f"round({c}, 8) AS {c}" for c in ("prevalence", "mean_pred", "brier", "ap", "skill")) + " FROM z" for k in SLICES},
    "month_spine_fill": """
        WITH o AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT CAST(unnest(generate_series(DATE '1994-01-01', DATE '2002-12-01', INTERVAL 1 MONTH)) AS DATE) AS month),
        s AS (SELECT month, coalesce(n, 0) AS n FROM m LEFT JOIN o USING (month)) SELECT month, n, round(CASE WHEN max(n) OVER () <> min(n) OVER () THEN (n - min(n) OVER ()) / CAST(max(n) OVER () - min(n) OVER () AS DOUBLE) ELSE 0 END, 8) AS scaled FROM s""",
    "series_corr": "SELECT round(corr(n, p), 6) AS r FROM (SELECT count(*) AS n, sum(o_totalprice) AS p FROM orders GROUP BY date_trunc('month', o_orderdate))",
    "season_end_value": """
        WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS v FROM orders GROUP BY 1), s AS (SELECT * FROM d WHERE month(date) BETWEEN 4 AND 9)
        SELECT CAST(year(date) AS INT) AS year, coalesce(max(v) FILTER (month(date) = 9 AND day(date) = 30), arg_max(v, date)) AS value FROM s GROUP BY 1""",
    "quartile_dominance": """
        WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS q1, quantile_cont(p_retailprice, 0.75) AS q3 FROM part), b AS (SELECT CASE WHEN p_retailprice >= q3 THEN 'high' WHEN p_retailprice <= q1 THEN 'low' ELSE 'mid' END AS band, p_type FROM part, q),
        n AS (SELECT band, p_type, count(*) AS n FROM b GROUP BY ALL)
        SELECT band, p_type AS leading_type, n AS dominant_count, total FROM (SELECT *, sum(n) OVER (PARTITION BY band)::BIGINT AS total, row_number() OVER (PARTITION BY band ORDER BY n DESC, p_type) AS k FROM n) WHERE k = 1""",
    "metric_points": "WITH d AS (SELECT staid, 0.36 * (latitude - 52.15517440) AS a, 0.36 * (longitude - 5.38720621) AS b FROM cdd_stations WHERE latitude IS NOT NULL AND longitude IS NOT NULL) SELECT staid, round(155000 + " + " + ".join(f"({v}) * pow(a, {p}) * pow(b, {q})" for p, q, v in [(0, 1, 190094.945), (1, 1, -11832.228), (2, 1, -114.221), (0, 3, -32.391), (1, 0, -0.705), (3, 1, -2.340), (1, 3, -0.608), (0, 2, -0.008), (2, 3, 0.148)]) + ", 3) AS x, round(463000 + " + " + ".join(f"({v}) * pow(a, {p}) * pow(b, {q})" for p, q, v in [(1, 0, 309056.544), (0, 2, 3638.893), (2, 0, 73.077), (1, 2, -157.984), (3, 0, 59.788), (0, 1, 0.433), (2, 2, -6.439), (1, 1, -0.032), (0, 4, 0.092), (1, 4, -0.054)]) + ", 3) AS y FROM d",
    "bbox_clip": "SELECT row_id FROM impacts_geocoded_points WHERE geocoded_latitude BETWEEN 50.75 AND 53.55 AND geocoded_longitude BETWEEN 3.35 AND 7.25",
}
