from pyspark.sql import functions as F

from rainledger.plans import registry


def test_whole_panel_has_all_months_classes_lags_and_targets(spark, tiny):
    rows = registry.queries()["panel_all_classes"](spark, tiny)
    made = [f"{c}{s}" for c in ["has_impact", *[f"class_{i}" for i in range(20)]] for s in ("", "_lag1", "_h0", "_h1", "_h2", "_h3")]
    assert set(rows.columns) == {"nuts3_id", "year_month", *made}
    months = rows.groupBy("nuts3_id").agg(F.count("*").alias("n"), F.min("year_month").cast("string").alias("low"), F.max("year_month").cast("string").alias("high")).drop("nuts3_id").distinct().collect()
    assert [tuple(r) for r in months] == [(96, "2018-01-01", "2025-12-01")]
    # the first month has its lag and the last ones their targets
    assert rows.na.drop().count() == rows.count() > 0
