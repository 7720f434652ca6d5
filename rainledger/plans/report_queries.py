"""Summaries, evaluation tables, rankings, samples and filters of a report on the impact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainledger.functions import domain, text
from rainledger.functions.dates import month_of
from rainledger.operators import evaluation, metrics, relations
from rainledger.storage import table

#: Example prices (input, output) per million tokens and published counts: small tables that a user replaces.
PRICES = [("aurora/reader-large", 1.5, 9.0), ("aurora/reader-mini", 0.1, 0.4), ("polder/news-7", 0.75, 3.0)]
PUBLISHED = [("aurora/reader-large", 40, 3), ("delta/extract-2", 5, 2)]
LONGEST_TEXT = 50_000


def _impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "impacts_geocoded_points")


def dataset_summary(spark, sf_dir):
    """(metric, value): rows, articles, models and the rows of each class, absent classes included."""
    rows = _impacts(spark, sf_dir)
    totals = rows.agg(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in (("rows", F.count("*")), ("articles", F.count_distinct("article_id")), ("models", F.count_distinct("model_name")))]).alias("a"))
    by = relations.filled(rows.groupBy("classification").agg(F.count("*").alias("value")), "classification", list(domain.THEMES), ["value"])
    return totals.select(F.explode("a").alias("x")).select("x.*").unionAll(by.select(F.concat(F.lit("class: "), "classification").alias("metric"), "value"))


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model and article: attributes that are there (tp) and that are missing (fn)."""
    there = {"location": F.col("geocoded_latitude").isNotNull(), "severity": F.col("severity").isNotNull(), "recency": F.col("recency_in_months").isNotNull()}
    return _impacts(spark, sf_dir).groupBy("model_name", "article_id").agg(*[F.count_if(c if k == "tp" else ~c).alias(f"{f}_{k}") for f, c in there.items() for k in ("tp", "fn")])


def recall_by_model(spark, sf_dir):
    """Sums of the attribute reviews of each model with the recall of each attribute and the mean of the recalls."""
    return evaluation.recalls(_reviews(spark, sf_dir), "model_name", ["location", "severity", "recency"])


def adjusted_counts(spark, sf_dir):
    """Counted true and false rows of each model beside published ones, and their differences."""
    raw = _impacts(spark, sf_dir).where("model_name is not null").groupBy("model_name").agg(F.count_if(F.col("confidence") >= 0.5).alias("tp"), F.count_if(F.col("confidence") < 0.5).alias("fp"))
    return evaluation.adjusted(raw, spark.createDataFrame(PUBLISHED, "model_name string, tp bigint, fp bigint"), "model_name", ["tp", "fp"])


def usage_totals(spark, sf_dir):
    """Rows, failures, tokens (a quarter of the characters) and cost of each model."""
    rows, payload = table(spark, sf_dir, "drought_extractions"), F.col("payload")
    prompt, completion = F.lit(500).cast("bigint"), F.floor(F.char_length(F.coalesce(payload, F.lit(""))) / 4)
    prices = spark.createDataFrame(PRICES, "model_name string, price_in double, price_out double")
    out = evaluation.usage(rows, "model_name", prompt, completion, F.coalesce(payload.startswith("Error:"), F.lit(True)), prices)
    return out.withColumn("cost", F.round("cost", 8))


def best_class_per_model(spark, sf_dir):
    """The class of the highest mean confidence of each model."""
    by = _impacts(spark, sf_dir).where("classification is not null and model_name is not null").groupBy("model_name", "classification").agg(F.round(F.avg("confidence"), 8).alias("score"))
    return evaluation.best_per(by, "model_name", "score", "classification")


def numeric_describe(spark, sf_dir):
    out = relations.describe(_impacts(spark, sf_dir), ["severity", "confidence", "recency_in_months", "mention_weight"])
    return out.select("column_name", "n", "n_null", *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "q25", "median", "q75", "high")])


def ranged_total(spark, sf_dir):
    """Rows and weight of the months of 2022 and 2023 and their monthly mean."""
    by = _impacts(spark, sf_dir).where("publication_date is not null").groupBy(month_of(F.col("publication_date")).alias("m")).agg(F.count("*").alias("n"), F.sum("mention_weight").alias("w"))
    return by.where(F.year("m").between(2022, 2023)).agg(F.sum("n").alias("n"), F.round(F.sum("w"), 6).alias("weight"), F.round(F.sum("n") / 24, 8).alias("monthly_mean"))


def step_counters(spark, sf_dir):
    """What each cleaning step of documents takes away: null, blank, repeated and kept texts, in one pass and an aggregate by text."""
    rows = table(spark, sf_dir, "documents").select("text", F.md5("text").alias("h"))
    kind = F.when(F.col("text").isNull(), "null").when(F.trim("text") == "", "blank").otherwise("text")
    by = rows.groupBy(kind.alias("kind"), "h").agg(F.count("*").alias("n"))
    one = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    kept = F.count_if(F.col("kind") == "text")
    return by.agg(F.sum("n").alias("n_input"), one("null").alias("n_null"), one("blank").alias("n_blank"), (one("text") - kept).alias("n_repeated"), kept.alias("n_kept"))


def rank_table(spark, sf_dir):
    """Place types by falling rank, then name, with the rank of all others as the last row."""
    rows = spark.createDataFrame([*domain.PLACE_RANKS.items(), (None, domain.DEFAULT_RANK)], "place_type string, place_rank int")
    return relations.ranked(rows, [F.col("place_type").isNull(), F.desc("place_rank"), F.col("place_type")])


def bins_in_order(spark, sf_dir):
    """Rows of each drought bin in the order dry, near normal, wet."""
    by = _impacts(spark, sf_dir).groupBy(domain.drought_bin(F.col("confidence") * 4 - 2).alias("drought_bin")).agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*[F.lit(b) for b in domain.DROUGHT_BINS]), F.col("drought_bin"))
    return relations.ranked(by, [place])


def region_rank(spark, sf_dir):
    """Regions by falling score: mean confidence above the mean of all rows, else minus the mean squared error to 1."""
    rows = _impacts(spark, sf_dir).where("nuts3_id is not null and confidence between 0 and 1")
    by = rows.groupBy("nuts3_id").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 8).alias("mean"), F.round(F.avg(F.pow(1 - F.col("confidence"), 2)), 8).alias("error"))
    score = F.coalesce(F.when(F.col("n") >= 5, F.col("mean")), -F.col("error"))
    return relations.ranked(by.select("nuts3_id", score.alias("rank_score")), [F.desc("rank_score"), F.col("nuts3_id")])


def article_prefix(spark, sf_dir):
    """The first 50 extractions by id (a limit is the feature)."""
    return table(spark, sf_dir, "drought_extractions").select("extraction_id", "model_name").orderBy("extraction_id").limit(50)


def sample_rows(spark, sf_dir):
    """A seeded queue of 200 rows (the feature), with its order."""
    rows = relations.seeded_sample(_impacts(spark, sf_dir).select("row_id", "classification"), "row_id", 200, 42)
    return relations.ranked(rows, [relations.seeded_order(F.col("row_id"), 42), F.col("row_id")])


def sample_tenth(spark, sf_dir):
    """Rows and weight of a seeded tenth of all rows (the feature)."""
    return relations.seeded_fraction(_impacts(spark, sf_dir), "row_id", 0.1, 7).agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


def title_order(spark, sf_dir):
    """Titles of documents that occur more than once, by falling count, then title."""
    titles = table(spark, sf_dir, "documents").select(text.squash(F.col("title")).alias("title")).where("title <> ''")
    by = titles.groupBy("title").agg(F.count("*").alias("n")).where("n > 1")
    return relations.ranked(by, [F.desc("n"), F.col("title")])


def extreme_regions(spark, sf_dir):
    """The five regions with the most rows and the one with the least."""
    by = _impacts(spark, sf_dir).where("nuts3_id is not null").groupBy("nuts3_id").agg(F.count("*").alias("n"))
    top = by.orderBy(F.desc("n"), "nuts3_id").limit(5).withColumn("side", F.lit("top"))
    return top.unionAll(by.orderBy("n", "nuts3_id").limit(1).withColumn("side", F.lit("bottom")))


def meteo_divergence(spark, sf_dir):
    """Years in which scaled impact counts and scaled season-end values lie at least 0.41 apart, and which is higher."""
    impacts = _impacts(spark, sf_dir).where("publication_date is not null and recency_in_months = 0").groupBy(F.year("publication_date").alias("year")).agg(F.count("*").cast("double").alias("value"))
    days = _impacts(spark, sf_dir).where("publication_date is not null").groupBy(F.col("publication_date").alias("date")).agg(F.max("severity").cast("double").alias("v"), F.count("*").alias("n"))
    season = relations.season_end(days.withColumn("v", F.coalesce("v", F.lit(0.0)) + F.col("n")), "date", "v")
    out = evaluation.divergence(impacts, season, "year", "value", 0.41)
    return out.select("year", *[F.round(c, 8).alias(c) for c in ("a", "b", "difference")], "side")


def review_filter(spark, sf_dir):
    """Articles whose label is one of the reviewed kinds."""
    return table(spark, sf_dir, "article_labels").where(F.col("lang_label").isin("nl", "de")).select("article_id", "lang_label")


def shared_articles(spark, sf_dir):
    """Rows per model of a fixed list of nine articles."""
    return relations.restricted(_impacts(spark, sf_dir), "article_id", list(range(1, 10))).groupBy("model_name").agg(F.count("*").alias("n"))


def country_class_filter(spark, sf_dir):
    """Wildfires of the home country by month."""
    rows = _impacts(spark, sf_dir).where(F.col("classification").isin("Wildfire Occurrence", "Wildfire Risk Increase") & (F.lower("geocoded_country_code") == "nl") & F.col("publication_date").isNotNull())
    return rows.groupBy(month_of(F.col("publication_date")).alias("year_month"), "classification").agg(F.count("*").alias("n"))


def nested_class_filter(spark, sf_dir):
    """Articles with an impact of a class anywhere in their events, found without flattening, and the number of such impacts."""
    events = F.col("features.llm_drought_impacts")
    hits = F.aggregate(events, F.lit(0), lambda a, e: a + F.coalesce(F.size(F.filter(e["impacts"], lambda i: F.coalesce(i["classification"] == "Crop Failure & Yield Reduction", F.lit(False)))), F.lit(0)))
    rows = table(spark, sf_dir, "sample_impacts").select(F.col("features.article_id").alias("article_id"), "model_name", F.coalesce(hits, F.lit(0)).alias("n_hits"))
    return rows.where("n_hits > 0").distinct()


def null_safe_class_join(spark, sf_dir):
    """Counts of place types joined to their rows' mean severity, the missing type included."""
    rows = _impacts(spark, sf_dir)
    counts = rows.groupBy("geocoded_place_type").agg(F.count("*").alias("n"))
    means = rows.groupBy("geocoded_place_type").agg(F.round(F.avg("severity"), 8).alias("mean_severity"))
    return relations.null_safe_join(counts, means, ["geocoded_place_type"])


def review_join(spark, sf_dir):
    """Extraction answers beside the first review of their article; articles reviewed but not extracted are told apart."""
    reviews = relations.first_by(_impacts(spark, sf_dir).where("article_id is not null"), ["article_id"], [F.col("row_id")], ["row_id", "classification"])
    answers = table(spark, sf_dir, "drought_extractions").select("extraction_id", "article_id")
    both = answers.join(reviews, "article_id").select("article_id", "extraction_id", "classification", F.lit("reviewed").alias("side"))
    missing = reviews.join(answers.select("article_id").distinct(), "article_id", "left_anti")
    return both.unionByName(missing.select("article_id", F.lit(None).cast("bigint").alias("extraction_id"), "classification", F.lit("missing").alias("side")))


def resume_in_order(spark, sf_dir):
    """Every article with its newest answer's length, null where it is still open, at its place in the input."""
    inputs = table(spark, sf_dir, "article_labels").select("article_id").distinct()
    inputs = relations.ranked(inputs, [F.col("article_id")])
    newest = relations.first_by(table(spark, sf_dir, "drought_extractions"), ["article_id"], [-F.unix_micros(F.col("created_at").cast("timestamp")), -F.col("extraction_id")], ["payload"])
    return relations.in_order(inputs, newest.select("article_id", F.char_length("payload").alias("answer_chars")), "article_id", "place", ["answer_chars"])


def batch_filter(spark, sf_dir):
    """Why each article leaves its batch: no readable date, more than 50,000 characters, or the text of an earlier article in batch order."""
    batches = table(spark, sf_dir, "archive_batches").groupBy("source_zip").agg(F.min("batch_no").alias("batch_no"))
    rows = table(spark, sf_dir, "sample_impacts").select(F.col("features.article_id").alias("article_id"), F.col("features.source_zip").alias("source_zip"), F.col("features.publication_date").alias("date"), F.coalesce("text_content", F.lit("")).alias("text")).groupBy("article_id").agg(F.min(F.struct("source_zip", "date", "text")).alias("r")).select("article_id", "r.*")
    dated = F.try_to_timestamp(F.col("date"), F.lit("yyyy-MM-dd")).isNotNull()
    rows = rows.join(F.broadcast(batches), "source_zip", "left").select("article_id", F.coalesce("batch_no", F.lit(0x7FFFFFFF)).alias("batch_no"), F.md5("text").alias("h"), (F.col("text") == "").alias("blank"), F.when(~F.coalesce(dated, F.lit(False)), "no date").when(F.char_length("text") > LONGEST_TEXT, "too long").alias("reason"))
    first = rows.where("reason is null and not blank").groupBy("h").agg(F.min(F.struct("batch_no", "article_id")).alias("f")).select("h", F.col("f.article_id").alias("first"))
    repeated = F.col("reason").isNull() & ~F.col("blank") & (F.col("article_id") != F.col("first"))
    return rows.join(first, "h", "left").select("article_id", F.coalesce("reason", F.when(repeated, "repeated"), F.lit("kept")).alias("reason"))


def record_shaping(spark, sf_dir):
    """Flat rows assembled to nested records and read back field by field."""
    flat = _impacts(spark, sf_dir).where("article_id is not null")
    meta = F.struct(F.col("publication_date").cast("string").alias("date"), F.lit(None).cast("string").alias("source"), F.col("source_file").alias("original_filename"))
    labels = F.struct(F.col("confidence").alias("relevance_score"), F.array(F.col("classification")).alias("sectors"), F.array(F.struct(F.col("location").alias("mention"), F.array_compact(F.array("nuts3_id")).alias("nuts3_codes"))).alias("spatial_targets"))
    record = flat.select("row_id", F.struct(F.col("id").alias("id"), meta.alias("meta"), labels.alias("labels")).alias("r"))
    return record.select("row_id", "r.id", "r.meta.original_filename", F.col("r.meta.date").alias("date"), F.col("r.labels.sectors")[0].alias("sector"), F.col("r.labels.spatial_targets")[0]["mention"].alias("mention"), F.size(F.col("r.labels.spatial_targets")[0]["nuts3_codes"]).alias("n_codes"))


def month_union(spark, sf_dir):
    """The months in which anything was published or loaded."""
    return relations.union_of([month_of(F.col("publication_date")), month_of(F.to_date("loaded_at"))], _impacts(spark, sf_dir), "year_month")


def fold_means(spark, sf_dir):
    """Mean and sample deviation of the yearly mean confidence of each class (folds are years)."""
    by = _impacts(spark, sf_dir).where("classification is not null and publication_date is not null and confidence between 0 and 1").groupBy("classification", F.year("publication_date").alias("fold")).agg(F.avg("confidence").alias("score"))
    return metrics.fold_stats(by, ["classification"], "score").select("classification", "n_folds", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def running_fold_means(spark, sf_dir):
    """Mean over the folds so far of each class, and whether a median pruner stops it there."""
    by = _impacts(spark, sf_dir).where("classification is not null and publication_date is not null and confidence between 0 and 1 and year(publication_date) between 2018 and 2023").groupBy("classification", F.year("publication_date").alias("fold")).agg(F.avg("confidence").alias("score"))
    return metrics.pruned_runs(by, "classification", "fold", "score", warm_up=1).select("classification", "fold", F.round("running", 5).alias("running"), "pruned")


QUERIES = {f.__name__: f for f in (dataset_summary, recall_by_model, adjusted_counts, usage_totals, best_class_per_model, numeric_describe, ranged_total, step_counters, rank_table, bins_in_order, region_rank, article_prefix, sample_rows, sample_tenth, title_order, extreme_regions, meteo_divergence, review_filter, shared_articles, country_class_filter, nested_class_filter, null_safe_class_join, review_join, resume_in_order, batch_filter, record_shaping, month_union, fold_means, running_fold_means)}

_I = "impacts_geocoded_points"


def _values(rows: list[tuple], names: str) -> str:
    one = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"(VALUES {', '.join('(' + ', '.join(one(v) for v in r) + ')' for r in rows)}) AS v({names})"


_RECALL = lambda f: f"CASE WHEN {f}_tp + {f}_fn > 0 THEN round(CAST({f}_tp AS DOUBLE) / ({f}_tp + {f}_fn), 4) END"

ORACLES = {
    "dataset_summary": f"""
        SELECT 'rows' AS metric, count(*) AS value FROM {_I} UNION ALL SELECT 'articles', count(DISTINCT article_id) FROM {_I} UNION ALL SELECT 'models', count(DISTINCT model_name) FROM {_I}
        UNION ALL SELECT 'class: ' || c, coalesce(n, 0) FROM {_values([(c,) for c in domain.THEMES], 'c')} LEFT JOIN (SELECT classification AS c, count(*) AS n FROM {_I} GROUP BY 1) USING (c)""",
    "recall_by_model": f"""
        WITH r AS (SELECT model_name, article_id, """ + ", ".join(f"count({c}) AS {f}_tp, count(*) - count({c}) AS {f}_fn" for f, c in (("location", "geocoded_latitude"), ("severity", "severity"), ("recency", "recency_in_months"))) + f""" FROM {_I} GROUP BY ALL),
        s AS (SELECT model_name, count(*) AS n_reviews, """ + ", ".join(f"CAST(sum({f}_{k}) AS BIGINT) AS {f}_{k}" for f in ("location", "severity", "recency") for k in ("tp", "fn")) + f""" FROM r GROUP BY 1),
        q AS (SELECT *, """ + ", ".join(f"{_RECALL(f)} AS {f}_recall" for f in ("location", "severity", "recency")) + """ FROM s)
        SELECT *, round(list_avg([location_recall, severity_recall, recency_recall]), 4) AS overall_recall FROM q""",
    "adjusted_counts": f"""
        WITH r AS (SELECT model_name, count(*) FILTER (confidence >= 0.5) AS tp, count(*) FILTER (confidence < 0.5) AS fp FROM {_I} WHERE model_name IS NOT NULL GROUP BY 1)
        SELECT r.model_name, r.tp, r.fp, coalesce(v.tp, 0) AS tp_published, coalesce(v.fp, 0) AS fp_published, r.tp - coalesce(v.tp, 0) AS tp_difference, r.fp - coalesce(v.fp, 0) AS fp_difference FROM r LEFT JOIN {_values(PUBLISHED, 'model_name, tp, fp')} ON v.model_name = r.model_name""",
    "usage_totals": f"""
        WITH s AS (SELECT model_name, count(*) AS n, count(*) FILTER (coalesce(starts_with(payload, 'Error:'), true)) AS n_failed, CAST(sum(500) AS BIGINT) AS prompt_tokens, CAST(sum(length(coalesce(payload, '')) // 4) AS BIGINT) AS completion_tokens FROM drought_extractions GROUP BY 1)
        SELECT s.*, round((prompt_tokens * price_in::DOUBLE + completion_tokens * price_out::DOUBLE) / 1e6, 8) AS cost FROM s LEFT JOIN {_values(PRICES, 'm, price_in, price_out')} ON m = model_name""",
    "best_class_per_model": f"""
        WITH s AS (SELECT model_name, classification, round(avg(confidence), 8) AS score FROM {_I} WHERE classification IS NOT NULL AND model_name IS NOT NULL GROUP BY 1, 2)
        SELECT model_name, classification, score FROM (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY score DESC, classification) AS k FROM s WHERE score IS NOT NULL) WHERE k = 1""",
    "numeric_describe": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, count(*) - count({c}) AS n_null, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS low, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, round(max({c})::DOUBLE, 6) AS high FROM {_I}" for c in ("severity", "confidence", "recency_in_months", "mention_weight")),
    "ranged_total": f"SELECT count(*) AS n, round(sum(mention_weight), 6) AS weight, round(count(*) / 24.0::DOUBLE, 8) AS monthly_mean FROM {_I} WHERE year(publication_date) BETWEEN 2022 AND 2023",
    "step_counters": "SELECT count(*) AS n_input, count(*) - count(text) AS n_null, count(*) FILTER (trim(text) = '') AS n_blank, count(*) FILTER (trim(text) <> '') - count(DISTINCT text) FILTER (trim(text) <> '') AS n_repeated, count(DISTINCT text) FILTER (trim(text) <> '') AS n_kept FROM documents",
    "rank_table": f"SELECT place_type, CAST(place_rank AS INT) AS place_rank, CAST(row_number() OVER (ORDER BY place_type IS NULL, place_rank DESC, place_type) AS INT) AS place FROM {_values([*domain.PLACE_RANKS.items(), (None, domain.DEFAULT_RANK)], 'place_type, place_rank')}",
    "bins_in_order": f"WITH b AS (SELECT CASE WHEN confidence * 4 - 2 <= -1 THEN 'dry' WHEN confidence * 4 - 2 >= 1 THEN 'wet' ELSE 'near_normal' END AS drought_bin FROM {_I}) SELECT drought_bin, count(*) AS n, CAST(row_number() OVER (ORDER BY drought_bin) AS INT) AS place FROM b GROUP BY 1",
    "region_rank": f"""
        WITH s AS (SELECT nuts3_id, count(*) AS n, round(avg(confidence), 8) AS m, round(avg(pow(1 - confidence, 2)), 8) AS e FROM {_I} WHERE nuts3_id IS NOT NULL AND confidence BETWEEN 0 AND 1 GROUP BY 1), k AS (SELECT nuts3_id, CASE WHEN n >= 5 THEN m ELSE -e END AS rank_score FROM s)
        SELECT *, CAST(row_number() OVER (ORDER BY rank_score DESC, nuts3_id) AS INT) AS place FROM k""",
    "article_prefix": "SELECT extraction_id, model_name FROM drought_extractions ORDER BY extraction_id LIMIT 50",
    "sample_rows": f"SELECT row_id, classification, CAST(row_number() OVER (ORDER BY md5(row_id || ':42'), row_id) AS INT) AS place FROM {_I} QUALIFY place <= 200",
    "sample_tenth": f"SELECT count(*) AS n, min(row_id) AS first, max(row_id) AS last FROM {_I} WHERE CAST('0x' || md5(row_id || ':7')[1:8] AS BIGINT) < CAST(floor(0.1 * 4294967296) AS BIGINT)",
    "title_order": "WITH t AS (SELECT trim(regexp_replace(lower(title), '[\\s\\x0b\\x85\\p{Z}]+', ' ', 'g')) AS title FROM documents), c AS (SELECT title, count(*) AS n FROM t WHERE title <> '' GROUP BY 1 HAVING count(*) > 1) SELECT title, n, CAST(row_number() OVER (ORDER BY n DESC, title) AS INT) AS place FROM c",
    "extreme_regions": f"WITH c AS (SELECT nuts3_id, count(*) AS n FROM {_I} WHERE nuts3_id IS NOT NULL GROUP BY 1) (SELECT nuts3_id, n, 'top' AS side FROM c ORDER BY n DESC, nuts3_id LIMIT 5) UNION ALL (SELECT nuts3_id, n, 'bottom' FROM c ORDER BY n, nuts3_id LIMIT 1)",
    "meteo_divergence": f"""
        WITH i AS (SELECT year(publication_date) AS year, CAST(count(*) AS DOUBLE) AS x FROM {_I} WHERE publication_date IS NOT NULL AND recency_in_months = 0 GROUP BY 1),
        d AS (SELECT publication_date AS date, coalesce(max(severity), 0) + count(*) AS v FROM {_I} WHERE month(publication_date) BETWEEN 4 AND 9 GROUP BY 1),
        s AS (SELECT year(date) AS year, CAST(coalesce(max(v) FILTER (month(date) = 9 AND day(date) = 30), arg_max(v, date)) AS DOUBLE) AS y FROM d GROUP BY 1),
        j AS (SELECT CAST(year AS INT) AS year, CASE WHEN max(x) OVER () > min(x) OVER () THEN (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) ELSE 0 END AS a, CASE WHEN max(y) OVER () > min(y) OVER () THEN (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) ELSE 0 END AS b FROM i JOIN s USING (year))
        SELECT year, round(a, 8) AS a, round(b, 8) AS b, round(a - b, 8) AS difference, CASE WHEN a - b >= 0.41 THEN 'first' WHEN a - b <= -0.41 THEN 'second' ELSE 'alike' END AS side FROM j""",
    "review_filter": "SELECT article_id, lang_label FROM article_labels WHERE lang_label IN ('nl', 'de')",
    "shared_articles": f"SELECT model_name, count(*) AS n FROM {_I} WHERE article_id BETWEEN 1 AND 9 GROUP BY 1",
    "country_class_filter": f"SELECT CAST(date_trunc('month', publication_date) AS DATE) AS year_month, classification, count(*) AS n FROM {_I} WHERE classification IN ('Wildfire Occurrence', 'Wildfire Risk Increase') AND lower(geocoded_country_code) = 'nl' AND publication_date IS NOT NULL GROUP BY 1, 2",
    "nested_class_filter": """
        WITH r AS (SELECT DISTINCT features.article_id AS article_id, model_name, features.llm_drought_impacts AS events FROM sample_impacts),
        e AS (SELECT article_id, model_name, events, unnest(events) AS e FROM r), i AS (SELECT article_id, model_name, events, unnest(e.impacts) AS i FROM e)
        SELECT article_id, model_name, CAST(count(*) AS INT) AS n_hits FROM i WHERE i.classification = 'Crop Failure & Yield Reduction' GROUP BY article_id, model_name, events""",
    "null_safe_class_join": f"SELECT geocoded_place_type, count(*) AS n, round(avg(severity), 8) AS mean_severity FROM {_I} GROUP BY 1",
    "review_join": f"""
        WITH r AS (SELECT article_id, arg_min(classification, row_id) AS classification FROM (SELECT article_id, row_id, classification FROM {_I} WHERE article_id IS NOT NULL) GROUP BY 1),
        f AS (SELECT article_id, classification FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY row_id) AS k FROM {_I} WHERE article_id IS NOT NULL) WHERE k = 1)
        SELECT a.article_id, extraction_id, classification, 'reviewed' AS side FROM drought_extractions a JOIN f USING (article_id)
        UNION ALL SELECT article_id, NULL, classification, 'missing' FROM f WHERE article_id NOT IN (SELECT article_id FROM drought_extractions WHERE article_id IS NOT NULL)""",
    "resume_in_order": """
        WITH i AS (SELECT article_id, CAST(row_number() OVER (ORDER BY article_id) AS INT) AS place FROM (SELECT DISTINCT article_id FROM article_labels)),
        n AS (SELECT article_id, CAST(length(payload) AS INT) AS answer_chars FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC NULLS FIRST, extraction_id DESC) AS k FROM drought_extractions) WHERE k = 1)
        SELECT i.article_id, place, answer_chars FROM i LEFT JOIN n USING (article_id)""",
    "batch_filter": """
        WITH b AS (SELECT source_zip, min(batch_no) AS batch_no FROM archive_batches GROUP BY 1),
        r AS (SELECT DISTINCT features.article_id AS article_id, coalesce(batch_no, 2147483647) AS batch_no, features.publication_date AS date, coalesce(text_content, '') AS text FROM sample_impacts LEFT JOIN b ON b.source_zip = features.source_zip),
        q AS (SELECT *, CASE WHEN try_strptime(date, '%Y-%m-%d') IS NULL THEN 'no date' WHEN length(text) > 50000 THEN 'too long' END AS reason FROM r),
        k AS (SELECT *, row_number() OVER (PARTITION BY reason, text ORDER BY batch_no, article_id) AS n FROM q)
        SELECT article_id, coalesce(reason, CASE WHEN text <> '' AND n > 1 THEN 'repeated' ELSE 'kept' END) AS reason FROM k""",
    "record_shaping": f"SELECT row_id, id, source_file AS original_filename, CAST(publication_date AS VARCHAR) AS date, classification AS sector, location AS mention, CASE WHEN nuts3_id IS NULL THEN 0 ELSE 1 END AS n_codes FROM {_I} WHERE article_id IS NOT NULL",
    "month_union": f"SELECT DISTINCT m AS year_month FROM (SELECT CAST(date_trunc('month', publication_date) AS DATE) AS m FROM {_I} UNION ALL SELECT CAST(date_trunc('month', loaded_at) AS DATE) FROM {_I}) WHERE m IS NOT NULL",
    "fold_means": f"WITH s AS (SELECT classification, avg(confidence) AS s FROM {_I} WHERE classification IS NOT NULL AND publication_date IS NOT NULL AND confidence BETWEEN 0 AND 1 GROUP BY classification, year(publication_date)) SELECT classification, count(*) AS n_folds, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std FROM s GROUP BY 1",
    "running_fold_means": f"""
        WITH s AS (SELECT classification, CAST(year(publication_date) AS INT) AS fold, avg(confidence) AS s FROM {_I} WHERE classification IS NOT NULL AND publication_date IS NOT NULL AND confidence BETWEEN 0 AND 1 AND year(publication_date) BETWEEN 2018 AND 2023 GROUP BY 1, 2),
        r AS (SELECT classification, fold, avg(s) OVER w AS running, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY classification ORDER BY fold)),
        m AS (SELECT k, median(running) AS middle FROM r GROUP BY 1)
        SELECT classification, fold, round(running, 5) AS running, k > 1 AND round(running, 6) < round(middle, 6) AS pruned FROM r JOIN m USING (k)""",
}
