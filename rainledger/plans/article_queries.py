"""Queries over articles and documents: cleaning, duplicates, extraction checks, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainledger.functions import articles, domain, text
from rainledger.operators import extraction, relations, similarity
from rainledger.operators.graph import components
from rainledger.storage import Workspace, table


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per article: the nested record flattened, the smallest row of each id."""
    rows = table(spark, sf_dir, "sample_impacts").select(F.col("features.article_id").alias("article_id"), "id", F.col("meta.source").alias("source"), F.col("meta.original_filename").alias("filename"), F.col("features.title").alias("title"), "text_content", F.col("features.clean_text").alias("clean_text"), F.col("features.source_zip").alias("source_zip"), F.col("features.publication_date").alias("publication_date"))
    return relations.first_by(rows, ["article_id"], [F.col("id"), F.col("source_zip"), F.col("filename"), F.col("source")], [c for c in rows.columns if c != "article_id"])


def text_clean_features(spark, sf_dir):
    """First line, words, squashed fingerprint and ratio of the trimmed to the whole text of each document."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.first_line(t).alias("title"), F.size(text.words(t)).alias("n_words"), F.md5(text.squash(t)).alias("fingerprint"), F.round(F.char_length(F.trim(t)) / F.greatest(F.char_length(t), F.lit(1)), 4).alias("ratio"))


def shingle_counts(spark, sf_dir):
    """Distinct 5-word shingles of each document."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(text.shingles(text.words(F.col("text")), 5)).alias("n_shingles"))


def article_enrichment(spark, sf_dir):
    """Title, dates, body ratio, warning and labelling id of each article's whole text."""
    rows = articles.enrich_articles(_articles(spark, sf_dir).select("article_id", "text_content"), "text_content")
    return rows.select("article_id", "title", "top_date", "bottom_date", "publication_date", "clean_text_ratio", "cleaning_warning", "label_id", F.char_length("clean_text").alias("clean_chars"))


def exact_dedup(spark, sf_dir):
    """The first document of each text, by source then id; empty and null texts are no duplicates."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    filled = relations.first_by(rows.where("text <> ''").select("doc_id", "source", F.md5("text").alias("h")), ["h"], [F.col("source"), F.col("doc_id")], ["doc_id"])
    return filled.select("doc_id").unionAll(rows.where("text = ''").select("doc_id"))


def near_dup_pairs(spark, sf_dir):
    """Pairs of documents of 5-word similarity 0.88 or more; copies are linked to the first only."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return similarity.similar_pairs(rows).select("a", "b", F.round("sim", 6).alias("sim"))


def near_dup_greedy(spark, sf_dir):
    """Documents dropped for a kept one before them, and those without a word."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return similarity.removal_report(rows, similarity.similar_pairs(rows)).select("id", "kept_id", F.round("sim", 4).alias("sim"), "reason")


def title_clusters(spark, sf_dir):
    """Documents in clusters of similar titles, at least two to a cluster."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").where("text is not null")
    roots = components(Workspace(spark, "titles"), similarity.title_pairs(rows))
    titles = rows.select("id", text.squash(text.first_line(F.col("text"))).alias("title")).where("title <> ''")
    first = titles.groupBy("title").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    out = titles.join(first, "title").join(roots.withColumnRenamed("id", "rep"), "rep", "left").where("root is not null or n > 1")
    return out.select(F.coalesce("root", "rep").alias("cluster"), "id")


def medoid_dedup(spark, sf_dir):
    """Members of title clusters dropped for their cluster's medoid."""
    members = title_clusters(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return similarity.medoid_duplicates(members.select("cluster", "id", "text"))


def answer_validation(spark, sf_dir):
    """Answers by outcome of the all-or-nothing validation."""
    rows = extraction.parse_answers(table(spark, sf_dir, "drought_extractions"), "payload")
    return rows.select("extraction_id", F.when(F.col("error").startswith("Error:"), "error").otherwise(F.coalesce("error", F.lit("valid"))).alias("outcome"), F.size("events").alias("n_events"))


def good_articles(spark, sf_dir):
    """Articles whose body is at least 0.30 of their text."""
    rows = articles.enrich_articles(_articles(spark, sf_dir).select("article_id", "text_content"), "text_content")
    return articles.good_articles(rows).select("article_id", "clean_text_ratio")


def evidence_check(spark, sf_dir):
    """Impacts per article and those whose evidence stands in the title or text."""
    rows = table(spark, sf_dir, "sample_impacts").where("features.llm_drought_impacts is not null").select(F.col("features.article_id").alias("article_id"), "model_name", F.col("features.title").alias("title"), "text_content", F.col("features.llm_drought_impacts").alias("events")).distinct()
    checked = rows.withColumn("events", F.transform(F.filter("events", lambda e: e.isNotNull()), lambda e: e.withField("impacts", F.filter(e["impacts"], lambda i: i.isNotNull()))))
    flat = extraction.flat_impacts(checked.withColumn("events", extraction.verbatim(F.col("events"), F.col("title"), F.col("text_content"))), "events", ["article_id", "model_name"])
    return flat.where("impact_pos is not null").groupBy("article_id", "model_name").agg(F.count("*").alias("n_impacts"), F.count_if("evidence_found_verbatim").alias("n_verbatim"))


def extraction_totals(spark, sf_dir):
    """Rows, failed rows, events and impacts per model in one pass."""
    e = F.col("features.llm_drought_impacts")
    impacts = F.aggregate(F.coalesce(e, F.array().cast(table(spark, sf_dir, "sample_impacts").select(e.alias("e")).schema["e"].dataType)), F.lit(0), lambda acc, x: acc + F.coalesce(F.size(x["impacts"]), F.lit(0)))
    return table(spark, sf_dir, "sample_impacts").groupBy("model_name").agg(F.count("*").alias("n"), F.count_if(F.col("features.llm_drought_impact_error").isNotNull()).alias("n_errors"), F.sum(F.when(e.isNull(), 0).otherwise(F.size(e))).alias("n_events"), F.sum(impacts).alias("n_impacts"))


def multiset_prf(spark, sf_dir):
    """Precision, recall and F1 of each model's (location, class) bag against the largest model's, per article of either."""
    rows = table(spark, sf_dir, "impacts_geocoded_points").where("article_id is not null and model_name is not null").select("article_id", "model_name", "location", "classification")
    reference = F.broadcast(relations.first_by(rows.groupBy("model_name").agg(F.count("*").alias("n")).withColumn("one", F.lit(1)), ["one"], [-F.col("n"), F.col("model_name")], [F.col("model_name").alias("reference")]).select("reference"))
    # the bag of the reference stands beside each other model: counted first, so it is small
    others = F.broadcast(rows.select("model_name").distinct().join(reference, F.col("model_name") != F.col("reference")).select("model_name"))
    gold = rows.join(reference, F.col("model_name") == F.col("reference"), "left_semi").drop("model_name").crossJoin(others)
    predicted = rows.join(others, "model_name", "left_semi")
    m = relations.multiset_match(gold, predicted, ["location", "classification"], ["model_name", "article_id"])
    p, r = F.col("n_match") / F.nullif(F.col("n_predicted"), F.lit(0)), F.col("n_match") / F.nullif(F.col("n_gold"), F.lit(0))
    return m.select("model_name", "article_id", "n_gold", "n_predicted", "n_match", F.round(p, 8).alias("precision"), F.round(r, 8).alias("recall"), F.round(domain.f1(p, r), 8).alias("f1"))


def model_precision(spark, sf_dir):
    """Rows with confidence of a half or more against the others, per model of a fixed list, zero rows included."""
    models = ["aurora/reader-large", "aurora/reader-mini", "delta/extract-2", "polder/news-7", "none/absent"]
    sums = table(spark, sf_dir, "impacts_geocoded_points").groupBy("model_name").agg(F.count_if(F.col("confidence") >= 0.5).alias("tp"), F.count_if(F.col("confidence") < 0.5).alias("fp"))
    out = relations.filled(sums, "model_name", models, ["tp", "fp"])
    return out.select("model_name", "tp", "fp", F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), 3).alias("precision"))


def corpus_text(spark, sf_dir):
    """Characters of the first filled of text_content and clean_text, and of the first filled in the other order."""
    a, b = (text.blank_to_null(F.col(c)) for c in ("text_content", "clean_text"))
    return _articles(spark, sf_dir).select("article_id", F.char_length(F.coalesce(a, b)).alias("text_first"), F.char_length(F.coalesce(b, a)).alias("clean_first"))


def title_lookup(spark, sf_dir):
    """Title of each article, else its file name without ending, else its id."""
    return _articles(spark, sf_dir).select("article_id", F.coalesce(text.blank_to_null(F.col("title")), text.blank_to_null(text.without_extension(F.col("filename"))), F.col("id")).alias("title"))


def batch_manifest(spark, sf_dir):
    """Articles and dates per archive beside the announced number of files."""
    by = _articles(spark, sf_dir).groupBy("source_zip").agg(F.count("*").alias("n_articles"), F.min("publication_date").alias("first_date"), F.max("publication_date").alias("last_date"))
    return table(spark, sf_dir, "archive_batches").join(by, "source_zip", "left").select("source_zip", "n_files", F.coalesce("n_articles", F.lit(0)).alias("n_articles"), "first_date", "last_date")


def semi_anti_pending(spark, sf_dir):
    """Articles without a label, and labels without an article."""
    a, b = _articles(spark, sf_dir).select("article_id"), table(spark, sf_dir, "article_labels").select("article_id")
    return relations.pending(a, b, "article_id").withColumn("side", F.lit("unlabelled")).unionAll(relations.pending(b, a, "article_id").withColumn("side", F.lit("unknown")))


def label_upsert(spark, sf_dir):
    """Labels with those of even articles replaced and a column added."""
    base = table(spark, sf_dir, "article_labels")
    changes = base.where("article_id % 2 = 0").select("article_id", F.lit("nl").alias("lang_label"), F.lit(True).alias("checked"))
    return relations.upsert(base.withColumn("checked", F.lit(False)), changes, ["article_id"])


def union_by_name(spark, sf_dir):
    """Stations and customers' nations in one frame, missing columns null."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return a.unionByName(b, allowMissingColumns=True)


def set_difference(spark, sf_dir):
    """Sources of documents that no article names, and those of both."""
    a = table(spark, sf_dir, "documents").select("source").where("source is not null").distinct()
    b = table(spark, sf_dir, "sample_impacts").select(F.col("meta.source").alias("source")).where("source is not null").distinct()
    return a.exceptAll(b).withColumn("kind", F.lit("only")).unionAll(a.intersect(b).withColumn("kind", F.lit("both")))


QUERIES = {f.__name__: f for f in (text_clean_features, shingle_counts, article_enrichment, exact_dedup, near_dup_pairs, near_dup_greedy, title_clusters, medoid_dedup, answer_validation, good_articles, evidence_check, extraction_totals, multiset_prf, model_precision, corpus_text, title_lookup, batch_manifest, semi_anti_pending, label_upsert, union_by_name, set_difference)}

_A = "(SELECT DISTINCT features.article_id AS article_id, id, meta.original_filename AS filename, features.title AS title, text_content, features.clean_text AS clean_text, features.source_zip AS source_zip, features.publication_date AS publication_date FROM sample_impacts)"
_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')"
_FOLD = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', ' ', 'g'))"

ORACLES = {
    "text_clean_features": """
        SELECT doc_id, coalesce(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: trim(x)), lambda x: x <> '')[1], '') AS title,
               CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS INT) AS n_words, md5(trim(regexp_replace(lower(text), '[\\s\\x0b\\x85\\p{Z}]+', ' ', 'g'))) AS fingerprint,
               round(CAST(length(trim(text)) AS DOUBLE) / greatest(length(text), 1), 4) AS ratio FROM documents WHERE text IS NOT NULL""",
    "shingle_counts": f"""
        WITH w AS (SELECT doc_id, {_W} AS w FROM documents WHERE text IS NOT NULL),
        s AS (SELECT doc_id, len(w) AS n, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS r FROM w)
        SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 WHEN n < 5 THEN 1 ELSE len(list_distinct(r)) END AS INT) AS n_shingles FROM s""",
    "exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents)
        SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS k FROM d) WHERE k = 1 OR text = ''""",
    "near_dup_pairs": f"""
        WITH w AS (SELECT doc_id AS id, {_W} AS w FROM documents WHERE text IS NOT NULL),
        g AS (SELECT DISTINCT id, s FROM (SELECT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w)),
        n AS (SELECT id, count(*) AS n, list_sort(list(s)) AS all_s FROM g GROUP BY id),
        r AS (SELECT id, n, min(id) OVER (PARTITION BY all_s) AS rep FROM n),
        c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.id < b.id WHERE a.id IN (SELECT rep FROM r) AND b.id IN (SELECT rep FROM r) GROUP BY ALL)
        SELECT a, b, round(k / (x.n + y.n - k), 6) AS sim FROM c JOIN r x ON x.id = a JOIN r y ON y.id = b WHERE CAST(k AS DOUBLE) / (x.n + y.n - k) >= 0.88
        UNION ALL SELECT rep, id, 1.0 FROM r WHERE id <> rep""",
    "evidence_check": f"""
        WITH r AS (SELECT DISTINCT features.article_id AS article_id, model_name, features.title AS title, text_content, features.llm_drought_impacts AS events FROM sample_impacts WHERE features.llm_drought_impacts IS NOT NULL),
        e AS (SELECT article_id, model_name, concat_ws(chr(10), title, text_content) AS hay, unnest(events) AS e FROM r), i AS (SELECT article_id, model_name, hay, unnest(e.impacts) AS i FROM e),
        q AS (SELECT article_id, model_name, {_FOLD.format("hay")} AS hay, trim(regexp_replace({_FOLD.format("i.evidence")}, '^["''“”‘’ ]+|["''“”‘’ ]+$', '', 'g')) AS needle FROM i WHERE i IS NOT NULL)
        SELECT article_id, model_name, count(*) AS n_impacts, count(*) FILTER (needle <> '' AND contains(hay, needle)) AS n_verbatim FROM q GROUP BY ALL""",
    "extraction_totals": """
        SELECT model_name, count(*) AS n, count(features.llm_drought_impact_error) AS n_errors, CAST(sum(coalesce(len(features.llm_drought_impacts), 0)) AS BIGINT) AS n_events,
               CAST(sum(coalesce(list_sum(list_transform(features.llm_drought_impacts, lambda e: coalesce(len(e.impacts), 0))), 0)) AS BIGINT) AS n_impacts FROM sample_impacts GROUP BY 1""",
    "multiset_prf": """
        WITH r AS (SELECT article_id, model_name, location, classification FROM impacts_geocoded_points WHERE article_id IS NOT NULL AND model_name IS NOT NULL),
        f AS (SELECT model_name FROM r GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), m AS (SELECT DISTINCT model_name FROM r WHERE model_name NOT IN (FROM f)),
        g AS (SELECT m.model_name, article_id, location, classification, count(*) AS g FROM r, m WHERE r.model_name IN (FROM f) GROUP BY ALL),
        p AS (SELECT model_name, article_id, location, classification, count(*) AS p FROM r WHERE model_name IN (FROM m) GROUP BY ALL),
        b AS (SELECT coalesce(g.model_name, p.model_name) AS model_name, coalesce(g.article_id, p.article_id) AS article_id, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM g FULL JOIN p ON g.model_name = p.model_name AND g.article_id = p.article_id AND g.location IS NOT DISTINCT FROM p.location AND g.classification IS NOT DISTINCT FROM p.classification),
        s AS (SELECT model_name, article_id, CAST(sum(g) AS BIGINT) AS n_gold, CAST(sum(p) AS BIGINT) AS n_predicted, CAST(sum(least(g, p)) AS BIGINT) AS n_match FROM b GROUP BY 1, 2)
        SELECT *, round(n_match / nullif(n_predicted, 0), 8) AS precision, round(n_match / nullif(n_gold, 0), 8) AS recall, round(2.0::DOUBLE * n_match / nullif(CASE WHEN n_match > 0 THEN n_gold + n_predicted END, 0), 8) AS f1 FROM s""",
    "model_precision": """
        WITH m AS (SELECT unnest(['aurora/reader-large', 'aurora/reader-mini', 'delta/extract-2', 'polder/news-7', 'none/absent']) AS model_name),
        s AS (SELECT model_name, count(*) FILTER (confidence >= 0.5) AS tp, count(*) FILTER (confidence < 0.5) AS fp FROM impacts_geocoded_points GROUP BY 1)
        SELECT model_name, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, round(tp / nullif(tp + fp, 0), 3) AS precision FROM m LEFT JOIN s USING (model_name)""",
    "corpus_text": f"SELECT article_id, CAST(length(coalesce(a, b)) AS INT) AS text_first, CAST(length(coalesce(b, a)) AS INT) AS clean_first FROM (SELECT article_id, CASE WHEN trim(text_content) <> '' THEN text_content END AS a, CASE WHEN trim(clean_text) <> '' THEN clean_text END AS b FROM {_A})",
    "title_lookup": f"SELECT article_id, coalesce(CASE WHEN trim(title) <> '' THEN title END, CASE WHEN trim(regexp_replace(filename, '(?i)\\.docx?$', '')) <> '' THEN regexp_replace(filename, '(?i)\\.docx?$', '') END, id) AS title FROM {_A}",
    "batch_manifest": f"SELECT source_zip, n_files, coalesce(n, 0) AS n_articles, first_date, last_date FROM archive_batches LEFT JOIN (SELECT source_zip, count(*) AS n, min(publication_date) AS first_date, max(publication_date) AS last_date FROM {_A} GROUP BY 1) USING (source_zip)",
    "semi_anti_pending": "WITH a AS (SELECT DISTINCT features.article_id AS article_id FROM sample_impacts) SELECT article_id, 'unlabelled' AS side FROM a WHERE article_id NOT IN (SELECT article_id FROM article_labels) UNION ALL SELECT article_id, 'unknown' FROM article_labels WHERE article_id NOT IN (SELECT article_id FROM a)",
    "label_upsert": "SELECT article_id, CASE WHEN article_id % 2 = 0 THEN 'nl' ELSE lang_label END AS lang_label, article_id % 2 = 0 AS checked FROM article_labels",
    "union_by_name": "SELECT s_name AS name, s_acctbal AS balance, CAST(NULL AS INT) AS region FROM supplier UNION ALL SELECT n_name, NULL, n_regionkey FROM nation",
    "set_difference": "WITH a AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), b AS (SELECT DISTINCT meta.source AS source FROM sample_impacts WHERE meta.source IS NOT NULL) SELECT source, CASE WHEN b.source IS NULL THEN 'only' ELSE 'both' END AS kind FROM a LEFT JOIN b USING (source)",
}

_TITLE = "trim(regexp_replace(lower(coalesce(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: regexp_replace(x, '^[\\s\\x0b\\x85\\p{Z}]+|[\\s\\x0b\\x85\\p{Z}]+$', '', 'g')), lambda x: x <> '')[1], '')), '[\\s\\x0b\\x85\\p{Z}]+', ' ', 'g'))"
ORACLES["near_dup_greedy"] = f"""
        WITH RECURSIVE p AS ({ORACLES["near_dup_pairs"]}),
        o AS (SELECT id, coalesce(list(a) FILTER (a IS NOT NULL), []) AS prev, row_number() OVER (ORDER BY id) AS k FROM (SELECT DISTINCT id FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p)) LEFT JOIN p ON b = id GROUP BY id),
        w(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT o.k, CASE WHEN len(list_intersect(w.kept, o.prev)) > 0 THEN w.kept ELSE list_append(w.kept, o.id) END FROM w JOIN o ON o.k = w.k + 1),
        s AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM w ORDER BY k DESC LIMIT 1)),
        d AS (SELECT b AS id, a AS kept_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY sim DESC, a) AS n FROM p WHERE a IN (SELECT id FROM s) AND b NOT IN (SELECT id FROM s)) WHERE n = 1)
        SELECT id, kept_id, round(sim, 4) AS sim, 'near_duplicate' AS reason FROM d UNION ALL SELECT doc_id, NULL, NULL, 'empty_text' FROM documents WHERE text IS NULL OR len({_W}) = 0"""
ORACLES["title_clusters"] = f"""
        WITH RECURSIVE t AS (SELECT doc_id AS id, {_TITLE} AS title FROM documents WHERE text IS NOT NULL), f AS (SELECT title, min(id) AS rep, count(*) AS n, string_split(title, ' ') AS w FROM t WHERE title <> '' GROUP BY title),
        g AS (SELECT rep, n, w[1] AS word, list_distinct(CASE WHEN len(w) < 3 THEN [title] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS s FROM f),
        e AS (SELECT a.rep AS a, b.rep AS b FROM g a JOIN g b ON a.word = b.word AND a.rep <> b.rep WHERE len(list_intersect(a.s, b.s)) / CAST(len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS DOUBLE) >= 0.85),
        r AS (SELECT a AS id, b AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a), m AS (SELECT id AS rep, least(id, min(other)) AS root FROM r GROUP BY id)
        SELECT coalesce(root, f.rep) AS cluster, t.id FROM t JOIN f USING (title) LEFT JOIN m ON m.rep = f.rep WHERE root IS NOT NULL OR n > 1"""
_IN = lambda values: ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v) for v in values)
ORACLES["answer_validation"] = f"""
        WITH j AS (SELECT extraction_id, payload, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN CAST(payload AS JSON) END AS j FROM drought_extractions),
        k AS (SELECT *, json_type(j, '$.events') AS t, coalesce(TRY_CAST(json_extract(j, '$.events') AS JSON[]), []) AS events FROM j),
        e AS (SELECT extraction_id, unnest(events) AS e FROM k WHERE t = 'ARRAY'),
        i AS (SELECT extraction_id, unnest(CAST(json_extract(e, '$.impacts') AS JSON[])) AS i FROM e WHERE json_type(e, '$.impacts') = 'ARRAY'),
        b AS (SELECT extraction_id FROM e WHERE NOT coalesce(json_type(e) = 'OBJECT' AND trim(json_extract_string(e, '$.location')) <> '' AND json_type(e, '$.recency_in_months') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract_string(e, '$.recency_in_months') AS INT) IN ({_IN(domain.RECENCIES)}) AND json_type(e, '$.impacts') = 'ARRAY', false)
              UNION SELECT extraction_id FROM i WHERE NOT coalesce(json_type(i) = 'OBJECT' AND json_extract_string(i, '$.classification') IN ({_IN(domain.THEMES)}) AND json_type(i, '$.severity') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract_string(i, '$.severity') AS INT) IN ({_IN(domain.SEVERITIES)})
                AND json_type(i, '$.confidence') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(json_extract_string(i, '$.confidence') AS DOUBLE) IN ({_IN(domain.CONFIDENCES)}) AND length(trim(json_extract_string(i, '$.evidence'))) BETWEEN 1 AND {domain.LONGEST_EVIDENCE}, false)),
        o AS (SELECT *, CASE WHEN coalesce(trim(payload) = '', true) THEN 'empty' WHEN starts_with(payload, 'Error:') THEN 'error' WHEN j IS NULL THEN 'not an extraction object' WHEN coalesce(t NOT IN ('ARRAY', 'NULL'), false) OR extraction_id IN (SELECT extraction_id FROM b) THEN 'invalid value' ELSE 'valid' END AS outcome FROM k)
        SELECT extraction_id, outcome, CAST(CASE WHEN outcome = 'valid' THEN len(events) ELSE 0 END AS INT) AS n_events FROM o"""
