"""Queries of the operators on document text, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainledger.llm.canonical import map_values
from rainledger.llm.encoding import encode
from rainledger.llm.incremental import IncrementalDeduper, rejected_articles
from rainledger.llm.language import document_languages, fit_profiles, mislabelled_lines, named_labels
from rainledger.llm.mixing import mix_documents
from rainledger.llm.near_duplicates import near_duplicate_groups
from rainledger.llm.page_lines import page_templates, repeated_lines
from rainledger.llm.residue import residue_documents
from rainledger.storage import Workspace, table


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The rejected articles of all archives, and the store they were rejected by."""
    articles = table(spark, sf_dir, "sample_impacts").select(F.col("features.article_id").alias("id"), F.col("features.source_zip").alias("source_zip"), F.col("features.clean_text").alias("text"))
    store = Workspace(spark, "history").path("store")
    return rejected_articles(articles, table(spark, sf_dir, "archive_batches"), store), store


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id_a, article_id_b): every rejected article with the accepted one it repeats, smaller id first."""
    a, b = F.col("article").cast("int"), (F.col("match") % (1 << 32)).cast("int")
    return _history(spark, sf_dir)[0].select(F.least(a, b).alias("article_id_a"), F.greatest(a, b).alias("article_id_b"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, cluster): the representative of every article in a cluster of accepted articles and what repeats them,
    read from the store by a deduper that did not write it."""
    rows = IncrementalDeduper(spark, _history(spark, sf_dir)[1]).mapping()
    return rows.select((F.col("id") % (1 << 32)).cast("int").alias("article_id"), (F.col("representative") % (1 << 32)).cast("int").alias("cluster"))


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sample_impacts").select(F.col("features.article_id").alias("id"), F.col("meta.source").alias("source"), F.col("features.clean_text").alias("text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, line_no): lines of clean_text that stand in many articles of their source."""
    return repeated_lines(_sourced(spark, sf_dir)).select(F.col("id").alias("article_id"), "line_no")


def p2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, template, documents, forms): templates with learned slots that cover many articles of their source."""
    return page_templates(_sourced(spark, sf_dir))


def _texts_and_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = table(spark, sf_dir, "sample_impacts").select(F.col("features.article_id").alias("id"), F.col("text_content").alias("text"))
    return texts, table(spark, sf_dir, "article_labels").select(F.col("article_id").alias("id"), "lang_label")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, line_no, lang): lines of text_content in another language than the article's label names."""
    return mislabelled_lines(*_texts_and_labels(spark, sf_dir)).select(F.col("id").alias("article_id"), "line_no", "lang")


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article once, judged as a whole and in segments."""
    texts, labels = _texts_and_labels(spark, sf_dir)
    profiles = fit_profiles(texts.join(named_labels(labels).where("lang is not null"), "id"))
    return document_languages(texts.where("id is not null").groupBy("id").agg(F.min("text").alias("text")), profiles)


def p5_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, lang, confidence) of every article."""
    return _languages(spark, sf_dir).select(F.col("id").alias("article_id"), "lang", F.round("confidence", 4).alias("confidence"))


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, segment_no, first_line, last_line, letters, lang, confidence) of the segments of mixed articles."""
    rows = _languages(spark, sf_dir).where(F.size("segments") > 1).select(F.col("id").alias("article_id"), F.posexplode("segments").alias("segment_no", "s"))
    return rows.select("article_id", "segment_no", "s.first_line", "s.last_line", "s.letters", "s.lang", F.round("s.confidence", 4).alias("confidence"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document by byte_bpe_50k."""
    return encode(table(spark, sf_dir, "documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, field, ref_id): the entry of place_list that each typed location and nuts3_name means, `-` if none."""
    points = table(spark, sf_dir, "impacts_geocoded_points")
    return map_values(points, "row_id", {"location": False, "nuts3_name": True}, table(spark, sf_dir, "place_list"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, article_id): groups of articles of 3-word similarity 0.7 or more in text_content."""
    texts = table(spark, sf_dir, "sample_impacts").select(F.col("features.article_id").alias("id"), F.col("text_content").alias("text"))
    return near_duplicate_groups(texts).select(F.col("group_id").cast("int").alias("group_id"), F.col("id").cast("int").alias("article_id"))


def _mixes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return mix_documents(texts, table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reached beside wanted share, tokens, documents and most repeats of every source of every mix."""
    return _mixes(spark, sf_dir)[1]


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mix_id, doc_id, source, tokens, repeats): the documents of every mix."""
    return _mixes(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): documents with unfilled fields or filler, or an error page or script notice in place of the article."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return residue_documents(texts).select(F.col("id").alias("doc_id"))


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters, "p2_found": p2_found, "p2_templates": p2_templates, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_documents": p5_documents, "p5_segments": p5_segments, "p8_ids": p8_ids, "p9_shares": p9_shares, "p9_selection": p9_selection, "p10_found": p10_found}

ORACLES = {
    "p2_found": """
        WITH a AS (SELECT DISTINCT features.article_id AS article_id, meta.source AS source, features.clean_text AS t FROM sample_impacts WHERE meta.source IS NOT NULL AND trim(meta.source) <> ''),
        s AS (SELECT source, count(*) AS size FROM a GROUP BY source),
        p AS (SELECT article_id, source, string_split(t, chr(10)) AS parts FROM a WHERE t IS NOT NULL),
        l AS (SELECT article_id, source, CAST(i - 1 AS INT) AS line_no, trim(parts[i], ' ' || chr(9) || chr(13)) AS line FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p)),
        k AS (SELECT article_id, source, line_no, regexp_replace(regexp_replace(lower(line), '\\p{Nd}+', '#D#', 'g'), '[ \\t\\r]+', ' ', 'g') AS like_line FROM l WHERE line <> ''),
        c AS (SELECT source, like_line, count(DISTINCT article_id) AS n FROM k GROUP BY source, like_line)
        SELECT k.article_id, k.line_no FROM k JOIN c USING (source, like_line) JOIN s USING (source) WHERE c.n >= 5 AND c.n >= 0.1 * s.size""",
    "p4_found": """
        WITH RECURSIVE a AS (SELECT DISTINCT features.article_id AS id, regexp_extract_all(lower(text_content), '[\\p{L}\\p{N}]+') AS w FROM sample_impacts WHERE text_content IS NOT NULL),
        g AS (SELECT DISTINCT id, s FROM (SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS s FROM a WHERE len(w) >= 20)),
        n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
        c AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.id < y.id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE CAST(k AS DOUBLE) / (p.n + q.n - k) >= 0.7),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT a AS id, b AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a)
        SELECT CAST(min(least(id, other)) AS INT) AS group_id, CAST(id AS INT) AS article_id FROM r GROUP BY id""",
}
