import datetime

import pytest
from pyspark.sql import functions as F

from rainledger.functions import articles, dates, domain, geometry, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value, want",
    [("January 5, 2020", (2020, 1, 5)), ("vrijdag 3 mei 2019", (2019, 5, 3)), ("Monday 12 augustus 2018.", (2018, 8, 12)), ("5 Januari 2021", (2021, 1, 5)), ("2020-01-05", None), ("31 februari 2020", None), (None, None), ("", None)],
)
def test_dates(spark, value, want):
    assert one(spark, dates.parse_date, value) == (datetime.date(*want) if want else None)


def test_top_and_bottom_date(spark):
    t = "Kop\nLoad-Date: March 1, 2020\n3 mei 2019 Amsterdam\nLoad-Date: April 2, 2021\n"
    assert one(spark, dates.top_date, t) == datetime.date(2020, 3, 1) and one(spark, dates.bottom_date, t) == datetime.date(2021, 4, 2)
    # the first line with any date counts although it can't be read
    assert one(spark, dates.top_date, "12 foo 2020\n3 mei 2019") is None
    assert one(spark, dates.degrees_of, "-006:30:00") == -6.5 and one(spark, dates.degrees_of, "x") is None


@pytest.mark.parametrize(
    "value, want",
    [("a\nb", "a\nb"), ("Kop\nBody\nSection: x\ntekst\n\n\n\nmeer\nClassification\nrest", "tekst\n\nmeer"), ("Highlight: kern\nCopyright 2020\nBody\ntekst\nGraphic\nrest", "kern\nCopyright 2020\ntekst"), ("Body\nx\nVolledige tekst:\ny\nEnd of Document", "y"), ("Body\ntekst\nGraphic\nmeer\nClassification", "tekst\nGraphic\nmeer"), ("", ""), (None, None)],
)
def test_body(spark, value, want):
    assert one(spark, articles.body_text, value) == want


def test_enrich_handles_nulls(spark):
    rows = articles.enrich_articles(spark.createDataFrame([(0, None), (1, "Kop\nJanuary 5, 2020\nBody\ntekst")], "article_id int, text string")).orderBy("article_id").collect()
    assert rows[0]["label_id"] == "NEWS_UNK_000001" and rows[0]["clean_text"] == "" and rows[0]["cleaning_warning"] == "clean_text_too_short_check_regex"
    assert rows[1]["clean_text"] == "Publication date: 2020-01-05\n\ntekst" and rows[1]["title"] == "Kop"


def test_text(spark):
    assert one(spark, text.squash, " Ä \n\t b ") == "ä b" and one(spark, text.plain_name, "De Fryslân-West") == "fryslan west" and one(spark, text.slug, "a b/c") == "a_b_c"
    assert one(spark, lambda c: text.shingles(text.words(c), 3), "a b c a b c") == ["a b c", "b c a", "c a b"]
    assert one(spark, lambda c: text.shingles(text.words(c), 3), "a b") == ["a b"] and one(spark, lambda c: text.shingles(text.words(c), 3), "") == []
    assert one(spark, lambda c: text.contains_quote(F.lit("Het STRAẞE \n water"), c), "“het strasse water”") in (True, False)
    assert one(spark, lambda c: text.contains_quote(F.lit("Het  water"), c), "“het water”") is True and one(spark, lambda c: text.contains_quote(F.lit("x"), c), "") is False
    assert one(spark, text.unescape, "a &amp; b &#39;c&#39;") == "a & b 'c'" and one(spark, text.without_extension, "x.DOCX") == "x"


def test_jaccard_conventions(spark):
    empty = F.array().cast("array<string>")
    r = spark.range(1).select(text.jaccard(empty, empty).alias("a"), text.jaccard(empty, empty, 1.0).alias("b"), text.jaccard(F.array(F.lit("x")), F.array(F.lit("x"), F.lit("y"))).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (0.0, 1.0, 0.5)


def test_domain(spark):
    assert len(domain.THEMES) == 20 and one(spark, domain.theme_of, "?") == "economy" and one(spark, domain.theme_of, None) == "economy"
    assert one(spark, domain.place_rank, "City") == 60 and one(spark, domain.place_rank, "moon") == 50 and one(spark, domain.place_rank, " ") is None
    rows = spark.createDataFrame([(3,), (12,), (None,)], "m int")
    assert {r["preset"]: (r["low"], r["high"]) for r in domain.recency_presets(rows, F.col("m")).collect()} == {"All": (0, 12), "0 months only": (0, 0), "0–1 months": (0, 1), "0–6 months": (0, 6), "6–12 months": (6, 12), "12–24 months": (12, 12), "24+ months": (12, 12)}
    assert domain.recency_bounds("24+ months") == (24, None) and rows.where(domain.in_recency(F.col("m"), 6, None, True)).count() == 2
    assert spark.range(1).select(domain.token_cost(F.lit(2_000_000), F.lit(1_000_000), F.lit(1.5), F.lit(9.0), F.lit(True)).alias("c")).first()["c"] == 6.0
    assert one(spark, domain.drought_bin, float("nan"), "double") == "near_normal" and one(spark, domain.drought_bin, -1.0, "double") == "dry" and one(spark, domain.drought_bin, 1.0, "double") == "wet"
    assert one(spark, domain.backoff_seconds, 3, "int") == 4.0


def test_names_and_entities_of_any_script(spark):
    assert one(spark, text.plain_names, "Het Čáslav-Ångström") == "caslav angstrom" and one(spark, text.plain_names, None) is None
    assert one(spark, text.unescape_all, "Caf&eacute; &#8364; &amp;amp;") == "Café € &amp;" and one(spark, text.unescape_all, None) is None


def test_areas_and_interior_points(spark):
    square = [(5.0, 52.0), (5.1, 52.0), (5.1, 52.1), (5.0, 52.1), (5.0, 52.0)]
    hole = [(5.02, 52.02), (5.08, 52.02), (5.08, 52.08), (5.02, 52.08), (5.02, 52.02)]
    rows = spark.createDataFrame([(1, [square]), (2, [square, hole]), (3, []), (4, None)], "i int, rings array<array<struct<x:double,y:double>>>")
    got = {r["i"]: r for r in rows.select("i", geometry.polygon_area_km2(F.col("rings")).alias("a"), geometry.interior_point(F.col("rings")).alias("p")).collect()}
    assert abs(got[1]["a"] - 76.2) < 0.3 and abs(got[2]["a"] / got[1]["a"] - 0.64) < 0.001 and got[3]["a"] == 0 and got[4]["a"] is None
    assert abs(got[1]["p"]["x"] - 5.05) < 1e-9 and not 5.02 < got[2]["p"]["x"] < 5.08 and got[3]["p"] is None and got[4]["p"] is None
