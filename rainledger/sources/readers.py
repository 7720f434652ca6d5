"""Readers of the project's file formats. Schemas are declared, never inferred, unless the format has none."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rainledger.functions.dates import degrees_of
from rainledger.operators.places import quality_fields
from rainledger.storage import Workspace

_IMPACT = "struct<classification:string,severity:int,evidence:string,confidence:double,evidence_found_verbatim:boolean>"
ARTICLE_SCHEMA = (
    "id string, meta struct<date:string,source:string,original_filename:string>, text_content string, labels struct<relevance_score:double,sectors:array<string>,"
    "spatial_targets:array<struct<mention:string,induction_type:string,nuts3_codes:array<string>,confidence_manual:double>>>, manual_notes string,"
    "features struct<title:string,top_date:string,bottom_date:string,publication_date:string,clean_text:string,clean_text_ratio:double,cleaning_warning:string,source_zip:string,"
    f"source_file:string,article_id:int,llm_drought_impacts:array<struct<reasoning:string,location:string,recency_in_months:int,impacts:array<{_IMPACT}>>>,llm_drought_impact_error:string>, model_name string"
)
POINT_COLUMNS = "id string, article_id string, model_name string, publication_date string, source_file string, impact_index string, location string, classification string, severity string, confidence string, evidence string, recency_in_months string, geocoded_latitude string, geocoded_longitude string, geocoded_place_type string"
# The periods of a station line in order, and its sign for a missing value.
PERIODS = ["annual", "winter_half", "summer_half", "djf", "mam", "jja", "son", "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MISSING = -999999
_WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str | None:
    """The paragraphs of a DOCX file, one a line; null for a damaged file."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD_NS}t")) for p in root.iter(f"{_WORD_NS}p"))


def read_docx_archives(spark: SparkSession, path: str) -> DataFrame:
    """(article_id, source_zip, source_file, text) of every DOCX in every ZIP under a path, numbered by archive and file name.

    Archives are opened where they are read. The numbers come from counts per archive and a window within each
    archive, so no sort holds all files.
    """

    def run(frames):
        for pdf in frames:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(name.rsplit("/", 1)[-1], f, docx_text(z.read(f))) for f in sorted(z.namelist()) if f.lower().endswith(".docx")]
            yield pd.DataFrame(rows, columns=["source_zip", "source_file", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    # written once: archives are not opened again for the numbers
    rows = Workspace(spark, "archives").write("files", files.select("path", "content").mapInPandas(run, "source_zip string, source_file string, text string"))
    counts = rows.groupBy("source_zip").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("source_zip").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("start", before).select("source_zip", "start")
    place = F.row_number().over(W.partitionBy("source_zip").orderBy("source_file"))
    return rows.withColumn("place", place).join(starts, "source_zip").select((F.col("start") + F.col("place") - 1).alias("article_id"), "source_zip", "source_file", "text")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article records from JSON: an array, one object a line, or an object that holds the array as sample or articles."""
    wrapped = spark.read.schema(f"sample array<struct<{_fields(ARTICLE_SCHEMA)}>>, articles array<struct<{_fields(ARTICLE_SCHEMA)}>>, {ARTICLE_SCHEMA}").json(path, multiLine=True)
    inner = wrapped.where("sample is not null or articles is not null").select(F.explode(F.coalesce("sample", "articles")).alias("a")).select("a.*")
    return wrapped.where("sample is null and articles is null").drop("sample", "articles").unionByName(inner)


def _fields(schema: str) -> str:
    """The fields of a table schema as those of a struct."""
    return StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def normalised_corpus(articles: DataFrame, cleaned_first: bool = False) -> DataFrame:
    """(id, title, date, text) with each field from the first place that fills it; the text from text_content, else
    clean_text, or the other way round with `cleaned_first`, as extraction wants it."""
    texts = ("features.clean_text", "text_content") if cleaned_first else ("text_content", "features.clean_text")
    first = lambda *cs: F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.col(c)) for c in cs])
    return articles.select(F.coalesce(first("id"), F.col("features.article_id").cast("string")).alias("id"), first("features.title", "meta.original_filename").alias("title"), first("features.publication_date", "meta.date", "features.top_date").alias("date"), first(*texts).alias("text"))


def read_checkpoint(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines of an append-only checkpoint: blank and damaged lines are skipped, the last line of a key wins. Files
    follow each other by time of change, then name; lines by their place in the file."""
    lines = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    m = F.col("_metadata")
    at = F.struct(m["file_modification_time"].alias("t"), m["file_path"].alias("p"), m["file_block_start"].alias("b"), F.monotonically_increasing_id().alias("i"))
    kept = lines.withColumn("_at", at).where(f"_bad is null and {key} is not null").drop("_bad")
    return kept.groupBy(key).agg(F.max_by(F.struct(*[c for c in kept.columns if c not in (key, "_at")]), "_at").alias("r")).select(key, "r.*")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Typed point impacts from CSV: rows without coordinates go, severity defaults to 1, what can't be read is null."""
    raw = spark.read.schema(POINT_COLUMNS).csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    number = lambda c, kind: F.col(c).try_cast(kind)
    date = F.try_to_timestamp(F.col("publication_date"), F.lit("yyyy-MM-dd")).cast("date")
    return raw.withColumns({
        "article_id": number("article_id", "int"), "impact_index": number("impact_index", "int"), "publication_date": date, "year_month": F.trunc(date, "MM"), "severity": F.coalesce(number("severity", "int"), F.lit(1)),
        "confidence": F.round(number("confidence", "double"), 2), "recency_in_months": number("recency_in_months", "int"), "geocoded_latitude": number("geocoded_latitude", "double"), "geocoded_longitude": number("geocoded_longitude", "double"),
    }).where("geocoded_latitude is not null and geocoded_longitude is not null").transform(_with_rank)


def _with_rank(df: DataFrame) -> DataFrame:
    """Rank and low-quality flag computed anew from the place type and the forced names."""
    out = quality_fields(df.drop("geocoded_place_rank", "geocoded_is_low_quality"), "geocoded_place_type", "location")
    return out.withColumnsRenamed({"place_rank": "geocoded_place_rank", "low_quality": "geocoded_is_low_quality"}).drop("place_level", "is_broad")


REGION_COLUMNS = POINT_COLUMNS + ", nuts_level string, nuts2_id string, nuts2_name string, nuts3_id string, nuts3_name string, nuts_match_distance_m string, source_nuts_level string, mention_weight string"


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Typed region impacts from CSV: severity and mention_weight default to 1, ids and names are trimmed and never null,
    what else can't be read is null; rows without coordinates stay."""
    raw = spark.read.schema(REGION_COLUMNS).csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    number = lambda c, kind: F.col(c).try_cast(kind)
    date = F.try_to_timestamp(F.col("publication_date"), F.lit("yyyy-MM-dd")).cast("date")
    named = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("nuts_level", "nuts2_id", "nuts2_name", "nuts3_id", "nuts3_name", "source_nuts_level")}
    typed = {c: number(c, kind) for kind, cs in {"int": ("article_id", "impact_index", "recency_in_months", "nuts_match_distance_m"), "double": ("geocoded_latitude", "geocoded_longitude")}.items() for c in cs}
    defaults = {"severity": F.coalesce(number("severity", "int"), F.lit(1)), "mention_weight": F.coalesce(number("mention_weight", "double"), F.lit(1.0)), "confidence": F.round(number("confidence", "double"), 2)}
    return _with_rank(raw.withColumns({"publication_date": date, "year_month": F.trunc(date, "MM")} | named | typed | defaults))


def read_grid(spark: SparkSession, path: str, columns: list[str], value: str = "wildfires_sum") -> DataFrame:
    """Cells with a positive value and a place and time, of a grid in CSV; only the asked columns are parsed."""
    head = spark.read.csv(path, header=True).columns
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in head)).csv(path, header=True, enforceSchema=False).select("x", "y", "time", value, *[c for c in columns if c not in ("x", "y", "time", value)])
    typed = raw.select(F.col("x").try_cast("double").alias("x"), F.col("y").try_cast("double").alias("y"), F.col("time").try_cast("timestamp").alias("time"), *[F.col(c).try_cast("double").alias(c) for c in raw.columns if c not in ("x", "y", "time")])
    return typed.where(F.col(value) > 0).na.drop(subset=["x", "y", "time"])


def read_daily(spark: SparkSession, path: str, value: str = "deficit_mm") -> DataFrame:
    """(date, value) of a table with blanks between its columns and # before comments; the last row of a date wins."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("value not like '#%' and trim(value) <> ''").select(F.try_to_timestamp(parts[0], F.lit("yyyyMMdd")).cast("date").alias("date"), F.get(parts, F.lit(1)).try_cast("double").alias(value)).where("date is not null")
    return rows.withColumn("_at", F.monotonically_increasing_id()).groupBy("date").agg(F.max_by(value, "_at").alias(value))


def read_geojson(spark: SparkSession, path: str, level: int | None = None) -> DataFrame:
    """(nuts_id, level, name, rings) of polygons and multipolygons; only regions with an id."""
    at = "array<array<array<array<double>>>>"
    schema = "features array<struct<properties:struct<NUTS_ID:string,LEVL_CODE:int,NUTS_NAME:string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.*")
    polygons = F.when(F.col("geometry.type") == "Polygon", F.array(F.from_json("geometry.coordinates", "array<array<array<double>>>"))).otherwise(F.from_json("geometry.coordinates", at))
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    out = f.select(F.col("properties.NUTS_ID").alias("nuts_id"), F.col("properties.LEVL_CODE").alias("level"), F.col("properties.NUTS_NAME").alias("name"), F.transform(F.flatten(polygons), ring).alias("rings"))
    out = out.where("nuts_id is not null and nuts_id <> ''")
    return out if level is None else out.where(F.col("level") == level)


def read_station_files(spark: SparkSession, path: str, country: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(stations, series) of fixed-layout station files; stations without id or place are left out.

    stations: (staid, station_name, latitude, longitude, elevation, source_file); series: (staid, year, period, cdd_days).
    """
    files = spark.read.text(path, wholetext=True).withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    text = F.col("value")
    pick = lambda pattern: F.regexp_extract(text, pattern, 1)
    if country:
        files = files.where(text.contains(f"STATION {country}"))
    head = files.select(
        pick(r"\(STAID:\s*(\d+)").try_cast("int").alias("staid"), F.trim(F.regexp_replace(pick(r"FOR STATION ([^\n(]*)\(STAID"), r"\s+", " ")).alias("station_name"),
        degrees_of(pick(r"(?m)^LATITUDE:[^\n]*?([+-]?\d+:\d+:\d+)")).alias("latitude"), degrees_of(pick(r"(?m)^LONGITUDE:[^\n]*?([+-]?\d+:\d+:\d+)")).alias("longitude"), pick(r"(?m)^ELEVATION:\D*?(-?\d+)").try_cast("int").alias("elevation"), "source_file", "value",
    ).where("staid is not null and latitude is not null and longitude is not null")
    lines = head.select("staid", F.explode(F.split("value", "\n")).alias("line")).where(F.col("line").rlike(r"^\s*\d+\s+\d{4}\s"))
    parts = F.split(F.trim("line"), r"\s+")
    rows = lines.select("staid", parts[1].cast("int").alias("year"), F.posexplode(F.slice(parts, 3, len(PERIODS))).alias("i", "v"))
    value = F.col("v").try_cast("int")
    series = rows.select("staid", "year", F.element_at(F.array(*[F.lit(p) for p in PERIODS]), F.col("i") + 1).alias("period"), F.when(value != MISSING, value / 100.0).alias("cdd_days"))
    return head.drop("value"), series


def read_xml_areas(spark: SparkSession, path: str, row_tag: str, schema: str | StructType) -> DataFrame:
    """Rows of a large XML file, streamed tag by tag by Spark's own reader."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def rings_of_pos_lists(lists: Column) -> Column:
    """Rings of (x, y) from lists of numbers in text, one a ring (outline first)."""

    def ring(c: Column) -> Column:
        v = F.transform(F.split(F.trim(c), r"\s+"), lambda x: x.try_cast("double"))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(v) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get(v, 2 * i).alias("x"), F.get(v, 2 * i + 1).alias("y")))

    return F.transform(F.filter(lists, lambda c: F.coalesce(F.trim(c) != "", F.lit(False))), ring)


def planar_area(rings: Column) -> Column:
    """Area of rings in the unit of their coordinates squared: the outline less its holes."""
    one = lambda r: F.abs(F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda a, i: a + F.get(r, i - 1)["x"] * F.get(r, i)["y"] - F.get(r, i)["x"] * F.get(r, i - 1)["y"])) / 2
    areas = F.transform(F.filter(rings, lambda r: F.size(r) > 2), one)
    return F.when(F.size(areas) > 0, 2 * F.get(areas, F.lit(0)) - F.aggregate(areas, F.lit(0.0), lambda a, x: a + x))


def read_xml_polygons(spark: SparkSession, path: str, row_tag: str, class_field: str, outline: str, holes: str | None = None) -> DataFrame:
    """(class, rings, area_km2) of features in metres, streamed tag by tag; the fields are paths of tags below the row tag, down to
    the position lists. Features without an outline are left out."""

    def nested(fields: list[tuple[list[str], str]]) -> str:
        heads: dict[str, list] = {}
        for path_, kind in fields:
            heads.setdefault(path_[0], []).append((path_[1:], kind))
        return "struct<" + ",".join(f"`{h}`:{kids[0][1] if not kids[0][0] else nested(kids)}" for h, kids in heads.items()) + ">"

    wanted = [(class_field.split("."), "string"), (outline.split("."), "string")] + ([(holes.split("."), "array<string>")] if holes else [])
    rows = read_xml_areas(spark, path, row_tag, StructType.fromDDL(f"r {nested(wanted)}")["r"].dataType)
    lists = F.array(F.col(outline)) if holes is None else F.concat(F.array(F.col(outline)), F.coalesce(F.col(holes), F.array().cast("array<string>")))
    rings = rings_of_pos_lists(lists)
    return rows.where(F.col(outline).isNotNull()).select(F.col(class_field).alias("class"), rings.alias("rings")).withColumn("area_km2", planar_area(F.col("rings")) / 1e6)


def read_manifest(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Feature groups of a manifest (group, feature), `year` left out: one row a feature, whatever their number."""
    rows = spark.read.schema("group string, feature string").csv(path, header=True).where("feature <> 'year'").collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["group"], []).append(r["feature"])
    return out


def read_raster(spark: SparkSession, path: str, decode, nodata: float | None = None) -> DataFrame:
    """(path, x, y, time, value) of binary rasters; decode(bytes) yields (x, y, time, value). No decoder is built in:
    the formats' libraries are optional. Cells without data, beyond 1e10 or not finite have a null value."""

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame([(name, *cell) for cell in decode(content)], columns=["path", "x", "y", "time", "value"])

    cells = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, x double, y double, time timestamp, value double")
    return cells.withColumn("value", mask(F.col("value"), nodata))


def mask(value: Column, nodata: float | None = None) -> Column:
    bad = value.isNull() | F.isnan(value) | (F.abs(value) > 1e10)
    if nodata is not None:
        bad = bad | (value == nodata)
    return F.when(~bad, value)


def read_raster_archives(spark: SparkSession, path: str, decode, nodata: float | None = None, ending: str = ".tif") -> DataFrame:
    """(path, x, y, time, value) of the rasters in ZIP archives; see read_raster. The path is archive/member."""

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(m for m in z.namelist() if m.lower().endswith(ending)):
                        yield pd.DataFrame([(f"{name}/{member}", *cell) for cell in decode(z.read(member))], columns=["path", "x", "y", "time", "value"])

    cells = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, x double, y double, time timestamp, value double")
    return cells.withColumn("value", mask(F.col("value"), nodata))


def clipped(cells: DataFrame, south: float, north: float, west: float, east: float, first_year: int | None = None) -> DataFrame:
    """Cells (x, y, time, ...) in a box, its edges included, from a year on."""
    out = cells.where(F.col("y").between(south, north) & F.col("x").between(west, east))
    return out if first_year is None else out.where(F.year("time") >= first_year)
