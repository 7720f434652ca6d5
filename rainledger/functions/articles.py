"""The body of an article file and what is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainledger.functions.dates import bottom_date, top_date
from rainledger.functions.text import first_line, let, lines, strip

SHORT_RATIO, LONG_RATIO, LEAST_RATIO = 0.25, 0.95, 0.30
# Marks of the file format, in lower case.
_STARTS = ("highlight:", "volledige tekst", "full text", "body")
_ENDS = ("graphic", "end of document", "link naar pdf")
_METADATA = ("copyright", "section:", "length:", "byline:", "dateline:", "subject:", "industry:", "publication-type:", "journal code:", "language:", "geographic:", "load-date:")


def _begins(line: Column, marks: tuple[str, ...]) -> Column:
    return line.rlike("^(" + "|".join(m.replace(".", r"\.") for m in marks) + ")")


def body_text(c: Column) -> Column:
    """The lines between the start and the end mark of a file, without its metadata lines.

    The first `highlight:` line starts the body if there is one (with what stands behind its colon, and metadata
    lines then stay), else the first full-text mark in the order of _STARTS, else the text's begin. It ends before
    the first `classification` line after the start, else before the first other end mark. Runs of blank lines are
    one blank line. A null gives null.
    """
    rows = F.transform(lines(c), lambda x: F.struct(strip(x).alias("line"), F.lower(strip(x)).alias("low")))
    return let(rows, _body_of)


def _body_of(rows: Column) -> Column:
    def position(test, start) -> Column:
        hits = F.filter(F.transform(rows, lambda r, i: F.when(test(r["low"]) & (i >= start), i)), lambda i: i.isNotNull())
        return F.coalesce(F.get(hits, F.lit(0)), F.lit(-1))

    marks = F.struct(*[position(lambda x, m=m: x.startswith(m), F.lit(0)).alias(f"s{i}") for i, m in enumerate(_STARTS)])
    return let(marks, lambda m: let(F.coalesce(*[F.when(m[f"s{i}"] >= 0, m[f"s{i}"] + 1) for i in range(len(_STARTS))], F.lit(0)), lambda start: _from(rows, m["s0"], start, position)))


def _from(rows: Column, mark: Column, start: Column, position) -> Column:
    highlight = mark >= 0
    ends = [position(lambda x: x.startswith("classification"), start), position(lambda x: _begins(x, _ENDS), start)]
    inline = F.when(highlight, F.trim(F.regexp_replace(F.get(rows, mark)["line"], "^[^:]*:", ""))).otherwise("")

    def text(end: Column) -> Column:
        kept = F.filter(rows, lambda r, i: (i >= start) & (i < end) & ~r["low"].startswith("highlight:") & ~r["low"].startswith("body") & (highlight | ~_begins(r["low"], _METADATA)))
        joined = F.array_join(F.concat(F.when(inline != "", F.array(inline)).otherwise(F.array().cast("array<string>")), F.transform(kept, lambda r: r["line"])), "\n")
        return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")

    return let(F.coalesce(*[F.when(e >= 0, e) for e in ends], F.size(rows)), text)


def enrich_articles(articles: DataFrame, text_col: str = "text", id_col: str = "article_id") -> DataFrame:
    """Adds title, dates, body, ratio, warning and labelling id to every article (null text: an empty one)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = articles.withColumns({"title": first_line(text), "top_date": top_date(text), "bottom_date": bottom_date(text), "body": body_text(text)})
    out = out.withColumn("publication_date", F.coalesce("top_date", "bottom_date"))
    ratio = F.char_length(F.col("body")) / F.greatest(F.char_length(strip(text)), F.lit(1))
    dated = F.concat(F.lit("Publication date: "), F.col("publication_date").cast("string"))
    return out.withColumns({
        "clean_text_ratio": F.round(ratio, 4),
        "cleaning_warning": F.when(ratio < SHORT_RATIO, "clean_text_too_short_check_regex").when(ratio > LONG_RATIO, "clean_text_too_long_check_regex"),
        "clean_text": F.when(F.col("publication_date").isNull(), F.col("body")).when(F.col("body") == "", dated).otherwise(F.concat(dated, F.lit("\n\n"), F.col("body"))),
        "label_id": F.concat(F.lit("NEWS_"), F.coalesce(F.year("publication_date").cast("string"), F.lit("UNK")), F.lit("_"), F.lpad((F.col(id_col) + 1).cast("string"), 6, "0")),
    })


def good_articles(enriched: DataFrame) -> DataFrame:
    return enriched.where(F.col("clean_text_ratio") >= LEAST_RATIO)
