"""Text expressions. All but the last two are built-in column expressions, so they stay in the JVM."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with a mark beside the plain letter (the Latin letters that occur in names).
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it inside lambda functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def squash(c: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """Case folding: lower case and double s for the sharp s."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def unquote(c: Column) -> Column:
    """Quotation marks and blanks off both ends."""
    return F.regexp_replace(c, "^[\"'“”‘’ ]+|[\"'“”‘’ ]+$", "")


def plain_name(c: Column) -> Column:
    """Lower case without marks, leading article off, anything but letters and digits one blank."""
    bare = F.translate(F.lower(F.trim(c)), _MARKED, _PLAIN)
    bare = F.regexp_replace(bare, "^(in de|in het|de|het|den)\\s+", "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def words(c: Column) -> Column:
    """Runs of letters, digits, marks and underscores of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))


def shingles(tokens: Column, k: int) -> Column:
    """Distinct runs of k tokens; a shorter text is one shingle, an empty one has none."""

    def runs(t: Column) -> Column:
        n = F.size(t)
        each = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.when(t.isNull(), None).when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(each))

    return let(tokens, runs)


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Similarity of two arrays of distinct values; `both_empty` where neither has any."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def lines(c: Column) -> Column:
    return F.split(c, r"\r\n|\n|\r")


def first_line(c: Column) -> Column:
    """The first line that isn't blank, trimmed; an empty string if there is none."""
    return F.coalesce(F.get(F.filter(F.transform(lines(c), strip), lambda x: x != ""), F.lit(0)), F.lit(""))


def without_extension(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\.docx?$", "")


def unescape(c: Column) -> Column:
    """The common named entities and decimal references of single quotes."""
    for entity, sign in (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def contains_quote(haystack: Column, quote: Column) -> Column:
    """Whether a quote stands in a text after both are folded, squashed and unquoted; false for an empty quote."""
    needle = F.trim(unquote(squash(fold(quote))))
    return F.coalesce((needle != "") & F.contains(squash(fold(haystack)), needle), F.lit(False))


def unescape_all(c: Column) -> Column:
    """All named and numbered HTML entities, in Arrow batches (for distinct titles)."""

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else html.unescape(x))

    return run(c)


def plain_names(c: Column) -> Column:
    """plain_name for letters of any script with marks (compatibility decomposition), in Arrow batches (for distinct names)."""

    @F.pandas_udf("string")
    def bare(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else "".join(s for s in unicodedata.normalize("NFKD", x) if not unicodedata.combining(s)))

    return plain_name(bare(c))
