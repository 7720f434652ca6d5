"""Candidate pairs from banded signatures, without hot groups in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainledger.storage import Workspace

#: Buckets of up to so many sets emit all their pairs; larger ones are compared by way of pivots.
SMALL_BUCKET = 64
#: Rows up to which a table is broadcast after being counted.
BROADCAST_ROWS = 500_000
#: Bytes that the counted rows of a broadcast may take at most (long columns; strings are reckoned apart).
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, row_bytes: int = 100) -> DataFrame:
    """For a written table: broadcast if its counted rows, of about `row_bytes` each, allow it."""
    return F.broadcast(df) if df.count() <= min(BROADCAST_ROWS, BROADCAST_BYTES // row_bytes) else df


def first_of_copies(sketches: DataFrame) -> DataFrame:
    """(print, rep, copies): the smallest id of each set of equal shingle sets and the number of ids."""
    return sketches.groupBy("print", "id").agg(F.lit(1).alias("one")).groupBy("print").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))


def bands_of(sketches: DataFrame, *more: str) -> DataFrame:
    return sketches.select("id", *more, F.explode("keys").alias("key"))


def bucket_pairs(ws: Workspace, sketches: DataFrame, least_bands: int) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs (a, b, bands), a < b, of sets that share at least `least_bands` bands, and the rows of hot buckets.

    Buckets are counted with a map-side aggregate, so a bucket however large costs one row a task.
    Buckets of two give their pair from that aggregate alone. Larger ones are joined back: up to
    SMALL_BUCKET sets give all pairs; the rows (key, id, lead) of hotter ones are returned apart, with
    the first set of each, and None if there are none.
    """
    counted = bands_of(sketches).groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    counted = ws.write("buckets", counted)
    sizes = counted.agg(F.count_if(F.col("n").between(3, SMALL_BUCKET)).alias("tame"), F.count_if(F.col("n") > SMALL_BUCKET).alias("hot")).first()
    pairs, hot = counted.where("n = 2").select("a", "b"), None
    if sizes["tame"]:
        tame = counted.where(F.col("n").between(3, SMALL_BUCKET)).select("key")
        rows = bands_of(sketches).join(F.broadcast(tame) if sizes["tame"] <= BROADCAST_ROWS else tame, "key")
        # at most SMALL_BUCKET ids an array
        sets = rows.groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("s"))
        each = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        pairs = pairs.unionAll(sets.select(F.explode(each).alias("p")).select("p.a", "p.b"))
    if sizes["hot"]:
        crowded = counted.where(F.col("n") > SMALL_BUCKET).select("key", F.col("a").alias("lead"))
        hot = ws.write("hot", bands_of(sketches).join(F.broadcast(crowded) if sizes["hot"] <= BROADCAST_ROWS else crowded, "key").select("key", "id", "lead").distinct())
    return pairs.groupBy("a", "b").agg(F.count("*").alias("bands")).where(F.col("bands") >= least_bands), hot
