"""Relational operators that the impact tables need beyond plain select, join and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """One row per key: `keep` of the row that comes first. An aggregate with map-side combine, not a sort."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("__first")).select(*keys, "__first.*")


def dominant(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """(keys, dominant, dominant_count, total): the most frequent value; ties go to the smaller one, nulls don't count
    as a value but in the total. Counted per (keys, value) first, so a hot key is combined before it moves."""
    counted = df.groupBy(*keys, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("__n"))
    best = F.struct((-F.when(F.col(value).isNotNull(), F.col("__n"))).alias("n"), F.col(value).alias("v"))
    out = counted.groupBy(*keys).agg(F.min(F.when(F.col(value).isNotNull(), best)).alias("__b"), F.sum("__n").alias("total"))
    return out.select(*keys, F.col("__b.v").alias("dominant"), (-F.col("__b.n")).alias("dominant_count"), "total")


def share_of(df: DataFrame, value: str, within: list[str], name: str = "share") -> DataFrame:
    """Adds value / sum of value in the group by an aggregate joined back (a small side), not by a window over all rows."""
    if not within:
        return df.crossJoin(F.broadcast(df.agg(F.sum(value).alias("__all")))).withColumn(name, F.col(value) / F.col("__all")).drop("__all")
    return df.withColumn(name, F.col(value) / F.sum(value).over(W.partitionBy(*within)))


def filled(df: DataFrame, key: str, categories: list, zeros: list[str]) -> DataFrame:
    """A row for each category in order, zeros where df has none."""
    kinds = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(categories)], f"`{key}` {df.schema[key].dataType.simpleString()}, place int")
    return F.broadcast(kinds).join(df, key, "left").fillna(0, zeros)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_rows, n_missing, pct_missing, n_distinct) of each column from one pass over the table."""
    each = [F.struct(F.lit(c).alias("c"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("m"), F.count_distinct(F.col(c)).alias("d")) for c in columns]
    one = df.agg(F.array(*each).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    return one.select(F.col("c").alias("column_name"), F.col("n").alias("n_rows"), F.col("m").alias("n_missing"), F.round(100 * F.col("m") / F.col("n"), 2).alias("pct_missing"), F.col("d").alias("n_distinct"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of changes in place of those with the same keys."""
    return base.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return inputs.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def multiset_match(gold: DataFrame, predicted: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """(within, n_gold, n_predicted, n_match): matches of two bags, each row at most once. Bags are compared by counts."""
    cols = [*within, *keys]
    bag = gold.select(*cols, F.lit(1).alias("g"), F.lit(0).alias("p")).unionAll(predicted.select(*cols, F.lit(0), F.lit(1)))
    both = bag.groupBy(*cols).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))  # null keys are equal in a group
    return both.groupBy(*within).agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_predicted"), F.sum(F.least("g", "p")).alias("n_match"))


def cooccurrence(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(source, target, weight): number of keys that hold both items, source < target. Items of one key are a set, and
    the set is small (at most the classes), so pairs come from its array and not from a self-join."""
    sets = df.where(F.col(item).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.source", "p.target").agg(F.count("*").alias("weight"))


def month_spine(df: DataFrame, month: str, values: list[str], start: str, end: str) -> DataFrame:
    """A row for every month between the dates, zeros where df has none."""
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 month"))).alias(month))
    return spine.join(df, month, "left").fillna(0, values)


def min_max(df: DataFrame, value: str, name: str) -> DataFrame:
    """Scales a column to 0..1; a constant one is 0."""
    low_high = df.agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    span = F.col("__high") - F.col("__low")
    return df.crossJoin(F.broadcast(low_high)).withColumn(name, F.when(span != 0, (F.col(value) - F.col("__low")) / span).otherwise(0.0)).drop("__low", "__high")


def season_end(series: DataFrame, date: str, value: str) -> DataFrame:
    """(year, value): the value of 30 September, else the last of April to September."""
    season = series.where(F.month(date).between(4, 9) & F.col(value).isNotNull())
    exact = F.max(F.when((F.month(date) == 9) & (F.dayofmonth(date) == 30), F.col(value)))
    return season.groupBy(F.year(date).alias("year")).agg(F.coalesce(exact, F.max_by(value, date)).alias("value"))


def quartile_band(df: DataFrame, value: str, name: str) -> DataFrame:
    """high from the upper quartile, low up to the lower one, mid between; quartiles by linear interpolation."""
    q = df.agg(F.percentile(value, F.lit(0.25)).alias("__q1"), F.percentile(value, F.lit(0.75)).alias("__q3"))
    band = F.when(F.col(value) >= F.col("__q3"), "high").when(F.col(value) <= F.col("__q1"), "low").otherwise("mid")
    return df.crossJoin(F.broadcast(q)).withColumn(name, band).drop("__q1", "__q3")


def top_and_bottom(df: DataFrame, within: list[str], score: str, tie: str, k: int = 3) -> DataFrame:
    """The k best and k worst rows of each group with side and place."""
    best = W.partitionBy(*within).orderBy(F.desc(score), tie)
    worst = W.partitionBy(*within).orderBy(F.asc(score), tie)
    ranked = df.where(F.col(score).isNotNull()).withColumns({"__t": F.row_number().over(best), "__b": F.row_number().over(worst)})
    top = ranked.where(F.col("__t") <= k).withColumns({"side": F.lit("top"), "place": F.col("__t")})
    return top.unionAll(ranked.where(F.col("__b") <= k).withColumns({"side": F.lit("bottom"), "place": F.col("__b")})).drop("__t", "__b")


def seeded_order(key: Column, seed: int) -> Column:
    """A place that depends on the key and the seed only, the same on every engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in seeded order, ties by the key. Each task keeps its own n best, so no sort holds all rows."""
    return df.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def seeded_fraction(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """About that share of the rows, chosen row by row (32 bits of the seeded order)."""
    return df.where(F.conv(F.substring(seeded_order(F.col(key), seed), 1, 8), 16, 10).cast("bigint") < int(share * (1 << 32)))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, n_null, mean, std, low, q25, median, q75, high) of numeric columns from one pass; quartiles are exact."""
    each = []
    for c in columns:
        v = F.col(c).cast("double")
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        each.append(F.struct(F.lit(c).alias("column_name"), F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_null"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("low"), q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"), F.max(v).alias("high")))
    return df.agg(F.array(*each).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys are equal; the keys come once, from a."""
    right = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = None
    for k in keys:
        on = F.col(k).eqNullSafe(F.col(f"__{k}")) if on is None else on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(right, on, how).drop(*[f"__{k}" for k in keys])


def restricted(df: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of a fixed list of ids, by a semi-join with the list."""
    kind = df.schema[key].dataType.simpleString()
    return df.join(F.broadcast(df.sparkSession.createDataFrame([(i,) for i in ids], f"`{key}` {kind}").distinct()), key, "left_semi")


def in_order(inputs: DataFrame, done: DataFrame, key: str, place: str, columns: list[str]) -> DataFrame:
    """Every input with the columns of `done` (one row per key, null where it is still open) and its place in the input."""
    return inputs.select(key, place).join(done.select(key, *columns), key, "left")


def ranked(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds the place in an order. For results of a bounded size (classes, regions): the window is one partition."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)))


def union_of(columns: list[Column], frame: DataFrame, name: str) -> DataFrame:
    """Distinct values of several expressions of one table, nulls left out, in one pass."""
    return frame.select(F.explode(F.array_distinct(F.array(*columns))).alias(name)).where(F.col(name).isNotNull()).distinct()
