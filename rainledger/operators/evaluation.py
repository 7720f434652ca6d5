"""Tables of the evaluation of extraction models: precision, recall, adjustments, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainledger.functions.domain import token_cost


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """A rounded share, null where the whole is 0."""
    return F.round(part / F.nullif(whole, F.lit(0)), digits)


def recalls(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, n_reviews, <field>_tp, <field>_fn, <field>_recall..., overall_recall): sums of the review columns of each
    model, recalls to 4 digits, and the mean of those that are defined."""
    sums = df.groupBy(key).agg(F.count("*").alias("n_reviews"), *[F.sum(F.coalesce(f"{f}_{c}", F.lit(0))).cast("bigint").alias(f"{f}_{c}") for f in fields for c in ("tp", "fn")])
    out = sums.withColumns({f"{f}_recall": ratio(F.col(f"{f}_tp"), F.col(f"{f}_tp") + F.col(f"{f}_fn"), 4) for f in fields})
    known = F.array_compact(F.array(*[F.col(f"{f}_recall") for f in fields]))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    return out.withColumn("overall_recall", F.round(mean, 4))


def adjusted(raw: DataFrame, published: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """(key, <count>, <count>_published, <count>_difference) of every row of raw; a missing published count is 0."""
    other = published.select(key, *[F.col(c).alias(f"{c}_published") for c in counts])
    out = raw.select(key, *counts).join(F.broadcast(other), key, "left").fillna(0, [f"{c}_published" for c in counts])
    return out.withColumns({f"{c}_difference": F.col(c) - F.col(f"{c}_published") for c in counts})


def usage(df: DataFrame, key: str, prompt: Column, completion: Column, failed: Column, prices: DataFrame, flex: bool = False) -> DataFrame:
    """(key, n, n_failed, prompt_tokens, completion_tokens, cost): totals with prices (key, price_in, price_out) per
    million tokens; a model without a price has a null cost."""
    sums = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(failed).alias("n_failed"), F.sum(prompt).alias("prompt_tokens"), F.sum(completion).alias("completion_tokens"))
    cost = token_cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("price_in"), F.col("price_out"), F.lit(flex))
    return sums.join(F.broadcast(prices), key, "left").select(key, "n", "n_failed", "prompt_tokens", "completion_tokens", cost.alias("cost"))


def best_per(df: DataFrame, key: str, score: str, name: str) -> DataFrame:
    """(key, name, score): the highest score of each key and what has it (the smaller name if equal)."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(name).alias("n")))
    return df.where(F.col(score).isNotNull()).groupBy(key).agg(best.alias("b")).select(key, F.col("b.n").alias(name), (-F.col("b.s")).alias(score))


def divergence(left: DataFrame, right: DataFrame, key: str, value: str, least: float) -> DataFrame:
    """(key, a, b, difference, side): two series scaled to 0..1 over the keys that both have, with the side that is higher
    by at least `least`, else `alike`."""
    both = left.select(key, F.col(value).alias("x")).join(right.select(key, F.col(value).alias("y")), key)
    ends = both.agg(*[f(c).alias(f"__{c}_{n}") for c in "xy" for f, n in ((F.min, "low"), (F.max, "high"))])
    scaled = lambda c: F.when(F.col(f"__{c}_high") > F.col(f"__{c}_low"), (F.col(c) - F.col(f"__{c}_low")) / (F.col(f"__{c}_high") - F.col(f"__{c}_low"))).otherwise(0.0)
    out = both.crossJoin(F.broadcast(ends)).select(key, scaled("x").alias("a"), scaled("y").alias("b")).withColumn("difference", F.col("a") - F.col("b"))
    return out.withColumn("side", F.when(F.col("difference") >= least, "first").when(F.col("difference") <= -least, "second").otherwise("alike"))
