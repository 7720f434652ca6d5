"""Scores of probabilistic predictions, grouped by any keys, as aggregates and windows over (keys, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _steps(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Cumulative positives and rows by falling score; tied scores are one step. The aggregate by score comes first,
    so the window sees distinct scores only."""
    steps = df.groupBy(*keys, score).agg(F.sum(F.col(y).cast("double")).alias("tp"), F.count("*").cast("double").alias("n"))
    down = W.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    return steps.withColumns({"ctp": F.sum("tp").over(down), "cn": F.sum("n").over(down), "pos": F.sum("tp").over(whole), "all": F.sum("n").over(whole)})


def average_precision(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """(keys, ap): step-wise average precision, null where one label is missing."""
    term = F.col("tp") / F.nullif(F.col("pos"), F.lit(0.0)) * F.col("ctp") / F.col("cn")
    both = (F.max("pos") > 0) & (F.max("pos") < F.max("all"))
    return _steps(df, keys, y, score).groupBy(*keys).agg(F.when(both, F.sum(term)).alias("ap"))


def roc_auc(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """(keys, auc) by the Mann-Whitney statistic with half a point for ties, null where one label is missing."""
    above = (F.col("ctp") - F.col("tp")) * (F.col("n") - F.col("tp")) + F.col("tp") * (F.col("n") - F.col("tp")) / 2
    negatives = F.max("all") - F.max("pos")
    return _steps(df, keys, y, score).groupBy(*keys).agg((F.sum(above) / F.nullif(F.max("pos") * negatives, F.lit(0.0))).alias("auc"))


def point_scores(df: DataFrame, keys: list[str], y: str, score: str, cut: float = 0.5) -> DataFrame:
    """(keys, n, n_pos, prevalence, mean_pred, brier, precision, recall, f1); a ratio by zero is 0."""
    yes, hit = F.col(score) >= cut, F.col(y) == 1
    tp, fp, fn = (F.count_if(c).cast("double") for c in (yes & hit, yes & ~hit, ~yes & hit))
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("n_pos"), F.avg(F.col(y).cast("double")).alias("prevalence"), F.avg(score).alias("mean_pred"), F.avg(F.pow(F.col(score) - F.col(y), 2)).alias("brier"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("tp", "fp", "fn")


def slices(df: DataFrame, keys: list[str], y: str, score: str, least_positives: int = 5) -> DataFrame:
    """Point scores with ap and skill (ap - prevalence); both null for fewer positives than asked or one label."""
    out = point_scores(df, keys, y, score).join(average_precision(df, keys, y, score), keys)
    ap = F.when(F.col("n_pos") >= least_positives, F.col("ap"))
    return out.withColumn("ap", ap).withColumn("skill", F.col("ap") - F.col("prevalence"))


def macro(scores: DataFrame, over: list[str]) -> DataFrame:
    """Means over classes; undefined scores are left out and counted."""
    return scores.groupBy(*over).agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"), F.count("*").alias("n_classes"), F.count("ap").alias("n_scored"), F.avg("ap").alias("macro_ap"), F.avg("skill").alias("macro_skill"), F.avg("brier").alias("macro_brier"))


def predictable(scores: DataFrame, skill: float = 0.15, ap: float = 0.25) -> DataFrame:
    return scores.withColumn("predictable", F.coalesce((F.col("skill") >= skill) & (F.col("ap") >= ap), F.lit(False)))


def fold_stats(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """(keys, n_folds, mean, std): mean and sample deviation of defined fold scores; one fold has no deviation."""
    return df.groupBy(*keys).agg(F.count(score).alias("n_folds"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"))


def pruned_runs(df: DataFrame, run: str, step: str, score: str, warm_up: int = 1) -> DataFrame:
    """Adds the mean over the steps so far of each run and whether a median pruner stops it: beyond the warm-up its mean
    lies below the median of all runs' means at the same step (6 digits)."""
    so_far = W.partitionBy(run).orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    steps = df.withColumns({"running": F.avg(score).over(so_far), "__k": F.row_number().over(W.partitionBy(run).orderBy(step))})
    middle = steps.groupBy("__k").agg(F.percentile("running", F.lit(0.5)).alias("__middle"))
    below = (F.col("__k") > warm_up) & (F.round("running", 6) < F.round("__middle", 6))
    return steps.join(F.broadcast(middle), "__k").withColumn("pruned", below).drop("__k", "__middle")


def evaluated(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """(keys, ap, auc, precision, recall, f1, brier, n, n_pos, prevalence) of each group."""
    out = point_scores(df, keys, y, score).join(average_precision(df, keys, y, score), keys).join(roc_auc(df, keys, y, score), keys)
    return out.select(*keys, "ap", "auc", "precision", "recall", "f1", "brier", "n", "n_pos", "prevalence")


def macro_means(scores: DataFrame, over: list[str]) -> DataFrame:
    """(over, n_classes, macro_<metric>): means of seven metrics, undefined ones left out."""
    return scores.groupBy(*over).agg(F.count("*").alias("n_classes"), *[F.avg(m).alias(f"macro_{m}") for m in ("ap", "auc", "precision", "recall", "f1", "brier", "prevalence")])
