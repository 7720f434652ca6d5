"""Binary relevance: one regularised logistic model per class, fitted for all classes, folds and settings at once.

A model sees a panel of regions and months, whose size is bounded by those two and does not grow with the
articles, so each (class, fold, setting) is one group of a grouped frame: models are fitted side by side in
the tasks, and none of them on the driver.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rainledger.operators.metrics import average_precision, fold_stats, pruned_runs

#: Rows of a panel up to which a model is fitted in one task.
MOST_ROWS = 2_000_000


class Logistic:
    """L2-regularised logistic regression on standardised features with balanced weights, by Newton steps.

    Minimises C * sum(w log-loss) + |beta|^2 / 2, the intercept free of penalty. Constant features have coefficient 0.
    """

    def __init__(self, c: float = 1.0, rounds: int = 60):
        self.c, self.rounds = c, rounds

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Logistic":
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale[self.scale < 1e-12] = np.inf
        z = np.hstack([np.ones((len(x), 1)), (x - self.mean) / self.scale])
        positive = max(1, int(y.sum()))
        w = np.where(y == 1, len(y) / (2 * positive), len(y) / (2 * max(1, len(y) - positive)))
        ridge = np.eye(z.shape[1]) / self.c
        ridge[0, 0] = 1e-9
        beta = np.zeros(z.shape[1])

        def loss(b):
            m = z @ b
            return float((w * (np.logaddexp(0, m) - y * m)).sum() + 0.5 * b @ ridge @ b)

        now = loss(beta)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -35, 35)))
            slope = z.T @ (w * (p - y)) + ridge @ beta
            step = np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + ridge + 1e-10 * np.eye(len(beta)), slope)
            size = 1.0
            while size > 1e-6 and (after := loss(beta - size * step)) > now:
                size /= 2
            if size <= 1e-6 or now - after < 1e-10 * (1 + abs(now)):
                break
            beta, now = beta - size * step, after
        self.intercept, self.coefficients = float(beta[0]), beta[1:]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + ((x - self.mean) / self.scale) @ self.coefficients, -35, 35)))

    def attribution(self, x: np.ndarray) -> np.ndarray:
        """Mean absolute share of each feature in the log-odds: beta (x - mean)."""
        return np.abs((x - self.mean) / self.scale * self.coefficients).mean(axis=0)


def long_targets(panel: DataFrame, keep: list[str], targets: list[str]) -> DataFrame:
    """(keep, class, y): one row per panel row and target, null targets left out."""
    return panel.unpivot(keep, targets, "class", "y").where("y is not null").withColumn("y", F.col("y").cast("int"))


def _sized(rows: DataFrame, by: list[str]) -> DataFrame:
    most = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > MOST_ROWS:
        raise ValueError(f"a panel of {most} rows is too large for one task")
    return rows


def fit_predict(rows: DataFrame, features: list[str], by: list[str], keep: list[str], c: str | float = 1.0) -> DataFrame:
    """(by, keep, y, y_score) of the valid rows of each group, scored by a model of its train rows.

    rows: (by, keep, features, y, part in train and valid); `c` is the inverse penalty or the column that holds it. A
    group whose train rows have one label only, or that has no valid rows, is left out.
    """
    rows = _sized(rows.na.drop(subset=features), by)
    out = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in [*by, *keep])

    def run(own: pd.DataFrame) -> pd.DataFrame:
        train, valid = own[own["part"] == "train"], own[own["part"] == "valid"]
        if train["y"].nunique() < 2 or not len(valid):
            return pd.DataFrame(columns=[*by, *keep, "y", "y_score"])
        model = Logistic(float(own[c].iloc[0]) if isinstance(c, str) else c).fit(train[features].to_numpy(float), train["y"].to_numpy())
        return valid[[*by, *keep, "y"]].assign(y_score=model.score(valid[features].to_numpy(float)))

    wanted = dict.fromkeys([*by, *keep, *features, "y", "part", *([c] if isinstance(c, str) else [])])
    return rows.select(*wanted).groupBy(*by).applyInPandas(run, f"{out}, y int, y_score double")


def attributions(rows: DataFrame, features: list[str], c: float = 1.0) -> DataFrame:
    """(class, feature, coefficient, attribution) of a model of each class on its train rows (class, features, y)."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        if own["y"].nunique() < 2:
            return pd.DataFrame(columns=["class", "feature", "coefficient", "attribution"])
        x = own[features].to_numpy(float)
        model = Logistic(c).fit(x, own["y"].to_numpy())
        return pd.DataFrame({"class": own["class"].iloc[0], "feature": features, "coefficient": model.coefficients, "attribution": model.attribution(x)})

    rows = _sized(rows.na.drop(subset=features), ["class"])
    return rows.select("class", *features, "y").groupBy("class").applyInPandas(run, "class string, feature string, coefficient double, attribution double")


def attribution_summary(table: DataFrame, least: float = 0.05) -> DataFrame:
    """(feature, mean_attribution, n_classes): the mean over classes and the classes in which it exceeds `least`."""
    return table.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_attribution"), F.count_if(F.abs("attribution") > least).alias("n_classes"))


def with_folds(rows: DataFrame, years: list[int], year: str = "target_year") -> DataFrame:
    """Rows of each expanding fold: all target years before `valid_year` train, that year is valid."""
    folds = rows.sparkSession.createDataFrame([(i, y) for i, y in enumerate(years)], "fold int, valid_year int")
    both = rows.join(F.broadcast(folds), F.col(year) <= F.col("valid_year"))
    return both.withColumn("part", F.when(F.col(year) == F.col("valid_year"), "valid").otherwise("train"))


def trials(rows: DataFrame, features: list[str], years: list[int], settings: list[dict]) -> DataFrame:
    """(trial, params, class, fold, ap): average precision of each setting ({"c": ...}) in each class and fold.

    All fits run side by side, whatever the number of settings.
    """
    grid = rows.sparkSession.createDataFrame([(i, float(s["c"]), json.dumps(s, sort_keys=True)) for i, s in enumerate(settings)], "trial int, c double, params string")
    tried = with_folds(rows, years).crossJoin(F.broadcast(grid.select("trial", "c")))
    scored = fit_predict(tried, features, ["trial", "class", "fold"], [], "c")
    return average_precision(scored, ["trial", "class", "fold"], "y", "y_score").where("ap is not null").join(F.broadcast(grid.select("trial", "params")), "trial").select("trial", "params", "class", "fold", "ap")


def trial_table(found: DataFrame) -> DataFrame:
    """(trial, params, score, n_folds, std, pruned): mean over folds of the macro average precision, best first by `place`.

    A setting that a median pruner stops in some fold is marked and comes after all others.
    """
    folds = found.groupBy("trial", "params", "fold").agg(F.avg("ap").alias("score"))
    stopped = pruned_runs(folds, "trial", "fold", "score").groupBy("trial").agg(F.max("pruned").alias("pruned"))
    out = fold_stats(folds, ["trial", "params"], "score").join(stopped, "trial").withColumnRenamed("mean", "score")
    return out.withColumn("place", F.row_number().over(W.orderBy("pruned", F.desc("score"), "trial")))  # one row a setting


def best_per_class(found: DataFrame) -> DataFrame:
    """(class, trial, params, score): the setting with the highest mean over folds for each class (ties: the first)."""
    by = found.groupBy("class", "trial", "params").agg(F.avg("ap").alias("score"))
    return by.groupBy("class").agg(F.min(F.struct((-F.col("score")).alias("s"), "trial", "params")).alias("b")).select("class", "b.trial", "b.params", (-F.col("b.s")).alias("score"))


def class_prevalence(rows: DataFrame, years: list[int]) -> DataFrame:
    """(class, prevalence): mean over folds of the share of positives among the valid rows."""
    valid = with_folds(rows, years).where("part = 'valid'").groupBy("class", "fold").agg(F.avg("y").alias("p"))
    return valid.groupBy("class").agg(F.avg("p").alias("prevalence"))


def fit_trees(train: DataFrame, valid: DataFrame, features: list[str], target: str, kind: str = "forest", seed: int = 42) -> DataFrame:
    """Valid rows with y_score from a random forest, or from boosted trees in place of the boosting libraries; labels weigh
    the same. A distributed fit, for one target."""
    n = train.agg(F.count("*").alias("n"), F.sum(F.col(target)).alias("p")).first()
    weight = F.when(F.col(target) == 1, n["n"] / (2 * max(n["p"] or 0, 1))).otherwise(n["n"] / (2 * max(n["n"] - (n["p"] or 0), 1)))
    vector = VectorAssembler(inputCols=features, outputCol="__features")
    common = dict(labelCol=target, featuresCol="__features", weightCol="__weight", seed=seed)
    model = RandomForestClassifier(numTrees=60, maxDepth=6, **common) if kind == "forest" else GBTClassifier(maxIter=20, maxDepth=3, **common)
    out = model.fit(vector.transform(train.withColumn("__weight", weight))).transform(vector.transform(valid))
    return out.withColumn("y_score", vector_to_array("probability")[1]).drop("__features", "rawPrediction", "probability", "prediction")


def subsets(manifest: dict[str, list[str]], chosen: dict[str, list[str] | bool]) -> list[str]:
    """Feature columns of the chosen groups: all of a group for True, else the named ones; unknown names are refused."""
    out: list[str] = []
    for group, part in chosen.items():
        own = manifest[group]
        if part is True:
            out += own
        elif part:
            if missing := sorted(set(part) - set(own)):
                raise ValueError(f"no features {missing} in group {group}")
            out += [f for f in own if f in part]
    return list(dict.fromkeys(out))
