"""Leakage-safe preparation, forests, nested cross-validation, ensembles and attribution."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrastat.functions.scalar import hash_uniform, poisson_one
from terrastat.operators.forests import Forest, Kept, Planned, Sample, fit_large, fit_many, held_sample, job_of, keep_large, left_out_errors, plan_many, with_predictions
from terrastat.operators.ranks import assign_folds
from terrastat.operators.search import FOREST_SPACE, Search
from terrastat.operators.summary import exact_percentiles, to_long
from terrastat.session import cut_lineage, local_table

# ------------------------------------------------------ train-only statistics


def training_rows(df: DataFrame, fold: str, k: int, out: str = "train_fold") -> DataFrame:
    """Every row once for each fold it trains (all folds but its own)."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(1), F.lit(k)))).filter(F.col(out) != F.col(fold))


def training_medians(df: DataFrame, numeric: Sequence[str], fold: str, k: int) -> DataFrame:
    """Median of each column over the rows outside each fold; an empty column gives 0."""
    long = to_long(training_rows(df, fold, k), numeric, ["train_fold"])
    med = exact_percentiles(long, "value", [0.5], ["train_fold", "variable"])
    names = F.explode(F.array(*[F.lit(c) for c in numeric]))
    every = df.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("train_fold"), names.alias("variable"))
    return every.join(med, ["train_fold", "variable"], "left").select(
        "train_fold", "variable", F.coalesce("percentile", F.lit(0.0)).alias("median")
    )


def training_modes(df: DataFrame, categorical: Sequence[str], fold: str, k: int) -> DataFrame:
    """Most frequent value of each column outside each fold, the smallest on ties."""
    text = training_rows(df, fold, k).select("train_fold", *[F.col(c).cast("string").alias(c) for c in categorical])
    counts = (
        text.unpivot(["train_fold"], list(categorical), "variable", "level")
        .filter(F.col("level").isNotNull())
        .groupBy("train_fold", "variable", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy("train_fold", "variable").orderBy(F.col("n").desc(), "level")
    return counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).select("train_fold", "variable", F.col("level").alias("mode"))


def training_levels(df: DataFrame, categorical: Sequence[str], fold: str, k: int) -> DataFrame:
    """Levels seen outside each fold, numbered from 0 in sorted order; level 0 is the dropped one."""
    text = training_rows(df, fold, k).select("train_fold", *[F.col(c).cast("string").alias(c) for c in categorical])
    seen = text.unpivot(["train_fold"], list(categorical), "variable", "level").filter(F.col("level").isNotNull()).distinct()
    w = Window.partitionBy("train_fold", "variable").orderBy("level")
    return seen.withColumn("position", F.row_number().over(w) - 1)


def fit_statistics(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """``feature, kind, value`` of a training table: medians, modes and sorted levels."""
    med = exact_percentiles(to_long(df, numeric), "value", [0.5], ["variable"])
    names = local_table(df.sparkSession, [(c,) for c in numeric], "variable string")
    out = names.join(med, "variable", "left").select(
        F.col("variable").alias("feature"), F.lit("median").alias("kind"), F.coalesce("percentile", F.lit(0.0)).cast("string").alias("value")
    )
    if not categorical:
        return out
    text = df.select(*[F.col(c).cast("string").alias(c) for c in categorical])
    counts = text.unpivot([], list(categorical), "feature", "value").filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("feature").orderBy(F.col("n").desc(), "value")
    modes = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
    return out.unionByName(modes.select("feature", F.lit("mode").alias("kind"), "value")).unionByName(
        counts.select("feature", F.lit("level").alias("kind"), "value")
    )


def apply_statistics(df: DataFrame, stats: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Filled numeric columns and one-hot columns from stored statistics only.

    Statistics are a handful of values per feature, so they become literals: the
    result is one projection without a join.
    """
    rows = stats.collect()
    median = {r["feature"]: float(r["value"]) for r in rows if r["kind"] == "median"}
    mode = {r["feature"]: r["value"] for r in rows if r["kind"] == "mode"}
    levels: dict[str, list[str]] = {}
    for r in rows:
        if r["kind"] == "level":
            levels.setdefault(r["feature"], []).append(r["value"])
    new = {c: F.coalesce(F.col(c).cast("double"), F.lit(median[c])) for c in numeric}
    hot: dict = {}
    for c in categorical:
        code = F.coalesce(F.col(c).cast("string"), F.lit(mode.get(c)))
        for lv in sorted(levels.get(c, []))[1:]:
            hot[f"{c}_{lv}"] = (code == lv).cast("double")
    return df.withColumns({**new, **hot}), [*numeric, *hot]


# -------------------------------------------------------------------- forests


class Trainer(NamedTuple):
    """A forest to be fitted; ``params``: trees, depth, leaf, subset, split (rows of a node that may be split) and bootstrap (rows are drawn)."""

    features: Sequence[str]
    label: str
    params: Mapping
    weight: str | None = None
    seed: int = 42

    def fit(self, df: DataFrame) -> Forest:
        by = [*self.features, self.label, *([self.weight] if self.weight else [])]  # an order that does not depend on partitions
        sample = held_sample(df, by, self.features, self.label, weights=[F.col(self.weight)] if self.weight else [])
        if sample is None:
            return fit_large(df, self.features, self.label, self.params, self.seed, self.weight)
        return fit_many(df.sparkSession, [sample], [job_of(self.params, self.seed, weight=0 if self.weight else -1)])[0]


def forest(features: Sequence[str], label: str, params: Mapping, weight: str | None = None, seed: int = 42) -> Trainer:
    return Trainer(list(features), label, params, weight, seed)


class Budget(NamedTuple):
    """A sequential search: seeded trials over the ranges of a forest's settings, ``batch`` of them at a time."""

    trials: int = 50
    seed: int = 42
    batch: int = 10
    space: Mapping = FOREST_SPACE


def _tuned_held(spark, samples: Sequence[Sample], folds: int, settings: Sequence[Mapping] | Budget) -> list[tuple[list[dict], list[float]]]:
    """Settings tried on each table and their mean errors; a batch of trials of all tables and folds is one job."""
    budget = settings if isinstance(settings, Budget) else None
    studies = [Search(budget.space, budget.seed) for _ in samples] if budget else []
    rounds = -(-budget.trials // budget.batch) if budget else 1
    tried: list[tuple[list[dict], list[float]]] = [([], []) for _ in samples]
    for i in range(rounds):
        asked = [s.ask(min(budget.batch, budget.trials - i * budget.batch)) for s in studies] if budget else [list(map(dict, settings)) for _ in samples]
        jobs = [job_of(p, 42, t, f) for t, ps in enumerate(asked) for p in ps for f in range(1, folds + 1)]
        errors = iter(left_out_errors(spark, samples, jobs))
        for t, ps in enumerate(asked):
            scores = [sum(next(errors) for _ in range(folds)) / folds for _ in ps]
            tried[t][0].extend(ps)
            tried[t][1].extend(scores)
            if budget:
                studies[t].tell(ps, scores)
    return tried


def _tuned_large(train: DataFrame, features: Sequence[str], label: str, inner: str, folds: int, settings: Sequence[Mapping] | Budget) -> tuple[list[dict], list[float]]:
    """The same search fold by fold over a table that tasks cannot hold."""
    budget = settings if isinstance(settings, Budget) else None
    study = Search(budget.space, budget.seed) if budget else None
    tried, scores = [], []
    while len(tried) < (budget.trials if budget else len(settings)):
        ps = study.ask(min(budget.batch, budget.trials - len(tried))) if budget else list(map(dict, settings))
        found = []
        for p in ps:
            errors = []
            for f in range(1, folds + 1):
                model = fit_large(train.filter(F.col(inner) != f), features, label, p, 42)
                held = model.transform(train.filter(F.col(inner) == f).select(*features, label), "_p")
                errors.append(held.agg(F.sqrt(F.avg(F.pow(F.col("_p") - F.col(label), F.lit(2.0))))).first()[0])
            found.append(sum(errors) / folds)
        if study:
            study.tell(ps, found)
        tried, scores = tried + ps, scores + found
    return tried, scores


def tune_tables(
    tables: Sequence[tuple[DataFrame, Sequence[str]]], ids: Sequence[str], label: str, inner: str, folds: int, settings: Sequence[Mapping] | Budget, apart: bool = False
) -> list[tuple[Forest | Kept | Planned, dict, list[dict], list[float]]]:
    """For each table (rows, features) the model refitted with its best setting, that setting, and all settings tried with their mean errors.

    ``inner`` numbers the inner folds from 1. Tables that tasks can hold are searched together: all folds and tables of a batch of trials are
    one job. Stored tables (``cut_lineage``) save reading them again. ``apart``: models that only predict, whose nodes never come to the driver.
    """
    samples = [(s := held_sample(df, ids, names, label, inner)) and s.bins() for df, names in tables]
    held = [i for i, s in enumerate(samples) if s is not None]
    spark = tables[0][0].sparkSession
    tried = dict(zip(held, _tuned_held(spark, [samples[i] for i in held], folds, settings))) if held else {}
    for i, (df, names) in enumerate(tables):
        if i not in tried:
            tried[i] = _tuned_large(df, names, label, inner, folds, settings)
    best = {i: ps[min(range(len(ps)), key=lambda j: (math.isnan(es[j]), es[j], j))] for i, (ps, es) in tried.items()}
    models = dict(zip(held, (plan_many if apart else fit_many)(spark, [samples[i] for i in held], [job_of(best[i], 42, n) for n, i in enumerate(held)]))) if held else {}
    for i, (df, names) in enumerate(tables):
        if i not in models:
            models[i] = (keep_large if apart else fit_large)(df, names, label, best[i], 42)
    return [(models[i], dict(best[i]), *tried[i]) for i in range(len(tables))]


def tune_forest(train: DataFrame, features: Sequence[str], label: str, inner: str, folds: int, settings: Sequence[Mapping] | Budget, ids: Sequence[str] = ("id",), apart: bool = False) -> tuple[Forest | Kept | Planned, dict, list[dict], list[float]]:
    """``tune_tables`` for one table."""
    return tune_tables([(train, features)], ids, label, inner, folds, settings, apart)[0]


def fold_tables(df: DataFrame, ids: Sequence[str], label: str, outer: int, inner: int, seed: int) -> DataFrame:
    """Rows with a present label and their outer fold; targets are never imputed."""
    return assign_folds(df.filter(F.col(label).isNotNull()), ids, outer, seed)


def prepared_folds(
    rows: DataFrame, ids: Sequence[str], keep: Sequence[str], label: str, numeric: Sequence[str], categorical: Sequence[str], outer: int, inner: int, seed: int
) -> list[tuple[DataFrame, list[str], DataFrame]]:
    """Per outer fold the training rows with inner folds, the feature names, and the rows left out, both prepared by training statistics only."""
    out = []
    for f in range(1, outer + 1):
        train, test = rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)
        stats = cut_lineage(fit_statistics(train, numeric, categorical))
        ready, names = apply_statistics(train, stats, numeric, categorical)
        ready = cut_lineage(assign_folds(ready.select(*ids, *keep, label, *names), ids, inner, seed + f, out="inner"))
        held, _ = apply_statistics(test, stats, numeric, categorical)
        out.append((ready, names, held.select(*ids, *keep, label, *names)))
    return out


def nested_cv(
    df: DataFrame, ids: Sequence[str], label: str, numeric: Sequence[str], categorical: Sequence[str], settings: Sequence[Mapping] | Budget,
    outer: int = 5, inner: int = 4, seed: int = 123,
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions ``ids, fold, obs, pred`` and the chosen settings per fold; the folds are searched together."""
    rows = cut_lineage(fold_tables(df, ids, label, outer, inner, seed))
    folds = prepared_folds(rows, ids, [], label, numeric, categorical, outer, inner, seed)
    predictions, chosen = None, []
    tuned = tune_tables([(ready, names) for ready, names, _ in folds], ids, label, "inner", inner, settings, apart=True)
    for f, ((_, _, held), (model, best, _, scores)) in enumerate(zip(folds, tuned), 1):
        part = model.transform(held).select(*ids, F.lit(f).alias("fold"), F.col(label).cast("double").alias("obs"), F.col("prediction").alias("pred"))
        predictions = part if predictions is None else predictions.unionByName(part)
        chosen.append((f, best["trees"], best["depth"], best["leaf"], best.get("split", 2), best["subset"], float(min(scores))))
    best_df = local_table(df.sparkSession, chosen, "fold int, trees int, depth int, leaf int, split int, subset string, inner_rmse double")
    return cut_lineage(predictions), best_df


def final_model(
    df: DataFrame, ids: Sequence[str], label: str, numeric: Sequence[str], categorical: Sequence[str], settings: Sequence[Mapping] | Budget,
    inner: int = 4, seed: int = 123, apart: bool = False,
) -> tuple[Forest | Kept | Planned, DataFrame, list[str], dict]:
    """Model tuned and fitted on every row with a label, with its statistics and feature names (``apart`` as in ``tune_tables``)."""
    rows = df.filter(F.col(label).isNotNull())
    stats = cut_lineage(fit_statistics(rows, numeric, categorical))
    ready, names = apply_statistics(rows, stats, numeric, categorical)
    ready = cut_lineage(assign_folds(ready.select(*ids, label, *names), ids, inner, seed, out="inner"))
    model, best, *_ = tune_forest(ready, names, label, "inner", inner, settings, ids, apart)
    return model, stats, names, best


def bootstrap_models(train: DataFrame, ids: Sequence[str], features: Sequence[str], label: str, params: Mapping, n_models: int, seed: int) -> list[Planned] | list[Kept]:
    """Forests refitted on Poisson(1) resamples; the weight is a hash of row and resample. All of them are one job.

    They never meet on the driver: they are grown by the tasks that predict with them, or lie in the shared folder.
    """

    def drawn(b: int):
        return poisson_one(hash_uniform(F.lit(str(seed)), F.lit(b), *ids)).cast("tinyint")

    sample = held_sample(train, ids, features, label, weights=[drawn(b) for b in range(1, n_models + 1)])
    if sample is not None:
        return plan_many(train.sparkSession, [sample], [job_of(params, seed + b, weight=b - 1) for b in range(1, n_models + 1)])
    out = []
    for b in range(1, n_models + 1):
        rows = train.withColumn("_w", drawn(b).cast("double")).filter(F.col("_w") > 0)
        out.append(keep_large(rows, features, label, params, seed + b, "_w"))
    return out


def ensemble_statistics(predictions: Sequence[str]) -> tuple:
    """Mean and sample sd across prediction columns of one row."""
    arr = F.array(*[F.col(c) for c in predictions])
    n = float(len(predictions))
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / n
    ss = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return mean, F.sqrt(ss / (n - 1.0))


def ensemble_predict(df: DataFrame, models: Sequence[Forest | Kept | Planned]) -> DataFrame:
    """Mean and sd of all models per row, in one pass."""
    names = [f"_p{b}" for b in range(len(models))]
    mean, sd = ensemble_statistics(names)
    return with_predictions(df, dict(zip(names, models))).withColumn("mean", mean).withColumn("sd", sd).drop(*names)


# ---------------------------------------------------------------- attribution


def mean_abs_attribution(phi: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return phi.groupBy(*by, "feature").agg(F.avg(F.abs("phi")).alias("mean_abs"), F.count(F.lit(1)).alias("n"))


def importances(model: Forest, features: Sequence[str]) -> DataFrame:
    """Impurity importance of each feature."""
    from pyspark.sql import SparkSession

    v = model.importances()
    return local_table(SparkSession.active(), [(f, float(x)) for f, x in zip(features, v)], "feature string, importance double")


def dependence_rows(phi: DataFrame, n_top: int, exclude: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Value and attribution of the strongest numeric predictors; the attributions are computed once and stored."""
    from terrastat.operators.prep import exclude_prefixes
    from terrastat.operators.ranks import top_per_group

    numeric = cut_lineage(exclude_prefixes(phi, "feature", exclude))
    means = mean_abs_attribution(numeric, by)
    if not by:
        means = means.withColumn("_all", F.lit(1))
    top = top_per_group(means, list(by) or ["_all"], [F.col("mean_abs").desc(), F.col("feature")], n_top)
    return numeric.join(top.select(*by, "feature", "rank"), [*by, "feature"])
