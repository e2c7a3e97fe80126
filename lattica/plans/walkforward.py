"""Walk-forward studies: factor selection, fixed rules, model comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.numeric import flag, present, ratio, row_mean
from lattica.operators.diagnostics import information_coefficient, melt_factors
from lattica.operators.preprocess import DATE, rank_label, zscore
from lattica.operators.sections import WHOLE, Layout
from lattica.plans.folds import anniversary_folds, fold_dates, year_folds
from lattica.plans.boosting import BoostSettings, boost
from lattica.plans.ridge import choose_alpha, fit_ridge, predict_ridge, prediction_ic
from lattica.session import settle


def fold_means(daily: DataFrame, dates: DataFrame, by=("factor",), value: str = "ic", fold: str = "test_year") -> DataFrame:
    """Mean of a daily series over each fold's parts."""
    return daily.join(F.broadcast(dates), "trade_date").groupBy(fold, "part", *by).agg(F.avg(value).alias("mean_ic"))


def select_factors(scores: DataFrame, names, label: str, dates: DataFrame, layout: Layout = WHOLE) -> DataFrame:
    """Factors with positive training and validation IC; weight follows validation IC.

    One IC per (factor, date) serves every fold. Folds without a survivor keep a row
    with a NULL factor, which means cash.
    """
    long = melt_factors(scores, names, ["trade_date", "symbol", label])
    ic = information_coefficient(long, "value", label, ("factor", "trade_date"), layout=layout)
    means = fold_means(ic, dates.where("part <> 'test'"))
    wide = means.groupBy("test_year", "factor").agg(
        F.max(F.when(F.col("part") == "train", F.col("mean_ic"))).alias("train_ic"),
        F.max(F.when(F.col("part") == "validation", F.col("mean_ic"))).alias("validation_ic"),
    )
    kept = wide.where("train_ic > 0 AND validation_ic > 0")
    total = F.sum("validation_ic").over(W.partitionBy("test_year"))  # one row per factor
    weights = kept.withColumn("weight", F.col("validation_ic") / total)
    return dates.select("test_year").distinct().join(weights, "test_year", "left")


def walk_forward_scores(
    scores: DataFrame, names, weights: DataFrame, dates: DataFrame, minimum_valid: int, layout: Layout = WHOLE
) -> DataFrame:
    """Out-of-sample score of each fold's test rows from that fold's weights."""
    names = list(names)
    per_fold = weights.groupBy("test_year").agg(
        *[F.max(F.when(F.col("factor") == n, F.col("weight"))).alias(f"_w_{n}") for n in names],
        F.count("factor").alias("selected_count"),
    )
    own = dates.where("part = 'test'").select("test_year", "trade_date")
    rows = scores.join(F.broadcast(own), "trade_date").join(F.broadcast(per_fold), "test_year")  # one row per fold
    zero = F.lit(0.0)
    top = sum((F.coalesce(F.col(n) * F.col(f"_w_{n}"), zero) for n in names), zero)
    bottom = sum((F.when(F.col(n).isNotNull(), F.coalesce(f"_w_{n}", zero)).otherwise(zero) for n in names), zero)
    seen = sum(((F.col(n).isNotNull() & F.col(f"_w_{n}").isNotNull()).cast("int") for n in names), F.lit(0))
    enough = seen >= F.least(F.lit(minimum_valid), F.col("selected_count"))
    rows = rows.withColumns(
        {
            "_raw": F.when(enough & (F.col("selected_count") > 0), ratio(top, bottom)),
            "force_cash": F.col("selected_count") == 0,
        }
    )
    rows = zscore(rows, "_raw", "factor_processed", DATE, layout)
    return rows.drop("_raw", *[f"_w_{n}" for n in names])


def selection_walk_forward(
    scores: DataFrame, names, label: str, sessions: DataFrame, train: int = 5, validation: int = 1, test: int = 1,
    embargo: int = 5, minimum_valid: int = 1, layout: Layout = WHOLE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fold weights, out-of-sample scores, fold summary)."""
    dates = fold_dates(sessions, year_folds(sessions, train, validation, test), embargo)
    weights = select_factors(scores, names, label, dates, layout)
    out = walk_forward_scores(scores, names, weights, dates, minimum_valid, layout)
    ic = information_coefficient(out, "factor_processed", label, ("test_year", "trade_date"), layout=layout)
    tested = ic.groupBy("test_year").agg(F.avg("ic").alias("test_mean_ic"))
    names_used = F.array_join(F.array_sort(F.collect_list("factor")), ",")  # at most one entry per factor
    folds = (
        weights.groupBy("test_year")
        .agg(names_used.alias("selected_factors"), F.count("factor").alias("selected_count"))
        .join(tested, "test_year", "left")
    )
    return weights, out, folds


def fixed_rule_walk_forward(
    scores: DataFrame, signal: str, label: str, sessions: DataFrame, train: int = 5, validation: int = 1,
    test: int = 1, embargo: int = 5, layout: Layout = WHOLE,
) -> DataFrame:
    """Train, validation and test IC of one frozen score per anniversary fold."""
    dates = anniversary_folds(sessions, train, validation, test, embargo)
    ic = information_coefficient(scores, signal, label, layout=layout)
    joined = dates.join(ic, "trade_date", "left")
    parts = joined.groupBy("fold", "part").agg(
        F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.avg("ic").alias("mean_ic")
    )
    return parts.groupBy("fold").agg(
        *[
            F.max(F.when(F.col("part") == p, F.col(c))).alias(f"{p}_{c}")
            for p in ("train", "validation", "test")
            for c in ("first_date", "last_date", "mean_ic")
        ]
    )


def model_frame(scores: DataFrame, features, label: str, minimum_valid: int, layout: Layout = WHOLE) -> DataFrame:
    """Universe rows with enough features and the centred rank label."""
    features = list(features)
    rows = scores.where(flag("in_universe") & (present(features) >= minimum_valid))
    rows = rows.select("trade_date", "symbol", *features, F.col(label).alias("_label"))
    return rank_label(rows, "_label", "label", layout=layout).drop("_label")


def ridge_walk_forward(
    rows: DataFrame, features, alphas, sessions: DataFrame, train: int, validation: int, test: int, embargo: int,
    layout: Layout = WHOLE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, fold table, coefficients of the refitted models)."""
    features = list(features)
    dates = fold_dates(sessions, year_folds(sessions, train, validation, test), embargo)
    fitted = settle(fit_ridge(rows, dates, features, [float(a) for a in alphas]))  # folds x penalties, read three times
    best = choose_alpha(rows, dates, fitted, features, layout)
    refit = fitted.where("fitted_on = 'train+validation'").join(F.broadcast(best), ["test_year", "alpha"])
    scored = predict_ridge(rows, dates, refit, features, "test").select(
        "test_year", "trade_date", "symbol", "label", F.col("prediction").alias("ridge_prediction"),
        row_mean(features).alias("equal_weight_prediction"),
    )
    by = ("test_year", "trade_date")
    ridge_ic = prediction_ic(scored, "ridge_prediction", by=by, layout=layout)
    equal_ic = prediction_ic(scored, "equal_weight_prediction", by=by, layout=layout)
    folds = (
        refit.select("test_year", F.col("alpha").alias("ridge_alpha"), F.col("validation_ic").alias("ridge_validation_ic"))
        .join(ridge_ic.groupBy("test_year").agg(F.avg("ic").alias("ridge_test_ic")), "test_year", "left")
        .join(equal_ic.groupBy("test_year").agg(F.avg("ic").alias("equal_weight_test_ic")), "test_year", "left")
        .join(
            scored.groupBy("test_year").agg(F.count("*").alias("test_rows")), "test_year", "left"
        )
    )
    importance = refit.select(
        "test_year",
        F.lit("ridge").alias("model"),
        F.inline(F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("coefficients").alias("importance"))),
    )
    return scored, folds, importance


def model_comparison(
    rows: DataFrame, features, alphas, sessions: DataFrame, train: int, validation: int, test: int, embargo: int,
    layout: Layout = WHOLE, settings: BoostSettings | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ridge, boosted trees and the equal-weight score on the same folds: (predictions, fold table, importances)."""
    features = list(features)
    scored, folds, importance = ridge_walk_forward(rows, features, alphas, sessions, train, validation, test, embargo, layout)
    dates = fold_dates(sessions, year_folds(sessions, train, validation, test), embargo)
    boosted, report, gains = boost(rows, features, dates, settings)
    keys = ["test_year", "trade_date", "symbol"]
    boosted = settle(boosted.select(*keys, "label", F.col("prediction").alias("boosted_prediction")))
    ic = prediction_ic(boosted, "boosted_prediction", by=("test_year", "trade_date"), layout=layout)
    folds = folds.join(ic.groupBy("test_year").agg(F.avg("ic").alias("boosted_test_ic")), "test_year", "left")
    folds = folds.join(report.select("test_year", "trees_kept"), "test_year", "left")
    both = scored.join(boosted.drop("label"), keys)
    return both, folds, importance.unionByName(gains)


def importance_stability(importance: DataFrame) -> DataFrame:
    """Normalised importance per feature over folds: mean, spread, sign share."""
    total = F.sum(F.abs("importance")).over(W.partitionBy("test_year", "model"))  # one row per feature
    shares = importance.withColumn("_share", ratio("importance", total))
    return shares.groupBy("model", "feature").agg(
        F.avg("_share").alias("mean_normalized_importance"),
        F.stddev_samp("_share").alias("importance_std"),
        F.avg((F.col("importance") > 0).cast("double")).alias("positive_share"),
        F.countDistinct("test_year").alias("folds"),
    ).orderBy("model", F.desc(F.abs("mean_normalized_importance")))


def boosted_trees(
    rows: DataFrame, features, split: DataFrame, max_iterations: int = 300, step: float = 0.03, depth: int = 4,
    subsample: float = 0.8, seed: int = 42,
) -> DataFrame:
    """Gradient-boosted trees, grown until the validation error stops falling.

    ``split`` is ``(trade_date, part)``. MLlib grows the trees over the partitioned
    rows; its results are not those of other boosting libraries. Its default tolerance
    is a hundredth of the error, more than a step of this size can gain, so that it would
    keep one tree; here any further gain counts. Medians for missing values are within
    a ten-thousandth of the rows.
    """
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    features = list(features)
    data = rows.join(F.broadcast(split), "trade_date")  # one row per session
    filled = [f"_{f}" for f in features]
    imputer = Imputer(strategy="median", inputCols=features, outputCols=filled, relativeError=1e-4)
    assembler = VectorAssembler(inputCols=filled, outputCol="_vector")
    train = data.where("part = 'train' AND label IS NOT NULL")
    filler = imputer.fit(train)
    ready = assembler.transform(filler.transform(data))
    fit = ready.where("part <> 'test' AND label IS NOT NULL").withColumn("_check", F.col("part") == "validation")
    trees = GBTRegressor(
        featuresCol="_vector", labelCol="label", validationIndicatorCol="_check", maxIter=max_iterations,
        stepSize=step, maxDepth=depth, subsamplingRate=subsample, seed=seed, validationTol=0.0,
    ).fit(fit)
    scored = trees.transform(ready.where("part = 'test'"))
    return scored.select("trade_date", "symbol", "label", "prediction")
