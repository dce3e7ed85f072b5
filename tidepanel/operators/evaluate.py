"""Scores, calibration, comparisons and resampled intervals over a long predictions table."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import ordered
from tidepanel.functions.scalars import log_loss, probability_clip

# Right-closed buckets by number of active markets and by market probability.
ACTIVE_EDGES = (10, 25, 50, 100)
ACTIVE_LABELS = ("<=10", "11-25", "26-50", "51-100", ">100")
PROB_EDGES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
PROB_LABELS = ("0-5%", "5-10%", "10-25%", "25-50%", "50-75%", "75-90%", "90-95%", "95-100%")


def bucket(value: Column, edges, labels) -> Column:
    out = None
    for edge, label in zip(edges, labels):
        out = F.when(value <= edge, label) if out is None else out.when(value <= edge, label)
    return out.otherwise(labels[-1])


def active_count_bucket(n: str = "n_active") -> Column:
    return bucket(F.col(n), ACTIVE_EDGES, ACTIVE_LABELS)


def prob_bucket(p: str = "p") -> Column:
    return bucket(F.col(p), PROB_EDGES, PROB_LABELS)


def decile(p: str = "p_hat") -> Column:
    """Ten right-closed bins of [0, 1] counted from zero, the lowest edge included."""
    return sum(((F.col(p) > i * 0.1).cast("int") for i in range(1, 10)), F.lit(0))


def score_metrics(y: str = "y", p: str = "p_hat") -> list[Column]:
    q = probability_clip(p)
    return [
        F.count("*").alias("n_obs"), F.avg((q - F.col(y)) ** 2).alias("brier"), F.avg(log_loss(y, p)).alias("log_loss"),
        F.avg(q).alias("avg_pred"), F.avg(y).alias("avg_actual"),
    ]


def score_predictions(pred: DataFrame, keys: list[str]) -> DataFrame:
    return pred.groupBy(*keys).agg(*score_metrics())


def score_auc(pred: DataFrame, keys: list[str]) -> DataFrame:
    return ordered.rank_auc(pred.withColumn("__q", probability_clip("p_hat")), keys, "__q", "y")


def score_regression(pred: DataFrame, keys: list[str], actual: str, fitted: str) -> DataFrame:
    e = F.col(actual) - F.col(fitted)
    return pred.where(e.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n_obs"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))


def scores_of_counts(pred: DataFrame, keys: list[str]) -> DataFrame:
    """All scores of each key, the AUC included, from one table of how often each probability met each label."""
    q, pos, neg = F.col("__q"), F.col("__pos").cast("double"), F.col("__neg").cast("double")
    counts = pred.groupBy(*keys, probability_clip("p_hat").alias("__q")).agg(
        F.sum(F.col("y").cast("long")).alias("__pos"), F.sum(1 - F.col("y").cast("long")).alias("__neg"))
    n = F.sum(pos + neg)
    wins = F.sum(pos * (F.col("__neg_upto") - neg / 2.0))
    return ordered.running_sum(counts, keys, [q], ["__neg"]).groupBy(*keys).agg(
        n.cast("long").alias("n_obs"), (F.sum(pos * (1 - q) ** 2 + neg * q ** 2) / n).alias("brier"), (F.sum(-(pos * F.log(q) + neg * F.log(1 - q))) / n).alias("log_loss"),
        (F.sum((pos + neg) * q) / n).alias("avg_pred"), (F.sum(pos) / n).alias("avg_actual"), (wins / F.nullif(F.sum(pos) * F.sum(neg), F.lit(0.0))).alias("auc"))


def result_slices(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Scores overall and by domain, family, label, active-count and probability bucket, in one grouping."""
    named = [("domain", F.col("domain")), ("family", F.col("family")), ("y", F.col("y").cast("string")),
             ("active_count_bucket", active_count_bucket()), ("prob_bucket", prob_bucket())]
    slices = F.array(F.struct(F.lit("overall").alias("slice_type"), F.lit("overall").alias("slice_value")),
                     *[F.struct(F.lit(k).alias("slice_type"), v.alias("slice_value")) for k, v in named])
    rows = pred.withColumn("s", F.explode(slices)).select(*keys, "s.slice_type", "s.slice_value", "y", "p_hat").where("slice_value IS NOT NULL")
    return scores_of_counts(rows, [*keys, "slice_type", "slice_value"])


def calibration_deciles(pred: DataFrame, keys: list[str]) -> DataFrame:
    return pred.groupBy(*keys, decile().alias("prob_decile")).agg(
        F.count("*").alias("n_obs"), F.avg("p_hat").alias("avg_pred"), F.avg("y").alias("avg_actual"))


def expected_calibration_error(pred: DataFrame, keys: list[str]) -> DataFrame:
    cal = calibration_deciles(pred, keys)
    gap = F.abs(F.col("avg_pred") - F.col("avg_actual"))
    return cal.groupBy(*keys).agg((F.sum(F.col("n_obs") * gap) / F.sum("n_obs")).alias("ece"))


def model_leaderboard(fold_scores: DataFrame) -> DataFrame:
    """Unweighted fold means per model, with the total rows, best log loss first."""
    means = [F.avg(c).alias(f"fold_mean_{c}") for c in ("log_loss", "brier", "avg_pred", "avg_actual", "auc") if c in fold_scores.columns]
    return fold_scores.groupBy("model").agg(F.countDistinct("fold").alias("folds"), F.sum("n_obs").alias("n_obs"), *means).orderBy("fold_mean_log_loss")


def fold_decomposition(fold_scores: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """Improvement and shift of mean prediction of the candidate in every fold."""
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    return fold_scores.groupBy("fold").agg(
        (pick(baseline, "log_loss") - pick(candidate, "log_loss")).alias("log_loss_gain"),
        (pick(baseline, "brier") - pick(candidate, "brier")).alias("brier_gain"),
        (pick(candidate, "avg_pred") - pick(baseline, "avg_pred")).alias("calibration_shift"),
    ).withColumn("helped", F.col("log_loss_gain") > 0)


def folds_improved(fold_scores: DataFrame, baseline: str) -> DataFrame:
    """In how many folds each model beats the baseline, and its mean gains."""
    base = fold_scores.where(F.col("model") == baseline).select("fold", F.col("log_loss").alias("l0"), F.col("brier").alias("b0"))
    return fold_scores.where(F.col("model") != baseline).join(base, "fold").groupBy("model").agg(
        F.count("*").alias("folds"), F.count_if(F.col("log_loss") < F.col("l0")).alias("log_loss_folds_improved"),
        F.count_if(F.col("brier") < F.col("b0")).alias("brier_folds_improved"),
        F.avg(F.col("l0") - F.col("log_loss")).alias("log_loss_gain"), F.avg(F.col("b0") - F.col("brier")).alias("brier_gain"))


def tail_diagnostics(pred: DataFrame, keys: list[str]) -> DataFrame:
    """How far predictions reach on the NO side and fall short on the YES side."""
    no, yes = pred.where("y = 0"), pred.where("y = 1")
    a = no.groupBy(*keys).agg(F.avg("p_hat").alias("mean_no"), F.max("p_hat").alias("max_no"))
    b = yes.groupBy(*keys).agg(F.avg("p_hat").alias("mean_yes"), F.min("p_hat").alias("min_yes"))
    qa = ordered.quantiles(no, keys, "p_hat", {"p95_no": 0.95})
    qb = ordered.quantiles(yes, keys, "p_hat", {"p05_yes": 0.05})
    return a.join(qa, keys).join(b.join(qb, keys), keys, "full")


# --- paired comparisons ----------------------------------------------------------------------


def paired_losses(pairs: DataFrame) -> DataFrame:
    """Loss of the baseline minus loss of the candidate per paired row (positive: candidate better)."""
    c, b = probability_clip("p_candidate"), probability_clip("p_baseline")
    return pairs.withColumns({
        "log_gain": log_loss("y", "p_baseline") - log_loss("y", "p_candidate"),
        "brier_gain": (b - F.col("y")) ** 2 - (c - F.col("y")) ** 2,
    })


def domain_gain(pairs: DataFrame) -> DataFrame:
    """Mean gain and share of the total gain per domain, and whether one domain makes over 75 %."""
    by = paired_losses(pairs).groupBy("domain").agg(
        F.count("*").alias("n_obs"), F.avg("log_gain").alias("log_loss_gain"), F.sum("log_gain").alias("total"))
    whole = by.agg(F.sum("total")).scalar()
    best = by.agg(F.max_by("domain", F.struct("log_loss_gain", "domain"))).scalar()
    share = F.col("total") / F.nullif(whole, F.lit(0.0))
    return by.withColumns({"share": share, "is_best": F.col("domain") == best, "dominates": share > 0.75}).drop("total")


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal tail by a rational approximation of erf, good to about 1e-7."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x)


def paired_loss_test(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean loss change of the candidate, its standard error, z and normal p-value."""
    keys = list(keys or [])
    losses = paired_losses(pairs).withColumns({"dl": -F.col("log_gain"), "db": -F.col("brier_gain")})
    out = losses.groupBy(*keys).agg(
        F.count("*").alias("paired_rows"), F.avg("dl").alias("log_loss_delta"), F.stddev_samp("dl").alias("sl"),
        F.avg("db").alias("brier_delta"), F.stddev_samp("db").alias("sb"))
    for name, sd in (("log_loss", "sl"), ("brier", "sb")):
        se = F.nullif(F.col(sd) / F.sqrt("paired_rows"), F.lit(0.0))
        out = out.withColumn(f"{name}_se", se).withColumn(f"{name}_z", F.col(f"{name}_delta") / F.col(f"{name}_se"))
        out = out.withColumn(f"{name}_p", normal_two_sided(F.col(f"{name}_z")))
    return out.drop("sl", "sb")


# --- bootstrap -------------------------------------------------------------------------------

# A prime just under 2^28: unit and replicate are mixed as (a + b * replicate) mod PRIME, with a and
# b taken from a digest of the unit, so weights are independent across units and reproducible.
PRIME = 268435399
# Steps up to the finest share that a draw resolves.
POISSON_STEPS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def resample_weights(a: np.ndarray, b: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(1) counts of the units (rows) in the replicates (columns)."""
    u = (a[:, None] + b[:, None] * np.arange(1, replicates + 1)) % PRIME / PRIME
    return np.searchsorted(POISSON_STEPS, u, side="right").astype(float)


def bootstrap(losses: DataFrame, keys: list[str], unit: list[str], gains: list[str], replicates: int = 300, seed: int = 7,
              one_row_each: bool = False) -> DataFrame:
    """Percentile interval of each mean gain when units (rows or clusters) are redrawn.

    Units are summed first, unless each is a row already. A task multiplies its units' sums with their
    weights in all replicates, so no unit is copied and a task tells one row per replicate.
    """
    if one_row_each:
        sums = losses.select(*keys, *unit, *gains, F.lit(1).cast("long").alias("n"))
    else:
        sums = losses.groupBy(*keys, *unit).agg(*[F.sum(g).alias(g) for g in gains], F.count("*").alias("n"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in unit]))
    hexed = lambda at: F.conv(F.substring(digest, at, 7), 16, 10).cast("long")
    parts = [*gains, "n"]
    drawn = sums.select(*keys, *[F.col(c).cast("double").alias(c) for c in parts], hexed(1).alias("a"), hexed(8).alias("b"))

    def weighted(frames):
        total: dict = {}
        for pdf in frames:
            for key, own in pdf.groupby(keys, dropna=False) if keys else [((), pdf)]:
                w = resample_weights(own["a"].to_numpy(), own["b"].to_numpy(), replicates)
                total[key] = total.get(key, 0.0) + w.T @ own[parts].to_numpy()
        for key, s in total.items():
            out = pd.DataFrame(s, columns=parts)
            out.insert(0, "r", np.arange(1, replicates + 1))
            for k, v in zip(keys, key):
                out[k] = v
            yield out[[*keys, "r", *parts]]

    types = dict(drawn.dtypes)
    told = drawn.mapInPandas(weighted, ", ".join([*(f"{k} {types[k]}" for k in keys), "r long", *(f"{c} double" for c in parts)]))
    reps = told.groupBy(*keys, "r").agg(*[(F.sum(g) / F.nullif(F.sum("n"), F.lit(0.0))).alias(g) for g in gains])
    bands = reps.groupBy(*keys).agg(*[
        F.percentile(g, q).alias(f"{g}_{name}") for g in gains for name, q in (("ci_low", 0.025), ("ci_high", 0.975))])
    point = sums.groupBy(*keys).agg(F.count("*").alias("n_units"), *[(F.sum(g) / F.sum("n")).alias(f"{g}_mean") for g in gains])
    if keys:
        return point.join(bands, keys)
    held = bands.select(F.struct(*bands.columns)).scalar()  # one subquery, so the replicates are drawn once
    return point.withColumn("__bands", held).select(*point.columns, *[F.col("__bands")[c].alias(c) for c in bands.columns])
