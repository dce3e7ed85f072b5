"""As-of and fold-membership joins written as equi-joins and bounded windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_backward(
    left: DataFrame, right: DataFrame, values: list[str], by: list[str] | None = None, on: str = "ts",
    tiebreak: list[str] | None = None, unit: str | None = None,
) -> DataFrame:
    """Each left row with the values of the latest right row at or before it, per `by` key.

    Only distinct left keys take part in the search, and the answer is joined back to the rows.
    The search runs inside (key, time slice); what a slice inherits comes from a table with one
    row per key and slice. So neither a hot key nor a missing key puts all rows in one task.
    """
    by, tiebreak = list(by or []), list(tiebreak or [])
    unit = unit or ("day" if by else "hour")
    picked = F.struct(*[F.col(v) for v in values])
    ties = F.struct(F.lit(True).alias("known"), *[F.col(t) for t in tiebreak]).alias("__tie")
    lhs = left.select(on, *by).distinct().withColumn("__side", F.lit(1))
    rhs = right.select(on, *by, picked.alias("__v"), ties, F.lit(0).alias("__side"))
    both = lhs.unionByName(rhs, allowMissingColumns=True).withColumn("__slice", F.date_trunc(unit, on))

    inside = W.partitionBy(*by, "__slice").orderBy(on, "__side", "__tie").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*by).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    slices = both.groupBy(*by, "__slice").agg(
        F.max_by("__v", F.when(F.col("__side") == 0, F.struct(on, "__tie"))).alias("__last")
    )
    carried = slices.select(*by, "__slice", F.last("__last", ignorenulls=True).over(earlier).alias("__carry"))
    found = both.withColumn("__here", F.last("__v", ignorenulls=True).over(inside)).where(F.col("__side") == 1)
    hit = F.coalesce("__here", "__carry")
    answers = found.join(carried, [*by, "__slice"], "left").select(on, *by, *[hit[v].alias(v) for v in values])
    return left.join(answers, [on, *by], "left").select(*left.columns, *values)


def fold_hours(folds: DataFrame) -> DataFrame:
    """One row per fold, split and hour, so that membership becomes an equi-join on the hour."""
    hour = F.expr("interval 1 hour")
    parts = F.array(
        F.struct(F.lit("train").alias("split"), F.col("train_start").alias("a"), F.col("train_end").alias("b")),
        F.struct(F.lit("test").alias("split"), F.col("test_start").alias("a"), F.col("test_end").alias("b")),
    )
    spans = folds.select("fold", F.explode(parts).alias("s"))
    return spans.select("fold", "s.split", F.explode(F.sequence("s.a", "s.b", hour)).alias("ts"))


def fold_rows(rows: DataFrame, folds: DataFrame, split: str | None = None) -> DataFrame:
    """Rows tagged with every fold and split whose interval holds their hour, ends included."""
    members = fold_hours(folds)
    if split:
        members = members.where(F.col("split") == split)
    return rows.join(members, "ts")


def pair_models(predictions: DataFrame, candidate: str, baseline: str, keys: list[str]) -> DataFrame:
    """Both models' probabilities side by side where both exist."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("p_hat")))
    both = predictions.where(F.col("model").isin(candidate, baseline)).groupBy(*keys).agg(
        pick(candidate).alias("p_candidate"), pick(baseline).alias("p_baseline")
    )
    return both.where("p_candidate IS NOT NULL AND p_baseline IS NOT NULL")


def baseline_delta(metrics: DataFrame, baseline: str, values: list[str], key: str = "fold") -> DataFrame:
    """Every model's metrics minus the baseline's in the same fold."""
    base = metrics.where(F.col("model") == baseline).select(key, *[F.col(v).alias(f"{v}_base") for v in values])
    return metrics.where(F.col("model") != baseline).join(base, key).withColumns(
        {f"{v}_delta": F.col(v) - F.col(f"{v}_base") for v in values}
    )


def semi(rows: DataFrame, ids: DataFrame, key: str | list[str]) -> DataFrame:
    return rows.join(ids, key, "left_semi")


def anti(rows: DataFrame, ids: DataFrame, key: str | list[str]) -> DataFrame:
    return rows.join(ids, key, "left_anti")


def attach(rows: DataFrame, side: DataFrame, key: str | list[str], how: str = "left") -> DataFrame:
    """Equi-join with a side table; its size decides at run time whether it is broadcast."""
    return rows.join(side, key, how)
