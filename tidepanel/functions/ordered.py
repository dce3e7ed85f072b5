"""Ranks, running sums and exact quantiles that never sort a whole column in one task.

Every helper works in two levels: rows are ordered inside a bucket, and only the per-bucket
totals (a bounded number of rows) are accumulated across buckets. Buckets are ranges of the order
itself, cut by Spark where a sample of the rows says so: they are even however the values crowd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.session import cut_lineage


def in_ranges(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows with `__range`, the number of the range of (keys, order) they are in; written, so that the cuts stay what they are."""
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(count, *[F.col(k) for k in keys], *order)
    return cut_lineage(dealt.withColumn("__range", F.spark_partition_id()))


def running_sum(df: DataFrame, keys: list[str], order: list[Column], sums: list[str]) -> DataFrame:
    """Adds `<name>_upto`, the inclusive running sum of each named column in order, per key."""
    return summed_ranges(in_ranges(df, keys, order), keys, "__range", order, sums).drop("__range")


def summed_ranges(df: DataFrame, keys: list[str], bucket: str, order: list[Column], sums: list[str]) -> DataFrame:
    """Running sums over buckets that follow the order; `df` is read for both levels."""
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(s).alias(s) for s in sums])
    offsets = totals.select(
        *keys, bucket, *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"__before_{s}") for s in sums]
    )
    return (
        df.withColumns({f"{s}_upto": F.sum(s).over(inside) for s in sums})
        .join(offsets, [*keys, bucket])
        .withColumns({f"{s}_upto": F.col(f"{s}_upto") + F.col(f"__before_{s}") for s in sums})
        .drop(*[f"__before_{s}" for s in sums])
    )


def dense_index(df: DataFrame, ts: str = "ts", unit: str = "month", start: int = 0) -> DataFrame:
    """Position of each distinct timestamp in order, `idx`, counted from `start`."""
    stamps = df.select(ts).distinct().withColumns({"__b": F.date_trunc(unit, ts), "__one": F.lit(1)})
    out = summed_ranges(cut_lineage(stamps), [], "__b", [F.col(ts)], ["__one"])
    return out.select(ts, (F.col("__one_upto") - 1 + start).cast("long").alias("idx"))


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], weight: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per key. Equal values are counted before any shuffle."""
    size = F.sum(weight) if weight else F.count("*")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(size.alias("__n"))
    counts = in_ranges(counts, keys, [F.col(value)])
    run = summed_ranges(counts, keys, "__range", [F.col(value)], ["__n"])
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    if keys:
        run = run.join(totals, keys)
    else:
        run = run.withColumn("__total", totals.scalar())

    def pick(rank: Column) -> Column:
        here = (F.col("__n_upto") > rank) & (F.col("__n_upto") - F.col("__n") <= rank)
        return F.max(F.when(here, F.col(value)))

    aggs = []
    for name, q in probs.items():
        pos = F.lit(float(q)) * (F.col("__total") - 1)
        aggs += [
            pick(F.floor(pos)).alias(f"__lo_{name}"),
            pick(F.ceil(pos)).alias(f"__hi_{name}"),
            F.max(pos - F.floor(pos)).alias(f"__w_{name}"),
        ]
    out = run.groupBy(*keys).agg(*aggs)
    return out.select(
        *keys,
        *[
            (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__w_{n}")).alias(n)
            for n in probs
        ],
    )


def rank_auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve per key from mid-ranks; null when only one class is present."""
    counts = df.groupBy(*keys, score).agg(
        F.sum(F.col(label).cast("long")).alias("__pos"), F.sum(1 - F.col(label).cast("long")).alias("__neg"))
    return counts_auc(counts, keys, score)


def counts_auc(counts: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The same from rows of each score's positives `__pos` and negatives `__neg`."""
    run = running_sum(counts, keys, [F.col(score)], ["__neg"])
    wins = F.sum(F.col("__pos") * (F.col("__neg_upto") - F.col("__neg") / 2.0))
    return run.groupBy(*keys).agg(
        F.when(
            (F.sum("__pos") > 0) & (F.sum("__neg") > 0),
            wins / F.nullif(F.sum("__pos") * F.sum("__neg"), F.lit(0)),
        ).alias("auc")
    )
