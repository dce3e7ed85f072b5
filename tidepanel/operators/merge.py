"""Aligning, merging and de-duplicating price sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The long price table and the tags of its two sources, in priority order.
PRICE_COLUMNS = {
    "timestamp": "timestamp_ntz", "market_id": "string", "token_id": "string", "yes_price": "double",
    "category": "string", "event_id": "string", "resolved_outcome": "string", "market_family": "string",
    "asset": "string", "is_core": "boolean", "is_satellite": "boolean", "source": "string",
    "trade_asset": "string", "trade_outcome": "string", "trade_side": "string", "trade_size": "double",
    "transaction_hash": "string",
}
SOURCE_PRIORITY = ("data_api_trades", "clob_prices_history")


def align_source(df: DataFrame | None, source: str, spark: SparkSession | None = None) -> DataFrame:
    """A source in the 17-column layout; an absent source is empty, an absent column null."""
    if df is None:
        fields = [T.StructField(c, T._parse_datatype_string(t)) for c, t in PRICE_COLUMNS.items()]
        return spark.createDataFrame([], T.StructType(fields))
    if "source" not in df.columns:
        df = df.withColumn("source", F.lit(source))
    return df.select(*[
        (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in PRICE_COLUMNS.items()
    ])


def keep_last(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last row per key in the given order. An aggregate, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(None)
    out = df.groupBy(*keys).agg(row.alias("__row"))
    return out.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def in_bounds(df: DataFrame, price: str = "p") -> DataFrame:
    return df.where(F.col(price).between(0.0, 1.0))


def merge_sources(parts: list[DataFrame], keys: list[str], price: str, tiebreak: list[str], priority=SOURCE_PRIORITY) -> DataFrame:
    """Union, bounds filter, then the last row per key by source priority and the tie-break."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rank = F.coalesce(*[F.when(F.col("source") == s, i) for i, s in enumerate(priority)], F.lit(len(priority)))
    ranked = in_bounds(both, price).withColumn("__priority", rank)
    return keep_last(ranked, keys, ["__priority", *tiebreak]).drop("__priority")


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key, over the keys the table has; nulls count as equal."""
    present = [k for k in keys if k in df.columns]
    sizes = df.groupBy(*present).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def union_models(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
