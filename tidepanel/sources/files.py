"""Reading raw payload files and tables, and writing panels and per-fold results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions import scalars as S

# Raw market objects. Fields that hold JSON or a native array are read as text and parsed later.
RAW_MARKET_SCHEMA = """
    id string, conditionId string, question string, title string, category string, outcomes string,
    outcomePrices string, clobTokenIds string, startDate string, endDate string, closedTime string,
    active boolean, closed boolean, archived boolean, volume string, volumeNum string, liquidity string,
    liquidityNum string, umaResolutionStatus string, umaResolutionStatuses string, resolvedBy string,
    resolutionSource string, slug string, description string, enableOrderBook boolean, volumeClob string,
    events array<struct<id string, category string, tags array<struct<label string, slug string>>>>,
    tags array<struct<label string, slug string>>
"""
RAW_TRADE_SCHEMA = """
    market_id string, condition_id string,
    payload array<struct<price string, timestamp bigint, asset string, outcome string, side string,
                         size double, transactionHash string>>
"""
RAW_HISTORY_SCHEMA = "market_id string, token_id string, payload string"
# Files at most per month or fold of a sink, whatever the number of tasks before it.
FILES = 16
POINT = "array<struct<t bigint, timestamp bigint, p double, price double>>"


def scan_parquet(spark: SparkSession, path: str, ids: list[str] | None = None, dates: list[str] | None = None) -> DataFrame:
    """A table with its id columns as text and its date columns parsed where they can be."""
    df = spark.read.parquet(path)
    casts = {c: F.col(c).cast("string") for c in ids or []}
    casts |= {c: S.tolerant_timestamp(F.col(c).cast("string")) for c in dates or []}
    return df.withColumns(casts) if casts else df


def scan_raw_markets(spark: SparkSession, path: str, array_per_line: bool = False) -> DataFrame:
    """Market objects from files that hold one JSON array each, on any number of lines.

    Files with an array per line can be split between tasks: `array_per_line`. Text that is not such JSON fails the job.
    """
    return spark.read.schema(RAW_MARKET_SCHEMA).json(path, multiLine=not array_per_line, mode="FAILFAST")


def scan_raw_trades(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(RAW_TRADE_SCHEMA).json(path)
    return rows.select("market_id", "condition_id", F.explode("payload").alias("t")).select("market_id", "condition_id", "t.*")


def scan_raw_history(spark: SparkSession, path: str) -> DataFrame:
    """History points; the payload is an object with `history` or the bare list."""
    rows = spark.read.schema(RAW_HISTORY_SCHEMA).json(path)
    listed = F.from_json("payload", POINT)
    held = F.from_json("payload", f"struct<history: {POINT}>")["history"]
    points = F.when(F.trim("payload").startswith("["), listed).otherwise(held)
    return rows.select("market_id", "token_id", F.explode(points).alias("h")).select("market_id", "token_id", "h.*")


def normalize_markets(raw: DataFrame, binary_only: bool = True) -> DataFrame:
    """The fixed market table: parsed arrays, YES token and price, outcome, tags, volumes and flags."""
    parsed = raw.withColumns({
        "outcomes": S.parse_jsonish("outcomes"),
        "price_text": S.parse_jsonish("outcomePrices"),
        "token_ids": S.parse_jsonish("clobTokenIds"),
    }).withColumn("outcome_prices", F.transform("price_text", S.safe_float))
    rows = parsed.select(
        F.col("id").alias("market_id"),
        F.col("conditionId").alias("condition_id"),
        S.first_event_id("events").alias("event_id"),
        F.coalesce(F.nullif("question", F.lit("")), F.col("title")).alias("question"),
        S.first_category("category", "events").alias("category"),
        S.collect_tags("tags", "events").alias("tags"),
        "outcomes",
        "outcome_prices",
        F.col("token_ids").alias("clob_token_ids"),
        S.at_yes("token_ids", "outcomes").alias("yes_token_id"),
        S.at_yes("outcome_prices", "outcomes").alias("yes_price_current"),
        F.col("startDate").alias("start_date"),
        F.col("endDate").alias("end_date"),
        F.col("closedTime").alias("close_date"),
        "active", "closed", "archived",
        S.resolved_outcome("outcomes", "outcome_prices").alias("resolved_outcome"),
        S.first_nonzero(S.safe_float("volumeNum"), S.safe_float("volume")).alias("volume"),
        S.first_nonzero(S.safe_float("liquidityNum"), S.safe_float("liquidity")).alias("liquidity"),
        S.safe_float("volumeClob").alias("volume_clob"),
        F.col("umaResolutionStatus").alias("uma_resolution_status"),
        S.parse_jsonish("umaResolutionStatuses").alias("uma_resolution_statuses"),
        F.col("resolvedBy").alias("resolved_by"),
        F.col("resolutionSource").alias("resolution_source"),
        F.col("enableOrderBook").alias("enable_order_book"),
        "slug", "description",
        S.is_binary_yes_no("outcomes").alias("is_binary"),
        S.at_yes("token_ids", "outcomes").isNotNull().alias("has_yes_token"),
    )
    if binary_only:
        rows = rows.where("is_binary AND has_yes_token")
    return rows.orderBy(F.desc_nulls_last("volume_clob"), F.desc_nulls_last("volume"))


MARKET_ATTRIBUTES = ["category", "event_id", "resolved_outcome", "market_family", "asset", "is_core", "is_satellite"]


def _attributes(markets: DataFrame) -> DataFrame:
    have = [c for c in MARKET_ATTRIBUTES if c in markets.columns]
    return markets.select("market_id", "yes_token_id", F.try_element_at("clob_token_ids", F.lit(2)).alias("no_token_id"), *have)


def explode_trades(trades: DataFrame, markets: DataFrame, source: str = "data_api_trades") -> DataFrame:
    """Trades as YES prices with the market's attributes; rows without time or price are dropped."""
    priced = trades.join(_attributes(markets), "market_id").select(
        S.epoch_to_ts("timestamp").alias("timestamp"), "market_id", F.col("yes_token_id").alias("token_id"),
        S.trade_to_yes_price("price", "asset", "outcome", "yes_token_id", "no_token_id").alias("yes_price"),
        *[c for c in MARKET_ATTRIBUTES if c in markets.columns and c != "asset"],
        F.lit(source).alias("source"), F.col("asset").alias("trade_asset"), F.col("outcome").alias("trade_outcome"),
        F.col("side").alias("trade_side"), F.col("size").alias("trade_size"),
        F.col("transactionHash").alias("transaction_hash"),
    )
    return priced.where("timestamp IS NOT NULL AND yes_price IS NOT NULL")


def explode_history(points: DataFrame, markets: DataFrame, source: str = "clob_prices_history", legacy: bool = False) -> DataFrame:
    """History points as YES prices; `legacy` also treats a zero time or price as missing."""
    t, p = F.col("t"), F.col("p")
    if legacy:
        t, p = F.nullif(t, F.lit(0).cast("bigint")), F.nullif(p, F.lit(0.0))
    rows = points.join(_attributes(markets).drop("yes_token_id", "no_token_id"), "market_id").select(
        S.epoch_to_ts(F.coalesce(t, F.col("timestamp"))).alias("timestamp"), "market_id", "token_id",
        F.coalesce(p, F.col("price")).alias("yes_price"),
        *[c for c in MARKET_ATTRIBUTES if c in markets.columns], F.lit(source).alias("source"),
    )
    return rows.where("timestamp IS NOT NULL AND yes_price IS NOT NULL")


def active_bounds(markets: DataFrame, close: str = "close_ts", end: str | None = None) -> DataFrame:
    """Start and close (else end) of each market, null where missing or reversed."""
    stop = F.coalesce(F.col(close), F.col(end)) if end else F.col(close)
    good = F.col("start_ts").isNotNull() & stop.isNotNull() & (stop > F.col("start_ts"))
    return markets.select(
        "market_id", F.when(good, F.col("start_ts")).alias("bound_start"), F.when(good, stop).alias("bound_stop"))


def chunk_time_range(bounds: DataFrame, days: int) -> DataFrame:
    """[start, stop) in pieces of at most `days` days, the last one short."""
    step = F.expr(f"interval {int(days)} day")
    starts = bounds.where("bound_start < bound_stop").select(
        "market_id", "bound_stop", F.explode(F.sequence("bound_start", "bound_stop", step)).alias("chunk_start"))
    return starts.where("chunk_start < bound_stop").select(
        "market_id", "chunk_start", F.least(F.col("chunk_start") + step, F.col("bound_stop")).alias("chunk_stop"))


# --- sinks -----------------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)


def write_panel(cells: DataFrame, stats: DataFrame, path: str) -> DataFrame:
    """The panel as Parquet by month beside its one-row description, which is returned."""
    cells.withColumn("month", F.date_format("ts", "yyyy-MM")).repartition("month", F.pmod(F.xxhash64("market_id"), F.lit(FILES))).write.mode(
        "overwrite").partitionBy("month").parquet(f"{path}/panel")
    stats.write.mode("overwrite").json(f"{path}/metadata")
    return cells.sparkSession.read.schema(stats.schema).json(f"{path}/metadata")


def write_folds(rows: DataFrame, path: str, skip_existing: bool = True) -> DataFrame:
    """Write each fold to its own partition, leaving folds that are already there; returns all folds."""
    spark = rows.sparkSession
    if skip_existing:
        try:
            done = spark.read.parquet(path).select("fold").distinct()
            rows = rows.join(done, "fold", "left_anti")
        except Exception as exc:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
                raise
    dealt = rows.repartition("fold", F.pmod(F.xxhash64(*rows.columns), F.lit(FILES)))
    dealt.write.mode("overwrite" if not skip_existing else "append").partitionBy("fold").parquet(path)
    return spark.read.parquet(path)
