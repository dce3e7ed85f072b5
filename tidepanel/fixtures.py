"""The prices and markets views every query starts from, for Spark and as SQL for the check.

`events` plays the price history and `customer` joined to its region plays the market table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.operators import panel as P
from tidepanel.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "ts",
        F.col("user_id").alias("market_id"),
        "event_id",
        (F.col("value") / (F.col("value") + 50.0)).alias("p"),
        F.when(F.col("event_type") == "purchase", "trade").otherwise("sampled").alias("source"),
    )


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    day0 = F.lit("2024-01-01").cast("timestamp_ntz")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey")).distinct()
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(events, "c_custkey", "left_semi")
        .select(
            key.alias("market_id"),
            F.col("c_mktsegment").alias("family"),
            F.col("r_name").alias("domain"),
            F.when(F.col("c_acctbal") >= 7000, 1).otherwise(0).alias("y"),
            F.col("c_acctbal").alias("volume"),
            (day0 + F.make_dt_interval((key % 7).cast("int"))).alias("start_ts"),
            (day0 + F.make_dt_interval((key % 7 + 14 + key % 11).cast("int"))).alias("close_ts"),
        )
    )


class Inputs:
    """The tables of one query: the ticks are read once for all that is made of the prices."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def hourly(self) -> DataFrame:
        return hourly(self.spark, self.sf_dir)

    @cached_property
    def markets(self) -> DataFrame:
        return markets(self.spark, self.sf_dir)

    @cached_property
    def panel(self) -> DataFrame:
        return cut_lineage(P.active_ffill(self.hourly, P.active_windows(self.hourly, self.markets)))

    @cached_property
    def supervised(self) -> DataFrame:
        return P.supervised_rows(self.panel, self.markets)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly last prices, written once: every panel reads them several times, the ticks only once."""
    return cut_lineage(P.bucket_last(prices(spark, sf_dir)))


def active_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.active_windows(hourly(spark, sf_dir), markets(spark, sf_dir))


def filled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir)
    return P.active_ffill(h, P.active_windows(h, markets(spark, sf_dir)))


def active_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled prices inside each market's activity window, written once for readers that need them twice."""
    return Inputs(spark, sf_dir).panel


def supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Inputs(spark, sf_dir).supervised


# --- the same views in SQL -------------------------------------------------------------------

_CTES = {
    "prices": """
        SELECT ts, user_id AS market_id, event_id, value / (value + 50.0) AS p,
               CASE WHEN event_type = 'purchase' THEN 'trade' ELSE 'sampled' END AS source
        FROM events""",
    "markets": """
        SELECT c_custkey AS market_id, c_mktsegment AS family, r_name AS domain,
               CASE WHEN c_acctbal >= 7000 THEN 1 ELSE 0 END AS y, c_acctbal AS volume,
               TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 7 AS INTEGER)) AS start_ts,
               TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 7 + 14 + c_custkey % 11 AS INTEGER)) AS close_ts
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE c_custkey IN (SELECT user_id FROM events)""",
    "hourly": """
        SELECT hr AS ts, market_id, p FROM (
          SELECT date_trunc('hour', ts) AS hr, market_id, p,
                 row_number() OVER (PARTITION BY date_trunc('hour', ts), market_id
                                    ORDER BY ts DESC, source DESC, event_id DESC) AS rn
          FROM prices WHERE p IS NOT NULL) WHERE rn = 1""",
    "span": "SELECT min(ts) AS lo, max(ts) AS hi FROM hourly",
    "hours": "SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span",
    "grid": """
        SELECT h.ts, m.market_id, x.p
        FROM hours h CROSS JOIN (SELECT DISTINCT market_id FROM hourly) m
        LEFT JOIN hourly x ON x.ts = h.ts AND x.market_id = m.market_id""",
    "active": """
        SELECT market_id, date_trunc('hour', greatest(first_ts, start_ts)) AS active_start,
               date_trunc('hour', close_ts + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND) AS active_end
        FROM (SELECT market_id, min(ts) AS first_ts FROM hourly GROUP BY 1) JOIN markets USING (market_id)""",
    "filled": """
        SELECT ts, market_id, last_value(p IGNORE NULLS) OVER (PARTITION BY market_id ORDER BY ts
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM grid""",
    "panel": """
        SELECT f.ts, f.market_id, f.p FROM filled f JOIN active a USING (market_id)
        WHERE f.p IS NOT NULL AND f.ts BETWEEN a.active_start AND a.active_end""",
    "sup": """
        SELECT p.ts, p.market_id, greatest(1e-6, least(1 - 1e-6, p.p)) AS p,
               count(*) OVER (PARTITION BY p.ts) AS n_active, m.y, m.domain, m.family, m.volume
        FROM panel p JOIN markets m USING (market_id) WHERE m.y IS NOT NULL""",
    "dense": """
        SELECT ts, market_id, coalesce(p, 0.5) AS p FROM filled""",
}
_NEEDS = {
    "hourly": ["prices"], "span": ["hourly"], "hours": ["span"], "grid": ["hours", "hourly"],
    "active": ["hourly", "markets"], "filled": ["grid"], "panel": ["filled", "active"],
    "sup": ["panel", "markets"], "dense": ["filled"],
}


def add_cte(name: str, sql: str, needs: list[str]) -> None:
    """Let a plan module share a view of its own with the SQL of its queries."""
    _CTES[name] = sql
    _NEEDS[name] = needs


def with_views(names: str, body: str) -> str:
    """`body` preceded by the named views and whatever they read; a body may open with its own views."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({_CTES[name]})" for name in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
