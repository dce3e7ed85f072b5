"""Queries for merging, panels and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import fixtures as X
from tidepanel.operators import joins as J
from tidepanel.operators import merge as M
from tidepanel.operators import panel as P
from tidepanel.operators import series as S
from tidepanel.plans.registry import query, r6
from tidepanel.session import cut_lineage

CORE = ["HOUSEHOLD", "MACHINERY", "FURNITURE"]
SATELLITE = ["BUILDING", "AUTOMOBILE"]
CORE_SQL = "('HOUSEHOLD', 'MACHINERY', 'FURNITURE')"
MIN_ACTIVE, MIN_MARKETS, MAX_MISSING = 5, 5, 0.35


# --- merge -----------------------------------------------------------------------------------

# Two overlapping copies of the price history, so that every rule has something to remove.
X.add_cte("copies", """
    SELECT *, 0 AS copy FROM prices
    UNION ALL SELECT ts, market_id, event_id, p, source, 1 FROM prices WHERE event_id % 3 = 0""", ["prices"])


def copies(spark, d):
    p = X.prices(spark, d)
    return p.withColumn("copy", F.lit(0)).unionByName(p.where("event_id % 3 = 0").withColumn("copy", F.lit(1)))


@query("dedupe_trades", X.with_views("copies", """
    SELECT ts, market_id, p, source, event_id, copy FROM (SELECT *, row_number() OVER (
      PARTITION BY event_id, market_id, ts, source, p ORDER BY copy DESC) AS rn FROM copies)
    WHERE rn = 1 AND p BETWEEN 0 AND 1"""))
def dedupe_trades(spark, d):
    return M.keep_last(M.in_bounds(copies(spark, d)), ["event_id", "market_id", "ts", "source", "p"], ["copy"])


@query("dedupe_history", X.with_views("copies", """
    SELECT ts, market_id, p, max(copy) AS copy FROM copies WHERE p BETWEEN 0 AND 1 GROUP BY 1, 2, 3"""))
def dedupe_history(spark, d):
    rows = M.in_bounds(copies(spark, d)).select("ts", "market_id", "p", "copy")
    return M.keep_last(rows, ["market_id", "ts", "p"], ["copy"])


@query("merge_sources", X.with_views("copies", """
    SELECT ts, market_id, p, source, event_id, copy FROM (SELECT *, row_number() OVER (
      PARTITION BY market_id, ts, source, event_id
      ORDER BY CASE source WHEN 'trade' THEN 0 WHEN 'sampled' THEN 1 ELSE 2 END DESC, copy DESC) AS rn
      FROM copies WHERE p BETWEEN 0 AND 1) WHERE rn = 1"""))
def merge_sources(spark, d):
    both = copies(spark, d)
    parts = [both.where("copy = 0"), both.where("copy = 1")]
    return M.merge_sources(parts, ["market_id", "ts", "source", "event_id"], "p", ["copy"], ("trade", "sampled"))


@query("duplicate_count", X.with_views("copies", """
    SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (
      SELECT count(*) AS n FROM copies GROUP BY event_id, market_id, ts, p)"""))
def duplicate_count(spark, d):
    return M.duplicate_count(copies(spark, d), ["transaction_hash", "event_id", "market_id", "ts", "p"])


@query("union_models", X.with_views("prices", """
    SELECT 'market' AS model, market_id, count(*) AS n, NULL AS mean_p FROM prices WHERE source = 'trade' GROUP BY 2
    UNION ALL SELECT 'sampled', market_id, NULL, round(avg(p), 6) FROM prices WHERE source = 'sampled' GROUP BY 2"""))
def union_models(spark, d):
    p = X.prices(spark, d)
    a = p.where("source = 'trade'").groupBy("market_id").agg(F.count("*").alias("n")).withColumn("model", F.lit("market"))
    b = p.where("source = 'sampled'").groupBy("market_id").agg(r6(F.avg("p"), "mean_p")).withColumn("model", F.lit("sampled"))
    return M.union_models([a, b])


@query("drop_duplicate_markets", X.with_views("sup", """
    SELECT count(*) AS markets, round(avg(y), 6) AS yes_rate FROM (SELECT DISTINCT market_id, y FROM sup)"""))
def drop_duplicate_markets(spark, d):
    one = X.supervised(spark, d).select("market_id", "y").dropDuplicates(["market_id"])
    return one.agg(F.count("*").alias("markets"), r6(F.avg("y"), "yes_rate"))


# --- panel construction ----------------------------------------------------------------------


@query("bucket_last", X.with_views("hourly", "SELECT ts, market_id, round(p, 6) AS p FROM hourly"))
def bucket_last(spark, d):
    return P.bucket_last(X.prices(spark, d)).select("ts", "market_id", r6("p"))


PIVOTED = 8


@query("pivot_panel", X.with_views("hourly", f"""
    WITH places AS (SELECT market_id, row_number() OVER (ORDER BY md5(CAST(market_id AS VARCHAR)), market_id) - 1 AS place FROM (SELECT DISTINCT market_id FROM hourly))
    SELECT place // {PIVOTED} AS block, ts, """ + ", ".join(
    f"round(max(CASE WHEN place % {PIVOTED} = {i} THEN p END), 6) AS m{i + 1}" for i in range(PIVOTED)) + " FROM hourly JOIN places USING (market_id) GROUP BY 1, 2"))
def pivot_panel(spark, d):
    """Wide form of all markets, eight columns to a block."""
    h = X.hourly(spark, d)
    wide = P.pivot_blocks(h, P.market_places(h, PIVOTED), PIVOTED)
    return wide.select("block", "ts", *[r6(F.col("values")[i], f"m{i + 1}") for i in range(PIVOTED)])


X.add_cte("places", f"""
    SELECT market_id, (rn // {P.PIVOT_WIDTH})::BIGINT AS block, (rn % {P.PIVOT_WIDTH})::INTEGER AS place FROM (
      SELECT market_id, row_number() OVER (ORDER BY md5(market_id::VARCHAR), market_id) - 1 AS rn FROM (SELECT DISTINCT market_id FROM hourly))""", ["hourly"])


@query("pivot_panel_places", X.with_views("places", "SELECT * FROM places"))
def pivot_panel_places(spark, d):
    return P.market_places(X.hourly(spark, d))


@query("pivot_panel_blocks", X.with_views("hourly places", f"""
    SELECT block, ts, list(round(p, 6) ORDER BY place) AS values FROM (
      SELECT w.block, w.ts, s.place, h.p FROM (SELECT DISTINCT block, ts FROM hourly JOIN places USING (market_id)) w
        CROSS JOIN (SELECT unnest(range({P.PIVOT_WIDTH})) AS place) s LEFT JOIN places m ON m.block = w.block AND m.place = s.place
        LEFT JOIN hourly h ON h.market_id = m.market_id AND h.ts = w.ts) GROUP BY 1, 2"""))
def pivot_panel_blocks(spark, d):
    """The wide form of all markets; pivot_panel is the view of eight named ones."""
    h = X.hourly(spark, d)
    return P.pivot_blocks(h, P.market_places(h)).select("block", "ts", F.transform("values", lambda v: F.round(v, 6)).alias("values"))


@query("continuous_grid", X.with_views("grid", "SELECT ts, market_id, round(p, 6) AS p FROM grid"))
def continuous_grid(spark, d):
    return P.continuous_grid(X.hourly(spark, d)).select("ts", "market_id", r6("p"))


@query("active_window_build", X.with_views("active", "SELECT * FROM active"))
def active_window_build(spark, d):
    return X.active_windows(spark, d)


@query("active_ffill", X.with_views("panel", "SELECT ts, market_id, round(p, 6) AS p FROM panel"))
def active_ffill(spark, d):
    return X.filled_panel(spark, d).select("ts", "market_id", r6("p"))


@query("active_ffill_limit", X.with_views("grid active", """
    WITH lim AS (SELECT ts, market_id, last_value(p IGNORE NULLS) OVER (PARTITION BY market_id ORDER BY ts
      ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS p FROM grid)
    SELECT lim.ts, lim.market_id, round(lim.p, 6) AS p FROM lim JOIN active a USING (market_id)
    WHERE lim.p IS NOT NULL AND lim.ts BETWEEN a.active_start AND a.active_end"""))
def active_ffill_limit(spark, d):
    h = X.hourly(spark, d)
    return P.active_ffill(h, P.active_windows(h, X.markets(spark, d)), limit=6).select("ts", "market_id", r6("p"))


@query("backfill_fill", X.with_views("filled", """
    SELECT ts, market_id, round(coalesce(p, first_value(p IGNORE NULLS) OVER (PARTITION BY market_id ORDER BY ts
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.5), 6) AS p FROM filled"""))
def backfill_fill(spark, d):
    return P.dense_fill(X.hourly(spark, d), bfill=True).select("ts", "market_id", r6("p"))


@query("dense_fill", X.with_views("dense", "SELECT ts, market_id, round(p, 6) AS p FROM dense"))
def dense_fill(spark, d):
    return P.dense_fill(X.hourly(spark, d)).select("ts", "market_id", r6("p"))


STATS = """
    SELECT count(*) AS timestamp_count, CAST((SELECT count(DISTINCT market_id) FROM hourly) AS BIGINT) AS market_count,
           min(ts) AS timestamp_min, max(ts) AS timestamp_max,
           CAST(min(n) AS BIGINT) AS active_market_min, CAST(median(n) AS DOUBLE) AS active_market_median,
           CAST(max(n) AS BIGINT) AS active_market_max,
           round(1 - sum(n) / (count(*) * (SELECT count(DISTINCT market_id) FROM hourly)), 6) AS missingness
    FROM (SELECT h.ts, count(p.p) AS n FROM hours h LEFT JOIN panel p ON p.ts = h.ts GROUP BY h.ts)"""


@query("panel_stats", X.with_views("hours panel", STATS))
def panel_stats(spark, d):
    h = X.hourly(spark, d)
    cells = P.active_ffill(h, P.active_windows(h, X.markets(spark, d)))
    return P.panel_stats(cells, P.hour_index(h), h).withColumn("missingness", r6("missingness"))


STRICT = f"""
    core AS (SELECT p.* FROM panel p JOIN markets m USING (market_id) WHERE m.family IN {CORE_SQL}),
    core_cols AS (SELECT DISTINCT market_id FROM hourly JOIN markets m USING (market_id) WHERE m.family IN {CORE_SQL}),
    busy AS (SELECT * FROM core WHERE ts IN (SELECT ts FROM core GROUP BY ts HAVING count(*) >= {MIN_ACTIVE})),
    ranked AS (SELECT c.market_id, row_number() OVER (ORDER BY count(b.p) DESC, c.market_id) AS rank
               FROM core_cols c LEFT JOIN busy b USING (market_id) GROUP BY c.market_id),
    placed AS (SELECT b.*, r.rank FROM busy b JOIN ranked r USING (market_id)),
    per_row AS (SELECT m.rank AS m, p.ts, count(*) AS n FROM ranked m JOIN placed p ON p.rank <= m.rank
                WHERE m.rank >= {MIN_MARKETS} GROUP BY 1, 2 HAVING count(*) >= {MIN_ACTIVE}),
    passing AS (SELECT m FROM per_row GROUP BY m
                HAVING 1 - sum(n) / (count(*) * m) <= {MAX_MISSING} AND median(n) >= {MIN_ACTIVE}),
    best AS (SELECT max(m) AS m FROM passing),
    strict AS (SELECT p.ts, p.market_id, p.p FROM placed p, best
               WHERE p.rank <= coalesce(best.m, {MIN_MARKETS})
                 AND (best.m IS NULL OR p.ts IN (SELECT ts FROM per_row, best b WHERE per_row.m = b.m)))"""


def strict_core(spark, d):
    h, m = X.hourly(spark, d), X.markets(spark, d)
    core = m.where(F.col("family").isin(CORE)).select("market_id")
    cells = J.semi(P.active_ffill(h, P.active_windows(h, m)), core, "market_id")
    return P.strict_panel(cells, J.semi(h, core, "market_id"), MIN_ACTIVE, MIN_MARKETS, MAX_MISSING)


@query("strict_panel", X.with_views("panel markets", f"WITH {STRICT} SELECT ts, market_id, round(p, 6) AS p FROM strict"))
def strict_panel(spark, d):
    return strict_core(spark, d).select("ts", "market_id", r6("p"))


OPTIONAL = f"""{STRICT},
    base AS (SELECT count(*) AS cells, count(DISTINCT ts) AS rows, count(DISTINCT market_id) AS cols FROM strict),
    opt_cols AS (SELECT DISTINCT market_id FROM hourly JOIN markets m USING (market_id) WHERE m.family NOT IN {CORE_SQL}),
    opt AS (SELECT p.* FROM panel p WHERE market_id IN (SELECT market_id FROM opt_cols)
            AND ts IN (SELECT ts FROM strict)),
    opt_rank AS (SELECT c.market_id, count(o.p) AS n, row_number() OVER (ORDER BY count(o.p) DESC, c.market_id) AS rank
                 FROM opt_cols c LEFT JOIN opt o USING (market_id) GROUP BY c.market_id),
    run AS (SELECT market_id, rank, sum(n) OVER (ORDER BY rank) AS upto FROM opt_rank),
    fails AS (SELECT min(rank) AS first FROM run, base WHERE 1 - (cells + upto) / (rows * (cols + rank)) > {MAX_MISSING}),
    plus AS (SELECT ts, market_id, p FROM strict UNION ALL
             SELECT ts, market_id, p FROM opt WHERE market_id IN
               (SELECT market_id FROM run, fails WHERE first IS NULL OR rank < first))"""


def core_plus(spark, d, base=None):
    h, m = X.hourly(spark, d), X.markets(spark, d)
    base = cut_lineage(strict_core(spark, d) if base is None else base)
    extra = m.where(~F.col("family").isin(CORE)).select("market_id")
    cells = J.semi(P.active_ffill(h, P.active_windows(h, m)), extra, "market_id")
    return P.add_optional_columns(base, cells, J.semi(h, extra, "market_id"), MAX_MISSING)


@query("add_optional_columns", X.with_views("panel markets", f"WITH {OPTIONAL} SELECT ts, market_id, round(p, 6) AS p FROM plus"))
def add_optional_columns(spark, d):
    return core_plus(spark, d).select("ts", "market_id", r6("p"))


def _stats_sql(name, cells, index, cols):
    return f"""SELECT '{name}' AS panel, count(*) AS timestamp_count, CAST(({cols}) AS BIGINT) AS market_count,
      min(ts) AS timestamp_min, max(ts) AS timestamp_max, CAST(min(n) AS BIGINT) AS active_market_min,
      CAST(median(n) AS DOUBLE) AS active_market_median, CAST(max(n) AS BIGINT) AS active_market_max,
      round(1 - sum(n) / (count(*) * ({cols})), 6) AS missingness
      FROM (SELECT i.ts, count(c.p) AS n FROM {index} i LEFT JOIN {cells} c ON c.ts = i.ts GROUP BY i.ts)"""


@query("build_panels", X.with_views("hours panel markets", f"""WITH {OPTIONAL},
    strict_ts AS (SELECT DISTINCT ts FROM strict), plus_ts AS (SELECT DISTINCT ts FROM plus)
    {_stats_sql('raw', 'hourly', 'hours', 'SELECT count(DISTINCT market_id) FROM hourly')} UNION ALL
    {_stats_sql('active_ffill', 'panel', 'hours', 'SELECT count(DISTINCT market_id) FROM hourly')} UNION ALL
    {_stats_sql('core', 'strict', 'strict_ts', 'SELECT count(DISTINCT market_id) FROM strict')} UNION ALL
    {_stats_sql('core_plus_satellites', 'plus', 'plus_ts', 'SELECT count(DISTINCT market_id) FROM plus')}"""))
def build_panels(spark, d):
    h, m = X.hourly(spark, d), X.markets(spark, d)
    index = P.hour_index(h)
    filled = P.active_ffill(h, P.active_windows(h, m))
    strict = cut_lineage(strict_core(spark, d))
    plus = cut_lineage(core_plus(spark, d, strict))
    parts = {
        "raw": (h, index, h), "active_ffill": (filled, index, h),
        "core": (strict, strict.select("ts").distinct(), strict),
        "core_plus_satellites": (plus, plus.select("ts").distinct(), plus),
    }
    rows = [P.panel_stats(*v).withColumn("panel", F.lit(k)) for k, v in parts.items()]
    return M.union_models(rows).withColumn("missingness", r6("missingness"))


X.add_cte("overlap", """
    SELECT * FROM (SELECT p.* FROM panel p WHERE ts IN (SELECT ts FROM panel GROUP BY ts HAVING count(*) >=
      (SELECT greatest(5, least(20, floor(count(DISTINCT market_id) * 0.25))) FROM hourly)))
    WHERE market_id IN (SELECT market_id FROM panel WHERE ts IN (SELECT ts FROM panel GROUP BY ts HAVING count(*) >=
      (SELECT greatest(5, least(20, floor(count(DISTINCT market_id) * 0.25))) FROM hourly))
      GROUP BY market_id HAVING count(*) / (SELECT count(*) FROM (SELECT ts FROM panel GROUP BY ts HAVING count(*) >=
      (SELECT greatest(5, least(20, floor(count(DISTINCT market_id) * 0.25))) FROM hourly))) >= 0.05)""",
    ["panel", "hourly"])


@query("overlap_panel", X.with_views("overlap", "SELECT ts, market_id, round(p, 6) AS p FROM overlap"))
def overlap_panel(spark, d):
    return P.overlap_panel((x := X.Inputs(spark, d)).panel, x.hourly).select("ts", "market_id", r6("p"))


X.add_cte("lifetimes", """
    SELECT market_id, family, domain, y, volume, least(start_ts, first_ts) AS active_start,
           greatest(close_ts, last_ts) AS active_end,
           epoch(greatest(close_ts, last_ts) - least(start_ts, first_ts)) / 3600 AS active_duration_hours,
           epoch(last_ts - first_ts) / 3600 AS observed_duration_hours, observed_hours
    FROM (SELECT market_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS observed_hours FROM hourly GROUP BY 1)
    JOIN markets USING (market_id)""", ["hourly", "markets"])
X.add_cte("lifemask", """
    SELECT h.ts, l.market_id FROM hours h JOIN lifetimes l
      ON h.ts BETWEEN date_trunc('hour', l.active_start)
         AND date_trunc('hour', l.active_end + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND)""", ["hours", "lifetimes"])


@query("market_lifetimes", X.with_views("lifetimes", """
    SELECT market_id, active_start, active_end, round(active_duration_hours, 6) AS active_duration_hours,
           round(observed_duration_hours, 6) AS observed_duration_hours, observed_hours FROM lifetimes"""))
def market_lifetimes(spark, d):
    return P.market_lifetimes(X.hourly(spark, d), X.markets(spark, d)).select(
        "market_id", "active_start", "active_end", r6("active_duration_hours"), r6("observed_duration_hours"),
        "observed_hours")


@query("lifetime_mask", X.with_views("lifemask", "SELECT ts, market_id FROM lifemask"))
def lifetime_mask(spark, d):
    h = X.hourly(spark, d)
    return P.lifetime_mask(P.market_lifetimes(h, X.markets(spark, d)), P.hour_index(h))


def _stress_sql():
    parts = []
    for m in (60, 70, 75):
        for name, lim in (("6h", 6), ("24h", 24), ("active_unlimited", None)):
            frame = f"{lim} PRECEDING" if lim else "UNBOUNDED PRECEDING"
            parts.append(f"""
    SELECT {m} AS min_points, '{name}' AS fill_limit, g.panel, count(*) AS timestamp_count,
      max(g.cols) AS market_count, CAST(min(c.n) AS BIGINT) AS active_market_min,
      CAST(median(c.n) AS DOUBLE) AS active_market_median, CAST(max(c.n) AS BIGINT) AS active_market_max,
      round(1 - sum(c.n) / (count(*) * max(g.cols)), 6) AS missingness
    FROM (SELECT gr.panel, i.ts, count(f.p) AS n FROM groups gr CROSS JOIN
            (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM kept{m}) i
          LEFT JOIN (SELECT x.ts, x.p, gm.panel FROM (
              SELECT ts, market_id, last_value(p IGNORE NULLS) OVER (PARTITION BY market_id ORDER BY ts
                ROWS BETWEEN {frame} AND CURRENT ROW) AS p
              FROM grid WHERE market_id IN (SELECT market_id FROM kept{m})
                AND ts BETWEEN (SELECT min(ts) FROM kept{m}) AND (SELECT max(ts) FROM kept{m})) x
            JOIN active a USING (market_id) JOIN members gm USING (market_id)
            WHERE x.p IS NOT NULL AND x.ts BETWEEN a.active_start AND a.active_end) f
            ON f.ts = i.ts AND f.panel = gr.panel GROUP BY 1, 2) c
    JOIN (SELECT panel, count(DISTINCT market_id) AS cols FROM members
          WHERE market_id IN (SELECT market_id FROM kept{m}) GROUP BY 1) g USING (panel)
    GROUP BY g.panel""")
    kept = ", ".join(f"""kept{m} AS (SELECT * FROM hourly WHERE market_id IN
        (SELECT market_id FROM prices GROUP BY 1 HAVING count(*) >= {m}))""" for m in (60, 70, 75))
    return f"""WITH groups AS (SELECT unnest(['core', 'core_plus_satellites']) AS panel),
        members AS (SELECT g.panel, m.market_id FROM groups g, markets m
                    WHERE m.family IN {CORE_SQL} OR (g.panel <> 'core' AND m.family IN ('BUILDING', 'AUTOMOBILE'))),
        {kept} """ + " UNION ALL ".join(parts)


@query("stress_grid", X.with_views("grid active", _stress_sql()))
def stress_grid(spark, d):
    return P.stress_grid(
        X.prices(spark, d), X.markets(spark, d), [60, 70, 75], {"6h": 6, "24h": 24, "active_unlimited": None},
        {"core": CORE, "core_plus_satellites": CORE + SATELLITE},
    ).withColumn("missingness", r6("missingness"))


@query("supervised_rows_active", X.with_views("sup", """
    SELECT ts, market_id, round(p, 6) AS p, n_active, y, domain, family, round(volume, 6) AS volume FROM sup"""))
def supervised_rows_active(spark, d):
    return X.supervised(spark, d).withColumns({"p": r6("p"), "volume": r6("volume")})


@query("family_state", X.with_views("panel markets", """
    SELECT p.ts, m.family, round(avg(p), 6) AS mean, round(median(p), 6) AS median,
           round(coalesce(stddev_pop(p), 0), 6) AS std, count(*) AS n
    FROM panel p JOIN markets m USING (market_id) GROUP BY 1, 2"""))
def family_state(spark, d):
    s = P.family_state(X.active_panel(spark, d), X.markets(spark, d))
    return s.select("ts", "family", r6("mean"), r6("median"), r6("std"), "n")


@query("timestamp_metadata", X.with_views("panel markets", """
    SELECT p.ts, count(*) AS active_market_count, count(DISTINCT m.family) AS active_family_count,
           round(avg(p), 6) AS average_market_probability
    FROM panel p LEFT JOIN markets m USING (market_id) GROUP BY 1"""))
def timestamp_metadata(spark, d):
    t = P.timestamp_metadata(X.active_panel(spark, d), X.markets(spark, d))
    return t.withColumn("average_market_probability", r6("average_market_probability"))


@query("future_targets", X.with_views("sup panel", """
    SELECT ts, market_id, round(f24, 6) AS future_price_24h, round(f72, 6) AS future_price_72h,
      round(abs(f24 - p), 6) AS abs_move_24h, CAST(abs(f24 - p) >= 0.10 AS INTEGER) AS large_move_24h,
      round(abs(f72 - p), 6) AS abs_move_72h, CAST(abs(f72 - p) >= 0.10 AS INTEGER) AS large_move_72h,
      round(abs(p - y), 6) AS abs_error, round((p - y) * (p - y), 6) AS squared_error,
      CAST(abs(p - y) >= 0.25 AS INTEGER) AS miscalibrated
    FROM (SELECT s.*, a.p AS f24, b.p AS f72 FROM sup s
      LEFT JOIN panel a ON a.market_id = s.market_id AND a.ts = s.ts + INTERVAL 24 HOUR
      LEFT JOIN panel b ON b.market_id = s.market_id AND b.ts = s.ts + INTERVAL 72 HOUR)"""))
def future_targets(spark, d):
    out = P.future_targets((x := X.Inputs(spark, d)).supervised, x.panel)
    return out.select(
        "ts", "market_id", r6("future_price_24h"), r6("future_price_72h"), r6("abs_move_24h"), "large_move_24h",
        r6("abs_move_72h"), "large_move_72h", r6("abs_error"), r6("squared_error"), "miscalibrated")


@query("sliding_windows", X.with_views("panel hours span", """
    SELECT e.ts AS window_end, count(*) AS cells, count(DISTINCT p.ts) AS filled_hours, round(avg(p.p), 6) AS mean_p
    FROM hours e JOIN span ON e.ts >= lo + INTERVAL 23 HOUR
    JOIN panel p ON p.ts > e.ts - INTERVAL 24 HOUR AND p.ts <= e.ts WHERE hour(e.ts) % 8 = 0 GROUP BY 1"""))
def sliding_windows(spark, d):
    h = X.hourly(spark, d)
    cells = P.active_ffill(h, P.active_windows(h, X.markets(spark, d)))
    inside = P.window_members(cells, 24, 8, P.window_ends(P.hour_index(h), 24, 8))
    return inside.groupBy("window_end").agg(
        F.count("*").alias("cells"), F.countDistinct("ts").alias("filled_hours"), r6(F.avg("p"), "mean_p"))


@query("first_nonnull_by_key", X.with_views("prices", """
    SELECT market_id, date_trunc('day', ts) AS day,
      round(max(CASE WHEN source = 'trade' THEN p END), 6) AS trade_p,
      round(max(CASE WHEN source = 'sampled' THEN p END), 6) AS sampled_p
    FROM (SELECT *, row_number() OVER (PARTITION BY market_id, date_trunc('day', ts), source ORDER BY ts, event_id) AS rn
          FROM prices) WHERE rn = 1 GROUP BY 1, 2"""))
def first_nonnull_by_key(spark, d):
    at = F.struct("ts", "event_id")
    first = lambda s: F.min_by("p", F.when(F.col("source") == s, at))
    return X.prices(spark, d).groupBy("market_id", P.floor_to("ts", "day").alias("day")).agg(
        r6(first("trade"), "trade_p"), r6(first("sampled"), "sampled_p"))


# --- joins -----------------------------------------------------------------------------------


@query("join_meta_left", X.with_views("hourly markets", """
    SELECT h.ts, h.market_id, round(h.p, 6) AS p, m.family, m.y FROM hourly h
    LEFT JOIN (SELECT * FROM markets WHERE volume > 0) m USING (market_id)"""))
def join_meta_left(spark, d):
    meta = X.markets(spark, d).where("volume > 0").select("market_id", "family", "y")
    return J.attach(X.hourly(spark, d), meta, "market_id").select("ts", "market_id", r6("p"), "family", "y")


@query("join_features_inner", X.with_views("sup", """
    SELECT s.ts, s.market_id, round(s.p, 6) AS p, round(f.mean_p, 6) AS mean_p FROM sup s
    JOIN (SELECT ts, avg(p) AS mean_p FROM sup GROUP BY 1 HAVING count(*) >= 5) f USING (ts)"""))
def join_features_inner(spark, d):
    s = X.supervised(spark, d)
    f = s.groupBy("ts").agg(F.avg("p").alias("mean_p"), F.count("*").alias("n")).where("n >= 5")
    return J.attach(s, f, "ts", "inner").select("ts", "market_id", r6("p"), r6("mean_p"))


@query("semi_join_ids", X.with_views("prices markets", """
    SELECT market_id, count(*) AS n, round(sum(p), 6) AS total FROM prices
    WHERE market_id IN (SELECT market_id FROM markets WHERE y = 1) GROUP BY 1"""))
def semi_join_ids(spark, d):
    ids = X.markets(spark, d).where("y = 1").select("market_id")
    return J.semi(X.prices(spark, d), ids, "market_id").groupBy("market_id").agg(
        F.count("*").alias("n"), r6(F.sum("p"), "total"))


@query("anti_join_ids", X.with_views("prices markets", """
    SELECT market_id, count(*) AS n, round(sum(p), 6) AS total FROM prices
    WHERE market_id NOT IN (SELECT market_id FROM markets WHERE y = 1) GROUP BY 1"""))
def anti_join_ids(spark, d):
    ids = X.markets(spark, d).where("y = 1").select("market_id")
    return J.anti(X.prices(spark, d), ids, "market_id").groupBy("market_id").agg(
        F.count("*").alias("n"), r6(F.sum("p"), "total"))


ASOF = """
    WITH trades AS (SELECT ts, market_id, p, event_id FROM prices WHERE source = 'trade'),
    samples AS (SELECT ts, market_id, p FROM prices WHERE source = 'sampled')"""


def _sides(spark, d):
    p = X.prices(spark, d)
    left = p.where("source = 'trade'").select("ts", "market_id", "event_id", r6("p"))
    right = p.where("source = 'sampled'").select("ts", "market_id", F.col("p").alias("sampled_p"), F.col("event_id").alias("sampled_id"))
    return left, right


@query("asof_backward", X.with_views("prices", f"""{ASOF}
    SELECT t.ts, t.market_id, t.event_id, round(t.p, 6) AS p, round(s.p, 6) AS sampled_p
    FROM trades t ASOF LEFT JOIN samples s ON t.ts >= s.ts"""))
def asof_backward(spark, d):
    left, right = _sides(spark, d)
    return J.asof_backward(left, right, ["sampled_p"], tiebreak=["sampled_id"]).withColumn("sampled_p", r6("sampled_p"))


@query("asof_backward_by", X.with_views("prices", f"""{ASOF}
    SELECT t.ts, t.market_id, t.event_id, round(t.p, 6) AS p, round(s.p, 6) AS sampled_p
    FROM trades t ASOF LEFT JOIN samples s ON t.market_id = s.market_id AND t.ts >= s.ts"""))
def asof_backward_by(spark, d):
    left, right = _sides(spark, d)
    out = J.asof_backward(left, right, ["sampled_p"], by=["market_id"], tiebreak=["sampled_id"])
    return out.withColumn("sampled_p", r6("sampled_p"))


@query("shift_join", X.with_views("panel", """
    SELECT a.ts, a.market_id, round(a.p, 6) AS p, round(b.p, 6) AS later FROM panel a
    LEFT JOIN panel b ON b.market_id = a.market_id AND b.ts = a.ts + INTERVAL 24 HOUR"""))
def shift_join(spark, d):
    cells = X.active_panel(spark, d)
    return P.shift_join(cells, cells, 24, "later").select("ts", "market_id", r6("p"), r6("later"))


@query("pair_self_join", X.with_views("panel", """
    SELECT a.market_id AS a, b.market_id AS b, count(*) AS both_hours, round(sum(a.p * b.p), 6) AS dot
    FROM panel a JOIN panel b ON a.ts = b.ts AND a.market_id < b.market_id GROUP BY 1, 2"""))
def pair_self_join(spark, d):
    pairs = S.dots(S.packed(X.active_panel(spark, d), []))
    return pairs.select("a", "b", F.col("n").alias("both_hours"), r6("dot"))
