"""Queries for coverage, gates and universe scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import fixtures as X
from tidepanel.operators import graph as G
from tidepanel.operators import joins as J
from tidepanel.operators import learn as L
from tidepanel.operators import panel as P
from tidepanel.operators import quality as Q
from tidepanel.plans.panels import CORE, CORE_SQL
from tidepanel.plans.registry import query, r6
from tidepanel.session import cut_lineage

MIN_HOURS = 6


@query("market_coverage", X.with_views("prices markets", """
    SELECT p.market_id, count(*) AS usable_points, min(ts) AS timestamp_min, max(ts) AS timestamp_max, round(min(p), 6) AS min_price,
      round(max(p), 6) AS max_price, count(DISTINCT event_id) AS unique_transactions,
      round((epoch(max(ts)) - epoch(min(ts))) / 86400, 6) AS observed_days, any_value(m.family) AS family, any_value(m.y) AS y
    FROM prices p LEFT JOIN markets m USING (market_id) GROUP BY 1"""))
def market_coverage(spark, d):
    c = Q.market_coverage(X.prices(spark, d), X.markets(spark, d).select("market_id", "family", "y"))
    return c.withColumns({k: r6(k) for k in ("min_price", "max_price", "observed_days")})


def core_ids(spark, d):
    return X.markets(spark, d).where(F.col("family").isin(CORE)).select("market_id")


@query("timestamp_coverage", X.with_views("hours panel markets", f"""
    SELECT h.ts, count(p.p) AS active_markets, count(p.p) FILTER (WHERE m.family IN {CORE_SQL}) AS active_core_markets,
      round(1 - count(p.p) / (SELECT count(DISTINCT market_id) FROM hourly), 6) AS missing_fraction
    FROM hours h LEFT JOIN panel p ON p.ts = h.ts LEFT JOIN markets m ON m.market_id = p.market_id GROUP BY 1"""))
def timestamp_coverage(spark, d):
    h, cells = (x := X.Inputs(spark, d)).hourly, x.panel
    out = Q.timestamp_coverage(cells, P.hour_index(h), h, J.semi(cells, core_ids(spark, d), "market_id"))
    return out.withColumn("missing_fraction", r6("missing_fraction"))


@query("window_violations", X.with_views("filled prices markets", """
    WITH b AS (SELECT f.market_id, f.a, f.b, greatest(date_trunc('hour', t.t), m.start_ts) AS s, m.close_ts AS e
      FROM (SELECT market_id, min(ts) AS a, max(ts) AS b FROM filled WHERE p IS NOT NULL GROUP BY 1) f
      JOIN (SELECT market_id, min(ts) AS t FROM prices GROUP BY 1) t USING (market_id) JOIN markets m USING (market_id))
    SELECT market_id, 'value_before_active_start' AS violation, a AS ts FROM b WHERE a < s
    UNION ALL SELECT market_id, 'value_after_active_end', b FROM b WHERE b > e"""))
def window_violations(spark, d):
    return Q.window_violations(P.forward_fill(X.hourly(spark, d)), X.prices(spark, d), X.markets(spark, d))


@query("max_staleness_hours", X.with_views("panel hourly", """
    SELECT round(max(epoch(p.ts) - epoch(h.ts)) / 3600, 6) AS max_staleness_hours
    FROM panel p ASOF JOIN hourly h ON p.market_id = h.market_id AND p.ts >= h.ts"""))
def max_staleness_hours(spark, d):
    return Q.max_staleness((x := X.Inputs(spark, d)).panel, x.hourly).select(r6("max_staleness_hours"))


def gappy(spark, d):
    k = F.col("event_id")
    return X.prices(spark, d).withColumn("p", F.when(k % 101 != 0, F.col("p"))).withColumn("source", F.when(k % 53 != 0, F.col("source")))


X.add_cte("gappy", """SELECT ts, market_id, event_id, CASE WHEN event_id % 101 <> 0 THEN p END AS p,
      CASE WHEN event_id % 53 <> 0 THEN source END AS source FROM prices""", ["prices"])


@query("required_nulls", X.with_views("gappy", """
    SELECT 'ts' AS "column", count(*) FILTER (WHERE ts IS NULL) AS nulls, false AS missing FROM gappy UNION ALL
    SELECT 'p', count(*) FILTER (WHERE p IS NULL), false FROM gappy UNION ALL
    SELECT 'source', count(*) FILTER (WHERE source IS NULL), false FROM gappy UNION ALL SELECT 'token_id', NULL, true"""))
def required_nulls(spark, d):
    return Q.required_nulls(gappy(spark, d), ["ts", "p", "source", "token_id"])


@query("cap_detection", X.with_views("prices", """
    SELECT max(n) AS max_points_per_market, count(*) FILTER (WHERE n = top) AS markets_at_max_points
    FROM (SELECT n, max(n) OVER () AS top FROM (SELECT count(*) AS n FROM prices GROUP BY market_id))"""))
def cap_detection(spark, d):
    return Q.cap_detection(X.prices(spark, d))


@query("value_counts", X.with_views("gappy", "SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM gappy GROUP BY 1"))
def value_counts(spark, d):
    return Q.value_counts(gappy(spark, d), "source")


X.add_cte("universe", f"""
    SELECT *, family IN {CORE_SQL} AS is_core, family = 'BUILDING' AS is_satellite,
      CASE WHEN market_id % 40 = 7 THEN NULL WHEN y = 1 THEN 'Yes' ELSE 'No' END AS resolved_outcome,
      market_id % 50 <> 3 AS is_binary, CASE WHEN family = 'AUTOMOBILE' AND market_id % 2 = 0 THEN 'other' END AS exclusion_reason
    FROM markets""", ["markets"])


def universe(spark, d):
    k = F.col("market_id")
    return X.markets(spark, d).withColumns({
        "is_core": F.col("family").isin(CORE), "is_satellite": F.col("family") == "BUILDING",
        "resolved_outcome": F.when(k % 40 == 7, None).when(F.col("y") == 1, "Yes").otherwise("No"),
        "is_binary": k % 50 != 3, "exclusion_reason": F.when((F.col("family") == "AUTOMOBILE") & (k % 2 == 0), "other"),
    })


GATES = {"min_core_markets": 20, "min_points_per_market": 40, "min_calendar_days": 20, "min_median_active_core": 15, "max_primary_missingness": 0.6}


@query("quality_gates", X.with_views("panel gappy universe", f"""
    WITH core AS (SELECT p.* FROM panel p JOIN markets m USING (market_id) WHERE m.family IN {CORE_SQL}),
    r AS (SELECT ts, count(*) AS n FROM core GROUP BY 1),
    g AS (SELECT (SELECT count(*) FROM universe WHERE is_core) >= 20 AS min_core_markets,
      (SELECT min(n) FROM (SELECT count(*) AS n FROM gappy GROUP BY market_id)) >= 40 AS min_points_per_market,
      (SELECT count(*) FROM r) / 24 >= 20 AS min_calendar_days, (SELECT median(n) FROM r) >= 15 AS min_median_active_core,
      (SELECT 1 - sum(n) / (count(*) * (SELECT count(DISTINCT market_id) FROM core)) FROM r) <= 0.6 AS max_primary_missingness,
      (SELECT count(*) FROM universe WHERE (is_core OR is_satellite) AND resolved_outcome IS NULL) = 0 AS no_unresolved_selected,
      (SELECT count(*) FROM universe WHERE (is_core OR is_satellite) AND NOT is_binary) = 0 AS no_non_binary_selected,
      true AS required_columns_present, (SELECT count(*) FROM gappy WHERE p IS NULL) = 0 AS required_nulls_absent,
      true AS timestamps_utc, (SELECT count(*) FROM gappy WHERE p NOT BETWEEN 0 AND 1) = 0 AS price_bounds,
      (SELECT count(*) FROM (SELECT market_id, min(ts) AS a, max(ts) AS b FROM panel GROUP BY 1)
        JOIN markets USING (market_id) WHERE a < start_ts OR b > close_ts) = 0 AS active_window_respected,
      (SELECT count(*) FROM universe WHERE NOT (is_core OR is_satellite) AND exclusion_reason IS NULL) = 0 AS excluded_reasons_complete,
      (SELECT count(*) FROM r) > 0 AS core_and_satellite_panels_exist)
    SELECT *, min_core_markets AND min_points_per_market AND min_calendar_days AND min_median_active_core AND max_primary_missingness
      AND no_unresolved_selected AND no_non_binary_selected AND required_columns_present AND required_nulls_absent AND timestamps_utc
      AND price_bounds AND active_window_respected AND excluded_reasons_complete AND core_and_satellite_panels_exist AS analysis_ready FROM g"""))
def quality_gates(spark, d):
    cells = X.active_panel(spark, d)
    primary = J.semi(cells, core_ids(spark, d), "market_id")
    return Q.quality_gates(gappy(spark, d), universe(spark, d), primary, cells, ["ts", "market_id", "p"], GATES)


@query("dataset_manifest", X.with_views("prices universe", """
    SELECT 'selected_market' AS section, CAST(market_id AS VARCHAR) AS name, '' AS value FROM universe WHERE is_core OR is_satellite
    UNION ALL SELECT 'source_count', source, CAST(count(*) AS VARCHAR) FROM prices GROUP BY 2
    UNION ALL SELECT 'observed', 'max_points_per_market', CAST(max(n) AS VARCHAR) FROM (SELECT count(*) AS n FROM prices GROUP BY market_id)
    UNION ALL SELECT 'observed', 'markets_at_max_points', CAST(count(*) FILTER (WHERE n = top) AS VARCHAR)
      FROM (SELECT n, max(n) OVER () AS top FROM (SELECT count(*) AS n FROM prices GROUP BY market_id))
    UNION ALL SELECT 'parameter', 'frequency', '1h' UNION ALL SELECT 'parameter', 'fill_policy', 'active_window_forward_fill'"""))
def dataset_manifest(spark, d):
    return Q.dataset_manifest(X.prices(spark, d), universe(spark, d), {"frequency": "1h", "fill_policy": "active_window_forward_fill"})


# --- families and universes --------------------------------------------------------------------

RELATED = ["ASIA", "EUROPE", "AMERICA", "AFRICA"]
X.add_cte("pool", """
    SELECT m.*, m.market_id IN (SELECT market_id FROM hourly WHERE p IS NOT NULL) AS in_panel, m.market_id % 9 = 0 AS excluded
    FROM markets m""", ["markets", "hourly"])


def pool(spark, d):
    ids = X.hourly(spark, d).select("market_id").distinct().withColumn("in_panel", F.lit(True))
    return X.markets(spark, d).join(ids, "market_id", "left").withColumns({
        "in_panel": F.coalesce("in_panel", F.lit(False)), "excluded": F.col("market_id") % 9 == 0})


ENTROPY = "CASE WHEN {0} > 0 AND {0} < 1 THEN -({0} * log2({0}) + (1 - {0}) * log2(1 - {0})) ELSE 0 END"
BALANCE = "coalesce(greatest(0, 1 - abs({0} - 0.5) * 2), 0)"


@query("family_audit", X.with_views("pool", f"""
    WITH s AS (SELECT family, count(*) AS markets, count(y) AS resolved_markets, avg(y) AS yes_rate, min(start_ts) AS start_min,
        max(start_ts) AS start_max, min(close_ts) AS close_min, max(close_ts) AS close_max, avg(volume) AS avg_volume,
        count(*) FILTER (WHERE in_panel) AS panel_ready_markets, count(*) FILTER (WHERE excluded) AS source_quality_exclusions
        FROM pool GROUP BY 1),
    md AS (SELECT family, domain FROM (SELECT family, domain, row_number() OVER (PARTITION BY family ORDER BY count(*) DESC, domain) AS rn
        FROM pool GROUP BY 1, 2) WHERE rn = 1),
    t AS (SELECT *, {ENTROPY.format('yes_rate')} AS class_entropy, {BALANCE.format('yes_rate')} AS balance,
        ln(1 + greatest(coalesce(avg_volume, 0), -0.999999)) AS lv, CASE WHEN domain IN ('ASIA', 'EUROPE', 'AMERICA', 'AFRICA') THEN 1.0 ELSE 0.35 END AS rel,
        panel_ready_markets / max(panel_ready_markets) OVER () AS ready FROM s JOIN md USING (family)),
    u AS (SELECT *, coalesce((lv - min(lv) OVER ()) / nullif(max(lv) OVER () - min(lv) OVER (), 0), 0) AS liq FROM t)
    SELECT family, domain, markets, resolved_markets, round(yes_rate, 6) AS yes_rate, round(class_entropy, 6) AS class_entropy, start_min,
      start_max, close_min, close_max, round(avg_volume, 6) AS avg_volume, panel_ready_markets, source_quality_exclusions,
      round(balance, 6) AS balance_score, round(liq, 6) AS liquidity_score, round(ready, 6) AS panel_ready_score,
      round(0.35 * balance + 0.30 * liq + 0.25 * ready + 0.10 * rel, 6) AS usefulness_score FROM u"""))
def family_audit(spark, d):
    a = Q.family_audit(pool(spark, d), RELATED)
    rounded = ("yes_rate", "class_entropy", "avg_volume", "balance_score", "liquidity_score", "panel_ready_score", "usefulness_score")
    return a.withColumns({c: r6(c) for c in rounded}).drop("log_volume", "relationship_score")


@query("minmax_score", X.with_views("prices", """
    SELECT market_id, round(coalesce((t - min(t) OVER ()) / nullif(max(t) OVER () - min(t) OVER (), 0), 0), 6) AS score
    FROM (SELECT market_id, sum(p) AS t FROM prices GROUP BY 1)"""))
def minmax_score(spark, d):
    totals = X.prices(spark, d).groupBy("market_id").agg(F.sum("p").alias("t"))
    return Q.minmax(totals, "t", "score").select("market_id", r6("score"))


SPECS = [
    {"universe": "a", "domains": ["ASIA"], "families": ["HOUSEHOLD", "BUILDING", "MACHINERY"]},
    {"universe": "b", "domains": ["ASIA", "EUROPE"]},
    {"universe": "c", "domains": ["ASIA", "EUROPE", "AFRICA", "AMERICA"]},
]
X.add_cte("chosen", """
    SELECT 'a' AS universe, 1 AS wanted, * FROM pool WHERE NOT excluded AND domain = 'ASIA' AND family IN ('HOUSEHOLD', 'BUILDING', 'MACHINERY')
    UNION ALL SELECT 'b', 2, * FROM pool WHERE NOT excluded AND domain IN ('ASIA', 'EUROPE')
    UNION ALL SELECT 'c', 4, * FROM pool WHERE NOT excluded AND domain IN ('ASIA', 'EUROPE', 'AFRICA', 'AMERICA')""", ["pool"])


@query("candidate_membership", X.with_views("chosen", "SELECT universe, market_id, domain, family FROM chosen"))
def candidate_membership(spark, d):
    return Q.candidate_membership(pool(spark, d), SPECS).select("universe", "market_id", "domain", "family")


@query("candidate_summary", X.with_views("chosen panel", f"""
    WITH mem AS (SELECT universe, market_id FROM chosen WHERE in_panel),
    cell AS (SELECT m.universe, p.ts, p.market_id, p.p FROM mem m JOIN panel p USING (market_id)),
    need AS (SELECT universe, greatest(5, least(20, floor(count(*) * 0.25))) AS need FROM mem GROUP BY 1),
    busy AS (SELECT universe, ts FROM cell JOIN need USING (universe) GROUP BY universe, ts, need HAVING count(*) >= need),
    sub AS (SELECT cell.* FROM cell JOIN busy USING (universe, ts)),
    cov AS (SELECT universe, market_id, count(*) / (SELECT count(*) FROM busy b WHERE b.universe = sub.universe) AS c FROM sub GROUP BY 1, 2),
    pan AS (SELECT sub.* FROM sub JOIN cov USING (universe, market_id) WHERE c >= 0.05),
    rws AS (SELECT universe, count(*) AS timestamp_count, sum(n) AS cells, median(n) AS active_market_median, min(ts) AS timestamp_min, max(ts) AS timestamp_max
            FROM (SELECT universe, ts, count(*) AS n FROM pan GROUP BY 1, 2) GROUP BY 1),
    kept AS (SELECT universe, count(*) AS panel_market_count, avg(y) AS yes_rate, avg(volume) AS avg_volume, count(DISTINCT family) AS family_count,
            count(DISTINCT domain) AS domain_count, max(wanted) AS requested_domain_count
            FROM chosen JOIN (SELECT DISTINCT universe, market_id FROM pan) USING (universe, market_id) GROUP BY 1),
    prs AS (SELECT a.universe, abs(corr(a.p, b.p)) AS w, min(a.p) = max(a.p) OR min(b.p) = max(b.p) AS flat FROM pan a
            JOIN pan b ON a.universe = b.universe AND a.ts = b.ts AND a.market_id < b.market_id
            GROUP BY a.universe, a.market_id, b.market_id HAVING count(*) >= {MIN_HOURS}),
    cor AS (SELECT universe, avg(w) AS mean_abs_corr, median(w) AS median_abs_corr, count(*) AS pairs FROM prs WHERE NOT flat GROUP BY 1),
    j AS (SELECT *, ln(1 + greatest(coalesce(avg_volume, 0), -0.999999)) AS lv, cells / (timestamp_count * panel_market_count) AS cover,
            {BALANCE.format('yes_rate')} AS balance, 0.5 * least(1, family_count / 8) + 0.5 * domain_count / requested_domain_count AS rel
          FROM (SELECT universe, count(*) AS metadata_market_count FROM chosen GROUP BY 1) JOIN rws USING (universe) JOIN kept USING (universe) JOIN cor USING (universe)),
    k AS (SELECT *, coalesce((lv - min(lv) OVER ()) / nullif(max(lv) OVER () - min(lv) OVER (), 0), 0) AS liq FROM j)
    SELECT universe, metadata_market_count, panel_market_count, timestamp_count, timestamp_min, timestamp_max, round(yes_rate, 6) AS yes_rate,
      round({ENTROPY.format('yes_rate')}, 6) AS class_entropy, round(avg_volume, 6) AS avg_volume, round(1 - cover, 6) AS panel_missingness,
      CAST(active_market_median AS DOUBLE) AS active_market_median, family_count, domain_count, pairs, round(mean_abs_corr, 6) AS mean_abs_corr,
      round(median_abs_corr, 6) AS median_abs_corr, round(liq, 6) AS liquidity_score, round(rel, 6) AS relationship_score,
      round(0.30 * balance + 0.20 * liq + 0.20 * greatest(0, cover) + 0.10 * rel, 6) AS overall_score FROM k"""))
def candidate_summary(spark, d):
    x = X.Inputs(spark, d)
    s = Q.candidate_summary(pool(spark, d), x.hourly, x.panel, SPECS, MIN_HOURS)
    return s.select(
        "universe", "metadata_market_count", "panel_market_count", "timestamp_count", "timestamp_min", "timestamp_max", r6("yes_rate"),
        r6("class_entropy"), r6("avg_volume"), r6("panel_missingness"), "active_market_median", "family_count", "domain_count", "pairs",
        r6("mean_abs_corr"), r6("median_abs_corr"), r6("liquidity_score"), r6("relationship_score"), r6("overall_score"))


def compressed(spark):
    """(universe, pc_90) of all universes' panels, their components found together."""
    def told(cells):
        found = L.compressibility(cut_lineage(cells))
        return spark.createDataFrame([(u, v["pc_90"]) for u, v in found.items()], "universe string, pc_90 int")

    return told


@query("candidate_scores")
def candidate_scores(spark, d):
    """The full score of each candidate universe with how few components carry its panel."""
    x = X.Inputs(spark, d)
    s = Q.candidate_summary(pool(spark, d), x.hourly, x.panel, SPECS, MIN_HOURS, compressed(spark))
    parts = ("balance_score", "liquidity_score", "coverage_score", "compressibility_score", "relationship_score", "overall_score")
    return s.select("universe", "panel_market_count", "pc_90", *[r6(c) for c in parts])


# --- overlap -----------------------------------------------------------------------------------

X.add_cte("jac", """
    SELECT a.market_id AS a, b.market_id AS b, count(*) / (any_value(na.n) + any_value(nb.n) - count(*)) AS overlap
    FROM panel a JOIN panel b ON a.ts = b.ts AND a.market_id < b.market_id
    JOIN (SELECT market_id, count(*) AS n FROM panel GROUP BY 1) na ON na.market_id = a.market_id
    JOIN (SELECT market_id, count(*) AS n FROM panel GROUP BY 1) nb ON nb.market_id = b.market_id GROUP BY 1, 2""", ["panel"])
X.add_cte("alljac", """
    SELECT x.market_id AS a, y.market_id AS b, coalesce(j.overlap, 0) AS overlap FROM (SELECT DISTINCT market_id FROM hourly) x
    JOIN (SELECT DISTINCT market_id FROM hourly) y ON x.market_id < y.market_id LEFT JOIN jac j ON j.a = x.market_id AND j.b = y.market_id""",
    ["jac", "hourly"])
X.add_cte("avgjac", """
    SELECT market_id, avg(overlap) AS average_overlap FROM (SELECT a AS market_id, overlap FROM alljac UNION ALL SELECT b, overlap FROM alljac)
    GROUP BY 1""", ["alljac"])


@query("pairwise_jaccard", X.with_views("jac", "SELECT a, b, round(overlap, 6) AS overlap FROM jac"))
def pairwise_jaccard(spark, d):
    return G.jaccard(X.active_panel(spark, d)).select("a", "b", r6("overlap"))


@query("avg_overlap", X.with_views("avgjac", "SELECT market_id, round(average_overlap, 6) AS average_overlap FROM avgjac"))
def avg_overlap(spark, d):
    x = X.Inputs(spark, d)
    return G.average_overlap(G.Lifetimes(x.panel), x.hourly).select("market_id", r6("average_overlap"))


def _overlap(spark, d):
    x = X.Inputs(spark, d)
    stats = G.overlap_stats(G.Lifetimes(x.panel), x.hourly)
    return stats.withColumns({c: r6(c) for c in stats.columns if c != "pairs"})


@query("overlap_stats", X.with_views("alljac", """
    SELECT count(*) AS pairs, round(avg(overlap), 6) AS mean_overlap, round(median(overlap), 6) AS median_overlap,
      round(min(overlap), 6) AS min_overlap, round(max(overlap), 6) AS max_overlap FROM alljac"""))
def overlap_stats(spark, d):
    return _overlap(spark, d).select("pairs", "mean_overlap", "median_overlap", "min_overlap", "max_overlap")


@query("overlap_shares", X.with_views("alljac", """
    SELECT count(*) AS pairs, round(avg(CAST(overlap = 0 AS INTEGER)), 6) AS share_zero, round(avg(CAST(overlap >= 0.10 AS INTEGER)), 6) AS share_ge_10,
      round(avg(CAST(overlap >= 0.25 AS INTEGER)), 6) AS share_ge_25 FROM alljac"""))
def overlap_shares(spark, d):
    return _overlap(spark, d).select("pairs", "share_zero", "share_ge_10", "share_ge_25")


@query("missingness_decomposition", X.with_views("grid panel lifemask", """
    WITH c AS (SELECT g.p IS NOT NULL AS r, p.p IS NOT NULL AS f, l.ts IS NOT NULL AS m FROM grid g
      LEFT JOIN panel p ON p.ts = g.ts AND p.market_id = g.market_id LEFT JOIN lifemask l ON l.ts = g.ts AND l.market_id = g.market_id),
    s AS (SELECT count(*) AS total_cells, count(*) FILTER (f) AS observed_filled_cells, count(*) FILTER (r) AS raw_observed_cells,
      count(*) FILTER (NOT f) AS missing_cells, count(*) FILTER (NOT m AND NOT f) AS structural_missing_cells,
      count(*) FILTER (m AND NOT f) AS data_missing_cells, count(*) FILTER (m AND NOT r) AS active_raw_missing_cells, count(*) FILTER (m) AS act FROM c)
    SELECT * EXCLUDE (act), round(missing_cells / total_cells, 6) AS overall_missingness,
      round(structural_missing_cells / total_cells, 6) AS structural_missing_fraction_of_all,
      round(data_missing_cells / total_cells, 6) AS data_missing_fraction_of_all,
      round(structural_missing_cells / greatest(1, missing_cells), 6) AS structural_share_of_missing,
      round(data_missing_cells / greatest(1, missing_cells), 6) AS data_share_of_missing,
      round(active_raw_missing_cells / greatest(1, act), 6) AS raw_sparsity_within_active,
      round(data_missing_cells / greatest(1, act), 6) AS filled_missing_within_active FROM s"""))
def missingness_decomposition(spark, d):
    h, m = X.hourly(spark, d), X.markets(spark, d)
    index = P.hour_index(h)
    mask = P.lifetime_mask(P.market_lifetimes(h, m), index)
    out = Q.missingness_decomposition(P.active_ffill(h, P.active_windows(h, m)), h, mask, index, h)
    return out.withColumns({c: r6(c) for c, t in out.dtypes if t == "double"})


# Names and letters of the universes by least average overlap.
LETTERS = {"Universe B": "A", "Universe B-25": "B", "Universe B-40": "C", "Universe B-50": "D"}
THRESHOLDS = {"Universe B": 0.0, "Universe B-25": 0.25, "Universe B-40": 0.40, "Universe B-50": 0.50}
X.add_cte("constrained", f"""
    SELECT k.universe, any_value(s.n) AS market_count, any_value(s.r) AS yes_rate,
      1 - any_value(f.cells) / ((SELECT count(*) FROM hours) * any_value(s.n)) AS panel_missingness,
      any_value(act.med) AS median_active_markets, any_value(act.mean) AS mean_active_markets, avg(j.overlap) AS mean_pairwise_overlap,
      median(j.overlap) AS median_pairwise_overlap, min(j.overlap) AS min_pairwise_overlap, max(j.overlap) AS max_pairwise_overlap
    FROM keep k JOIN keep k2 ON k.universe = k2.universe AND k.market_id < k2.market_id JOIN alljac j ON j.a = k.market_id AND j.b = k2.market_id
    JOIN (SELECT universe, count(*) AS n, avg(y) AS r FROM keep JOIN markets USING (market_id) GROUP BY 1) s ON s.universe = k.universe
    JOIN (SELECT universe, count(*) AS cells FROM keep JOIN panel USING (market_id) GROUP BY 1) f ON f.universe = k.universe
    JOIN (SELECT universe, median(n) AS med, avg(n) AS mean FROM (SELECT u.universe, h.ts, count(p.market_id) AS n
        FROM (SELECT DISTINCT universe FROM keep) u CROSS JOIN hours h LEFT JOIN (SELECT keep.universe, panel.* FROM keep JOIN panel USING (market_id)) p
        ON p.universe = u.universe AND p.ts = h.ts GROUP BY 1, 2) GROUP BY 1) act ON act.universe = k.universe GROUP BY 1""",
    ["keep", "alljac", "panel", "hours"])
X.add_cte("keep", "SELECT t.universe, a.market_id FROM avgjac a JOIN (VALUES " + ", ".join(
    f"('{n}', {t})" for n, t in THRESHOLDS.items()) + ") t(universe, cut) ON a.average_overlap >= t.cut", ["avgjac"])


def constrained(spark, d, compressibility=None):
    x = X.Inputs(spark, d)
    lives = G.Lifetimes(x.panel)
    return Q.constrained_universes(G.average_overlap(lives, x.hourly), lives, x.panel, x.panel, P.hour_index(x.hourly), x.markets, THRESHOLDS, compressibility)


@query("overlap_constrained_universes", X.with_views("constrained", f"""
    SELECT universe, market_count, round(yes_rate, 6) AS yes_rate, round({ENTROPY.format('yes_rate')}, 6) AS class_entropy,
      round(panel_missingness, 6) AS panel_missingness, CAST(median_active_markets AS DOUBLE) AS median_active_markets,
      round(mean_active_markets, 6) AS mean_active_markets, round(mean_pairwise_overlap, 6) AS mean_pairwise_overlap,
      round(median_pairwise_overlap, 6) AS median_pairwise_overlap, round(min_pairwise_overlap, 6) AS min_pairwise_overlap,
      round(max_pairwise_overlap, 6) AS max_pairwise_overlap FROM constrained"""))
def overlap_constrained_universes(spark, d):
    out = constrained(spark, d)
    return out.withColumns({c: r6(c) for c, t in out.dtypes if t == "double" and c != "median_active_markets"})


@query("recommend_universe", X.with_views("constrained", """
    WITH v AS (SELECT universe, market_count, round(0.30 * greatest(0, 1 - panel_missingness) + 0.25 * least(1, market_count / 100)
      + 0.25 * coalesce(greatest(0, 1 - abs(yes_rate - 0.5) * 2), 0), 9) AS score FROM constrained WHERE market_count >= 25)
    SELECT CASE WHEN (SELECT count(*) FROM v WHERE universe <> 'Universe B') = 0 THEN 'A' ELSE
      (SELECT CASE universe WHEN 'Universe B' THEN 'A' WHEN 'Universe B-25' THEN 'B' WHEN 'Universe B-40' THEN 'C' ELSE 'D' END
       FROM v ORDER BY score DESC, market_count, universe DESC LIMIT 1) END AS recommendation"""))
def recommend_universe(spark, d):
    return Q.recommend_universe(constrained(spark, d), LETTERS, "Universe B")


@query("universe_choice")
def universe_choice(spark, d):
    """The viable universes with the parts of their full score, and the letter that it recommends."""
    told = cut_lineage(constrained(spark, d, compressed(spark)))
    letter = Q.recommend_universe(told, LETTERS, "Universe B").scalar()
    parts = ("missingness_score", "market_score", "balance_score", "latent_score", "score")
    return Q.choice_scores(told).select("universe", "market_count", "pc_90", *[r6(c) for c in parts], letter.alias("recommendation"))


@query("lifetime_summary", X.with_views("lifetimes avgjac", """
    SELECT domain, family, y, count(*) AS markets, round(avg(average_overlap), 6) AS mean_overlap,
      round(median(active_duration_hours / 24), 6) AS median_days, round(median(observed_hours), 6) AS median_observed_hours
    FROM lifetimes JOIN avgjac USING (market_id) GROUP BY 1, 2, 3"""))
def lifetime_summary(spark, d):
    x = X.Inputs(spark, d)
    avg = cut_lineage(G.average_overlap(G.Lifetimes(x.panel), x.hourly))
    out = Q.lifetime_summary(P.market_lifetimes(x.hourly, x.markets), avg)
    return out.withColumns({c: r6(c) for c in ("mean_overlap", "median_days", "median_observed_hours")})


@query("feature_missingness", X.with_views("hours panel markets", """
    WITH f AS (SELECT h.ts, m.family, avg(p.p) AS v FROM hours h JOIN panel p ON p.ts = h.ts JOIN markets m USING (market_id) GROUP BY 1, 2)
    SELECT x.family AS feature, round(1 - (SELECT count(*) FROM f WHERE f.family = x.family) /
      (SELECT count(DISTINCT ts) FROM panel), 6) AS null_share
    FROM (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS family) x"""))
def feature_missingness(spark, d):
    fams = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    wide = X.active_panel(spark, d).join(X.markets(spark, d).select("market_id", "family"), "market_id").groupBy("ts").pivot("family", fams).agg(F.avg("p"))
    return Q.feature_missingness(wide, fams).select("feature", r6("null_share"))
