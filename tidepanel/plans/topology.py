"""Queries for persistence diagrams and the features read off them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel import fixtures as X
from tidepanel.operators import fits
from tidepanel.operators import folds as FO
from tidepanel.operators import graph as G
from tidepanel.operators import learn as L
from tidepanel.operators import panel as P
from tidepanel.operators import topology as T
from tidepanel.plans.learning import family_names
from tidepanel.plans.registry import query, r6
from tidepanel.plans.scoring import FOLD, r_all
from tidepanel.session import cut_lineage

WINDOWS, STRIDE = (12, 24), 12
KEYS = ["window_hours", "window_end"]

# A diagram table drawn from the price history: a window per day, some points infinite, reversed or empty.
X.add_cte("dgm", """
    SELECT CAST(CASE WHEN market_id % 2 = 0 THEN 12 ELSE 24 END AS INTEGER) AS window_hours, date_trunc('day', ts) AS window_end,
      CAST(event_id % 2 AS INTEGER) AS dim, p * 0.6 AS birth, CASE WHEN event_id % 37 = 0 THEN CAST('Infinity' AS DOUBLE)
      WHEN event_id % 23 = 0 THEN p * 0.6 WHEN event_id % 29 = 0 THEN p * 0.6 - 0.01 ELSE p END AS death, event_id FROM prices""", ["prices"])
X.add_cte("bp", """
    SELECT window_hours, window_end, dim, birth, death - birth AS persistence, event_id FROM dgm
    WHERE isfinite(birth) AND isfinite(death) AND death >= birth AND death - birth > 1e-12""", ["dgm"])


def dgm(spark, d):
    e, p = F.col("event_id"), F.col("p")
    death = F.when(e % 37 == 0, float("inf")).when(e % 23 == 0, p * 0.6).when(e % 29 == 0, p * 0.6 - 0.01).otherwise(p)
    return X.prices(spark, d).select(
        F.when(F.col("market_id") % 2 == 0, 12).otherwise(24).alias("window_hours"), P.floor_to("ts", "day").alias("window_end"),
        (e % 2).cast("int").alias("dim"), (p * 0.6).alias("birth"), death.alias("death"), "event_id")


@query("finite_diagram", X.with_views("dgm", """
    SELECT event_id, round(birth, 6) AS birth, round(death, 6) AS death FROM dgm WHERE isfinite(birth) AND isfinite(death) AND death >= birth"""))
def finite_diagram(spark, d):
    return T.finite_diagram(dgm(spark, d)).select("event_id", r6("birth"), r6("death"))


@query("birth_persistence", X.with_views("bp", "SELECT event_id, round(birth, 6) AS birth, round(persistence, 6) AS persistence FROM bp"))
def birth_persistence(spark, d):
    return T.birth_persistence(dgm(spark, d)).select("event_id", r6("birth"), r6("persistence"))


def _stats_sql():
    cols = []
    for dim, count in ((0, "num_components"), (1, "num_loops")):
        f = f"FILTER (dim = {dim})"
        cols += [f"count(*) {f} AS h{dim}_{count}", f"coalesce(sum(persistence) {f}, 0) AS h{dim}_total_persistence",
                 f"coalesce(max(persistence) {f}, 0) AS h{dim}_max_persistence", f"coalesce(-sum(w * log2(w + 1e-12)) {f}, 0) AS h{dim}_entropy"]
    return f"""SELECT window_hours, window_end, {', '.join(cols)} FROM (SELECT *, persistence / sum(persistence) OVER
      (PARTITION BY window_hours, window_end, dim) AS w FROM bp) GROUP BY 1, 2"""


X.add_cte("dstats", _stats_sql(), ["bp"])


@query("diagram_stats", X.with_views("dstats", "SELECT window_hours, window_end, h0_num_components, h1_num_loops, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in T.stat_columns() if "_num_" not in c) + " FROM dstats"))
def diagram_stats(spark, d):
    t = dgm(spark, d)
    return r_all(T.diagram_stats(t, t, KEYS))


TRAIN_END = "TIMESTAMP '2024-01-19'"
X.add_cte("ranges", f"""
    SELECT window_hours, greatest(quantile_cont(birth, 0.99), 1e-3) * 1.05 AS birth_max, greatest(quantile_cont(persistence, 0.99), 1e-3) * 1.05 AS pers_max
    FROM bp WHERE dim = 1 AND window_end < {TRAIN_END} GROUP BY 1""", ["bp"])


def ranges(spark, d):
    train = dgm(spark, d).where("dim = 1").where(F.col("window_end") < F.lit("2024-01-19").cast("timestamp_ntz"))
    return T.image_ranges(train, ["window_hours"])


def ranged(spark, d):
    loops = T.birth_persistence(dgm(spark, d).where("dim = 1"))
    return loops.join(cut_lineage(ranges(spark, d)), "window_hours")


@query("image_ranges", X.with_views("ranges", "SELECT window_hours, round(birth_max, 6) AS birth_max, round(pers_max, 6) AS pers_max FROM ranges"))
def image_ranges(spark, d):
    return r_all(ranges(spark, d))


def _image_sql(n, sigma):
    taps = ", ".join(f"({o}, {w!r})" for o, w in T.gaussian_kernel(sigma))
    return f"""
    WITH taps AS (SELECT o, CAST(w AS DOUBLE) AS w FROM (VALUES {taps}) t(o, w)),
    hist AS (SELECT window_hours, window_end, least({n - 1}, CAST(floor(least(birth, birth_max) / birth_max * {n}) AS INTEGER)) AS bi,
      least({n - 1}, CAST(floor(least(persistence, pers_max) / pers_max * {n}) AS INTEGER)) AS bj, sum(least(persistence, pers_max)) AS mass
      FROM bp JOIN ranges USING (window_hours) WHERE dim = 1 GROUP BY 1, 2, 3, 4),
    image AS (SELECT window_hours, window_end, CAST(bi + u.o AS INTEGER) AS i, CAST(bj + v.o AS INTEGER) AS j, sum(mass * u.w * v.w) AS value FROM hist, taps u, taps v
      WHERE bi + u.o BETWEEN 0 AND {n - 1} AND bj + v.o BETWEEN 0 AND {n - 1} GROUP BY 1, 2, 3, 4)"""


@query("persistence_image", X.with_views("bp ranges", f"{_image_sql(20, 1.0)} SELECT window_hours, window_end, i, j, round(value, 6) AS value FROM image"))
def persistence_image(spark, d):
    return r_all(T.persistence_image(ranged(spark, d), KEYS, 20))


@query("persistence_image_vector", X.with_views("bp ranges", f"""{_image_sql(10, 0.5)}
    SELECT window_hours, window_end, 100 AS n_features, round(sum(value), 6) AS mass, round(max(value), 6) AS peak FROM image GROUP BY 1, 2"""))
def persistence_image_vector(spark, d):
    points = cut_lineage(ranged(spark, d))
    v = T.image_vectors(T.persistence_image(points, KEYS, 10), points, KEYS, 10)
    return v.select(*KEYS, F.size("features").alias("n_features"), r6("mass"), r6(F.array_max("features"), "peak"))


@query("persistence_landscape", X.with_views("bp ranges", """
    SELECT window_hours, window_end, step, level, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY window_hours, window_end, step ORDER BY v DESC) AS level
      FROM (SELECT window_hours, window_end, step, least(g - birth, birth + persistence - g) AS v FROM (
        SELECT bp.*, s.step, s.step * greatest(birth_max + pers_max, 1e-3) / 49 AS g FROM bp JOIN ranges USING (window_hours),
          (SELECT CAST(unnest(generate_series(0, 49)) AS INTEGER) AS step) s WHERE dim = 1)) WHERE v > 0) WHERE level <= 3"""))
def persistence_landscape(spark, d):
    return T.persistence_landscape(ranged(spark, d), KEYS, 3, 50).select(*KEYS, "step", F.col("level").cast("long"), r6("value"))


@query("topology_change", X.with_views("dstats", """
    SELECT window_hours, window_end, round(coalesce(h0_entropy - lag(h0_entropy) OVER w, 0), 6) AS delta_h0_entropy,
      round(coalesce(h1_total_persistence - lag(h1_total_persistence) OVER w, 0), 6) AS delta_h1_total_persistence
    FROM dstats WINDOW w AS (PARTITION BY window_hours ORDER BY window_end)"""))
def topology_change(spark, d):
    t = dgm(spark, d)
    out = T.topology_change(T.diagram_stats(t, t, KEYS), ["h0_entropy", "h1_total_persistence"], ["window_hours"])
    return out.select(*KEYS, r6("delta_h0_entropy"), r6("delta_h1_total_persistence"))


@query("topology_diagnostics", X.with_views("dstats", """
    SELECT window_hours, count(DISTINCT window_end) AS timestamps, round(avg(CAST(h1_num_loops > 0 AS INTEGER)), 6) AS h1_nontrivial_rate,
      round(avg(h0_total_persistence), 6) AS avg_h0_total_persistence, round(avg(h1_total_persistence), 6) AS avg_h1_total_persistence,
      round(avg(h0_entropy), 6) AS avg_h0_entropy, round(avg(h1_entropy), 6) AS avg_h1_entropy, round(stddev_samp(h1_entropy), 6) AS h1_entropy_std,
      round(stddev_samp(h1_total_persistence), 6) AS h1_total_persistence_std FROM dstats GROUP BY 1"""))
def topology_diagnostics(spark, d):
    t = dgm(spark, d)
    return r_all(T.topology_diagnostics(T.diagram_stats(t, t, KEYS)))


# --- windows of the real state -----------------------------------------------------------------


def scaled_state(spark, d):
    """Family state scaled on the first fold's training hours, one array per hour, with the hour index."""
    from tidepanel.operators import joins as J

    h, m = X.hourly(spark, d), X.markets(spark, d)
    cells = cut_lineage(P.active_ffill(h, P.active_windows(h, m)))
    index = P.hour_index(h)
    long = cut_lineage(L.state_features(P.family_state(cells, m), index, family_names(m)))
    first = FO.chronological_folds(cells, **FOLD).where("fold = 1")
    train = long.join(J.fold_hours(first).where("split = 'train'").select("ts"), "ts", "left_semi")
    z = L.scale(long, L.fit_scale(train, ["feature"]), ["feature"], clip=10.0)
    return cut_lineage(L.state_vectors(z, [])), index, train.select("ts").distinct()


def state_windows(vectors, index):
    return T.window_points(vectors, index, WINDOWS[0], STRIDE).unionByName(T.window_points(vectors, index, WINDOWS[1], STRIDE))


@query("persistence_diagrams")
def persistence_diagrams(spark, d):
    vectors, index, _ = scaled_state(spark, d)
    return r_all(T.persistence_diagrams(state_windows(vectors, index), KEYS))


@query("dynamic_family_topology")
def dynamic_family_topology(spark, d):
    vectors, index, _ = scaled_state(spark, d)
    points = cut_lineage(state_windows(vectors, index))
    stats = cut_lineage(T.diagram_stats(T.persistence_diagrams(points, KEYS), points, KEYS, "dyn_"))
    cols = T.stat_columns("dyn_")
    out = FO.lag_and_delta(stats.withColumnRenamed("window_end", "ts"), ["window_hours"], cols)
    wide = out.groupBy("ts").pivot("window_hours", list(WINDOWS)).agg(*[
        F.first(c).alias(c) for c in out.columns if c not in ("ts", "window_hours")])
    return r_all(wide.na.fill(0))


@query("residual_topology")
def residual_topology(spark, d):
    vectors, index, train = scaled_state(spark, d)
    _, mean, cov = fits.covariances(vectors.join(train, "ts", "left_semi").withColumn("one", F.lit(1)), "one")["1"]
    fitted = L.components_of(mean, cov)
    rest = cut_lineage(vectors.select("ts", fitted.residuals(F.col("x"), 2).alias("x")))
    points = cut_lineage(state_windows(rest, index))
    dgms = cut_lineage(T.persistence_diagrams(points, KEYS))
    stats = T.diagram_stats(dgms, points, KEYS, "resid_")
    last = train.agg(F.max("ts")).scalar()
    loops = dgms.where("dim = 1")
    limits = cut_lineage(T.image_ranges(loops.where(F.col("window_end") <= last), ["window_hours"]))
    image = T.persistence_image(T.birth_persistence(loops).join(limits, "window_hours"), KEYS, 10, 0.5)
    mass = T.image_vectors(image, points, KEYS, 10).select(*KEYS, F.col("mass").alias("h1_image_mass"))
    return r_all(stats.join(mass, KEYS))


@query("local_topology")
def local_topology(spark, d):
    h, m = X.hourly(spark, d), X.markets(spark, d)
    groups = F.array(F.struct(F.lit("family").alias("group_type"), F.col("family").alias("group")),
                     F.struct(F.lit("domain").alias("group_type"), F.col("domain").alias("group")))
    tagged = m.select("market_id", F.explode(groups).alias("g")).select("market_id", "g.*")
    big = tagged.groupBy("group_type", "group").agg(F.count("*").alias("n")).where("n >= 3").drop("n")
    cells = P.dense_fill(h).join(tagged.join(big, ["group_type", "group"]), "market_id")
    inside = cut_lineage(P.window_members(cells, 24, 24, P.window_ends(P.hour_index(h), 24, 24)))
    keys = ["group_type", "group", "window_end"]
    dist = T.hour_distances(inside, keys, max(1, h.select("market_id").distinct().count() // 512))
    return r_all(T.diagram_stats(T.diagrams_from_distances(dist, keys), inside, keys, "local_"))


@query("hour_distances", X.with_views("dense markets hours span", """
    WITH e AS (SELECT h.ts FROM hours h, span WHERE hour(h.ts) = 0 AND h.ts >= lo + INTERVAL 23 HOUR),
    w AS (SELECT e.ts AS window_end, d.ts, d.market_id, d.p FROM e JOIN dense d ON d.ts > e.ts - INTERVAL 24 HOUR AND d.ts <= e.ts)
    SELECT x.window_end, m.family, x.ts AS a, y.ts AS b, round(sqrt(sum((x.p - y.p) * (x.p - y.p))), 6) AS d FROM w x
    JOIN w y ON x.window_end = y.window_end AND x.market_id = y.market_id AND x.ts < y.ts JOIN markets m ON m.market_id = x.market_id GROUP BY 1, 2, 3, 4"""))
def hour_distances(spark, d):
    h = X.hourly(spark, d)
    cells = P.dense_fill(h).join(X.markets(spark, d).select("market_id", "family"), "market_id")
    inside = P.window_members(cells, 24, 24, P.window_ends(P.hour_index(h), 24, 24))
    return r_all(T.hour_distances(inside, ["window_end", "family"], max(1, h.select("market_id").distinct().count() // 512)))
