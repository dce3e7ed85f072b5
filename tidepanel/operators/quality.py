"""Coverage tables, quality gates and universe scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import ordered
from tidepanel.functions.scalars import binary_entropy
from tidepanel.operators import graph as G
from tidepanel.operators import joins as J
from tidepanel.operators import panel as P
from tidepanel.session import cut_lineage

# The gates of an analysis-ready data set.
QUALITY_GATES = {
    "min_core_markets": 20, "min_points_per_market": 500, "min_calendar_days": 180,
    "min_median_active_core": 15, "max_primary_missingness": 0.20,
}
# Weights of the family score, the universe score and the recommendation.
FAMILY_WEIGHTS = {"balance": 0.35, "liquidity": 0.30, "panel_ready": 0.25, "relationship": 0.10}
UNIVERSE_WEIGHTS = {"balance": 0.30, "liquidity": 0.20, "coverage": 0.20, "compressibility": 0.20, "relationship": 0.10}
CHOICE_WEIGHTS = {"missingness": 0.30, "market": 0.25, "balance": 0.25, "latent": 0.20}


def seconds(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")) / 1e6


def zero_if_null(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0.0))


# --- coverage --------------------------------------------------------------------------------


def market_coverage(prices: DataFrame, universe: DataFrame, transaction: str = "event_id") -> DataFrame:
    cover = prices.groupBy("market_id").agg(
        F.count("*").alias("usable_points"), F.min("ts").alias("timestamp_min"), F.max("ts").alias("timestamp_max"),
        F.min("p").alias("min_price"), F.max("p").alias("max_price"),
        F.countDistinct(transaction).alias("unique_transactions"),
    ).withColumn("observed_days", (seconds("timestamp_max") - seconds("timestamp_min")) / 86400.0)
    return cover.join(universe, "market_id", "left")


def timestamp_coverage(cells: DataFrame, index: DataFrame, columns: DataFrame, core: DataFrame) -> DataFrame:
    m = columns.select("market_id").distinct().agg(F.count("*")).scalar()
    all_n = cells.groupBy("ts").agg(F.count("p").alias("active_markets"))
    core_n = core.groupBy("ts").agg(F.count("p").alias("active_core_markets"))
    out = index.join(all_n, "ts", "left").join(core_n, "ts", "left").na.fill(0)
    return out.withColumn("missing_fraction", 1 - F.col("active_markets") / m)


def window_violations(cells: DataFrame, prices: DataFrame, markets: DataFrame, end: str | None = None) -> DataFrame:
    """Panels values before a market's start or after its end, at most one of each per market."""
    seen = cells.groupBy("market_id").agg(F.min("ts").alias("first_cell"), F.max("ts").alias("last_cell"))
    trade = prices.groupBy("market_id").agg(P.floor_to(F.min("ts")).alias("first_trade"))
    stop = F.coalesce(F.col("close_ts"), F.col(end)) if end else F.col("close_ts")
    b = seen.join(markets.select("market_id", "start_ts", stop.alias("stop")), "market_id").join(trade, "market_id", "left")
    kinds = F.array(
        F.when(F.col("first_cell") < F.greatest("first_trade", P.floor_to("start_ts")),
               F.struct(F.lit("value_before_active_start").alias("violation"), F.col("first_cell").alias("ts"))),
        F.when(F.col("last_cell") > P.ceil_hour("stop"),
               F.struct(F.lit("value_after_active_end").alias("violation"), F.col("last_cell").alias("ts"))),
    )
    return b.select("market_id", F.explode(F.array_compact(kinds)).alias("v")).select("market_id", "v.*")


def max_staleness(cells: DataFrame, hourly: DataFrame) -> DataFrame:
    """Largest gap in hours between a filled hour and the observation it repeats."""
    seen = hourly.select("ts", "market_id", F.col("ts").alias("raw_ts"))
    joined = J.asof_backward(cells.select("ts", "market_id"), seen, ["raw_ts"], by=["market_id"], unit="month")
    return joined.agg(F.max((seconds("ts") - seconds("raw_ts")) / 3600.0).alias("max_staleness_hours"))


def required_nulls(df: DataFrame, required: list[str]) -> DataFrame:
    """Null count per required column; a column the table lacks is reported as missing."""
    present = [c for c in required if c in df.columns]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in present])
    pairs = [F.struct(F.lit(c).alias("column"), (F.col(c) if c in present else F.lit(None).cast("long")).alias("nulls"),
                      F.lit(c not in present).alias("missing")) for c in required]
    return counts.select(F.explode(F.array(pairs)).alias("r")).select("r.*")


def cap_detection(prices: DataFrame) -> DataFrame:
    """Most points of any market, and how many markets sit exactly at that number."""
    points = prices.groupBy("market_id").agg(F.count("*").alias("n"))
    sizes = points.groupBy("n").agg(F.count("*").alias("m"))
    return sizes.agg(F.max("n").alias("max_points_per_market"), F.max_by("m", "n").alias("markets_at_max_points"))


def quality_gates(prices: DataFrame, universe: DataFrame, primary: DataFrame, filled: DataFrame,
                  required: list[str], gates: dict = QUALITY_GATES) -> DataFrame:
    """One row of gate results and `analysis_ready`.

    `universe` has is_core, is_satellite, resolved_outcome, is_binary and exclusion_reason.
    """
    per_market = prices.groupBy("market_id").agg(F.count("*").alias("n"))
    rows = primary.groupBy("ts").agg(F.count("*").alias("n"))
    n_cols = primary.agg(F.countDistinct("market_id")).scalar()
    chosen = F.col("is_core") | F.col("is_satellite")
    u = universe.agg(
        F.count_if("is_core").alias("core_markets"),
        F.count_if(chosen & F.col("resolved_outcome").isNull()).alias("unresolved_selected"),
        F.count_if(chosen & ~F.col("is_binary")).alias("non_binary_selected"),
        F.count_if(~chosen & F.col("exclusion_reason").isNull()).alias("excluded_without_reason"),
    )
    missing_columns = [c for c in required if c not in prices.columns]
    nulls = prices.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required if c in prices.columns])
    null_total = nulls.select(sum((F.col(c) for c in nulls.columns), F.lit(0))).scalar()
    out_of_bounds = prices.agg(F.count_if(~F.col("p").between(0, 1))).scalar()
    shape = rows.agg(F.struct(F.count("*").alias("rows"), F.median("n").alias("median"), F.sum("n").alias("cells"))).scalar()
    flags = {
        "min_core_markets": F.col("core_markets") >= gates["min_core_markets"],
        "min_points_per_market": F.coalesce(per_market.agg(F.min("n")).scalar() >= gates["min_points_per_market"], F.lit(False)),
        "min_calendar_days": shape["rows"] / 24 >= gates["min_calendar_days"],
        "min_median_active_core": F.coalesce(shape["median"], F.lit(0.0)) >= gates["min_median_active_core"],
        "max_primary_missingness":
            F.coalesce(1 - shape["cells"] / F.nullif(shape["rows"] * n_cols, F.lit(0)), F.lit(1.0)) <= gates["max_primary_missingness"],
        "no_unresolved_selected": F.col("unresolved_selected") == 0,
        "no_non_binary_selected": F.col("non_binary_selected") == 0,
        "required_columns_present": F.lit(not missing_columns),
        "required_nulls_absent": null_total == 0,
        "timestamps_utc": F.lit(dict(prices.dtypes)["ts"] in ("timestamp_ntz", "timestamp")),
        "price_bounds": out_of_bounds == 0,
        "active_window_respected": window_violations(filled, prices, universe).agg(F.count("*") == 0).scalar(),
        "excluded_reasons_complete": F.col("excluded_without_reason") == 0,
        "core_and_satellite_panels_exist": shape["rows"] > 0,
    }
    table = u.select(*[c.alias(k) for k, c in flags.items()])
    ready = F.lit(True)
    for k in flags:
        ready = ready & F.col(k)
    return table.withColumn("analysis_ready", ready)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit("unknown")).alias(column)).agg(F.count("*").alias("n"))


def dataset_manifest(prices: DataFrame, universe: DataFrame, parameters: dict[str, object]) -> DataFrame:
    """Parameters, selected ids, source counts and caps as (section, name, value) rows.

    A row per id keeps the manifest a table of any length rather than one record.
    """
    text = lambda section, name, value: F.struct(
        F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("string").alias("value"))
    ids = universe.where(F.col("is_core") | F.col("is_satellite")).select(text("selected_market", F.col("market_id"), F.lit("")).alias("r"))
    counts = value_counts(prices, "source").select(text("source_count", F.col("source"), F.col("n")).alias("r"))
    caps = cap_detection(prices).select(F.explode(F.array(*[
        text("observed", F.lit(c), F.col(c)) for c in ("max_points_per_market", "markets_at_max_points")])).alias("r"))
    given = cap_detection(prices).select(F.explode(F.array(*[
        text("parameter", F.lit(k), F.lit(str(v))) for k, v in parameters.items()])).alias("r"))
    return ids.unionAll(counts).unionAll(caps).unionAll(given).select("r.*")


# --- families and universes ------------------------------------------------------------------


def minmax(df: DataFrame, column: str, name: str) -> DataFrame:
    """`column` scaled to [0, 1] over the table, 0 where it is flat."""
    ends = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    width = F.nullif(ends["hi"] - ends["lo"], F.lit(0.0))
    return df.withColumn(name, F.coalesce((F.col(column) - ends["lo"]) / width, F.lit(0.0)))


def balance_score(rate: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(rate - 0.5) * 2), F.lit(0.0))


def weighted(weights: dict[str, float]) -> Column:
    return sum((F.lit(w) * F.coalesce(F.col(f"{k}_score"), F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))


def family_audit(markets: DataFrame, related: list[str]) -> DataFrame:
    """Counts, rates, dates, volumes and the usefulness score of each family, best first.

    `markets` has family, domain, y, start_ts, close_ts, volume, in_panel and excluded.
    """
    stats = markets.groupBy("family").agg(
        F.count("*").alias("markets"), F.count("y").alias("resolved_markets"), F.avg("y").alias("yes_rate"),
        F.min("start_ts").alias("start_min"), F.max("start_ts").alias("start_max"),
        F.min("close_ts").alias("close_min"), F.max("close_ts").alias("close_max"),
        F.avg("volume").alias("avg_volume"), F.count_if("in_panel").alias("panel_ready_markets"),
        F.count_if("excluded").alias("source_quality_exclusions"))
    modes = markets.groupBy("family", "domain").agg(F.count("*").alias("n")).groupBy("family").agg(
        F.min_by("domain", F.struct((-F.col("n")).alias("n"), "domain")).alias("domain"))
    rated = stats.join(modes, "family").withColumns({
        "class_entropy": binary_entropy("yes_rate"),
        "balance_score": balance_score(F.col("yes_rate")),
        "log_volume": F.log1p(F.greatest(zero_if_null("avg_volume"), F.lit(-0.999999))),
        "relationship_score": F.when(F.col("domain").isin(related), 1.0).otherwise(0.35),
    })
    rated = cut_lineage(rated)
    most = F.nullif(rated.agg(F.max("panel_ready_markets")).scalar(), F.lit(0))
    rated = minmax(rated, "log_volume", "liquidity_score").withColumn("panel_ready_score", F.col("panel_ready_markets") / most)
    return rated.withColumn("usefulness_score", weighted(FAMILY_WEIGHTS)).orderBy(F.desc("usefulness_score"))


def candidate_membership(markets: DataFrame, specs: list[dict]) -> DataFrame:
    """Markets of each universe, by domain and family lists, without flagged sources."""
    rows = [F.struct(
        F.lit(s["universe"]).alias("universe"), F.lit(len(s["domains"])).alias("requested_domains"),
        F.array(*[F.lit(x) for x in s["domains"]]).alias("domains"),
        F.array(*[F.lit(x) for x in s.get("families", [])]).cast("array<string>").alias("families")) for s in specs]
    wide = markets.where(~F.col("excluded")).withColumn("spec", F.explode(F.array(*rows)))
    fits = F.expr("array_contains(spec.domains, domain) AND (size(spec.families) = 0 OR array_contains(spec.families, family))")
    return wide.where(fits).select("*", "spec.universe", "spec.requested_domains").drop("spec")


def candidate_summary(markets: DataFrame, hourly: DataFrame, filled: DataFrame, specs: list[dict], min_hours: int = 24,
                      compressibility: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Size, balance, coverage, correlation and component scores of each universe, best first.

    `compressibility` tells (universe, pc_90) of all universes' panels (universe, ts, market_id, p) together; without it that part counts as zero.
    """
    members = candidate_membership(markets, specs)
    meta = members.groupBy("universe").agg(F.count("*").alias("metadata_market_count"))
    parts, corrs = [], []
    for s in specs:
        ids = members.where(F.col("universe") == s["universe"]).where("in_panel").select("market_id")
        cells = cut_lineage(P.overlap_panel(J.semi(filled, ids, "market_id"), J.semi(hourly, ids, "market_id")))
        parts.append(cells.withColumn("universe", F.lit(s["universe"])))
        corr = G.correlation_summary(cells, min_hours)
        corrs.append(corr.withColumn("universe", F.lit(s["universe"])))
    panel = parts[0]
    corr = corrs[0]
    for more, c in zip(parts[1:], corrs[1:]):
        panel, corr = panel.unionByName(more), corr.unionByName(c)
    rows = panel.groupBy("universe", "ts").agg(F.count("*").alias("n")).groupBy("universe").agg(
        F.count("*").alias("timestamp_count"), F.sum("n").alias("cells"), F.median("n").alias("active_market_median"),
        F.min("ts").alias("timestamp_min"), F.max("ts").alias("timestamp_max"))
    kept = panel.select("universe", "market_id").distinct().join(members, ["universe", "market_id"]).groupBy("universe").agg(
        F.count("*").alias("panel_market_count"), F.avg("y").alias("yes_rate"), F.avg("volume").alias("avg_volume"),
        F.avg(zero_if_null("volume")).alias("volume0"), F.countDistinct("family").alias("family_count"),
        F.countDistinct("domain").alias("domain_count"), F.max("requested_domains").alias("requested_domain_count"))
    out = meta.join(rows, "universe").join(kept, "universe").join(corr, "universe")
    if compressibility is not None:
        out = out.join(compressibility(panel.select("universe", "ts", "market_id", "p")), "universe", "left")
    else:
        out = out.withColumn("pc_90", F.lit(None).cast("int"))
    size = F.col("timestamp_count") * F.col("panel_market_count")
    out = cut_lineage(out.withColumns({
        "class_entropy": binary_entropy("yes_rate"),
        "panel_missingness": 1 - F.col("cells") / size,
        "avg_market_coverage": F.col("cells") / size,
        "requested_domain_coverage": F.col("domain_count") / F.col("requested_domain_count"),
        "balance_score": balance_score(F.col("yes_rate")),
        "liquidity_raw": F.log1p(F.greatest(F.col("volume0"), F.lit(-0.999999))),
        "coverage_score": F.greatest(F.lit(0.0), F.col("cells") / size),
        "compressibility_score": F.coalesce(1 - F.col("pc_90") / F.col("panel_market_count"), F.lit(0.0)),
        "relationship_score": 0.5 * F.least(F.lit(1.0), F.col("family_count") / 8)
        + 0.5 * F.col("domain_count") / F.col("requested_domain_count"),
    }))
    return minmax(out, "liquidity_raw", "liquidity_score").withColumn(
        "overall_score", weighted(UNIVERSE_WEIGHTS)).orderBy(F.desc("overall_score"))


def missingness_decomposition(cells: DataFrame, raw: DataFrame, mask: DataFrame, index: DataFrame, columns: DataFrame) -> DataFrame:
    """How much of a panel is missing because a market was not live, and how much for want of data."""
    flag = lambda df, f, r, m: df.select("ts", "market_id", F.lit(f).alias("f"), F.lit(r).alias("r"), F.lit(m).alias("m"))
    merged = flag(cells, 1, 0, 0).unionAll(flag(raw, 0, 1, 0)).unionAll(flag(mask, 0, 0, 1)).groupBy("ts", "market_id").agg(
        F.max("f").alias("f"), F.max("r").alias("r"), F.max("m").alias("m"))
    total = index.agg(F.count("*")).scalar() * columns.select("market_id").distinct().agg(F.count("*")).scalar()
    c = merged.agg(
        F.sum("f").alias("observed_filled_cells"), F.sum("r").alias("raw_observed_cells"), F.sum("m").alias("active_cells"),
        F.count_if(F.expr("f = 1 OR m = 1")).alias("either"), F.count_if(F.expr("m = 1 AND f = 0")).alias("data_missing_cells"),
        F.count_if(F.expr("m = 1 AND r = 0")).alias("active_raw_missing_cells"),
    ).withColumn("total_cells", total)
    c = c.withColumns({
        "missing_cells": F.col("total_cells") - F.col("observed_filled_cells"),
        "structural_missing_cells": F.col("total_cells") - F.col("either"),
    })
    t, miss, act = (F.greatest(F.col(x), F.lit(1)) for x in ("total_cells", "missing_cells", "active_cells"))
    return c.select(
        "total_cells", "observed_filled_cells", "raw_observed_cells", "missing_cells", (F.col("missing_cells") / t).alias("overall_missingness"),
        "structural_missing_cells", "data_missing_cells", "active_raw_missing_cells",
        (F.col("structural_missing_cells") / t).alias("structural_missing_fraction_of_all"),
        (F.col("data_missing_cells") / t).alias("data_missing_fraction_of_all"),
        (F.col("structural_missing_cells") / miss).alias("structural_share_of_missing"),
        (F.col("data_missing_cells") / miss).alias("data_share_of_missing"),
        (F.col("active_raw_missing_cells") / act).alias("raw_sparsity_within_active"),
        (F.col("data_missing_cells") / act).alias("filled_missing_within_active"))


def constrained_universes(average: DataFrame, lives: G.Lifetimes, cells: DataFrame, mask: DataFrame, index: DataFrame, markets: DataFrame,
                          thresholds: dict[str, float], compressibility: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every universe of markets whose average overlap reaches a threshold, summarised in one job; `compressibility` adds pc_90 as above."""
    opts = F.array(*[F.struct(F.lit(n).alias("universe"), F.lit(float(t)).alias("t")) for n, t in thresholds.items()])
    keep = average.withColumn("o", F.explode(opts)).where(F.col("average_overlap") >= F.col("o.t")).select("o.universe", "market_id")
    keep = cut_lineage(keep)
    size = keep.join(markets.select("market_id", "y"), "market_id").groupBy("universe").agg(
        F.count("*").alias("market_count"), F.avg("y").alias("yes_rate"))
    filled = keep.join(cells, "market_id").groupBy("universe").agg(F.count("p").alias("cells"))
    hours = index.withColumn("universe", F.explode(F.array(*[F.lit(n) for n in thresholds])))
    live = keep.join(mask, "market_id").groupBy("universe", "ts").agg(F.count("*").alias("n"))
    active = hours.join(live, ["universe", "ts"], "left").withColumn("n", F.coalesce("n", F.lit(0))).groupBy("universe").agg(
        F.count("*").alias("hours"), F.avg("n").alias("mean_active_markets"), F.median("n").alias("median_active_markets"))
    inside = cut_lineage(lives.counts(keep))
    seen = inside.groupBy("universe").agg(F.sum("weight").alias("seen"), F.sum(F.col("overlap") * F.col("weight")).alias("total"), F.min("overlap").alias("lo"), F.max("overlap").alias("hi"))
    n_pairs = (F.col("market_count") * (F.col("market_count") - 1) / 2).cast("long")
    base = size.join(seen, "universe", "left").withColumn("pairs", n_pairs)
    zeros = base.select("universe", F.lit(0.0).alias("overlap"), (F.col("pairs") - F.coalesce("seen", F.lit(0))).alias("weight")).where("weight > 0")
    middle = ordered.quantiles(inside.unionByName(zeros), ["universe"], "overlap", {"median_pairwise_overlap": 0.5}, "weight")
    out = base.join(filled, "universe").join(active, "universe").join(middle, "universe", "left")
    some = F.nullif(F.col("pairs"), F.lit(0))
    more = []
    if compressibility is not None:
        out = out.join(compressibility(keep.join(cells, "market_id").select("universe", "ts", "market_id", "p")), "universe", "left")
        more = ["pc_90"]
    return out.select(
        "universe", *more, "market_count", "yes_rate", binary_entropy("yes_rate").alias("class_entropy"),
        (1 - F.col("cells") / (F.col("hours") * F.col("market_count"))).alias("panel_missingness"),
        "median_active_markets", "mean_active_markets", (zero_if_null("total") / some).alias("mean_pairwise_overlap"),
        "median_pairwise_overlap",
        F.when(F.coalesce("seen", F.lit(0)) < F.col("pairs"), 0.0).otherwise(F.col("lo")).alias("min_pairwise_overlap"),
        F.col("hi").alias("max_pairwise_overlap"))


def choice_scores(candidates: DataFrame, min_markets: int = 25) -> DataFrame:
    """The viable universes with the parts of their score; without pc_90 the latent part counts as zero."""
    return candidates.where(F.col("market_count") >= min_markets).withColumns({
        "balance_score": balance_score(F.col("yes_rate")),
        "missingness_score": F.greatest(F.lit(0.0), 1 - F.col("panel_missingness")),
        "market_score": F.least(F.lit(1.0), F.col("market_count") / 100),
        "latent_score": F.greatest(F.lit(0.0), 1 - F.col("pc_90") / F.col("market_count")) if "pc_90" in candidates.columns else F.lit(0.0),
    }).withColumn("score", weighted(CHOICE_WEIGHTS))


def recommend_universe(candidates: DataFrame, letters: dict[str, str], unconstrained: str, min_markets: int = 25) -> DataFrame:
    """Letter of the best viable universe; "A" when no constrained one is viable."""
    scored = choice_scores(candidates, min_markets)
    best = scored.agg(
        F.max_by("universe", F.struct(F.round("score", 9), (-F.col("market_count")).alias("m"), "universe")).alias("universe"),
        F.count_if(F.col("universe") != unconstrained).alias("constrained"))
    letter = F.lit("A")
    for name, code in letters.items():
        letter = F.when(F.col("universe") == name, code).otherwise(letter)
    return best.select(F.when(F.col("constrained") == 0, "A").otherwise(letter).alias("recommendation"))


def lifetime_summary(lifetimes: DataFrame, average: DataFrame) -> DataFrame:
    rows = lifetimes.join(average, "market_id").withColumn("days", F.col("active_duration_hours") / 24.0)
    by = ["domain", "family", "y"]
    sizes = rows.groupBy(*by).agg(F.count("*").alias("markets"), F.avg("average_overlap").alias("mean_overlap"))
    days = ordered.quantiles(rows, by, "days", {"median_days": 0.5})
    hours = ordered.quantiles(rows, by, "observed_hours", {"median_observed_hours": 0.5})
    return sizes.join(days, by).join(hours, by)


def class_balance(rows: DataFrame, core: list[str], satellites: list[str]) -> DataFrame:
    """Yes counts and rates, per market and per row, overall and by family, domain, fold, panel and place in the panel.

    `rows` has market_id, y, family, domain, fold; one grouping over exploded slices.
    """
    in_core, beside = F.coalesce(F.col("family").isin(core), F.lit(False)), F.coalesce(F.col("family").isin(satellites), F.lit(False))
    place = F.when(in_core, "core").when(beside, "satellite").otherwise("other")
    slice_of = lambda k, v: F.struct(F.lit(k).alias("slice_type"), v.alias("slice_value"))
    panels = [slice_of("core_satellite", place), slice_of("panel", F.when(in_core, F.lit("core"))), slice_of("panel", F.when(in_core | beside, F.lit("core_plus_satellites")))]
    slices = F.array(*[F.struct(F.lit(k).alias("slice_type"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("slice_value"))
                       for k, c in (("family", "family"), ("domain", "domain"), ("fold", "fold"))],
                     slice_of("overall", F.lit("overall")), *panels)
    tally = rows.withColumn("s", F.explode(slices)).where("s.slice_value IS NOT NULL").groupBy("s.slice_type", "s.slice_value", "market_id").agg(
        F.max("y").alias("y"), F.count("*").alias("n"), F.sum("y").alias("yes"))
    return tally.groupBy("slice_type", "slice_value").agg(
        F.count("*").alias("markets"), F.sum("y").alias("yes_markets"), F.avg("y").alias("market_yes_rate"),
        F.sum("n").alias("rows"), F.sum("yes").alias("yes_rows"), (F.sum("yes") / F.sum("n")).alias("row_yes_rate"))


def feature_missingness(df: DataFrame, features: list[str]) -> DataFrame:
    shares = df.agg(*[F.avg(F.col(f).isNull().cast("int")).alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("null_share")) for f in features])
    return shares.select(F.explode(pairs).alias("r")).select("r.*").orderBy(F.desc("null_share"), "feature")
