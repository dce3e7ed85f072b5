"""Panels of hourly prices, kept long: one row per (ts, market_id) that has a value.

A forward fill is written as intervals: each observation holds until the hour before the next
one, so only the sparse observations are shuffled and hours are generated afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions import ordered
from tidepanel.functions.scalars import probability_clip
from tidepanel.session import cut_lineage

#: Markets side by side in one row of the wide form.
PIVOT_WIDTH = 64


def floor_to(ts, unit: str = "hour") -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def ceil_hour(ts) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    low = floor_to(ts)
    return F.when(ts > low, low + hours(1)).otherwise(low)


def hours(n: int) -> Column:
    return F.expr(f"interval {int(n)} hour")


# --- from ticks to a panel -------------------------------------------------------------------


def bucket_last(prices: DataFrame, unit: str = "hour", tiebreak: tuple[str, ...] = ("source", "event_id")) -> DataFrame:
    """Last price of each market in each bucket; equal instants go to the largest tie-break."""
    usable = prices.where(F.col("ts").isNotNull() & F.col("market_id").isNotNull() & F.col("p").isNotNull())
    last = F.max_by("p", F.struct("ts", *tiebreak))
    return usable.groupBy(floor_to("ts", unit).alias("ts"), "market_id").agg(last.alias("p"))


def span(hourly: DataFrame) -> Column:
    """First and last bucket of a panel as one scalar struct (lo, hi)."""
    return hourly.agg(F.struct(F.min("ts").alias("lo"), F.max("ts").alias("hi")).alias("s")).scalar()


def hour_index(hourly: DataFrame) -> DataFrame:
    """Every hour from the first bucket to the last."""
    ends = hourly.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return ends.select(F.explode(F.sequence("lo", "hi", hours(1))).alias("ts"))


def continuous_grid(hourly: DataFrame) -> DataFrame:
    """Every market at every hour between the first and last bucket, null where unobserved."""
    ends = span(hourly)
    cells = hourly.select("market_id").distinct().select(
        "market_id", F.explode(F.sequence(ends["lo"], ends["hi"], hours(1))).alias("ts")
    )
    return cells.join(hourly, ["market_id", "ts"], "left").select("ts", "market_id", "p")


def pivot_panel(cells: DataFrame, ids: list) -> DataFrame:
    """Wide form for a bounded list of markets."""
    return cells.where(F.col("market_id").isin(ids)).groupBy("ts").pivot("market_id", ids).agg(F.first("p"))


def active_windows(hourly: DataFrame, markets: DataFrame, close: str = "close_ts", end: str | None = None) -> DataFrame:
    """Hours a market counts as active: the later of first price and start, to close (else end).

    A market without either bound gets no row and is never active.
    """
    stop = F.coalesce(F.col(close), F.col(end)) if end else F.col(close)
    first = hourly.groupBy("market_id").agg(F.min("ts").alias("first_ts"))
    return (
        first.join(markets.select("market_id", "start_ts", stop.alias("stop_ts")), "market_id")
        .select(
            "market_id",
            floor_to(F.greatest("first_ts", "start_ts")).alias("active_start"),
            ceil_hour(F.col("stop_ts")).alias("active_end"),
        )
        .where(F.col("active_start").isNotNull() & F.col("active_end").isNotNull())
    )


def holding_intervals(hourly: DataFrame) -> DataFrame:
    """Each bucket with the next bucket of its market; a market has at most one row per hour."""
    by_market = W.partitionBy("market_id").orderBy("ts")
    return hourly.withColumn("next_ts", F.lead("ts").over(by_market))


def forward_fill(hourly: DataFrame, windows: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Carry each price forward, at most `limit` hours, and keep the hours inside the windows."""
    hi = span(hourly)["hi"]
    held = holding_intervals(hourly).withColumn("stop", F.coalesce(F.col("next_ts") - hours(1), hi))
    if limit is not None:
        held = held.withColumn("stop", F.least("stop", F.col("ts") + hours(limit)))
    start = F.col("ts")
    if windows is not None:
        held = held.join(windows, "market_id")
        start = F.greatest(F.col("ts"), F.col("active_start"))
        held = held.withColumn("stop", F.least("stop", "active_end"))
    held = held.withColumn("start", start).where(F.col("start") <= F.col("stop"))
    return held.select(F.explode(F.sequence("start", "stop", hours(1))).alias("ts"), "market_id", "p")


def active_ffill(hourly: DataFrame, windows: DataFrame, limit: int | None = None) -> DataFrame:
    return forward_fill(hourly, windows, limit)


def dense_fill(hourly: DataFrame, bfill: bool = False, default: float = 0.5) -> DataFrame:
    """Every market at every hour: forward fill, then back fill if asked, then the default.

    Back filling shows later prices to earlier hours, so it is off unless asked for.
    """
    ends = span(hourly)
    held = holding_intervals(hourly).withColumn("stop", F.coalesce(F.col("next_ts") - hours(1), ends["hi"]))
    first = W.partitionBy("market_id").orderBy("ts")
    held = held.withColumn("is_first", F.row_number().over(first) == 1)
    lead_in = F.when(F.col("is_first") & (F.col("ts") > ends["lo"]), F.struct(
        ends["lo"].alias("start"), (F.col("ts") - hours(1)).alias("stop"),
        (F.col("p") if bfill else F.lit(float(default))).alias("p"),
    ))
    own = F.struct(F.col("ts").alias("start"), F.col("stop"), F.col("p"))
    pieces = held.select("market_id", F.explode(F.array_compact(F.array(lead_in, own))).alias("s"))
    return pieces.select(F.explode(F.sequence("s.start", "s.stop", hours(1))).alias("ts"), "market_id", "s.p")


# --- describing and narrowing a panel --------------------------------------------------------


def panel_stats(cells: DataFrame, index: DataFrame, columns: DataFrame) -> DataFrame:
    """Shape, missing share, span and active counts of the panel `cells` over its index and columns."""
    n_cols = columns.select("market_id").distinct().agg(F.count("*")).scalar()
    counts = index.join(cells.groupBy("ts").agg(F.count("p").alias("n")), "ts", "left").select(
        "ts", F.coalesce("n", F.lit(0)).alias("n")
    )
    out = counts.agg(
        F.count("*").alias("timestamp_count"),
        F.sum("n").alias("cells"),
        F.min("ts").alias("timestamp_min"),
        F.max("ts").alias("timestamp_max"),
        F.min("n").alias("active_market_min"),
        F.median("n").alias("active_market_median"),
        F.max("n").alias("active_market_max"),
    ).withColumn("market_count", n_cols)
    size = F.nullif(F.col("timestamp_count") * F.col("market_count"), F.lit(0))
    return out.withColumn("missingness", 1 - F.col("cells") / size).drop("cells")


def market_places(cells: DataFrame, width: int = PIVOT_WIDTH) -> DataFrame:
    """(market_id, block, place) of every market of the cells, in an order by digest cut into blocks of `width` places."""
    key = F.md5(F.col("market_id").cast("string"))
    ids = cells.select("market_id").where(F.col("market_id").isNotNull()).distinct()
    ids = ids.withColumns({"key": key, "one": F.lit(1)})
    rank = F.col("one_upto") - 1
    return ordered.running_sum(ids, [], [F.col("key"), F.col("market_id")], ["one"]).select(
        "market_id", F.floor(rank / width).cast("long").alias("block"), (rank % width).cast("int").alias("place"))


def pivot_blocks(cells: DataFrame, places: DataFrame, width: int = PIVOT_WIDTH) -> DataFrame:
    """Wide form of all markets, one row per block and hour with a price: `values[place]` is a market's price, null where it has none."""
    spots = list(range(width))
    wide = cells.join(places, "market_id").groupBy("block", "ts").pivot("place", spots).agg(F.first("p"))
    return wide.select("block", "ts", F.array(*[F.col(str(i)) for i in spots]).alias("values"))


def busy_rows(cells: DataFrame, min_active: int) -> DataFrame:
    """Cells of the hours that have at least `min_active` values."""
    keep = cells.groupBy("ts").agg(F.count("p").alias("n")).where(F.col("n") >= min_active).select("ts")
    return cells.join(keep, "ts", "left_semi")


def coverage_rank(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Rank of each column by number of values, most first, ties by id."""
    n = columns.select("market_id").distinct().join(
        cells.groupBy("market_id").agg(F.count("p").alias("n")), "market_id", "left"
    ).select("market_id", F.coalesce("n", F.lit(0)).alias("n"), F.lit(1).alias("one"))
    return ordered.running_sum(n, [], [-F.col("n"), F.col("market_id")], ["one"]).select(
        "market_id", "n", F.col("one_upto").alias("rank")
    )


def strict_panel(
    cells: DataFrame, columns: DataFrame, min_active: int, min_markets: int, max_missingness: float
) -> DataFrame:
    """The widest prefix of best-covered columns whose busy rows stay under the missing share.

    One pass: a row joins prefix m once its `min_active`-th best column is inside it, so prefix
    sizes only need the running sums of two counts per column rank. Every row of such a prefix
    has at least `min_active` values, so its median does too. With no passing prefix the first
    `min_markets` columns are kept on all busy rows.
    """
    busy = cut_lineage(busy_rows(cells, min_active))
    ranks = cut_lineage(coverage_rank(busy, columns))
    by_row = W.partitionBy("ts").orderBy("rank")
    placed = cut_lineage(
        busy.join(ranks.select("market_id", "rank"), "market_id").withColumn("ordinal", F.row_number().over(by_row)))
    joins_at = F.when(F.col("ordinal") == min_active, 1).otherwise(0)
    gains = F.when(F.col("ordinal") == min_active, min_active).when(F.col("ordinal") > min_active, 1).otherwise(0)
    steps = ranks.select("rank").join(
        placed.groupBy("rank").agg(F.sum(joins_at).alias("rows"), F.sum(gains).alias("cells")), "rank", "left"
    ).na.fill(0)
    prefixes = ordered.running_sum(steps, [], [F.col("rank")], ["rows", "cells"])
    missing = 1 - F.col("cells_upto") / F.nullif(F.col("rows_upto") * F.col("rank"), F.lit(0))
    best = prefixes.where(
        (F.col("rank") >= min_markets) & (F.col("rows_upto") > 0) & (missing <= max_missingness)
    ).agg(F.max("rank")).scalar()
    kept = placed.withColumn("best", best).where(F.col("rank") <= F.coalesce("best", F.lit(min_markets)))
    enough = kept.groupBy("ts").agg(F.count("*").alias("n"), F.max("best").alias("b")).where(
        F.col("b").isNull() | (F.col("n") >= min_active)
    ).select("ts")
    return kept.join(enough, "ts", "left_semi").select("ts", "market_id", "p")


def add_optional_columns(base: DataFrame, optional: DataFrame, columns: DataFrame, max_missingness: float) -> DataFrame:
    """Append optional columns by coverage on the base rows while the missing share stays in bounds.

    Coverage only falls along the order, so the first column that fails ends the search.
    """
    rows = base.select("ts").distinct()
    extra = cut_lineage(optional.join(rows, "ts", "left_semi"))
    shape = base.agg(F.struct(
        F.count("p").alias("cells"), F.countDistinct("ts").alias("rows"), F.countDistinct("market_id").alias("cols")
    )).scalar()
    run = ordered.running_sum(coverage_rank(extra, columns), [], [F.col("rank")], ["n"])
    missing = 1 - (shape["cells"] + F.col("n_upto")) / F.nullif(shape["rows"] * (shape["cols"] + F.col("rank")), F.lit(0))
    run = run.withColumn("fails", missing > max_missingness)
    first_fail = run.where("fails").agg(F.min("rank")).scalar()
    chosen = run.withColumn("stop", first_fail).where(F.col("stop").isNull() | (F.col("rank") < F.col("stop")))
    return base.select("ts", "market_id", "p").unionByName(
        extra.join(chosen.select("market_id"), "market_id", "left_semi").select("ts", "market_id", "p")
    )


def overlap_panel(cells: DataFrame, columns: DataFrame, min_coverage: float = 0.05) -> DataFrame:
    """Hours with enough active markets (a quarter of them, between 5 and 20), then covered columns."""
    n_cols = columns.select("market_id").distinct().agg(F.count("*")).scalar()
    need = F.greatest(F.lit(5), F.least(F.lit(20), F.floor(n_cols * 0.25)))
    keep = cells.groupBy("ts").agg(F.count("p").alias("n")).where(F.col("n") >= need).select("ts")
    subset = cells.join(keep, "ts", "left_semi")
    n_rows = subset.agg(F.countDistinct("ts")).scalar()
    cover = subset.groupBy("market_id").agg((F.count("p") / n_rows).alias("coverage"))
    best = cover.agg(F.max("coverage")).scalar()
    good = cover.where((F.col("coverage") >= min_coverage) | (best < min_coverage)).select("market_id")
    return subset.join(good, "market_id", "left_semi").select("ts", "market_id", "p")


# --- lifetimes -------------------------------------------------------------------------------


def market_lifetimes(hourly: DataFrame, markets: DataFrame, end: str | None = None) -> DataFrame:
    """Earliest of start and first price to latest of close, end and last price, with durations."""
    seen = hourly.groupBy("market_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("p").alias("observed_hours")
    )
    ends = [F.col("close_ts"), F.col("last_ts")] + ([F.col(end)] if end else [])

    def gap(a: str, b: str) -> Column:
        seconds = F.unix_timestamp(F.col(b).cast("timestamp")) - F.unix_timestamp(F.col(a).cast("timestamp"))
        return seconds / 3600.0

    return (
        seen.join(markets, "market_id")
        .withColumn("active_start", F.least("start_ts", "first_ts"))
        .withColumn("active_end", F.greatest(*ends))
        .withColumn("active_duration_hours", gap("active_start", "active_end"))
        .withColumn("observed_duration_hours", gap("first_ts", "last_ts"))
    )


def lifetime_mask(lifetimes: DataFrame, index: DataFrame) -> DataFrame:
    """Hours of the index inside each market's lifetime."""
    ends = index.agg(F.struct(F.min("ts").alias("lo"), F.max("ts").alias("hi")).alias("s")).scalar()
    bounds = lifetimes.where("active_start IS NOT NULL AND active_end IS NOT NULL").select(
        "market_id",
        F.greatest(floor_to("active_start"), ends["lo"]).alias("a"),
        F.least(ceil_hour("active_end"), ends["hi"]).alias("b"),
    ).where("a <= b")
    return bounds.select(F.explode(F.sequence("a", "b", hours(1))).alias("ts"), "market_id")


# --- modelling rows --------------------------------------------------------------------------


def supervised_rows(cells: DataFrame, markets: DataFrame) -> DataFrame:
    """One labelled row per active cell, with the number of active markets at its hour."""
    counts = cells.groupBy("ts").agg(F.count("*").alias("n_active"))
    meta = markets.where(F.col("y").isNotNull()).select("market_id", "y", "domain", "family", "volume")
    return (
        cells.where(F.col("p").isNotNull())
        .join(counts, "ts")
        .join(meta, "market_id")
        .select("ts", "market_id", probability_clip("p").alias("p"), "n_active", "y", "domain", "family", "volume")
    )


def family_state(cells: DataFrame, markets: DataFrame) -> DataFrame:
    """Mean, median, population deviation and count of active prices per hour and family."""
    tagged = cells.join(markets.select("market_id", "family"), "market_id").where("family IS NOT NULL")
    moments = tagged.groupBy("ts", "family").agg(
        F.avg("p").alias("mean"),
        F.coalesce(F.stddev_pop("p"), F.lit(0.0)).alias("std"),
        F.count("p").alias("n"),
    )
    middle = ordered.quantiles(tagged, ["ts", "family"], "p", {"median": 0.5})
    return moments.join(middle, ["ts", "family"]).select("ts", "family", "mean", "median", "std", "n")


def family_state_wide(state: DataFrame, families: list[str]) -> DataFrame:
    """The state vector of each hour: four columns per family, families being a bounded list."""
    wide = state.groupBy("ts").pivot("family", families).agg(
        F.first("mean").alias("mean"), F.first("median").alias("median"),
        F.first("std").alias("std"), F.first("n").alias("count"),
    )
    fill = {f"{f}_{c}": 0.0 for f in families for c in ("std", "count")}
    return wide.na.fill(fill)


def timestamp_metadata(cells: DataFrame, markets: DataFrame) -> DataFrame:
    return cells.join(markets.select("market_id", "family"), "market_id", "left").groupBy("ts").agg(
        F.count("p").alias("active_market_count"),
        F.countDistinct("family").alias("active_family_count"),
        F.avg("p").alias("average_market_probability"),
    )


def shift_join(rows: DataFrame, cells: DataFrame, offset_hours: int, name: str) -> DataFrame:
    """Price of the same market `offset_hours` later, as column `name`."""
    later = cells.select((F.col("ts") - hours(offset_hours)).alias("ts"), "market_id", F.col("p").alias(name))
    return rows.join(later, ["ts", "market_id"], "left")


def future_targets(rows: DataFrame, cells: DataFrame, horizons: tuple[int, ...] = (24, 72), legacy: bool = False) -> DataFrame:
    """Moves over each horizon and errors against the outcome; an unknown future stays null unless `legacy`."""
    out = rows
    for h in horizons:
        out = shift_join(out, cells, h, f"future_price_{h}h")
        move = F.abs(F.col(f"future_price_{h}h") - F.col("p"))
        large = (F.coalesce(move, F.lit(0.0)) if legacy else move) >= 0.10
        out = out.withColumn(f"abs_move_{h}h", move).withColumn(f"large_move_{h}h", large.cast("int"))
    error = F.abs(F.col("p") - F.col("y"))
    return out.withColumns({
        "abs_error": error,
        "squared_error": error * error,
        "miscalibrated": (error >= 0.25).cast("int"),
    })


def window_members(rows: DataFrame, window: int, stride: int, ends: DataFrame | None = None) -> DataFrame:
    """Each row once per trailing window that holds it, tagged with the window's last hour.

    Windows end at hours of day divisible by the stride; a row meets window/stride of them.
    """
    hour = F.hour("ts")
    first = F.col("ts") + F.make_dt_interval(F.lit(0), (F.lit(stride) - hour % stride) % stride)
    last = F.col("ts") + hours(window - 1)
    marked = rows.withColumn("first_end", first).where(F.col("first_end") <= last)
    if 24 % stride == 0:
        out = marked.withColumn("window_end", F.explode(F.sequence("first_end", last, hours(stride))))
    else:
        out = marked.withColumn("window_end", F.explode(F.sequence("ts", last, hours(1))))
        out = out.where(F.hour("window_end") % stride == 0)
    out = out.drop("first_end")
    return out.join(ends, "window_end", "left_semi") if ends is not None else out


def window_ends(index: DataFrame, window: int, stride: int) -> DataFrame:
    """Hours that close a full trailing window inside the index."""
    lo = index.agg(F.min("ts")).scalar()
    return index.where((F.hour("ts") % stride == 0) & (F.col("ts") >= lo + hours(window - 1))).select(
        F.col("ts").alias("window_end")
    )


# --- stress grid -----------------------------------------------------------------------------


def stress_grid(
    prices: DataFrame, markets: DataFrame, min_points: list[int], limits: dict[str, int | None],
    panels: dict[str, list[str]],
) -> DataFrame:
    """Panel statistics for every minimum number of points, fill limit and group of families."""
    hourly = cut_lineage(bucket_last(prices))
    sizes = prices.groupBy("market_id").agg(F.count("*").alias("points"))
    held = holding_intervals(hourly).join(sizes, "market_id")
    trial = held.withColumn("min_points", F.explode(F.array([F.lit(m) for m in min_points]))).where("points >= min_points")
    spans = trial.groupBy("min_points").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    windows = active_windows(hourly, markets)
    named = [F.struct(F.lit(n).alias("fill_limit"), F.lit(v).cast("int").alias("limit_hours")) for n, v in limits.items()]
    groups = [F.struct(F.lit(n).alias("panel"), F.array([F.lit(f) for f in fams]).alias("families")) for n, fams in panels.items()]

    members = trial.select("min_points", "market_id").distinct().join(markets.select("market_id", "family"), "market_id")
    cols = (
        members.withColumn("g", F.explode(F.array(groups)))
        .where(F.expr("array_contains(g.families, family)"))
        .groupBy("min_points", F.col("g.panel").alias("panel"))
        .agg(F.count("*").alias("market_count"))
    )
    cells = (
        trial.join(spans, "min_points").join(windows, "market_id").join(markets.select("market_id", "family"), "market_id")
        .withColumn("l", F.explode(F.array(named)))
        .withColumn("start", F.greatest("ts", "active_start"))
        .withColumn("stop", F.least(
            F.coalesce(F.col("next_ts") - hours(1), F.col("hi")), "active_end",
            F.col("ts") + F.make_dt_interval(F.lit(0), F.col("l.limit_hours")),
        ))
        .where("start <= stop")
        .withColumn("g", F.explode(F.array(groups)))
        .where(F.expr("array_contains(g.families, family)"))
        .select("min_points", "l.fill_limit", "g.panel", F.explode(F.sequence("start", "stop", hours(1))).alias("ts"))
        .groupBy("min_points", "fill_limit", "panel", "ts").agg(F.count("*").alias("n"))
    )
    index = (
        spans.withColumn("ts", F.explode(F.sequence("lo", "hi", hours(1))))
        .withColumn("fill_limit", F.explode(F.array([F.lit(n) for n in limits])))
        .join(cols, "min_points")
    )
    key = ["min_points", "fill_limit", "panel"]
    stats = index.join(cells, [*key, "ts"], "left").withColumn("n", F.coalesce("n", F.lit(0))).groupBy(*key).agg(
        F.count("*").alias("timestamp_count"), F.max("market_count").alias("market_count"),
        F.sum("n").alias("cells"), F.min("n").alias("active_market_min"),
        F.median("n").alias("active_market_median"), F.max("n").alias("active_market_max"),
    )
    return stats.withColumn("missingness", 1 - F.col("cells") / (F.col("timestamp_count") * F.col("market_count"))).drop("cells")
