"""Chronological folds, placebo features and model selection tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions import ordered
from tidepanel.operators import panel as P


def _stamp(index: DataFrame, cuts: DataFrame, names: list[str]) -> DataFrame:
    """Replace the row positions of a small fold table by timestamps, in one join."""
    spots = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("idx")) for n in names])
    long = cuts.select("fold", F.explode(spots).alias("s")).select("fold", "s.name", "s.idx")
    placed = long.join(index, "idx").groupBy("fold").agg(*[F.max(F.when(F.col("name") == n, F.col("ts"))).alias(n) for n in names])
    return placed


NAMES = ["train_start", "train_end", "test_start", "test_end"]


def chronological_folds(stamps: DataFrame, initial: float = 0.60, test: int = 336, step: int = 336, min_test: int = 168) -> DataFrame:
    """Expanding-train folds over the distinct timestamps, dropping a last test that is too short."""
    index = ordered.dense_index(stamps)
    n = index.agg(F.count("*").alias("n"))
    starts = n.select("n", F.floor(F.col("n") * initial).alias("first")).where("first < n").select(
        "n", "first", F.explode(F.sequence("first", F.col("n") - 1, F.lit(step).cast("long"))).alias("s"))
    stop = F.least(F.col("s") + test, F.col("n"))
    cuts = starts.withColumn("stop", stop).where(F.col("stop") - F.col("s") >= min_test).select(
        ((F.col("s") - F.col("first")) / step + 1).cast("int").alias("fold"),
        F.lit(0).alias("train_start"), (F.col("s") - 1).alias("train_end"), F.col("s").alias("test_start"), (F.col("stop") - 1).alias("test_end"))
    return _stamp(index, cuts, NAMES)


def locked_holdout(stamps: DataFrame, fraction: float = 0.20) -> DataFrame:
    """The last share of the timestamps, held out as fold 999."""
    index = ordered.dense_index(stamps)
    n = index.agg(F.count("*").alias("n")).withColumn("cut", F.floor(F.col("n") * (1.0 - fraction))).where("cut > 0 AND cut < n")
    cuts = n.select(F.lit(999).alias("fold"), F.lit(0).alias("train_start"), (F.col("cut") - 1).alias("train_end"),
                    F.col("cut").alias("test_start"), (F.col("n") - 1).alias("test_end"))
    return _stamp(index, cuts, NAMES)


def inner_validation(stamps: DataFrame, folds: DataFrame, fraction: float = 0.20, min_train: int = 720, min_val: int = 168) -> DataFrame:
    """The last share of each fold's training rows as its validation part."""
    index = ordered.dense_index(stamps)
    ends = folds.select("fold", F.col("train_end").alias("ts")).join(index, "ts").select("fold", (F.col("idx") + 1).alias("n"))
    split = F.greatest(F.lit(min_train), F.least(F.floor(F.col("n") * (1.0 - fraction)), F.col("n") - min_val))
    cuts = ends.withColumn("cut", split).where("cut > 0 AND cut < n").select(
        "fold", F.lit(0).alias("train_start"), (F.col("cut") - 1).alias("train_end"), F.col("cut").alias("test_start"),
        (F.col("n") - 1).alias("test_end"))
    return _stamp(index, cuts, NAMES)


def supervised_fold_rows(rows: DataFrame, members: DataFrame, markets: DataFrame, folds: DataFrame, known_labels_only: bool) -> DataFrame:
    """Rows of every fold and split; training may be held to markets already closed at its end."""
    out = rows.join(members, "ts")
    if known_labels_only:
        closed = markets.select("market_id", "close_ts")
        out = out.join(closed, "market_id").join(folds.select("fold", "train_end"), "fold")
        out = out.where((F.col("split") == "test") | (F.col("close_ts") <= F.col("train_end"))).drop("close_ts", "train_end")
    return out


def fold_feature_columns(cells: DataFrame, members: DataFrame) -> DataFrame:
    """Features observed and varying in each fold's training rows, from a long (ts, feature, value) table."""
    train = cells.join(members.where("split = 'train'"), "ts")
    return train.groupBy("fold", "feature").agg(
        F.count("value").alias("observed"), F.min("value").alias("lo"), F.max("value").alias("hi")
    ).where("observed > 0 AND hi > lo").select("fold", "feature", "observed")


# --- placebos --------------------------------------------------------------------------------

def _seeded(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def placebo_shuffle(frame: DataFrame, cols: list[str], seed: int, key: str, within: list[str] | None = None) -> DataFrame:
    """Hand the row in place r of the key order the features in place r of a seeded order, inside `within`.

    Both orders are ranked in two levels, so neither a long table nor a large group is one task.
    """
    within = list(within or [])
    base = frame.withColumns({"__h": _seeded(seed, *within, key), "__one": F.lit(1)})
    left = ordered.running_sum(base.select(*within, key, "__one"), within, [F.col(key)], ["__one"])
    right = ordered.running_sum(base.select(*within, *cols, "__h", "__one"), within, [F.col("__h")], ["__one"])
    return left.select(*within, key, F.col("__one_upto").alias("__r")).join(
        right.select(*within, *cols, F.col("__one_upto").alias("__r")), [*within, "__r"]).drop("__r")


def placebo_future_shift(frame: DataFrame, hours: int) -> DataFrame:
    """Features of `hours` later shown now."""
    return frame.withColumn("ts", F.col("ts") - P.hours(hours))


def leakage_diagnostic(sources: DataFrame, folds: DataFrame) -> DataFrame:
    """Measured span of the rows a feature was built from, against its fold's bounds."""
    span = sources.groupBy("fold").agg(F.min("ts").alias("source_start"), F.max("ts").alias("source_end"))
    return folds.join(span, "fold").select(
        "fold", "source_start", "source_end", (F.col("source_end") >= F.col("test_start")).alias("used_test_timestamps"))


# --- configurations --------------------------------------------------------------------------


def model_config_grid(folds: DataFrame, grids: list[dict]) -> DataFrame:
    """Every configuration of every representation for each fold, with its model name."""
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    out = None
    for g in grids:
        rows = folds.select("fold", F.lit(g["representation"]).alias("representation"))
        for name, default in (("pca_setting", ["none"]), ("tda_window", [0]), ("tda_group", ["none"]), ("c_value", [1.0])):
            rows = rows.withColumn(name, F.explode(lits(g.get(name, default))))
        out = rows if out is None else out.unionByName(rows)
    parts = F.concat_ws(
        "_", "representation", F.when(F.col("pca_setting") != "none", F.col("pca_setting")),
        F.when(F.col("tda_window") > 0, F.concat(F.col("tda_window").cast("string"), F.lit("h"))),
        F.when(F.col("tda_group") != "none", F.col("tda_group")),
        F.concat(F.lit("C"), F.regexp_replace(F.col("c_value").cast("string"), r"\.0$", "")))
    return out.withColumn("model", parts)


def best_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order, as an aggregate rather than a sort."""
    rest = [c for c in df.columns if c not in keys]
    named = [o.alias(f"o{i}") for i, o in enumerate(order)]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*named)).alias("__r")).select(*keys, "__r.*")


def choose_locked_config(selected: DataFrame, keys: list[str]) -> DataFrame:
    """Per representation, the configuration chosen in most folds, ties by mean validation loss."""
    tally = selected.groupBy("representation", *keys).agg(
        F.countDistinct("fold").alias("selected_folds"), F.avg("log_loss").alias("mean_validation_log_loss"),
        F.avg("brier").alias("mean_validation_brier"))
    order = [-F.col("selected_folds"), F.round("mean_validation_log_loss", 9), F.round("mean_validation_brier", 9), *[F.col(k) for k in keys]]
    return best_per_group(tally, ["representation"], order)


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def lag_and_delta(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Previous value and difference of each column per key in time order."""
    w = W.partitionBy(*keys).orderBy("ts")
    lags = {f"{c}_lag1": F.lag(c).over(w) for c in cols}
    return df.withColumns(lags).withColumns({f"{c}_delta": F.col(c) - F.col(f"{c}_lag1") for c in cols})
