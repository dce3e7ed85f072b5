"""Train-only scaling, principal components and forecasters on Spark ML."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import ordered
from tidepanel.functions.scalars import probability_clip
from tidepanel.operators.spectra import Spectra, scores
from tidepanel.session import cut_lineage

# Component counts and shares of variance that are tried.
FIXED_COMPONENTS = (2, 5, 10)
VARIANCE_SHARES = (0.85, 0.90, 0.95)


# --- long features and train-only scaling ----------------------------------------------------


def state_features(state: DataFrame, index: DataFrame, families: list[str]) -> DataFrame:
    """Family state as (ts, feature, value) over every hour of the index.

    An hour without active members has no mean or median, and zero deviation and count.
    """
    grid = index.withColumn("family", F.explode(F.array(*[F.lit(f) for f in families])))
    full = grid.join(state, ["ts", "family"], "left")
    name = lambda part: F.concat(F.col("family"), F.lit(f"__{part}")).alias("feature")
    parts = F.array(
        F.struct(name("mean"), F.col("mean").alias("value")), F.struct(name("median"), F.col("median").alias("value")),
        F.struct(name("std"), F.coalesce("std", F.lit(0.0)).alias("value")),
        F.struct(name("count"), F.coalesce("n", F.lit(0)).cast("double").alias("value")))
    return full.select("ts", F.explode(parts).alias("f")).select("ts", "f.feature", "f.value")


def fit_scale(train: DataFrame, by: list[str], impute: str = "mean") -> DataFrame:
    """Fill value, mean and population deviation per feature from training rows only.

    Deviation is that of the filled column. Features never seen or never varying are dropped.
    """
    stats = train.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count("value").alias("seen"), F.avg("value").alias("m"),
        F.var_pop("value").alias("v"), F.min("value").alias("lo"), F.max("value").alias("hi")).where("seen > 0 AND hi > lo")
    if impute == "median":
        stats = stats.join(ordered.quantiles(train, by, "value", {"fill": 0.5}), by)
    else:
        stats = stats.withColumn("fill", F.col("m"))
    gap = F.col("rows") - F.col("seen")
    mean = (F.col("m") * F.col("seen") + F.col("fill") * gap) / F.col("rows")
    second = (F.col("seen") * (F.col("v") + (F.col("m") - mean) ** 2) + gap * (F.col("fill") - mean) ** 2) / F.col("rows")
    return stats.select(*by, "fill", mean.alias("mean"), F.sqrt(second).alias("std"))


def scale(rows: DataFrame, fitted: DataFrame, by: list[str], clip: float | None = None) -> DataFrame:
    """Standardised values `z`, missing ones filled first."""
    z = (F.coalesce("value", "fill") - F.col("mean")) / F.col("std")
    if clip is not None:
        z = F.greatest(F.lit(-clip), F.least(F.lit(clip), z))
    return rows.join(fitted, by).withColumn("z", z).drop("fill", "mean", "std")


def zscore_by_train(rows: DataFrame, by: list[str]) -> DataFrame:
    """Values of both splits in training deviations; missing and flat ones become zero."""
    stats = rows.where("split = 'train'").groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    z = (F.col("value") - F.col("mean")) / F.nullif("std", F.lit(0.0))
    return rows.join(stats, by).withColumn("z", F.coalesce(z, F.lit(0.0))).drop("mean", "std")


def active_fill_scale(cells: DataFrame, mask: DataFrame, members: DataFrame) -> DataFrame:
    """Market columns in training deviations: an active hour without price sits at the train mean (0).

    Hours outside a market's activity are zero and carry no row.
    """
    live = mask.join(cells, ["ts", "market_id"], "left").join(members, "ts")
    stats = live.where("split = 'train'").groupBy("fold", "market_id").agg(
        F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"), F.min("p").alias("lo"), F.max("p").alias("hi")).where("hi > lo")
    z = F.coalesce((F.col("p") - F.col("mean")) / F.col("std"), F.lit(0.0))
    return live.join(stats.select("fold", "market_id", "mean", "std"), ["fold", "market_id"]).select("fold", "split", "ts", "market_id", z.alias("z"))


def state_vectors(scaled: DataFrame, keys: list[str]) -> DataFrame:
    """One array `x` per key and hour, in feature order; the number of features is bounded by the families."""
    packed = scaled.groupBy(*keys, "ts").agg(F.array_sort(F.collect_list(F.struct("feature", "z"))).alias("f"))
    return packed.select(*keys, "ts", F.transform("f", lambda f: f["z"]).alias("x"))


# --- principal components of a bounded number of columns -------------------------------------


class Components:
    """A fitted basis: loadings (columns by components), shares of variance, training mean."""

    def __init__(self, loadings: np.ndarray, ratio: np.ndarray, mean: np.ndarray):
        self.loadings, self.ratio, self.mean = loadings, ratio, mean

    def scores(self, x: Column, k: int) -> Column:
        basis, mean = self.loadings[:, :k], self.mean

        @F.pandas_udf("array<double>")
        def project(batch: pd.Series) -> pd.Series:
            return pd.Series(list((np.vstack(batch.to_numpy()) - mean) @ basis))

        return project(x)

    def residuals(self, x: Column, k: int, clip: float = 10.0) -> Column:
        basis, mean = self.loadings[:, :k], self.mean

        @F.pandas_udf("array<double>")
        def remain(batch: pd.Series) -> pd.Series:
            centred = np.vstack(batch.to_numpy()) - mean
            return pd.Series(list(np.clip(centred - centred @ basis @ basis.T, -clip, clip)))

        return remain(x)


def components_of(mean: np.ndarray, cov: np.ndarray) -> Components:
    """All components of a covariance; each is signed so that its largest loading is positive."""
    values, basis = np.linalg.eigh(cov)
    values, basis = np.maximum(values[::-1], 0.0), basis[:, ::-1]
    top = np.abs(basis).argmax(axis=0)
    return Components(basis * np.where(basis[top, np.arange(basis.shape[1])] < 0, -1.0, 1.0), values / values.sum(), mean)


def component_counts(ratio: np.ndarray, limit: int) -> dict[str, int]:
    """Components kept by each fixed or share-of-variance setting."""
    total = np.cumsum(ratio)
    out = {f"fixed_{k}": k for k in FIXED_COMPONENTS if k <= limit}
    return out | {f"var_{round(s * 100)}": min(int(np.searchsorted(total, s) + 1), limit) for s in VARIANCE_SHARES}


# --- principal components over any number of markets -----------------------------------------


def scaled_markets(cells: DataFrame, members: DataFrame) -> DataFrame:
    """(fold, split, ts, market_id, p, mean, std, z): prices in the market's training deviations; markets that do not vary in training are left out.

    An hour without price sits at the training mean, so it is zero and carries no row.
    """
    placed = cells.join(members, "ts")
    stats = placed.where("split = 'train'").groupBy("fold", "market_id").agg(
        F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"), F.min("p").alias("lo"), F.max("p").alias("hi")).where("hi > lo").drop("lo", "hi")
    return placed.join(stats, ["fold", "market_id"]).select("fold", "split", "ts", "market_id", "p", "mean", "std", ((F.col("p") - F.col("mean")) / F.col("std")).alias("z"))


COMPRESSED = ("pc_85", "pc_90", "pc_95", "pc1_variance", "pc2_cumulative_variance", "pc5_cumulative_variance", "components_found", "share_reached")


def compressibility(cells: DataFrame) -> dict[str, dict[str, float | int | None]]:
    """Of every universe in `cells` (universe, ts, market_id, p) how few components carry its panel; nothing below two varying columns or a day of hours."""
    hours = cells.groupBy("universe").agg(F.countDistinct("ts").alias("hours"))
    stats = cells.groupBy("universe", "market_id").agg(
        F.avg("p").alias("m"), F.sum(F.col("p") ** 2).alias("q"), F.count("p").alias("c"), F.min("p").alias("lo"), F.max("p").alias("hi")).where("hi > lo").join(hours, "universe")
    names = [r["universe"] for r in hours.collect()]
    able = {r["universe"] for r in stats.groupBy("universe").agg(F.count("*").alias("n"), F.max("hours").alias("h")).where("n >= 2 AND h >= 24").collect()}
    out = {u: dict.fromkeys(COMPRESSED) for u in names}
    if not able:
        return out
    # Missing hours are filled with the mean, so they add nothing to the spread.
    spread = F.sqrt((F.col("q") - F.col("c") * F.col("m") ** 2) / F.col("hours"))
    z = cells.join(stats, ["universe", "market_id"]).where(F.col("universe").isin(sorted(able))).select(
        F.col("universe").alias("grp"), "ts", "market_id", ((F.col("p") - F.col("m")) / spread).alias("z"))
    for u, group in Spectra(z, 5, max(VARIANCE_SHARES)).groups.items():
        total = np.cumsum(group.shares)
        reach = lambda s: int(np.searchsorted(total, s) + 1) if total[-1] >= s else None
        out[u] = dict(zip(COMPRESSED, (reach(0.85), reach(0.90), reach(0.95), float(total[0]), float(total[min(1, len(total) - 1)]), float(total[min(4, len(total) - 1)]),
                                       len(total), float(total[-1]))))
    return out


def market_embedding(cells: DataFrame, key: str, dims: int = 5) -> DataFrame:
    """(key, market_id, x): each market's series in at most five components, hours standardised across markets first; all keys together."""
    hourly = cells.groupBy(key, "ts").agg(F.avg("p").alias("m"), F.stddev_pop("p").alias("s")).where("s > 0")
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long")
    z = cells.join(hourly, [key, "ts"]).select(F.col(key).cast("string").alias("grp"), F.col("market_id").alias("ts"), hour.alias("market_id"), ((F.col("p") - F.col("m")) / F.col("s")).alias("z"))
    z = cut_lineage(z)  # hours take the place of markets: the components are directions in hours, a market is a row
    placed = scores(z, Spectra(z, dims).loadings(dims), dims)
    return placed.select(F.col("grp").cast(dict(cells.dtypes)[key]).alias(key), F.col("ts").alias("market_id"), F.col("s").alias("x"))


# --- forecasters -----------------------------------------------------------------------------


def balanced_weights(rows: DataFrame, keys: list[str], y: str = "y") -> DataFrame:
    """n / (2 n_class) per class, counting a class without rows as one."""
    pos = F.greatest(F.sum(y), F.lit(1))
    neg = F.greatest(F.count("*") - F.sum(y), F.lit(1))
    return rows.groupBy(*keys).agg((F.count("*") / (2.0 * pos)).alias("weight_yes"), (F.count("*") / (2.0 * neg)).alias("weight_no"))


def standardise(train: DataFrame, frames: list[DataFrame], cols: list[str]) -> list[DataFrame]:
    """Fill with training medians, then scale by training mean and population deviation (wide form).

    Only the statistics, a few numbers per column, come to the driver. Medians are taken for the
    columns that have gaps, exactly and without sorting a column in one task.
    """
    train = train.select(*[F.col(c).cast("double").alias(c) for c in cols])
    gaps = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first().asDict()
    missing = [c for c in cols if gaps[c]]
    medians = dict.fromkeys(cols, 0.0)
    if missing:
        long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in missing])).alias("r")).select("r.*")
        medians |= {r["c"]: r["m"] for r in ordered.quantiles(long, ["c"], "v", {"m": 0.5}).collect()}
    filled = train.na.fill(medians) if missing else train
    stats = filled.agg(*[F.avg(c).alias(f"{c}__m") for c in cols], *[F.stddev_pop(c).alias(f"{c}__s") for c in cols]).first().asDict()

    def apply(df: DataFrame) -> DataFrame:
        return df.withColumns({
            f"{c}__z": (F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) - F.lit(stats[f"{c}__m"])) / F.lit(stats[f"{c}__s"] or 1.0) for c in cols})

    return [apply(df) for df in frames]


def assemble(frames: list[DataFrame], cols: list[str], vectors: list[str]) -> list[DataFrame]:
    """Feature vectors of scalar columns and of array columns, the latter scaled by the first frame."""
    for v in vectors:
        frames = [f.withColumn(f"{v}__v", array_to_vector(v)) for f in frames]
        scaler = StandardScaler(inputCol=f"{v}__v", outputCol=f"{v}__z", withMean=True, withStd=True).fit(frames[0])
        frames = [scaler.transform(f) for f in frames]
    packer = VectorAssembler(inputCols=[*cols, *[f"{v}__z" for v in vectors]], outputCol="features")
    return [packer.transform(f) for f in frames]


def one_class(train: DataFrame, y: str = "y") -> bool:
    r = train.agg(F.min(y), F.max(y)).first()
    return r[0] is None or r[0] == r[1]


def forecast(train: DataFrame, test: DataFrame, cols: list[str], kind: str = "logistic", y: str = "y", c: float = 1.0, balanced: bool = False,
             vectors: list[str] | None = None, scaled: bool = True, rounds: int = 100, step: float = 0.03, seed: int = 7):
    """Fit on train, predict on test. Returns (test with p_hat or y_hat, model), or None for one class.

    The penalty of `c` follows the usual inverse-strength convention: 1 / (c n).
    """
    if kind != "ridge" and one_class(train, y):
        return None
    used = cols
    if scaled and cols:
        train, test = standardise(train, [train, test], cols)
        used = [f"{x}__z" for x in cols]
    n = train.count()
    train, test = assemble([train, test], used, vectors or [])
    train = train.withColumn("label", F.col(y).cast("double"))
    if kind == "ridge":
        model = LinearRegression(elasticNetParam=0.0, regParam=1.0 / n, standardization=False, maxIter=100).fit(train)
        return model.transform(test).withColumn("y_hat", F.col("prediction")), model
    if kind == "trees":
        model = GBTClassifier(maxDepth=2, maxIter=rounds, stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed).fit(train)
    else:
        given = {}
        if balanced:
            w = balanced_weights(train, [], y).first()
            train = train.withColumn("w", F.when(F.col(y) == 1, w["weight_yes"]).otherwise(w["weight_no"]))
            given = {"weightCol": "w"}
        model = LogisticRegression(elasticNetParam=0.0, regParam=1.0 / (c * n), standardization=False, maxIter=100, **given).fit(train)
    out = model.transform(test).withColumn("p_hat", probability_clip(vector_to_array("probability")[1]))
    return out, model


def best_silhouette(vectors: DataFrame, ks=range(2, 6), seed: int = 7) -> list[tuple[int, float]]:
    """Silhouette of k-means for each k on the array column `x`."""
    data = vectors.select(array_to_vector("x").alias("features"))
    judge = ClusteringEvaluator(distanceMeasure="squaredEuclidean")
    return [(k, float(judge.evaluate(KMeans(k=k, seed=seed).fit(data).transform(data)))) for k in ks]


def trajectory_stats(coords: DataFrame) -> DataFrame:
    """Step lengths, radii and end-to-end distance of a path given as (ts, x array)."""
    index = cut_lineage(ordered.dense_index(coords))
    path = cut_lineage(coords.join(index, "ts").select("idx", "x"))
    width = coords.select(F.size("x")).first()[0]
    gap = lambda a, b: F.sqrt(sum(((a[i] - b[i]) ** 2 for i in range(width)), F.lit(0.0)))
    steps = path.join(path.select((F.col("idx") + 1).alias("idx"), F.col("x").alias("before")), "idx").select(gap(F.col("x"), F.col("before")).alias("step"))
    centre = path.agg(F.array(*[F.avg(F.col("x")[i]) for i in range(width)])).scalar()
    radii = cut_lineage(path.select("idx", "x", gap(F.col("x"), centre).alias("radius")))
    sq = ordered.quantiles(steps, [], "step", {"median_step": 0.5, "p95_step": 0.95})
    rq = ordered.quantiles(radii, [], "radius", {"median_radius": 0.5, "p99_radius": 0.99})
    ends = path.agg(F.min_by("x", "idx").alias("a"), F.max_by("x", "idx").alias("b")).select(gap(F.col("a"), F.col("b")).alias("start_end_distance"))
    sq, rq = cut_lineage(sq).first(), cut_lineage(rq).first()
    far = radii.agg(F.count_if(F.col("radius") > F.lit(rq["p99_radius"])).alias("outliers")).scalar()
    return ends.withColumns({
        "median_step": F.lit(sq["median_step"]), "p95_step": F.lit(sq["p95_step"]), "median_radius": F.lit(rq["median_radius"]),
        "outliers_past_p99": far, "start_end_radius_ratio": F.col("start_end_distance") / F.nullif(F.lit(rq["median_radius"]), F.lit(0.0))})
