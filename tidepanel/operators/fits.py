"""Linear and logistic fits of every group (fold, target, label set), specification and penalty at once.

Rows carry all columns that any specification uses. One pass over the training rows yields loss, gradient and second derivatives of every fit of every
group: each task multiplies its own rows, and only sums leave it. The driver gets one small matrix per fit, takes a Newton step for
each and sends the coefficients back, so the number of passes is that of the slowest fit and does not grow with folds, specifications or penalties.

Logistic fits minimise c * sum(loss) + |b|^2 / 2 with the intercept in b; ridge fits minimise sum(error^2) + |b|^2 / c without it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import ordered
from tidepanel.functions.scalars import probability_clip
from tidepanel.session import cut_lineage

#: Passes that a family of fits may take, and the greatest entry of a gradient at a solution.
PASSES, TOLERANCE = 15, 1e-9


@dataclass(frozen=True)
class Fit:
    name: str
    columns: tuple[str, ...]
    c: float = 1.0
    kind: str = "logistic"
    balanced: bool = False


def _numbers(column: pa.Array, at: np.ndarray) -> np.ndarray:
    """Rows `at` of a column of equally long lists, as a matrix."""
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)


def _added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The arrays `v` of each key added up, one running sum per key in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        kinds: list = []
        for batch in batches:
            kinds = [batch.column(k).type for k in keys]
            names = zip(*(batch.column(k).to_pylist() for k in keys))
            for i, key in enumerate(names):
                v = batch.column("v")[i].values.to_numpy()
                total[key] = total[key] + v if key in total else v.copy()
        if total:
            columns = [pa.array([t[i] for t in total], kinds[i]) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(total.values()), pa.list_(pa.float64()))], names=[*keys, "v"])

    return parts.repartition(*keys).mapInArrow(run, parts.schema)


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    codes = batch.column("grp").dictionary_encode()
    of = codes.indices.to_numpy(zero_copy_only=False)
    for k, name in enumerate(codes.dictionary.to_pylist()):
        yield name, np.flatnonzero(of == k)


# --- components of every group ---------------------------------------------------------------


def covariances(vectors: DataFrame, key: str) -> dict:
    """Of each key its rows, mean vector and sample covariance of the array column `x`, in one pass; the squared width of numbers per key comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, at in _by_group(batch):
                ones = np.c_[np.ones(len(at)), _numbers(batch.column("x"), at)]
                total[name] = total.get(name, 0.0) + ones.T @ ones
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([t.ravel() for t in total.values()], pa.list_(pa.float64()))], names=["grp", "v"])

    parts = vectors.select(F.col(key).cast("string").alias("grp"), "x").mapInArrow(run, "grp string, v array<double>")
    out = {}
    for r in _added(parts, ["grp"]).collect():
        m = np.array(r["v"])
        m = m.reshape(int(len(m) ** 0.5), -1)
        n, mean = m[0, 0], m[0, 1:] / m[0, 0]
        out[r["grp"]] = (int(n), mean, (m[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1))
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts, means and squared deviations of two sets of rows taken together."""
    n = a[0] + b[0]
    gap, share = b[1] - a[1], b[0] / np.maximum(n, 1)
    return np.stack([n, a[1] + gap * share, a[2] + b[2] + gap * gap * a[0] * share])


def _moments(rows: DataFrame, columns: list[str]) -> dict[str, np.ndarray]:
    """Of each group the values seen, mean and squared deviations of every column, three by columns; one small matrix per group leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            known = np.stack([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in columns], axis=1)
            x = np.where(known, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1), 0.0)
            for g, at in _by_group(batch):
                mine, seen = x[at], known[at].sum(axis=0)
                mean = mine.sum(axis=0) / np.maximum(seen, 1)
                part = np.stack([seen, mean, (np.where(known[at], mine - mean, 0.0) ** 2).sum(axis=0)])
                total[g] = _joined(total[g], part) if g in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([t.ravel() for t in total.values()], pa.list_(pa.float64()))], names=["grp", "v"])

    out: dict[str, np.ndarray] = {}
    for r in rows.select("grp", *columns).mapInArrow(run, "grp string, v array<double>").collect():
        part = np.array(r["v"]).reshape(3, -1)
        out[r["grp"]] = _joined(out[r["grp"]], part) if r["grp"] in out else part
    return out


# --- rows of a family of fits ----------------------------------------------------------------


class Design:
    """Training and other rows of every group, with all columns filled and scaled as the group's training rows say.

    `rows` has the key columns `by`, `split` and `y`. Gaps are filled with training medians, then columns are put in training deviations; a column
    without any value or spread is zero. The numbers that say so, three per column and group, come to the driver.
    Columns are written as given (`raw`), where repeated values take little room, and scaled whenever they are read: by the tasks that multiply them, or as
    the array `x` of `rows`.
    """

    def __init__(self, rows: DataFrame, by: list[str], columns: list[str], keep: list[str]):
        self.by, self.columns, self.keep = by, columns, keep
        group = F.concat_ws("|", *[F.col(b).cast("string") for b in by])
        self.kept = ["grp", *by, "split", "y", *[c for c in keep if c not in by and c != "y"]]
        self.raw = rows = cut_lineage(rows.select(group.alias("grp"), *by, "split", F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(f"f_{c}") for c in columns],
                                                  *[F.col(c) for c in self.kept[len(by) + 3:]]))
        train = rows.where("split = 'train' AND y IS NOT NULL")
        told = train.groupBy("grp").agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.sum("y").alias("yes")).collect()
        self.groups = {r["grp"]: r.asDict() for r in told}
        moments = _moments(train, [f"f_{c}" for c in columns])
        gaps = [c for i, c in enumerate(columns) if any(moments[g][0, i] < r["n"] for g, r in self.groups.items())]
        median = {}
        if gaps:
            long = train.select("grp", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"f_{c}").alias("v")) for c in gaps])).alias("r")).select("grp", "r.*").where("v IS NOT NULL")
            median = {(r["grp"], r["c"]): r["m"] for r in ordered.quantiles(long, ["grp", "c"], "v", {"m": 0.5}).collect()}
        params = []
        for g, r in self.groups.items():
            fill, mean, std = [], [], []
            for c, (seen, m, square) in zip(columns, moments[g].T.tolist()):
                n, v = r["n"], square / max(seen, 1)
                q = median.get((g, c), m)
                whole = (m * seen + q * (n - seen)) / n
                spread = (seen * (v + (m - whole) ** 2) + (n - seen) * (q - whole) ** 2) / n
                fill.append(q), mean.append(whole), std.append(spread ** 0.5 or 1.0)
            params.append((g, fill, mean, std))
        self.scales = {g: np.array(told) for g, *told in params}
        # An Arrow table has a known size, so that the rows are not shuffled by their few groups to meet it.
        lists = [pa.array([p[i] for p in params], pa.list_(pa.float64())) for i in (1, 2, 3)]
        scales = rows.sparkSession.createDataFrame(pa.table([pa.array([p[0] for p in params], pa.string()), *lists], names=["grp", "fill", "mean", "std"]))
        x = F.array(*[(F.coalesce(f"f_{c}", F.col("fill")[i]) - F.col("mean")[i]) / F.col("std")[i] for i, c in enumerate(columns)])
        self.rows = rows.join(scales, "grp").select("grp", *by, "split", "y", x.alias("x"), *self.kept[len(by) + 3:])
        self.train = rows.where("split = 'train' AND y IS NOT NULL").select("grp", "y", *[f"f_{c}" for c in columns])

    def index(self, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
        """Places of a fit's coefficients (the intercept and its columns), and how much each is shrunk: a column named twice only half as much."""
        places, times = np.unique([0, *(1 + self.columns.index(c) for c in fit.columns)], return_counts=True)
        shrink = 1.0 / times
        if fit.kind == "ridge":
            shrink[0] = 0.0
        return places, shrink

    def weights(self, group: str, fit: Fit) -> tuple[float, float]:
        """Weights of the rows with y = 0 and y = 1."""
        if not fit.balanced:
            return 1.0, 1.0
        r = self.groups[group]
        return r["n"] / (2.0 * max(r["n"] - r["yes"], 1)), r["n"] / (2.0 * max(r["yes"], 1))


def _scaled_groups(batch: pa.RecordBatch, columns: list[str], scales: dict[str, np.ndarray]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Each group that has scales, the places of its rows and their columns, filled and scaled, behind a column of ones."""
    x, gaps = np.empty((batch.num_rows, len(columns))), []
    for i, c in enumerate(columns):
        v = batch.column(c)
        x[:, i] = v.to_numpy(zero_copy_only=False)
        if v.null_count:
            gaps.append((i, v.is_null().to_numpy(zero_copy_only=False)))
    for g, at in _by_group(batch):
        if g in scales:
            fill, mean, std = scales[g]
            own = x[at]
            for i, empty in gaps:
                own[empty[at], i] = fill[i]
            yield g, at, np.c_[np.ones(len(at)), (own - mean) / std]


def _sums(design: Design, fits: list[Fit], betas: dict[str, np.ndarray], wanted: set[tuple[str, int]]) -> dict[tuple[str, int], np.ndarray]:
    """Loss, gradient and second derivatives of the wanted fits (group, place) at the given coefficients, summed over the training rows."""
    places = [design.index(f)[0] for f in fits]
    weight = {g: [design.weights(g, f) for f in fits] for g in betas}
    columns, scales = [f"f_{c}" for c in design.columns], {g: design.scales[g] for g in betas}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            y = batch.column("y").to_numpy()
            for g, at, every in _scaled_groups(batch, columns, scales):
                target, of = y[at], {}
                for k, fit in enumerate(fits):
                    if (g, k) not in wanted:
                        continue
                    if fit.columns not in of:  # specifications differ, penalties do not
                        of[fit.columns] = every[:, places[k]]
                    own = of[fit.columns]
                    eta = own @ betas[g][places[k], k]
                    if fit.kind == "logistic":
                        hat, w = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700))), np.where(target > 0.5, weight[g][k][1], weight[g][k][0])
                        loss, bend = w * (np.logaddexp(0.0, eta) - target * eta), w * hat * (1.0 - hat)
                    else:
                        hat, w = eta, np.ones(len(eta))
                        loss, bend = 0.5 * (eta - target) ** 2, w
                    part = np.r_[loss.sum(), own.T @ (w * (hat - target)), ((own * bend[:, None]).T @ own).ravel()]
                    total[g, k] = total.get((g, k), 0.0) + part
        yield pa.RecordBatch.from_arrays(
            [pa.array([g for g, _ in total], pa.string()), pa.array([k for _, k in total], pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))],
            names=["grp", "fit", "v"])

    # Groups whose fits are all solved are not read again.
    train = design.train if len(betas) == len(design.groups) else design.train.where(F.col("grp").isin(sorted(betas)))
    parts = train.mapInArrow(run, "grp string, fit int, v array<double>")
    return {(r["grp"], r["fit"]): np.array(r["v"]) for r in _added(parts, ["grp", "fit"]).collect()}


class Fitted:
    """Coefficients of every fit of every group, with the gradient left and the passes taken."""

    def __init__(self, design: Design, fits: list[Fit]):
        self.design, self.fits, self.passes = design, fits, 0
        width = len(design.columns) + 1
        able = {g: [f.kind != "logistic" or r["lo"] < r["hi"] for f in fits] for g, r in design.groups.items()}
        self.betas = {g: np.zeros((width, len(fits))) for g, ok in able.items() if any(ok)}
        self.gradient = {(g, k): np.inf for g in self.betas for k in range(len(fits)) if able[g][k]}
        before: dict = {}  # objective and coefficients of the last accepted step
        while self.passes < PASSES and any(v > TOLERANCE for v in self.gradient.values()):
            wanted = {key for key, v in self.gradient.items() if v > TOLERANCE}
            self.passes += 1
            for (g, k), v in _sums(design, fits, {g: self.betas[g] for g, _ in wanted}, wanted).items():
                at, shrink = design.index(fits[k])
                b, strength = self.betas[g][at, k], fits[k].c
                objective = strength * v[0] + 0.5 * (shrink * b * b).sum()
                if (g, k) in before and objective > before[g, k][0] * (1 + 1e-12) + 1e-12:
                    self.betas[g][at, k] = (b + before[g, k][1]) / 2  # too far: half the way back
                    continue
                slope = strength * v[1:len(at) + 1] + shrink * b
                bend = strength * v[len(at) + 1:].reshape(len(at), len(at)) + np.diag(shrink)
                # What rounding leaves of a sum over all rows is no gradient.
                floor = 1e-15 * strength * design.groups[g]["n"]
                self.gradient[g, k] = max(0.0, float(np.abs(slope).max()) - floor)
                before[g, k] = (objective, b.copy())
                if self.gradient[g, k] > TOLERANCE:
                    self.betas[g][at, k] = b - np.linalg.lstsq(bend, slope, rcond=None)[0]

    def known(self, g: str, k: int) -> bool:
        return (g, k) in self.gradient

    def predictions(self, raw: DataFrame, x: bool = False) -> DataFrame:
        """`model` and `hat` of every fit beside the kept columns of some of the design's raw rows: a probability, or a value for ridge fits; if asked for, scaled columns `x`."""
        fits, betas = self.fits, self.betas
        known = {g: [self.known(g, k) for k in range(len(fits))] for g in betas}
        logit = np.array([f.kind == "logistic" for f in fits])
        columns, scales = [f"f_{c}" for c in self.design.columns], {g: self.design.scales[g] for g in betas}
        kept = raw.select(F.struct(*self.design.kept).alias("row"), "grp", *columns)
        names = ["row", "hats", *(["x"] if x else [])]

        def lists(values: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hats, scaled = np.full((batch.num_rows, len(fits)), np.nan), np.full((batch.num_rows, len(columns) if x else 0), np.nan)
                for g, at, every in _scaled_groups(batch, columns, scales):
                    eta = every @ betas[g]
                    hat = np.where(logit, 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700))), eta)
                    hats[at] = np.where(known[g], hat, np.nan)
                    if x:
                        scaled[at] = every[:, 1:]
                yield pa.RecordBatch.from_arrays([batch.column("row"), lists(hats), *([lists(scaled)] if x else [])], names=names)

        told = kept.mapInArrow(run, f"row {kept.schema['row'].dataType.simpleString()}, hats array<double>" + (", x array<double>" if x else ""))
        models = F.array(*[F.lit(f.name) for f in fits])
        return told.select("row.*", *names[2:], F.posexplode("hats").alias("k", "hat")).where(~F.isnan("hat")).withColumn("model", models[F.col("k")]).drop("k")

    def tested(self) -> DataFrame:
        """Predictions of the test rows, probabilities in `p_hat`."""
        out = self.predictions(self.design.raw.where("split = 'test'")).drop("grp", "split")
        return out.withColumn("p_hat", probability_clip("hat")).drop("hat")

    def coefficients(self) -> list[tuple[str, str, str, float]]:
        """Group, model, column (`intercept` first) and coefficient, in training deviations."""
        out = []
        for (g, k) in self.gradient:
            names = ["intercept", *self.design.columns]
            out += [(g, self.fits[k].name, names[i], float(self.betas[g][i, k])) for i in self.design.index(self.fits[k])[0]]
        return out
