import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import fits as T
from tidepanel.plans.learning import Setup
from tidepanel.session import at_once, spread


def table(spark, seed=3, n=600):
    """Three groups of rows with gaps in one column, a flat column and one without values; the third group has one class."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in (1, 2, 3):
        x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 3, 1]
        p = 1 / (1 + np.exp(-(0.8 * x[:, 0] - 0.3 * x[:, 1] + g - 2)))
        y = (rng.random(n) < p).astype(float) if g < 3 else np.ones(n)
        for i in range(n):
            gap = rng.random() < 0.2
            rows.append((g, "train" if i < 0.7 * n else "test", i, float(y[i]), float(x[i, 0]), None if gap else float(x[i, 1]), float(x[i, 2]), 4.0, None))
    return spark.createDataFrame(rows, "fold int, split string, i int, y double, a double, b double, c double, flat double, none double")


def prepared(rows, g):
    """The columns of a group as numpy, filled and scaled by its training rows."""
    pdf = rows.where(F.col("fold") == g).orderBy("i").toPandas()
    train = (pdf["split"] == "train").to_numpy()
    cols = []
    for c in ("a", "b", "c", "flat", "none"):
        v = pdf[c].to_numpy(dtype=float)
        seen = v[train][~np.isnan(v[train])]
        v = np.where(np.isnan(v), np.median(seen) if len(seen) else 0.0, v)
        cols.append((v - v[train].mean()) / (v[train].std() or 1.0))
    return np.stack(cols, axis=1), pdf["y"].to_numpy(), train


FITS = [T.Fit(f"{n}_{c}", cols, c) for n, cols in (("small", ("a",)), ("all", ("a", "b", "c", "flat", "none"))) for c in (1.0, 0.1, 0.01)]
FITS += [T.Fit("twice", ("a", "b", "a"), 0.01)]
FITS += [T.Fit("even", ("a", "b"), 0.01, balanced=True), T.Fit("ridge", ("a", "b", "c"), 1.0, "ridge")]
COLUMNS = ["a", "b", "c", "flat", "none"]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = table(spark)
    return rows, T.Fitted(T.Design(rows, ["fold"], COLUMNS, ["fold", "i", "y"]), FITS)


def test_score_equations(fitted):
    """At the solution the slope of every objective is nil, computed here by hand."""
    rows, got = fitted
    assert got.passes <= T.PASSES
    for g in (1, 2, 3):
        x, y, train = prepared(rows, g)
        own = np.c_[np.ones(train.sum()), x[train]]
        for k, fit in enumerate(FITS):
            if not got.known(str(g), k):
                assert g == 3 and fit.kind == "logistic"
                continue
            at = sorted({0, *(1 + COLUMNS.index(c) for c in fit.columns)})
            b = got.betas[str(g)][at, k]
            eta = own[:, at] @ b
            hat = 1 / (1 + np.exp(-eta)) if fit.kind == "logistic" else eta
            w = np.ones(len(hat))
            if fit.balanced:
                yes = y[train].sum()
                w = np.where(y[train] > 0.5, len(hat) / (2 * yes), len(hat) / (2 * (len(hat) - yes)))
            if fit.name == "twice":  # two copies of a column share its coefficient, so their penalty is half
                b = b * [1, 0.5, 1]
            shrink = b if fit.kind == "logistic" else np.r_[0.0, b[1:]]
            assert np.abs(fit.c * own[:, at].T @ (w * (hat - y[train])) + shrink).max() < 1e-7


def test_predictions(fitted):
    rows, got = fitted
    told = {(r.fold, r.i, r.model): r.p_hat for r in got.tested().collect()}
    assert len(told) == 2 * 180 * 8 + 3 * 180
    x, _, train = prepared(rows, 2)
    k = 1
    b = got.betas["2"][[0, 1], k]
    want = 1 / (1 + np.exp(-(np.c_[np.ones(len(x)), x[:, :1]] @ b)))
    for i in np.flatnonzero(~train):
        assert told[2, i, FITS[k].name] == pytest.approx(min(max(want[i], 1e-6), 1 - 1e-6), abs=1e-9)


def test_covariances(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    rows = spark.createDataFrame([(i % 2, [float(v) for v in x[i]]) for i in range(300)], "fold int, x array<double>").repartition(5)
    got = T.covariances(rows, "fold")
    for k in (0, 1):
        n, mean, cov = got[str(k)]
        assert n == 150 and np.allclose(mean, x[k::2].mean(axis=0)) and np.allclose(cov, np.cov(x[k::2].T))


def test_rows_are_not_dealt_by_group(spark):
    """Six groups in many files: a pass reads them where they lie, with no shuffle of the rows by their few groups."""
    rows = spark.range(0, 6000, 1, 16).selectExpr("CAST(id % 6 AS INT) AS fold", "'train' AS split", "CAST(id % 7 < 3 AS DOUBLE) AS y", "id * 1.0 AS a")
    plan = T.Design(rows, ["fold"], ["a"], ["fold", "y"]).rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_moments_of_far_values(spark):
    """Deviations are kept although the values lie far from zero and meet in several tasks; gaps are not counted."""
    v = [1e9 + i % 5 for i in range(400)]
    rows = spark.createDataFrame([("a", x) for x in v] + [("a", None)], "grp string, f_x double").repartition(5)
    n, mean, square = T._moments(rows, ["f_x"])["a"][:, 0]
    assert n == 400 and mean == pytest.approx(np.mean(v), abs=1e-6) and square == pytest.approx(np.var(v) * 400)


def test_at_once_keeps_order_and_spread_deals_rows(spark):
    assert at_once(spark, lambda k: spark.range(k).count(), [5, 3, 9, 1]) == [5, 3, 9, 1]
    sizes = [r["n"] for r in spread(spark.range(0, 1600, 1, 1)).groupBy(F.spark_partition_id().alias("k")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 2 * spark.sparkContext.defaultParallelism and max(sizes) < 200


def test_passes_read_plain_columns(spark, fitted):
    """Training rows reach the tasks as they were written, and what scales them there is what `rows` says."""
    rows, got = fitted
    assert got.design.train.columns == ["grp", "y", *[f"f_{c}" for c in COLUMNS]]
    told = got.predictions(got.design.raw.where("fold = 1 AND split = 'test'"), x=True).where("model = 'small_1.0'").orderBy("i").collect()
    x, _, train = prepared(rows, 1)
    assert len(told) == 180 and np.allclose([r["x"] for r in told], x[~train])


@pytest.mark.parametrize("many", [True, False])
def test_many_rows_of_a_fold_are_dealt_to_every_core(spark, many):
    """Boosted rounds pass over the written rows of a fold; folds come back in order."""
    s = object.__new__(Setup)
    rows = spark.range(0, 4000, 1, 1).selectExpr("TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, CAST(id % 8 AS INT)) AS ts", "id AS market_id", "1 AS y")
    hours = spark.range(0, 8, 1, 1).selectExpr("1 + CAST(id % 2 AS INT) AS fold", "IF(id < 6, 'train', 'test') AS split", "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, CAST(id AS INT)) AS ts")
    s.__dict__.update(rows=rows, members=hours, many=many, inputs=type("Given", (), {"spark": spark}), fold_ids=lambda: [1, 2], components=lambda *a: None)
    train, test = s.modelling_rows(1)
    assert (train.count(), test.count()) == (1500, 500) and (len(train.inputFiles()) > 4) == many
    assert s.each_fold(lambda fold: fold * 10, None) == [10, 20]
