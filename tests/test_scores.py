"""Scores, weights and scalar rules on small known inputs."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import classify as C
from tidepanel.functions import scalars as S
from tidepanel.operators import evaluate as E
from tidepanel.operators import folds as FO
from tidepanel.operators import learn as L
from tidepanel.operators import quality as Q
from tidepanel.plans import learning as LP


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_auc_with_ties_and_one_class(spark):
    rng = np.random.default_rng(0)
    p, y = np.round(rng.random(300), 1), rng.integers(0, 2, 300)
    df = spark.createDataFrame([("a", float(a), int(b)) for a, b in zip(p, y)] + [("b", 0.4, 1)], "model string, p_hat double, y int")
    got = {r["model"]: r["auc"] for r in E.score_auc(df, ["model"]).collect()}
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert abs(got["a"] - want) < 1e-12 and got["b"] is None


def test_deciles_are_right_closed_like_cut(spark):
    p = [0.0, 0.1, 0.10000001, 0.3, 0.30000000000000004, 0.9, 1.0]
    want = pd.cut(p, np.linspace(0, 1, 11), include_lowest=True, labels=False).tolist()
    got = [r[0] for r in spark.createDataFrame([(v,) for v in p], "p_hat double").select(E.decile()).collect()]
    assert got == want


def test_buckets_at_the_edges(spark):
    df = spark.createDataFrame([(10, 0.05), (11, 0.0500001), (101, 1.0)], "n_active int, p double")
    assert [tuple(r) for r in df.select(E.active_count_bucket(), E.prob_bucket()).collect()] == [("<=10", "0-5%"), ("11-25", "5-10%"), (">100", "95-100%")]


@pytest.mark.parametrize("z", [0.0, 0.5, 1.96, -3.0])
def test_normal_tail(spark, z):
    assert abs(one(spark, E.normal_two_sided(F.lit(z))) - (1 - math.erf(abs(z) / math.sqrt(2)))) < 2e-7


def test_resample_weights_are_poisson(spark):
    rng = np.random.default_rng(3)
    w = E.resample_weights(rng.integers(0, 1 << 28, 4000), rng.integers(0, 1 << 28, 4000), 17)
    assert w.shape == (4000, 17) and abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04
    # Known values: the counts that shares just below and above the first two steps stand for.
    units = np.array([0, int(0.36 * E.PRIME), int(0.37 * E.PRIME), int(0.735 * E.PRIME), int(0.736 * E.PRIME)])
    assert E.resample_weights(units, np.zeros(5, int), 1).ravel().tolist() == [0, 0, 1, 1, 2]


def test_bootstrap_interval_holds_the_mean(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, i % 20, float(rng.normal(0.1))) for i in range(400)], "i int, market_id int, g double")
    for unit in (["i"], ["market_id"]):
        r = E.bootstrap(df, [], unit, ["g"], 200).first()
        assert r["g_ci_low"] < r["g_mean"] < r["g_ci_high"]
    assert r["n_units"] == 20


def test_shuffle_keeps_the_values_and_is_seeded(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(200)], "k bigint, v double")
    a = [r["v"] for r in FO.placebo_shuffle(df, ["v"], 7, "k").orderBy("k").collect()]
    b = [r["v"] for r in FO.placebo_shuffle(df, ["v"], 7, "k").orderBy("k").collect()]
    assert a == b and sorted(a) == [float(i) for i in range(200)] and a != sorted(a)


def test_logistic_penalty_follows_the_inverse_strength(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * x))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    _, model = L.forecast(df, df, ["x"], c=0.05, scaled=False)
    w, b = model.coefficients[0], model.intercept
    p = 1 / (1 + np.exp(-(w * x + b)))
    assert abs(w / 0.05 + ((p - y) * x).sum()) < 0.05 and abs((p - y).sum()) < 0.05


def test_one_class_fold_is_skipped(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "x double, y int")
    assert L.forecast(df, df, ["x"]) is None


def test_medians_fill_gaps_before_scaling(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (9.0,)], "x double")
    got = [r["x__z"] for r in L.standardise(df, [df], ["x"])[0].collect()]
    v = np.array([1.0, 2.0, 2.0, 9.0])
    assert np.allclose(got, (v - v.mean()) / v.std())


def test_balanced_weights_with_an_empty_class(spark):
    df = spark.createDataFrame([(1,), (1,)], "y int")
    r = L.balanced_weights(df, []).first()
    assert (r["weight_yes"], r["weight_no"]) == (0.5, 1.0)


def test_thresholds_and_directions(spark):
    # A unit letter counts even when it opens the next word: the "b" of "by" is read as billions.
    q = [("will btc reach $1,200.5k?", 1200500.0, "above"), ("dip below 3 m", 3e6, "below"), ("hit $100 by may", 1e11, "above"), ("hit $100 in may", 100.0, "above"), ("no amount", None, None)]
    df = spark.createDataFrame([(a,) for a, _, _ in q], "q string")
    got = [tuple(r) for r in df.select(C.extract_threshold(F.col("q")), C.infer_direction(F.col("q"))).collect()]
    assert got == [(b, c) for _, b, c in q]


def test_short_keywords_stand_alone(spark):
    df = spark.createDataFrame([("the method",), ("eth up",), ("cryptocurrency",)], "t string")
    assert [r[0] for r in df.select(C.keyword_filter(F.col("t"), ["eth", "crypto"])).collect()] == [False, True, True]


def test_parsing_tolerates_broken_fields(spark):
    df = spark.createDataFrame([('["a"]',), ("",), ("{x",), (None,)], "s string")
    assert [r[0] for r in df.select(S.parse_jsonish("s")).collect()] == [["a"], [], [], []]
    assert one(spark, S.safe_float(F.lit("x"))) is None and one(spark, S.safe_float(F.lit(" 2 "))) == 2.0
    assert one(spark, S.resolved_outcome(F.array(F.lit("A"), F.lit("B")), F.array(F.lit(1.0), F.lit(1.0)))) == "A"
    assert one(spark, S.binary_entropy(F.lit(0.5))) == 1.0 and one(spark, S.binary_entropy(F.lit(None).cast("double"))) == 0.0


def test_clips_keep_nulls(spark):
    assert one(spark, S.probability_clip(F.lit(None).cast("double"))) is None
    assert one(spark, S.clean_value(F.lit(float("-inf")))) is None and one(spark, S.clean_value(F.lit(-0.5))) == 0.0


def test_minmax_of_a_flat_column_is_zero(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r["s"] for r in Q.minmax(df, "x", "s").collect()] == [0.0, 0.0]


def test_image_diagrams_of_all_folds_equal_those_of_each(spark):
    """Windows of two folds in one job give each fold the diagrams that it has on its own."""
    from types import SimpleNamespace

    rng = np.random.default_rng(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(f, start + dt.timedelta(hours=h), [float(v) for v in rng.normal(size=3)]) for f in (1, 2) for h in range(36)]
    vectors = spark.createDataFrame(rows, "fold int, ts timestamp_ntz, x array<double>")
    s = SimpleNamespace(index=vectors.select("ts").distinct())
    told = lambda df: sorted((r.window_end, r.dim, round(r.birth, 9), round(r.death, 9)) for r in df.collect())
    _, both = LP.folds_topology(s, vectors)
    for fold in (1, 2):
        _, own, _ = LP.fold_topology(s, vectors, fold)
        assert (mine := told(both.where(F.col("fold") == fold))) == told(own) and mine
