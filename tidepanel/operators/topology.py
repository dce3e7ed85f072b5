"""Persistence diagrams of trailing windows, and everything computed from a long diagram table.

A diagram table has key columns that name a window, then `dim`, `birth`, `death`.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions import ordered
from tidepanel.operators import graph as G
from tidepanel.operators import panel as P

TINY = 1e-12  # fixed value: persistence at or below this counts as none


# --- diagrams of one window ------------------------------------------------------------------


def component_deaths(dist: np.ndarray) -> np.ndarray:
    """Edge lengths of a minimum spanning tree: where components of the point set merge."""
    best, left, out = dist[0].copy(), np.ones(len(dist), bool), []
    left[0] = False
    for _ in range(len(dist) - 1):
        nxt = int(np.argmin(np.where(left, best, np.inf)))
        out.append(best[nxt])
        left[nxt] = False
        best = np.minimum(best, dist[nxt])
    return np.sort(np.array(out))


def loop_pairs(dist: np.ndarray) -> np.ndarray:
    """Births and deaths of loops of the Vietoris-Rips filtration, over the two-element field.

    Edges are taken longest first and paired with the earliest triangle left in their coboundary.
    Past the radius at which one point reaches all others nothing can be born, and an edge that
    merges two components bears no loop, so neither is reduced.
    """
    n = len(dist)
    limit = dist.max(axis=1).min()
    rows, cols = np.triu_indices(n, 1)
    near = dist[rows, cols] <= limit
    rows, cols = rows[near], cols[near]
    order = np.lexsort((cols, rows, dist[rows, cols]))
    edges = list(zip(rows[order].tolist(), cols[order].tolist()))
    parent = list(range(n))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    merging = set()
    for i, j in edges:
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            merging.add((i, j))
    others = np.arange(n)

    def coboundary(edge):
        i, j = edge
        size = np.maximum(np.maximum(dist[i], dist[j]), dist[i, j])
        keep = (size <= limit) & (others != i) & (others != j)
        k = others[keep]
        low, high = np.minimum(k, i), np.maximum(k, j)
        return size[keep], (low * n + (i + j + k - low - high)) * n + high

    chains, owner, found = {}, {}, []
    for edge in reversed(edges):
        if edge in merging:
            continue
        size, ident = coboundary(edge)
        if not len(size):
            continue
        first = np.lexsort((ident, size))[0]
        pivot, chain = (float(size[first]), int(ident[first])), {edge}
        if pivot in owner:
            heap = list(zip(size.tolist(), ident.tolist()))
            heapq.heapify(heap)
            pivot = _earliest(heap)
            while pivot is not None and pivot in owner:
                for e in chains[owner[pivot]]:
                    chain ^= {e}
                    for entry in zip(*(v.tolist() for v in coboundary(e))):
                        heapq.heappush(heap, entry)
                pivot = _earliest(heap)
        if pivot is not None:
            owner[pivot], chains[edge] = edge, chain
            if pivot[0] > dist[edge]:
                found.append((dist[edge], pivot[0]))
    return np.array(found).reshape(-1, 2)


def _earliest(heap: list):
    """Smallest entry present an odd number of times, left in the heap; pairs cancel."""
    while heap:
        top = heapq.heappop(heap)
        if heap and heap[0] == top:
            heapq.heappop(heap)
        else:
            heapq.heappush(heap, top)
            return top
    return None


def _diagram(dist: np.ndarray) -> pd.DataFrame:
    deaths, loops = component_deaths(dist), loop_pairs(dist)
    return pd.DataFrame({
        "dim": np.r_[np.zeros(len(deaths), int), np.ones(len(loops), int)].astype("int32"),
        "birth": np.r_[np.zeros(len(deaths)), loops[:, 0]], "death": np.r_[deaths, loops[:, 1]],
    })


# --- diagrams of every window ----------------------------------------------------------------


def _tag(out: pd.DataFrame, pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    for k in keys:
        out[k] = pdf[k].iloc[0]
    return out[[*keys, "dim", "birth", "death"]]


def persistence_diagrams(points: DataFrame, keys: list[str]) -> DataFrame:
    """Diagrams of point sets with one row per point, its coordinates in the array `x`.

    A task holds one window, whose points are its hours; windows are independent.
    """
    types = dict(points.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack(pdf["x"].to_numpy()).astype(float)
        square = (x * x).sum(axis=1)
        dist = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0.0))
        np.fill_diagonal(dist, 0.0)
        return _tag(_diagram(dist), pdf, keys)

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", dim int, birth double, death double"
    return points.groupBy(*keys).applyInPandas(run, schema)


def hour_distances(cells: DataFrame, keys: list[str], chunks: int) -> DataFrame:
    """Euclidean distance between the hours of each window over all its markets' prices.

    Markets are hashed into `chunks` parts and summed part by part, so a group of any number of
    markets only ever meets as a matrix of hours by hours.
    """
    turned = cells.select(*keys, F.col("market_id").alias("ts"), F.col("ts").alias("market_id"), F.col("p").alias("x"))
    sums = G.pair_sums(turned, keys, blocks=1, chunk=F.pmod(F.xxhash64("ts"), F.lit(chunks)).cast("bigint"))
    gap = F.sqrt(F.greatest(F.col("sxx") + F.col("syy") - 2 * F.col("sxy"), F.lit(0.0)))
    return sums.select(*keys, "a", "b", gap.alias("d"))


def diagrams_from_distances(distances: DataFrame, keys: list[str]) -> DataFrame:
    types = dict(distances.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]))
        dist = np.zeros((len(ids), len(ids)))
        a, b = np.searchsorted(ids, pdf["a"].to_numpy()), np.searchsorted(ids, pdf["b"].to_numpy())
        dist[a, b] = dist[b, a] = pdf["d"].to_numpy()
        return _tag(_diagram(dist), pdf, keys)

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", dim int, birth double, death double"
    return distances.groupBy(*keys).applyInPandas(run, schema)


def window_points(vectors: DataFrame, index: DataFrame, window: int, stride: int) -> DataFrame:
    """The points of every full strided window, tagged with its length and last hour."""
    inside = P.window_members(vectors, window, stride, P.window_ends(index, window, stride))
    return inside.withColumn("window_hours", F.lit(window))


# --- from diagrams to features ---------------------------------------------------------------


def finite_diagram(diagrams: DataFrame) -> DataFrame:
    """Points with finite birth and death, death not before birth."""
    good = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    b, d = F.col("birth"), F.col("death")
    return diagrams.where(good(b) & good(d) & (d >= b))


def birth_persistence(diagrams: DataFrame) -> DataFrame:
    points = finite_diagram(diagrams).withColumn("persistence", F.col("death") - F.col("birth")).drop("death")
    return points.where(F.col("persistence") > TINY)


def diagram_stats(diagrams: DataFrame, windows: DataFrame, keys: list[str], prefix: str = "") -> DataFrame:
    """Count, total, largest and entropy of persistence per window and dimension; zeros where empty."""
    points = birth_persistence(diagrams)
    total = F.sum("persistence").over(W.partitionBy(*keys, "dim"))
    share = points.withColumn("share", F.col("persistence") / total)
    aggs = []
    for dim, count in ((0, "num_components"), (1, "num_loops")):
        mine = lambda v: F.when(F.col("dim") == dim, v)
        w = F.col("share")
        aggs += [
            F.count(mine(F.lit(1))).alias(f"{prefix}h{dim}_{count}"),
            F.sum(mine(F.col("persistence"))).alias(f"{prefix}h{dim}_total_persistence"),
            F.max(mine(F.col("persistence"))).alias(f"{prefix}h{dim}_max_persistence"),
            (-F.sum(mine(w * F.log2(w + TINY)))).alias(f"{prefix}h{dim}_entropy"),
        ]
    stats = share.groupBy(*keys).agg(*aggs)
    return windows.select(*keys).distinct().join(stats, keys, "left").na.fill(0)


def stat_columns(prefix: str = "") -> list[str]:
    names = []
    for dim, count in ((0, "num_components"), (1, "num_loops")):
        names += [f"{prefix}h{dim}_{s}" for s in (count, "total_persistence", "max_persistence", "entropy")]
    return names


def image_ranges(diagrams: DataFrame, keys: list[str]) -> DataFrame:
    """Upper ends of birth and persistence per key from training diagrams: the 99th percentile plus 5 %."""
    points = birth_persistence(diagrams)
    b = ordered.quantiles(points, keys, "birth", {"b99": 0.99})
    p = ordered.quantiles(points, keys, "persistence", {"p99": 0.99})
    end = lambda c: F.greatest(F.col(c), F.lit(1e-3)) * 1.05
    return b.join(p, keys).select(*keys, end("b99").alias("birth_max"), end("p99").alias("pers_max"))


def gaussian_kernel(sigma: float) -> list[tuple[int, float]]:
    radius = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [(i - radius, w / sum(raw)) for i, w in enumerate(raw)]


def image_sigma(resolution: int) -> float:
    return max(0.5, resolution / 20.0)


def persistence_image(points: DataFrame, keys: list[str], resolution: int, sigma: float | None = None) -> DataFrame:
    """Blurred persistence-weighted histogram as (keys, i, j, value), cells of no weight left out.

    `points` has birth, persistence, birth_max and pers_max. Weight is binned first, then each
    filled bin is spread over its neighbours with a fixed kernel; what leaves the frame is lost.
    """
    kernel = gaussian_kernel(sigma or image_sigma(resolution))
    cell = lambda v, top: F.least(F.lit(resolution - 1), F.floor(F.least(v, top) / top * resolution)).cast("int")
    pers = F.least("persistence", "pers_max")
    hist = points.groupBy(
        *keys, cell(F.col("birth"), F.col("birth_max")).alias("bi"), cell(F.col("persistence"), F.col("pers_max")).alias("bj")
    ).agg(F.sum(pers).alias("mass"))
    taps = lambda: F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in kernel])
    spread = hist.withColumn("u", F.explode(taps())).withColumn("i", F.col("bi") + F.col("u.o")).where(F.col("i").between(0, resolution - 1))
    spread = spread.withColumn("v", F.explode(taps())).withColumn("j", F.col("bj") + F.col("v.o")).where(F.col("j").between(0, resolution - 1))
    return spread.groupBy(*keys, "i", "j").agg(F.sum(F.col("mass") * F.col("u.w") * F.col("v.w")).alias("value"))


def image_vectors(image: DataFrame, windows: DataFrame, keys: list[str], resolution: int) -> DataFrame:
    """Each window's image as one array of resolution² values with its total mass."""
    cells = image.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct((F.col("i") * resolution + F.col("j")).alias("c"), "value"))).alias("m"))
    full = windows.select(*keys).distinct().join(cells, keys, "left")
    slots = F.sequence(F.lit(0), F.lit(resolution * resolution - 1))
    out = full.withColumn("features", F.transform(slots, lambda c: F.coalesce(F.try_element_at(F.col("m"), c), F.lit(0.0)))).drop("m")
    return out.withColumn("mass", F.aggregate("features", F.lit(0.0), lambda s, x: s + x))


def persistence_landscape(points: DataFrame, keys: list[str], levels: int, steps: int = 50) -> DataFrame:
    """The k-th highest tent at each grid step as (keys, step, level, value), zeros left out."""
    stop = F.greatest(F.col("birth_max") + F.col("pers_max"), F.lit(1e-3))
    at = points.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    g = F.col("step") * stop / (steps - 1)
    tent = F.least(g - F.col("birth"), F.col("birth") + F.col("persistence") - g)
    high = at.withColumn("value", tent).where("value > 0")
    by = W.partitionBy(*keys, "step").orderBy(F.desc("value"))
    return high.withColumn("level", F.row_number().over(by)).where(F.col("level") <= levels).select(*keys, "step", "level", "value")


def topology_change(stats: DataFrame, cols: list[str], keys: list[str], time: str = "window_end") -> DataFrame:
    """Difference of each statistic from the window before, zero at the first."""
    w = W.partitionBy(*keys).orderBy(time)
    return stats.withColumns({f"delta_{c}": F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) for c in cols})


def topology_diagnostics(stats: DataFrame, time: str = "window_end", prefix: str = "") -> DataFrame:
    c = lambda name: F.col(f"{prefix}{name}")
    return stats.groupBy("window_hours").agg(
        F.countDistinct(time).alias("timestamps"), F.avg((c("h1_num_loops") > 0).cast("int")).alias("h1_nontrivial_rate"),
        F.avg(c("h0_total_persistence")).alias("avg_h0_total_persistence"), F.avg(c("h1_total_persistence")).alias("avg_h1_total_persistence"),
        F.avg(c("h0_entropy")).alias("avg_h0_entropy"), F.avg(c("h1_entropy")).alias("avg_h1_entropy"),
        F.stddev_samp(c("h1_entropy")).alias("h1_entropy_std"), F.stddev_samp(c("h1_total_persistence")).alias("h1_total_persistence_std"))

