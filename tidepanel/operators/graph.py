"""Market-by-market statistics and the graphs built from them.

Pair sums are a blocked matrix product: markets are hashed into blocks, hours cut into chunks, and
each task multiplies two dense blocks. Only per-pair sums leave a task, never one row per shared hour.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepanel.functions import ordered
from tidepanel.operators import panel as P
from tidepanel.operators import series as S
from tidepanel.operators.forest import joins_at, spanning_forest
from tidepanel.session import cut_lineage

# Correlation thresholds of the graphs and the neighbourhood sizes.
THRESHOLDS = (0.3, 0.5, 0.7)
NEIGHBOURHOOD_SIZES = (10, 20, 40)

# A task of a blocked product holds at most two dense blocks of this many hours by markets (2 MB each).
BLOCK, CHUNK_HOURS = 256, 1024
# Distinct lifetimes in a block of those that meet in a task (8 MB of shared hours for two blocks).
LIFETIMES = 1024
# Groups that neighbourhoods are dealt to for description; a neighbourhood is at most 41 * 40 / 2 pairs.
OWNER_GROUPS = 4096
# Points in a block of those that meet in a task, and distances it looks at together (2 MB).
POINTS, POINT_CELLS = 8192, 1 << 18
# Members of the neighbourhoods whose prices are described together, some dozen runs for each.
NEIGHBOURS_DEALT = 4096
# Rows (neighbourhood, member) of a group whose series come to one task, and how many a small table is dealt in, so that every core has some.
HOOD_ROWS, FEW_ROWS, FEW_GROUPS = 1 << 16, 1 << 12, 8
# Hours by members of the neighbourhoods that are laid out densely at once (some 40 MB).
DYNAMIC_CELLS = 1 << 20
# Nodes of a graph that one task describes whole (64 MB of adjacency, at most eight million pairs).
DENSE_NODES = 4096
# Graphs that are worth being described by bits.
MANY_GRAPHS = 512
SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def block_count(ids: DataFrame) -> int:
    """Blocks needed to keep about BLOCK markets in each."""
    return max(1, math.ceil(ids.select("market_id").distinct().count() / BLOCK))


def _dense(side: pd.DataFrame, times: np.ndarray):
    ids, col = np.unique(side["market_id"].to_numpy(), return_inverse=True)
    row = np.searchsorted(times, side["ts"].to_numpy())
    x, seen = np.zeros((len(times), len(ids))), np.zeros((len(times), len(ids)))
    x[row, col] = side["x"].to_numpy()
    seen[row, col] = 1.0
    return ids, x, seen


def _block_product(keys: list[str]):
    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        ba, bb = pdf["ba"].iloc[0], pdf["bb"].iloc[0]
        times = np.unique(pdf["ts"].to_numpy())
        ia, xa, va = _dense(pdf[pdf["block"] == ba], times)
        ib, xb, vb = (ia, xa, va) if ba == bb else _dense(pdf[pdf["block"] == bb], times)
        n = va.T @ vb
        left, right = np.nonzero((n > 0) & ((ia[:, None] < ib[None, :]) | (ba != bb)))
        grids = [n, xa.T @ vb, va.T @ xb, (xa * xa).T @ vb, va.T @ (xb * xb), xa.T @ xb]
        out = {s: g[left, right] for s, g in zip(SUMS, grids)}
        a, b = ia[left], ib[right]
        swap = a > b
        out["a"], out["b"] = np.where(swap, b, a), np.where(swap, a, b)
        for p, q in (("sx", "sy"), ("sxx", "syy")):
            out[p], out[q] = np.where(swap, out[q], out[p]), np.where(swap, out[p], out[q])
        res = pd.DataFrame(out)
        for k in keys:
            res[k] = pdf[k].iloc[0]
        return res[[*keys, "a", "b", *SUMS]]

    return product


def pair_sums(cells: DataFrame, keys: list[str] | None = None, blocks: int | None = None, chunk_hours: int | None = CHUNK_HOURS,
              chunk: Column | None = None) -> DataFrame:
    """Per key and pair a < b with a shared hour: n and the sums of x, y, x², y², xy over shared hours.

    `cells` holds one `x` per (keys, ts, market_id). With `chunk_hours=None` a key's hours are
    already bounded (a window) and are multiplied in one go; `chunk` names another way to cut.
    """
    keys = list(keys or [])
    blocks = blocks or block_count(cells)
    types = dict(cells.dtypes)
    schema = ", ".join(
        [f"{k} {types[k]}" for k in keys] + [f"a {types['market_id']}", f"b {types['market_id']}"]
        + [f"{s} double" for s in SUMS]
    )
    block = F.pmod(F.xxhash64("market_id"), F.lit(blocks)).cast("int")
    cut = chunk is not None or chunk_hours is not None
    if chunk is None:
        hour = lambda: F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (chunk_hours * 3600))
        chunk = hour() if chunk_hours else F.lit(0).cast("bigint")
    placed = cells.select(
        *keys, "ts", "market_id", "x", block.alias("block"), chunk.alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"),
    ).withColumns({"ba": F.least("block", "other"), "bb": F.greatest("block", "other")})
    part = placed.drop("other").groupBy(*keys, "chunk", "ba", "bb").applyInPandas(_block_product(keys), schema)
    if cut:
        part = part.groupBy(*keys, "a", "b").agg(*[F.sum(s).alias(s) for s in SUMS])
    return part.withColumn("n", F.col("n").cast("long"))


def correlations(cells: DataFrame, keys: list[str] | None = None, min_hours: int = 24, blocks: int | None = None,
                 chunk_hours: int | None = CHUNK_HOURS) -> DataFrame:
    """Pearson correlation of each pair over its shared hours; null where a series does not vary.

    Values are centred per market first, which keeps the sums well conditioned. A row for every pair leaves the tasks, sums do not.
    """
    keys = list(keys or [])
    kind = dict(cells.dtypes)["market_id"]
    told = S.pairs(S.packed(cells, keys), keys, min_hours, blocks, chunk_hours or CHUNK_HOURS)
    return told.select(*keys, F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "n", "r")


def varying(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cells of the markets whose value changes inside the key."""
    by = [*(keys or []), "market_id"]
    keep = cells.groupBy(*by).agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("hi > lo").select(*by)
    return cells.join(keep, by, "left_semi")


def correlation_summary(cells: DataFrame, min_hours: int = 24) -> DataFrame:
    """Mean and median of |r| over the pairs of markets that have one; strengths are counted where pairs meet, no pair is written."""
    return S.strength_summary(S.packed(cells, []), min_hours)


# --- overlap of lifetimes --------------------------------------------------------------------


def jaccard(mask: DataFrame, blocks: int | None = None) -> DataFrame:
    """Shared over combined active hours for each pair that shares any; other pairs are zero."""
    both = S.dots(S.packed(mask.withColumn("x", F.lit(1.0)), [], "x"), blocks)
    kind = dict(mask.dtypes)["market_id"]
    return both.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("overlap"))


class Lifetimes:
    """The distinct sets of hours in which markets are live: markets with the same hours overlap alike, so only distinct ones meet.

    A lifetime is its spans of hours, whatever their length; blocks of lifetimes meet in tasks, and what leaves a task are sums of each lifetime or
    counts of each overlap (shared and combined hours), never a pair.
    """

    def __init__(self, mask: DataFrame):
        hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
        island = F.col("hour") - F.dense_rank().over(W.partitionBy("market_id").orderBy("hour"))
        runs = mask.select("market_id", hour.alias("hour")).withColumn("island", island).groupBy("market_id", "island").agg(
            F.min("hour").alias("lo"), F.max("hour").alias("hi"), F.count("*").alias("c"))
        spans = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("lo", "hi"))), lambda r: F.array(r["lo"], r["hi"])))
        markets = cut_lineage(runs.groupBy("market_id").agg(spans.alias("spans"), F.sum("c").alias("size")))
        self.distinct = cut_lineage(markets.groupBy("spans", "size").agg(F.min("market_id").alias("life"), F.count("*").alias("markets")))
        self.members = cut_lineage(markets.join(self.distinct, ["spans", "size"]).select("market_id", "life"))

    def _met(self, lives: DataFrame, keys: list[str], told, schema: str) -> DataFrame:
        """What `told` makes of shared hours, combined hours and numbers of markets of each two blocks of lifetimes."""
        blocks = max(1, math.ceil(self.distinct.count() / LIFETIMES))
        block = F.pmod(F.xxhash64("life"), F.lit(blocks)).cast("int")
        dealt = lives.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns(
            {"ba": F.least("block", "other"), "bb": F.greatest("block", "other")})

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            ba, bb = pdf["ba"].iloc[0], pdf["bb"].iloc[0]
            a = pdf[pdf["block"] == ba]
            b = a if ba == bb else pdf[pdf["block"] == bb]
            n = _shared_hours(a, b)
            out = told(a, b, n, a["size"].to_numpy()[:, None] + b["size"].to_numpy()[None, :] - n, ba == bb)
            for k in keys:
                out[k] = pdf[k].iloc[0]
            return out

        return dealt.drop("other").groupBy(*keys, "ba", "bb").applyInPandas(run, schema)

    def totals(self) -> DataFrame:
        """(market_id, total): the sum of a market's overlaps with all others."""

        def told(a, b, n, union, same):
            o = n / union
            if same:
                return pd.DataFrame({"life": a["life"], "total": o @ a["markets"].to_numpy() - np.diag(o)})
            return pd.DataFrame({"life": np.r_[a["life"], b["life"]], "total": np.r_[o @ b["markets"].to_numpy(), o.T @ a["markets"].to_numpy()]})

        kind = self.distinct.schema["life"].dataType.simpleString()
        sums = self._met(self.distinct, [], told, f"life {kind}, total double").groupBy("life").agg(F.sum("total").alias("total"))
        return self.members.join(sums, "life").select("market_id", "total")

    def counts(self, kept: DataFrame | None = None) -> DataFrame:
        """(universe, overlap, weight): how many pairs of markets have each overlap above zero, of all or of those that `kept` (universe, market_id) lists."""
        if kept is None:
            lives = self.distinct.withColumn("universe", F.lit("all"))
        else:
            chosen = kept.join(self.members, "market_id").groupBy("universe", "life").agg(F.count("*").alias("markets"))
            lives = chosen.join(self.distinct.drop("markets"), "life")

        def told(a, b, n, union, same):
            wa, wb = a["markets"].to_numpy(np.float64), b["markets"].to_numpy(np.float64)
            pairs = np.outer(wa, wb)
            if same:
                pairs = np.triu(pairs, 1) + np.diag(wa * (wa - 1) / 2)
            i, j = np.nonzero((n > 0) & (pairs > 0))
            shared, together = n[i, j].astype(np.int64), union[i, j].astype(np.int64)
            wide = int(together.max(initial=0)) + 1
            code, at = np.unique(shared * wide + together, return_inverse=True)
            weight = np.bincount(at, weights=pairs[i, j], minlength=len(code))
            return pd.DataFrame({"n": (code // wide).astype(float), "together": (code % wide).astype(float), "weight": weight.astype(np.int64)})

        found = self._met(lives, ["universe"], told, "universe string, n double, together double, weight long")
        return found.groupBy("universe", "n", "together").agg(F.sum("weight").alias("weight")).select("universe", (F.col("n") / F.col("together")).alias("overlap"), "weight")


def _shared_hours(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Hours that lifetimes of two blocks share, a chunk of hours at a time."""

    def live(side: pd.DataFrame, first: int) -> np.ndarray:
        x = np.zeros((CHUNK_HOURS, len(side)))
        for j, spans in enumerate(side["spans"]):
            for lo, hi in np.asarray(spans).reshape(-1, 2) - first:
                x[max(lo, 0):max(hi + 1, 0), j] = 1.0
        return x

    if a.empty or b.empty:
        return np.zeros((len(a), len(b)))
    ends = [np.concatenate(list(side["spans"])) for side in (a, b)]
    first, last = max(e.min() for e in ends), min(e.max() for e in ends)
    n = np.zeros((len(a), len(b)))
    for at in range(first, last + 1, CHUNK_HOURS):
        x = live(a, at)
        n += x.T @ (x if a is b else live(b, at))
    return n


def average_overlap(lives: Lifetimes, columns: DataFrame) -> DataFrame:
    """Mean overlap of each market with all the others; pairs without a shared hour count as zero."""
    ids = columns.select("market_id").distinct()
    others = ids.agg(F.count("*") - 1).scalar()
    return ids.join(lives.totals(), "market_id", "left").select(
        "market_id", (F.coalesce("total", F.lit(0.0)) / F.nullif(others, F.lit(0))).alias("average_overlap")
    )


def overlap_stats(lives: Lifetimes, columns: DataFrame) -> DataFrame:
    """Mean, median, smallest and largest overlap and its shares over every pair of columns."""
    pairs = cut_lineage(lives.counts().select("overlap", "weight"))
    m = columns.select("market_id").distinct().agg(F.count("*").alias("m"))
    over = lambda least: F.coalesce(F.sum(F.when(F.col("overlap") >= least, F.col("weight"))), F.lit(0))
    seen = pairs.agg(
        F.coalesce(F.sum("weight"), F.lit(0)).alias("seen"), F.sum(F.col("overlap") * F.col("weight")).alias("total"), F.min("overlap").alias("lo"),
        F.max("overlap").alias("hi"), over(0.10).alias("ge10"), over(0.25).alias("ge25"),
    ).withColumn("m", m.scalar())
    out = seen.withColumn("pairs", (F.col("m") * (F.col("m") - 1) / 2).cast("long"))
    zeros = out.select(F.lit(0.0).alias("overlap"), (F.col("pairs") - F.col("seen")).alias("weight")).where("weight > 0")
    weighted = pairs.unionByName(zeros)
    middle = ordered.quantiles(weighted, [], "overlap", {"v": 0.5}, weight="weight").select("v")
    total = F.nullif(F.col("pairs"), F.lit(0))
    return out.select(
        "pairs", (F.col("total") / total).alias("mean_overlap"), middle.scalar().alias("median_overlap"),
        F.when(F.col("seen") < F.col("pairs"), 0.0).otherwise(F.col("lo")).alias("min_overlap"),
        F.col("hi").alias("max_overlap"),
        ((F.col("pairs") - F.col("seen")) / total).alias("share_zero"),
        (F.col("ge10") / total).alias("share_ge_10"), (F.col("ge25") / total).alias("share_ge_25"),
    )


# --- graphs over all markets -----------------------------------------------------------------


def connected_labels(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest node id reachable from each node of the edge list, per key.

    Each round takes the smallest label among neighbours and then follows it one step, so the
    number of rounds grows with the logarithm of the path length. Rounds are checkpointed.
    """
    both = edges.select(*keys, F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        edges.select(*keys, F.col("b").alias("src"), F.col("a").alias("dst"))
    )
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(*keys, F.col("src").alias("node")).agg(
        F.least(F.min("dst"), F.col("src")).alias("label")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "src"), [*keys, "src"]).groupBy(
            *keys, F.col("dst").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, [*keys, "node"], "left").withColumn("near", F.least("label", "heard"))
        hop = labels.select(*keys, F.col("node").alias("near"), F.col("label").alias("far"))
        step = near.join(hop, [*keys, "near"], "left").select(
            *keys, "node", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved"))
        step = cut_lineage(step)
        labels = step.drop("moved")
        if step.where("moved").isEmpty():
            return labels


def triangle_counts(edges: DataFrame, degrees: DataFrame, keys: list[str]) -> DataFrame:
    """Triangles per key. Edges point from the lower-degree end, which bounds the wedges at any hub."""
    da = degrees.select(*keys, F.col("node").alias("a"), F.col("degree").alias("da"))
    db = degrees.select(*keys, F.col("node").alias("b"), F.col("degree").alias("db"))
    e = edges.join(da, [*keys, "a"]).join(db, [*keys, "b"])
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = e.select(*keys, F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedge = out.join(out.withColumnRenamed("v", "w"), [*keys, "u"]).where("v < w").select(
        *keys, F.col("v").alias("a"), F.col("w").alias("b"))
    closed = wedge.join(edges.select(*keys, "a", "b"), [*keys, "a", "b"])
    return closed.groupBy(*keys).agg(F.count("*").alias("triangles"))


def graph_features(edges: DataFrame, sizes: DataFrame, keys: list[str], joins: DataFrame | None = None) -> DataFrame:
    """Components, cycle rank, edge density, mean degree and clustering per key.

    `edges` lists a < b once; `sizes` gives the number of nodes `n` of every key, edges or not. `joins` may bring (keys, joins), by how many
    a key has fewer components than nodes, as a spanning forest tells; otherwise components are labelled.
    """
    ends = edges.select(*keys, F.explode(F.array("a", "b")).alias("node"))
    degrees = ends.groupBy(*keys, "node").agg(F.count("*").alias("degree"))
    shape = degrees.groupBy(*keys).agg(
        (F.sum("degree") / 2).cast("long").alias("edges"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("triples"))
    if joins is None:
        joins = connected_labels(edges, keys).groupBy(*keys).agg(F.count_if(F.col("node") != F.col("label")).alias("joins"))
    out = sizes.join(shape, keys, "left").join(joins, keys, "left").join(triangle_counts(edges, degrees, keys), keys, "left")
    zero = {c: 0 for c in ("edges", "triples", "joins", "triangles")}
    return describe_graph(out.na.fill(zero).withColumn("components", F.col("n") - F.col("joins")), keys)


def describe_graph(counts: DataFrame, keys: list[str]) -> DataFrame:
    n, e = F.col("n"), F.col("edges")
    return counts.select(
        *keys, n.cast("long").alias("nodes"), e.cast("long").alias("edges"), F.col("components").cast("long").alias("components"),
        F.greatest(e - n + F.col("components"), F.lit(0)).cast("long").alias("cycle_rank"),
        (e / F.greatest(n * (n - 1) / 2.0, F.lit(1.0))).alias("edge_density"),
        F.when(n > 0, 2.0 * e / F.nullif(n, F.lit(0))).otherwise(0.0).alias("avg_degree"),
        F.when(F.col("triples") > 0, 3.0 * F.col("triangles") / F.nullif(F.col("triples"), F.lit(0))).otherwise(0.0).alias("clustering"),
    )


def threshold_edges(corr: DataFrame, keys: list[str], thresholds=THRESHOLDS) -> DataFrame:
    """Pairs whose |r|, to nine places, reaches each threshold, one row per threshold `t`."""
    rows = corr.withColumn("t", F.explode(F.array([F.lit(float(t)) for t in thresholds])))
    return rows.where(F.round(F.abs("r"), 9) >= F.col("t")).select(*keys, "t", "a", "b")


def _component_count(adj: np.ndarray) -> int:
    """Components of a graph by its adjacency; every node takes the smallest label around it, and that one's label."""
    label = np.arange(len(adj))
    while True:
        near = np.minimum(label, np.where(adj, label, len(adj)).min(axis=1, initial=len(adj)))
        near = near[near]
        if (near == label).all():
            return len(np.unique(label))
        label = near


def _whole_graphs(corr: DataFrame, keys: list[str], thresholds, tasks: int) -> DataFrame:
    """(keys, t, edges, triples, joins, triangles) of graphs of at most DENSE_NODES nodes: a task takes a graph's pairs and describes it at every threshold."""
    types = dict(corr.dtypes)
    names = [*keys, "t", "edges", "triples", "joins", "triangles"]

    def describe(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.r_[pdf["a"].to_numpy(), pdf["b"].to_numpy()], return_inverse=True)
        i, j = at[:len(pdf)], at[len(pdf):]
        w, rows = np.round(np.abs(pdf["r"].to_numpy(dtype=float)), 9), []
        for t in thresholds:
            hit = w >= t
            near = np.zeros((len(ids), len(ids)), np.float32)
            near[i[hit], j[hit]] = near[j[hit], i[hit]] = 1.0
            degree = near.sum(axis=1, dtype=float)
            triangles = sum(float(np.einsum("ij,ij->", near[s:s + BLOCK] @ near, near[s:s + BLOCK], dtype=float)) for s in range(0, len(ids), BLOCK)) / 6.0
            rows.append([*pdf[keys].iloc[0], float(t), int(hit.sum()), (degree * (degree - 1) / 2).sum(), len(ids) - _component_count(near > 0), round(triangles)])
        return pd.DataFrame(rows, columns=names)

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "t double, edges long, triples double, joins long, triangles long"])
    return corr.select(*keys, "a", "b", "r").repartition(tasks, *keys).groupBy(*keys).applyInPandas(describe, schema)


def threshold_graphs(corr: DataFrame, sizes: DataFrame, keys: list[str], thresholds=THRESHOLDS) -> DataFrame:
    """The graph features at every threshold. A graph of few nodes is described whole in a task, wedges of dense ones are not written out; otherwise
    components of all thresholds come from one spanning forest."""
    most, graphs = sizes.agg(F.max("n"), F.count("*")).first()
    if keys and (most or 0) <= DENSE_NODES:
        per_t = sizes.withColumn("t", F.explode(F.array([F.lit(float(t)) for t in thresholds])))
        told = per_t.join(_whole_graphs(corr, keys, thresholds, max(1, min(4096, 2 * graphs))), [*keys, "t"], "left")
        return describe_graph(told.na.fill(0, ["edges", "triples", "joins", "triangles"]).withColumn("components", F.col("n") - F.col("joins")), [*keys, "t"])
    per_t = sizes.withColumn("t", F.explode(F.array([F.lit(float(t)) for t in thresholds])))
    forest = spanning_forest(corr.select(*keys, "a", "b", F.round(F.abs("r"), 9).alias("w")), keys)
    return graph_features(threshold_edges(corr, keys, thresholds), per_t, [*keys, "t"], joins_at(forest, keys, thresholds))


# --- neighbourhoods --------------------------------------------------------------------------


def _both_ways(pairs: DataFrame, keep: list[str]) -> DataFrame:
    return pairs.select(F.col("a").alias("owner"), F.col("b").alias("member"), *keep).unionByName(
        pairs.select(F.col("b").alias("owner"), F.col("a").alias("member"), *keep))


def nearest(ranked: DataFrame, order: list, k: int, keys: list[str] | None = None) -> DataFrame:
    by = W.partitionBy(*(keys or []), "owner").orderBy(*order)
    return ranked.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_corr_neighbors(corr: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """The k markets most correlated with each market of a key, a missing r counting as zero, ties by id."""
    strength = F.round(F.coalesce(F.abs("r"), F.lit(0.0)), 9)
    return nearest(_both_ways(corr.withColumn("w", strength), [*(keys or []), "w"]), [F.col("w").desc(), F.col("member")], k, keys)


def nearest_points(points: DataFrame, k: int, blocks: int) -> DataFrame:
    """The k nearest others of each market by Euclidean distance between its `x` arrays, ties by id.

    Blocks of markets are compared in numpy and each task keeps k per market, so distances are never written out; the k best over all blocks
    follow from those. A matrix product tells who may be among the k, with room for its rounding and for ties; only their distances are taken one by one.
    """
    id_type = dict(points.dtypes)["market_id"]
    block = F.pmod(F.xxhash64("market_id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    base = points.select("market_id", "x", block.alias("block"))
    asks = base.select("market_id", "x", F.lit(True).alias("asks"), F.col("block").alias("qb"), every.alias("cb"))
    offers = base.select("market_id", "x", F.lit(False).alias("asks"), every.alias("qb"), F.col("block").alias("cb"))

    def closest(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, other = pdf[pdf["asks"]], pdf[~pdf["asks"]].sort_values("market_id")
        if mine.empty or other.empty:
            return pd.DataFrame({"owner": [], "member": [], "dist": []})
        q, c = np.vstack(mine["x"].to_numpy()).astype(float), np.vstack(other["x"].to_numpy()).astype(float)
        qi, ci = mine["market_id"].to_numpy(), other["market_id"].to_numpy()
        own, member, dist = [], [], []
        reach, width = (c * c).sum(axis=1), max(1, POINT_CELLS // len(c))
        for at in range(0, len(q), width):
            part = q[at:at + width]
            size = (part * part).sum(axis=1)
            with np.errstate(invalid="ignore", over="ignore"):
                square = (-2.0 * part) @ c.T
                square += size[:, None]
                square += reach
            square[qi[at:at + width, None] == ci] = np.nan
            last = np.partition(square, k - 1, axis=1)[:, k - 1] if len(ci) >= k else np.full(len(part), np.inf)
            last = np.where(np.isnan(last), np.inf, np.maximum(last, 0.0))
            room = 4e-9 * (np.sqrt(last) + 1.0) + 1e-12 * (size + np.nanmax(reach, initial=0.0))
            room = np.where(np.isnan(room), np.inf, room)
            for i in range(len(part)):
                some = np.flatnonzero(square[i] <= last[i] + room[i])
                gap = np.sqrt(((c[some] - part[i]) ** 2).sum(axis=1))
                best = np.argsort(np.round(gap, 9), kind="stable")[:k]
                own.append(np.full(len(best), qi[at + i]))
                member.append(ci[some[best]])
                dist.append(gap[best])
        out = pd.DataFrame({"owner": np.concatenate(own), "member": np.concatenate(member), "dist": np.concatenate(dist)})
        return out[np.isfinite(out["dist"])].groupby("owner", sort=False).head(k)

    schema = f"owner {id_type}, member {id_type}, dist double"
    near = asks.unionAll(offers).groupBy("qb", "cb").applyInPandas(closest, schema)
    return nearest(near, [F.round("dist", 9), F.col("member")], k)


def point_blocks(points: DataFrame) -> int:
    """How many blocks of points keep two of them well inside a task."""
    return max(1, math.ceil(points.count() / POINTS))


def random_neighbors(ids: DataFrame, k: int, seed: int, keys: list[str] | None = None) -> DataFrame:
    """k other markets per market of a key, drawn by digests of the seed, the owner and the draw: the placebo neighbourhood.

    Each owner makes 3k + 8 draws of a place on the listed markets; repeats and the owner are passed over. Behind them come the k + 1 places from a
    drawn start on, so that an owner has min(k, m - 1) neighbours in any case. No market is compared with all others.
    """
    keys = list(keys or [])
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("market_id")))
    ids = ids.select(*keys, "market_id").distinct().withColumns({"key": key, "one": F.lit(1)})
    listed = ordered.running_sum(ids, keys, [F.col("key"), F.col("market_id")], ["one"])
    listed = cut_lineage(listed.select(*keys, "market_id", (F.col("one_upto") - 1).alias("place")))
    sizes = listed.groupBy(*keys).agg(F.count("*").alias("m"))
    owners = (listed.join(sizes, keys) if keys else listed.withColumn("m", sizes.scalar())).select(*keys, F.col("market_id").alias("owner"), "m")
    draws, last = 3 * k + 8, F.col("j") > 3 * k + 8
    owners = owners.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(draws + k + 1))))
    text = F.concat_ws(":", F.lit(seed), F.col("owner"), F.when(last, F.lit(0)).otherwise(F.col("j")))
    draw = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
    drawn = owners.withColumn("place", (draw + F.when(last, F.col("j") - draws - 1).otherwise(F.lit(0))) % F.col("m"))
    met = drawn.join(listed.withColumnRenamed("market_id", "member"), [*keys, "place"]).where("member <> owner")
    first = met.groupBy(*keys, "owner", "member").agg(F.min("j").alias("j"))
    return nearest(first, [F.col("j")], k, keys).select(*keys, "owner", "member", "rank")


def with_owner(neighbors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, owner, member) including the owner itself."""
    by = [*(keys or []), "owner"]
    return neighbors.select(*by, "member").unionByName(neighbors.select(*by, F.col("owner").alias("member")).distinct())


def _small_graph(n: int, a: np.ndarray, b: np.ndarray):
    """Edges, components, triangles and connected triples of a graph of a few dozen nodes."""
    adj = np.zeros((n, n))
    adj[a, b] = adj[b, a] = 1.0
    reach = adj + np.eye(n)
    for _ in range(max(1, math.ceil(math.log2(n + 1)))):
        reach = np.minimum(reach @ reach, 1.0)
    degree = adj.sum(axis=0)
    return len(a), float((1.0 / reach.sum(axis=0)).sum()), np.trace(adj @ adj @ adj) / 6.0, (degree * (degree - 1) / 2).sum()


class Strengths:
    """Correlations of the markets of each key, told where a neighbourhood's series meet: it stands for a table of pairs that is never written."""

    def __init__(self, cells: DataFrame, keys: list[str] | None = None, min_hours: int = 2):
        self.keys, self.min_hours = list(keys or []), min_hours
        self.series = S.packed(cells, self.keys)


class Hoods:
    """The neighbourhoods of a group with as many members each: their prices and presence (neighbourhood, member, hour)."""

    def __init__(self, heads: pd.DataFrame, size: np.ndarray, x: np.ndarray, seen: np.ndarray):
        self.heads, self.size, self.x, self.seen = heads, size, x, seen

    def strengths(self, min_hours: int) -> np.ndarray:
        """|r| of every two members over the hours they share, zero where there is none and on the diagonal."""
        v = self.seen.astype(float)
        c = np.where(self.seen, self.x - (self.x.sum(axis=2) / np.maximum(v.sum(axis=2), 1))[:, :, None], 0.0)
        turned = c.transpose(0, 2, 1)
        if self.seen.all():
            a, q = c.sum(axis=2), (c * c).sum(axis=2)
            grids = (np.float64(c.shape[2]), a[:, :, None], a[:, None, :], q[:, :, None], q[:, None, :], c @ turned)
        else:
            present, square = v.transpose(0, 2, 1), c * c
            grids = (v @ present, c @ present, v @ turned, square @ present, v @ square.transpose(0, 2, 1), c @ turned)
        w = np.abs(np.nan_to_num(S.correlation(grids, min_hours)))
        w[:, np.arange(w.shape[1]), np.arange(w.shape[1])] = 0.0
        return w


def _hoods(group: np.ndarray, member: np.ndarray, series: pd.DataFrame, heads: pd.DataFrame, size: np.ndarray):
    """The neighbourhoods of a group, few at a time; `group` and `member` are the rows of those that have a series. Neighbourhoods without any come with no member."""
    ids, of = np.unique(series["member"].to_numpy(), return_inverse=True)
    order = np.argsort(of, kind="stable")
    lo, n, x = (np.concatenate([*series[c].to_numpy()[order], np.zeros(0, kind)]) for c, kind in (("lo", np.int64), ("n", np.int64), ("x", float)))
    ends = np.r_[0, np.cumsum(np.bincount(of, weights=[len(r) for r in series["lo"]], minlength=len(ids)))].astype(np.int64)
    first = int(lo.min()) if len(lo) else 0
    hours = int((lo + n).max()) - first if len(lo) else 0
    met = np.unique(np.stack([group, np.searchsorted(ids, member)]), axis=1)
    many = np.bincount(met[0], minlength=len(heads))
    start = np.r_[0, np.cumsum(many)]
    for width in np.unique(many):
        alike = np.flatnonzero(many == width)
        step = max(1, DYNAMIC_CELLS // max(1, hours * width))
        for at in range(0, len(alike), step):
            mine = alike[at:at + step]
            slots, place = np.unique(met[1][(start[mine][:, None] + np.arange(width)).ravel()], return_inverse=True)
            runs = ends[slots + 1] - ends[slots]
            own = np.repeat(ends[slots] - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
            long = n[own]
            spot = (np.repeat(np.repeat(np.arange(len(slots)), runs), long), np.repeat(lo[own] - first - np.cumsum(long) + long, long) + np.arange(long.sum()))
            p, seen = np.zeros((len(slots), hours)), np.zeros((len(slots), hours), bool)
            p[spot], seen[spot] = np.repeat(x[own], long), True
            shape = (len(mine), width, hours)
            yield Hoods(heads.iloc[mine], size[mine], p[place].reshape(shape), seen[place].reshape(shape))


def _meet_hoods(own: DataFrame, corr: Strengths, by: list[str], schema: str, tell) -> DataFrame:
    """(by, `schema`): what `tell` makes of the neighbourhoods (by, member), whose series meet in the task that describes them.

    Neighbourhoods are dealt to groups by owner, and a series comes to a group once, however many of its neighbourhoods it is in: what is shuffled
    grows with neighbourhoods and members, not with pairs of markets.
    """
    shared = corr.keys
    rows = {tuple(r)[:-1]: r["m"] for r in own.groupBy(*shared).agg(F.count("*").alias("m")).collect()}
    most = max(rows.values(), default=0)
    groups = max(1, math.ceil(most / HOOD_ROWS), min(FEW_GROUPS, math.ceil(most / FEW_ROWS)))
    head = [*shared, "__deal"]
    dealt = own.withColumn("__deal", F.pmod(F.xxhash64("owner"), F.lit(groups)))
    part = lambda c, kind: F.transform("runs", lambda r: r[c].cast(kind)).alias(c)
    series = corr.series.select(*shared, F.col("market_id").alias("member"), part("lo", "int"), part("n", "int"), part("x", "double"))
    needed = dealt.where("member IS NOT NULL").select(*head, F.col("member").cast("long").alias("member")).distinct().join(series, [*shared, "member"])
    types = dict(own.dtypes)
    whole = ", ".join([*(f"{k} {types[k]}" for k in by), schema])
    names = [f.split()[0] for f in whole.split(", ")]

    def describe(hoods: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if hoods.empty:
            return pd.DataFrame(columns=names)
        group = hoods.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
        heads = hoods.loc[~pd.Series(group, index=hoods.index).duplicated(), by].reset_index(drop=True)
        known = hoods["member"].isin(found["member"]).to_numpy()
        out = [tell(h) for h in _hoods(group[known], hoods["member"].to_numpy()[known].astype(np.int64), found, heads, np.bincount(group))]
        return pd.concat(out)[names]

    # Few bytes mean much work here, so the number of tasks follows the groups.
    tasks = min(4096, 2 * groups * max(1, len(rows)))
    right = [f"of_{c}" for c in head]
    needed = needed.select(*[F.col(c).alias(r) for c, r in zip(head, right)], "member", "lo", "n", "x")
    return dealt.repartition(tasks, *head).groupBy(*head).cogroup(needed.repartition(tasks, *right).groupBy(*right)).applyInPandas(describe, whole)


def _met_graphs(own: DataFrame, corr: Strengths, by: list[str], thresholds) -> DataFrame:
    least = corr.min_hours

    def tell(hoods: Hoods) -> pd.DataFrame:
        w = np.round(hoods.strengths(least), 9)
        w[:, np.arange(w.shape[1]), np.arange(w.shape[1])] = -1.0
        out = []
        for t in thresholds:
            e, c, tri, trip = _small_graphs(w >= t)
            out.append(hoods.heads.assign(t=float(t), n=hoods.size, edges=e.astype(int), components=(c + hoods.size - w.shape[1]).astype(int), triangles=tri, triples=trip))
        return pd.concat(out)

    return _meet_hoods(own, corr, by, "t double, n long, edges long, components long, triangles double, triples double", tell)


def _met_controls(own: DataFrame, corr: Strengths, by: list[str]) -> DataFrame:
    least = corr.min_hours

    def tell(hoods: Hoods) -> pd.DataFrame:
        w, m = hoods.strengths(least), hoods.x.shape[1]
        i, j = np.triu_indices(m, 1)
        pairs, told = hoods.size * (hoods.size - 1) / 2, len(i)
        mean = w[:, i, j].sum(axis=1) / np.maximum(pairs, 1)
        square = ((w[:, i, j] - mean[:, None]) ** 2).sum(axis=1) + (pairs - told) * mean ** 2
        seen = hoods.seen.sum(axis=1)
        hourly = hoods.x.sum(axis=1) / np.maximum(seen, 1)
        rest = np.where(hoods.seen, hoods.x - hourly[:, None, :], 0.0)
        spread = np.sqrt((rest * rest).sum(axis=1) / np.maximum(seen, 1))
        hours = np.maximum((seen > 0).sum(axis=1), 1)
        out = hoods.heads.assign(corr_mean_abs=mean, corr_std_abs=np.sqrt(square / np.maximum(pairs, 1)), prob_mean=hourly.sum(axis=1) / hours, prob_std=spread.sum(axis=1) / hours)
        return out[(pairs > 0) & (m > 0)]

    return _meet_hoods(own, corr, by, "corr_mean_abs double, corr_std_abs double, prob_mean double, prob_std double", tell)


def neighborhood_graphs(neighbors: DataFrame, corr: DataFrame | Strengths, keys: list[str] | None = None, thresholds=THRESHOLDS) -> DataFrame:
    """Graph features of each market's neighbourhood, at most k + 1 nodes, per key and threshold.

    Each needed pair's correlation is computed once and attached to the owners that share it; a neighbourhood without a joined pair has no edges.
    `corr` may have keys of its own (a window), in which every neighbourhood is described. With `Strengths` instead of a table of pairs, correlations are
    taken from the members' series where a neighbourhood is described.
    """
    keys = list(keys or [])
    if isinstance(corr, Strengths):
        return describe_graph(_met_graphs(with_owner(neighbors, keys), corr, [*keys, "owner"], thresholds), [*keys, "owner", "t"])
    mine = [c for c in keys if c in neighbors.columns]
    shared = [c for c in mine if c in corr.columns]
    own = with_owner(neighbors, mine)
    sizes = own.groupBy(*mine, "owner").agg(F.count("*").alias("n"))
    inner = own.withColumnRenamed("member", "a").join(own.withColumnRenamed("member", "b"), [*mine, "owner"]).where("a < b")
    weighted = inner.join(corr, [*shared, "a", "b"]).select(*keys, "owner", "a", "b", F.coalesce("r", F.lit(0.0)).alias("r"))
    weighted = weighted.join(sizes, [*mine, "owner"])
    types, by = dict(weighted.dtypes), [*keys, "owner"]

    def describe(whole: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for head, pdf in whole.groupby(by, sort=False):
            ids = np.unique(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]))
            a, b = np.searchsorted(ids, pdf["a"].to_numpy()), np.searchsorted(ids, pdf["b"].to_numpy())
            strength, n = np.round(np.abs(pdf["r"].to_numpy()), 9), int(pdf["n"].iloc[0])
            for t in thresholds:
                hit = strength >= t
                e, c, tri, trip = _small_graph(max(n, len(ids)), a[hit], b[hit])
                rows.append([*head, float(t), n, e, round(c), float(tri), float(trip)])
        return pd.DataFrame(rows, columns=[*by, "t", "n", "edges", "components", "triangles", "triples"])

    # Neighbourhoods are dealt to groups, so that a group has many of them.
    schema = ", ".join(f"{k} {types[k]}" for k in by) + ", t double, n long, edges long, components long, triangles double, triples double"
    dealt = weighted.withColumn("__deal", F.pmod(F.xxhash64(*by), F.lit(OWNER_GROUPS)))
    told = dealt.groupBy("__deal").applyInPandas(describe, schema)
    if set(keys) == set(mine):
        every = sizes.withColumn("t", F.explode(F.array([F.lit(float(t)) for t in thresholds])))
        bare = every.join(told, [*by, "t"], "left_anti").select(
            *by, "t", "n", F.lit(0).cast("long").alias("edges"), F.col("n").alias("components"), F.lit(0.0).alias("triangles"), F.lit(0.0).alias("triples"))
        told = told.unionByName(bare)
    return describe_graph(told, [*by, "t"])


def neighborhood_controls(neighbors: DataFrame, corr: DataFrame | Strengths, cells: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Mean and spread of |r| inside each neighbourhood, and of its members' prices over the hours.

    Prices come as runs of hours with one value, so a neighbourhood is a row for each member and thousand hours, never one for every hour. `Strengths` bring the
    prices along with the correlations.
    """
    keys = list(keys or [])
    if isinstance(corr, Strengths):
        return _met_controls(with_owner(neighbors, keys), corr, [*keys, "owner"])
    shared = [c for c in keys if c in corr.columns]
    own, by = with_owner(neighbors, keys), [*keys, "owner"]
    inner = own.withColumnRenamed("member", "a").join(own.withColumnRenamed("member", "b"), by).where("a < b")
    edges = inner.join(corr, [*shared, "a", "b"], "left").groupBy(*by).agg(
        F.avg(F.coalesce(F.abs("r"), F.lit(0.0))).alias("corr_mean_abs"),
        F.stddev_pop(F.coalesce(F.abs("r"), F.lit(0.0))).alias("corr_std_abs"))
    return edges.join(neighborhood_prices(own, cells, by, shared), by)


def neighborhood_prices(own: DataFrame, cells: DataFrame, by: list[str], shared: list[str]) -> DataFrame:
    """(by, prob_mean, prob_std): over the hours of each neighbourhood, the averages of its members' mean price and of their deviation."""
    types = dict(own.dtypes)
    series = S.packed(cells, shared).withColumnRenamed("market_id", "member")
    met = own.join(series, [*shared, "member"]).select(
        *by, F.transform("runs", lambda r: r["lo"]).alias("lo"), F.transform("runs", lambda r: r["n"]).alias("n"), F.transform("runs", lambda r: r["x"]).alias("x"))

    def describe(whole: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for head, pdf in whole.groupby(by, sort=False):
            lo, n, x = (np.concatenate(pdf[c].to_numpy()) for c in ("lo", "n", "x"))
            hour = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum()) - lo.min()
            p, seen = np.repeat(x, n), np.bincount(hour)
            mean = np.bincount(hour, p) / np.maximum(seen, 1)
            spread = np.sqrt(np.bincount(hour, (p - mean[hour]) ** 2) / np.maximum(seen, 1))
            rows.append([*head, mean.sum() / np.count_nonzero(seen), spread.sum() / np.count_nonzero(seen)])
        return pd.DataFrame(rows, columns=[*by, "prob_mean", "prob_std"])

    # Neighbourhoods are dealt to groups, so that a group has many of them.
    schema = ", ".join(f"{k} {types[k]}" for k in by) + ", prob_mean double, prob_std double"
    groups = F.pmod(F.xxhash64(*by), F.greatest(F.ceil(own.agg(F.count("*") / NEIGHBOURS_DEALT).scalar()), F.lit(1)))
    return met.withColumn("__deal", groups).groupBy("__deal").applyInPandas(describe, schema)


def _bit_graphs(adj: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same with a node's neighbours in the bits of one number, for very many graphs."""
    n = adj.shape[1]
    place = np.arange(n, dtype=np.uint64)
    one = np.uint64(1) << place
    bits = np.ascontiguousarray((adj * one).sum(axis=2, dtype=np.uint64).T)
    degree, triangles = np.bitwise_count(bits).astype(np.int64), np.zeros(len(adj), np.int64)
    for i in range(n - 1):
        linked = (bits[i] >> place[i + 1:, None]) & np.uint64(1)
        triangles += (np.bitwise_count(bits[i] & bits[i + 1:]) * linked).sum(axis=0).astype(np.int64)
    reach = bits | one[:, None]
    for k in range(n):
        reach |= reach[k] * ((reach >> place[k]) & np.uint64(1))
    components = ((reach & (one - np.uint64(1))[:, None]) == 0).sum(axis=0)
    return degree.sum(axis=0) / 2.0, components.astype(float), triangles / 3.0, (degree * (degree - 1) / 2).sum(axis=0)


def _small_graphs(adj: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges, components, triangles and connected triples of many graphs of a few dozen nodes, from their adjacency (graph, node, node)."""
    if len(adj) >= MANY_GRAPHS and adj.shape[1] <= 62:
        return _bit_graphs(adj)
    near = adj.astype(np.float32)
    reach = near + np.eye(adj.shape[1], dtype=np.float32)
    for _ in range(max(1, math.ceil(math.log2(adj.shape[1] + 1)))):
        reach = np.minimum(reach @ reach, 1.0)
    degree = near.sum(axis=2, dtype=float)
    triangles = np.einsum("gij,gij->g", near @ near, near, dtype=float) / 6.0
    return degree.sum(axis=1) / 2.0, np.round((1.0 / reach.sum(axis=2, dtype=float)).sum(axis=1)), triangles, (degree * (degree - 1) / 2).sum(axis=1)


def dynamic_neighborhood_graphs(
    cells: DataFrame, index: DataFrame, neighbors: DataFrame, windows: int | tuple[int, ...], stride: int, thresholds=THRESHOLDS, keys: list[str] | None = None,
) -> DataFrame:
    """Neighbourhood graphs in each strided trailing window, of one length or of several (then `window_hours` tells which).

    A neighbourhood's series come as runs of hours with one value and are met in the task that describes it, in every window: no pair of markets is written, so
    the work follows owners * k² * hours and what is shuffled only the runs. Values are met by hour, whatever hours a market has.
    """
    keys = list(keys or [])
    lengths = (windows,) if isinstance(windows, int) else tuple(windows)
    by = [*keys, "owner"]
    own = with_owner(neighbors, keys)
    sizes = own.groupBy(*by).agg(F.count("*").alias("size"))
    met = own.join(S.packed(cells, []).withColumnRenamed("market_id", "member"), "member").join(sizes, by).select(
        *by, "member", "size", F.transform("runs", lambda r: r["lo"]).alias("lo"), F.transform("runs", lambda r: r["n"]).alias("n"), F.transform("runs", lambda r: r["x"]).alias("x"))
    types = dict(own.dtypes)
    # One number for every `stride` hours of the index.
    ends = {w: sorted(r["h"] for r in P.window_ends(index, w, stride).select(S.unix_hour("window_end").cast("long").alias("h")).collect()) for w in lengths}
    names = [*by, "window_hours", "end", "t", "n", "edges", "components", "triangles", "triples"]
    empty = pd.DataFrame(columns=names)

    def tell(heads: pd.DataFrame, size: np.ndarray, seen: np.ndarray, x: np.ndarray, first: int):
        """The graphs of a few neighbourhoods: presence and values are (neighbourhood, hour, place), hours from `first` on."""
        for w in lengths:
            for end in ends[w]:
                span = slice(max(end - w + 1 - first, 0), max(end + 1 - first, 0))
                here, p = seen[:, span], x[:, span]
                hours = here.sum(axis=1)
                able = (hours > 0).sum(axis=1) >= 2
                if not able.any():
                    continue
                here, p, hours = here[able], p[able], hours[able]
                varies = np.where(here, p, -np.inf).max(axis=1) > np.where(here, p, np.inf).min(axis=1)
                rest = np.where(here, p - (p.sum(axis=1) / np.maximum(hours, 1))[:, None], 0.0)
                norm = np.where(varies, np.sqrt((rest * rest).sum(axis=1)), 1.0)
                r = (rest.transpose(0, 2, 1) @ rest) / (norm[:, :, None] * norm[:, None, :])
                strength = np.where(varies[:, :, None] & varies[:, None, :], np.round(np.abs(r), 9), 0.0)
                strength[:, np.arange(x.shape[2]), np.arange(x.shape[2])] = -1.0
                for t in thresholds:
                    # A place that no member takes is a node of its own.
                    e, c, tri, trip = _small_graphs((strength >= t) & (hours > 0)[:, :, None] & (hours > 0)[:, None, :])
                    yield heads[able].assign(window_hours=w, end=end, t=float(t), n=size[able], edges=e.astype(int),
                                             components=(c + size[able] - x.shape[2]).astype(int), triangles=tri, triples=trip)

    # Windows of all lengths are made of slices of so many hours.
    grid = math.gcd(24, stride, *lengths)
    start, stop = min((e[0] - w + 1 for w, e in ends.items() if e), default=0), max((e[-1] + 1 for e in ends.values() if e), default=0)

    def tell_whole(heads: pd.DataFrame, size: np.ndarray, x: np.ndarray):
        """The same of neighbourhoods whose members all have every hour from `start` on: a slice of hours is multiplied once for all windows it is in."""
        m, _, width = x.shape
        part = x.reshape(m, -1, grid, width)
        mean, lo, hi = part.mean(axis=2), part.min(axis=2), part.max(axis=2)
        rest = part - mean[:, :, None]
        inner = rest.transpose(0, 1, 3, 2) @ rest
        for w in (w for w in lengths if ends[w]):
            k = w // grid
            at = (np.array(ends[w]) + 1 - start) // grid - k
            slices = at[:, None] + np.arange(k)
            between = mean[:, slices]
            between = between - between.mean(axis=2, keepdims=True)
            p = sum((inner[:, at + i] for i in range(1, k)), inner[:, at]) + grid * (between.transpose(0, 1, 3, 2) @ between)
            varies = hi[:, slices].max(axis=2) > lo[:, slices].min(axis=2)
            norm = np.where(varies, np.sqrt(np.einsum("...ii->...i", p)), np.inf)
            strength = np.round(np.abs(p / (norm[..., :, None] * norm[..., None, :])), 9).reshape(-1, width, width)
            strength[:, np.arange(width), np.arange(width)] = -1.0
            of = np.repeat(np.arange(m), len(at))
            told = heads.iloc[of].assign(window_hours=w, end=np.tile(ends[w], m), n=size[of])
            for t in thresholds:
                e, c, tri, trip = _small_graphs(strength >= t)
                yield told.assign(t=float(t), edges=e.astype(int), components=(c + size[of] - width).astype(int), triangles=tri, triples=trip)

    def describe(whole: pd.DataFrame) -> pd.DataFrame:
        group = whole.groupby(by, sort=False).ngroup().to_numpy()
        heads = whole.loc[~pd.Series(group, index=whole.index).duplicated(), [*by, "size"]].reset_index(drop=True)
        ids, of = np.unique(np.stack([group, whole["member"].to_numpy()]), axis=1, return_inverse=True)
        place = (np.arange(ids.shape[1]) - np.searchsorted(ids[0], ids[0]))[of.ravel()]
        width, first = int(place.max()) + 1, min(int(v.min()) for v in whole["lo"])
        hours = max(int((a + b).max()) for a, b in zip(whole["lo"], whole["n"])) - first
        out, many = [], max(1, DYNAMIC_CELLS // (hours * width))
        for a in range(0, len(heads), many):
            mine = np.flatnonzero((group >= a) & (group < a + many))
            lo, n, v = (np.concatenate(whole[c].to_numpy()[mine]) for c in ("lo", "n", "x"))
            runs = np.array([len(r) for r in whole["lo"].to_numpy()[mine]])
            at = np.repeat(lo - first - np.cumsum(n) + n, n) + np.arange(n.sum())
            spot = (np.repeat(np.repeat(group[mine] - a, runs), n), at, np.repeat(np.repeat(place[mine], runs), n))
            shape = (min(many, len(heads) - a), hours, width)
            seen, x = np.zeros(shape, bool), np.zeros(shape)
            seen[spot], x[spot] = True, np.repeat(v, n)
            some = heads.iloc[a:a + many]
            covered = slice(start - first, stop - first)
            if first <= start < stop <= first + hours and width > 1 and seen[:, covered].all():
                out += tell_whole(some[by], some["size"].to_numpy(), x[:, covered])
            else:
                out += tell(some[by], some["size"].to_numpy(), seen, x, first)
        return pd.concat(out)[names] if out else empty

    schema = ", ".join(f"{k} {types[k]}" for k in by) + ", window_hours int, end long, t double, n long, edges long, components long, triangles double, triples double"
    groups = F.pmod(F.xxhash64(*by), F.greatest(F.ceil(own.agg(F.count("*") / NEIGHBOURS_DEALT).scalar()), F.lit(1)))
    told = met.withColumn("__deal", groups).groupBy("__deal").applyInPandas(describe, schema)
    told = told.withColumn("window_end", F.timestamp_seconds(F.col("end") * 3600).cast("timestamp_ntz"))
    several = [] if isinstance(windows, int) else ["window_hours"]
    return describe_graph(told, [*several, "window_end", *by, "t"])
