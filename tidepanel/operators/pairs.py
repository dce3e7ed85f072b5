"""Pairs of markets reduced inside a blocked product, so that no table of all pairs is ever written.

Over the whole span packed series meet (`series.py`), and what leaves a task is already reduced: pairs above a threshold, a forest or the best partners
of each market. Windows are streamed: a task takes a pair of blocks and multiplies each slice of hours once, the sums of all pairs of the two blocks stay
in it, and windows of several lengths are sums of the last slices, so they share one product.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import graph as G
from tidepanel.operators import series as S
from tidepanel.operators.series import correlation, unix_hour

#: Hours multiplied at once where no windows are asked for, and slices of a chunk that one task streams.
SLICE_HOURS, CHUNK_SLICES = 1024, 28


def dealt_to_blocks(cells: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """Rows (keys, slice, hour, market_id, x) once for every pair of blocks (ba, bb) that their block is in."""
    block = F.pmod(F.xxhash64("market_id"), F.lit(blocks)).cast("int")
    placed = cells.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    placed = placed.withColumns({"ba": F.least("block", "other"), "bb": F.greatest("block", "other")}).drop("other")
    by = [*keys, "ba", "bb"]
    return placed.repartition(*by).sortWithinPartitions(*by, "slice", "hour", "market_id").select(*by, "slice", "hour", "block", "market_id", F.col("x").cast("double"))


class Side:
    """The markets of one block in the order they came."""

    def __init__(self):
        self.place: dict[int, int] = {}

    def places(self, ids: np.ndarray) -> np.ndarray:
        return np.array([self.place.setdefault(i, len(self.place)) for i in ids.tolist()], np.int64)

    def ids(self) -> np.ndarray:
        return np.array(list(self.place), np.int64)


class Block:
    """Sums n, x, y, x², y², xy of all pairs of two blocks, slice by slice; the last `held` slices are kept apart."""

    def __init__(self, same: bool, held: int):
        self.same, self.left, self.right = same, Side(), None
        self.right = self.left if same else Side()
        self.slices: deque = deque(maxlen=held)

    def multiply(self, at: int, hour: np.ndarray, ids: np.ndarray, x: np.ndarray, mine: np.ndarray, keep: bool) -> None:
        """Add the rows of a slice: `mine` marks those of the first block."""
        times, row = np.unique(hour, return_inverse=True)

        def dense(side: Side, rows: np.ndarray):
            own, col = np.unique(ids[rows], return_inverse=True)
            v, seen = np.zeros((len(times), len(own))), np.zeros((len(times), len(own)))
            v[row[rows], col], seen[row[rows], col] = x[rows], 1.0
            lo = np.where(seen > 0, v, np.inf).min(axis=0, initial=np.inf)
            hi = np.where(seen > 0, v, -np.inf).max(axis=0, initial=-np.inf)
            return side.places(own), v, seen, lo, hi

        a = dense(self.left, mine)
        b = a if self.same else dense(self.right, ~mine)
        (_, xa, va, *_), (_, xb, vb, *_) = a, b
        grids = np.stack([va.T @ vb, xa.T @ vb, va.T @ xb, (xa * xa).T @ vb, va.T @ (xb * xb), xa.T @ xb])
        if not keep and self.slices:
            grids = self.spread(grids, a[0], b[0]) + self.grown(self.slices.pop()[1])
            self.slices.append((at, grids, None, None))
            return
        self.slices.append((at, self.spread(grids, a[0], b[0]), self.bounds(a, self.left), self.bounds(b, self.right)))

    def shape(self) -> tuple[int, int]:
        return len(self.left.place), len(self.right.place)

    def spread(self, grids: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> np.ndarray:
        out = np.zeros((6, *self.shape()))
        out[:, pa_[:, None], pb[None, :]] = grids
        return out

    def grown(self, grids: np.ndarray) -> np.ndarray:
        m, n = self.shape()
        return np.pad(grids, ((0, 0), (0, m - grids.shape[1]), (0, n - grids.shape[2])))

    @staticmethod
    def bounds(part, side: Side) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.full(len(side.place), np.inf), np.full(len(side.place), -np.inf)
        lo[part[0]], hi[part[0]] = part[3], part[4]
        return lo, hi

    def last(self, first: int) -> np.ndarray:
        """The sums of the slices from `first` on."""
        out = np.zeros((6, *self.shape()))
        for at, grids, *_ in self.slices:
            if at >= first:
                out[:, :grids.shape[1], :grids.shape[2]] += grids
        return out

    def varying(self, first: int, which: int) -> np.ndarray:
        """Which markets change their value in the slices from `first` on."""
        m = self.shape()[which]
        lo, hi = np.full(m, np.inf), np.full(m, -np.inf)
        for at, _, *sides in self.slices:
            if at >= first:
                low, high = sides[which]
                lo[:len(low)], hi[:len(high)] = np.minimum(lo[:len(low)], low), np.maximum(hi[:len(high)], high)
        return hi > lo


def stream(rows: DataFrame, keys: list[str], schema: str, held: int, finish: Callable, each_slice: Callable | None = None) -> DataFrame:
    """Stream every block pair's slices through a Block. `finish(key, block)` and `each_slice(key, slice, block)` yield dicts of columns."""
    names = [f.split()[0] for f in schema.split(", ")]
    by = [*keys, "ba", "bb", "slice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"key": None, "block": None}
        kept: pa.Table | None = None
        empty = {n: [] for n in names}

        def told(found: Iterator[dict]) -> Iterator[pa.RecordBatch]:
            for out in found:
                yield pa.RecordBatch.from_pydict({n: out.get(n, empty[n]) for n in names}, schema=arrow)

        def close() -> Iterator[pa.RecordBatch]:
            if state["block"] is not None:
                yield from told(finish(state["key"][:-2], state["block"]))

        def take(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """One slice of one block pair."""
            head = tuple(t.column(k)[0].as_py() for k in by)
            if head[:-1] != state["key"]:
                yield from close()
                state["key"], state["block"] = head[:-1], Block(head[-3] == head[-2], held)
            hour, ids, x, block = (t.column(c).to_numpy() for c in ("hour", "market_id", "x", "block"))
            state["block"].multiply(head[-1], hour, ids, x, block == head[-3], each_slice is not None)
            if each_slice is not None:
                yield from told(each_slice(head[:-3], head[-1], state["block"]))

        def cuts(t: pa.Table) -> list[int]:
            change = np.zeros(t.num_rows - 1, bool)
            for k in by:
                v = t.column(k).to_numpy(zero_copy_only=False)
                change |= v[1:] != v[:-1]
            return [0, *(np.flatnonzero(change) + 1).tolist()]

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([kept, t]) if kept is not None else t
            at = cuts(t)
            for a, b in zip(at, at[1:]):
                yield from take(t.slice(a, b - a))
            kept = t.slice(at[-1]).combine_chunks()
        if kept is not None:
            yield from take(kept)
            yield from close()

    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}
    arrow = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])
    return rows.mapInArrow(run, schema)


# --- reductions of the whole span ------------------------------------------------------------


def strong_pairs(cells: DataFrame, keys: list[str], least: float, least_hours: int = 2, blocks: int | None = None) -> DataFrame:
    """(keys, a, b, n, r) of the pairs a < b whose |r|, to nine places, is at least `least`."""

    def tell(met) -> Iterator[dict]:
        for a, b, grids in met:
            r = correlation(grids, least_hours)
            i, j, lo, hi = S.once(a, b, np.round(np.abs(np.nan_to_num(r)), 9) >= least)
            yield {"a": lo, "b": hi, "n": grids[0][i, j].astype(np.int64), "r": r[i, j]}

    return S.meet(S.packed(cells, keys), keys, "a long, b long, n long, r double", tell, blocks, SLICE_HOURS)


def local_forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges of a maximum spanning forest of one block pair's edges, ties by the smaller ids."""
    ids = np.unique(np.r_[a, b])
    top = list(range(len(ids)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    kept = []
    order = np.lexsort((b, a, -w))
    for at, i, j in zip(order.tolist(), np.searchsorted(ids, a)[order].tolist(), np.searchsorted(ids, b)[order].tolist()):
        if (i := root(i)) != (j := root(j)):
            top[i] = j
            kept.append(at)
            if len(kept) == len(ids) - 1:
                break
    return np.array(kept, np.int64)


def forest_pairs(cells: DataFrame, keys: list[str], least_hours: int = 2, blocks: int | None = None) -> DataFrame:
    """(keys, a, b, w) of pairs that hold a maximum spanning forest of all pairs by |r| to nine places; pairs without an r are none.

    A block pair tells the forest of its own pairs, fewer than it has markets: what leaves the product grows with markets and blocks, at any threshold.
    """

    def tell(met) -> Iterator[dict]:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a, b, grids in met:
            w = np.round(np.abs(correlation(grids, least_hours)), 9)
            i, j, lo, hi = S.once(a, b, ~np.isnan(w))
            own = local_forest(lo, hi, w[i, j])
            parts.append((lo[own], hi[own], w[i, j][own]))
        lo, hi, w = (np.concatenate(c) for c in zip(*parts))
        own = local_forest(lo, hi, w)
        yield {"a": lo[own], "b": hi[own], "w": w[own]}

    return S.meet(S.packed(cells, keys), keys, "a long, b long, w double", tell, blocks, SLICE_HOURS)


def top_correlated(cells: DataFrame | G.Strengths, keys: list[str], k: int, least_hours: int = 2, blocks: int | None = None) -> DataFrame:
    """(keys, owner, member, w, rank): the k markets most correlated with each one, a missing r counting as zero, ties by id.

    Series that `Strengths` have packed are not packed again. A block pair tells k partners of each of its markets, so what leaves the product grows with markets, blocks and k, not with pairs.
    """

    def best(row: np.ndarray, other: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each row, with their ids and strengths."""
        order = np.lexsort((other, -w, row))
        row, other, w = row[order], other[order], w[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        keep = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
        return row[keep], other[keep], w[keep]

    def tell(met) -> Iterator[dict]:
        top: dict[bytes, list] = {}

        def add(own: np.ndarray, other: np.ndarray, w: np.ndarray) -> None:
            """Partners as strong as a row's k-th best so far, and within a tile as its own k-th, with room for rounding, may be among the k; `w` is not yet rounded."""
            kept = top.setdefault(own.tobytes(), [own, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.full(len(own), -0.5)])
            least = kept[2]
            if w.shape[1] > k and (few := least < 0).any():
                least = least.copy()
                least[few] = np.maximum(least[few], np.partition(w[few], w.shape[1] - k, axis=1)[:, -k] - 2e-9)
            i, j = np.nonzero(w >= least[:, None])
            if not len(i):
                return
            old = kept[1]
            kept[1] = best(np.r_[old[0], i], np.r_[old[1], other[j]], np.r_[old[2], np.round(w[i, j], 9)])
            full = np.bincount(kept[1][0], minlength=len(own)) >= k
            last = np.full(len(own), -0.5)
            last[kept[1][0]] = kept[1][2]  # rows are in order, so the last of each one stays
            kept[2] = np.where(full, last - 1e-9, -0.5)

        for a, b, grids in met:
            r = correlation(grids, least_hours)
            w = np.abs(r, out=r)
            w[np.isnan(w)] = 0.0
            if grids[0].min(initial=least_hours) < least_hours:
                w[grids[0] < least_hours] = -1.0
            if a is b:
                np.fill_diagonal(w, -1.0)
            else:
                add(b.ids, a.ids, w.T)
            add(a.ids, b.ids, w)
        for own, (row, ids, w), _ in top.values():
            yield {"owner": own[row], "member": ids, "w": w}

    series = cells.series if isinstance(cells, G.Strengths) else S.packed(cells, keys)
    told = S.meet(series, keys, "owner long, member long, w double", tell, blocks, SLICE_HOURS)
    return G.nearest(told, [F.col("w").desc(), F.col("member")], k, keys)


# --- sliding windows -------------------------------------------------------------------------


def sliding_pairs(cells: DataFrame, first: int, last: int, windows: tuple[int, ...], stride: int, least: float, blocks: int) -> DataFrame:
    """(window_hours, window_end, a, b, r) of the strong pairs in every strided trailing window of every length, from one product.

    Windows end where the hour of day divides by the stride, and must lie between the hours `first` and `last`. An hour is multiplied once, but for those that open
    a chunk, which close the chunk before it as well; a window is the sum of its last window / stride slices. `cells` is dense in time: every block has
    a value in every slice.
    """
    if 24 % stride or any(w % stride for w in windows):
        raise ValueError("the stride must divide a day and every window")
    held = max(windows) // stride
    hour = unix_hour().cast("long")
    means = cells.groupBy("market_id").agg(F.avg("p").alias("mean_p"))
    rows = cells.join(means, "market_id").select(F.ceil(hour / stride).cast("long").alias("slice"), hour.alias("hour"), F.col("market_id").cast("long").alias("market_id"),
                                                 (F.col("p") - F.col("mean_p")).alias("x"))
    own = F.floor(F.col("slice") / CHUNK_SLICES).cast("long")
    # The last slices of a chunk are told to the next one too, whose first windows need them.
    ahead = F.floor((F.col("slice") + held - 1) / CHUNK_SLICES).cast("long")
    rows = rows.withColumn("chunk", F.explode(F.sequence(own, ahead)))
    schema = "window_hours int, window_end_hour long, a long, b long, r double"

    def each_slice(key: tuple, at: int, block: Block) -> Iterator[dict]:
        if at // CHUNK_SLICES != key[0]:
            return  # belongs to the chunk before
        for w in windows:
            if at * stride - w + 1 < first or at * stride > last:
                continue
            start = at - w // stride + 1
            r = correlation(block.last(start), 2)
            strong = np.round(np.abs(np.nan_to_num(r)), 9) >= least
            strong &= block.varying(start, 0)[:, None] & block.varying(start, 1)[None, :]
            i, j = np.nonzero(strong)
            a, b = block.left.ids()[i], block.right.ids()[j]
            once = (a < b) if block.same else np.ones(len(a), bool)
            a, b, v = a[once], b[once], r[i[once], j[once]]
            yield {"window_hours": np.full(len(a), w, np.int32), "window_end_hour": np.full(len(a), at * stride), "a": np.minimum(a, b), "b": np.maximum(a, b), "r": v}

    told = stream(dealt_to_blocks(rows, ["chunk"], blocks), ["chunk"], schema, held, lambda key, block: iter(()), each_slice)
    end = F.timestamp_seconds(F.col("window_end_hour") * 3600).cast("timestamp_ntz")
    return told.select("window_hours", end.alias("window_end"), "a", "b", "r")


def sliding_bounds(cells: DataFrame, windows: tuple[int, ...], stride: int, ends: DataFrame) -> DataFrame:
    """(window_hours, window_end, market_id) of the markets that change in a window, from the bounds of each slice; `ends` lists the windows."""
    slices = F.ceil(unix_hour() / stride).cast("long")
    bounds = cells.groupBy("market_id", slices.alias("slice")).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    lengths = F.array(*[F.struct(F.lit(w).alias("window_hours"), F.lit(w // stride - 1).alias("more")) for w in windows])
    spread = bounds.withColumn("w", F.explode(lengths)).withColumn("last", F.explode(F.sequence(F.col("slice"), F.col("slice") + F.col("w.more"))))
    end = F.timestamp_seconds(F.col("last") * stride * 3600).cast("timestamp_ntz")
    met = spread.select(F.col("w.window_hours").alias("window_hours"), end.alias("window_end"), "market_id", "lo", "hi").join(ends, ["window_hours", "window_end"], "left_semi")
    return met.groupBy("window_hours", "window_end", "market_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("hi > lo").select("window_hours", "window_end", "market_id")
