"""Markets' series met in pairs: each is packed into runs of hours with one value, so a task takes two blocks of thousands of markets.

A block of packed series is dealt to every pair of blocks it is in; the task multiplies tile by tile and keeps the sums of one pair of tiles at a
time. What leaves it is what the caller makes of those: strong pairs, best partners, counts of strengths, or the pairs themselves, never sums to be added up later.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import ordered
from tidepanel.session import cut_lineage

#: Markets of a tile, markets and runs of a block, and hours multiplied at once.
TILE, BLOCK, RUNS, HOURS = 256, 4096, 1 << 22, 1024
#: Bins of strengths in a pass, and how many pairs may be left for the pass that tells their strengths.
BINS, LEFT = 1 << 14, 1 << 22

KINDS = {"bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "string": pa.string()}


def unix_hour(ts: str = "ts"):
    return F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / 3600)


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(f.split()[0], KINDS[f.split()[1]]) for f in schema.split(", ")])


def _changes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns."""
    out = np.zeros(batch.num_rows - 1, bool)
    for c in names:
        v = batch.column(c)
        out |= ~pc.fill_null(pc.equal(v.slice(1), v.slice(0, len(v) - 1)), False).to_numpy(zero_copy_only=False)
    return out


def packed(cells: DataFrame, keys: list[str], value: str = "p") -> DataFrame:
    """(keys, market_id, runs): the hours of each market in runs (lo, n, x) of one value, a row for every thousand hours; written, as it is read twice."""
    by = [*keys, "market_id"]
    hour = unix_hour().cast("long")
    rows = cells.where(F.col("market_id").isNotNull() & F.col(value).isNotNull()).select(
        *keys, F.col("market_id").cast("long").alias("market_id"), F.floor(hour / HOURS).cast("long").alias("piece"), hour.alias("hour"), F.col(value).cast("double").alias("x"))
    by = [*by, "piece"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hour, x = batch.column("hour").to_numpy(), batch.column("x").to_numpy()
            at = np.flatnonzero(np.r_[True, _changes(batch, by) | (hour[1:] != hour[:-1] + 1) | (x[1:] != x[:-1])])
            n = np.diff(np.r_[at, batch.num_rows])
            firsts = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*(firsts.column(c) for c in by), pa.array(hour[at]), pa.array(n), pa.array(x[at])], names=[*by, "lo", "n", "x"])

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), "lo long", "n long", "x double"])
    runs = rows.repartition(*by).sortWithinPartitions(*by, "hour").mapInArrow(cut, schema)
    return cut_lineage(runs.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("lo", "n", "x"))).alias("runs")).drop("piece"))


class Tile:
    """The runs of a few markets of a block."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, owner: np.ndarray, lo: np.ndarray, n: np.ndarray, x: np.ndarray):
        self.ids, self.size, self.owner, self.lo, self.n, self.x = ids, size, owner, lo, n, x
        self.first, self.last, self.kept = int(lo.min()), int((lo + n).max()), {}
        self.told: tuple = (None, None)

    def dense(self, first: int, hours: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Presence, values and their squares, hours by markets; the last two slices of hours are kept for the next tile."""
        if (first, hours) not in self.kept:
            lo, hi = np.clip(self.lo - first, 0, hours), np.clip(self.lo + self.n - first, 0, hours)
            n = hi - lo
            row = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            col = np.repeat(self.owner, n)
            seen, x = np.zeros((hours, len(self.ids))), np.zeros((hours, len(self.ids)))
            seen[row, col], x[row, col] = 1.0, np.repeat(self.x, n)
            if len(self.kept) == 2:
                self.kept.clear()
            self.kept[first, hours] = seen, x, x * x
        return self.kept[first, hours]

    def part(self, first: int, hours: int, own: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool, np.ndarray, np.ndarray]:
        """Some hours of a slice: presence, values, their squares, whether every market has all hours, and the sums of values and squares."""
        if self.told[0] != (first, hours, own.start, own.stop):
            seen, x, square = (g[own] for g in self.dense(first, hours))
            self.told = (first, hours, own.start, own.stop), (seen, x, square, bool(seen.all()), x.sum(axis=0), square.sum(axis=0))
        return self.told[1]


def tiles(rows: pa.Table, centred: bool) -> list[Tile]:
    """The markets of one block, by id, in tiles; values less the market's mean, which keeps the sums well conditioned."""
    runs = rows.column("runs").combine_chunks()
    ids, of = np.unique(rows.column("market_id").to_numpy(), return_inverse=True)
    owner = np.repeat(of, pc.list_value_length(runs).to_numpy(zero_copy_only=False))
    told = runs.flatten()
    lo, n, x = (told.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "n", "x"))
    order = np.lexsort((lo, owner))
    owner, lo, n, x = owner[order], lo[order], n[order], x[order]
    size = np.bincount(owner, weights=n, minlength=len(ids))
    if centred:
        x = x - (np.bincount(owner, weights=n * x, minlength=len(ids)) / size)[owner]
    out = []
    for a in range(0, len(ids), TILE):
        own = slice(*np.searchsorted(owner, [a, a + TILE]))
        out.append(Tile(ids[a:a + TILE], size[a:a + TILE], owner[own] - a, lo[own], n[own], x[own]))
    return out


def sums(a: Tile, b: Tile, hours: int) -> tuple[np.ndarray, ...]:
    """n and the sums of x, y, x², y², xy over the hours that each pair of two tiles shares. What all pairs of a market have alike is held once: a view of one row or column."""
    shape, begin, end = (len(a.ids), len(b.ids)), max(a.first, b.first), min(a.last, b.last)
    grids: list = [np.zeros((1, 1))] * 6
    for first in range(begin // hours * hours, end, hours):
        own = slice(max(begin - first, 0), min(hours, end - first))
        (va, xa, qa, alla, ta, ua), (vb, xb, qb, allb, tb, ub) = a.part(first, hours, own), b.part(first, hours, own)
        if alla and allb:  # every hour is shared
            more = (np.full((1, 1), float(len(va))), ta[:, None], tb[None, :], ua[:, None], ub[None, :], xa.T @ xb)
        else:
            more = (va.T @ vb, xa.T @ vb, va.T @ xb, qa.T @ vb, va.T @ qb, xa.T @ xb)
        grids = [g + m for g, m in zip(grids, more)]
    return tuple(np.broadcast_to(g, shape) for g in grids)


def _alike(g: np.ndarray) -> np.ndarray:
    """A grid without the rows or columns that only repeat the first one."""
    if g.ndim != 2 or not g.size:
        return g
    return g[:1 if g.strides[0] == 0 else None, :1 if g.strides[1] == 0 else None]


def correlation(grids: tuple[np.ndarray, ...], least_hours: int) -> np.ndarray:
    """Pearson's r of each pair; not a number where hours are few or a series does not vary over the shared ones."""
    n, sx, sy, sxx, syy, sxy = (_alike(g) for g in grids)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    with np.errstate(all="ignore"):
        # A spread that counts for none makes r not a number.
        vx = np.where((n >= least_hours) & (vx > 1e-11 * n * sxx), vx, np.nan)
        vy = np.where(vy > 1e-11 * n * syy, vy, np.nan)
        r = n * sxy
        r -= sx * sy
        r /= np.sqrt(vx * vy)
    return np.clip(r, -1.0, 1.0, out=r)


def once(a: Tile, b: Tile, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places i, j of the pairs kept, each once, and their ids, the smaller first."""
    i, j = np.nonzero(np.triu(kept, 1) if a is b else kept)
    return i, j, np.minimum(a.ids[i], b.ids[j]), np.maximum(a.ids[i], b.ids[j])


def meet(series: DataFrame, keys: list[str], schema: str, tell: Callable, blocks: int | None = None, hours: int = HOURS, centred: bool = True) -> DataFrame:
    """(keys, `schema`): what `tell` makes of two blocks. It gets an iterator of (tile, tile, sums) over their pairs of tiles and yields dicts of columns."""
    sizes = series.groupBy(*keys).agg(F.countDistinct("market_id").alias("m"), F.sum(F.size("runs")).alias("r")).collect()
    most, runs = max((s["m"] for s in sizes), default=0), max((s["r"] or 0 for s in sizes), default=0)
    blocks = blocks or max(1, math.ceil(most / BLOCK), math.ceil(runs / RUNS), min(8, math.ceil(most / TILE)))
    block = F.pmod(F.xxhash64("market_id"), F.lit(blocks)).cast("int")
    dealt = series.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns(
        {"ba": F.least("block", "other"), "bb": F.greatest("block", "other")}).drop("other")
    by = [*keys, "ba", "bb"]
    # Few bytes mean much work here, so the number of tasks follows the pairs of blocks, not the bytes.
    tasks = min(4096, 4 * max(len(sizes), 1) * blocks * (blocks + 1) // 2)
    rows = dealt.repartition(tasks, *by).sortWithinPartitions(*by)
    types = dict(series.dtypes)
    whole = ", ".join([*(f"{k} {types[k]}" for k in keys), schema])
    arrow = arrow_schema(whole)
    own = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def pairs(left: list[Tile], right: list[Tile]) -> Iterator[tuple[Tile, Tile, tuple[np.ndarray, ...]]]:
            for i, a in enumerate(left):
                for b in (left[i:] if left is right else right):
                    yield a, b, sums(a, b, hours)

        def close() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held)
            sides = []
            for which in dict.fromkeys(key[-2:]):
                mine = t.filter(pc.equal(t.column("block"), which))
                sides.append(tiles(mine, centred) if mine.num_rows else [])
            for out in tell(pairs(sides[0], sides[-1])):
                n = len(out[own[0]])
                if n:
                    yield pa.RecordBatch.from_pydict({**{k: [v] * n for k, v in zip(keys, key)}, **out}, schema=arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            at = [0, *(np.flatnonzero(_changes(batch, by)) + 1).tolist(), batch.num_rows]
            for a, b in zip(at, at[1:]):
                head = tuple(batch.column(k)[a].as_py() for k in by)
                if head != key:
                    if held:
                        yield from close()
                    key, held = head, []
                held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
        if held:
            yield from close()

    return rows.select(*by, "block", "market_id", "runs").mapInArrow(run, whole)


# --- pairs, and how strong they are ----------------------------------------------------------


def pairs(series: DataFrame, keys: list[str], least_hours: int, blocks: int | None = None, hours: int = HOURS) -> DataFrame:
    """(keys, a, b, n, r) of every pair a < b with enough shared hours; `r` null where a series does not vary over them."""

    def tell(met) -> Iterator[dict]:
        for a, b, grids in met:
            i, j, lo, hi = once(a, b, grids[0] >= max(least_hours, 1))
            r = correlation(grids, least_hours)[i, j]
            yield {"a": lo, "b": hi, "n": grids[0][i, j].astype(np.int64), "r": pa.array(r, mask=np.isnan(r))}

    return meet(series, keys, "a long, b long, n long, r double", tell, blocks, hours)


def dots(series: DataFrame, blocks: int | None = None) -> DataFrame:
    """(a, b, n, dot, na, nb): shared hours and sum of products of every pair a < b that shares any, and the hours of each."""

    def tell(met) -> Iterator[dict]:
        for a, b, grids in met:
            i, j, lo, hi = once(a, b, grids[0] > 0)
            first = a.ids[i] == lo
            na, nb = a.size[i].astype(np.int64), b.size[j].astype(np.int64)
            yield {"a": lo, "b": hi, "n": grids[0][i, j].astype(np.int64), "dot": grids[5][i, j], "na": np.where(first, na, nb), "nb": np.where(first, nb, na)}

    return meet(series, [], "a long, b long, n long, dot double, na long, nb long", tell, blocks, centred=False)


def strength_summary(series: DataFrame, least_hours: int, bins: int = BINS, left: int = LEFT) -> DataFrame:
    """Mean and exact median of |r| over the pairs that have one, in one row.

    A pass counts strengths by bin; the bins that hold the middle are cut again until few pairs are left in them, whose strengths are then told and
    counted. At most a bin's counts leave a pair of blocks, and only counts come to the driver.
    """
    spark = series.sparkSession

    def strengths(met) -> Iterator[np.ndarray]:
        for a, b, grids in met:
            r = correlation(grids, least_hours)
            yield np.abs(r[~np.isnan(r) & np.triu(np.ones(r.shape, bool), 1)] if a is b else r[~np.isnan(r)])

    def binned(lo: float, hi: float) -> list:
        """Pairs and the sum of their strengths in each bin of [lo, hi), the last one closed at 1."""

        def tell(met) -> Iterator[dict]:
            n, total = np.zeros(bins, np.int64), np.zeros(bins)
            for w in strengths(met):
                w = w[(w >= lo) & ((w < hi) | (hi >= 1.0))]
                at = bin_of(w, lo, hi, bins)
                n += np.bincount(at, minlength=bins)
                total += np.bincount(at, weights=w, minlength=bins)
            at = np.flatnonzero(n)
            yield {"bin": at, "n": n[at], "total": total[at]}

        return meet(series, [], "bin long, n long, total double", tell).groupBy("bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("bin").collect()

    def counted(lo: float, hi: float, wanted: list[int]) -> DataFrame:
        """How many pairs have each strength of the named bins."""

        def tell(met) -> Iterator[dict]:
            w, n = np.zeros(0), np.zeros(0, np.int64)
            for more in strengths(met):
                more = more[(more >= lo) & ((more < hi) | (hi >= 1.0))]
                more = more[np.isin(bin_of(more, lo, hi, bins), wanted)]
                if len(more):
                    w, of = np.unique(np.r_[w, more], return_inverse=True)
                    n = np.bincount(of, weights=np.r_[n, np.ones(len(more), np.int64)]).astype(np.int64)
            yield {"w": w, "n": n}

        return cut_lineage(meet(series, [], "w double, n long", tell).groupBy("w").agg(F.sum("n").alias("n")))

    lo, hi, below = 0.0, 1.0, 0
    found = binned(lo, hi)
    pairs_, total = sum(r["n"] for r in found), math.fsum(r["total"] for r in found)
    if not pairs_:
        return spark.createDataFrame([(None, 0, None)], "mean_abs_corr double, pairs long, median_abs_corr double")
    ranks = sorted({(pairs_ - 1) // 2, pairs_ // 2})
    while True:
        upto = below + np.cumsum([r["n"] for r in found])
        at = sorted({int(np.searchsorted(upto, k, side="right")) for k in ranks})
        inside = sum(found[i]["n"] for i in at)
        before = below + sum(r["n"] for r in found[:at[0]])
        width = (hi - lo) / bins
        if inside <= left or len(at) > 1 or width < 1e-12:
            break
        bottom = found[at[0]]["bin"]
        lo, hi, below = lo + bottom * width, (1.0 if hi >= 1.0 and bottom == bins - 1 else lo + (bottom + 1) * width), before
        found = binned(lo, hi)
    wanted = [found[i]["bin"] for i in at]
    # Between two bins that hold a middle each there is none, so the ranks of the strengths told follow on `before`.
    run = ordered.running_sum(counted(lo, hi, wanted), [], [F.col("w")], ["n"])
    here = lambda k: (F.col("n_upto") > k - before) & (F.col("n_upto") - F.col("n") <= k - before)
    values = list(run.agg(*[F.max(F.when(here(k), F.col("w"))).alias(f"rank_{k}") for k in ranks]).first())
    return spark.createDataFrame([(total / pairs_, pairs_, sum(values) / len(values))], "mean_abs_corr double, pairs long, median_abs_corr double")


def bin_of(w: np.ndarray, lo: float, hi: float, bins: int) -> np.ndarray:
    """Bins are a power of two of [0, 1], so their edges are exact."""
    return np.minimum(((w - lo) * (bins / (hi - lo))).astype(np.int64), bins - 1)
