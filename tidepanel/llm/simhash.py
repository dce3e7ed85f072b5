"""Near-duplicates by SimHash: fingerprints, a grid range-join of their segments' bit counts, exact verification, components.

A text's words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, its features all shingles of `words` words joined by spaces (repeats included; the whole
sequence if it has fewer). A bit of the fingerprint is 1 if it is set in more than half of the features' XXH64 values. A text without words
has fingerprint zero and is linked like any other. Fingerprints are linked when they differ in `radius` bits or fewer.

1. Documents with equal fingerprints are one class, so copies meet nobody.
2. A fingerprint is cut into segments and embedded as its bit count in each: the Manhattan distance of two embeddings is at most the Hamming distance of
   the fingerprints. The segments are dealt to `parts` parts; of a pair within the radius, some part is within radius // parts.
3. For each part a grid join meets all fingerprints whose counts there are that near: each one is at home in the cell of its counts, and
   visits the cells that it reaches by raising some counts and lowering others, only those to which it is the greater end, so a pair
   meets once for each part. With the defaults, 32 segments of two bits in three parts, 0.0013 of all pairs of random fingerprints meet, and a
   fingerprint has 27 rows: the work grows with the square of the number of distinct fingerprints, at some nanoseconds for each thousand pairs.
4. Whoever meets is verified on the whole fingerprint. A cell beyond `BLOCK` members is dealt to blocks, so a dense cluster is worked off by as many
   tasks as it needs; a block tells only links that join what is not joined in it yet, never all its pairs.
5. Components come from alternating stars. Documents learn theirs by a join in which classes that hold more than a thousandth of all
   documents, at most a thousand of them, are broadcast, so no class meets in one task.

A null id is a document of its own in the result but never names a component that has an id. Repeated rows are documents of their own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import join_classes, spread, texts, written
from tidepanel.llm.near import components

#: Features whose bits are counted at once, members of a side of a block, pairs verified at once.
CHUNK, BLOCK, PAIRS = 1 << 15, 1 << 13, 1 << 20


@dataclass(frozen=True)
class Settings:
    words: int = 4
    radius: int = 4
    seed: int = 42
    segment: int = 2  # bits of a segment
    parts: int = 3

    @property
    def reach(self) -> int:
        """The Manhattan distance within which some part of a linked pair lies."""
        return self.radius // self.parts

    def part_segments(self) -> list[list[int]]:
        return [s.tolist() for s in np.array_split(np.arange(64 // self.segment), self.parts)]


def features(text: str, words: int, seed: int) -> np.ndarray:
    """The hashes of all shingles."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, wide = b" ".join(found), min(words, len(found))
    ends = list(itertools.accumulate((len(w) + 1 for w in found)))
    hashed, starts = xxhash.xxh64_intdigest, [0, *ends]
    return np.array([hashed(joined[a:b - 1], seed) for a, b in zip(starts, ends[wide - 1:])], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in more than half of the hashes."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), CHUNK):
        total += np.unpackbits(hashes[a:a + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each document."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(features(t, settings.words, settings.seed)) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def embedded(fps: np.ndarray, settings: Settings) -> np.ndarray:
    """The bit counts of each segment, one row for each fingerprint."""
    segments = 64 // settings.segment
    mask = np.uint64((1 << settings.segment) - 1)
    return np.stack([np.bitwise_count((fps >> np.uint64(s * settings.segment)) & mask) for s in range(segments)], axis=1).astype(np.int64)


def moves(dims: int, reach: int) -> np.ndarray:
    """Half of the steps of Manhattan length 1 .. reach in so many dimensions: those whose first change goes up."""
    found, ring = [], {(0,) * dims}
    seen = set(ring)
    for _ in range(reach):
        ring = {m[:d] + (m[d] + s,) + m[d + 1:] for m in ring for d in range(dims) for s in (1, -1)} - seen
        seen |= ring
        found += [m for m in ring if next(x for x in m if x) > 0]
    return np.array(sorted(found), np.int64).reshape(-1, dims)


def cells(fps: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, place of the fingerprint and whether it is at home there."""
    counts, base = embedded(fps, settings), settings.segment + 1
    out = []
    for part, segments in enumerate(settings.part_segments()):
        own = counts[:, segments]
        place = base ** np.arange(len(segments), dtype=np.int64)
        code = (own @ place) * settings.parts + part
        out.append((code, np.arange(len(fps)), np.ones(len(fps), bool)))
        for move in moves(len(segments), settings.reach):
            changed = np.flatnonzero(move)
            to = own[:, changed] + move[changed]
            who = np.flatnonzero(((to >= 0) & (to < base)).all(axis=1))
            out.append((code[who] + (move @ place) * settings.parts, who, np.zeros(len(who), bool)))
    return tuple(np.concatenate(c) for c in zip(*out))


def dealt_to_cells(classes: DataFrame, settings: Settings) -> DataFrame:
    """cell, fp, home for every distinct fingerprint: its home cells and those that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            cell, who, home = cells(fps.view(np.uint64), settings)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fps[who]), pa.array(home)], names=["cell", "fp", "home"])

    return classes.select("fp").mapInArrow(run, "cell long, fp long, home boolean")


#: What a member is in a block: a visitor, at home (on both sides if the block's slices are the same one), or on the left side alone.
VISITOR, HOME, LEFT = 0, 1, 2


def in_blocks(placed: DataFrame) -> DataFrame:
    """The members of every cell dealt to blocks (cell, x, y): those at home in slice x of the cell meet all members of slice y."""
    sizes = placed.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    # Broadcast: there are no more rows than members / BLOCK, and no more than cells, 531,441 with the default settings.
    many = F.broadcast(sizes.select("cell", F.ceil(F.col("size") / BLOCK).cast("long").alias("g")))
    joined = placed.join(many, "cell", "left").withColumn("g", F.coalesce("g", F.lit(1).cast("long"))).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("g")))
    every = F.sequence(F.lit(0).cast("long"), F.col("g") - 1)
    lefts = joined.where("home and g > 1").select("cell", F.col("i").alias("x"), F.explode(every).alias("y"), "fp", F.lit(LEFT).alias("kind")).where("x <> y")
    members = joined.select("cell", F.explode(every).alias("x"), F.col("i").alias("y"), "fp", F.when(F.col("home"), HOME).otherwise(VISITOR).alias("kind"))
    return members.union(lefts)


class Joined:
    """Which fingerprints the links told so far join."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def add(self, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
        """The pairs that join something."""
        out = []
        for p, q in pairs:
            r, s = self.root(p), self.root(q)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                out.append((p, q))
        return out


def block_links(fps: np.ndarray, kind: np.ndarray, block: np.ndarray, diagonal: np.ndarray, radius: int, joined: Joined) -> list[tuple[int, int]]:
    """Links between the two sides of each block that join what the links before do not. Rows are ordered by block, then kind."""
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    rights = np.add.reduceat(kind != LEFT, starts, dtype=np.int64)
    left = np.flatnonzero((kind == LEFT) | ((kind == HOME) & diagonal))
    of = np.searchsorted(starts, left, side="right") - 1
    to, width = starts[of], rights[of]
    home = kind != VISITOR
    out = []

    def near(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.repeat(left[a:b], width[a:b]), spread(to[a:b], width[a:b])
        # Two that are at home there meet twice and are told from the smaller one.
        ok = (np.bitwise_count(fps[i] ^ fps[j]) <= radius) & ((fps[i] < fps[j]) | ~home[j]) & (fps[i] != fps[j])
        return i[ok], j[ok]

    total = np.r_[0, np.cumsum(width)]
    a = 0
    while a < len(left):
        last = int(np.searchsorted(of, of[a], side="right"))
        if total[last] - total[a] <= PAIRS:  # whole blocks, as many as fit
            b = int(np.searchsorted(total, total[a] + PAIRS, side="right")) - 1
            b = len(left) if b >= len(left) else max(last, int(np.searchsorted(of, of[b])))
            i, j = near(a, b)
            out += joined.add(zip(fps[i].tolist(), fps[j].tolist()))
            a = b
            continue
        # A wide block: few rows first, and members that are joined already are not told again, so a dense block tells few links.
        lo = int(starts[of[a]])
        hi = int(starts[of[a] + 1]) if of[a] + 1 < len(starts) else len(fps)
        step = 1
        while a < last:
            label = np.array([joined.root(f) for f in fps[lo:hi].tolist()], np.uint64)
            b = min(a + step, last)
            i, j = near(a, b)
            apart = label[i - lo] != label[j - lo]
            out += joined.add(zip(fps[i[apart]].tolist(), fps[j[apart]].tolist()))
            a, step = b, max(1, min(2 * step, PAIRS // int(width[a])))
    return out


def links(placed: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that join what the fingerprints within the radius of each other join."""
    dealt = in_blocks(placed).repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, kept = Joined(), None

        def told(t: pa.Table, upto: int) -> pa.RecordBatch:
            cell, x, y, fp, kind = (t.column(c).to_numpy()[:upto] for c in ("cell", "x", "y", "fp", "kind"))
            found = []
            if upto:
                block = np.cumsum(np.r_[False, (cell[1:] != cell[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
                found = block_links(fp.view(np.uint64), kind, block, x == y, radius, joined)
            ends = [pa.array(np.array([f[k] for f in found], np.uint64).view(np.int64)) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kept = pa.concat_tables([kept, pa.Table.from_batches([batch])]) if kept is not None else pa.Table.from_batches([batch])
            if kept.num_rows < 8 * BLOCK:
                continue
            cell, x, y = (kept.column(c).to_numpy() for c in ("cell", "x", "y"))
            last = np.flatnonzero((cell[1:] != cell[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            upto = int(last[-1]) + 1 if len(last) else 0
            yield told(kept, upto)
            kept = kept.slice(upto).combine_chunks()
        if kept is not None:
            yield told(kept, kept.num_rows)

    return dealt.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and component_id of every document."""
    rows = written(fingerprints(docs, settings, id_col, text_col), "simhash-rows")
    classes = written(rows.groupBy("fp").agg(F.count("*").alias("size"), F.min("doc_id").alias("least")), "simhash-classes")
    found = written(links(dealt_to_cells(classes, settings), settings.radius), "simhash-links")
    labels = components(found).withColumnRenamed("cls", "fp")
    placed = written(classes.join(labels, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "simhash-placed")
    named = placed.groupBy("comp").agg(F.count("*").alias("classes"), F.min("least").alias("component_id"))
    told = join_classes(placed.select("fp", "size", "comp"), named, ["comp"], "classes").select("fp", "size", "component_id")
    return join_classes(rows, written(told, "simhash-told"), ["fp"], "size").select("doc_id", "fp", "component_id")
