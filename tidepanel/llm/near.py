"""Near-duplicate documents by MinHash: many universal hash minima, banding, signature verification, exact confirmation, components.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case; a document's set is its distinct shingles of `words` words, or its whole
sequence if it has fewer. Two documents are linked when 100 * common >= `percent` * all shingles. Null and empty texts and texts of blanks
have an empty set and are linked with nothing.

1. Documents with equal sets are one class, so copies cost one row each and meet nobody.
2. A class has `bands` band keys of `rows` minima each and a signature of one byte per minimum. Classes that share a key are a bucket.
3. A bucket is not paired off. First every member is compared with the smallest member, then, in buckets that are not yet one component,
   with the member that has most links; what is then still apart is compared in blocks of bounded size, each pair in the first band it
   shares, and a block tells only the links that join components. So a bucket of any size is worked off completely, by as many tasks
   as it needs, and no list of its pairs is written.
4. A pair must pass its signature (six deviations below the threshold) and then its full sets, which only candidates build again: a bit
   set of fixed size tells each scan which texts may be wanted, and a join removes the false hits. Candidates of a pivot stream past the
   pivot's set, so a task holds one set and no row carries two.
5. Components come from alternating large-star and small-star steps, each written to the shared folder.

A link at the threshold is missed with a probability of (1 - s^rows)^bands, 5e-6 for the defaults. Repeated rows are documents of their own
in the result. A null id joins its class, but never names a component that has an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import BITS, bit_set, join_classes, maybe_in, spread, texts, tidy, written

#: Bytes hashed at once, shingles whose minima are taken at once, shingles of the members of one block.
SEGMENT, CHUNK, BLOCK = 1 << 20, 1 << 16, 1 << 20


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_matches(self) -> int:
        """Equal signature bytes that a pair at the threshold falls short of once in a billion."""
        s = self.percent / 100
        return max(0, int(self.hashes * s - 6 * (self.hashes * s * (1 - s)) ** 0.5))


_random = np.random.default_rng(20240501)
_LETTER = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LETTER[_BLANK] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = _random.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, 4096, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the input."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word and where it starts: letters' values times powers by place, summed over the word."""
    hashes, places, at = [], [], 0
    while at < len(data):
        stop = min(at + SEGMENT, len(data))
        while stop < len(data) and not _BLANK[data[stop]]:
            stop += 1  # to the end of the word
        raw = np.frombuffer(data, dtype=np.uint8, count=stop - at, offset=at)
        blank = _BLANK[raw]
        starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
        if len(starts):
            place = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
            powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(place.max()), _BASE)])
            values = _LETTER[raw[starts[0]:]] * powers[place]
            hashes.append(mixed(np.add.reduceat(values, starts - starts[0])))
            places.append(starts + at)
        at = stop
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def shingle_sets(batch: list[str], words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    data = [t.encode().lower() for t in batch]
    sizes = np.array([len(d) + 1 for d in data])
    hashes, places = word_hashes(b"\n".join(data))
    counts = np.diff(np.searchsorted(places, np.r_[0, np.cumsum(sizes)])) if len(data) else []
    out, at = [], 0
    for n in counts:
        own = hashes[at:at + n]
        at += n
        wide = min(words, n)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        total = np.full(n - wide + 1, np.uint64(wide))
        for i in range(wide):
            total = total + own[i:n - wide + 1 + i] * _FACTORS[i]
        out.append(np.unique(mixed(total)))
    return out


def minima(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """The least value of each universal hash (a x + b, upper half) over each set; sets are not empty."""
    out = np.full((len(sets), hashes), 0xFFFFFFFF, dtype=np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (n == 0 or n + len(sets[j]) <= CHUNK):
            n += len(sets[j])
            j += 1
        joined = np.concatenate(sets[i:j])
        starts = np.r_[0, np.cumsum([len(s) for s in sets[i:j]])[:-1]].astype(np.int64)
        y = np.empty_like(joined)
        for k in range(hashes):
            np.multiply(joined, _FACTORS[k], out=y)
            np.add(y, _SHIFTS[k], out=y)
            out[i:j, k] = np.minimum.reduceat(y, starts) >> np.uint64(32)
        i = j
    return out


def band_keys(minimum: np.ndarray, settings: Settings) -> np.ndarray:
    """A 64-bit key of each band's minima."""
    by_band = minimum.reshape(len(minimum), settings.bands, settings.rows).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, settings.bands + 1, dtype=np.uint64), by_band.shape[:2]).copy()
    for r in range(settings.rows):
        total = mixed(total + by_band[:, :, r]) * _FACTORS[r]
    return mixed(total).view(np.int64)


def _set_digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signed(docs: DataFrame, settings: Settings) -> DataFrame:
    """row, doc_id, text_hash, n (set size), d1, d2 (set digest), bands, signature of each document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(texts(batch), settings.words)
            full = [i for i, s in enumerate(sets) if len(s)]
            least = minima([sets[i] for i in full], settings.hashes)
            keys, short = band_keys(least, settings), (least & 0xFF).astype(np.uint8)
            bands, signature = [None] * len(sets), [None] * len(sets)
            for k, i in enumerate(full):
                bands[i], signature[i] = keys[k], short[k].tobytes()
            digests = [_set_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(signature, pa.binary())],
                names=["row", "doc_id", "text_hash", "n", "d1", "d2", "bands", "signature"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"row long, doc_id {kind}, text_hash long, n long, d1 long, d2 long, bands array<bigint>, signature binary")


class Search:
    """Classes, their buckets, and the confirmation of candidate pairs."""

    def __init__(self, docs: DataFrame, settings: Settings):
        self.docs, self.settings = docs, settings
        self.all = written(signed(docs, settings), "near-signed")
        thin = self.all.select("row", "doc_id", "n", "d1", "d2")
        classes = thin.groupBy("d1", "d2", "n").agg(F.min("row").alias("cls"), F.count("*").alias("size"))
        self.members = written(join_classes(thin, written(classes, "near-told"), ["d1", "d2", "n"], "size").select("row", "doc_id", "n", "cls"), "near-members")
        first = self.members.where("row = cls and n > 0").select("row")
        reps = self.all.join(first, "row", "left_semi").withColumnRenamed("row", "cls")
        self.classes = written(reps, "near-classes")
        keyed = self.classes.select("cls", "n", F.posexplode("bands").alias("band", "key"))
        shared = keyed.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).where("size > 1")
        self.buckets = written(keyed.drop("n").join(shared, "key"), "near-buckets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (pivot, cls) that pass their sizes, their signatures and their full sets, as links (a, b); written."""
        low, percent = self.settings.least_matches, self.settings.percent
        sig = self.classes.select("cls", "n", "signature")
        both = pairs.join(sig.toDF("pivot", "np", "sp"), "pivot").join(sig.toDF("cls", "nc", "sc"), "cls")
        both = both.where(F.expr(f"100 * least(np, nc) >= {percent} * greatest(np, nc)"))

        def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sp", "sc"))
                    yield batch.select(["pivot", "cls", "nc"]).filter(pa.array((left == right).sum(axis=1) >= low))

        candidates = written(both.mapInArrow(tidy(alike), "pivot long, cls long, nc long"), "near-candidates")
        sets = self.sets_of(candidates.select("cls").union(candidates.select("pivot")).distinct())
        # A pivot with many candidates is copied to slots of bounded size; a slot streams its candidates past the pivot's set.
        slots = candidates.groupBy("pivot").agg(F.ceil(F.sum("nc") / BLOCK).cast("long").alias("slots"))
        dealt = candidates.join(slots, "pivot").select("pivot", F.pmod(F.xxhash64("cls"), "slots").alias("slot"), "cls")
        heads = slots.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), F.col("pivot").alias("cls"))
        rows = heads.withColumn("own", F.lit(0)).union(dealt.withColumn("own", F.lit(1))).join(sets, "cls")
        rows = rows.repartition("pivot", "slot").sortWithinPartitions("pivot", "slot", "own")

        def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, mine = None, None
            for batch in batches:
                pivot, slot, cls, own = (batch.column(c).to_numpy() for c in ("pivot", "slot", "cls", "own"))
                shingles, found = batch.column("shingles"), []
                for k in range(batch.num_rows):
                    theirs = shingles[k].values.to_numpy()
                    if not own[k]:
                        held, mine = (pivot[k], slot[k]), np.sort(theirs)
                        continue
                    if held != (pivot[k], slot[k]):
                        raise ValueError("a candidate without its pivot")
                    common = int((mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs).sum())
                    if 100 * common >= percent * (len(mine) + len(theirs) - common):
                        found.append((min(pivot[k], cls[k]), max(pivot[k], cls[k])))
                yield pa.RecordBatch.from_arrays([pa.array([int(f[i]) for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        return written(rows.mapInArrow(tidy(verified), "a long, b long"), "near-links")

    def sets_of(self, named: DataFrame) -> DataFrame:
        """cls and shingles of the named classes, built again from their texts; written."""
        words = self.settings.words
        needed = written(self.classes.join(named, "cls", "left_semi").select("cls", "text_hash", "d1", "d2"), "near-needed")
        held = bit_set(needed, "text_hash")
        rows = self.docs.select(F.pmod(F.xxhash64("text"), F.lit(BITS)).alias("place"), "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            told = set()  # copies of a text build the same set; a task tells it once
            for batch in batches:
                wanted = maybe_in(held, batch, "place")
                new = {}
                for s in shingle_sets(texts(wanted), words):
                    if (d := _set_digest(s)) not in told:
                        told.add(d)
                        new[d] = s.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d[0] for d in new], pa.int64()), pa.array([d[1] for d in new], pa.int64()), pa.array(list(new.values()), pa.list_(pa.int64()))],
                    names=["d1", "d2", "shingles"])

        built = rows.mapInArrow(tidy(run), "d1 long, d2 long, shingles array<bigint>")
        sets = built.join(needed.select("cls", "d1", "d2"), ["d1", "d2"]).groupBy("cls").agg(F.first("shingles").alias("shingles"))
        sets = written(sets, "near-sets")
        held.destroy()
        return sets

    def apart(self, labels: DataFrame) -> DataFrame:
        """The rows of the buckets that are not one component yet, with the component of each."""
        told = self.buckets.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        split = told.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        return told.join(split, "key", "left_semi")

    def stars(self, rows: DataFrame, best) -> DataFrame:
        """Pairs of each bucket's member that is least by `best` with its other members of other components."""
        pivot = rows.groupBy("key").agg(F.min(F.struct(best.alias("best"), F.col("cls").alias("pivot"), F.col("comp").alias("pivot_comp"))).alias("p")).select("key", "p.pivot", "p.pivot_comp")
        return rows.join(pivot, "key").where("cls <> pivot and comp <> pivot_comp").select("pivot", "cls").distinct()

    def rest(self, rows: DataFrame) -> DataFrame:
        """Links between members of different components, found block by block on full sets: enough of them to join what they join; written."""
        low, percent = self.settings.least_matches, self.settings.percent
        rows = written(rows, "near-rest")
        sets = self.sets_of(rows.select("cls").distinct())
        many = F.ceil(F.col("shingles") / BLOCK).cast("long")
        placed = rows.withColumn("g", many).withColumn("i", F.pmod(F.xxhash64("cls"), F.col("g"))).drop("shingles")
        about = self.classes.select("cls", "n", "signature", "bands").join(sets, "cls")
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))).join(about, "cls")
        placed = placed.select("key", "band", F.least("i", "other").alias("x"), F.greatest("i", "other").alias("y"), "i", "cls", "comp", "n", "signature", "bands", "shingles")
        dealt = placed.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: pa.Table | None = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                t = pa.Table.from_batches([batch])
                t = pa.concat_tables([kept, t]) if kept is not None else t
                key, x, y = (t.column(c).to_numpy() for c in ("key", "x", "y"))
                ends = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist()]
                yield told([p for a, b in zip(ends, ends[1:]) for p in joining_links(t.slice(a, b - a), low, percent)])
                kept = t.slice(ends[-1])
            yield told(joining_links(kept, low, percent) if kept is not None else [])

        def told(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([int(p[k]) for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        return written(dealt.mapInArrow(tidy(run), "a long, b long"), "near-links")


def joining_links(block: pa.Table, low: int, percent: int) -> list[tuple[int, int]]:
    """Links between the two sides of a block that join components not yet joined in it."""
    cls, comp, n, i, x, y, band = (block.column(c).to_numpy() for c in ("cls", "comp", "n", "i", "x", "y", "band"))
    if len(cls) < 2:
        return []
    signatures = np.frombuffer(b"".join(block.column("signature").to_pylist()), np.uint8).reshape(len(cls), -1)
    bands = block.column("bands").combine_chunks().flatten().to_numpy().reshape(len(cls), -1)
    shingles = block.column("shingles").combine_chunks()
    flat = shingles.flatten().to_numpy()
    ends = np.cumsum(n)
    _, root = np.unique(comp, return_inverse=True)  # the component of each member, renamed as they join
    right_side, out = np.flatnonzero(i == y[0]), []
    for a in np.flatnonzero(i == x[0]):
        b = right_side if x[0] != y[0] else right_side[right_side > a]
        b = b[(root[b] != root[a]) & (100 * np.minimum(n[b], n[a]) >= percent * np.maximum(n[b], n[a]))]
        b = b[(bands[b] == bands[a]).argmax(axis=1) == band[0]] if len(b) else b
        b = b[(signatures[b] == signatures[a]).sum(axis=1) >= low] if len(b) else b
        if not len(b):
            continue
        mine = np.sort(flat[ends[a] - n[a]:ends[a]])
        theirs = flat[spread(ends[b] - n[b], n[b])]
        there = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        common = np.add.reduceat(there, np.r_[0, np.cumsum(n[b])[:-1]], dtype=np.int64)
        for c in b[100 * common >= percent * (n[a] + n[b] - common)]:
            if root[c] != root[a]:
                out.append((min(cls[a], cls[c]), max(cls[a], cls[c])))
                root[root == root[c]] = root[a]
    return out


def components(edges: DataFrame) -> DataFrame:
    """cls and comp (the smallest node reachable) of every node of the edges (a, b) that is not its own least, by alternating stars."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "star")
    before = None
    while True:
        told = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if told == before or not told[0]:
            return now.select(F.col("u").alias("cls"), F.col("v").alias("comp"))
        before = told
        # Large star: every larger neighbour of u is tied to the least of u and its neighbours.
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "star-large")
        # Small star: u and its smaller neighbours are tied to the least of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "star-small")


def stars_of(labels: DataFrame) -> DataFrame:
    """The components found so far, as edges."""
    return labels.select(F.col("cls").alias("a"), F.col("comp").alias("b"))


def placed_rows(docs: DataFrame, settings: Settings) -> DataFrame:
    """row, doc_id, n, component_id and first_row (the row of that id in the component, the least one) of every row of `docs` (doc_id, text)."""
    search = Search(docs, settings)
    alone = search.buckets.withColumn("comp", F.col("cls"))
    links = search.confirmed(search.stars(alone, F.lit(0)))
    labels = components(links)

    ends = links.select(F.col("a").alias("cls")).union(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("degree"))
    left = written(search.apart(labels).where("size > 2"), "near-apart")
    known = left.join(ends, "cls", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    labels = components(stars_of(labels).union(search.confirmed(search.stars(known, -F.col("degree")))))
    labels = components(stars_of(labels).union(search.rest(search.apart(labels).where("size > 2"))))

    # Ids are compared among classes, then told to the rows, so that a class or component of any size meets in no task.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row").alias("first_row"))).alias("first")
    classes = written(search.members.where("n > 0").groupBy("cls").agg(F.count("*").alias("size"), first), "near-firsts")
    placed = written(classes.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "near-placed")
    named = written(placed.groupBy("comp").agg(F.count("*").alias("classes"), F.min("first").alias("least")), "near-named")
    told = join_classes(placed.select("cls", "size", "comp"), named, ["comp"], "classes")
    told = written(told.select("cls", "size", F.col("least.doc_id").alias("component_id"), "least.first_row"), "near-ids")
    # An empty set is linked with nothing, not even with its like.
    empty = search.members.where("n = 0").select("row", "doc_id", "n", F.col("doc_id").alias("component_id"), F.col("row").alias("first_row"))
    return join_classes(search.members.where("n > 0"), told, ["cls"], "size").select("row", "doc_id", "n", "component_id", "first_row").union(empty)


def near_groups(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    rows = placed_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), settings)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", from_files: bool = False) -> DataFrame:
    """The documents that stay, with all their columns: one row of each component, with its smallest id (nulls last), the first of repeated ones.

    Rows are told by their place. A table that is computed is written first, since its rows may come in another order next time; one that is
    read `from_files` is not.
    """
    docs = docs if from_files else written(docs, "near-input")
    gone = placed_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), settings).where("row <> first_row")
    at = "row"
    while at in docs.columns:
        at += "_"
    numbered = docs.withColumn(at, F.monotonically_increasing_id())
    return numbered.join(written(gone.select(F.col("row").alias(at)), "near-gone"), at, "left_anti").select(docs.columns)
