"""The prefix trie of conversations, from sorted sequences and a sparse table of range minima over their common prefixes.

A turn is one symbol: 16 bytes of digest of its role and text and 8 bytes that hold the length of its text in UTF-8. A conversation is its
symbols in order of turn (null first; equal turns by digest), as one binary value, so Spark's order of binaries is the order of sequences.

1. Equal sequences become one row with its number of conversations and its smallest id, so copies meet nobody.
2. The distinct sequences are dealt by ranges and sorted; a task cuts them into pieces of bounded size. In a piece, the symbols that
   neighbours share at their start (LCP) go into a sparse table of range minima. Every candidate prefix, that is every sequence and depth beyond what
   it shares with its predecessor, searches its left and its right extent in the table by halving steps, each on its own; its members
   are the interval between. All else are sums over intervals: members by running weights, the subtree by a contiguous run of candidates.
3. Only prefixes of the first and the last sequence of a piece can go on in another piece. These edge nodes are told by digest of the prefix, merged
   by aggregation, and their subtrees summed: each distinct edge node is owned by one chain (a first or last sequence), chains are
   summed from their deep end, and an edge node adds up the chains that pass through it.

Null roles and texts are empty. Rows without a conv_id belong to no conversation. Repeated rows are turns of their own. A conversation without turns
is a member of the root alone; without conversations there is no node. A conversation is one value of 24 bytes a turn in its task; texts are
not carried. Prefixes are told apart by 128 bits of digest a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import spread, written

#: Bytes of a symbol and of its digest; symbols and sequences that close a piece.
WIDTH, DIGEST = 24, 16
PIECE_SYMBOLS, PIECE_SEQUENCES = 1 << 18, 1 << 16

NODE = ("piece long, edge boolean, side int, depth long, conv_id long, n_convs long, bytes long, n_children long, n_leaves long, saved_tokens long, "
        "parent_conv_id long, parent_side int, key binary, parent_key binary, end_key binary")


def symbol() -> Column:
    """48 hex digits of a turn: the digest of role and text, then the bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    size = F.octet_length(text)
    return F.concat(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")), F.lpad(F.lower(F.hex(size.cast("long"))), 16, "0"))


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and its symbols in order, as an array of hex strings."""
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", symbol().alias("s"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"), F.col("s").alias("s"))))
    return own.groupBy("conv_id").agg(listed.alias("seq")).select("conv_id", F.transform("seq", lambda x: x["s"]).alias("seq"))


def grafted(seqs: DataFrame, base: Column, head: Column, longest_head: int) -> DataFrame:
    """Every conversation with its first `head` turns replaced by those of conversation `base` (all if it has fewer, none if it is absent)."""
    heads = seqs.select(F.col("conv_id").alias("base_id"), F.slice("seq", 1, longest_head).alias("base_seq"))
    placed = seqs.withColumn("base_id", base).withColumn("head", head.cast("int"))
    joined = placed.join(heads, "base_id", "left")
    kept = F.filter("seq", lambda x, i: i >= F.col("head"))
    front = F.coalesce(F.filter("base_seq", lambda x, i: i < F.col("head")), F.array().cast("array<string>"))
    return joined.select("conv_id", F.concat(front, kept).alias("seq"))


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level j holds the minimum of 2^j values from each place on."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        last, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-step], last[step:]))
    return levels


def right_extent(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last place r >= at such that the values of at+1 .. r are all >= depth."""
    at, n = at.copy(), len(levels[0])
    for j in range(len(levels) - 1, -1, -1):
        fits = at + (1 << j) < n
        ok = fits & (levels[j][np.where(fits, at + 1, 0)] >= depth)
        at[ok] += 1 << j
    return at


def left_extent(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first place l <= at such that the values of l+1 .. at are all >= depth."""
    at = at.copy()
    for j in range(len(levels) - 1, -1, -1):
        fits = at - (1 << j) >= 0
        ok = fits & (levels[j][np.where(fits, at - (1 << j) + 1, 0)] >= depth)
        at[ok] -= 1 << j
    return at


def range_minimum(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The minimum of the values lo .. hi."""
    out = np.empty(len(lo), levels[0].dtype)
    j = np.floor(np.log2(hi - lo + 1)).astype(np.int64) if len(lo) else np.empty(0, np.int64)
    for level in np.unique(j):
        m = j == level
        out[m] = np.minimum(levels[level][lo[m]], levels[level][hi[m] - (1 << level) + 1])
    return out


def common_prefixes(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The number of symbols each sequence shares with its predecessor at the start; -1 for the first."""
    shared = np.full(len(lengths), -1, np.int64)
    both = np.minimum(lengths[1:], lengths[:-1])
    some = np.flatnonzero(both) + 1
    shared[1:] = 0
    if len(some):
        n = both[some - 1]
        differs = (flat[spread(starts[some], n)] != flat[spread(starts[some - 1], n)]).any(axis=1)
        ends = np.cumsum(n)
        place = np.where(differs, np.arange(len(differs)) - np.repeat(ends - n, n), np.repeat(n, n))
        shared[some] = np.minimum.reduceat(place, ends - n)
    return shared


def piece_nodes(piece: int, seqs: list[bytes], weights: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """All nodes of a piece of sorted distinct sequences: whole ones, and edge nodes with what the piece holds of them."""
    m = len(seqs)
    lengths = np.array([len(s) // WIDTH for s in seqs], np.int64)
    starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
    raw = np.frombuffer(b"".join(seqs), np.uint8).reshape(-1, WIDTH)
    flat = np.ascontiguousarray(raw[:, :DIGEST]).view(np.uint64)
    sizes = np.ascontiguousarray(raw[:, DIGEST:]).view(">u8").astype(np.int64).ravel()
    shared = common_prefixes(flat, starts, lengths)
    levels, least = sparse_table(shared), sparse_table(ids)

    # Candidates: each sequence k with every depth beyond what it shares with its predecessor.
    counts = lengths - shared
    first = np.r_[0, np.cumsum(counts)].astype(np.int64)
    k = np.repeat(np.arange(m), counts)
    depth = np.arange(first[-1]) - first[k] + shared[k] + 1
    lo, hi = left_extent(levels, k, depth), right_extent(levels, k, depth)
    parent_lo = left_extent(levels, k, depth - 1)
    parent = np.where(depth > 0, first[parent_lo] + depth - 1 - (shared[parent_lo] + 1), -1)
    edge = (lo == 0) | (hi == m - 1)
    running = np.r_[0, np.cumsum(weights)]
    members, smallest = running[hi + 1] - running[lo], range_minimum(least, lo, hi)
    size = np.where(depth > 0, sizes[np.minimum(starts[k] + depth - 1, max(0, len(sizes) - 1))] if len(sizes) else 0, 0)
    child_count = np.bincount(parent[(depth > 0) & ~edge], minlength=first[-1]) if len(k) else np.empty(0, np.int64)
    inner = ~edge
    leaf = inner & (child_count == 0)
    saved = np.where(inner, (members - 1) * size, 0)
    # The subtree of a candidate is the run of candidates from it to the last one of its interval.
    stop, here = first[hi + 1], np.arange(first[-1])
    below = lambda v: (c := np.r_[0, np.cumsum(v)])[stop] - c[here]
    leaves, total = below(leaf.astype(np.int64)), below(saved)
    ends = np.full(first[-1], -1, np.int64)
    ends[first[1:] - 1] = np.arange(m)

    # Edge nodes, told on the chains of the first and the last sequence; what both chains pass is counted on the first one.
    rows, keys, parent_keys = [], [], []
    for side, at in ((0, 0), (1, m - 1))[:2 if m > 1 else 1]:
        digest, chain = hashlib.md5(), np.arange(lengths[at] + 1)
        on = left_extent(levels, np.full(len(chain), at), chain)
        rows.append(np.stack([np.full(len(chain), side), first[on] + chain - (shared[on] + 1), (on > 0) if side else np.ones(len(chain), bool)]))
        own = [digest.digest()]
        for d in range(lengths[at]):
            digest.update(seqs[at][d * WIDTH:(d + 1) * WIDTH])
            own.append(digest.digest())
        keys += own
        parent_keys += [None, *own[:-1]]
    side, node, counted = np.concatenate(rows, axis=1)
    whole = np.flatnonzero(inner)
    every = np.r_[whole, node]
    is_edge = np.r_[np.zeros(len(whole), bool), np.ones(len(node), bool)]
    share = np.r_[np.ones(len(whole), np.int64), counted]
    from_edge = (parent[every] >= 0) & edge[np.maximum(parent[every], 0)] & ~is_edge
    known = (parent[every] >= 0) & ~edge[np.maximum(parent[every], 0)]
    end_keys = [hashlib.md5(seqs[e]).digest() if e >= 0 else None for e in ends[whole]] + [None] * len(node)
    longs = lambda v, ok=None: pa.array(np.asarray(v, np.int64), mask=None if ok is None else ~ok)
    return pa.RecordBatch.from_arrays(
        [longs(np.full(len(every), piece)), pa.array(is_edge), pa.array(np.r_[np.full(len(whole), -1), side].astype(np.int32)), longs(depth[every]),
         longs(smallest[every]), longs(members[every] * share), longs(size[every]), longs(child_count[every] * share), longs(leaves[every] * share),
         longs(total[every] * share), longs(smallest[np.maximum(parent[every], 0)], known),
         pa.array(np.where(lo[np.maximum(parent[every], 0)] == 0, 0, 1).astype(np.int32), mask=~from_edge),
         pa.array([None] * len(whole) + keys, pa.binary()), pa.array([None] * len(whole) + parent_keys, pa.binary()), pa.array(end_keys, pa.binary())],
        names=[f.split()[0] for f in NODE.split(", ")])


def nodes_of_pieces(distinct: DataFrame) -> DataFrame:
    """The nodes of every piece of the distinct sequences (seq, n, least), in sorted order."""
    count = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.repartitionByRange(count, "seq").sortWithinPartitions("seq").select("seq", "n", "least", F.spark_partition_id().cast("long").alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seqs, weights, ids, symbols, done, task = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal seqs, weights, ids, symbols, done
            made = piece_nodes((task << 32) + done, seqs, np.array(weights, np.int64), np.array(ids, np.int64))
            seqs, weights, ids, symbols, done = [], [], [], 0, done + 1
            return made

        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column("task")[0].as_py()
            for s, n, i in zip(*(batch.column(c).to_pylist() for c in ("seq", "n", "least"))):
                seqs.append(s)
                weights.append(n)
                ids.append(i)
                symbols += len(s) // WIDTH
                if symbols >= PIECE_SYMBOLS or len(seqs) >= PIECE_SEQUENCES:
                    yield close()
        if seqs:
            yield close()

    return dealt.mapInArrow(run, NODE)


def merged_edges(parts: DataFrame) -> DataFrame:
    """Every distinct edge node with its totals: key, depth, conv_id, n_convs, n_children, n_leaves, saved_tokens, parent_key."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = parts.groupBy("key").agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), F.max("parent_key").alias("parent_key"),
                                     F.min(F.struct("piece", "side")).alias("owner"), *sums)
    kids = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    nodes = nodes.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    nodes = written(nodes, "trie-edges")
    own = nodes.select("key", "owner", F.col("n_children").eqNullSafe(0).cast("long").alias("own_leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("own_saved"))
    owned = F.col("owner") == F.struct("piece", "side")
    chains = parts.select("piece", "side", "depth", "key").join(own, "key")
    deep = Window.partitionBy("piece", "side").orderBy(F.desc("depth"))
    summed = chains.select("key", *(F.sum(F.when(owned, F.col(c)).otherwise(0)).over(deep).alias(c) for c in ("own_leaf", "own_saved")))
    more = summed.groupBy("key").agg(F.sum("own_leaf").alias("more_leaves"), F.sum("own_saved").alias("more_saved"))
    return nodes.join(more, "key").select(
        "key", "parent_key", "depth", "conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("more_saved")).alias("saved_tokens"))


def end_digests(convs: DataFrame) -> DataFrame:
    """key (digest of a sequence) and ends_sha256 over the ids of all its conversations, ascending.

    A digest over ids is one chain, so the ids of equal conversations stream through one task, eight bytes and a key each; only the running
    state is held.
    """
    ordered = convs.select(F.unhex(F.md5("seq")).alias("key"), "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state = None, None
        for batch in batches:
            done = []
            for key, i in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if key == open_key:
                    state.update(b",%d" % i)
                    continue
                if state:
                    done.append((open_key, state.hexdigest()))
                open_key, state = key, hashlib.sha256(b"%d" % i)
            yield told(done)
        yield told([(open_key, state.hexdigest())] if state else [])

    def told(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["key", "ends_sha256"])

    return ordered.mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """One row per node of the trie of the sequences (conv_id, seq): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs = written(seqs.select("conv_id", F.unhex(F.array_join("seq", "")).alias("seq")), "trie-sequences")
    distinct = convs.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    found = written(nodes_of_pieces(distinct), "trie-nodes")
    parts = found.where("edge")
    edges = written(merged_edges(parts), "trie-merged")
    told = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]

    above = edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    spine = edges.join(above, "parent_key", "left").select(*told, "key")
    # What hangs on an edge node learns its id from its own piece's chain, so no edge node's children meet in one task.
    hooks = parts.select("piece", "side", "depth", "key").join(edges.select("key", F.col("conv_id").alias("hook_id")), "key")
    hooks = hooks.select("piece", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), "hook_id")
    inner = found.where("not edge").withColumnRenamed("end_key", "end")
    inner = inner.join(hooks, ["piece", "parent_side", "depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "hook_id"))
    inner = inner.select(*told, F.col("end").alias("key"))
    none = F.lit(hashlib.sha256(b"").hexdigest()).alias("ends_sha256")
    ended = spine.union(inner.where("key is not null")).join(end_digests(convs), "key", "left").select(*told, F.coalesce("ends_sha256", none).alias("ends_sha256"))
    return ended.union(inner.where("key is null").select(*told, none))
