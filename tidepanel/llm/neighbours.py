"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

A rotation is learned on a bounded sample: principal directions, then alternating between signs and the closest rotation. A vector's code is
the sign of each rotated coordinate; the code is cut into substrings of at most 16 bits, each with a table of its own. Codes within Hamming
radius r of a query agree with it in some substring up to r / m flips (m substrings), so widening the flips by one in each table in turn
retrieves every code within the radius. A query widens its radius until `least` candidates lie within it, and reranks those by exact distance.

Rows are dealt by hash to shards of about `shard_rows`, each with its own tables; queries come in blocks of about `block_rows`, and every
block meets every shard in a task of bounded size. A shard answers with its best k per query; the best k of all are taken from those.
Vectors with equal components are held once, with the k + 1 smallest ids, so copies of one vector fill no table.

Vectors take no part if they are null, all zeros, hold a null or a component that is not finite, or are of another length than the most
common one in the sample; nor do rows without id. Equal distances go to the smaller id; repeated rows of an id count once. Distances are
Euclidean, in double precision, on the vectors as given.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import written

ID, VEC = "vec_id", "embedding"


@dataclass(frozen=True)
class Settings:
    sample: int = 16_384  # vectors the rotation is learned on
    rounds: int = 25
    bits: int = 16  # of a substring
    least: int = 2_000  # candidates within the radius, in each shard that has as many
    shard_rows: int = 16_384
    block_rows: int = 1_024


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


def learn_rotation(sample: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation: principal directions turned so that signs lose least."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, _, directions = np.linalg.svd(centred.T @ centred)
    projected = centred @ directions.T
    turn = np.linalg.qr(np.random.default_rng(5).standard_normal((projected.shape[1],) * 2))[0]
    for _ in range(rounds):
        signs = np.where(projected @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(projected.T @ signs)
        turn = left @ right
    return mean, directions.T @ turn


def substrings(vectors: np.ndarray, mean: np.ndarray, rotation: np.ndarray, bits: int) -> np.ndarray:
    """Codes of the vectors, one column of `bits` bits at most for each substring."""
    signs = (vectors - mean) @ rotation >= 0
    m = -(-signs.shape[1] // bits)
    return np.stack([s @ (1 << np.arange(s.shape[1])) for s in np.array_split(signs, m, axis=1)], axis=1).astype(np.int64)


class Tables:
    """One shard: for each substring the rows sorted by its value, found by the value's range."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits, self.n = codes, bits, len(codes)
        self.rows = [np.argsort(c, kind="stable") for c in codes.T]
        self.starts = [np.searchsorted(c[r], np.arange((1 << bits) + 1)) for c, r in zip(codes.T, self.rows)]
        self.ones = np.array([bin(i).count("1") for i in range(1 << bits)], dtype=np.int16)
        self.flips = {}

    def masks(self, flips: int) -> np.ndarray:
        """All substring masks with so many ones."""
        if flips not in self.flips:
            self.flips[flips] = np.array([sum(1 << i for i in c) for c in combinations(range(self.bits), flips)], dtype=np.int64)
        return self.flips[flips]

    def within(self, code: np.ndarray, least: int) -> np.ndarray:
        """Every row within the smallest radius that holds `least` rows, radii widened by one flip in one table at a time."""
        m, least = len(code), min(least, self.n)
        seen, found, far = np.zeros(self.n, bool), np.empty(0, np.int64), np.empty(0, np.int64)
        for step in range(m * (self.bits + 1)):
            flips, k = divmod(step, m)
            at = code[k] ^ self.masks(flips)
            begin, size = self.starts[k][at], self.starts[k][at + 1] - self.starts[k][at]
            if size.any():
                begin, size = begin[size > 0], size[size > 0]
                ends = np.cumsum(size)
                hit = self.rows[k][np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)]
                hit = hit[~seen[hit]]
                seen[hit] = True
                found = np.r_[found, hit]
                far = np.r_[far, self.ones[self.codes[hit] ^ code].sum(axis=1)]
            # Probed so far: everything within radius `step`, since m * flips + k + 1 flips exceed it in every table.
            if step % m == m - 1 or len(found) >= least:
                inside = far <= step
                if inside.sum() >= least:
                    return found[inside]
        return found


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


def search(vectors: DataFrame, is_query: Column, k: int = 10, settings: Settings = Settings(), vec_id: str = ID, embedding: str = VEC) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query among all other rows."""
    rows = vectors.select(F.col(vec_id).alias(ID), F.transform(F.col(embedding), lambda x: x.cast("double")).alias(VEC), is_query.alias("is_query"))
    rows = rows.where(usable(F.col(VEC)) & F.col(ID).isNotNull())
    key = F.xxhash64(VEC)
    sample = rows.select(VEC).orderBy(F.xxhash64(ID, F.lit("sample")), ID).limit(settings.sample).toPandas()[VEC]
    lengths = sample.map(len)
    if not len(sample):
        return rows.select(F.col(ID).alias("query_id"), F.lit(1).alias("rank"), ID, F.lit(0.0).alias("score")).limit(0)
    width = int(lengths.mode().iloc[0])
    mean, rotation = learn_rotation(np.stack(sample[lengths == width].to_list()), settings.rounds)
    rows = rows.where(F.size(VEC) == width)

    # Copies of a vector in one entry: per part of the ids first, so that no task sees all of a common vector.
    few = F.row_number().over(Window.partitionBy("key", VEC, "salt").orderBy(ID))
    thinned = rows.select(ID, VEC).distinct().withColumn("key", key).withColumn("salt", F.pmod(F.xxhash64(ID), F.lit(64))).withColumn("n", few).where(F.col("n") <= k + 1)
    entries = thinned.groupBy("key", VEC).agg(F.slice(F.array_sort(F.collect_list(ID)), 1, k + 1).alias("ids"))
    entries = written(entries, "neighbour-entries")
    queries = written(rows.where("is_query").select(ID, VEC).distinct(), "neighbour-queries")
    shards = -(-max(entries.count(), 1) // settings.shard_rows)
    blocks = -(-max(queries.count(), 1) // settings.block_rows)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = entries.withColumn("shard", F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    asked = queries.withColumn("block", F.pmod(F.xxhash64(ID, F.lit("block")), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], ID: [], "score": []}
        if len(left) and len(right):
            data = np.stack(left[VEC].to_list())
            tables = Tables(substrings(data, mean, rotation, settings.bits), settings.bits)
            ids = left["ids"].to_list()
            asked_vectors = np.stack(right[VEC].to_list())
            for query, vector, code in zip(right[ID], asked_vectors, substrings(asked_vectors, mean, rotation, settings.bits)):
                found = tables.within(code, settings.least)
                far = distances(vector, data[found])
                # Entries up to the (k + 1)-th distance: one of them may be the query itself.
                edge = np.partition(far, k)[k] if len(far) > k else np.inf
                near = sorted((d, i) for e, d in zip(found[far <= edge], far[far <= edge]) for i in ids[e] if i != query)[:k]
                out["query_id"] += [query] * len(near)
                out[ID] += [i for _, i in near]
                out["score"] += [d for d, _ in near]
        return pd.DataFrame(out).astype({"query_id": "int64", ID: "int64", "score": "float64"})

    told = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(answer, f"query_id long, {ID} long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", ID))
    return told.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", ID, "score")
