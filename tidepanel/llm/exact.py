"""Exact de-duplication by Grace hashing with complete comparison.

Texts are equal when they are the same after every run of blanks (space, tab to carriage return) became one space; a null text counts
as empty. Two passes keep copies from meeting in one task:

1. each scan partition groups its own rows, so a text leaves it once with a count, however many copies the partition holds;
2. those representatives are shuffled on their digest and grouped again, and the rows learn their group by a thin join.

A pass holds its records in memory up to a budget. Beyond it they are dealt to spill files by bits of the digest, and each file again by
the next bits, until the distinct texts of a bucket fit an open-addressing table that compares whole contents. A bucket of copies of one
text fits at once, however long the file. Spill files are private to the task and go with it; a task that is run again makes its own.

Of equal texts the row with the smallest id stays (null ids last); of repeated rows with that id exactly one stays.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import tidy, written

#: Bytes of records, and of distinct texts in a table, that a task may hold; spill files a bucket is dealt to.
BUDGET, FANOUT_BITS = 64 << 20, 4


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


class Contents:
    """An open-addressing table: a slot holds the number of a content, found by its hash and confirmed by its bytes."""

    def __init__(self, slots: int = 1024):
        self.slots, self.hashes, self.contents, self.bytes = [-1] * slots, [], [], 0

    def number(self, h: int, content: bytes, add: bool = True) -> int:
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (n := slots[at]) >= 0:
            if self.hashes[n] == h and self.contents[n] == content:
                return n
            at = (at + 1) & mask
        if not add:
            raise KeyError(h)
        n = slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 100
        if 2 * len(self.contents) > len(slots):
            self._grow()
        return n

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for n, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = n


def hashes_of(batch: pa.RecordBatch) -> np.ndarray:
    """The first 64 bits of each record's digest."""
    return np.array([int(d[:16], 16) for d in batch.column("digest").to_pylist()], dtype=np.uint64)


class SpillFile:
    """Record batches in a file of the task's own; read as often as needed."""

    def __init__(self, path: str, schema: pa.Schema):
        self.path, self.schema = path, schema
        self.writer = pa.ipc.new_stream(path, schema)

    def add(self, batch: pa.RecordBatch) -> None:
        self.writer.write_batch(batch)

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        self.writer.close()
        with pa.OSFile(self.path) as source, pa.ipc.open_stream(source) as batches:
            yield from batches


Answer = Callable[[pa.RecordBatch, np.ndarray, "list"], pa.RecordBatch]


def _deal(source: Iterable[pa.RecordBatch], schema: pa.Schema, folder: str, level: int) -> list[SpillFile]:
    files = [SpillFile(os.path.join(folder, f"{level}-{b}"), schema) for b in range(1 << FANOUT_BITS)]
    shift, mask = np.uint64(64 - FANOUT_BITS * (level + 1)), np.uint64((1 << FANOUT_BITS) - 1)
    for batch in source:
        bucket = (hashes_of(batch) >> shift) & mask
        for b in np.unique(bucket):
            files[int(b)].add(batch.filter(pa.array(bucket == b)))
    return files


def _groups(source: Iterable[pa.RecordBatch], budget: int | None, answer: Answer) -> Iterator[pa.RecordBatch] | None:
    """Group a source that can be read twice; None if its distinct texts pass the budget."""
    table, best = Contents(), []  # best: [null id?, id, row_key, members] of each content
    for batch in source:
        ids, keys, members = (batch.column(c).to_pylist() for c in ("doc_id", "row_key", "members"))
        for h, content, i, key, n in zip(hashes_of(batch).tolist(), batch.column("content"), ids, keys, members):
            g = table.number(h, content.as_py().encode())
            mine = (i is None, i, key)
            if g == len(best):
                best.append([mine, n])
                if budget is not None and table.bytes > budget:
                    return None
            else:
                best[g][1] += n
                first = best[g][0]
                if (mine[0], mine[2]) < (first[0], first[2]) if mine[1] == first[1] or mine[0] or first[0] else mine[1] < first[1]:
                    best[g][0] = mine

    def told() -> Iterator[pa.RecordBatch]:
        for batch in source:
            numbers = (table.number(h, c.as_py().encode(), add=False) for h, c in zip(hashes_of(batch).tolist(), batch.column("content")))
            yield answer(batch, np.fromiter(numbers, dtype=np.int64, count=batch.num_rows), best)

    return told()


def _bucket(source: Iterable[pa.RecordBatch], schema: pa.Schema, folder: str, level: int, budget: int, answer: Answer) -> Iterator[pa.RecordBatch]:
    last = FANOUT_BITS * (level + 1) > 64
    if (told := _groups(source, None if last else budget, answer)) is not None:
        yield from told
        return
    with tempfile.TemporaryDirectory(dir=folder) as inner:
        for file in _deal(source, schema, inner, level):
            yield from _bucket(file, schema, inner, level + 1, budget, answer)
            os.remove(file.path)


def grace(batches: Iterator[pa.RecordBatch], answer: Answer, budget: int = BUDGET) -> Iterator[pa.RecordBatch]:
    """Answer every record of a partition with its group; records are held while they fit the budget and dealt to files beyond it."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > budget:
            break
    if not held:
        return
    if size <= budget:
        yield from _groups(held, None, answer)
        return

    def everything() -> Iterator[pa.RecordBatch]:
        while held:
            yield held.pop(0)
        yield from batches

    schema = held[0].schema
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for file in _deal(everything(), schema, folder, 0):
            yield from _bucket(file, schema, folder, 1, budget, answer)
            os.remove(file.path)


def _best(best: list, groups: np.ndarray, field: int) -> list:
    return [best[g][0][field] for g in groups]


def local_groups(docs: DataFrame, id_col: str, text_col: str, budget: int) -> DataFrame:
    """Pass 1: row_key, rep_key, doc_id, digest of every row; members and the whole row of each representative."""
    content = normalised(docs[text_col])
    keyed = docs.select(
        F.monotonically_increasing_id().alias("row_key"), docs[id_col].alias("doc_id"), F.sha2(content, 256).alias("digest"),
        content.alias("content"), F.lit(1).cast("long").alias("members"), F.struct(*(docs[c] for c in docs.columns)).alias("row"),
    )

    def answer(batch: pa.RecordBatch, groups: np.ndarray, best: list) -> pa.RecordBatch:
        reps = np.array(_best(best, groups, 2), dtype=np.int64)
        is_rep = pa.array(reps == batch.column("row_key").to_numpy())
        counts = pa.array([best[g][1] for g in groups], pa.int64())
        rows = pa.Table.from_batches([batch]).column("row").combine_chunks()
        # Rows that are not representatives leave with a null in place of their text.
        row = rows.take(pa.array([i if r else None for i, r in enumerate(is_rep.to_pylist())], pa.int64()))
        none = pa.nulls(len(groups), pa.int64())
        members = pa.compute.if_else(is_rep, counts, none)
        return pa.RecordBatch.from_arrays(
            [batch.column("row_key"), pa.array(reps), batch.column("doc_id"), batch.column("digest"), members, row],
            names=["row_key", "rep_key", "doc_id", "digest", "members", "row"],
        )

    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema}
    schema = f"row_key long, rep_key long, doc_id {kinds['doc_id']}, digest string, members long, row {keyed.schema['row'].dataType.simpleString()}"
    return keyed.mapInArrow(tidy(lambda batches: grace(batches, answer, budget)), schema)


def merged_groups(local: DataFrame, text_col: str, budget: int) -> DataFrame:
    """Pass 2: for every representative the group it is in: keep_key, keep_id, group_size."""
    reps = local.where("members is not null").select(
        F.col("rep_key").alias("row_key"), "doc_id", "digest", normalised(F.col("row")[text_col]).alias("content"), "members",
    )

    def answer(batch: pa.RecordBatch, groups: np.ndarray, best: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column("row_key"), pa.array(_best(best, groups, 2), pa.int64()), pa.array(_best(best, groups, 1), batch.column("doc_id").type),
             pa.array([best[g][1] for g in groups], pa.int64())],
            names=["rep_key", "keep_key", "keep_id", "group_size"],
        )

    id_type = local.schema["doc_id"].dataType.simpleString()
    dealt = reps.repartition("digest")
    return dealt.mapInArrow(tidy(lambda batches: grace(batches, answer, budget)), f"rep_key long, keep_key long, keep_id {id_type}, group_size long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    local = written(local_groups(docs.select(id_col, text_col), id_col, text_col, budget), "exact-local")
    merged = merged_groups(local, text_col, budget)
    return local.select("row_key", "rep_key", "doc_id", "digest").join(merged, "rep_key").select(
        "doc_id", "keep_id", "group_size", (F.col("row_key") == F.col("keep_key")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows that stay, with all their columns."""
    local = written(local_groups(docs, id_col, text_col, budget), "exact-local")
    stays = merged_groups(local, text_col, budget).where("rep_key = keep_key").select("rep_key")
    return local.where("members is not null").join(stays, "rep_key", "left_semi").select("row.*")
