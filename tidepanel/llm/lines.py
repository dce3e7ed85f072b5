"""Line de-duplication within one edit, by a deletion-neighbourhood join.

A line is a piece of the text between line breaks, without blanks at its ends. It goes if an equal line occurs earlier (by id, then line
number), or, from `near_chars` code points on, if a line one insertion, deletion or substitution away first occurs earlier. Blank lines stay.

1. Equal lines are counted as one, with their first place, by a partial aggregate: a line that fills a third of all rows costs no more,
   and such a line is told its first place where it is read; blank lines take no part.
2. A line one edit away from another agrees with it in its left or its right half. Lines that share no half with any other have no
   neighbour, which settles all but a few without building their neighbourhoods.
3. The others emit all their variants: the line itself and the line less each one code point, as hashed keys. Lines with the same
   variant and the same deleted place are a substitution apart; a line that equals another's variant is a deletion apart. Such groups
   differ in one code point, so their size is bounded by the alphabet, and only their earliest line is a partner.
4. Partners are verified by their edit distance.

Rows with equal ids share their places, so their lines stay or go together; null ids come last. Null and empty texts are one blank line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import BITS, bit_set, join_classes, maybe_in, written

NEAR_CHARS = 20
LINE = ["h1", "h2"]


def pieces(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_of(piece: Column) -> Column:
    return F.btrim(piece, F.lit(" \t\r\f\x0b"))


def halves(line: Column, chars: Column) -> Column:
    """Keys of a line's halves: as one of its own length, and as the longer of a pair that differ in length."""
    rest = lambda start: F.substring(line, start, F.lit(2147483647))
    own, less = F.floor(chars / 2).cast("int"), F.floor((chars - 1) / 2).cast("int")
    zero = F.lit(1)
    return F.array(
        F.xxhash64(chars, F.lit("left"), F.substring(line, zero, own)), F.xxhash64(chars, F.lit("right"), rest(own + 1)),
        F.xxhash64(chars - 1, F.lit("left"), F.substring(line, zero, less)), F.xxhash64(chars - 1, F.lit("right"), rest(less + 2)),
    )


def hashed_lines(docs: DataFrame, near_chars: int) -> DataFrame:
    """row, doc_id, line_no, h1, h2, blank and halves (null for short lines) of every line."""
    cut = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.posexplode(pieces(F.col("text"))).alias("line_no", "piece"))
    line = cut.withColumn("line", line_of(F.col("piece"))).withColumn("chars", F.length("line"))
    keys = F.when(F.col("chars") >= near_chars, halves(F.col("line"), F.col("chars")))
    return line.select("row", "doc_id", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), (F.col("chars") == 0).alias("blank"), keys.alias("halves"))


def at() -> Column:
    """The place of a line, to be compared."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("line_no").alias("line_no"))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0xD1B54A32D192ED03)


#: Places of a line whose variants are emitted at once: a line of any length takes some megabytes beside its text.
SLICE = 1 << 15
_POWERS = np.multiply.accumulate(np.r_[np.uint64(1), np.full(SLICE - 1, _BASE)])
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))  # undoes a step of the powers


def variant_slices(line: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of the line less each one code point, slice by slice, the line itself (place -1) with the last.

    A hash sums letter values times powers of their place. Less one code point, the letters behind it move one place down, so their part of
    the whole line's sum is divided by one power.
    """
    n = len(line)

    def sums() -> Iterator[tuple[int, np.ndarray]]:
        scale = np.ones(1, np.uint64)
        for start in range(0, n, SLICE):
            letters = np.frombuffer(line[start:start + SLICE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            letters = (letters + _SALT) * np.uint64(0xBF58476D1CE4E5B9)
            letters = (letters ^ (letters >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            letters = letters ^ (letters >> np.uint64(32))
            yield start, letters * (_POWERS[:len(letters)] * scale)
            scale *= _POWERS[-1:] * _BASE

    total, front = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
    for _, part in sums():
        total += part.sum(dtype=np.uint64)
    whole = (total * _SALT + np.uint64(n)).view(np.int64)
    for start, part in sums():
        before = np.r_[front, front + np.cumsum(part, dtype=np.uint64)]  # of the letters in front of each place
        front = before[-1:]
        shorter = before[:-1] + (total - before[1:]) * _BACK
        keys, places = (shorter * _SALT + np.uint64(n - 1)).view(np.int64), np.arange(start, start + len(part))
        yield (places, keys) if start + SLICE < n else (np.r_[places, -1], np.r_[keys, whole])
    if not n:
        yield np.array([-1]), whole


def variants(lines: DataFrame) -> DataFrame:
    """variant, place (-1 for the line itself), h1, h2 and first of every variant of the lines."""
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, line in enumerate(batch.column("line").to_pylist()):
                for places, keys in variant_slices(line):
                    same = pa.array(np.full(len(keys), i))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(places), *(batch.column(c).take(same) for c in ("h1", "h2", "first"))],
                                                     names=["variant", "place", "h1", "h2", "first"])

    return lines.mapInArrow(run, f"variant long, place long, h1 long, h2 long, first {kinds['first']}")


def holders_of(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """text of the documents in which the lines occur first, and of a few others."""
    by_id = lambda i: F.xxhash64(i.cast("string"))
    held = bit_set(lines.select(by_id(F.col("first.id")).alias("hash")), "hash")
    rows = docs.select(F.pmod(by_id(F.col("doc_id")), F.lit(BITS)).alias("place"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield maybe_in(held, batch, "place").select(["text"])

    return rows.mapInArrow(run, "text string")


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """h1, h2 of lines that have an earlier neighbour."""
    keyed = distinct.where("halves is not null").select("h1", F.explode("halves").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    named = keyed.join(shared, "key", "left_semi").select("h1").distinct()
    candidates = distinct.where("halves is not null").join(named, "h1", "left_semi").select(*LINE, "first")
    candidates = written(candidates, "line-candidates")

    # Their texts, from the documents of their first occurrences: a bit set of fixed size picks these in the scan.
    cut = holders_of(docs, candidates).select(F.explode(pieces(F.col("text"))).alias("piece"))
    line = cut.select(F.xxhash64(line_of(F.col("piece"))).alias("h1"), F.xxhash64(F.lit(7), line_of(F.col("piece"))).alias("h2"), line_of(F.col("piece")).alias("line"))
    read = written(line.join(candidates, LINE).groupBy(*LINE).agg(F.first("line").alias("line"), F.first("first").alias("first")), "line-texts")

    emitted = variants(read).repartition("variant")
    me = F.struct("first", "h1", "h2")
    same_place = F.min(me).over(Window.partitionBy("variant", "place"))
    itself = F.min(F.when(F.col("place") == -1, me)).over(Window.partitionBy("variant"))
    longer = F.min(F.when(F.col("place") >= 0, me)).over(Window.partitionBy("variant"))
    partners = F.when(F.col("place") == -1, F.array(longer)).otherwise(F.array(same_place, itself))
    met = emitted.withColumn("partners", partners).select("h1", "h2", "first", F.explode("partners").alias("partner")).where("partner.first < first")
    pairs = met.select(*LINE, F.col("partner.h1").alias("p1"), F.col("partner.h2").alias("p2")).distinct()
    texts = read.select(*LINE, "line")
    both = pairs.join(texts, LINE).join(texts.toDF("p1", "p2", "partner"), ["p1", "p2"])
    return both.where(F.levenshtein("line", "partner", 1) >= 0).select(*LINE).distinct()


def line_duplicates(docs: DataFrame, near_chars: int = NEAR_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_exact and n_near (lines that go, by reason), removed (their numbers from 0, in order)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = written(hashed_lines(docs, near_chars), "lines")
    distinct = lines.where("not blank").groupBy(*LINE).agg(F.min(at()).alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves"))
    distinct = written(distinct, "lines-distinct")
    near = written(near_lines(docs, distinct), "lines-near").withColumn("near", F.lit(True))
    touched = written(distinct.select(*LINE, "first", "n").join(near, LINE, "left").where("n > 1 or near"), "lines-touched")
    told = join_classes(lines.where("not blank").select("row", "doc_id", "line_no", *LINE), touched, LINE, "n")
    exact = F.col("first") < at()
    gone = told.select("row", "doc_id", "line_no", exact.alias("exact"), (~exact & F.coalesce("near", F.lit(False))).alias("near")).where("exact or near")
    # Every line is counted where it is read; beside that only the lines that go are shuffled.
    every = lines.select("row", "doc_id", F.lit(None).cast("int").alias("line_no"), F.lit(False).alias("exact"), F.lit(False).alias("near"))
    return every.unionByName(gone).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.count_if(F.col("line_no").isNull()).alias("n_lines"), F.count_if("exact").alias("n_exact"), F.count_if("near").alias("n_near"),
        F.array_sort(F.collect_list("line_no")).alias("removed"),
    ).drop("row")


def without_lines(text: Column, removed: Column) -> Column:
    """The text less the removed lines."""
    return F.array_join(F.filter(pieces(text), lambda x, i: ~F.array_contains(removed, i)), "\n")


def clean(docs: DataFrame, near_chars: int = NEAR_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the lines that go taken out of their texts."""
    found = line_duplicates(docs, near_chars, id_col, text_col).where(F.size("removed") > 0)
    gone = found.groupBy("doc_id").agg(F.first("removed").alias("__removed")).withColumnRenamed("doc_id", "__id")
    joined = docs.join(gone, docs[id_col].eqNullSafe(F.col("__id")), "left")
    kept = F.when(F.col("__removed").isNull(), docs[text_col]).otherwise(without_lines(docs[text_col], F.col("__removed")))
    return joined.select(*(kept.alias(c) if c == text_col else docs[c] for c in docs.columns))
