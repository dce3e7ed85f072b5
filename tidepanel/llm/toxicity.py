"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities and counts of a lexicon's words, of lexicon words near second-person words, of words that match the
lexicon only after obfuscation is undone; rates of capitals, punctuation, symbols inside words and repeated letters; its length. The lexicon
is a small list of common insults and the words of the training sample that tell toxic from clean texts best.

Fitting reads at most about `sample` labelled rows, taken by a hash of the id over all of them; part of these is kept from the trees for the
calibration. Every text has a score, also null and empty ones (their features are zeros). A row with several labels is toxic if one says so;
rows without a label, or a null one, do not take part. With labels of one class only the score is that class; without labels it is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import texts, written

# Common insults, and second-person words of the corpus languages.
INSULTS = frozenset(
    "idiot stupid moron dumb trash scum worthless pathetic disgusting loser garbage filth vermin ugly hate kill imbecile crap damn hell "
    "dummkopf abschaum dumm arschloch idiota estupido basura imbecil connard ordure debile salaud".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein ihr euch tu te toi vous votre ton usted ustedes vos".split())
# Signs that stand for letters.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
NAMES = ("hits", "hit_rate", "distinct_hits", "hit_peak", "near_person", "person_rate", "hidden_hits", "hidden_rate", "capital_rate", "shout_rate",
         "punctuation_rate", "exclaim_rate", "question_rate", "symbol_words", "stretched", "log_words")
_WORD = re.compile(r"[^\W_]+(?:[@$!*0-9]+[^\W_]+)*")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_PUNCTUATION = re.compile(r"[^\w\s]")
_INSIDE = re.compile(r"[^\W\d_][@$!*0-9]+[^\W\d_]?")


@dataclass(frozen=True)
class Settings:
    sample: int = 20_000  # labelled rows that fitting reads, in expectation
    learned_words: int = 200  # most words a lexicon learns
    least_texts: int = 5  # toxic texts a learned word is in,
    least_share: float = 0.01  # and share of all toxic texts
    odds: float = 2.0  # least log-odds of a learned word
    near: int = 4  # words between an insult and a second-person word
    trees: int = 20
    depth: int = 4
    rate: float = 0.3


@dataclass
class Model:
    lexicon: frozenset
    trees: object = None
    calibration: object = None
    constant: float = 0.0
    settings: Settings = field(default_factory=Settings)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(text: str, lexicon: frozenset, near: int) -> list[float]:
    """The dense features of a text, in the order of NAMES."""
    if not text:
        return [0.0] * len(NAMES)
    found, chars = _WORD.findall(text), len(text)
    lower = [w.lower() for w in found]
    n = max(len(lower), 1)
    hits = [i for i, w in enumerate(lower) if w in lexicon]
    person = [i for i, w in enumerate(lower) if w in SECOND_PERSON]
    close, j = 0, 0
    for i in hits:
        while j < len(person) and person[j] < i - near:
            j += 1
        close += j < len(person) and person[j] <= i + near
    odd = [w for w in lower if not w.isalpha() and w not in lexicon]
    hidden = sum(w.translate(DISGUISE) in lexicon or w.replace("*", "") in lexicon for w in odd)
    hidden += sum(_STRETCHED.sub(r"\1", w) in lexicon for w in lower if w not in lexicon and _STRETCHED.search(w)) if _STRETCHED.search(text) else 0
    # The densest stretch of fifty words tells a few insults in a long text from none.
    peak = max((b - a + 1 for a, b in _windows(hits, 50)), default=0)
    marks, letters = len(_PUNCTUATION.findall(text)), sum(map(len, found)) or 1
    capitals = sum(map(str.isupper, text)) if not text.islower() else 0
    return [
        np.log1p(len(hits)), len(hits) / n, np.log1p(len({lower[i] for i in hits})), peak / 50, close / n, len(person) / n, np.log1p(hidden), hidden / n,
        capitals / letters, sum(len(w) > 2 and w.isupper() for w in found) / n, marks / chars, text.count("!") / chars, text.count("?") / chars,
        sum(_INSIDE.search(w) is not None for w in odd) / n, len(_STRETCHED.findall(text)) / n, np.log1p(len(lower)),
    ]


def _windows(at: list[int], wide: int) -> Iterator[tuple[int, int]]:
    """For each last position the first index within `wide` of it."""
    first = 0
    for last, p in enumerate(at):
        while at[first] <= p - wide:
            first += 1
        yield first, last


def with_features(docs: DataFrame, lexicon: frozenset, near: int, text: str = "text") -> DataFrame:
    """Every row as `row`, with its features as an array."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [features(t, lexicon, near) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(told, pa.list_(pa.float64()))], names=["row", "told"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, told array<double>")


def learned_words(sample: DataFrame, settings: Settings) -> frozenset:
    """Words whose odds of being in a toxic text are highest, from the training sample."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told: dict[str, list[int]] = {}
            for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist()):
                for w in set(words_of(text)):
                    told.setdefault(w, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(told), pa.string()), pa.array([v[1] for v in told.values()], pa.int64()),
                                              pa.array([v[0] for v in told.values()], pa.int64())], names=["word", "bad", "good"])

    totals = sample.groupBy().agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.count("*").alias("n")).first()
    bad, good = totals["bad"], totals["n"] - totals["bad"]
    if not bad or not good:
        return frozenset()
    counts = sample.select("text", "toxic").mapInArrow(distinct, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (bad - F.col("bad") + 0.5)) - F.log((F.col("good") + 0.5) / (good - F.col("good") + 0.5))
    need = max(settings.least_texts, settings.least_share * bad)
    best = counts.where(F.col("bad") >= need).withColumn("odds", odds).where(F.col("odds") >= settings.odds)
    top = best.orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "word").limit(settings.learned_words).collect()
    return frozenset(r["word"] for r in top)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", settings: Settings = Settings()) -> Model:
    """Lexicon, trees and calibration from documents and labels (0 or 1) with the same key; only sampled texts are shuffled."""
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30))
    taken = place < min(1 << 30, int(settings.sample / max(marked.count(), 1) * (1 << 30)))
    rows = docs.select(key, F.col(text).alias("text")).where(taken).join(marked.where(taken), key)
    sample = written(rows.select(F.col(key).cast("string").alias("key"), "text", "toxic"), "toxicity-sample")
    lexicon = INSULTS | learned_words(sample, settings)
    ready = with_features(sample, lexicon, settings.near).select(
        array_to_vector("told").alias("features"), F.col("row.toxic").cast("double").alias("label"),
        (F.pmod(F.xxhash64("row.key", F.lit("part")), F.lit(4)) == 0).alias("kept_back"))
    ready = written(ready, "toxicity-features")
    seen = {(r["kept_back"], r["label"]) for r in ready.select("kept_back", "label").distinct().collect()}
    if (False, 0.0) not in seen or (False, 1.0) not in seen:
        return Model(lexicon, constant=1.0 if seen and all(x for _, x in seen) else 0.0, settings=settings)
    trees = GBTClassifier(maxIter=settings.trees, maxDepth=settings.depth, stepSize=settings.rate, seed=7, maxBins=64).fit(ready.where("not kept_back"))
    told = raw_score(trees, ready.where("kept_back") if {(True, 0.0), (True, 1.0)} <= seen else ready).select("label", F.col("raw").alias("features_raw"))
    calibration = IsotonicRegression(featuresCol="features_raw", labelCol="label").fit(told)
    return Model(lexicon, trees, calibration, settings=settings)


def raw_score(trees, ready: DataFrame) -> DataFrame:
    return trees.transform(ready).withColumn("raw", vector_to_array("probability")[1])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row as `row`, with `score` from 0 to 1."""
    told = with_features(docs, model.lexicon, model.settings.near, text)
    if model.trees is None:
        return told.select("row", F.lit(model.constant).alias("score"))
    raw = raw_score(model.trees, told.withColumn("features", array_to_vector("told"))).select("row", F.col("raw"))
    # The calibration is a few steps: straight lines between its boundaries, written as an expression.
    at, values = (np.asarray(x.toArray() if hasattr(x, "toArray") else x) for x in (model.calibration.boundaries, model.calibration.predictions))
    edges, heights = F.array(*map(F.lit, at.tolist())), F.array(*map(F.lit, values.tolist()))
    k = F.size(F.filter(edges, lambda x: x <= F.col("raw")))
    x0, x1 = F.get(edges, k - 1), F.get(edges, k)
    y0, y1 = F.get(heights, k - 1), F.get(heights, k)
    line = F.when(x1 > x0, y0 + (y1 - y0) * (F.col("raw") - x0) / (x1 - x0)).otherwise(y0)
    inside = F.when(k == 0, heights[0]).when(k >= len(at), heights[len(at) - 1]).otherwise(line)
    return raw.select("row", F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0)).alias("score"))
