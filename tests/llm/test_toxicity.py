import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES
from tidepanel.llm import toxicity as T
from tidepanel.llm.common import crc_mod
from tidepanel.llm.queries import QUERIES


def test_held_out_labels(corpus):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op9_toxicity"](corpus, sf).toPandas()
    assert all(h == (crc_mod(i, 5) == 0) for h, i in zip(got.held_out, got.doc_id))
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    toxic = held.toxic == 1
    ranks = held.score.rank()
    n1, n0 = toxic.sum(), (~toxic).sum()
    assert (ranks[toxic].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.95
    assert held.predicted[toxic].mean() > 0.85 and held.predicted[~toxic].mean() < 0.01


def test_edges_and_few_labels(corpus, edges):
    labels = corpus.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    for marked, expected in ((labels.limit(0), 0.0), (labels.where("doc_id = 1"), 1.0)):
        got = T.score(edges, T.fit(edges, marked))
        rows = got.collect()
        assert got.select("row.*").columns == edges.columns and len(rows) == len(EDGES)
        assert {r.score for r in rows} == {expected}
    assert T.score(edges.limit(0), T.fit(edges, labels)).count() == 0


def test_small_fit_separates(corpus):
    texts = [(i, ("you are such an idiot " if i % 3 == 0 else "what a fine day it is ") + f"number {i} " * (i % 7), int(i % 3 == 0)) for i in range(300)]
    docs = corpus.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = corpus.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    model = T.fit(docs, labels, settings=T.Settings(trees=3))
    assert "idiot" in model.lexicon
    got = T.score(docs, model).select(F.col("row.doc_id").alias("doc_id"), "score").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in got)


def test_features():
    told = dict(zip(T.NAMES, T.features("You 1d1ot! STUPID trash, stuuupid st*pid day", T.INSULTS, 4)))
    assert told["hits"] == np.log1p(2) and told["hidden_hits"] > 0 and told["near_person"] > 0 and told["shout_rate"] > 0 and told["stretched"] > 0
    assert T.features("", T.INSULTS, 4) == [0.0] * len(T.NAMES)


def test_long_words_are_learned(corpus):
    run_together = "youaresuchaterribleperson" * 3
    texts = [(i, (f"{run_together} " if i % 3 == 0 else "what a fine day it is ") + f"number {i}", int(i % 3 == 0)) for i in range(120)]
    sample = corpus.createDataFrame([(t, y) for _, t, y in texts], "text string, toxic int")
    assert run_together in T.learned_words(sample, T.Settings())
