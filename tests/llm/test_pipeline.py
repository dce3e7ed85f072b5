import hashlib
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_exact import plain as plain_exact
from tests.llm.test_mixing import by_sql
from tests.llm.test_near import plain as plain_near
from tidepanel.llm import langid
from tidepanel.llm.common import crc_mod

SF = "/root/testdata/sf0.001"


def expected(corpus, docs):
    """The stages in plain Python over rows (doc_id, text, lang, source)."""
    table = corpus.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    train = table.where(F.col("doc_id").isin([r[0] for r in docs if r[0] is not None and crc_mod(r[0], 4) != 2]) | F.col("doc_id").isNull())
    model = langid.fit(train, F.lit(True))
    rows = [r for r in docs if not langid.classify(r[1], model)[3]]
    stays = Counter((i, d) for i, _, _, kept, d in plain_exact([r[:2] for r in rows]) if kept)
    rows = [r for r in rows if stays.pop((r[0], _digest(r[1])), 0)]
    near = {i: kept for i, _, _, kept in plain_near([r[:2] for r in rows], 5)}
    rows = [r for r in rows if near[r[0]]]
    copies = {r[0]: r[6] for r in by_sql(rows)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for r in rows:
        ids = library.encode(r[1], add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out += [(r[0], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] * copies[r[0]]
    return sorted(out)


def _digest(text):
    return plain_exact([(0, text)])[0][4]


def test_pipeline_equals_plain_stages(corpus):
    docs = [tuple(r) for r in corpus.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    assert sorted(map(tuple, P.run(corpus, SF).collect())) == expected(corpus, docs)


def test_stages_keep_columns_on_edges(corpus, edges):
    docs = edges
    for name, stage in P.STAGES[:-1]:
        docs = stage(corpus, docs, SF)
        assert docs.columns == edges.columns, name
    assert P.STAGES[-1][1](corpus, docs, SF).count() > 0
    empty = edges.limit(0)
    for _, stage in P.STAGES:
        empty = stage(corpus, empty, SF)
    assert empty.count() == 0
