import math
import re
import unicodedata

import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES
from tidepanel.llm import langid as G
from tidepanel.llm.common import crc_mod
from tidepanel.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(corpus):
    got = QUERIES["op2_language"](corpus, SF).join(corpus.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.length("text").alias("chars")), "doc_id").collect()
    assert all(r.held_out == (crc_mod(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.chars >= 60]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in held) <= 0.02 * len(held)


def test_edges(edges):
    model = G.fit(edges, F.lit(True))
    assert model.languages == ("de", "en", "fr")
    got = G.identify(edges, model)
    assert got.select("row.*").columns == edges.columns
    for r in got.collect():
        letters = any(map(str.isalpha, r.row.text or ""))
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    told = {r.row.doc_id: r for r in got.collect()}
    assert told[7].lang_pred == "en" and told[10].lang_pred == "fr" and told[6].rejected
    assert G.identify(edges.limit(0), model).count() == 0


@pytest.mark.parametrize(("languages", "expected"), [((), ("und", 0.0)), (("en",), ("en", 1.0))])
def test_few_languages(edges, languages, expected):
    model = G.fit(edges.where(F.col("lang").isin(*languages) if languages else F.lit(False)), F.lit(True))
    r = next(r for r in G.identify(edges, model).collect() if r.row.doc_id == 1)
    assert (r.lang_pred, r.score) == expected
    assert len(G.identify(edges, model).collect()) == len(EDGES)


def plain(text, model):
    """Language and sizes by fresh encoders for every block."""
    said = "".join(ch if unicodedata.category(ch)[0] in "LM" or ch in "'’" else " " for ch in text.lower())
    data = f" {re.sub(' +', ' ', said)} ".encode()
    found = []
    for content in model.contents:
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=12)
        size = 0
        for i in range(0, len(data), 16384):
            one = zstandard.ZstdCompressor(dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)
            size += len(one.compress(b"0123456789 " * 8 + data[i:i + 16384]))
        found.append(size)
    return model.languages[found.index(min(found))], found


def test_query_against_plain_classifier(corpus):
    sf = "/root/testdata/sf0.001"
    docs = corpus.read.parquet(f"{sf}/documents.parquet")
    train = F.udf(lambda i: crc_mod(i, 4) != 2, "boolean")
    model = G.fit(docs, train("doc_id"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in QUERIES["op2_language"](corpus, sf).collect():
        if any(map(str.isalpha, texts[r.doc_id])):
            best, found = plain(texts[r.doc_id], model)
            least, second = sorted(found)[:2]
            assert (r.lang_pred, r.margin) == (best, (second - least) / second)
            assert abs(r.score - 1 / sum(math.exp((least - x) / 6) for x in found)) < 1e-9 and r.rejected == (r.margin < 0.005)


def test_marks_stay():
    for text in ("हिन्दी भाषा में लिखा", "ภาษาไทยเขียนแบบนี้", "l'été d’hiver"):
        assert G.prepared(text).decode().strip() == text


def test_no_switch_by_length(corpus):
    """One dictionary for texts of any length: a text around a kilobyte keeps its language as it grows."""
    docs = corpus.read.parquet(f"{SF}/documents.parquet")
    model = G.fit(docs, F.lit(True))
    base = "the people of the town went to the market and bought some bread for the children "
    assert {G.classify(base * n, model)[0] for n in (1, 5, 12, 13, 14, 200, 500)} == {"en"}
