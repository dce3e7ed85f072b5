import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import EDGES
from tidepanel.llm import bpe as B
from tidepanel.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_library(library):
    rng = random.Random(4)
    letters = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["", "İSTANBUL ΑΣ ſ", "a<|endoftext|>b <|STARTOFTEXT|><|startoftext|>", "x" * 5000, "ab" * 400 + "'s it'll don’t", "\x1c\x85  é é ½ ²", "\U0001F600 ok"]
    texts += ["".join(rng.choices(letters[:n], k=80)) for n in (300, 1300, 3000, len(letters)) for _ in range(60)]
    texts += ["".join(rng.choices("abcdeé ',.\n", k=300)) for _ in range(60)]
    ids, counts = B.Vocabulary(PATH).encode(texts)
    want = library.encode_batch(texts, add_special_tokens=False)
    assert counts.tolist() == [len(w.ids) for w in want]
    assert ids.tolist() == [i for w in want for i in w.ids]


def test_short_and_long_paths_agree():
    vocabulary = B.Vocabulary(PATH)
    rng = random.Random(5)
    words = ["".join(rng.choices("thinger", k=rng.randint(1, 30))).encode() for _ in range(300)]
    assert [a.tolist() for a in vocabulary.short_words(words)] == [vocabulary.long_word(w).tolist() for w in words]


def test_edges(edges, library):
    got = B.decode(B.encode(edges, PATH), PATH)
    assert got.select("row.*").columns == edges.columns
    rows = got.collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        ids = library.encode(r.row.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert B.decode(B.encode(edges.limit(0), PATH), PATH).count() == 0


def test_query(corpus, library):
    sf = "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r.doc_id: r.text or "" for r in corpus.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op6_bpe"](corpus, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
