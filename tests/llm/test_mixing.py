import random

import duckdb
import pytest

import check
from tests.llm.conftest import EDGES
from tidepanel.llm import mixing as M
from tidepanel.llm.queries import ORACLE, QUERIES, mix_documents, mix_sql


def told(df):
    return df.select("row.doc_id", "domain", "lang", "source", "n_tokens", "given", "copies").collect()


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [list(r) for r in rows])
    return con.execute(f"WITH {mix_sql('documents')} SELECT doc_id, domain, lang, source, n_tokens, coalesce(given, 0), copies FROM mixed").fetchall()


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_edges_equal_sql(corpus, edges):
    assert ordered(told(mix_documents(edges))) == ordered(by_sql(EDGES))
    assert mix_documents(edges.limit(0)).count() == 0
    assert M.mixed(mix_documents(edges)).columns == edges.columns


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_leaf_equals_sql(corpus, seed):
    """One source holds most rows, so its prefix is found over several bins; other leaves run short."""
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randint(0, 30), rng.choice(["en", "en", "de", "xx", None]), rng.choice(["src0"] * 6 + ["src1", "src2", "src5", "odd"])) for i in range(6000)]
    docs = corpus.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = told(mix_documents(docs))
    assert ordered(got) == ordered(by_sql(rows))
    leaves = {(r.domain, r.lang, r.source): r.given for r in got}
    taken = {}
    for r in got:
        taken[r.domain, r.lang, r.source] = taken.get((r.domain, r.lang, r.source), 0) + r.n_tokens * r.copies
    assert all(0 <= leaves[k] - taken[k] <= 30 for k in leaves)
    assert abs(sum(leaves.values()) - 0.8 * sum(r.n_tokens for r in got)) < 100


def test_shortage_goes_to_siblings_first(corpus):
    rows = [(f"d{d}", lang, s, tokens) for d, lang, s, tokens in (("0", "a", "p", 10), ("0", "a", "q", 1000), ("0", "b", "r", 1000), ("1", "a", "t", 1000))]
    leaves = corpus.createDataFrame([(*r, 1, 600) for r in rows], "domain string, lang string, source string, tokens long, n long, budget long")
    given = {r.source: r.given for r in M.allocate(leaves, 1, {"domain": {"*": 1}, "lang": {"*": 1}, "source": {"*": 1}}).collect()}
    assert given == {"p": 10, "q": 140, "r": 150, "t": 300}


def test_query_equals_sql(corpus):
    sf = "/root/testdata/sf0.001"
    status, note = check.compare(corpus, check.connect(sf), "op10_mixing", QUERIES["op10_mixing"], ORACLE["op10_mixing"], sf)
    assert status == "ok", note
