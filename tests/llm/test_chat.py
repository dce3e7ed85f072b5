import hashlib
from itertools import groupby

from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa

from tidepanel.llm import chat as C
from tidepanel.llm.queries import QUERIES

PIECES = ["<|im_end|>", "<|im_start|>", "<\\|", "<|nl|>", "|>", "<", "\\", "|", "\n", "assistant", "é𝄞", "a"]
text = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)
turn = st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|im_end|>", ""]), text)


@settings(max_examples=300, deadline=None)
@given(st.lists(turn, min_size=1, max_size=6))
def test_round_trip(turns):
    made = C.format_batch(pa.array([1] * len(turns), pa.int64()), pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    formatted = made["formatted"][0].as_py()
    assert C.turns_of(formatted) == turns
    loss = [C.unescaped(formatted[s["start"]:s["end"]]) for s in made["loss"][0].as_py()]
    assert loss == [t for r, t in turns if r == "assistant"]


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user"), (1, 2, None, None), (2, 1, "assistant", None), (2, 0, "system", ""),
    (None, 0, "user", "x"), (3, 0, "user", "same"), (3, 0, "user", "same"), (3, None, "assistant", "first"), (5, 0, "assistant", "long é " * 50_000),
]


def plain(rows):
    out = []
    key = lambda r: (r[0] is not None, r[0] or 0)
    for _, turns in groupby(sorted(rows, key=lambda r: (*key(r), r[1] is not None, r[1] or 0)), key=key):
        turns = [(i, r or "", t or "") for i, _, r, t in turns]
        loss = "".join(t for _, r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        out.append((turns[0][0], len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def test_edges(corpus):
    rows = corpus.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS formatted", "3 AS tie")
    got = [tuple(r)[:5] for r in C.digests(C.format_conversations(rows)).collect()]
    assert sorted(got, key=str) == sorted(plain(ROWS), key=str)
    assert C.digests(C.format_conversations(rows.limit(0))).count() == 0


def test_one_conversation_over_many_tasks(corpus):
    rows = corpus.range(3000).selectExpr("7L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id) AS text")
    parts = C.format_conversations(rows)
    assert parts.count() > 4
    want = plain([(7, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(3000)])
    assert [tuple(r)[:5] for r in C.digests(parts).collect()] == want


def test_query(corpus):
    sf = "/root/testdata/sf0.001"
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [tuple(r) for r in corpus.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r)[:5] for r in QUERIES["op4_chat"](corpus, sf).collect()]
    assert sorted(got) == sorted(plain([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]))
