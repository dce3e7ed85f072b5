"""Chat formatting by columnar byte assembly.

A turn becomes `<|im_start|>role`, a line break, the text, `<|im_end|>` and a line break. Control strings inside texts and roles get a
backslash after the `<`, and one more if they already have some, so reading the output back gives the input.

Turns are dealt by ranges of (conversation, turn), so a conversation of any length spreads over tasks; a task lays out the turns of a
batch by segment lengths, running offsets and scatter indices, and copies all bytes into one buffer that Arrow then cuts into parts. A part
holds consecutive turns of one conversation, with the spans of the loss mask in code points. Parts are ordered by (conv_id, part).

Null roles and texts are empty, turns with equal number are ordered by role and text, null turns come first and a null conv_id is a
conversation of its own. Repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import spread

START, END = "<|im_start|>", "<|im_end|>"
BREAK = "<|nl|>"  # a line break inside a role
LEARNED = "assistant"
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escaped(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, pattern=r"<(\\*)\|", replacement=r"<\\\1|")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a string column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + column.offset + 1)[column.offset:]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data and data.size else np.empty(0, np.uint8), offsets[:-1], np.diff(offsets)


def assemble(columns: list[pa.Array | str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows of the columns side by side in one buffer (a plain string repeats in every row), and where each row starts."""
    parts = []
    for c in columns:
        if isinstance(c, str):
            raw = np.frombuffer(c.encode(), dtype=np.uint8)
            parts.append((raw, np.zeros(n, np.int64), np.full(n, len(raw), np.int64)))
        else:
            parts.append(_bytes(c))
    lengths = np.stack([p[2] for p in parts], axis=1)  # rows x segments, in output order
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(lengths.shape)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k, (raw, source, size) in enumerate(parts):
        out[spread(starts[:, k], size)] = raw[spread(source, size)]
    return out, np.append(starts[:, 0], len(out))


def format_batch(conv: pa.Array, role: pa.Array, text: pa.Array) -> dict[str, pa.Array]:
    """Consecutive turns as parts: one for each run of rows of a conversation."""
    n = len(conv)
    role, text = (pc.fill_null(c, "").cast(pa.large_string()) for c in (role, text))
    head = pc.replace_substring(escaped(role), pattern="\n", replacement=BREAK)
    body = escaped(text)
    data, at = assemble([START, head, "\n", body, END + "\n"], n)
    ids = conv.fill_null(0).to_numpy(zero_copy_only=False)
    null = pc.is_null(conv).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])])
    turns = np.diff(np.r_[first, n])
    offsets = at[np.r_[first, n]]
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
    # The mask in code points: where a learned text starts within its part, and its length.
    chars = lambda c: pc.utf8_length(c).to_numpy(zero_copy_only=False).astype(np.int64)
    before, size = chars(head) + len(START) + 1, chars(body)
    begin = np.cumsum(before + size + len(END) + 1) - (size + len(END) + 1)
    row_part = np.repeat(np.arange(len(first)), turns)
    base = (begin - before)[first][row_part]
    learned = pc.equal(role, LEARNED).to_numpy(zero_copy_only=False)
    spans = pa.StructArray.from_arrays([pa.array((begin - base)[learned]), pa.array((begin - base + size)[learned])], names=["start", "end"])
    counts = np.bincount(row_part[learned], minlength=len(first))
    mask = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), spans)
    return {"conv_id": conv.take(pa.array(first)), "formatted": formatted.cast(pa.string()), "loss": mask, "n_turns": pa.array(turns.astype(np.int64))}


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, part, formatted, loss (spans in code points), n_turns; the parts of a conversation joined in order are its text."""
    tie = F.xxhash64("role", "text")
    keys = ["conv_id", "turn", "role", "tie"]
    thin = rows.select("conv_id", "turn", "role", "text", tie.alias("tie"))
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = thin.repartitionByRange(count, *keys).sortWithinPartitions(*keys, "text").withColumn("task", F.spark_partition_id().cast("long"))
    conv_type = thin.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            made = format_batch(batch.column("conv_id"), batch.column("role"), batch.column("text"))
            k = len(made["conv_id"])
            part = (batch.column("task")[0].as_py() << 33) + seen + np.arange(k)
            seen += k
            yield pa.RecordBatch.from_arrays([made["conv_id"], pa.array(part), made["formatted"], made["loss"], made["n_turns"]],
                                             names=["conv_id", "part", "formatted", "loss", "n_turns"])

    return dealt.mapInArrow(run, f"conv_id {conv_type}, part long, formatted string, loss array<struct<start:bigint,end:bigint>>, n_turns long")


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from formatted turns."""
    return [(unescaped(r.replace(BREAK, "\n")), unescaped(t)) for r, t in TURN.findall(formatted)]


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation, read back from the parts: turns and their digest, learned text and its digest, length of the output.

    Digests run over a conversation in order, so its parts stream through one task; only the running state is held.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, state = None, None
        for batch in batches:
            ids, formatted, loss = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))
            done = []
            for i, text, spans in zip(ids, formatted, loss):
                if state is None or i != open_id:
                    if state is not None:
                        done.append((open_id, *state))
                    open_id, state = i, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns_of(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    learned = unescaped(text[s["start"]:s["end"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            yield told(done)
        yield told([(open_id, *state)] if state else [])

    def told(done: list) -> pa.RecordBatch:
        columns = list(zip(*((i, n, a.hexdigest(), c, b.hexdigest(), f) for i, n, a, c, b, f in done))) or [()] * 6
        kinds = [arrow_id, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    arrow_id = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
