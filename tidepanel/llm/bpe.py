"""Byte-pair encoding and decoding of a public word vocabulary, by contiguous rank arrays.

A word is a row of parts with the rank of every adjacent pair beside them. The least rank (the leftmost of equals) is found by a scan, its
right boundary is deleted, and the ranks on both sides of the new part are looked up again, until no pair is in the merge table. Short
words of a batch take these steps together, as rows of one array; long ones keep a heap of ranks over linked parts, so that a word of any
length costs no more than n log n. Words seen before are taken from a bounded store per worker.

The tokenizer file is read where it lies, on each worker. Null and empty texts have no tokens and decode to the empty text. Special tokens
inside a text are recognised before it is normalised, as the vocabulary's own library does.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from tidepanel.llm.common import spread, texts, tidy

#: Longest word in parts that takes the array path, words encoded at once, words kept by a worker, code points split into words at once.
SHORT, AT_ONCE, KEPT, SLICE = 32, 4096, 100_000, 1 << 19
NONE = np.int64(1) << 40
# Code points for which engines may differ: beyond Latin, Greek and Cyrillic, the separators 1C to 1F, and the sigma, lowered by context.
_FAR = re.compile(r"[^\x00-\x1b\x20-\u03a2\u03a4-\u052f\u2010-\u2027]")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself if printable, else the next free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    return letters | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}


class Vocabulary:
    """The merge table as sorted pair keys, and the words encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, split = told["model"], told["pre_tokenizer"]["pretokenizers"][0]
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.special_split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(_blanks(told)), " "), normalizers.Lowercase()])
        self.splitter = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        letters = byte_letters()
        self.inner = np.array([ids[letters[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([ids[letters[b] + suffix] for b in range(256)], dtype=np.int64)
        self.width = 1 << 20  # more than any id
        pairs = model["merges"]
        keys = np.array([ids[a] * self.width + ids[b] for a, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made  # made is by rank
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        self.forget()

    def forget(self) -> None:
        """Start the store anew: the number of each word, and where its ids are in one flat array."""
        self.number = {"\n" + content: k for k, content in enumerate(self.special)}
        self.flat = np.array(list(self.special.values()), dtype=np.int32)
        self.start, self.size = np.arange(len(self.flat)), np.ones(len(self.flat), np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it is not in the table or a side is missing (-1)."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def short_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Merge many short words at once, each a row of part ids and a row of adjacent ranks."""
        size = np.array([len(w) for w in words])
        rows, wide = len(words), int(size.max())
        parts = np.full((rows, wide + 1), -1, dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        row = np.repeat(np.arange(rows), size)
        col = spread(np.zeros(rows, np.int64), size)
        parts[row, col] = np.where(col == size[row] - 1, self.last[data], self.inner[data])
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        live = np.arange(rows)
        while len(live):
            at = ranks[live].argmin(axis=1)
            least = ranks[live, at]
            live, at, least = live[least < NONE], at[least < NONE], least[least < NONE]
            if not len(live):
                break
            # Delete the boundary after `at`: what lies right of it moves one place to the left.
            moved = np.arange(wide)[None, :] > at[:, None]
            source = np.arange(wide)[None, :] + moved
            parts[live, :wide] = np.take_along_axis(parts[live], source, axis=1)
            parts[live, wide] = -1
            parts[live, at] = self.made[least]
            shifted = np.take_along_axis(ranks[live], np.minimum(source, wide - 1), axis=1)
            shifted[:, -1] = NONE
            ranks[live] = shifted
            ranks[live, at] = self.rank(parts[live, at], parts[live, at + 1])
            left = at > 0
            ranks[live[left], at[left] - 1] = self.rank(parts[live[left], at[left] - 1], parts[live[left], at[left]])
        return [p[p >= 0].astype(np.int32) for p in parts]

    def long_word(self, word: bytes) -> np.ndarray:
        """The same merges over linked parts, the least rank taken from a heap."""
        ids = [*self.inner[list(word[:-1])].tolist(), int(self.last[word[-1]])]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: self.rank_of.get(ids[i] * self.width + ids[after[i]]) if after[i] < n else None
        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue  # one of the two has been merged since
            gone = after[i]
            ids[i], ids[gone] = int(self.made[r]), -1
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0 and (r := rank(j)) is not None:
                    heapq.heappush(heap, (r, j))
        return np.array([i for i in ids if i >= 0], dtype=np.int32)

    def learn(self, words: set[str]) -> None:
        """Encode the words not yet in the store, those of like length together."""
        new = sorted(((w.encode(), w) for w in words if w not in self.number), key=lambda x: len(x[0]))
        if not new:
            return
        short = sum(len(b) <= SHORT for b, _ in new)
        made = [ids for i in range(0, short, AT_ONCE) for ids in self.short_words([b for b, _ in new[i:min(i + AT_ONCE, short)]])]
        made += [self.long_word(b) for b, _ in new[short:]]
        sizes = np.array(list(map(len, made)))
        self.number.update((w, len(self.start) + k) for k, (_, w) in enumerate(new))
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(sizes) - sizes]
        self.size, self.flat = np.r_[self.size, sizes], np.concatenate([self.flat, *made])

    def words(self, text: str) -> list[str]:
        """The words of a text as the encoder sees them; a special token stands as itself, marked by a line break no word holds."""
        if not self.special_split.search(text):
            return self.split(text) if text else []
        out, at = [], 0
        for m in self.special_split.finditer(text):
            out += self.split(text[at:m.start()])
            out.append("\n" + m[0])
            at = m.end()
        return out + self.split(text[at:])

    def split(self, text: str) -> list[str]:
        """Words by the vocabulary's pattern. Blanks need no folding, since no word holds one. Where engines or Unicode versions
        may differ, the library's own normaliser and splitter decide."""
        if _FAR.search(text):
            return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return self.pattern.findall(unicodedata.normalize("NFC", text).lower())

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has; texts are taken by slices, to hold few words at a time."""
        ids, counts, i = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
        while i < len(batch):
            j, room = i + 1, SLICE - len(batch[i])
            while j < len(batch) and len(batch[j]) <= room:
                room -= len(batch[j])
                j += 1
            split = [self.words(t) for t in batch[i:j]]
            if len(self.number) > KEPT:
                self.forget()
            self.learn(set().union(*split))
            found = np.fromiter((self.number[w] for words in split for w in words), dtype=np.int64)
            sizes = self.size[found]
            ids.append(self.flat[spread(self.start[found], sizes)])
            counts.append(np.diff(np.r_[0, np.cumsum(sizes)][np.cumsum([0, *map(len, split)])]))
            i = j
        return np.concatenate(ids), np.concatenate(counts)


def _blanks(told: dict) -> str:
    return next(n["pattern"]["Regex"] for n in told["normalizer"]["normalizers"] if n["type"] == "Replace")


@lru_cache(maxsize=2)
def token_strings(path: str) -> list[str]:
    """The string of each id, special ones included."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    named = told["model"]["vocab"] | {t["content"]: t["id"] for t in told["added_tokens"]}
    strings = [""] * (max(named.values()) + 1)
    for token, i in named.items():
        strings[i] = token
    return strings


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every row as `row`, with `ids`, the tokens of its text."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = vocabulary(path).encode(texts(batch))
            column = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), column], names=["row", "ids"])

    return rows.mapInArrow(tidy(run, vocabulary), f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Each encoded row with `decoded`: the vocabulary has no decoder of its own, so tokens are joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(token_strings(path), pa.string())
        for batch in batches:
            ids = batch.column("ids")
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), tokens.take(ids.flatten()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), ids, pc.binary_join(lists, " ")], names=["row", "ids", "decoded"])

    return encoded.select("row", "ids").mapInArrow(tidy(run, token_strings), f"row {encoded.schema['row'].dataType.simpleString()}, ids array<int>, decoded string")

