"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of training texts. A text is encoded with every language's dictionary and
takes the language of the fewest bytes. It is encoded in blocks, each against the dictionary alone, so every part of the text counts
alike, and every block is set in a neutral carrier, because a few bytes alone would be stored raw whatever the dictionary. All texts, short
or long, meet the same dictionaries at the same level. The call is rejected when the runner-up is within `margin` of the winner.

Training reads `sample` windows of `window` code points per language at most, taken by hash over all labelled rows; each dictionary is
thus bounded whatever the table. Null and letterless texts are `und` with score 0, as is everything when no language was learned; with
one language every text with a letter has it, with score 1. Ties go to the language that sorts first, and are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import tidy

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    sample: int = 256  # windows of a language's dictionary
    window: int = 2000  # code points of a window
    block: int = 16384  # bytes encoded at once
    level: int = 12
    margin: float = 0.005  # share of the runner-up's bytes by which the winner must be smaller
    temperature: float = 6.0  # bytes by which a language must be smaller to be e times as likely


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    contents: tuple[bytes, ...]  # the dictionary of each
    settings: Settings = Settings()


CARRIER = b"0123456789 " * 8
_OTHER = regex.compile(r"[^\p{L}\p{M}'’]+")


def prepared(text: str) -> bytes:
    """Lower-case words of letters, combining marks and apostrophes with single blanks: digits and signs tell no language, and would keep words from matching."""
    return f" {_OTHER.sub(' ', text.lower())} ".encode()


def fit(docs: DataFrame, train: Column, lang: str = "lang", text: str = "text", key: str = "doc_id", settings: Settings = Settings()) -> Model:
    """Dictionaries from rows where `train` holds: of each language one window per hash bucket, from a place the hash names."""
    h = F.xxhash64(F.col(key).cast("string"), F.lit("dictionary"))
    room = F.greatest(F.length(text) - settings.window, F.lit(0)) + 1
    part = F.substring(F.col(text), (F.pmod(h, room) + 1).cast("int"), F.lit(settings.window))
    rows = docs.where(train & F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), h.alias("h"), part.alias("part"))
    kept = rows.groupBy("lang", F.pmod("h", F.lit(settings.sample)).alias("bucket")).agg(F.min_by("part", F.struct("h", "part")).alias("part")).collect()
    contents = {}
    for r in sorted(kept, key=lambda r: (r["lang"], r["bucket"])):
        contents.setdefault(r["lang"], []).append(prepared(r["part"]))
    names = tuple(sorted(contents))
    return Model(names, tuple(b"\n".join(contents[x]) for x in names), settings)


@lru_cache(maxsize=1)
def encoders(model: Model) -> list[zstandard.ZstdCompressor]:
    def one(content: bytes) -> zstandard.ZstdCompressor:
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=model.settings.level)
        return zstandard.ZstdCompressor(dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)

    return [one(c) for c in model.contents]


def sizes(text: str, model: Model) -> np.ndarray:
    """Bytes of the whole text under each language's dictionary."""
    data, step = prepared(text), model.settings.block
    blocks = [CARRIER + data[i:i + step] for i in range(0, len(data), step)]
    return np.array([sum(len(e.compress(b)) for b in blocks) for e in encoders(model)])


def classify(text: str | None, model: Model) -> tuple[str, float, float, bool]:
    """Language, score, margin (share of the runner-up's bytes) and whether the call is rejected."""
    if not text or not model.languages or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, 0.0, True
    if len(model.languages) == 1:
        return model.languages[0], 1.0, 1.0, False
    found = sizes(text, model)
    best, second = np.sort(found)[:2]
    margin = float(second - best) / float(second)
    score = 1.0 / float(np.exp(-(found - best) / model.settings.temperature).sum())
    return model.languages[int(found.argmin())], score, margin, margin < model.settings.margin


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row as `row`, with lang_pred, score, margin and rejected beside it."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few dictionaries of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [classify(t, held.value) for t in batch.column("text").to_pylist()]
            pred, score, margin, rejected = zip(*said) if said else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["row", "lang_pred", "score", "margin", "rejected"],
            )

    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[text].alias("text"))
    return rows.mapInArrow(tidy(run, encoders), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, margin double, rejected boolean")
