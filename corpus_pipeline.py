"""The corpus pipeline: documents through five stages, each on what the one before kept.

language    documents whose language the classifier rejects go (no letter, or too narrow a margin)
exact       of equal texts the row with the smallest id stays
near        of each component of near-duplicates (five-word shingles, 0.8) the document with the smallest id stays
mix         documents stay as often as the mix of domains, languages and sources selects them
encode      tokens of each text, and the text they decode to, as digests
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import bpe, exact, langid, mixing, near
from tidepanel.llm.common import prepare, remainder, table, written
from tidepanel.llm.queries import WORD_BPE, bpe_digests, mix_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a sufficient margin; rows with remainder 2 are kept from training."""
    prepare(spark)
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return langid.identify(docs, langid.fit(docs, ~held_out)).where("not rejected").select("row.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return exact.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near.keep_one(docs, near.Settings(words=5), from_files=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as it is selected; a document of two epochs is two rows."""
    prepare(spark)
    return mixing.mixed(mix_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe_digests(bpe.decode(bpe.encode(docs.select("doc_id", "text"), WORD_BPE), WORD_BPE))


STAGES = [("language", language), ("exact", exact_duplicates), ("near", near_duplicates), ("mix", mix), ("encode", encode)]

# Compression and byte-pair merges are not expressible in SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents; every stage but the last is written and read back."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
