"""From raw documents to token ids: language, exact copies, near copies, benchmark leaks, encoding.

Each stage gets what its predecessor kept and returns the columns of ``documents``; the last returns tokens. A stage's
own columns never meet those of the documents, so extra columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, exact, language, near
from plumbline.llm.common import discard, packed, stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language: those labelled ``und`` (no text, or not a letter in it) go.

    The labels are learned from the rows that have a language; if there are none, a letter is all that is asked for.
    """
    model = language.fit(docs)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return language.identify(packed(docs, "text"), model).filter("lang_pred != 'und'").select("doc.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text; the smallest id stays."""
    return exact.one_of_each_text(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 or more connect; the smallest id stays."""
    return near.one_of_each_group(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exactly or within a tenth of its length in edits."""
    found = decontaminate.find_leaks(packed(docs, "text"), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select("doc.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids (little-endian unsigned 32-bit), their number, and digests of ids and of the text decoded from them."""
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "text"), drop=("text",)))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language id", known_language),
    ("exact dedup", exact_copies),
    ("n-gram jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level bpe", token_ids),
]

#: Similarity groups, edit distances under LSH and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out = stored(out)
        if k:
            discard(docs)  # what the stage before has written
        docs = out
