"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage works on all rows its predecessor kept. All but the last return the columns of ``documents``, further columns
and ones of clashing names included. Every stage keeps rows with null or empty texts unless its own decision says
otherwise, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from dispersa.llm import bpe, decontam, nbsvm, secret_scan, simhash
from dispersa.llm.common import Scratch, read_table
from dispersa.llm.langid import held_out
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from labels outside the held-out fold.

    A null text is judged as an empty one, repeated rows alike; without labels every row stays.
    """
    labels = read_table(spark, sf_dir, "labels").filter(~held_out(5, 0)).select("doc_id", "quality")
    model = nbsvm.learn(docs, labels)
    return nbsvm.score(docs, model).filter("predicted = 1").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of near duplicates, and one row of each doc_id, that of the
    least text (null least), then of the least other columns.

    Null and empty texts are near duplicates of each other. Rows without a doc_id cannot be named and stay.
    """
    gone = simhash.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.groupBy("doc_id").count().filter("doc_id IS NOT NULL AND count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    rest = [c for c in docs.columns if c != "doc_id"]
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in rest if c != "text"])).alias("row")).select("doc_id", "row.*").select(*docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item.

    Null and empty texts stay, repeated rows are treated alike; an empty benchmark drops nothing.
    """
    return decontam.mark_contamination(docs, read_table(spark, sf_dir, "benchmark")).filter("NOT contaminated").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of every secret, encoded ones included; other texts, null and empty ones too, stay as they are.

    ``n_chars`` is that of the new text, null for a null one. Runs that could not be unwrapped whole go as well.
    """
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, token_ids)`` of every row; a null or empty text has none, repeated rows have theirs again."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN).select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("byte-level BPE encoding and decoding", encode),
]

#: The classifier, the fingerprints and the encoding have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(before)
    return docs
