"""A corpus pipeline of five operators: quality, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of documents, whatever others there
are. Nulls, empty and very long texts, repeated rows and empty tables have the results that the operators define; null and empty texts are scored by the
classifier's bias, and are near-duplicates of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.llm import linededup, mixing, packing, quality, simhash
from cellframe.llm.common import WORD, crc32_of, documents, row_back, whole_row, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from labelled rows of docs that are not held out."""
    weights = quality.fit(docs.filter(crc32_of("doc_id") % 4 != 2), documents(spark, sf_dir, "labels"))
    scored = quality.score(docs.select(whole_row(docs), "text"), weights)
    return scored.filter(F.col("score") >= quality.THRESHOLD).select(*row_back(docs.columns))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; n_chars follows the text. A document of which nothing is left goes."""
    out = linededup.dedup_lines(docs.select(whole_row(docs), "doc_id", "text"), counts=True)
    changed = F.col("n_deleted") > 0
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))
    return out.filter(~changed | F.regexp_like("text", F.lit(WORD))).select(*row_back(docs.columns, text=F.col("text"), n_chars=n_chars))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity of 0.8 or more) stays, the one with the smallest id."""
    return simhash.representatives(docs, shingle=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_texts(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("near-dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
