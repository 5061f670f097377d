"""From raw documents to packed training sequences in five stages, each over all that the one before kept.

Every stage takes the columns of documents and any others; others are carried along untouched, whatever their names, and the results an operator
adds are not. An empty table gives an empty result. Repeated rows are rows of their own, except that near_dedup keeps one of a group.
ORACLE_SQL is None: fingerprints, tokenization and packing have no SQL form; tests compare every stage with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from throngcast.llm import decontaminate, host_rules, packing, similar, site_lines
from throngcast.llm.common import written
from throngcast.llm.queries import tokenizer_files
from throngcast.session import prepare

USED = ("doc_id", "source", "text")


def _kept(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the operator leaves of docs, in their own columns; columns it does not use are out of its sight."""
    used, others = [c for c in docs.columns if c in USED], [c for c in docs.columns if c not in USED]
    if not others:
        return operator(docs).select(*docs.columns)
    left = operator(docs.select(*used, F.struct(*others).alias("_others")))
    return left.select(*[F.col(c) if c in used else F.col("_others").getField(c).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose source is not rejected. NULL, empty and blank texts have no words and fail; documents
    without a source (NULL) are judged by the text alone."""
    prepare(spark)
    return _kept(docs, lambda d: host_rules.judge(d, description="text", map_id="source").where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share; n_chars follows the text. No document is dropped: NULL and empty texts stay as they are,
    and a document that loses all its lines has an empty text. NULL sources do not count as sources."""
    prepare(spark)
    left = _kept(docs, lambda d: site_lines.remove_spread_lines(d, description="text", map_id="source"))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) the document with the smallest doc_id: pairs from op6's
    index over SimHash fingerprints, checked by whole sets, and the pairs it cannot see by an exact join.

    NULL, empty and blank texts are one group. Of rows that share the smallest id one stays; NULL ids are never the smallest."""
    prepare(spark)
    return _kept(docs, lambda d: similar.one_of_near_copies(d, description="text", incident_id="doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. NULL, empty and blank texts hold none and stay; items without words match nothing."""
    prepare(spark)
    return _kept(docs, lambda d: decontaminate.clean_only(d, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), description="text"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every document's tokens.

    A NULL or empty text is one piece with the end id alone; repeated rows and NULL ids give pieces of their own; other columns are left out."""
    prepare(spark)
    pieces = packing.tokenized_pieces(docs, *tokenizer_files(), description="text", incident_id="doc_id", keep_ids=False)
    return packing.pack(pieces).withColumnRenamed("incident_id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sequence_packing", sequence_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage returns is written and read again by the next."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
