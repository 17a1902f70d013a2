"""A training corpus from raw documents: good, distinct, uncontaminated, without secrets, and packed.

Each stage takes all that the one before kept. The first four return the columns of documents, the last the packed pieces.
In every stage: null and empty texts are rows as any other (no words, no secrets, one end id); null doc_ids are kept as they
are; columns besides doc_id and text pass through untouched, null or not (secret_scans writes n_chars); very long texts are
read whole; an empty table gives an empty one. What a stage does with ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import op03_packing, op05_simhash, op06_secrets, op08_quality, op10_decontaminate
from lodestone.llm.common import discard, saved, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Repeated rows go or stay together; a score at the threshold stays.
    Without any labelled row nothing can be rejected: all stay, with a warning."""
    return op08_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id (null: the last). Of rows with that
    id the one whose text's hash is least stays, of rows with equal id and text any one. Texts without words are near copies
    of one another."""
    return op05_simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, repeated rows together. An empty benchmark removes nothing."""
    return op10_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by the name of their kind; n_chars follows where a text changed. Of overlapping spans the
    first one's kind is named, of those with one start the base kind listed first. No row goes."""
    return op06_secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids: a row for each piece of a document. Repeated rows are packed as often as they occur;
    documents follow one another as the files of the stage before hold them."""
    return op03_packing.pack(docs)


STAGES = [(f.__name__, f) for f in (quality_classifier, simhash_near_dedup, benchmark_decontamination, secret_scans, packing)]

#: Classifiers, tokenizers and XXH64 fingerprints are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
