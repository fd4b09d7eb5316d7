"""Corpus pipeline: stages that each take all documents their predecessor kept.

Every stage but the last returns the columns of documents. Null texts have no words: the quality stage rejects them.
An empty table passes through every stage. Extra columns of the documents are carried along whatever their names: a
stage takes other names inside where a document's column has one of its own. Rows that share an id, or have none, are
decided each by its own text. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontam, jaccard_join, mixing, pii, quality_model, repeats


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """(docs with a row key, its name, whether rows may share it): rows do only if both id and text are equal."""
    row = common.fresh(docs, "__row")
    keyed, ids = common.row_keys(docs, "doc_id", "text", row)
    return keyed, row, ids is not None


def _without(keyed: DataFrame, row: str, gone: DataFrame, label: str) -> DataFrame:
    """The rows of keyed documents whose key is not in gone (row), without the key."""
    return keyed.join(repeats.side(common.materialize(gone.distinct(), label)), row, "left_anti").drop(row)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; each is judged by its own text."""
    keyed, row, _ = _keyed(docs)
    judged = quality_model.classify(keyed, common.table(spark, sf_dir, "labels"), carry=row)
    return _without(keyed, row, judged.where("not kept").select(row), "rejected")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; of rows that repeat, one.

    Near duplicates share 80 % or more of their five-word shingles. Rows repeat if id and text are equal.
    """
    keyed, row, shared = _keyed(docs)
    found = jaccard_join.jaccard_join(keyed, id_col=row, ngram=5, percent=80, count=False)
    once = keyed.dropDuplicates([row]) if shared else keyed
    return _without(once, row, found.where("doc_id <> component_id").select(F.col("doc_id").alias(row)), "later")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage: any item's window makes a document go."""
    keyed, row, _ = _keyed(docs)
    found = decontam.decontaminate(keyed, common.table(spark, sf_dir, "benchmark"), id_col=row, min_items=1)
    return _without(keyed, row, found.where("contaminated").select(F.col("doc_id").alias(row)), "contaminated")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return pii.redact_column(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once per copy that the mix takes, with the copy's number."""
    return mixing.mix(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", keep_distinct), ("decontamination", drop_contaminated), ("pii", redact), ("mix", mix)]

#: The first, second and fourth stage learn or iterate, which SQL can't express; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages. What a stage wrote on its way goes when its result is written, and that when the
    next one's is."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.scratch(spark) as keep:
            new = keep(common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        common.discard(docs)
        docs = new
    return docs
