"""From raw documents to packed training sequences: quality rules, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Rows with null
or empty texts fail the quality rules; other cases are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymart.llm.common import forget, settled, table, written
from tallymart.llm.packing import best_fit_pack
from tallymart.llm.pii import redact
from tallymart.llm.quality import keep_good
from tallymart.llm.simhash import keep_first
from tallymart.llm.toxicity import keep_clean, train


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, with null, empty and short texts; repeated rows are judged alike, no rows give none."""
    return keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or above the threshold go; the model learns from the labelled ones of those that came here.

    An empty text has the score of a text without cues; repeated rows stay or go together; where no row at all is labelled every score is 0.5, and all go; no rows give none.
    """
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; documents without one all stay.

    Documents are linked whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Candidates are texts whose fingerprints differ in at most
    four bits, found by the bit-sliced comparison, then those that share a band of MinHashes and aren't connected by then, because pairs of that similarity may differ in ten bits and
    more; each link is decided on the whole sets.
    """
    return keep_first(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows. Null and empty texts stay as they are, repeated rows stay repeated, no rows give none."""
    return redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in a sequence. A null or empty text is one piece of the end token; repeated rows are packed each; no rows give none."""
    return best_fit_pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    What a stage wrote on its way, and its predecessor's table, are deleted as soon as its own is there; the packed rows alone are left.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = settled(spark, lambda: written(stage(spark, docs, sf_dir), name))  # noqa: B023  called at once
        if last is not None:
            forget(last)
        last = docs
    return docs


#: The toxicity model and the fingerprints' links can't be expressed in SQL.
ORACLE_SQL = None
