"""Preparing a corpus: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again for the next.  All but the last return the columns of
``documents``, whatever these are called, and rows as they were.

Rows are judged by their texts, so rows with equal texts share their fate in the
first, second and fourth stage, with or without a doc_id.  Null and empty texts: the
classifier scores an empty document; language identification rejects texts without a
letter, null among them; near-duplicates never link blank texts; they leak nothing and
encode to nothing.  Very long texts are read whole, slice by slice.  Repeated rows and
repeated doc_ids: one row of each group of near-duplicates stays, the one with the
smallest doc_id, null last (ties: see ``lodestone.llm.chosenpath``).  An empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.bytecnn import keep_good
from lodestone.llm.centroids import keep_known
from lodestone.llm.chosenpath import keep_one_each
from lodestone.llm.common import Workspace, read_table
from lodestone.llm.tiling import keep_unseen
from lodestone.llm.transducer import digests


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(spark, docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("language_id", keep_known),
    ("near_dedup", keep_one_each),
    ("decontamination", keep_unseen),
    ("bpe", encode),
]

#: No stage of these can be written in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.table(docs, name)
            if k:
                work.drop(STAGES[k - 1][0])
    return docs
