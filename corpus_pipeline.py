"""Raw documents to packed training sequences, in stages that each call one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofline.llm.common import load, written
from proofline.llm.languages import language_stage
from proofline.llm.mixing import mixing_stage
from proofline.llm.packing import packing_stage
from proofline.llm.simhash import near_duplicate_stage
from proofline.llm.toxicity import toxicity_stage

#: (name, function of (spark, docs, sf_dir)); each works on all that the one before has kept.
STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has no classifiers, fingerprints or tokenizers; tests/llm compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each result is written to the shared folder and read back."""
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
