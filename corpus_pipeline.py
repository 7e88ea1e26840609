"""The training-data pipeline: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of docs. A null text or id, repeated rows and an empty table
pass through each stage as its own docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from finlake.llm import decontamination, mixing, pii, simhash_dedup, toxicity
from finlake.llm.common import purge, read, stash, stashed

STAGES = [
    ("toxicity", toxicity.stage),
    ("simhash_dedup", simhash_dedup.stage),
    ("decontamination", decontamination.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
]

#: The first stage is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; each result is written and read again, and what
    the stages before have left in the shared folder is deleted then."""
    docs, began = read(spark, sf_dir, "documents"), stashed()
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stash(docs)
            purge(spark, began, last=1)
    return docs
