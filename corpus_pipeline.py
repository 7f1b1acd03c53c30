"""A corpus pipeline: toxicity filter, exact dedup, near dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written
as Parquet into the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

import uuid

from tidewatch.llm import common, decontaminate, exact, mixing, simhash, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("source_mixing", mixing.stage),
]

#: The toxicity stage is a trained model and near dedup a graph closure; SQL has neither.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``. A stage's table is deleted when the next one's is written; the last is read by the result.

    Each stage defines its results for odd rows (see its module): null texts are empty ones,
    and of equal empty ones one stays; null ids and sources are carried along; an empty table
    gives none; columns may have any names, but for the two that mixing adds.
    """
    folder = f"{common.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, written = common.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if written is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(written)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        written = path
    return STAGES[-1][1](spark, docs, sf_dir)
