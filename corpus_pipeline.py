"""A corpus pipeline: language, near duplicates, benchmark passages, source mix, shards.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is written as Parquet in
the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowweave.llm import common
from rowweave.llm.decontaminate import stage_decontamination
from rowweave.llm.forest import stage_near_duplicates
from rowweave.llm.langid import stage_language
from rowweave.llm.mixing import stage_mixing
from rowweave.llm.shards import stage_sharding

STAGES = [
    ("language", stage_language),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontamination),
    ("mixing", stage_mixing),
    ("sharding", stage_sharding),
]

#: SQL can't express the trained language model; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
