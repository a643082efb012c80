"""The corpus pipeline: documents in, token files out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's docs. Stages keep the
columns of ``documents``; the last returns what the token files say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marquee.llm import decontaminate, mixing, near_dedup, token_files, toxicity
from marquee.llm.common import scratch_table, stored, table

#: No SQL: the toxicity scores and the token ids cannot be expressed in it.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five words, 0.8)."""
    return near_dedup.drop_near_duplicates(docs, words=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row per copy that the mix takes."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back."""
    out = scratch_table(spark, "pipeline-tokens")
    token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), out)
    return token_files.read_token_files(spark, out)


STAGES = [("toxicity", reject_toxic), ("near_dedup", near_dedup_stage),
          ("decontamination", decontaminate_stage), ("mixing", mix_sources),
          ("token_output", token_output)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to
    the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", 16)
    return STAGES[-1][1](spark, docs, sf_dir)
