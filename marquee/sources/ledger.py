"""Epoch ledger: tables that a stream appends to, each epoch at most once.

``foreachBatch`` may run an epoch again after a failure, also one that was
already written. So an epoch's rows go to a folder of their own (a second run
overwrites what a broken one left), then a commit record is written; an epoch
with a record is not written again, and readers see the rows of recorded
epochs only. Epochs are counted per writer: a stream that begins anew with
another checkpoint takes another writer name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT_SCHEMA = "writer string, epoch long, n_rows long"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMIT_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{path}/commits")


def create_ledger(spark: SparkSession, path: str, schema) -> None:
    """An empty table at ``path``; nothing happens to one that is there."""
    for part, kind in (("commits", COMMIT_SCHEMA), ("data", schema)):
        empty = spark.createDataFrame([], kind)
        if part == "data":
            empty = empty.withColumn("writer", F.lit("")).withColumn("epoch", F.lit(-1).cast("long"))
        empty.coalesce(1).write.mode("overwrite").parquet(f"{path}/{part}/none")


def commit_epoch(rows: DataFrame, path: str, epoch: int, writer: str = "main") -> bool:
    """Write one epoch; False (and nothing done) if it is recorded already."""
    spark = rows.sparkSession
    if not _commits(spark, path).where((F.col("writer") == writer) & (F.col("epoch") == epoch)).isEmpty():
        return False
    out = f"{path}/data/{writer}-{epoch}"
    rows.withColumn("writer", F.lit(writer)).withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(out)
    n = spark.read.parquet(out).count()
    spark.createDataFrame([(writer, epoch, n)], COMMIT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/commits/{writer}-{epoch}")
    return True


def epoch_writer(path: str, rows_of: Callable[[DataFrame], DataFrame] | None = None,
                 writer: str = "main") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over :func:`commit_epoch`."""
    def write(batch: DataFrame, epoch: int) -> None:
        commit_epoch(rows_of(batch) if rows_of else batch, path, epoch, writer)
    return write


def read_ledger(spark: SparkSession, path: str, schema, keep_epoch: bool = False) -> DataFrame:
    """The rows of recorded epochs. The records are one short row an epoch."""
    from pyspark.sql.types import LongType, StringType, StructType
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = StructType([*kinds.fields]).add("writer", StringType()).add("epoch", LongType())
    data = spark.read.schema(kinds).option("recursiveFileLookup", "true").parquet(f"{path}/data")
    done = _commits(spark, path)
    out = data.join(done.select("writer", "epoch").distinct(), ["writer", "epoch"], "left_semi")
    return out if keep_epoch else out.drop("writer", "epoch")
