"""The catalogue as a versioned store: movies, people and cast of one import
round, its change feed, and the sequences of the surrogate ids.

A round writes its tables into a version folder that nobody reads yet; the last
thing it writes is the version's record, which is the pointer: readers take the
highest recorded version, so they see all of a round or nothing. The record
keeps the largest ids ever given, so a deleted title's id is not given again,
and the cast follows the change feed: what a title loses by its deletion or
replacement goes in the same round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.catalog import build_bridge, build_people
from marquee.sources.snapshot import DELETE, current_rows, replace_children, sync_snapshot

VERSION_SCHEMA = "version long, last_movie_id long, last_person_id long"


def create_store(spark: SparkSession, path: str) -> None:
    """An empty store (version 0 has no tables)."""
    spark.createDataFrame([(0, 0, 0)], VERSION_SCHEMA).coalesce(1).write.mode("ignore").parquet(f"{path}/versions/v=0")


def current_version(spark: SparkSession, path: str):
    """The record of the highest published version: a row an import round."""
    return (spark.read.schema(VERSION_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{path}/versions")
            .orderBy(F.desc("version")).first())


def read_store(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """``movie``, ``person``, ``cast`` or ``changes`` of a version (default:
    the published one)."""
    at = current_version(spark, path)["version"] if version is None else version
    return spark.read.parquet(f"{path}/data/v={at}/{name}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def import_round(spark: SparkSession, path: str, titles: DataFrame, principals: DataFrame, names: DataFrame) -> int:
    """One import of a full dump of ``titles`` (tconst and source columns) with
    its cleaned ``principals`` and ``names``: S3, J4, J5 and S4 in a chain, each
    table written once. Returns the published version. A round that breaks
    publishes nothing and may be run again."""
    old = current_version(spark, path)
    version = old["version"] + 1
    out = f"{path}/data/v={version}"
    if old["version"]:
        target = read_store(spark, path, "movie", old["version"])
        people_before = read_store(spark, path, "person", old["version"])
        cast_before = read_store(spark, path, "cast", old["version"])
    else:
        target = titles.limit(0).withColumn("id", F.lit(None).cast("long"))
        people_before = spark.createDataFrame([], "id long, nconst string, primary_name string")
        cast_before = None
    changes = _written(sync_snapshot(target, titles, "tconst", last_id=old["last_movie_id"]), f"{out}/changes")
    movies = _written(current_rows(changes), f"{out}/movie")
    people = _written(build_people(principals, names, people_before, last_id=old["last_person_id"]), f"{out}/person")
    fresh = build_bridge(principals, movies, people)
    # The change feed says whose children go: replaced titles and deleted ones.
    gone = changes.select(F.col("id").alias("movie_id"))
    alive = changes.where(F.col("change") != DELETE).select(F.col("id").alias("movie_id"))
    cast = fresh.distinct() if cast_before is None else replace_children(cast_before, gone, fresh, alive=alive)
    _written(cast, f"{out}/cast")
    last = [max(old[c], t.agg(F.max("id")).first()[0] or 0)  # one number each
            for c, t in (("last_movie_id", movies), ("last_person_id", people))]
    spark.createDataFrame([(version, *last)], VERSION_SCHEMA).coalesce(1).write.parquet(f"{path}/versions/v={version}")
    return version
