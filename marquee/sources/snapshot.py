"""Catalogue snapshot sync (S3), child replacement (S4) and versioned
snapshot writes. Plain Parquet has no MERGE or DELETE, so a sync computes the
next version as a DataFrame (full outer join on the natural key) and writes
it as a new version directory; readers never see a path being rewritten."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.catalog import assign_ids

# Change kinds of a sync.
INSERT, UPDATE, UNCHANGED, DELETE = "insert", "update", "unchanged", "delete"
ENRICHMENT_COLS = ("plot", "embedding", "embedding_model", "embedding_updated_at")


def sync_snapshot(target: DataFrame, source: DataFrame, key: str = "tconst",
                  source_cols: Sequence[str] | None = None, id_col: str | None = "id",
                  invalidate_on_change: bool = False, last_id: int | None = None) -> DataFrame:
    """S3: upsert every source column on ``key`` and mark target rows absent
    from the source as deleted (J3 is the anti side of the same join).

    Columns the source does not carry (plot, embedding, ...) and surrogate ids
    survive an update. New keys get ids ``last_id`` + rank in key order;
    ``last_id`` is the largest id ever given (default: the target's largest,
    which is enough only while no row with the largest id was deleted).
    ``invalidate_on_change`` clears the embedding columns of updated rows
    (the reference leaves them stale). Returns the target columns plus
    ``change``; ``current_rows`` drops the deletes.
    """
    src_cols = list(source_cols or [c for c in source.columns if c != key])
    t_cols = [c for c in target.columns if c != key]
    t = target.select(F.col(key).alias("_k"), *[F.col(c).alias(f"t_{c}") for c in t_cols],
                      F.lit(True).alias("_in_t"))
    s = source.select(F.col(key).alias("_k"), *[F.col(c).alias(f"s_{c}") for c in src_cols],
                      F.lit(True).alias("_in_s"))
    j = t.join(s, "_k", "full_outer")
    shared = [c for c in src_cols if c in t_cols]
    same = reduce(lambda a, b: a & b,
                  [F.col(f"t_{c}").eqNullSafe(F.col(f"s_{c}")) for c in shared], F.lit(True))
    change = (F.when(F.col("_in_t").isNull(), INSERT)
              .when(F.col("_in_s").isNull(), DELETE)
              .when(same, UNCHANGED).otherwise(UPDATE))
    j = j.withColumn("change", change)
    out = [F.col("_k").alias(key)]
    for c in t_cols:
        if c == id_col:
            continue
        if c in src_cols:
            out.append(F.when(F.col("_in_s"), F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")).alias(c))
        elif invalidate_on_change and c in ENRICHMENT_COLS:
            out.append(F.when(F.col("change") == UPDATE, F.lit(None)).otherwise(
                F.col(f"t_{c}")).alias(c))
        else:
            out.append(F.col(f"t_{c}").alias(c))
    for c in src_cols:
        if c not in t_cols:
            out.append(F.col(f"s_{c}").alias(c))
    rows = j.select(*out, "change", *([F.col(f"t_{id_col}").alias(id_col)] if id_col in t_cols else []))
    if id_col is None or id_col not in t_cols:
        return rows
    max_id = last_id if last_id is not None else target.agg(F.max(id_col)).first()[0] or 0  # one scalar
    # Inserts are numbered from the two key columns alone, so the wide change
    # set (embeddings) is neither planned twice nor written to number it.
    fresh = source.select(key).join(target.select(key), key, "left_anti")
    new_ids = assign_ids(fresh, key, "_new_id", start=max_id)
    return (rows.join(new_ids, key, "left")
            .withColumn(id_col, F.coalesce(F.col(id_col), F.col("_new_id"))).drop("_new_id"))


def current_rows(changes: DataFrame) -> DataFrame:
    """The next snapshot: every row that was not deleted."""
    return changes.filter(F.col("change") != DELETE).drop("change")


def write_version(df: DataFrame, base_path: str, version: int | str) -> str:
    """Write a snapshot as ``base_path/v=<version>`` and return the path;
    the previous version stays readable until the caller switches over."""
    path = f"{base_path.rstrip('/')}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def replace_children(existing: DataFrame, parent_keys: DataFrame, fresh: DataFrame,
                     parent_col: str = "movie_id", alive: DataFrame | None = None) -> DataFrame:
    """Drop every child row of the given parents, then add the fresh
    distinct set (anti join + union; nothing is rewritten in place). With
    ``alive`` (the parents that there are) children of others go as well."""
    keys = parent_keys.select(parent_col).distinct()
    kept = existing.join(keys, parent_col, "left_anti")
    if alive is not None:
        kept = kept.join(alive.select(parent_col).distinct(), parent_col, "left_semi")
    return kept.unionByName(fresh.select(*existing.columns).distinct())
