"""Helpers shared by the training-data operators: reading a table, cutting
lineage into the shared folder, word hashing in batches, and connected
components over an edge table."""

from __future__ import annotations

import ctypes
import functools
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.session import reliable_checkpoint, scratch_path, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# Odd 64-bit multipliers of the hash mixers (any odd constants would do).
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
               0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_S31, _S29 = np.uint64(31), np.uint64(29)

#: Characters of text that one step of a Python task handles at a time, so
#: that memory does not follow the Arrow batch size.
STEP_CHARS = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table in the shared folder."""
    return scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")


def aside(docs: DataFrame, *own: str):
    """``docs`` with all columns but ``own`` under names that no operator uses,
    and the function that gives rows of it their columns back."""
    names = [c if c in own else f"aside_{i}" for i, c in enumerate(docs.columns)]

    def back(out: DataFrame) -> DataFrame:
        return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
    return docs.toDF(*names), back


def stored(df: DataFrame, name: str, group_mb: int = 128) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: the lineage
    is cut there, and a lost executor costs a re-read, not a re-run. A task
    buffers a row group of ``group_mb``; wide rows take a smaller one."""
    path = scratch_table(df.sparkSession, name)
    df.write.option("parquet.block.size", group_mb << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: How to drop what this Python worker keeps between tasks.
_KEPT: list = []


def kept_by_worker(drop) -> None:
    """Register ``drop``, which frees something kept between tasks."""
    _KEPT.append(drop)


def free_worker() -> None:
    """Workers outlive their tasks: an operator that needs the memory first
    frees what another one left there (it is built again when needed)."""
    for drop in _KEPT:
        drop()
    _trim()


def _trim() -> None:
    """Hand memory that nothing holds back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def frees(run):
    """A task's function that gives its memory back when the task ends: an
    idle worker keeps its bounded caches only."""
    @functools.wraps(run)
    def task(*args):
        try:
            yield from run(*args)
        finally:
            _trim()
    return task


def ascii_lower(text):
    """Lower-case A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def steps(texts, limit: int = STEP_CHARS):
    """Slices of ``texts`` of about ``limit`` characters (at least one text)."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings (keyed SipHash, the same in every task)."""
    if not words:
        return np.empty(0, np.uint64)
    arr = np.empty(len(words), dtype=object)
    arr[:] = words
    return pd.util.hash_array(arr, categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> _S31)) * _M[1]
    x = (x ^ (x >> _S29)) * _M[3]
    return x ^ (x >> _S31)


def gram_hashes(h: np.ndarray, n: int, gaps: tuple[int, ...] | None = None) -> np.ndarray:
    """Hashes of the n-grams of the word hashes ``h``; ``gaps`` gives other
    offsets than 0..n-1 (skip-grams). Empty when ``h`` is too short."""
    at = gaps or tuple(range(n))
    m = len(h) - at[-1]
    if m <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(m, np.uint64(len(at) * 1315423911 + at[-1]), np.uint64)
    for k, g in enumerate(at):
        acc = acc * _M[0] + mix(h[g:g + m] + _M[k % 5])
    return mix(acc)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)``; root is the smallest
    node of its component.

    Alternating large-star / small-star steps: each is an aggregate (partial
    before the shuffle) and an equi join that AQE may split, so a hub with a
    third of all edges is never one task's list. The edge table is cut into
    the shared folder each round; only a count and a hash sum reach the
    driver. Nulls and self-loops are ignored; an empty table gives none.
    """
    e = (edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
         .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    e = reliable_checkpoint(e)
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("v", "m") % 1_000_003)).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = e.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(
            e.select(F.col("m").alias("u"), F.col("v").alias("w")))
        low = both.groupBy("u").agg(F.min("w").alias("m0")).select(
            "u", F.least("u", "m0").alias("m"))
        large = (both.join(low, "u").where("w > u AND w <> m")
                 .select(F.col("w").alias("v"), "m").distinct())
        low = large.groupBy("v").agg(F.min("m").alias("r"))
        pairs = large.join(low, "v")
        e = reliable_checkpoint(
            pairs.where("m <> r").select(F.col("m").alias("v"), F.col("r").alias("m"))
            .unionByName(pairs.select("v", F.col("r").alias("m"))).distinct())
    return e.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(
        e.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct())
