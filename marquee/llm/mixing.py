"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source's target share becomes an integer number of equal-word blocks by
highest quotients v / (2s + 1). A source is dealt into shards by a seeded hash
(a hot source into more of them), its blocks are apportioned over its shards
by the same rule, and each shard, in seeded order, gives whole passes over its
documents plus one seeded run of blocks. Texts are cut only where such a run
begins or ends, so at most two documents of a shard are taken in part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import aside
from marquee.session import ship_package

#: Weights of the sources in code point order (null last), repeating, and the
#: most times a source may be repeated.
WEIGHTS, MOST = (5, 2, 1), 3
#: Words of a block; words a shard aims at; shards of one source at most.
BLOCK_WORDS, SHARD_WORDS, MAX_SHARDS = 16, 1 << 20, 4096
#: Sources of one mix: the plan (a row each) is made on the driver.
MAX_SOURCES = 1_000_000

WORD = "[^\\x20\\x09-\\x0D]+"


def sainte_lague(values, seats: int) -> np.ndarray:
    """Seats by highest quotients v / (2s + 1); ties go to the earlier party;
    no value above zero: no seats."""
    v = np.maximum(np.asarray(values, dtype=float), 0)
    if seats <= 0 or not v.sum() > 0:
        return np.zeros(len(v), np.int64)
    won = np.floor(v / (v.sum() / seats) + 0.5).astype(np.int64)
    short = seats - int(won.sum())
    step = 1 if short > 0 else -1
    # The rounding is itself a Sainte-Lague result for its own seat count.
    queue = [(-v[i] / (2 * won[i] + 1), i) if step > 0 else (v[i] / (2 * won[i] - 1), -i)
             for i in range(len(v)) if v[i] > 0 and (step > 0 or won[i] > 0)]
    heapq.heapify(queue)
    for _ in range(abs(short)):
        i = abs(heapq.heappop(queue)[1])
        won[i] += step
        if step > 0:
            heapq.heappush(queue, (-v[i] / (2 * won[i] + 1), i))
        elif won[i] > 0:
            heapq.heappush(queue, (v[i] / (2 * won[i] - 1), -i))
    return won


def targets(sizes: list[float], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of ``sum(sizes)`` by weight; a share stops at ``most`` times its
    source's size and the excess is shared again by weight."""
    out = [0.0] * len(sizes)
    left, weight = float(sum(sizes)), float(sum(weights))
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    for n, i in enumerate(order):
        if most * sizes[i] * weight > left * weights[i]:
            for j in order[n:]:
                out[j] = left * weights[j] / weight
            break
        out[i] = float(most * sizes[i])
        left -= out[i]
        weight -= weights[i]
    return out


def mix_plan(sized: DataFrame, weights=WEIGHTS, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: ``__src, __source_size, __target, __blocks, __shards``."""
    rows = sized.groupBy("__src").agg(F.sum("__size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: map them to groups before mixing")
    rows = sorted(((r["__src"], int(r["n"])) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in rows]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))]) if rows else []
    blocks = sainte_lague(goal, round(sum(sizes) / block))
    data = [(s, n, float(t), int(b), min(MAX_SHARDS, max(1, -(-n // SHARD_WORDS))))
            for (s, n), t, b in zip(rows, goal, blocks)]
    return sized.sparkSession.createDataFrame(
        data, "__src string, __source_size long, __target double, __blocks long, __shards long")


def _shard_quotas(block: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__shard", kind="stable")
        won = sainte_lague(pdf["__supply"].to_numpy(), int(pdf["__blocks"].iloc[0]))
        supply = pdf["__supply"].to_numpy()
        return pd.DataFrame({"__q_src": pdf["__src"], "__q_shard": pdf["__shard"], "__supply": supply,
                             "__quota": np.minimum(won * block, MOST * supply)})
    return run


def plan_mix(docs: DataFrame, weights=WEIGHTS, block: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """``docs`` with ``__size, __source_size, __target, __passes`` (whole
    copies), ``__cuts`` (word ranges ``struct<lo, hi>`` taken besides) and
    ``__taken``. Input columns stay as they are; ``source`` and ``text`` may be
    null (null text: no words, never taken); repeated rows count each; equal
    order keys are equal rows, so reruns agree. Empty table: empty result.
    Columns of ``docs`` named as those six are replaced."""
    ship_package(docs.sparkSession)
    own = ["__size", "__source_size", "__target", "__passes", "__cuts", "__taken"]
    docs = docs.drop(*own)
    rows, _ = aside(docs, "doc_id", "text", "source")
    sized = (rows.withColumn("__src", F.col("source").cast("string"))
             .withColumn("__size", F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long"))
             .withColumn("__rank", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text").cast("string"))))
    plan = mix_plan(sized, weights, block)
    # At most MAX_SOURCES short rows: a bounded broadcast, and no skew by source.
    dealt = (sized.join(F.broadcast(plan.withColumnRenamed("__src", "__p_src")),
                        F.col("__src").eqNullSafe(F.col("__p_src"))).drop("__p_src")
             .withColumn("__shard", F.pmod(F.col("__rank"), F.col("__shards"))))
    supply = dealt.groupBy("__src", "__shard", "__blocks").agg(F.sum("__size").alias("__supply"))
    quotas = supply.groupBy("__src").applyInPandas(
        _shard_quotas(block), "__q_src string, __q_shard long, __supply long, __quota long")
    start = F.pmod(F.xxhash64(F.lit(seed), "__q_src", "__q_shard"),
                   F.greatest(F.ceil(F.col("__supply") / block), F.lit(1))) * block
    quotas = (quotas.where("__supply > 0")
              .withColumn("__passes", F.floor(F.col("__quota") / F.col("__supply")))
              .withColumn("__more", F.col("__quota") % F.col("__supply"))
              .withColumn("__from", start).drop("__quota"))
    # One key without nulls for the window and the join: the texts move once.
    def key(src):
        return F.coalesce(F.concat(F.lit("s"), F.col(src)), F.lit(""))
    order = Window.partitionBy("__key", "__shard").orderBy("__rank", "doc_id", "__size")
    quotas = quotas.withColumn("__q_key", key("__q_src"))
    placed = dealt.withColumn("__key", key("__src")).withColumn("__hi", F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(quotas, (F.col("__key") == F.col("__q_key")) & (F.col("__shard") == F.col("__q_shard")), "left")
    lo = F.col("__hi") - F.col("__size")

    def cut(a, b):
        return F.struct((F.greatest(a, lo) - lo).alias("lo"), (F.least(b, F.col("__hi")) - lo).alias("hi"))
    runs = F.array(cut(F.col("__from"), F.col("__from") + F.col("__more")),
                   cut(F.lit(0).cast("long"), F.col("__from") + F.col("__more") - F.col("__supply")))
    out = (placed.withColumn("__passes", F.coalesce("__passes", F.lit(0)))
           .withColumn("__cuts", F.coalesce(F.filter(runs, lambda c: c["hi"] > c["lo"]),
                                            F.array().cast("array<struct<lo:bigint,hi:bigint>>")))
           .withColumn("__taken", F.col("__passes") * F.col("__size") + F.aggregate(
               "__cuts", F.lit(0).cast("long"), lambda s, c: s + c["hi"] - c["lo"])))
    return out.select(*[F.col(n).alias(c) for n, c in zip(rows.columns, docs.columns)], *own)


def mixed_documents(docs: DataFrame, weights=WEIGHTS, block: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row per whole copy and
    one per cut (its words joined by a space; ``n_chars``, if there, follows).
    Texts without words have nothing to take and are not in it."""
    rows, back = aside(docs, "doc_id", "text", "source", "n_chars")
    plan = plan_mix(rows, weights, block, seed).where("__size > 0")
    words = F.filter(F.split(F.col("text"), "[ \\t-\\r]+"), lambda w: w != "")
    whole = F.array_repeat(F.struct(F.col("text").alias("t"), F.lit(False).alias("cut")), F.col("__passes").cast("int"))
    parts = F.transform("__cuts", lambda c: F.when(
        c["hi"] - c["lo"] == F.col("__size"), F.struct(F.col("text").alias("t"), F.lit(False).alias("cut"))).otherwise(
        F.struct(F.array_join(F.slice(words, (c["lo"] + 1).cast("int"), (c["hi"] - c["lo"]).cast("int")), " ").alias("t"),
                 F.lit(True).alias("cut"))))
    out = plan.withColumn("__copy", F.explode(F.concat(whole, parts)))
    fresh = {"text": F.col("__copy.t")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col("__copy.cut"), F.length("__copy.t").cast("long")).otherwise(F.col("n_chars"))
    return back(out.select(*[fresh.get(c, F.col(c)).alias(c) for c in rows.columns]))
