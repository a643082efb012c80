"""V5: approximate kNN join -- an inverted-file (IVF) index built with
Spark ML k-means, probed per request.

The HNSW access path of the reference is re-aimed as a cell index that fits
Spark's model: catalogue vectors are assigned to k-means cells; each request
probes its ``nprobe`` nearest cells (the recall knob, like ``ef_search``).
Cells that hold too many rows are split into sub-blocks of at most
``block_rows`` (the per-cell counts are a tiny aggregate), and the request is
sent to every sub-block of a probed cell, so a hot cell never lands whole in
one task. Each (cell, sub-block) is one cogroup task that scores its
requests with a matrix product and keeps a local top-k; no candidate pair
set is materialised. Exact re-ranking is the score itself (cosine in double).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.vector import unit_vector
from marquee.operators.search import _KNN_SCHEMA, _empty_candidates, _requests_payload, _score_block
from marquee.session import ship_package


def build_ivf(catalog: DataFrame, n_cells: int = 16, seed: int = 7, max_iter: int = 20):
    """Fit k-means on the unit catalogue vectors; return (model, centroids)
    where centroids is a small (n_cells x dim) numpy array."""
    unit = (catalog.filter(F.col("embedding").isNotNull())
            .select("id", array_to_vector(unit_vector("embedding")).alias("features"))
            .filter(F.col("features").isNotNull()))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, featuresCol="features",
                   predictionCol="cell").fit(unit)
    cents = np.array([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])
    return model, cents


def approx_knn_join(requests: DataFrame, catalog: DataFrame, k: int = 10, n_cells: int = 16,
                    nprobe: int = 4, block_rows: int = 50_000, seed: int = 7,
                    mode: str = "similarity", weights=(0.60, 0.30, 0.10)) -> DataFrame:
    """V5: approximate V4, ``limit`` of a request as there. Returns
    (request_id, id, similarity, score, rank)."""
    spark = requests.sparkSession
    ship_package(spark)
    cat = catalog.filter(F.col("embedding").isNotNull()).select(
        "id", "embedding", "start_year", "runtime_minutes", "rating", "votes", "genres")
    model, cents = build_ivf(cat, n_cells, seed)
    n_cells = len(cents)
    cents_unit = cents / np.maximum(np.linalg.norm(cents, axis=1), 1e-12)[:, None]
    cent_b = spark.sparkContext.broadcast(cents_unit)  # n_cells x dim: bounded
    assigned = model.transform(cat.withColumn("features", array_to_vector(unit_vector("embedding")))
                               .filter(F.col("features").isNotNull())).drop("features")
    sizes = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    subs = sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block_rows)))
                        .cast("int").alias("n_sub"))
    cat_b = (assigned.join(F.broadcast(subs), "cell")  # one row per cell
             .withColumn("sub", F.pmod(F.xxhash64("id"), F.col("n_sub")).cast("int")).drop("n_sub"))

    probe_schema = T.StructType([T.StructField("request_id", T.LongType()),
                                 T.StructField("cell", T.IntegerType())])
    npr = max(1, min(nprobe, n_cells))

    def probe(it):
        c = cent_b.value
        for pdf in it:
            if not len(pdf):
                continue
            q = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["qvec"].values])
            s = q @ c.T
            top = np.argsort(-s, axis=1)[:, :npr]
            yield pd.DataFrame({"request_id": np.repeat(pdf["request_id"].to_numpy(np.int64), npr),
                                "cell": top.reshape(-1).astype(np.int32)})

    req_cols = [c for c in requests.columns if c in (
        "request_id", "qvec", "from_year", "to_year", "runtime_max", "min_rating",
        "include_genres", "exclude_genres", "limit")]
    req = requests.select(*req_cols)
    probes = req.select("request_id", "qvec").mapInPandas(probe, probe_schema)
    req_b = (req.join(probes, "request_id").join(F.broadcast(subs), "cell")
             .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("n_sub") - 1))).drop("n_sub"))

    def cell(rpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if len(rpdf) == 0 or len(cpdf) == 0:
            return _empty_candidates()
        return _score_block(cpdf, _requests_payload(rpdf, k), k, mode, weights, 512)

    cand = (req_b.groupBy("cell", "sub").cogroup(cat_b.groupBy("cell", "sub"))
            .applyInPandas(cell, _KNN_SCHEMA))
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), F.asc("id"))
    return (cand.withColumn("rank", F.row_number().over(w))
            .filter((F.col("rank") <= k) & (F.col("rank") <= F.col("limit"))).drop("limit"))


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Mean fraction of the exact top-k ids found by the approximate join."""
    hit = approx.select("request_id", "id").join(exact.select("request_id", "id"), ["request_id", "id"])
    per = (exact.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
           .join(hit.groupBy("request_id").agg(F.count(F.lit(1)).alias("h")), "request_id", "left"))
    return per.agg(F.avg(F.coalesce(F.col("h"), F.lit(0)) / F.col("n")).alias("recall"))
