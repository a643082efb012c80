"""V5 recall against exact V4, and the driver contract of __spark_entry__."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from marquee.operators.ann import approx_knn_join, recall_at_k
from marquee.operators.search import knn_join
from marquee.plans import standins as sv
from tests.conftest import SF001, SF01


def test_v5_full_probe_with_split_cells_is_exact(spark):
    cat = sv.catalog(spark, SF001)
    req = sv.requests(spark, SF001).select("request_id", "qvec")
    exact = knn_join(req, cat, k=5)
    full = approx_knn_join(req, cat, k=5, n_cells=4, nprobe=4, block_rows=10)
    assert recall_at_k(full, exact).first().recall == 1.0


def test_v5_columns_and_limit_per_request(spark):
    cat = sv.catalog(spark, SF001)
    req = (sv.requests(spark, SF001).select("request_id", "qvec")
           .withColumn("limit", F.when(F.col("request_id") % 2 == 0, 2)))
    out = approx_knn_join(req, cat, k=5, n_cells=4, nprobe=4)
    assert out.columns == ["request_id", "id", "similarity", "score", "rank"]
    most = {r.request_id: r.n for r in out.groupBy("request_id").agg(F.max("rank").alias("n")).collect()}
    assert most and all(n == (2 if i % 2 == 0 else 5) for i, n in most.items())


def test_v5_registered_query_has_rows(spark):
    df = entry.queries()["v5_approx_knn"](spark, SF001)
    n = sv.requests(spark, SF001).count()
    assert df.columns == ["request_id", "rank", "id", "similarity"] and df.count() == 10 * n


def test_v5_recall_at_10(spark):
    cat = sv.catalog(spark, SF01)
    req = sv.requests(spark, SF01).select("request_id", "qvec")
    exact = knn_join(req, cat, k=10)
    approx = approx_knn_join(req, cat, k=10, n_cells=16, nprobe=12)
    assert recall_at_k(approx, exact).first().recall >= 0.9


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "score" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60
