"""Quality: posteriors against a plain loop, shrinkage, held-out accuracy."""

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import quality as q
from tests.llm.fixtures import SCHEMA, documents, frame, with_clashes

LABELS = "doc_id long, quality int, toxic int"


def strength(sites, mean):
    n = [a for a, _ in sites]
    if len(sites) < 2 or sum(n) <= len(sites):
        return 1000.0
    ss = sum(a * (s / a - mean) ** 2 for a, s in sites)
    within = mean * (1 - mean)
    spread = (ss - (len(sites) - 1) * within) / max(sum(n) - sum(a * a for a in n) / sum(n), 1e-9)
    return 1000.0 if spread <= 0 else min(1000.0, max(1.0, within / spread - 1))


def brute(rows):
    """rows: (id, host, path, evidence, belief)."""
    path, host = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for _, h, p, _, b in rows:
        for d, k in ((path, (h, p)), (host, h)):
            d[k][0] += 1
            d[k][1] += b
    mean = (sum(s for _, s in host.values()) + 1) / (len(rows) + 2)
    kh, kp = strength(list(host.values()), mean), strength(list(path.values()), mean)
    out = {}
    for i, h, p, e, b in rows:
        (hn, hs), (n, s) = host[h], path[(h, p)]
        hm = (kh * mean + hs - s) / (kh + hn - n)
        site = (kp * hm + s - b) / (kp + n - 1)
        logit = lambda x: math.log(x / (1 - x))
        z = logit(min(max(e, 1e-6), 1 - 1e-6)) + logit(site) - logit(mean)
        out[i] = (site, 1 / (1 + math.exp(-z)))
    return out


def test_posteriors_equal_plain_loop(spark):
    rng = np.random.RandomState(4)
    rows = []
    for i in range(500):
        h = "hot" if i % 3 == 0 else None if i % 17 == 0 else "h%d" % rng.randint(0, 12)
        p = "p%d" % rng.randint(0, 4) if i % 13 else None
        e = float(rng.uniform(0.05, 0.95))
        rows.append((i, h, p, e, float(rng.rand() < (0.9 if h == "hot" else 0.4)) if i % 2 else e))
    df = spark.createDataFrame(rows, "id long, __host string, __path string, __evidence double, __belief double")
    want = brute(rows)
    for r in q.combine(df).collect():
        assert math.isclose(r["__site"], want[r.id][0], rel_tol=1e-9)
        assert math.isclose(r["__posterior"], want[r.id][1], rel_tol=1e-9)


def test_sparse_sites_shrink(spark):
    rows = [(i, "big", "a", 0.5, 0.0) for i in range(300)] + [(300 + i, "h%d" % (i % 30), "a", 0.5, float(i % 3 > 0)) for i in range(300)]
    rows.append((999, "tiny", "a", 0.5, 0.0))
    rows.append((1000, "tiny", "a", 0.5, 0.0))
    got = {r.id: r["__site"] for r in q.combine(spark.createDataFrame(
        rows, "id long, __host string, __path string, __evidence double, __belief double")).collect()}
    assert got[0] < 0.05 < 0.1 < got[999] < 0.34


def test_awkward_rows(spark):
    rows = documents()
    lab = spark.createDataFrame([(r[0], k % 2, 0) for k, r in enumerate(rows)] + [(None, 1, 1), (6, None, 0)], LABELS)
    out = q.score_quality(with_clashes(frame(spark, rows)), lab, F.col("source"), F.col("lang")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and 0 <= r.evidence <= 1 for r in out)
    none = spark.createDataFrame([], LABELS)
    assert q.score_quality(spark.createDataFrame([], SCHEMA), none, F.col("source"), F.col("lang")).collect() == []
    assert {r.evidence for r in q.score_quality(frame(spark, rows), none, F.col("source"), F.col("lang")).collect()} == {0.5}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = q.score_quality(spark.read.parquet(f"{d}/documents.parquet"), labels, F.col("source"), F.col("lang"))
    rows = out.where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    hit = [(r.score >= 0.5) == (r.quality == 1) for r in rows]
    print("held-out accuracy", sum(hit) / len(hit))
    assert sum(hit) / len(hit) > 0.95
