"""Toxicity: the learner against a scalar version, scores against the model,
held-out accuracy, labels never an input of a score."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import toxicity as tx
from tests.llm.fixtures import SCHEMA, documents, frame, with_clashes

LABELS = "doc_id long, quality int, toxic int"


def scalar_ftrl(rows, labels, epochs, alpha, beta, l1, l2):
    z, n, bias = {}, {}, "bias"

    def weight(i):
        p = 0.0 if i == bias else l1
        zi = z.get(i, 0.0)
        if abs(zi) <= p:
            return 0.0
        return -(zi - math.copysign(p, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)
    for _ in range(epochs):
        for row, y in zip(rows, labels):
            own = [*row, bias]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return weight(bias), {i: weight(i) for i in z if i != bias and weight(i)}


def test_learner_equals_scalar_version():
    rng = np.random.RandomState(0)
    rows = [np.unique(rng.randint(0, 50, 12)).astype(np.int32) for _ in range(80)]
    y = np.array([float(3 in r or 7 in r) for r in rows])
    bias, w = tx.ftrl(rows, y, 3, 0.5, 1.0, 0.3, 0.5)
    b2, w2 = scalar_ftrl(rows, y, 3, 0.5, 1.0, 0.3, 0.5)
    assert math.isclose(bias, b2, rel_tol=1e-9)
    assert {i: round(w[i], 9) for i in np.flatnonzero(w)} == {int(i): round(v, 9) for i, v in w2.items()}


def test_features():
    a, b, c, d = tx.feature_slots(["One, two THREE", None, "one two three", "😀"])
    assert len(a) == 3 + 9 + 2 + 1 and len(b) == 0 and list(a) == list(c) and len(d) == 4


def test_scores_follow_the_model(spark):
    rows = documents()
    labels = [(r[0], 1, int(k % 5 == 0)) for k, r in enumerate(rows) if r[0] is not None]
    rows = [(r[0], (r[1] or "") + (" vileword awful" if k % 5 == 0 else "") if r[1] else r[1], *r[2:]) for k, r in enumerate(rows)]
    df, lab = with_clashes(frame(spark, rows)), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], LABELS)
    got = tx.score_toxicity(df, lab).collect()
    bias, slots, weights = tx.fit_toxicity(df, lab)
    w = dict(zip(slots.tolist(), weights.tolist()))
    want = {}
    for r, x in zip(rows, tx.feature_slots([r[1] for r in rows])):
        want[(r[0], r[1])] = 1 / (1 + math.exp(-max(-35, min(35, bias + sum(w.get(i, 0.0) for i in set(x.tolist()))))))
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r["__score"], want[(r.doc_id, r.text)], rel_tol=1e-4, abs_tol=1e-6)
    out = tx.drop_toxic(df, lab)
    assert out.columns == df.columns and out.count() == sum(r["__score"] < tx.THRESHOLD for r in got)


def test_held_out_labels_are_not_learned(spark):
    rows = documents()
    ids = [r[0] for r in rows if r[0] is not None]
    out = spark.createDataFrame([(i,) for i in set(ids)], "doc_id long").select("doc_id", tx.held_out(F.col("doc_id")).alias("h"))
    held = {r.doc_id for r in out.collect() if r.h}
    assert held == {i for i in ids if zlib.crc32(str(i).encode()) % 4 == 2}
    lab = spark.createDataFrame([(i, 1, int(i % 2)) for i in set(ids)], LABELS)
    other = spark.createDataFrame([(i, 1, int(i % 2) if i not in held else 1 - i % 2) for i in set(ids)], LABELS)
    df = frame(spark, rows)
    assert sorted(tx.score_toxicity(df, lab).select("doc_id", "__score").collect(), key=repr) == \
        sorted(tx.score_toxicity(df, other).select("doc_id", "__score").collect(), key=repr)


def test_no_rows_no_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert tx.score_toxicity(spark.createDataFrame([], SCHEMA), none).collect() == []
    assert {r["__score"] for r in tx.score_toxicity(frame(spark), none).collect()} == {0.5}


def test_sample_is_of_these_documents(spark):
    rows = documents()
    ids = {r[0] for r in rows if r[0] is not None}
    lab = spark.createDataFrame([(i, 1, 0) for i in sorted(ids) + list(range(10 ** 6, 10 ** 6 + 3000))], LABELS)
    learnt = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)
    assert tx.fit_rows(frame(spark, rows), lab, "toxic", 200).count() == learnt
    assert tx.fit_rows(frame(spark, rows), lab, "toxic", 20).count() == 20


def test_sample_has_a_repeated_id_once(spark):
    rows = [(1, "again", "en", "s", 5)] * 50 + [(1, None, "en", "s", 0), (3, "once", "en", "s", 4), (9, None, "en", "s", 0)]
    assert not any(zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 3, 9))
    lab = spark.createDataFrame([(1, 1, 1), (3, 1, 0), (9, 1, 0)], LABELS)
    got = tx.fit_rows(frame(spark, rows), lab, "toxic").select("label", "text").collect()
    assert sorted(map(tuple, got)) == [(0, ""), (0, "once"), (1, "again")]


def test_nothing_is_dropped_without_a_label(spark):
    df = frame(spark)
    for lab in ([], [(10 ** 6 + i, 1, 1) for i in range(50)]):
        out = tx.drop_toxic(df, spark.createDataFrame(lab, LABELS))
        assert out.columns == df.columns and sorted(out.collect(), key=repr) == sorted(df.collect(), key=repr)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = (tx.score_toxicity(docs, labels).join(labels, "doc_id").where(tx.held_out(F.col("doc_id")))
            .select("__score", "toxic").collect())
    hit = [(r["__score"] >= tx.THRESHOLD, r.toxic == 1) for r in rows]
    assert sum(a == b for a, b in hit) / len(hit) > 0.96
    assert sum(a and b for a, b in hit) / sum(b for _, b in hit) > 0.85
