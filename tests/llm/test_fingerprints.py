"""Fingerprints against plain Python over the same rows."""

import hashlib
import math

from marquee.llm import fingerprints as fp
from tests.llm.fixtures import SCHEMA, documents, frame, with_clashes


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        out.append((r[0], len(t), hashlib.sha256((t[:len(t) - h] + nxt[:h]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edited_texts_and_order(spark, monkeypatch):
    rows = documents()
    for size in (2000, 7, 1):
        monkeypatch.setattr(fp, "FAN", 5)
        monkeypatch.setattr(fp.with_next, "__defaults__", (size,))
        got = fp.fingerprint_edits(with_clashes(frame(spark, rows))).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == edited(rows)
    by_text = {}
    texts = {(r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()): r[1] for r in rows}
    assert texts
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    same = [r.fingerprint for r in got if r.doc_id in (15, 255, 258)]
    assert len(set(same)) == 1
    assert by_text == {}


def test_no_python_in_the_plan(spark):
    df = fp.fingerprint_edits(frame(spark))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_estimates_follow_the_truth(spark):
    import random
    rng = random.Random(3)
    words = ["w%d" % i for i in range(5000)]
    long = [rng.choice(words) for _ in range(4000)]
    part = long[1000:2000]
    other = [rng.choice(words) for _ in range(1000)]
    df = spark.createDataFrame([(" ".join(long), " ".join(part), " ".join(other))], "a string, b string, c string")
    for c in "abc":
        df = fp.with_fingerprint(df, c, "f" + c)
    r = df.select(fp.containment(df["fb"], df["fa"]).alias("x"), fp.containment(df["fc"], df["fa"]).alias("y"),
                  fp.resemblance(df["fa"], df["fb"]).alias("z"), df["fa"], df["fb"], fp.merge(df["fa"], df["fb"]).alias("m")).first()
    assert r.x > 0.97 and r.y < 0.03 and math.isclose(r.z, 0.25, abs_tol=0.05)
    assert r.m == sorted(set(r.fa) | set(r.fb))
    assert len(r.fa) == len([1 for _ in r.fa]) and 800 < len(r.fa) < 1200


def test_short_in_long_is_never_a_false_zero(spark):
    import random
    rng = random.Random(5)
    words = ["w%d" % i for i in range(5000)]
    rows = []
    for k in range(120):
        long = [rng.choice(words) for _ in range(400)]
        rows.append((" ".join(long[50:55 + k % 4]), " ".join(long), " ".join(rng.choice(words) for _ in range(6))))
    df = spark.createDataFrame(rows, "a string, b string, c string")
    for c in "abc":
        df = fp.with_fingerprint(df, c, "f" + c)
    got = df.select(
        "fa", "fb", fp.containment(df["fa"], df["fb"], df["fa_least"], df["fb_least"]).alias("inside"),
        fp.containment(df["fa"], df["fb"]).alias("alone"), fp.merge(df["fa"], df["fb"]).alias("m"),
        fp.containment(df["fa"], df["fa"], df["fa_least"], df["fa_least"]).alias("self"),
        fp.resemblance(df["fa"], df["fa"], df["fa_least"], df["fa_least"]).alias("same"),
        fp.resemblance(df["fa"], df["fc"], df["fa_least"], df["fc_least"]).alias("other")).collect()
    assert {r.inside for r in got} == {r.alone for r in got} == {1.0, None}
    assert all((r.inside is None) == (r.fa == []) for r in got)
    # The union's shingles are the long text's.
    assert all(r.m == r.fb for r in got)
    assert {r.self for r in got} == {r.same for r in got} == {1.0} and {r.other for r in got} == {0.0}


def test_one_row_and_none(spark):
    assert fp.fingerprint_edits(spark.createDataFrame([], SCHEMA)).collect() == []
    r = fp.fingerprint_edits(frame(spark, [(5, "a b c d e f", None, None, None)])).first()
    assert r.near_next == 1.0 and r.n_chars == 11
    assert r.edited_sha256 == hashlib.sha256(b"a b c " + b"a b c").hexdigest()
