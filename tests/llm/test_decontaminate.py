"""Decontamination against brute force over words."""

import random
import re

import pytest

from marquee.llm import decontaminate as dc
from tests.llm.fixtures import SCHEMA, documents, frame, with_clashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items, window=10):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        p = words(t)
        n = min(window, len(p))
        for a in range(len(p) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i:i + n] == p[a:a + n]:
                    hit |= set(range(i, i + n))
                    if item is not None:
                        ids.add(str(item))
    return len(w), len(hit), sorted(ids)


def data():
    rows = documents()
    items = [(3, rows[30][1]), (20, "Alpha1"), (100, rows[60][1]), (4, None), (5, " .. "), (None, "odd, text!")]
    rng = random.Random(2)
    long = rows[60][1].split(" ")
    for k in range(12):
        a = rng.randint(0, len(long) - 20)
        piece = ", ".join(x.upper() for x in long[a:a + rng.randint(8, 20)])
        rows.append((1000 + k, "Before. %s? after ODD-TEXT é" % piece, "en", "s", 1))
    rows.append((2000, long[0] + " " + " ".join(long[:30]) + " " + " ".join(long[:15]), "en", "s", 1))
    return rows, items


@pytest.mark.parametrize("most", [1_000_000, 300])
def test_hits_equal_brute_force(spark, most):
    rows, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.mark_contaminated(with_clashes(frame(spark, rows)), bench, max_item_chars=most)
    got = got.withColumn("hit", dc.n_hit(got)).collect()
    want = sorted(((r[0], *brute(r[1], items)) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["__n_words"], r["hit"], r["__items"]) for r in got), key=repr) == want
    for r in got:
        assert len(r["__hit_chars"]) == len(r["__hit_words"])
        for c, w in zip(r["__hit_chars"], r["__hit_words"]):
            assert words(r["text"][c["lo"]:c["hi"]]) == words(r["text"])[w["lo"]:w["hi"]]


def test_clean_documents_stay_as_they_are(spark):
    rows, items = data()
    df = with_clashes(frame(spark, rows))
    out = dc.drop_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == df.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == \
        sorted((r[0] for r in rows if not brute(r[1], items)[1]), key=repr)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.mark_contaminated(spark.createDataFrame([], SCHEMA), none).collect() == []
    assert dc.drop_contaminated(frame(spark), none).count() == len(documents())
