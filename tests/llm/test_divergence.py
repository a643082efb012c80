"""The divergence audit against sums over all terms."""

import random
import re

import numpy as np
import pytest

from marquee.llm import divergence as dv
from marquee.llm.queries import QUERIES
from tests.conftest import SF001
from tests.llm.fixtures import SCHEMA, documents, frame, with_clashes

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10):
    """Rows (lang, source, part, item, value, rank) of (text, lang, source)."""
    n, docs, groups = {}, {}, set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = TERM.findall((text or "").translate(LOW))
        for w in words:
            n.setdefault((lang, source), {}).setdefault(w, 0)
            n[lang, source][w] += 1
        for w in set(words):
            docs[lang, w] = docs.get((lang, w), 0) + 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (la, w), c in docs.items() if la == lang and c >= least)
        sources = sorted(s for la, s in groups if la == lang)
        count = {s: [n.get((lang, s), {}).get(w, 0) for w in kept] for s in sources}
        total = [sum(count[s][k] for s in sources) for k in range(len(kept))]

        def share(c):
            return [1 + 10 ** 9 * (x + 2) // (sum(c) + 2 * len(kept)) for x in c]
        p = {s: share(count[s]) for s in sources}
        q = share(total)
        for s in sources:
            def ranked(part, items):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                return [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(items)]
            out += ranked("pair", [(o, sum((a - b) ** 2 // (a + b) for a, b in zip(p[s], p[o]))) for o in sources if o != s])
            out += ranked("term", [(w, (a - b) ** 2 // (a + b)) for w, a, b, c in zip(kept, p[s], q, count[s]) if c and a > b])[:10]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def table(spark, rows):
    return frame(spark, [(i, t, la, s, None) for i, (t, la, s) in enumerate(rows)])


def test_awkward_rows(spark):
    rows = documents()
    assert got(dv.divergence(with_clashes(frame(spark)))) == brute([(r[1], r[2], r[3]) for r in rows])


def test_nulls_languages_without_terms_and_groups_without_words(spark):
    rng = random.Random(2)
    rows = [(" ".join(rng.choices(["Aa", "b", "é", "x-y", "STRAẞE", "中文", "1z2"], k=6)), None if i % 3 else "", ["p", "", None, "q"][i % 4])
            for i in range(80)]
    rows += [("", "", "blank"), (None, "", "null"), ("0 1 2", "", "digits"), ("rare", "la", "s1"), ("once", "la", "s2"), (None, "la", None), ("x", "one", "s")]
    want = brute(rows)
    assert got(dv.divergence(table(spark, rows))) == want
    assert any(r[0] == "la" and r[4] == 0 for r in want)
    assert dv.divergence(table(spark, [])).collect() == []


def test_many_terms_and_many_sources(spark, monkeypatch):
    """More terms than a bucket, more sources than a block, one hot source, ties."""
    rng = random.Random(5)
    words = ["w" + "".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else f"s{rng.randrange(40)}"
        rows.append((" ".join(rng.choices(words, weights=range(1, 301), k=25)), "en", source))
    monkeypatch.setattr(dv, "BUCKET_TERMS", 64)
    monkeypatch.setattr(dv, "BLOCK_SOURCES", 8)
    assert got(dv.divergence(table(spark, rows))) == brute(rows)


def test_equal_subtrees_are_one_node_and_equal_pairs_meet_once():
    leaves = np.zeros((3, 1024), np.int64)
    leaves[1, 5] = leaves[2, 5] = 1
    leaves[2, 900] = 2
    roots, children = dv.hash_consed(leaves)
    # a tree without counts has a node a level, one count adds one a level
    assert [len(left) for left, _ in children] == [3, 3, 3, 3, 3, 3, 3, 3, 3, 3][:len(children)]
    other, x, y, times = dv.met_leaves(roots[0], roots[1:], children)
    assert sorted(zip(other, x, y, times)) == [(0, 0, 0, 1023), (0, 0, 1, 1), (1, 0, 0, 1022), (1, 0, 1, 1), (1, 0, 2, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_traversal_equals_leaf_by_leaf(seed):
    rng = np.random.RandomState(seed)
    leaves = rng.poisson(0.3, (6, 64)).astype(np.int64)
    roots, children = dv.hash_consed(leaves)
    other, x, y, times = dv.met_leaves(roots[2], roots, children)
    want = {}
    for o in range(6):
        for pair in zip(leaves[2], leaves[o]):
            want[o, *pair] = want.get((o, *pair), 0) + 1
    assert dict(zip(zip(other, x, y), times)) == want


def test_large_counts_are_exact():
    counts = np.array([0, 5, 3 * 10 ** 13], np.int64)
    assert dv.shares(counts, 10 ** 14, 1000).tolist() == [1 + 10 ** 9 * (c + 2) // (10 ** 14 + 2000) for c in counts.tolist()]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("text", "lang", "source").collect()]
    df = QUERIES["op11_source_divergence"](spark, SF001)
    assert dict(df.dtypes)["rank"] == "int" and got(df) == brute(rows) and SCHEMA
