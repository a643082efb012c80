"""Near-duplicate groups against brute force over all pairs."""

import random
import re

import pytest

from marquee.llm.near_dedup import drop_near_duplicates, match_threshold, near_duplicates
from tests.llm.fixtures import SCHEMA, documents, frame, prose, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return frozenset()
    m = min(n, len(w))
    return frozenset(tuple(w[i:i + m]) for i in range(len(w) - m + 1))


def brute(rows, n=3, percent=85):
    sets = [shingles(r[1], n) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    label = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            label[find(i)] = min(label.get(find(i), r[0]), r[0])
    return sorted((r[0] if r[0] is not None else -1, len(sets[i]),
                   -1 if label.get(find(i)) is None else label[find(i)],
                   r[0] == label.get(find(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, n, percent):
    rows = documents()
    got = near_duplicates(with_clashes(frame(spark)), n, percent).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles,
                  -1 if r.component_id is None else r.component_id, r.kept) for r in got)
    assert got == brute(rows, n, percent)


def test_clusters_of_several_blocks(spark, monkeypatch):
    import marquee.llm.near_dedup as nd
    monkeypatch.setattr(nd, "BLOCK_DOCS", 4)
    rows = documents(11)
    got = near_duplicates(frame(spark, rows)).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles,
                  -1 if r.component_id is None else r.component_id, r.kept) for r in got)
    assert got == brute(rows)


def chained(seed):
    """A large group of near copies, and chains whose links lie between blocks."""
    rng = random.Random(seed)
    texts = []
    for _ in range(2):
        base = prose(rng, 150).split(" ")
        for _ in range(30):
            w = list(base)
            for _ in range(rng.randint(0, 12)):
                w[rng.randrange(len(w))] = "edit%d" % rng.randint(0, 10 ** 6)
            texts.append(" ".join(w))
        for step in range(25):
            base[step * 5] = "step%d" % step
            texts.append(" ".join(base))
    rng.shuffle(texts)
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("docs", [1, 3, 10])
def test_chains_across_blocks(spark, monkeypatch, docs):
    import marquee.llm.near_dedup as nd
    monkeypatch.setattr(nd, "BLOCK_DOCS", docs)
    rows = chained(docs)
    got = near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = documents()
    out = drop_near_duplicates(with_clashes(frame(spark)), 3, 85)
    assert set(out.columns) == set(with_clashes(frame(spark)).columns)
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect())
    assert ids == sorted({x[0] for x in brute(rows) if x[3] or x[0] == -1})


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_match_threshold_leaves_margin():
    assert match_threshold(0.85) == 40 and match_threshold(0.8) == 35


def test_collisions_count_agreeing_coordinates():
    import numpy as np

    from marquee.llm.near_dedup import collisions
    keys = np.array([[1, 2, 3], [1, 5, 3], [7, 8, 9]])
    assert collisions(keys).tolist() == [[3, 2, 0], [2, 3, 0], [0, 0, 3]]
