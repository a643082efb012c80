"""Apportionment and mixing against their definitions."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from marquee.llm import mixing
from tests.llm.fixtures import SCHEMA, documents, frame, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_sainte_lague(v, seats):
    won = [0] * len(v)
    for _ in range(seats):
        best = max((x / (2 * s + 1), -i) for i, (x, s) in enumerate(zip(v, won)) if x > 0)
        won[-best[1]] += 1
    return won


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12), st.integers(0, 200))
@settings(max_examples=200, deadline=None)
def test_highest_quotients(v, seats):
    got = list(mixing.sainte_lague(v, seats))
    if not any(v):
        assert not any(got)
        return
    assert sum(got) == seats
    slow = slow_sainte_lague(v, seats)
    last = lambda won: sorted(round(x / (2 * s - 1), 9) for x, w in zip(v, won) for s in range(1, w + 1))
    assert last(got) == last(slow)  # the same quotients won, ties aside


def slow_targets(sizes, weights, most=3):
    out, capped = [0.0] * len(sizes), set()
    while True:
        left = sum(sizes) - sum(most * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        total = sum(weights[i] for i in free)
        for i in range(len(sizes)):
            out[i] = most * sizes[i] if i in capped else left * weights[i] / total
        over = {i for i in free if out[i] > most * sizes[i] + 1e-9}
        if not over:
            return out
        capped |= over


@given(st.lists(st.integers(0, 500), min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_targets_stop_and_reshare(sizes):
    w = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    if sum(sizes):
        assert mixing.targets(sizes, w) == pytest.approx(slow_targets(sizes, w))


def check(rows, got):
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = [sum(size(r[1]) for r in rows if r[3] == s) for s in sources]
    goal = slow_targets(total, [mixing.WEIGHTS[i % 3] for i in range(len(sources))])
    assert len(got) == len(rows)
    for s, n, t in zip(sources, total, goal):
        own = [g for g in got if g["source"] == s]
        assert all(g["__source_size"] == n and abs(g["__target"] - t) < 1e-6 for g in own)
        assert abs(sum(g["__taken"] for g in own) - t) <= 2 * mixing.BLOCK_WORDS
    for g in got:
        assert 0 <= g["__taken"] <= 3 * g["__size"] and g["__size"] == size(g["text"])


def test_taken_words_come_near_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1500)
    rows = documents()
    df = with_clashes(frame(spark, rows))
    got = [r.asDict() for r in mixing.plan_mix(df).collect()]
    check(rows, got)
    again = [r.asDict() for r in mixing.plan_mix(df.repartition(7)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mixed_documents_hold_what_was_taken(spark):
    rows = documents()
    df = with_clashes(frame(spark, rows))
    plan = mixing.plan_mix(df).collect()
    out = mixing.mixed_documents(df).collect()
    assert list(out[0].asDict()) == df.columns
    for i in {r[0] for r in rows}:
        taken = sum(r["__taken"] for r in plan if r["doc_id"] == i)
        assert taken == sum(len(WORD.findall(r["text"] or "")) for r in out if r["doc_id"] == i)
    texts = {r[0]: r[1] for r in rows}
    for r in out:
        own = " ".join(WORD.findall(texts[r["doc_id"]]))
        assert " ".join(WORD.findall(r["text"])) in own and r["n_chars"] == len(r["text"])


def test_empty_and_wordless(spark):
    assert mixing.plan_mix(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.plan_mix(frame(spark, [(1, None, None, None, None), (2, " ", None, "a", 1)])).collect()
    assert [r["__taken"] for r in got] == [0, 0]


def test_hot_source_is_dealt_into_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 400)
    rng = random.Random(5)
    rows = [(i, " ".join("w%d" % rng.randint(0, 99) for _ in range(rng.randint(1, 60))), "en",
             "hot" if i % 3 else "s%d" % (i % 7), 1) for i in range(400)]
    check(rows, [r.asDict() for r in mixing.plan_mix(frame(spark, rows)).collect()])
