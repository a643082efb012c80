"""The Merkle manifest against a plain loop over the same rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from marquee.llm import merkle
from marquee.llm.queries import QUERIES
from tests.conftest import SF001
from tests.llm.fixtures import SCHEMA, documents, frame, with_clashes


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    d, text, lang, source, n = row
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)])


def grow(nodes):
    """The levels over ``nodes``, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i:i + 16]) for i in range(0, len(last), 16)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 16 * 16:i // 16 * 16 + 16]
        out.append(("".join(run[:i % 16]), "".join(run[i % 16 + 1:])))
        i //= 16
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, path) of every row, sorted."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = own, grow([leaf(r) for r in own])
    top = grow([trees[g][1][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        own, levels = trees[g]
        for i, r in enumerate(own):
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], path(levels, i) + path(top, at)))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r[0], r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in df.collect()], key=repr)


def test_awkward_rows(spark):
    assert got(merkle.manifest(with_clashes(frame(spark)))) == brute(documents())


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 4097, 4600])
def test_tiers(spark, n):
    """Sizes at which a level, a block or a tier begins; a hot group and small ones."""
    rows = [(i, f"t{i}", "en", "hot" if i % 40 or i < 40 else f"s{i}", i) for i in range(n)]
    out = merkle.manifest(frame(spark, rows))
    assert got(out) == brute(rows)
    assert out.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).isEmpty()


def test_many_groups_and_null_first(spark):
    rows = [(i, None if i % 7 == 0 else "", None, None if i == 5 else f"é{i % 300}", None) for i in range(700)]
    assert got(merkle.manifest(frame(spark, rows))) == brute(rows)


def test_empty_table_and_one_row(spark):
    assert merkle.manifest(frame(spark, [])).collect() == []
    r = merkle.manifest(frame(spark, [(None, None, None, None, None)])).first()
    assert r.leaf == r.subroot == r.root == H("-----") and r.proof == []


def test_a_changed_row_is_found(spark):
    out = merkle.manifest(frame(spark), carry={"other": merkle.leaf_of(F.col("doc_id"), F.lit("x"))})
    assert out.where(merkle.fold(F.col("other"), F.col("proof")) == F.col("root")).isEmpty()


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet")
            .select("doc_id", "text", "lang", "source", "n_chars").collect()]
    texts = {r[0]: r for r in rows}
    want = []
    for d, own, subroot, root, steps in brute(rows):
        changed = zlib.crc32(str(d).encode()) % 5 == 0 and texts[d][1] is not None
        f = own
        if changed:
            low = texts[d][1].translate({c: c + 32 for c in range(65, 91)})
            f = leaf((d, low, *texts[d][2:]))
        for a, b in steps:
            f = H(a, f, b)
        want.append((d, own, subroot, root, H(*[a + b for a, b in steps]), f, f == root))
    assert sorted(map(tuple, QUERIES["op13_merkle_manifest"](spark, SF001).collect()), key=repr) == sorted(want, key=repr)
    assert any(not w[-1] for w in want) and any(w[-1] for w in want)
    assert SCHEMA
