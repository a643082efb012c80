"""Stages of the pipeline and the entry, met with names of their own."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import ADDED, CLASHES, documents, frame, with_clashes

ROOT = corpus_pipeline.__file__.rsplit("/", 1)[0]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clash"))
    labels = [(r[0], i % 2, int(r[0] % 4 == 0)) for i, r in enumerate(documents()) if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [("q1", documents()[4][1]), (None, None)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_a_stage_keeps_columns_named_like_its_own(spark, tables, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = frame(spark)
    extra = with_clashes(plain)
    extra = extra.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in ADDED], F.lit(1).alias("a.b"))
    want, got = stage(spark, plain, tables), stage(spark, extra, tables)
    if name == "token_output":
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        return
    assert got.columns == extra.columns
    rows = got.collect()
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    for r in rows:
        assert all(r[c] == "x" for c in CLASHES) and r["a.b"] == 1
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for c in ADDED)


def test_repeated_rows_are_one_row_of_sets(spark, monkeypatch):
    from marquee.llm import common, near_dedup
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "s", 1)] * 3000 + [(2, text + " more", "en", "s", 1), (3, "other words here", "en", "s", 1)]
    sizes = {}

    def stored(df, name, group_mb=128):
        out = common.stored(df, name, group_mb)
        sizes[name] = out.count()
        return out
    monkeypatch.setattr(near_dedup, "stored", stored)
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sizes["sets"] == 2 and len(got) == 3002
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)}


@pytest.mark.parametrize("missing", ["public_tokenizers", "ahocorasick", "corpus_pipeline", "marquee.llm"])
def test_entry_without(missing):
    code = f"""
import sys
sys.modules[{missing!r}] = None
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
print(len(e.queries()), sum(q.startswith('op') for q in e.queries()), 'pipeline' in e.queries(), 'v3_hybrid_search' in e.oracle_sql())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    n, ops, pipeline, there = done.stdout.split()
    assert there == "True" and pipeline == str(missing == "ahocorasick")
    assert int(ops) == (0 if missing in ("public_tokenizers", "marquee.llm") else 13)
    assert int(n) >= 73 + int(ops)
