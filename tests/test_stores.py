"""The stored vector index, the versioned import store and the stored manifest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators.ann import recall_at_k
from marquee.operators.search import knn_join
from marquee.operators.vector_index import append_to_index, build_index, search_index
from marquee.plans import standins as sv
from marquee.session import scratch_path
from marquee.sources.manifest import create_manifest, listing_key, read_changed
from marquee.sources.store import create_store, current_version, import_round, read_store
from marquee.streaming.jobs import run_dir
from tests.conftest import SF01

DIM = 12


def _vectors(spark, n, seed, first=0):
    rng = np.random.RandomState(seed)
    centre = rng.normal(size=(6, DIM))
    rows = [(first + i, (centre[i % 6] + 0.4 * rng.normal(size=DIM)).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, embedding array<double>")


def _exact(rows, queries, k):
    e = np.array([v for _, v in rows])
    e /= np.linalg.norm(e, axis=1)[:, None]
    out = {}
    for q, v in queries:
        sim = e @ (np.array(v) / np.linalg.norm(v))
        out[q] = [rows[i][0] for i in sorted(range(len(rows)), key=lambda i: (-sim[i], rows[i][0]))[:k]]
    return out


def _ids(df):
    out = {}
    for r in df.orderBy("request_id", "rank").collect():
        out.setdefault(r.request_id, []).append(r.id)
    return out


@pytest.fixture(scope="module")
def index(spark):
    rows, df = _vectors(spark, 400, 1)
    path = run_dir(spark, "index")
    build_index(df, path, n_sub=4)
    return rows, df, path


def test_full_probe_is_exact_and_few_requests_equal_many(spark, index):
    rows, df, path = index
    queries, _ = _vectors(spark, 40, 2)
    req = spark.createDataFrame(queries, "request_id long, qvec array<double>")
    want = _exact(rows, queries, 5)
    assert _ids(search_index(req, df, path, 5, nprobe=None, refine=None)) == want
    assert _ids(search_index(req, df, path, 5, nprobe=None, refine=None, max_requests=10)) == want
    few, many = search_index(req, df, path, 5, 0.3, 8), search_index(req, df, path, 5, 0.3, 8, max_requests=10)
    assert _ids(few) == _ids(many)
    hit = np.mean([len(set(_ids(few)[q]) & set(want[q])) / 5 for q in want])
    assert hit >= 0.9


def test_many_requests_probing_much_equal_few(spark, index, monkeypatch):
    import marquee.operators.vector_index as V
    rows, df, path = index
    queries, _ = _vectors(spark, 40, 2)
    req = spark.createDataFrame(queries, "request_id long, qvec array<double>")
    few = _ids(search_index(req, df, path, 5, 0.7, 8))
    monkeypatch.setattr(V, "BLOCK_ROWS", 150)
    monkeypatch.setattr(V, "BLOCK_REQUESTS", 7)
    monkeypatch.setattr(V, "CHUNK_ROWS", 40)
    monkeypatch.setattr(V, "_dealt_requests", None)  # the cells are not dealt to
    monkeypatch.setattr(V, "_codes_bytes", lambda codes: 0)
    assert _ids(search_index(req, df, path, 5, 0.7, 8, max_requests=10)) == few


def test_exact_search_ships_no_pair_but_the_best(spark, index, monkeypatch):
    import marquee.operators.vector_index as V
    rows, df, path = index
    queries, _ = _vectors(spark, 40, 2)
    req = spark.createDataFrame(queries, "request_id long, qvec array<double>")
    monkeypatch.setattr(V, "CHUNK_ROWS", 40)
    cents, _ = V._model(spark, path)
    codes = spark.read.schema(V.CODED).parquet(f"{path}/codes")
    some = V._exact_candidates(req, df, codes, cents, len(cents), 5, len(queries))
    assert some.count() == 5 * len(queries)
    assert _ids(search_index(req, df, path, 5, refine=None)) == _exact(rows, queries, 5)


def test_rows_are_appended_without_fitting(spark, index):
    rows, df, _ = index
    path = run_dir(spark, "index-append")
    build_index(df, path, n_sub=4)
    model = sorted(map(tuple, spark.read.parquet(f"{path}/model").select("kind", "pos", F.hash("vector")).collect()))
    new, more = _vectors(spark, 50, 3, first=1000)
    append_to_index(more, path)
    assert sorted(map(tuple, spark.read.parquet(f"{path}/model").select("kind", "pos", F.hash("vector")).collect())) == model
    queries = [(i, v) for i, v in new[:10]]
    req = spark.createDataFrame(queries, "request_id long, qvec array<double>")
    every = df.unionByName(more)
    assert _ids(search_index(req, every, path, 3, refine=None)) == _exact(rows + new, queries, 3)
    # rows that the catalogue has no longer are left out
    assert _ids(search_index(req, df, path, 3, refine=None)) == _exact(rows, queries, 3)


def test_index_of_nothing_and_rows_without_direction(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    path = run_dir(spark, "index-none")
    build_index(none, path)
    req = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "request_id long, qvec array<double>")
    assert search_index(req, none, path).collect() == []
    some = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 1.0]), (4, [2.0, 0.0])], "id long, embedding array<double>")
    path = run_dir(spark, "index-some")
    build_index(some, path)
    assert _ids(search_index(req, some, path, 5)) == {1: [4, 3]}


def test_v5_stored_index_recall_at_10(spark):
    cat, req = sv.stored_catalog(spark, SF01), sv.requests(spark, SF01).select("request_id", "qvec")
    got = search_index(req, cat, sv.stored_index(spark, SF01), 10, 0.7, 4)
    assert recall_at_k(got, knn_join(req, cat, k=10)).first().recall >= 0.9


def _titles(spark, *rows):
    return spark.createDataFrame([(t, f"name {t}", v) for t, v in rows], "tconst string, primary_title string, votes int")


def _principals(spark, *rows):
    return spark.createDataFrame([(t, n, "actor", i, None, None) for i, (t, n) in enumerate(rows)],
                                 "tconst string, nconst string, category string, ordering int, job string, characters string")


def test_import_rounds(spark):
    path = run_dir(spark, "store")
    create_store(spark, path)
    create_store(spark, path)
    names = spark.createDataFrame([("n1", "A"), ("n2", "B")], "nconst string, primary_name string")
    assert import_round(spark, path, _titles(spark, ("a", 1), ("b", 1), ("c", 1)),
                        _principals(spark, ("a", "n1"), ("c", "n1"), ("c", "n9")), names) == 1
    import_round(spark, path, _titles(spark, ("a", 2), ("b", 1)), _principals(spark, ("a", "n1"), ("b", "n2")), names)
    # c, with the largest id, left with its cast; its id and person n9's stay used
    assert sorted(map(tuple, read_store(spark, path, "cast").select("movie_id", "person_id").collect())) == [(1, 1), (2, 3)]
    import_round(spark, path, _titles(spark, ("a", 2), ("b", 1), ("c", 5), ("d", 1)), _principals(spark, ("c", "n9"), ("d", "n3")), names)
    assert {r.tconst: (r.id, r.change) for r in read_store(spark, path, "changes").collect()} == {
        "a": (1, "unchanged"), "b": (2, "unchanged"), "c": (4, "insert"), "d": (5, "insert")}
    assert sorted(map(tuple, read_store(spark, path, "cast").select("movie_id", "person_id").collect())) == [(4, 2), (5, 4)]
    last = current_version(spark, path)
    assert (last.version, last.last_movie_id, last.last_person_id) == (3, 5, 4)
    # an unpublished round is not seen, and may be run again
    read_store(spark, path, "movie").limit(1).write.parquet(f"{path}/data/v=4/movie")
    assert read_store(spark, path, "movie").count() == 4
    assert import_round(spark, path, _titles(spark, ("a", 2)), _principals(spark), names) == 4
    assert [r.tconst for r in read_store(spark, path, "movie").collect()] == ["a"]
    assert read_store(spark, path, "cast").isEmpty() and read_store(spark, path, "movie", 3).count() == 4


def test_manifest_reads_changed_content_only(spark):
    root = run_dir(spark, "manifest")
    create_manifest(spark, f"{root}/store")

    def write(name, *values):
        spark.createDataFrame([(v,) for v in values], "a long").coalesce(1).write.mode("overwrite").parquet(f"{root}/in/{name}")

    def run():
        rows, n = read_changed(spark, f"{root}/in/*/*.parquet", f"{root}/store", "a long")
        return n, sorted(r.a for r in rows.collect()) if rows is not None else None
    write("x", 1, 2)
    write("y", 3)
    assert run() == (2, [1, 2, 3]) and run() == (0, None)
    key = listing_key(spark, f"{root}/in")
    write("y", 4)
    assert run() == (1, [4]) and listing_key(spark, f"{root}/in") != key
    write("z", 5)
    assert run() == (1, [5]) and run() == (0, None)


def test_stored_copies_follow_their_input(spark, tmp_path):
    for t in sv.STORE_INPUTS:
        spark.read.parquet(f"{SF01}/{t}.parquet").limit(3).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    assert sv.stored_person(spark, str(tmp_path)).count() == 3
    spark.read.parquet(f"{SF01}/supplier.parquet").limit(5).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/supplier.parquet")
    assert sv.stored_person(spark, str(tmp_path)).count() == 5 and scratch_path(spark, "x")
