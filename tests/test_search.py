"""Search family: filters (F3/F5 golden rows), limit clamp, top-k cast and
the batch kNN join against a brute-force numpy answer."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marquee.operators import filters as flt
from marquee.operators.search import clamp_limit, hybrid_search, knn_join, search
from marquee.plans import standins as sv
from marquee.plans.search_queries import probe_vector
from tests.conftest import SF001


def _movies(spark):
    return spark.createDataFrame([
        Row(id=1, genres=None), Row(id=2, genres=["Drama", "Comedy"]), Row(id=3, genres=["Drama"])],
        "id long, genres array<string>")


def test_genre_filter_golden(spark):
    m = _movies(spark)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert 1 not in ids(flt.genre_filter(m, ["Drama"], []))
    assert 1 in ids(flt.genre_filter(m, [], ["Drama"]))
    assert 2 in ids(flt.genre_filter(m, ["Drama"], ["Horror"]))
    assert 3 not in ids(flt.genre_filter(m, ["drama"], None))
    assert 3 in ids(flt.genre_filter(m, ["drama"], None, case_sensitive=False))


def test_actor_all_golden(spark):
    movies = spark.createDataFrame([Row(id=1)], "id long")
    cast = spark.createDataFrame([Row(movie_id=1, person_id=10, category="actor", ordering=1),
                                  Row(movie_id=1, person_id=11, category="actor", ordering=2)])
    people = spark.createDataFrame([Row(id=10, nconst="nm10", primary_name="Al Pacino"),
                                    Row(id=11, nconst="nm11", primary_name="Brad Pitt")])
    n = lambda names: flt.actor_all(movies, cast, people, names).count()
    assert n(["al pacino", "pitt"]) == 1
    assert n(["al pacino", "keanu"]) == 0
    assert n(["Киану"]) == 1  # token strips to empty: no filter


def test_clamp_limit():
    assert clamp_limit(None) == 15 and clamp_limit(0) == 1 and clamp_limit(99) == 15
    assert clamp_limit(7) == 7


def test_search_and_hybrid_shapes(spark):
    cat = sv.catalog(spark, SF001)
    q = probe_vector(cat)
    res = search(cat, sv.cast(spark, SF001), sv.person(spark, SF001), q, limit=5,
                 title_types=("promo", "economy", "standard", "medium", "large", "small"))
    rows = sorted(res.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    sims = [r["similarity"] for r in rows]
    assert sims == sorted(sims, reverse=True)
    assert all(len(r["actor_names"] or []) <= 5 for r in rows)
    hy = hybrid_search(cat, sv.cast(spark, SF001), sv.person(spark, SF001), q, limit=3).collect()
    assert len(hy) == 3


def test_knn_join_matches_bruteforce(spark):
    cat = sv.catalog(spark, SF001)
    req = sv.requests(spark, SF001).select("request_id", "qvec")
    got = knn_join(req, cat, k=3).collect()
    items = cat.filter(F.col("embedding").isNotNull()).select("id", "embedding").collect()
    E = np.array([r.embedding for r in items], dtype=np.float64)
    E /= np.linalg.norm(E, axis=1)[:, None]
    ids = np.array([r.id for r in items])
    for r in req.collect()[:20]:
        q = np.asarray(r.qvec, dtype=np.float64)
        s = E @ (q / np.linalg.norm(q))
        order = sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[:3]
        mine = sorted((g for g in got if g.request_id == r.request_id), key=lambda g: g["rank"])
        assert [g.id for g in mine] == [int(ids[i]) for i in order]


def test_knn_join_blocked_path_equals_broadcast(spark):
    cat = sv.catalog(spark, SF001)
    req = sv.requests(spark, SF001)
    a = {(r.request_id, r["rank"], r.id) for r in knn_join(req, cat, k=4).collect()}
    b = {(r.request_id, r["rank"], r.id) for r in
         knn_join(req, cat, k=4, max_broadcast_requests=7).collect()}
    assert a == b


def test_p6_golden(spark):
    from marquee.operators.lookup import sanitize_requests
    df = spark.createDataFrame(
        [("  comedy ", None, [" Action ", "  "], ["Drama", None], ["Tom Hanks", "  Meryl streep "]),
         ("x", 0, None, None, None), ("y", 99, [None], [], [None])],
        "query string, limit int, include_genres array<string>, exclude_genres array<string>, "
        "actors array<string>")
    r = sanitize_requests(df).collect()
    assert r[0].query == "comedy" and r[0].limit == 15 and list(r[0].include_genres) == ["Action"]
    assert list(r[0].exclude_genres) == ["Drama"] and list(r[0].actors) == ["tom hanks", "meryl streep"]
    assert r[1].limit == 1 and list(r[1].include_genres) == [] and r[2].limit == 15
    assert list(r[2].actors) == []


def test_s5_statuses(spark):
    from marquee.operators.lookup import lookup_resources
    cat = sv.stored_catalog(spark, SF001)
    uris = spark.createDataFrame([(1, "http://x/tt1"), (2, "imdb://movie/ "), (3, "imdb://movie/tt9999999"),
                                  (4, "imdb://movie/tt0000001")], "pos long, uri string")
    out = {r.pos: r for r in lookup_resources(uris, cat, sv.stored_cast(spark, SF001),
                                              sv.stored_person(spark, SF001)).collect()}
    assert out[1].message == "Unsupported resource" and out[2].message == "Missing IMDb identifier"
    assert out[3].message == "Movie tt9999999 not found." and out[4].status == "found"
    assert out[4].similarity == 1.0 and len(out[4].actor_names or []) <= 5


def test_knn_join_actor_filter_equals_single_searches(spark):
    from marquee.plans.search_queries import actor_requests
    cat = sv.stored_catalog(spark, SF001)
    cast, people = sv.stored_cast(spark, SF001), sv.stored_person(spark, SF001)
    req = actor_requests(spark, SF001)
    got = knn_join(req, cat, k=4, cast=cast, people=people).collect()
    types = [r[0].lower() for r in cat.select("title_type").distinct().collect()]
    rows = [r for r in req.collect() if r.actors][:4]
    assert rows
    for r in rows:
        single = search(cat, cast, people, list(r.qvec), limit=4, from_year=r.from_year,
                        to_year=r.to_year, runtime_max=r.runtime_max, min_rating=r.min_rating,
                        include_genres=r.include_genres, exclude_genres=r.exclude_genres,
                        actors=list(r.actors), title_types=types).collect()
        want = [x.id for x in sorted(single, key=lambda x: x["rank"])]
        mine = [g.id for g in sorted((g for g in got if g.request_id == r.request_id), key=lambda g: g["rank"])]
        assert mine == want


def test_knn_join_hybrid_actor_filter_equals_single_searches(spark):
    from marquee.plans.search_queries import actor_requests
    cat = sv.stored_catalog(spark, SF001)
    cast, people = sv.stored_cast(spark, SF001), sv.stored_person(spark, SF001)
    req = actor_requests(spark, SF001)
    got = knn_join(req, cat, k=3, mode="hybrid", cast=cast, people=people).collect()
    rows = [r for r in req.collect() if r.actors and any("#" in a for a in r.actors)][:3]
    assert rows
    for r in rows:
        single = hybrid_search(cat, cast, people, list(r.qvec), limit=3, from_year=r.from_year,
                               to_year=r.to_year, runtime_max=r.runtime_max, min_rating=r.min_rating,
                               include_genres=r.include_genres, exclude_genres=r.exclude_genres,
                               actor_names=list(r.actors)).collect()
        want = [x.id for x in sorted(single, key=lambda x: x["rank"])]
        mine = [g.id for g in sorted((g for g in got if g.request_id == r.request_id), key=lambda g: g["rank"])]
        assert mine == want


def test_large_k_path_equals_collected_path(spark, monkeypatch):
    import marquee.operators.search as S
    cat = sv.stored_catalog(spark, SF001)
    cast, people = sv.stored_cast(spark, SF001), sv.stored_person(spark, SF001)
    q = probe_vector(cat)
    a = [(r["rank"], r.id, tuple(r.actor_ids or [])) for r in hybrid_search(cat, cast, people, q, limit=20).collect()]
    monkeypatch.setattr(S, "COLLECT_TOP_K_MAX", 5)
    b = [(r["rank"], r.id, tuple(r.actor_ids or [])) for r in hybrid_search(cat, cast, people, q, limit=20).collect()]
    assert sorted(a) == sorted(b) and len(a) == 20


def _equal_vectors(spark, n=300):
    return spark.range(n).selectExpr(
        "id", "array(1.0D, 0.0D) AS embedding", "2000 AS start_year", "90 AS runtime_minutes",
        "5.0D AS rating", "10 AS votes", "array('red') AS genres")


@pytest.mark.parametrize("mode", ["similarity", "hybrid"])
def test_knn_join_ties_keep_k_rows_per_batch(spark, mode):
    import marquee.operators.search as S
    pdf = _equal_vectors(spark).toPandas().sample(frac=1, random_state=3)
    req = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)], "request_id long, qvec array<double>").toPandas()
    out = S._score_block(pdf, S._requests_payload(req, 5), 5, mode, S.HYBRID_WEIGHTS, 8)
    assert len(out) == 100 and np.all(np.sort(out.groupby("request_id")["id"].max()) == 4)


def test_knn_join_limit_per_request(spark):
    req = spark.createDataFrame([(1, [1.0, 0.0], 2), (2, [1.0, 0.0], None), (3, [1.0, 0.0], 0), (4, [1.0, 0.0], 99)],
                                "request_id long, qvec array<double>, limit int")
    got = knn_join(req, _equal_vectors(spark), k=4)
    assert "limit" not in got.columns
    n = {}
    for r in got.collect():
        n.setdefault(r.request_id, []).append(r.id)
    assert {k: sorted(v) for k, v in n.items()} == {1: [0, 1], 2: [0, 1, 2, 3], 3: [0], 4: [0, 1, 2, 3]}


def test_knn_join_actor_filter_blocked_equals_broadcast(spark, monkeypatch):
    import marquee.operators.search as S
    from marquee.plans.search_queries import actor_requests
    cat = sv.stored_catalog(spark, SF001)
    cast, people = sv.stored_cast(spark, SF001), sv.stored_person(spark, SF001)
    req = actor_requests(spark, SF001)
    rows = lambda df: {(r.request_id, r["rank"], r.id) for r in df.collect()}
    a = rows(knn_join(req, cat, k=4, cast=cast, people=people))
    monkeypatch.setattr(S, "TOKEN_BLOCK", 1)
    assert rows(knn_join(req, cat, k=4, cast=cast, people=people, max_broadcast_requests=50)) == a


def _random_block(n, m):
    rng = np.random.default_rng(4)
    cat = pd.DataFrame({"id": rng.permutation(m), "embedding": list(rng.integers(-2, 3, size=(m, 4)).astype(np.float32)),
                        "start_year": rng.integers(1970, 2020, m), "runtime_minutes": 90, "rating": 5.0, "votes": 10,
                        "genres": [["red"] if i % 3 else ["blue"] for i in range(m)]})
    req = pd.DataFrame({"request_id": np.arange(n), "qvec": list(rng.integers(-2, 3, size=(n, 4)).astype(np.float32)),
                        "from_year": np.where(np.arange(n) % 2, 1990.0, np.nan), "include_genres": [["red"]] * n})
    return cat, req


@pytest.mark.parametrize("mode", ["similarity", "hybrid"])
def test_knn_tiles_find_the_same_rows(monkeypatch, mode):
    import marquee.operators.search as S
    cat, req = _random_block(30, 200)
    run = lambda: S._score_block(cat, S._requests_payload(req, 5), 5, mode, S.HYBRID_WEIGHTS, 8)
    key = ["request_id", "score", "id"]
    whole = run().sort_values(key, ignore_index=True)
    monkeypatch.setattr(S, "TILE_MOVIES", 7)
    pd.testing.assert_frame_equal(run().sort_values(key, ignore_index=True), whole)


def test_knn_memory_does_not_grow_with_the_cell():
    import tracemalloc

    import marquee.operators.search as S
    cat, req = _random_block(512, 40_000)
    payload = S._requests_payload(req, 5)
    tracemalloc.start()
    S._score_block(cat, payload, 5, "similarity", S.HYBRID_WEIGHTS, 512)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20


def test_floor_leaves_the_best_and_spares_the_rest(monkeypatch):
    """A floor carried from batch to batch changes no result, whether filters
    look at whole tiles or at single pairs, and fewer rows leave a batch."""
    import numpy as np
    import pandas as pd
    from marquee.operators import search as ops

    rng = np.random.RandomState(1)
    n, words = 900, ["a", "b", "c", "d"]

    def some(p):
        return [list(rng.choice(words, rng.randint(1, 3), replace=False)) if rng.rand() < p else None for _ in range(n)]
    movies = pd.DataFrame({
        "id": rng.permutation(n), "embedding": list(rng.randint(-1, 2, (n, 4)).astype(float)), "genres": some(0.9), "matched": some(0.7),
        "rating": rng.rand(n) * 10, "votes": 1.0, "start_year": np.where(rng.rand(n) < 0.1, np.nan, 1990.0), "runtime_minutes": 90.0})
    asked = pd.DataFrame({
        "request_id": np.arange(n), "qvec": list(rng.randint(-1, 2, (n, 4)).astype(float)), "include_genres": some(0.3),
        "exclude_genres": some(0.3), "_tokens": [t or [] for t in some(0.3)],
        "min_rating": np.where(rng.rand(n) < 0.5, np.nan, 6.0), "from_year": np.where(rng.rand(n) < 0.5, np.nan, 1980.0)})
    req = ops._requests_payload(asked, 5)

    def run(few, floor):
        monkeypatch.setattr(ops, "FEW_PAIRS", few)
        monkeypatch.setattr(ops, "TILE_MOVIES", 70)
        parts = [p for a in range(0, n, 300) for p in ops._score_tiles(
            movies[a:a + 300], req, 5, "similarity", ops.HYBRID_WEIGHTS, 256, floor)]
        found = pd.concat(parts).sort_values(["request_id", "score", "id"], ascending=[True, False, True])
        best = found[found.groupby("request_id").cumcount() < 5]
        return len(found), list(zip(best["request_id"], best["id"], best["score"].round(9)))
    n_plain, plain = run(0, None)
    for few in (0, 1 / 8, 2):
        n_floor, floored = run(few, np.full(n, -np.inf))
        assert floored == plain
        assert n_floor < n_plain
