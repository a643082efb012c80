"""Registered queries for the search family (F*, V1-V4, W2, W3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.vector import cosine_literal
from marquee.operators import filters as flt
from marquee.operators.cast import top_cast
from marquee.operators.search import hybrid_search, knn_join, search
from marquee.operators.vector_index import search_index
from marquee.plans import standins as sv
from marquee.plans.registry import register
from marquee.plans.standins import with_views
from marquee.sources.tables import table


def probe_vector(catalog: DataFrame) -> list[float]:
    """The query vector of the single-request searches: the embedding of the
    best-rated catalogue movie (a "more like this" request). One row."""
    row = (catalog.filter(F.col("embedding").isNotNull())
           .orderBy(F.desc_nulls_last("rating"), F.asc("id"))
           .select("embedding").first())
    return [float(x) for x in row[0]]


PROBE_SQL = """probe AS (SELECT embedding AS q FROM catalog WHERE embedding IS NOT NULL
                ORDER BY rating DESC NULLS LAST, id ASC LIMIT 1)"""


def _j(c):
    return F.array_join(F.col(c), "|")


def _r6(c):
    return F.round(F.col(c), 6)


# ---- V3 hybrid search (the flagship) ----------------------------------------

V3_PARAMS = dict(limit=10, from_year=1975, min_rating=4.0, exclude_genres=["anvil"],
                 actor_names=["Supplier#000000007", "Supplier#000000042"])


def v3_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    cat = sv.stored_catalog(spark, sf)
    res = hybrid_search(cat, sv.stored_cast(spark, sf), sv.stored_person(spark, sf), probe_vector(cat),
                        **V3_PARAMS)
    return res.select("rank", "tconst", "primary_title", "start_year", "rating", "votes",
                      _r6("sim").alias("sim"), _r6("score").alias("score"),
                      _j("genres").alias("genres"), "plot",
                      _j("actor_names").alias("actor_names"), _j("actor_ids").alias("actor_ids"))


#: Who acts in what, once per (movie, person), and the movies that both of the
#: queried names match.
PLAYED_SQL = """played AS (
  SELECT movie_id, lower(primary_name) AS who, regexp_replace(lower(primary_name), '[^a-z0-9]', '', 'g') AS bare
  FROM cast_, person WHERE person.id = cast_.person_id AND category IN ('actor', 'actress'))"""
BOTH_SQL = """both_played AS (
  SELECT movie_id FROM played GROUP BY movie_id
  HAVING bool_or(contains(bare, 'supplier000000003')) AND bool_or(contains(bare, '00000007')))"""


register("v3_hybrid_search", with_views("""
SELECT t.rank, t.tconst, t.primary_title, t.start_year, t.rating, t.votes,
       round(t.sim, 6) AS sim, round(t.score, 6) AS score,
       array_to_string(t.genres, '|') AS genres, t.plot,
       array_to_string(tc.actor_names, '|') AS actor_names,
       array_to_string(tc.actor_ids, '|') AS actor_ids
FROM top t LEFT JOIN top_cast tc ON tc.movie_id = t.id""", "catalog", "top_cast", ctes=[
    PROBE_SQL, PLAYED_SQL, BOTH_SQL, """
filtered AS (
  SELECT c.* FROM catalog c
  WHERE c.embedding IS NOT NULL AND c.start_year >= 1975 AND c.rating >= 4.0
    AND NOT coalesce(list_has_any(c.genres, ['anvil']), false)
    AND c.id IN (SELECT movie_id FROM played WHERE who IN ('supplier#000000007', 'supplier#000000042')))""",
    """
scored AS (
  SELECT f.*, list_cosine_similarity(CAST(f.embedding AS DOUBLE[]), CAST(probe.q AS DOUBLE[])) AS sim
  FROM filtered f, probe)""", """
ranked AS (
  SELECT *, 0.60 * sim + 0.30 * least(coalesce(rating, 0) / 10.0, 1.0)
            + 0.10 * log10(greatest(coalesce(votes, 0), 1)) AS score
  FROM scored WHERE sim IS NOT NULL)""", """
top AS (
  SELECT *, CAST(row_number() OVER (ORDER BY score DESC, id ASC) AS INTEGER) AS rank
  FROM ranked QUALIFY rank <= 10)"""]))(v3_hybrid)


# ---- V1 cosine ------------------------------------------------------------------

@register("v1_cosine", with_views("""
SELECT id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS sim
FROM catalog, probe WHERE embedding IS NOT NULL""", "catalog", ctes=[PROBE_SQL]))
def v1_cosine(spark, sf):
    cat = sv.stored_catalog(spark, sf)
    q = probe_vector(cat)
    return (cat.filter(F.col("embedding").isNotNull())
            .select("id", F.round(cosine_literal("embedding", q), 6).alias("sim")))


# ---- V2 filtered cosine top-k ---------------------------------------------------

V2_PARAMS = dict(limit=8, from_year=1980, to_year=2015, runtime_max=180,
                 include_genres=["red", "blue", "old"], exclude_genres=["gizmo"],
                 actors=["Supplier#000000003", "0000000 7", "Киану"],
                 title_types=("promo", "economy"))


@register("v2_search", with_views("""
SELECT t.rank, t.tconst, t.primary_title AS title, t.start_year AS year, t.rating, t.votes,
       round(t.similarity, 6) AS similarity, array_to_string(t.genres, '|') AS genres,
       array_to_string(tc.actor_names, '|') AS actor_names,
       array_to_string(tc.actor_ids, '|') AS actor_ids,
       t.plot, t.title_type, t.runtime_minutes, t.is_adult
FROM top t LEFT JOIN top_cast tc ON tc.movie_id = t.id""", "catalog", "top_cast", ctes=[
    PROBE_SQL, PLAYED_SQL, BOTH_SQL, """
filtered AS (
  SELECT c.* FROM catalog c
  WHERE c.embedding IS NOT NULL AND lower(c.title_type) IN ('promo', 'economy')
    AND c.start_year >= 1980 AND c.start_year <= 2015 AND c.runtime_minutes <= 180
    AND coalesce(list_has_any(c.genres, ['red', 'blue', 'old']), false)
    AND NOT coalesce(list_has_any(c.genres, ['gizmo']), false)
    AND c.id IN (SELECT movie_id FROM both_played))""",
    """
scored AS (
  SELECT f.*, list_cosine_similarity(CAST(f.embedding AS DOUBLE[]), CAST(probe.q AS DOUBLE[])) AS similarity
  FROM filtered f, probe)""", """
top AS (
  SELECT *, CAST(row_number() OVER (ORDER BY similarity DESC, id ASC) AS INTEGER) AS rank
  FROM scored WHERE similarity IS NOT NULL QUALIFY rank <= 8)"""]))
def v2_search(spark, sf):
    cat = sv.stored_catalog(spark, sf)
    res = search(cat, sv.stored_cast(spark, sf), sv.stored_person(spark, sf), probe_vector(cat), **V2_PARAMS)
    return res.select("rank", "tconst", F.col("primary_title").alias("title"),
                      F.col("start_year").alias("year"), "rating", "votes",
                      _r6("similarity").alias("similarity"), _j("genres").alias("genres"),
                      _j("actor_names").alias("actor_names"), _j("actor_ids").alias("actor_ids"),
                      "plot", "title_type", "runtime_minutes", "is_adult")


# ---- V4 batch kNN join --------------------------------------------------------------

_KNN_CAND = """
cand AS (
  SELECT r.request_id, c.id, c.tconst,
         list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(r.qvec AS DOUBLE[])) AS similarity,
         c.rating, c.votes
  FROM requests r JOIN catalog c ON c.embedding IS NOT NULL
   AND (r.from_year IS NULL OR c.start_year >= r.from_year)
   AND (r.to_year IS NULL OR c.start_year <= r.to_year)
   AND (r.runtime_max IS NULL OR c.runtime_minutes <= r.runtime_max)
   AND (r.min_rating IS NULL OR c.rating >= r.min_rating)
   AND (r.include_genres IS NULL OR len(r.include_genres) = 0
        OR coalesce(list_has_any(c.genres, r.include_genres), false))
   AND (r.exclude_genres IS NULL OR NOT coalesce(list_has_any(c.genres, r.exclude_genres), false)))"""


def _knn_query(mode: str, k: int):
    def q(spark, sf):
        cat = sv.stored_catalog(spark, sf)
        res = knn_join(sv.requests(spark, sf), cat, k=k, mode=mode)
        out = res.join(cat.select("id", "tconst"), "id")
        cols = ["request_id", "rank", "tconst", _r6("similarity").alias("similarity")]
        if mode == "hybrid":
            cols.append(_r6("score").alias("score"))
        return out.select(*cols)
    return q


register("v4_knn_similarity", with_views("""
SELECT request_id, rank, tconst, round(similarity, 6) AS similarity FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY similarity DESC, id ASC) AS INTEGER) AS rank
  FROM cand) WHERE rank <= 10""", "catalog", "requests", ctes=[_KNN_CAND]))(_knn_query("similarity", 10))

register("v4_knn_hybrid", with_views("""
SELECT request_id, rank, tconst, round(similarity, 6) AS similarity, round(score, 6) AS score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id ASC) AS INTEGER) AS rank
  FROM (SELECT *, 0.60 * similarity + 0.30 * least(coalesce(rating, 0) / 10.0, 1.0)
                  + 0.10 * log10(greatest(coalesce(votes, 0), 1)) AS score FROM cand))
WHERE rank <= 5""", "catalog", "requests", ctes=[_KNN_CAND]))(_knn_query("hybrid", 5))


# ---- F1-F7 ----------------------------------------------------------------------------

@register("f1_title_type", with_views(
    "SELECT id, title_type FROM catalog WHERE lower(title_type) IN ('promo', 'economy')", "catalog"))
def f1_title_type(spark, sf):
    return flt.title_type_filter(sv.stored_catalog(spark, sf), ("promo", "economy")).select("id", "title_type")


@register("f2_range_filter", with_views("""
SELECT id FROM catalog WHERE start_year >= 1980 AND start_year <= 2010
  AND runtime_minutes <= 150 AND rating >= 5.0""", "catalog"))
def f2_range_filter(spark, sf):
    return flt.range_filter(sv.stored_catalog(spark, sf), 1980, 2010, 150, 5.0).select("id")


@register("f3_genre_filter", with_views("""
SELECT id FROM catalog WHERE coalesce(list_has_any(genres, ['red', 'hot']), false)
  AND NOT coalesce(list_has_any(genres, ['ring']), false)""", "catalog"))
def f3_genre_filter(spark, sf):
    return flt.genre_filter(sv.stored_catalog(spark, sf), ["red", "hot"], ["ring"]).select("id")


@register("f3_genre_filter_ci", with_views("""
SELECT id FROM catalog
WHERE coalesce(list_has_any(list_transform(genres, lambda x: lower(x)), ['red', 'gear']), false)""",
    "catalog"))
def f3_genre_filter_ci(spark, sf):
    return flt.genre_filter(sv.stored_catalog(spark, sf), ["RED", "Gear"], None,
                            case_sensitive=False).select("id")


@register("f4_actor_any", with_views("""
SELECT DISTINCT c.id FROM catalog c JOIN played ON played.movie_id = c.id
WHERE who IN ('supplier#000000003', 'supplier#000000011')""",
    "catalog", "cast_", "person", ctes=[PLAYED_SQL]))
def f4_actor_any(spark, sf):
    return flt.actor_any(sv.stored_catalog(spark, sf), sv.stored_cast(spark, sf), sv.stored_person(spark, sf),
                         ["supplier#000000003", "supplier#000000011"]).select("id")


@register("f5_actor_all", with_views("""
SELECT c.id FROM catalog c JOIN both_played ON both_played.movie_id = c.id""",
    "catalog", "cast_", "person", ctes=[PLAYED_SQL, BOTH_SQL]))
def f5_actor_all(spark, sf):
    return flt.actor_all(sv.stored_catalog(spark, sf), sv.stored_cast(spark, sf), sv.stored_person(spark, sf),
                         ["Supplier#000000003", "0000000 7", "Киану"]).select("id")


@register("f6_count_candidates", with_views("""
SELECT count(*) AS candidates FROM catalog
WHERE start_year >= 1975 AND rating >= 4.0
  AND coalesce(list_has_any(genres, ['red', 'blue']), false)
  AND NOT coalesce(list_has_any(genres, ['anvil']), false)""", "catalog"))
def f6_count_candidates(spark, sf):
    return flt.count_candidates(sv.stored_catalog(spark, sf), ["red", "blue"], ["anvil"],
                                from_year=1975, min_rating=4.0)


@register("f7_missing_embedding", with_views(
    "SELECT id, tconst FROM catalog WHERE embedding_model IS NULL ORDER BY id LIMIT 500", "catalog"))
def f7_missing_embedding(spark, sf):
    return flt.missing_embedding(sv.stored_catalog(spark, sf), 500).select("id", "tconst")


@register("f7_missing_plot", with_views(
    "SELECT id FROM catalog WHERE plot IS NULL ORDER BY id LIMIT 100", "catalog"))
def f7_missing_plot(spark, sf):
    return flt.missing_plot(sv.stored_catalog(spark, sf), limit=100).select("id")


# ---- W2 / W3 ---------------------------------------------------------------------------

@register("w2_first_per_key", with_views(
    "SELECT movie_id, person_id, category, ordering, tie FROM cast_", "cast_"))
def w2_first_per_key(spark, sf):
    return sv.cast(spark, sf)


@register("w3_top_cast", with_views("""
SELECT movie_id, array_to_string(actor_ids, '|') AS actor_ids,
       array_to_string(actor_names, '|') AS actor_names FROM top_cast""", "top_cast"))
def w3_top_cast(spark, sf):
    tc = top_cast(sv.stored_cast(spark, sf), sv.stored_person(spark, sf), 5)
    return tc.select("movie_id", _j("actor_ids").alias("actor_ids"),
                     _j("actor_names").alias("actor_names"))


# ---- V5 approximate kNN ---------------------------------------------------------------

#: Share of the cells that the registered approximate search probes; the
#: stand-in vectors are weakly clustered, so recall 0.9 takes most of them.
V5_PROBE = 0.7


@register("v5_approx_knn")
def v5_approx_knn(spark, sf):
    res = search_index(sv.requests(spark, sf), sv.stored_catalog(spark, sf), sv.stored_index(spark, sf), k=10,
                       nprobe=V5_PROBE, refine=4)
    return res.select("request_id", "rank", "id", F.round("similarity", 6).alias("similarity"))


@register("v5_full_probe", with_views("""
SELECT request_id, CAST(rank AS INTEGER) AS rank, id, round(similarity, 6) AS similarity FROM (
  SELECT r.request_id, c.id, list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(r.qvec AS DOUBLE[])) AS similarity,
         row_number() OVER (PARTITION BY r.request_id ORDER BY similarity DESC, c.id) AS rank
  FROM requests r JOIN catalog c ON c.embedding IS NOT NULL) WHERE rank <= 10""", "catalog", "requests"))
def v5_full_probe(spark, sf):
    """Every cell probed and every row scored again: the exact search."""
    res = search_index(sv.requests(spark, sf), sv.stored_catalog(spark, sf), sv.stored_index(spark, sf), k=10, nprobe=None, refine=None)
    return res.select("request_id", "rank", "id", F.round("similarity", 6).alias("similarity"))


# ---- V4 with per-request actor filters ----------------------------------------------

def actor_requests(spark, sf):
    """The request table with an actor filter on some rows: two fuzzy tokens,
    a token matching every person, and a name that strips to nothing."""
    lab = F.col("label")
    acts = (F.when(lab.isin(3, 8), F.array(F.lit("Supplier#000000003"), F.lit("0000000 7")))
            .when(lab == 1, F.array(F.lit("Supplier")))
            .when(lab == 5, F.array(F.lit("Киану"))))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("request_id"), acts.alias("actors"))
    return sv.requests(spark, sf).join(e, "request_id")


_AREQ_SQL = [
    """areq AS (
  SELECT r.*, CASE WHEN e.label IN (3, 8) THEN ['Supplier#000000003', '0000000 7']
                   WHEN e.label = 1 THEN ['Supplier'] WHEN e.label = 5 THEN ['Киану'] END AS actors
  FROM requests r JOIN embeddings e ON e.vec_id = r.request_id)""",
    """atok AS (
  SELECT *, list_distinct(list_filter(list_transform(coalesce(actors, []),
              lambda a: regexp_replace(lower(a), '[^a-z0-9]', '', 'g')), lambda t: t <> '')) AS tokens
  FROM areq)""",
    """rt AS (SELECT DISTINCT request_id, unnest(tokens) AS token FROM atok WHERE len(tokens) > 0)""",
    """mt AS (
  SELECT DISTINCT c.movie_id, t.token
  FROM cast_ c JOIN person p ON p.id = c.person_id
  JOIN (SELECT DISTINCT token FROM rt) t
    ON strpos(regexp_replace(lower(p.primary_name), '[^a-z0-9]', '', 'g'), t.token) > 0
  WHERE c.category IN ('actor', 'actress'))""",
    """elig AS (
  SELECT rt.request_id, mt.movie_id AS id FROM rt JOIN mt USING (token)
  JOIN (SELECT request_id, len(tokens) AS need FROM atok) n USING (request_id)
  GROUP BY rt.request_id, mt.movie_id, n.need HAVING count(*) = n.need)""",
    """cand AS (
  SELECT r.request_id, c.id, c.tconst,
         list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(r.qvec AS DOUBLE[])) AS similarity
  FROM atok r JOIN catalog c ON c.embedding IS NOT NULL
   AND (len(r.tokens) = 0 OR EXISTS (SELECT 1 FROM elig WHERE elig.request_id = r.request_id AND elig.id = c.id))
   AND (r.from_year IS NULL OR c.start_year >= r.from_year)
   AND (r.to_year IS NULL OR c.start_year <= r.to_year)
   AND (r.runtime_max IS NULL OR c.runtime_minutes <= r.runtime_max)
   AND (r.min_rating IS NULL OR c.rating >= r.min_rating)
   AND (r.include_genres IS NULL OR len(r.include_genres) = 0
        OR coalesce(list_has_any(c.genres, r.include_genres), false))
   AND (r.exclude_genres IS NULL OR NOT coalesce(list_has_any(c.genres, r.exclude_genres), false)))"""]


@register("v4_knn_actor_filter", with_views("""
SELECT request_id, rank, tconst, round(similarity, 6) AS similarity FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY similarity DESC, id ASC) AS INTEGER) AS rank
  FROM cand WHERE similarity IS NOT NULL) WHERE rank <= 5""", "catalog", "requests", "cast_", "person",
    ctes=_AREQ_SQL))
def v4_knn_actor_filter(spark, sf):
    cat = sv.stored_catalog(spark, sf)
    res = knn_join(actor_requests(spark, sf), cat, k=5, mode="similarity",
                   cast=sv.stored_cast(spark, sf), people=sv.stored_person(spark, sf))
    return (res.join(cat.select("id", "tconst"), "id")
            .select("request_id", "rank", "tconst", _r6("similarity").alias("similarity")))
