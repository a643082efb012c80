"""Registered queries for request sanitising, hit shaping and resource lookup
(P5, P6, S5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions.vector import cosine_literal
from marquee.operators.cast import top_cast
from marquee.operators.lookup import lookup_resources, metadata_text, sanitize_requests, shape_hits
from marquee.plans import standins as sv
from marquee.plans.registry import register
from marquee.plans.search_queries import PROBE_SQL, probe_vector
from marquee.plans.standins import with_views
from marquee.sources.tables import table

_JTRIM = r"regexp_replace({0}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def _clean_sql(col: str, lower: bool = False) -> str:
    item = _JTRIM.format("x")
    if lower:
        item = f"lower({item})"
    return (f"list_filter(list_transform(list_filter(coalesce({col}, []), lambda x: x IS NOT NULL), "
            f"lambda x: {item}), lambda x: x <> '')")


def search_requests(spark, sf):
    """Raw search requests derived from the user turns of ``conversations``."""
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        F.col("text").alias("query"),
        F.when(F.col("turn") % 4 != 0, (F.col("turn") * 5 - 10).cast("int")).alias("limit"),
        F.array(F.concat(F.lit(" "), F.col("role"), F.lit(" ")), F.lit("  "),
                F.lit(None).cast("string")).alias("include_genres"),
        F.when(F.col("turn") % 3 == 0, F.array(F.lit("Drama"), F.lit(None).cast("string")))
         .alias("exclude_genres"),
        F.array(F.concat(F.lit(" Star "), F.upper(F.col("role"))), F.lit(None).cast("string"),
                F.lit(" ")).alias("actors"),
    )


_REQ_SQL = """
req AS (
  SELECT conv_id * 1000 + turn AS request_id, text AS query,
         CASE WHEN turn % 4 <> 0 THEN CAST(turn * 5 - 10 AS INTEGER) END AS "limit",
         [' ' || role || ' ', '  ', NULL] AS include_genres,
         CASE WHEN turn % 3 = 0 THEN ['Drama', NULL] END AS exclude_genres,
         [' Star ' || upper(role), NULL, ' '] AS actors
  FROM conversations WHERE role = 'user')"""


@register("p6_sanitize_requests", f"""WITH {_REQ_SQL.strip()}
SELECT request_id, coalesce({_JTRIM.format('query')}, '') AS query,
       coalesce({_JTRIM.format('query')}, '') <> '' AS valid,
       CASE WHEN "limit" IS NULL THEN 15 ELSE least(greatest("limit", 1), 15) END AS "limit",
       array_to_string({_clean_sql('include_genres')}, '|') AS include_genres,
       array_to_string({_clean_sql('exclude_genres')}, '|') AS exclude_genres,
       array_to_string({_clean_sql('actors', True)}, '|') AS actors
FROM req""")
def p6_sanitize_requests(spark, sf):
    s = sanitize_requests(search_requests(spark, sf))
    return s.select("request_id", "query", "valid", "limit",
                    *[F.array_join(c, "|").alias(c)
                      for c in ("include_genres", "exclude_genres", "actors")])


@register("p5_shape_hits", with_views("""
SELECT c.tconst, array_to_string(list_filter(list_transform(c.genres, lambda x: trim(x)), lambda x: x <> ''), '|') AS genres,
       array_to_string(tc.actor_names, '|') AS actor_names,
       coalesce(round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(probe.q AS DOUBLE[])), 6), 0.0) AS similarity,
       concat_ws(';', 'plot=' || c.plot, 'titleType=' || c.title_type,
                 'runtimeMinutes=' || CAST(c.runtime_minutes AS VARCHAR),
                 'isAdult=' || lower(CAST(c.is_adult AS VARCHAR))) AS metadata
FROM catalog c CROSS JOIN probe LEFT JOIN top_cast tc ON tc.movie_id = c.id""",
    "catalog", "top_cast", ctes=[PROBE_SQL]))
def p5_shape_hits(spark, sf):
    cat = sv.stored_catalog(spark, sf)
    q = probe_vector(cat)
    tc = top_cast(sv.stored_cast(spark, sf), sv.stored_person(spark, sf), 5)
    hits = (cat.withColumn("similarity", F.round(cosine_literal("embedding", q), 6))
            .join(tc, cat["id"] == tc["movie_id"], "left"))
    s = shape_hits(hits)
    return s.select("tconst", F.array_join("genres", "|").alias("genres"),
                    F.array_join(F.transform("actors", lambda a: a["name"]), "|").alias("actor_names"),
                    "similarity", metadata_text().alias("metadata"))


def resource_requests(spark, sf):
    """Resource URIs derived from ``customer``: most point at catalogue ids
    (some beyond the catalogue), one segment uses a foreign scheme, one an
    empty id."""
    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    uri = (F.when(seg == "BUILDING", F.concat(F.lit("http://other/"), F.col("c_custkey").cast("string")))
           .when(seg == "MACHINERY", F.lit("imdb://movie/ "))
           .otherwise(F.concat(F.lit("imdb://movie/tt"),
                               F.lpad((F.col("c_custkey") * 2).cast("string"), 7, "0"))))
    return c.select(F.col("c_custkey").alias("pos"), uri.alias("uri"))


@register("s5_lookup_resources", with_views("""
SELECT u.pos, u.uri,
       CASE WHEN u.key IS NULL THEN 'unsupported' WHEN trim(u.key) = '' THEN 'missing_id'
            WHEN c.id IS NULL THEN 'not_found' ELSE 'found' END AS status,
       CASE WHEN u.key IS NULL THEN 'Unsupported resource'
            WHEN trim(u.key) = '' THEN 'Missing IMDb identifier'
            WHEN c.id IS NULL THEN 'Movie ' || u.key || ' not found.'
            ELSE 'Metadata for ' || c.primary_title END AS message,
       c.tconst, c.start_year AS year, c.rating, c.votes,
       CASE WHEN c.id IS NOT NULL THEN 1.0 END AS similarity,
       array_to_string(tc.actor_names, '|') AS actor_names
FROM u LEFT JOIN catalog c ON c.tconst = u.key
LEFT JOIN top_cast tc ON tc.movie_id = c.id""", "catalog", "top_cast", ctes=["""
u AS (
  SELECT pos, uri, CASE WHEN starts_with(uri, 'imdb://movie/') THEN substring(uri, 14) END AS key
  FROM (SELECT c_custkey AS pos,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 'http://other/' || CAST(c_custkey AS VARCHAR)
                    WHEN c_mktsegment = 'MACHINERY' THEN 'imdb://movie/ '
                    ELSE 'imdb://movie/tt' || lpad(CAST(c_custkey * 2 AS VARCHAR), 7, '0') END AS uri
        FROM customer))"""]))
def s5_lookup_resources(spark, sf):
    r = lookup_resources(resource_requests(spark, sf), sv.stored_catalog(spark, sf),
                         sv.stored_cast(spark, sf), sv.stored_person(spark, sf))
    return r.select("pos", "uri", "status", "message", "tconst",
                    F.col("start_year").alias("year"), "rating", "votes", "similarity",
                    F.array_join("actor_names", "|").alias("actor_names"))
