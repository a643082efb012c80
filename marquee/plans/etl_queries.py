"""Registered queries for the catalogue bootstrap ETL (S1, P1, P2, W1, W2,
J1-J5, A1, A4, S3, S4).

The driver tables hold no dumps, so the staged all-string dump rows are
derived from them (part -> title rows, lineitem -> ratings and principals,
supplier -> names) with the dump oddities mixed in: quoted titles, NULLs,
bad runtimes, out-of-range runtimes, odd booleans, non-numeric orderings,
upper-case and unknown categories."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marquee.operators import catalog as cat_ops
from marquee.plans import standins as sv
from marquee.plans.registry import register
from marquee.session import reliable_checkpoint, scratch_path
from marquee.sources.dumps import read_dump, write_dump
from marquee.sources.snapshot import replace_children, sync_snapshot
from marquee.sources.store import create_store, import_round, read_store
from marquee.sources.tables import table

TOP_N = 300  # W1's report; every other query works on all kept titles


def _pad(c, prefix):
    return F.concat(F.lit(prefix), F.lpad(F.col(c).cast("string"), 7, "0"))


def stg_basics(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size")
    return p.select(
        _pad("p_partkey", "tt").alias("tconst"),
        F.when(F.col("p_type") == "ECONOMY", "movie").when(F.col("p_type") == "PROMO", "tvMovie")
         .when(F.col("p_type") == "SMALL", "short").otherwise(F.lower("p_type")).alias("title_type"),
        F.when(size == 13, F.concat(F.lit('"'), F.col("p_name"), F.lit('"')))
         .otherwise(F.col("p_name")).alias("primary_title"),
        F.col("p_name").alias("original_title"),
        F.when(size % 5 == 0, "1").when(size % 5 == 1, "f").when(size % 5 == 2, "TRUE")
         .when(size % 5 == 3, "yes").alias("is_adult"),
        F.when(size != 50, (F.lit(1970) + size).cast("string")).alias("start_year"),
        F.lit(None).cast("string").alias("end_year"),
        F.when(size % 7 == 0, "abc").when(size % 11 == 0, "99999").when(size % 13 == 0, "-5")
         .otherwise((size * 4).cast("string")).alias("runtime_minutes"),
        F.when(size % 9 != 0, F.regexp_replace("p_name", " ", ",")).alias("genres"),
    )


def stg_ratings(spark, sf):
    li = table(spark, sf, "lineitem")
    g = li.groupBy("l_partkey").agg(
        F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("s"),
        F.count(F.lit(1)).alias("n"))
    return g.select(
        _pad("l_partkey", "tt").alias("tconst"),
        (F.expr("(s * 10) div n") / 10.0).cast("string").alias("average_rating"),
        F.col("n").cast("string").alias("num_votes"))


def stg_principals(spark, sf):
    li = table(spark, sf, "lineitem")
    ln, rf = F.col("l_linenumber"), F.col("l_returnflag")
    return li.select(
        _pad("l_partkey", "tt").alias("tconst"),
        F.when(ln == 7, "x").when(ln != 6, ln.cast("string")).alias("ordering"),
        F.when(F.col("l_suppkey") % 50 != 49, _pad("l_suppkey", "nm")).alias("nconst"),
        F.when(rf == "A", "ACTOR").when(rf == "N", "actress")
         .when(F.col("l_linestatus") == "F", "editor").otherwise("Director").alias("category"),
        F.lit(None).cast("string").alias("job"),
        F.when(rf == "A", F.concat(F.lit('["'), F.col("l_orderkey").cast("string"), F.lit('"]')))
         .alias("characters"),
    )


def stg_names(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(_pad("s_suppkey", "nm").alias("nconst"),
                    F.when(F.col("s_nationkey") != 3, F.col("s_name")).alias("primary_name"),
                    *[F.lit(None).cast("string").alias(c) for c in
                      ("birth_year", "death_year", "primary_profession", "known_for_titles")])


STG_SQL = [
    """stg_basics AS (
  SELECT 'tt' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS tconst,
         CASE p_type WHEN 'ECONOMY' THEN 'movie' WHEN 'PROMO' THEN 'tvMovie'
                     WHEN 'SMALL' THEN 'short' ELSE lower(p_type) END AS title_type,
         CASE WHEN p_size = 13 THEN '"' || p_name || '"' ELSE p_name END AS primary_title,
         p_name AS original_title,
         CASE p_size % 5 WHEN 0 THEN '1' WHEN 1 THEN 'f' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'yes' END AS is_adult,
         CASE WHEN p_size <> 50 THEN CAST(1970 + p_size AS VARCHAR) END AS start_year,
         CAST(NULL AS VARCHAR) AS end_year,
         CASE WHEN p_size % 7 = 0 THEN 'abc' WHEN p_size % 11 = 0 THEN '99999'
              WHEN p_size % 13 = 0 THEN '-5' ELSE CAST(p_size * 4 AS VARCHAR) END AS runtime_minutes,
         CASE WHEN p_size % 9 <> 0 THEN replace(p_name, ' ', ',') END AS genres
  FROM part)""",
    """stg_ratings AS (
  SELECT 'tt' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS tconst,
         CAST((sum(CAST(round(l_discount * 100) AS BIGINT)) * 10 // count(*)) / 10.0 AS VARCHAR) AS average_rating,
         CAST(count(*) AS VARCHAR) AS num_votes
  FROM lineitem GROUP BY l_partkey)""",
    """stg_principals AS (
  SELECT 'tt' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS tconst,
         CASE WHEN l_linenumber = 7 THEN 'x' WHEN l_linenumber <> 6 THEN CAST(l_linenumber AS VARCHAR) END AS ordering,
         CASE WHEN l_suppkey % 50 <> 49 THEN 'nm' || lpad(CAST(l_suppkey AS VARCHAR), 7, '0') END AS nconst,
         CASE WHEN l_returnflag = 'A' THEN 'ACTOR' WHEN l_returnflag = 'N' THEN 'actress'
              WHEN l_linestatus = 'F' THEN 'editor' ELSE 'Director' END AS category,
         CAST(NULL AS VARCHAR) AS job,
         CASE WHEN l_returnflag = 'A' THEN '["' || CAST(l_orderkey AS VARCHAR) || '"]' END AS characters
  FROM lineitem)""",
    """stg_names AS (
  SELECT 'nm' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS nconst,
         CASE WHEN s_nationkey <> 3 THEN s_name END AS primary_name
  FROM supplier)""",
    """typed AS (
  SELECT b.tconst, b.title_type, b.primary_title, b.original_title,
         CASE WHEN b.is_adult IN ('1', 't', 'true', 'TRUE') THEN true
              WHEN b.is_adult IN ('0', 'f', 'false', 'FALSE') THEN false END AS is_adult,
         TRY_CAST(b.start_year AS SMALLINT) AS start_year, TRY_CAST(b.end_year AS SMALLINT) AS end_year,
         CASE WHEN regexp_full_match(b.runtime_minutes, '-?[0-9]+')
                   AND TRY_CAST(b.runtime_minutes AS BIGINT) BETWEEN -32768 AND 32767
              THEN CAST(b.runtime_minutes AS SMALLINT) END AS runtime_minutes,
         string_split(b.genres, ',') AS genres,
         CAST(r.average_rating AS DOUBLE) AS rating, CAST(r.num_votes AS INTEGER) AS votes
  FROM stg_basics b LEFT JOIN stg_ratings r ON r.tconst = b.tconst)""",
    """ranked AS (
  SELECT *, CAST(row_number() OVER (ORDER BY coalesce(rating, -1) DESC, coalesce(votes, 0) DESC, tconst) AS INTEGER) AS rank
  FROM typed WHERE lower(title_type) IN ('movie', 'tvmovie'))""",
    """clean AS (
  SELECT tconst, nconst, lower(category) AS category,
         CASE WHEN regexp_full_match(ordering, '[0-9]+') THEN TRY_CAST(ordering AS INTEGER) END AS ordering,
         job, characters
  FROM stg_principals
  WHERE nconst IS NOT NULL AND lower(category) IN ('actor', 'actress', 'director', 'writer'))""",
    """dedup AS (
  SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY tconst, nconst, category
      ORDER BY ordering ASC NULLS LAST, job ASC NULLS FIRST, characters ASC NULLS FIRST) = 1)""",
    """selected AS (SELECT tconst FROM ranked)""",
    """restricted AS (SELECT d.* FROM dedup d WHERE d.tconst IN (SELECT tconst FROM selected))""",
    """people AS (
  SELECT CAST(row_number() OVER (ORDER BY nconst) AS BIGINT) AS id, nconst, primary_name FROM (
    SELECT DISTINCT r.nconst, coalesce(n.primary_name, r.nconst) AS primary_name
    FROM (SELECT DISTINCT nconst FROM restricted) r LEFT JOIN stg_names n ON n.nconst = r.nconst))""",
    """bridge AS (
  SELECT DISTINCT CAST(substring(r.tconst, 3) AS BIGINT) AS movie_id, p.id AS person_id,
         r.category, r.ordering, r.job, r.characters
  FROM restricted r JOIN people p ON p.nconst = r.nconst)""",
]


def etl_sql(body: str, upto: str, views: tuple[str, ...] = (), extra: tuple[str, ...] = ()) -> str:
    """Oracle SQL: stand-in ``views``, the staged CTEs up to ``upto``, then
    ``extra`` CTEs and the final ``body``."""
    names = [c.split(" AS (", 1)[0] for c in STG_SQL]
    return sv.with_views(body, *views, ctes=list(STG_SQL[:names.index(upto) + 1]) + list(extra))


def typed_titles(spark, sf):
    return cat_ops.type_titles(stg_basics(spark, sf), stg_ratings(spark, sf))


def selected_titles(spark, sf):
    return cat_ops.kept_titles(typed_titles(spark, sf))


def restricted_principals(spark, sf):
    dedup = cat_ops.dedup_principals(cat_ops.clean_principals(stg_principals(spark, sf)))
    return cat_ops.restrict_to(dedup, selected_titles(spark, sf), "tconst")


def people_dim(spark, sf):
    return cat_ops.build_people(restricted_principals(spark, sf), stg_names(spark, sf))


def _movies_by_partkey(df):
    return df.select(F.expr("CAST(substring(tconst, 3) AS BIGINT)").alias("id"), "tconst")


@register("p1_type_titles", etl_sql("""
SELECT tconst, title_type, primary_title, is_adult, start_year, end_year, runtime_minutes,
       array_to_string(genres, '|') AS genres, rating, votes FROM typed""", "typed"))
def p1_type_titles(spark, sf):
    return typed_titles(spark, sf).select(
        "tconst", "title_type", "primary_title", "is_adult", "start_year", "end_year",
        "runtime_minutes", F.array_join("genres", "|").alias("genres"), "rating", "votes")


@register("s1_dump_roundtrip", etl_sql("""
SELECT tconst, title_type, primary_title, is_adult, start_year, runtime_minutes,
       array_to_string(genres, '|') AS genres FROM typed""", "typed"))
def s1_dump_roundtrip(spark, sf):
    """Derived title rows written as a gzip TSV dump and read back with the
    dump reader, then typed."""
    path = scratch_path(spark, f"dumps/{sf.strip('/').replace('/', '_')}/title_basics")
    write_dump(stg_basics(spark, sf), path)
    back = read_dump(spark, path, "title_basics")
    t = cat_ops.type_titles(back)
    return t.select("tconst", "title_type", "primary_title", "is_adult", "start_year",
                    "runtime_minutes", F.array_join("genres", "|").alias("genres"))


@register("w1_top_titles", etl_sql(
    f"SELECT rank, tconst, rating, votes FROM ranked WHERE rank <= {TOP_N}", "ranked"))
def w1_top_titles(spark, sf):
    return cat_ops.top_titles(typed_titles(spark, sf), TOP_N).select("rank", "tconst", "rating", "votes")


@register("p2_clean_principals", etl_sql(
    "SELECT tconst, nconst, category, ordering, characters FROM clean", "clean"))
def p2_clean_principals(spark, sf):
    return cat_ops.clean_principals(stg_principals(spark, sf)).select(
        "tconst", "nconst", "category", "ordering", "characters")


@register("w2_dedup_principals", etl_sql(
    "SELECT tconst, nconst, category, ordering, characters FROM dedup", "dedup"))
def w2_dedup_principals(spark, sf):
    return cat_ops.dedup_principals(cat_ops.clean_principals(stg_principals(spark, sf))).select(
        "tconst", "nconst", "category", "ordering", "characters")


@register("j2_restrict_selected", etl_sql(
    "SELECT tconst, nconst, category, ordering FROM restricted", "restricted"))
def j2_restrict_selected(spark, sf):
    return restricted_principals(spark, sf).select("tconst", "nconst", "category", "ordering")


@register("j4_build_people", etl_sql("SELECT id, nconst, primary_name FROM people", "people"))
def j4_build_people(spark, sf):
    return people_dim(spark, sf).select("id", "nconst", "primary_name")


@register("j5_build_bridge", etl_sql(
    "SELECT movie_id, person_id, category, ordering, characters FROM bridge", "bridge"))
def j5_build_bridge(spark, sf):
    b = cat_ops.build_bridge(restricted_principals(spark, sf),
                             _movies_by_partkey(selected_titles(spark, sf)), people_dim(spark, sf))
    return b.select("movie_id", "person_id", "category", "ordering", "characters")


@register("s4_replace_children", etl_sql("""
SELECT movie_id, person_id, category, ordering FROM cast_
WHERE movie_id NOT IN (SELECT CAST(substring(tconst, 3) AS BIGINT) FROM selected)
UNION
SELECT DISTINCT movie_id, person_id, category, ordering FROM bridge""", "bridge", ("cast_",)))
def s4_replace_children(spark, sf):
    existing = sv.cast(spark, sf).select("movie_id", "person_id", "category", "ordering")
    fresh = cat_ops.build_bridge(restricted_principals(spark, sf),
                                 _movies_by_partkey(selected_titles(spark, sf)),
                                 people_dim(spark, sf))
    parents = _movies_by_partkey(selected_titles(spark, sf)).select(F.col("id").alias("movie_id"))
    return replace_children(existing, parents, fresh).distinct()


# Titles without a year come under another key in the new dump: a delete and
# an insert each.
_SYNC_CTES = ("""tgt AS (SELECT * FROM catalog)""",
              """src AS (SELECT * EXCLUDE (rank) REPLACE (
                  CASE WHEN start_year IS NULL THEN 'x' || tconst ELSE tconst END AS tconst) FROM ranked)""",
              """j AS (
  SELECT coalesce(s.tconst, t.tconst) AS tconst, t.id AS old_id,
         CASE WHEN t.tconst IS NULL THEN 'insert' WHEN s.tconst IS NULL THEN 'delete'
              WHEN t.title_type IS NOT DISTINCT FROM s.title_type
               AND t.primary_title IS NOT DISTINCT FROM s.primary_title
               AND t.original_title IS NOT DISTINCT FROM s.original_title
               AND t.is_adult IS NOT DISTINCT FROM s.is_adult
               AND t.start_year IS NOT DISTINCT FROM s.start_year
               AND t.end_year IS NOT DISTINCT FROM s.end_year
               AND t.runtime_minutes IS NOT DISTINCT FROM s.runtime_minutes
               AND t.genres IS NOT DISTINCT FROM s.genres
               AND t.rating IS NOT DISTINCT FROM s.rating
               AND t.votes IS NOT DISTINCT FROM s.votes THEN 'unchanged' ELSE 'update' END AS change,
         CASE WHEN s.tconst IS NOT NULL THEN s.votes ELSE t.votes END AS votes,
         t.plot, t.embedding_model
  FROM tgt t FULL OUTER JOIN src s ON s.tconst = t.tconst)""")


def _sync(spark, sf):
    # the current catalogue version is the stored table (as the ETL wrote it)
    target = sv.stored_catalog(spark, sf)
    source = selected_titles(spark, sf).withColumn("tconst", F.when(
        F.col("start_year").isNull(), F.concat(F.lit("x"), "tconst")).otherwise(F.col("tconst")))
    return sync_snapshot(target, source, "tconst")


@register("s3_sync_snapshot", etl_sql("""
SELECT tconst, change, votes, plot, embedding_model,
       CAST(coalesce(old_id, (SELECT max(id) FROM tgt)
                + row_number() OVER (PARTITION BY old_id IS NULL ORDER BY tconst)) AS BIGINT) AS id
FROM j""", "ranked", ("catalog",), _SYNC_CTES))
def s3_sync_snapshot(spark, sf):
    return _sync(spark, sf).select("tconst", "change", "votes", "plot", "embedding_model", "id")


@register("a4_import_summary", etl_sql(
    "SELECT change, count(*) AS n FROM j GROUP BY change", "ranked", ("catalog",), _SYNC_CTES))
def a4_import_summary(spark, sf):
    return cat_ops.import_summary(_sync(spark, sf))


# ---- three import rounds into the versioned store (S3, J4, J5, S4 in a chain) ----------------

# The n-th dump has the titles whose number is no multiple of 2 + n, and some
# with more votes; titles leave, return and are new.
ROUNDS_SQL = ("num AS (SELECT *, CAST(substring(tconst, 3) AS BIGINT) AS k FROM ranked)",
              "r1 AS (SELECT tconst, k, row_number() OVER (ORDER BY tconst) AS id FROM num WHERE k % 3 <> 0)",
              """r2 AS (
  SELECT n.tconst, n.k, coalesce(r1.id, (SELECT count(*) FROM r1)
           + row_number() OVER (PARTITION BY r1.id IS NULL ORDER BY n.tconst)) AS id
  FROM num n LEFT JOIN r1 USING (tconst) WHERE n.k % 4 <> 0)""",
              """r3 AS (
  SELECT n.tconst, n.k, n.votes, r2.id AS old, coalesce(r2.id, greatest((SELECT max(id) FROM r2), (SELECT max(id) FROM r1))
           + row_number() OVER (PARTITION BY r2.id IS NULL ORDER BY n.tconst)) AS id
  FROM num n LEFT JOIN r2 USING (tconst) WHERE n.k % 5 <> 0)""",
              """cast3 AS (
  SELECT tconst, count(*) AS n_cast FROM (SELECT DISTINCT tconst, nconst, category, ordering, job, characters FROM restricted) GROUP BY tconst)""",
              "ever AS (SELECT nconst, min(CASE WHEN k % 3 <> 0 THEN 1 WHEN k % 4 <> 0 THEN 2 ELSE 3 END) AS r "
              "FROM restricted JOIN num USING (tconst) WHERE k % 3 <> 0 OR k % 4 <> 0 OR k % 5 <> 0 GROUP BY nconst)",
              "person_id AS (SELECT nconst, row_number() OVER (ORDER BY r, nconst) AS id FROM ever)",
              "first_person AS (SELECT tconst, min(id) AS first_person FROM restricted JOIN person_id USING (nconst) GROUP BY tconst)")


@register("s3_import_rounds", etl_sql("""
SELECT tconst, id, CASE WHEN old IS NULL THEN 'insert' WHEN k % 7 = 0 THEN 'update' ELSE 'unchanged' END AS change,
       CAST(votes + CASE WHEN k % 7 = 0 THEN 3 ELSE 0 END AS INTEGER) AS votes,
       CAST(coalesce(n_cast, 0) AS BIGINT) AS n_cast, first_person
FROM r3 LEFT JOIN cast3 USING (tconst) LEFT JOIN first_person USING (tconst)
UNION ALL SELECT tconst, id, 'delete', NULL, 0, NULL FROM r2 WHERE k % 5 = 0""", "restricted", ("ranked",), ROUNDS_SQL))
def s3_import_rounds(spark, sf):
    path = scratch_path(spark, f"store/{uuid.uuid4().hex}")
    number = F.expr("CAST(substring(tconst, 3) AS BIGINT)")
    titles = reliable_checkpoint(selected_titles(spark, sf).drop("rank"))
    principals, names = reliable_checkpoint(restricted_principals(spark, sf)), stg_names(spark, sf)
    create_store(spark, path)
    for n in (1, 2, 3):
        dump = titles.where(number % (2 + n) != 0).withColumn(
            "votes", F.when(number % 7 == 0, F.col("votes") + n).otherwise(F.col("votes")).cast("int"))
        import_round(spark, path, dump, principals.join(dump.select("tconst"), "tconst", "left_semi"), names)
    changes, cast = read_store(spark, path, "changes"), read_store(spark, path, "cast")
    per = cast.groupBy("movie_id").agg(F.count("*").alias("n_cast"), F.min("person_id").alias("first_person"))
    gone = F.col("change") == "delete"
    return changes.join(per, F.col("id") == F.col("movie_id"), "left").select(
        "tconst", "id", "change", F.when(~gone, F.col("votes")).alias("votes"),
        F.coalesce("n_cast", F.lit(0)).alias("n_cast"), "first_person")
