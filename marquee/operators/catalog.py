"""Catalogue ETL: title typing (P1), principal cleaning (P2), global top-N
(W1), restriction to selected keys (J2), person dimension with stable ids
(J4), bridge build (J5) and import summary (A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators.cast import first_per_key
from marquee.operators.filters import MOVIE_TITLE_TYPES
from marquee.session import reliable_checkpoint

# Boolean spellings of the dumps and the kept cast categories.
TRUE_SPELLINGS = ("1", "t", "true", "TRUE")
FALSE_SPELLINGS = ("0", "f", "false", "FALSE")
KEPT_CATEGORIES = ("actor", "actress", "director", "writer")
DEFAULT_MAX_TITLES = 10_000


def _year(c: str, strict: bool):
    # strict: a bad year fails the load, as an unguarded cast does.
    return F.col(c).cast("smallint") if strict else F.expr(f"try_cast({c} AS smallint)")


def type_titles(basics: DataFrame, ratings: DataFrame | None = None,
                strict: bool = False) -> DataFrame:
    """P1 (+ J1): type the all-string title rows, LEFT JOIN the ratings.

    is_adult from {1,t,true,TRUE} / {0,f,false,FALSE}, else NULL; runtime
    kept only when it is an integer in smallint range; genres split on ',';
    rating double; votes int.
    """
    rt = F.col("runtime_minutes")
    typed = basics.select(
        "tconst", "title_type", "primary_title", "original_title",
        F.when(F.col("is_adult").isin(*TRUE_SPELLINGS), F.lit(True))
         .when(F.col("is_adult").isin(*FALSE_SPELLINGS), F.lit(False)).alias("is_adult"),
        _year("start_year", strict).alias("start_year"),
        _year("end_year", strict).alias("end_year"),
        F.when(rt.rlike(r"^-?\d+$") & (F.length(rt) <= 11),
               F.expr("try_cast(runtime_minutes AS bigint)")).alias("_rt"),
        F.split(F.col("genres"), ",").alias("genres"),
    )
    typed = typed.withColumn("runtime_minutes", F.when(
        F.col("_rt").between(-32768, 32767), F.col("_rt").cast("smallint"))).drop("_rt")
    if ratings is None:
        return typed
    r = ratings.select(F.col("tconst").alias("_rk"),
                       F.col("average_rating").cast("double").alias("rating"),
                       F.col("num_votes").cast("int").alias("votes"))
    return typed.join(r, typed["tconst"] == r["_rk"], "left").drop("_rk")


def clean_principals(raw: DataFrame) -> DataFrame:
    """lower(category); ordering only when all digits; drop NULL nconst;
    keep actor / actress / director / writer."""
    o = F.col("ordering")
    return (raw.select(
        "tconst", "nconst", F.lower("category").alias("category"),
        F.when(o.rlike(r"^\d+$"), F.expr("try_cast(ordering AS int)")).alias("ordering"),
        "job", "characters")
        .filter(F.col("nconst").isNotNull() & F.col("category").isin(*KEPT_CATEGORIES)))


def dedup_principals(clean: DataFrame) -> DataFrame:
    """W2 on principals: one row per (tconst, nconst, category), lowest
    ordering NULLS LAST; job, characters break remaining ties."""
    return first_per_key(clean, ["tconst", "nconst", "category"], "ordering",
                         ["job", "characters"])


def ranking_order():
    return [F.desc(F.coalesce(F.col("rating"), F.lit(-1.0))),
            F.desc(F.coalesce(F.col("votes").cast("bigint"), F.lit(0))),
            F.asc("tconst")]


def top_titles(titles: DataFrame, max_titles: int | None = DEFAULT_MAX_TITLES,
               title_types=MOVIE_TITLE_TYPES) -> DataFrame:
    """Keep movie / tvMovie titles, order by rating (NULL -> -1) DESC,
    votes (NULL -> 0) DESC, tconst; keep the first ``max_titles`` (<= 0 or
    None keeps all) and number them in ``rank``. ``titles`` carries rating and
    votes (P1 output).

    A bounded N plans as TakeOrderedAndProject (a per-partition top-N then
    one merge of N x partitions rows); the numbering is by range partitions,
    so no unpartitioned window gathers the catalogue in one task.
    """
    kept = kept_titles(titles, title_types)
    if max_titles and max_titles > 0:
        kept = kept.orderBy(*ranking_order()).limit(int(max_titles))
    return number_rows(kept, ranking_order(), "rank").withColumn("rank", F.col("rank").cast("int"))


def kept_titles(titles: DataFrame, title_types=MOVIE_TITLE_TYPES) -> DataFrame:
    """The titles of the kept types, all of them."""
    return titles.filter(F.lower(F.col("title_type")).isin([t.lower() for t in title_types]))


def number_rows(df: DataFrame, order, out: str, start: int | F.Column = 0) -> DataFrame:
    """``df`` with ``out`` = ``start`` + 1, 2, .. in ``order``.

    Rows are range-partitioned, numbered inside each partition and written to
    the shared checkpoint folder once; the offsets (one row per partition) and
    the numbered rows both come from that one copy, so they agree whatever the
    planner reuses or recomputes.
    """
    ranged = df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id())
    local = reliable_checkpoint(ranged.withColumn("_rn", F.row_number().over(
        Window.partitionBy("_pid").orderBy(*order))))
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start_col = start if isinstance(start, F.Column) else F.lit(int(start))
    return (local.join(F.broadcast(offsets.select("_pid", "_off")), "_pid")
            .withColumn(out, (start_col + F.col("_off") + F.col("_rn")).cast("bigint"))
            .drop("_pid", "_off", "_rn"))


def restrict_to(df: DataFrame, keys: DataFrame, key: str, bounded: bool = False) -> DataFrame:
    """Semi join with the selected keys; broadcast only when the caller
    knows the key set is bounded (e.g. a top-N with N <= 10,000)."""
    k = keys.select(key).distinct()
    return df.join(F.broadcast(k) if bounded else k, key, "left_semi")


def assign_ids(keys: DataFrame, key: str, id_col: str = "id",
               start: int | F.Column = 0) -> DataFrame:
    """Dense ids ``start + 1 ..`` of the distinct keys, in ``key`` order."""
    return number_rows(keys.select(key).distinct(), [F.col(key)], id_col, start).select(key, id_col)


def build_people(principals: DataFrame, names: DataFrame,
                 existing: DataFrame | None = None, last_id: int | None = None) -> DataFrame:
    """J4 (+ A1): DISTINCT nconst of the principals with name =
    COALESCE(name, nconst). People are only added or renamed: an existing
    person stays, with its id, whether or not the principals still name it;
    new nconsts get ``last_id`` + their rank in nconst order. ``last_id`` is
    the largest id ever given (default: the largest there is)."""
    n = names.select(F.col("nconst").alias("_nk"), "primary_name")
    people = (principals.select("nconst").filter(F.col("nconst").isNotNull()).distinct()
              .join(n, F.col("nconst") == F.col("_nk"), "left")
              .select("nconst", F.coalesce("primary_name", "nconst").alias("primary_name"))
              .dropDuplicates(["nconst"]))
    if existing is None:
        return assign_ids(people, "nconst").join(people, "nconst").select("id", "nconst", "primary_name")
    old = existing.select("id", F.col("nconst").alias("_ok"), F.col("primary_name").alias("_on"))
    known = old.join(people, people["nconst"] == old["_ok"], "left").select(
        "id", F.col("_ok").alias("nconst"), F.coalesce("primary_name", "_on").alias("primary_name"))
    fresh = people.join(old, people["nconst"] == old["_ok"], "left_anti")
    max_id = last_id if last_id is not None else existing.agg(F.max("id")).first()[0] or 0  # one scalar
    new_rows = assign_ids(fresh, "nconst", start=max_id).join(fresh, "nconst")
    return known.select("id", "nconst", "primary_name").unionByName(
        new_rows.select("id", "nconst", "primary_name"))


def build_bridge(principals: DataFrame, movies: DataFrame, people: DataFrame) -> DataFrame:
    """Resolve (tconst, nconst) to (movie_id, person_id), DISTINCT."""
    m = movies.select(F.col("id").alias("movie_id"), F.col("tconst").alias("_t"))
    p = people.select(F.col("id").alias("person_id"), F.col("nconst").alias("_n"))
    return (principals.join(m, principals["tconst"] == m["_t"])
            .join(p, principals["nconst"] == p["_n"])
            .select("movie_id", "person_id", "category", "ordering", "job", "characters")
            .distinct())


def import_summary(changes: DataFrame) -> DataFrame:
    """A4: rows per change kind of a snapshot sync."""
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))
