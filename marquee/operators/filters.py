"""Catalogue predicates.

Predicates for absent parameters are left out of the plan entirely instead of
being written as ``(:x IS NULL OR ...)``, so every remaining scalar bound is
pushed into the Parquet scan as a row-group filter.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The title types the catalogue keeps, and the cast categories
# that count as actors.
MOVIE_TITLE_TYPES = ("movie", "tvmovie")
ACTOR_CATEGORIES = ("actor", "actress")


def _all(preds: Sequence[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, preds) if preds else None


def title_type_filter(df: DataFrame, types: Iterable[str] = MOVIE_TITLE_TYPES,
                      col: str = "title_type") -> DataFrame:
    """lower(title_type) in the whitelist."""
    return df.filter(F.lower(F.col(col)).isin([t.lower() for t in types]))


def range_predicates(from_year=None, to_year=None, runtime_max=None,
                     min_rating=None) -> list[Column]:
    """F2 as a list of predicates; a NULL column fails any given bound."""
    preds = []
    if from_year is not None:
        preds.append(F.col("start_year") >= F.lit(from_year))
    if to_year is not None:
        preds.append(F.col("start_year") <= F.lit(to_year))
    if runtime_max is not None:
        preds.append(F.col("runtime_minutes") <= F.lit(runtime_max))
    if min_rating is not None:
        preds.append(F.col("rating") >= F.lit(float(min_rating)))
    return preds


def range_filter(df: DataFrame, from_year=None, to_year=None, runtime_max=None,
                 min_rating=None) -> DataFrame:
    """optional year / runtime / rating bounds."""
    p = _all(range_predicates(from_year, to_year, runtime_max, min_rating))
    return df if p is None else df.filter(p)


def _clean_list(values) -> list[str]:
    return [v for v in (values or []) if v is not None and str(v).strip() != ""]


def genre_predicates(include=None, exclude=None, case_sensitive: bool = True,
                     col: str = "genres") -> list[Column]:
    """include-any / exclude-any. A NULL genre array fails an include
    list and passes an exclude list."""
    inc, exc = _clean_list(include), _clean_list(exclude)
    g = F.col(col)
    if not case_sensitive:
        g = F.transform(g, lambda x: F.lower(x))
        inc = [v.lower() for v in inc]
        exc = [v.lower() for v in exc]
    preds = []
    if inc:
        preds.append(F.coalesce(F.arrays_overlap(g, F.array(*[F.lit(v) for v in inc])), F.lit(False)))
    if exc:
        preds.append(~F.coalesce(F.arrays_overlap(g, F.array(*[F.lit(v) for v in exc])), F.lit(False)))
    return preds


def genre_filter(df: DataFrame, include=None, exclude=None,
                 case_sensitive: bool = True, col: str = "genres") -> DataFrame:
    p = _all(genre_predicates(include, exclude, case_sensitive, col))
    return df if p is None else df.filter(p)


def actor_rows(cast: DataFrame, people: DataFrame) -> DataFrame:
    """(movie_id, person_id, ordering, nconst, primary_name) for actors."""
    c = cast.filter(F.col("category").isin(*ACTOR_CATEGORIES)).select(
        "movie_id", "person_id", "ordering")
    p = people.select(F.col("id").alias("person_id"), "nconst", "primary_name")
    return c.join(p, "person_id")


def actor_any(df: DataFrame, cast: DataFrame, people: DataFrame, names,
              id_col: str = "id") -> DataFrame:
    """keep movies where some actor's lower-cased name is one of names
    (exact, any-of). An empty list is no filter."""
    names = [n for n in _clean_list(names)]
    if not names:
        return df
    hits = (actor_rows(cast, people)
            .filter(F.lower("primary_name").isin(names))
            .select(F.col("movie_id").alias(id_col)))
    return df.join(hits, id_col, "left_semi")


def sanitize_actor_token(raw: str | None) -> str:
    """Lower-case and keep only [a-z0-9] (tokens that strip to empty, e.g.
    all-Cyrillic names, are then dropped by the caller)."""
    if raw is None:
        return ""
    return "".join(ch for ch in raw.lower() if ("a" <= ch <= "z") or ("0" <= ch <= "9"))


def stripped_name(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def actor_all(df: DataFrame, cast: DataFrame, people: DataFrame, names,
              id_col: str = "id") -> DataFrame:
    """for every requested name some actor's stripped lower name
    contains the stripped token.

    The token tests run on the people table first (far smaller than the
    cast), so only cast rows of matching people reach the join and the
    per-movie aggregation -- which is partial before the shuffle, so a movie
    with a huge cast costs no skew. A semi join keeps movies that match all
    tokens.
    """
    tokens = list(dict.fromkeys(t for t in (sanitize_actor_token(n) for n in (names or [])) if t))
    if not tokens:
        return df
    sname = stripped_name("primary_name")
    flags = [sname.contains(t).cast("int").alias(f"t{i}") for i, t in enumerate(tokens)]
    hits = (people.select(F.col("id").alias("person_id"), *flags)
            .filter(reduce(lambda a, b: a | b, [F.col(f"t{i}") == 1 for i in range(len(tokens))])))
    rows = (cast.filter(F.col("category").isin(*ACTOR_CATEGORIES))
            .select("movie_id", "person_id").join(hits, "person_id"))
    per_movie = rows.groupBy("movie_id").agg(*[F.max(f"t{i}").alias(f"t{i}") for i in range(len(tokens))])
    keep = per_movie.filter(_all([F.col(f"t{i}") == 1 for i in range(len(tokens))]))
    return df.join(keep.select(F.col("movie_id").alias(id_col)), id_col, "left_semi")


def count_candidates(df: DataFrame, include=None, exclude=None, from_year=None,
                     to_year=None, runtime_max=None, min_rating=None) -> DataFrame:
    """one-row count after F2 + F3 (no embedding or actor condition)."""
    f = genre_filter(range_filter(df, from_year, to_year, runtime_max, min_rating),
                     include, exclude)
    return f.agg(F.count(F.lit(1)).alias("candidates"))


def missing_plot(df: DataFrame, after_id: int | None = None,
                 limit: int | None = None) -> DataFrame:
    """rows without a plot, by id. Without ``limit`` the whole backlog is
    returned unordered -- partitions replace keyset paging."""
    f = df.filter(F.col("plot").isNull())
    if after_id is not None:
        f = f.filter(F.col("id") > F.lit(after_id))
    return f.orderBy("id").limit(limit) if limit else f


def missing_embedding(df: DataFrame, limit: int | None = None,
                      after_id: int | None = None) -> DataFrame:
    """rows whose embedding model is NULL, by id; a page of ``limit`` rows
    after ``after_id``, or the whole backlog unordered."""
    f = df.filter(F.col("embedding_model").isNull())
    if after_id is not None:
        f = f.filter(F.col("id") > F.lit(after_id))
    return f.orderBy("id").limit(limit) if limit else f
