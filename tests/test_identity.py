"""Ids that are never given twice, children of deleted parents, numbering that
does not rest on exchange reuse, and the prompt texts' blank cases."""

import pytest
from pyspark.sql import functions as F

from marquee.operators.catalog import assign_ids, build_people, number_rows, top_titles
from marquee.operators.filters import missing_embedding
from marquee.operators.recommend import catalog_entry, compose_search, render_recs
from marquee.session import ensure_checkpoint_dir
from marquee.sources.snapshot import current_rows, replace_children, sync_snapshot


def people(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "nconst string")


def test_people_stay_and_ids_are_not_reused(spark):
    names = spark.createDataFrame([("nm1", "A"), ("nm5", "E")], "nconst string, primary_name string")
    one = build_people(people(spark, "nm1", "nm2"), names)
    two = build_people(people(spark, "nm1"), names, one)
    three = build_people(people(spark, "nm1", "nm5"), names, two)
    assert sorted(map(tuple, three.collect())) == [(1, "nm1", "A"), (2, "nm2", "nm2"), (3, "nm5", "E")]


def test_deleted_titles_keep_their_ids_and_lose_their_cast(spark):
    old = spark.createDataFrame([(1, "tt1"), (2, "tt9")], "id long, tconst string")
    new = spark.createDataFrame([("tt1",), ("tt5",)], "tconst string")
    now = current_rows(sync_snapshot(old, new, "tconst", last_id=2))
    assert sorted((r.id, r.tconst) for r in now.collect()) == [(1, "tt1"), (3, "tt5")]
    cast = spark.createDataFrame([(1, 10), (2, 11)], "movie_id long, person_id long")
    fresh = spark.createDataFrame([(3, 12)], "movie_id long, person_id long")
    out = replace_children(cast, fresh, fresh, alive=now.select(F.col("id").alias("movie_id")))
    assert sorted(map(tuple, out.collect())) == [(1, 10), (3, 12)]


def test_numbering_without_exchange_reuse(spark):
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        keys = spark.range(50_000).select(F.xxhash64("id").alias("k"))
        got = assign_ids(keys, "k").agg(F.countDistinct("id"), F.min("id"), F.max("id")).first()
        assert tuple(got) == (50_000, 1, 50_000)
        rows = number_rows(keys, [F.col("k").desc()], "n").orderBy("n").collect()
        assert [r.k for r in rows] == sorted((r.k for r in rows), reverse=True)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)


@pytest.mark.parametrize("n", [0, 2, None])
def test_ranks_for_any_limit(spark, n):
    t = spark.createDataFrame([("a", "movie", 5.0, 1), ("b", "movie", None, 9), ("c", "tvMovie", 5.0, 2), ("d", "short", 9.0, 9)],
                              "tconst string, title_type string, rating double, votes int")
    got = sorted((r["rank"], r.tconst) for r in top_titles(t, n).collect())
    assert got == [(1, "c"), (2, "a"), (3, "b")][:n or 3]


def test_embedding_backlog_has_no_default_page(spark):
    df = spark.range(700).withColumn("embedding_model", F.lit(None).cast("string"))
    assert missing_embedding(df).count() == 700
    assert [r.id for r in missing_embedding(df, 3, after_id=5).collect()] == [6, 7, 8]


def test_context_line_of_blank_and_missing_titles(spark):
    hit = "title string, tconst string, year int, rating double, genres array<string>, actor_names array<string>, plot string, similarity double"
    rows = spark.createDataFrame([("  ", "tt1", None, None, None, None, None, 0.5), (None, None, None, None, None, None, None, None)], hit)
    got = sorted(r[0] for r in rows.select(catalog_entry(F.lit(1))).collect())
    assert got == ["1) Title:  | Year: unknown | Similarity: 0.00 | IMDb ID: unknown",
                   "1) Title: tt1 | Year: unknown | Similarity: 0.50 | IMDb ID: tt1"]


def test_search_text_is_trimmed_and_replies_are_unescaped(spark):
    row = spark.createDataFrame(
        [("  hi  ", (None, ["moody"], None, None, None), None, None, None)],
        "user_text string, intent struct<rewritten_query:string,descriptors:array<string>,runtime_minutes:int,"
        "include_genres:array<string>,exclude_genres:array<string>>, profile_summary string, "
        "liked_genres array<string>, blocked array<string>")
    assert compose_search(row).first()["query"] == "hi | Vibe: moody"
    reply = spark.createDataFrame(
        [("{}", "", "rate <it>", [("Tom & Jerry", 1992, "cat's", ["a"])])],
        "raw string, intro string, reminder string, movies array<struct<title:string,year:int,reason:string,genres:array<string>>>")
    assert render_recs(reply).first()["rendered"] == \
        "1. <code>Tom & Jerry (1992)</code> — cat's\n\n<i>rate &lt;it&gt;</i>"


def test_checkpoint_folder_is_demanded_on_a_cluster(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
