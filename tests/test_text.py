"""Golden rows from FIXTURES.md for the text and preference functions."""

from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from marquee.functions import text as tx
from marquee.operators.profiles import fold_profiles, parse_opinion, parse_tag_list
from marquee.operators.text import apply_translations, extract_mentions, route_language, title_case_runs


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "t string").select(col(F.col("t")).alias("o")).first().o


@pytest.mark.parametrize("text,names,exact", [
    ("Show me movies with Keanu Reeves please.", ["Keanu Reeves"], True),
    ("Хочу фильм с Киану Ривз или Томом Хэнксом.", ["Киану Ривз", "Томом Хэнксом"], False),
    ("фильм Киану", [], True),
    ("подскажи фильм свежий с бредом питтом", ["Бредом Питтом"], True),
    ("Need a movie with leonardo dicaprio and al pacino", ["Leonardo Dicaprio", "Al Pacino"], False),
])
def test_x1_golden(spark, text, names, exact):
    got = one(spark, extract_mentions, text)
    if exact:
        assert list(got) == names
    else:
        assert all(n in got for n in names)


def test_x1_long_runs(spark):
    """A run of words, however long, takes no stack of the matcher."""
    words = " ".join("Word" + chr(97 + i % 26) for i in range(30_000))
    assert list(one(spark, title_case_runs, words)) == [words]
    assert list(one(spark, extract_mentions, words)) == [words]
    assert list(one(spark, extract_mentions, "Ab Cd" + " Please" * 30_000)) == ["Ab Cd"]
    kept = "Ab Cd" + " Please" * 30_000 + " Ef"
    assert list(one(spark, extract_mentions, kept + " Pls")) == [kept]
    assert list(one(spark, extract_mentions, "Ab Cd" + " " * 60_000 + "Ef")) == ["Ab Cd Ef"]
    assert list(one(spark, extract_mentions, "actor ab and  and cd pleaser , ef gh и")) == ["Cd Pleaser"]


def test_x2_golden(spark):
    rec = ("Вот что могу предложить:\n1. <b>Властелин колец: Братство кольца</b> (2001) — Эпическая история."
           "\n2. <b>Лабиринт Фавна</b> (2006) — Сказка.")
    assert one(spark, tx.looks_like_recommendation, rec) is True
    assert one(spark, tx.looks_like_recommendation,
               "Какой жанр ты любишь? Расскажи про любимые фильмы.") is False


def test_x5_x6_golden(spark):
    out = one(spark, lambda c: tx.sanitize_message(c), "1. **Начало (2010)** — фильм")
    assert "<b>Начало (2010)</b>" in out and "**" not in out
    out = one(spark, lambda c: tx.sanitize_message(c, allow_html=True),
              "1. <b>Лабиринт Фавна</b> (2006) — Сказка.")
    assert "<b>Лабиринт Фавна</b>" in out and "&lt;b&gt;" not in out


def test_x3_x4_x7(spark):
    assert one(spark, tx.strip_code_fence, "```json\n{\"a\": 1}\n```") == '{"a": 1}'
    assert one(spark, tx.unescape_html, "&amp;lt;b&amp;gt;") == "<b>"
    assert one(spark, tx.html_to_plain, "a<br/>b <i>c</i> &amp;") == "a\nb c &"


@pytest.mark.parametrize("title,year,expected", [
    ("Властелин колец: Братство кольца (2024)", 2001, "Властелин колец: Братство кольца (2001)"),
    ("Лабиринт Фавна (2024)", None, "Лабиринт Фавна"),
    ("Хроники Нарнии: Лев, колдунья и платяной шкаф", 2005,
     "Хроники Нарнии: Лев, колдунья и платяной шкаф (2005)"),
    ("1917", 2019, "(2019)"),
    ("Title - 1999", None, "Title -"),
])
def test_p4_golden(spark, title, year, expected):
    df = spark.createDataFrame([(title, year)], "t string, y int")
    assert df.select(tx.format_title("t", "y").alias("o")).first().o == expected


def test_x10(spark):
    df = spark.createDataFrame([("Порекомендуй что-нибудь", 0), ("hmm", 2), ("hmm", 1)], "t string, n int")
    assert [r.o for r in df.select(tx.recommend_now("t", "n").alias("o")).collect()] == [True, True, False]


def test_x8_x9_golden(spark):
    rows = [(1, "привет бред питт", '{"language":"ru","confidence":0.98}', "en"),
            (2, "hello there", '{"language":"en","confidence":0.90}', "en"),
            (3, "Фильм на вечер", '{"language":"ru","confidence":0.73}', "en"),
            (4, "Need фильм for evening", '{"language":"en","confidence":0.91}', "en"),
            (5, "x", "not json", "en"),
            (6, "mixed язык", None, "en")]
    df = spark.createDataFrame(rows, "text_id long, text string, raw string, target_language string")
    tr = spark.createDataFrame([(1, "Hello Brad Pitt"), (3, "<<<A movie for the evening>>>")],
                               "text_id long, translated string")
    out = {r.text_id: r for r in apply_translations(route_language(df), tr).collect()}
    assert out[1].translation_needed and out[1].normalized_text == "Hello Brad Pitt" and out[1].language == "ru"
    assert not out[2].translation_needed and out[2].normalized_text == "hello there"
    assert out[2].notes == "Already in target language"
    assert out[3].normalized_text == "A movie for the evening"
    assert out[4].normalized_text == "Need фильм for evening" and out[4].language == "en"
    assert out[5].detected_language == "unknown" and out[5].notes == "Unable to determine language"
    assert out[6].normalized_text == "mixed язык" and out[6].language == "en"


def test_r1_golden(spark):
    assert list(one(spark, parse_tag_list, "/like_genre drama, comedy; noir")) == ["drama", "comedy", "noir"]
    assert list(one(spark, parse_tag_list, "drama, comedy")) == ["drama", "comedy"]
    assert list(one(spark, lambda c: parse_tag_list(c, strip_any_first_word=True),
                    "drama, comedy")) == ["comedy"]


def test_r3_golden(spark):
    t = lambda i: datetime(2024, 1, 1, 0, i)
    ev = [(1, 1, t(1), "add_genre", "Drama"), (2, 1, t(2), "add_actor", "Al  Pacino"),
          (3, 1, t(3), "add_genre", "drama"), (4, 1, t(4), "block", "horror"),
          (5, 1, t(5), "unblock", "DRAMA"),
          (6, 2, t(1), "add_genre", "noir"), (7, 2, t(2), "reset", None), (8, 2, t(3), "add_genre", "war")]
    df = spark.createDataFrame(ev, "event_id long, user_id long, ts timestamp, kind string, tag string")
    out = {r.user_id: r for r in fold_profiles(df).collect()}
    assert list(out[1].liked_genres) == [] and list(out[1].liked_actors) == ["al pacino"]
    assert list(out[1].blocked) == ["horror"]
    assert list(out[2].liked_genres) == ["war"]


@pytest.mark.parametrize("raw,title,opinion,ok", [
    ("Inception\nОтлично", "Inception", "Отлично", True),
    ("Dune; great", "Dune", "great", True),
    ("Dune – great", "Dune", "great", True),
    ("Dune", "Dune", "", True),
    ("   ", "", "", False),
])
def test_r4_golden(spark, raw, title, opinion, ok):
    r = spark.createDataFrame([(raw,)], "t string").select(parse_opinion("t").alias("p")).first().p
    assert (r.title, r.opinion, r.ok) == (title, opinion, ok)
