"""Registered queries for preferences, opinions, history and the task queue
(R1-R6, R15, W4-W7).

Stand-ins: ``pref_event`` from ``events`` (event type -> kind, tag picked by
the props key), opinions from ``events`` and ``conversations``, messages from
``conversations``, tasks from ``orders``, task events from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators.history import chat_history
from marquee.operators.profiles import (append_opinions, explode_tags, fold_profiles,
                                        normalize_tag, parse_opinions, profile_summary)
from marquee.operators.tasks import active_queue, resume_batch, task_state
from marquee.plans.lookup_queries import _JTRIM
from marquee.plans.registry import register
from marquee.sources.tables import table

# Fixed values of the stand-in: the tag picked by props key k is TAGS[k % 10].
TAGS = ["Drama", " comedy ", "NOIR", "war", "Horror", "al  pacino", "Keanu Reeves",
        "sci-fi", " ", "Western"]
_TAGS_SQL = "[" + ", ".join("'" + t + "'" for t in TAGS) + "]"


def pref_events(spark, sf):
    e = table(spark, sf, "events")
    et = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (F.when(et == "click", "add_genre")
            .when((et == "view") & (F.col("value") > 25), "add_director")
            .when(et == "view", "add_actor").when(et == "purchase", "block")
            .when(et == "signup", "unblock").otherwise("reset"))
    tags = F.array(*[F.lit(t) for t in TAGS])
    return e.select("event_id", "user_id", "ts", kind.alias("kind"),
                    F.element_at(tags, k % 10 + 1).alias("tag"))


PREF_SQL = f"""pref_event AS (
  SELECT event_id, user_id, ts,
         CASE WHEN event_type = 'click' THEN 'add_genre'
              WHEN event_type = 'view' AND value > 25 THEN 'add_director'
              WHEN event_type = 'view' THEN 'add_actor' WHEN event_type = 'purchase' THEN 'block'
              WHEN event_type = 'signup' THEN 'unblock' ELSE 'reset' END AS kind,
         {_TAGS_SQL}[CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 + 1] AS tag
  FROM events)"""

_NORM = "lower(regexp_replace(" + _JTRIM.format("{0}") + r", '\s+', ' ', 'g'))"

FOLD_SQL = [PREF_SQL, f"""ev AS (
  SELECT *, {_NORM.format('tag')} AS ntag,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM pref_event)""",
            """lr AS (SELECT user_id, max(pos) AS rpos FROM ev WHERE kind = 'reset' GROUP BY user_id)""",
            """eff AS (SELECT ev.* FROM ev LEFT JOIN lr USING (user_id)
            WHERE (lr.rpos IS NULL OR ev.pos > lr.rpos) AND ev.ntag <> ''
              AND ev.kind IN ('add_genre', 'add_actor', 'add_director', 'block', 'unblock'))""",
            """ops AS (
  SELECT user_id, ntag, pos, kind <> 'unblock' AS is_add,
         unnest(CASE kind WHEN 'add_genre' THEN ['genre'] WHEN 'add_actor' THEN ['actor']
                          WHEN 'add_director' THEN ['director'] WHEN 'block' THEN ['blocked']
                          ELSE ['genre', 'actor', 'director', 'blocked'] END) AS set_kind
  FROM eff)""",
            """lastop AS (SELECT user_id, set_kind, ntag, arg_max(is_add, pos) AS present
           FROM ops GROUP BY ALL)""",
            """folded AS (
  SELECT u.user_id,
         coalesce(list_sort(list(l.ntag) FILTER (WHERE l.set_kind = 'genre' AND l.present)), []) AS liked_genres,
         coalesce(list_sort(list(l.ntag) FILTER (WHERE l.set_kind = 'actor' AND l.present)), []) AS liked_actors,
         coalesce(list_sort(list(l.ntag) FILTER (WHERE l.set_kind = 'director' AND l.present)), []) AS liked_directors,
         coalesce(list_sort(list(l.ntag) FILTER (WHERE l.set_kind = 'blocked' AND l.present)), []) AS blocked
  FROM (SELECT DISTINCT user_id FROM pref_event) u LEFT JOIN lastop l USING (user_id)
  GROUP BY u.user_id)"""]


def _with(ctes, body):
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()


def _j(c):
    return F.array_join(c, "|").alias(c)


@register("r1_explode_tags", _with([f"""cmd AS (
  SELECT conv_id * 1000 + turn AS cmd_id, '/like_genre ' || text AS text
  FROM conversations WHERE role = 'user')""", f"""parts AS (
  SELECT cmd_id, list_filter(list_transform(
           string_split_regex(regexp_replace(text, '^/\\S*(\\s|$)', ''), '[,;\\n]'),
           lambda x: {_JTRIM.format('x')}), lambda x: x <> '') AS tags FROM cmd)"""],
    "SELECT cmd_id, CAST(generate_subscripts(tags, 1) - 1 AS INTEGER) AS pos, unnest(tags) AS tag FROM parts"))
def r1_explode_tags(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    cmds = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("cmd_id"),
                    F.concat(F.lit("/like_genre "), F.col("text")).alias("text"))
    return explode_tags(cmds).select("cmd_id", "pos", "tag")


@register("r2_normalize_tags", _with([PREF_SQL],
    f"SELECT DISTINCT tag AS raw_tag, {_NORM.format('tag')} AS tag FROM pref_event"))
def r2_normalize_tags(spark, sf):
    p = pref_events(spark, sf)
    return p.select(F.col("tag").alias("raw_tag"), normalize_tag("tag").alias("tag")).distinct()


@register("r3_fold_profiles", _with(FOLD_SQL, """
SELECT user_id, array_to_string(liked_genres, '|') AS liked_genres,
       array_to_string(liked_actors, '|') AS liked_actors,
       array_to_string(liked_directors, '|') AS liked_directors,
       array_to_string(blocked, '|') AS blocked FROM folded"""))
def r3_fold_profiles(spark, sf):
    f = fold_profiles(pref_events(spark, sf))
    return f.select("user_id", *[_j(c) for c in ("liked_genres", "liked_actors", "liked_directors", "blocked")])


def _opinion_sql(src: str) -> str:
    t = _JTRIM.format("raw")
    line = r"'(?s)^(.*?)\r?\n(.*)$'"
    semi = r"'(?s)^(.*?)\s*;\s*(.*)$'"
    dash = r"'(?s)^(.*?)\s*[–—-]\s*(.*)$'"
    return f"""
  SELECT *, {_JTRIM.format('p_title')} AS title, {_JTRIM.format('p_op')} AS opinion,
         t <> '' AND {_JTRIM.format('p_title')} <> '' AS ok
  FROM (SELECT *,
          CASE WHEN regexp_matches(t, '\\r?\\n') THEN regexp_extract(t, {line}, 1)
               WHEN regexp_matches(t, ';') THEN regexp_extract(t, {semi}, 1)
               WHEN regexp_matches(t, '[–—-]') THEN regexp_extract(t, {dash}, 1) ELSE t END AS p_title,
          CASE WHEN regexp_matches(t, '\\r?\\n') THEN regexp_extract(t, {line}, 2)
               WHEN regexp_matches(t, ';') THEN regexp_extract(t, {semi}, 2)
               WHEN regexp_matches(t, '[–—-]') THEN regexp_extract(t, {dash}, 2) ELSE '' END AS p_op
        FROM (SELECT *, {t} AS t FROM ({src})))"""


@register("r4_parse_opinions", _with([f"""parsed AS ({_opinion_sql(
    "SELECT conv_id, turn, coalesce(text, '') AS raw FROM conversations WHERE role = 'user'")})"""],
    "SELECT conv_id, turn, title, opinion, ok FROM parsed"))
def r4_parse_opinions(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    return parse_opinions(c.select("conv_id", "turn", F.col("text").alias("raw"))).select(
        "conv_id", "turn", "title", "opinion", "ok")


def opinion_events(spark, sf):
    e = table(spark, sf, "events")
    et = F.col("event_type")
    raw = (F.when(et == "error", F.lit("   "))
           .when(et == "signup", F.concat(F.lit(" - "), F.col("props")))
           .otherwise(F.concat(et, F.lit(" - "), F.col("props"))))
    return e.select("event_id", "user_id", "ts", raw.alias("raw"))


_OPEV_SQL = """SELECT event_id, user_id, ts,
  CASE WHEN event_type = 'error' THEN '   ' WHEN event_type = 'signup' THEN ' - ' || props
       ELSE event_type || ' - ' || props END AS raw FROM events"""

OPINION_SQL = [PREF_SQL, f"""op_parsed AS ({_opinion_sql(_OPEV_SQL)})""",
               """resets AS (SELECT user_id, max(pos) AS rpos FROM (
  SELECT user_id, kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos
  FROM pref_event) WHERE kind = 'reset' GROUP BY user_id)""",
               """op_pos AS (SELECT o.*, p.pos FROM op_parsed o JOIN (
  SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM pref_event) p
  USING (event_id))""",
               """stored AS (
  SELECT user_id, ts, event_id, coalesce(nullif(title, ''), 'неизвестно') AS title, nullif(opinion, '') AS opinion
  FROM op_pos LEFT JOIN resets USING (user_id)
  WHERE ok AND (resets.rpos IS NULL OR op_pos.pos > resets.rpos)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50)"""]


def stored_opinions(spark, sf):
    parsed = parse_opinions(opinion_events(spark, sf)).filter("ok")
    resets = pref_events(spark, sf).filter(F.col("kind") == "reset")
    return append_opinions(parsed, resets)


@register("r5_append_opinions", _with(OPINION_SQL,
    "SELECT user_id, event_id, title, opinion FROM stored"))
def r5_append_opinions(spark, sf):
    return stored_opinions(spark, sf).select("user_id", "event_id", "title", "opinion")


SUMMARY_SQL = FOLD_SQL + OPINION_SQL[1:] + ["""recent AS (
  SELECT user_id, string_agg(CASE WHEN coalesce(opinion, '') = '' THEN title
                                  ELSE title || ' — ' || opinion END, '; ' ORDER BY ts DESC, event_id DESC) AS r
  FROM (SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5)
  GROUP BY user_id)""", """summary AS (
  SELECT f.user_id, trim(concat_ws(' ',
    CASE WHEN len(liked_genres) > 0 THEN 'Preferred genres: [' || array_to_string(liked_genres, ', ') || '].' END,
    CASE WHEN len(liked_actors) > 0 THEN 'Favorite actors: [' || array_to_string(liked_actors, ', ') || '].' END,
    CASE WHEN len(liked_directors) > 0 THEN 'Favorite directors: [' || array_to_string(liked_directors, ', ') || '].' END,
    CASE WHEN len(blocked) > 0 THEN 'Block list: [' || array_to_string(blocked, ', ') || '].' END,
    CASE WHEN coalesce(r.r, '') <> '' THEN 'Recent opinions: ' || r.r || '.' END)) AS summary
  FROM folded f LEFT JOIN recent r USING (user_id))"""]


@register("r6_profile_summary", _with(SUMMARY_SQL, "SELECT user_id, summary FROM summary"))
def r6_profile_summary(spark, sf):
    return profile_summary(fold_profiles(pref_events(spark, sf)), stored_opinions(spark, sf))


def messages(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.col("turn").alias("id"), F.col("conv_id").alias("chat_id"), "text",
                    F.col("turn").alias("created_at"))


@register("w4_chat_history", f"""
SELECT chat_id, string_agg(CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END,
                           chr(10) ORDER BY turn) AS history
FROM (SELECT conv_id AS chat_id, turn, text FROM conversations
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 30)
GROUP BY chat_id""")
def w4_chat_history(spark, sf):
    return chat_history(messages(spark, sf), 30, 300)


def tasks(spark, sf):
    o = table(spark, sf, "orders")
    st = (F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "P", "RUNNING")
          .otherwise("DONE"))
    return o.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("chat_id"),
                    st.alias("status"), F.col("o_orderdate").alias("created_at"),
                    F.when(F.col("o_orderstatus") != "O",
                           F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("started_at"))


_TASK_SQL = """task AS (
  SELECT o_orderkey AS task_id, o_custkey AS chat_id,
         CASE o_orderstatus WHEN 'O' THEN 'QUEUED' WHEN 'P' THEN 'RUNNING' ELSE 'DONE' END AS status,
         o_orderdate AS created_at,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 HOUR END AS started_at
  FROM orders)"""


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


@register("w6_active_queue", _with([_TASK_SQL], """
SELECT chat_id, CAST(row_number() OVER (PARTITION BY chat_id ORDER BY created_at, task_id) AS INTEGER) AS position,
       task_id, status FROM task WHERE status IN ('QUEUED', 'RUNNING')"""))
def w6_active_queue(spark, sf):
    return active_queue(tasks(spark, sf)).select("chat_id", "position", "task_id", "status")


@register("w7_resume_batch", _with([_TASK_SQL], f"""
SELECT task_id, 'QUEUED' AS status, CAST(NULL AS VARCHAR) AS started_at, {_TS.format('created_at')}
FROM (SELECT * FROM task WHERE status IN ('QUEUED', 'RUNNING') ORDER BY created_at, task_id LIMIT 100)"""))
def w7_resume_batch(spark, sf):
    return resume_batch(tasks(spark, sf), 100).select("task_id", "status", _ts("started_at"), _ts("created_at"))


def task_events(spark, sf):
    li = table(spark, sf, "lineitem")
    st = (F.when(F.col("l_linenumber") == 1, "QUEUED").when(F.col("l_returnflag") == "R", "FAILED")
          .when(F.col("l_linestatus") == "F", "DONE").otherwise("RUNNING"))
    return li.select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("event_id"),
                     F.col("l_shipdate").alias("ts"), st.alias("status"))


@register("r15_task_state", _with(["""tev AS (
  SELECT l_orderkey AS task_id, l_linenumber AS event_id, l_shipdate AS ts,
         CASE WHEN l_linenumber = 1 THEN 'QUEUED' WHEN l_returnflag = 'R' THEN 'FAILED'
              WHEN l_linestatus = 'F' THEN 'DONE' ELSE 'RUNNING' END AS status FROM lineitem)""",
    """st AS (
  SELECT task_id, first(status ORDER BY ts DESC, event_id DESC, status DESC) AS status, max(ts) AS last_ts,
         min(ts) FILTER (WHERE status = 'QUEUED') AS created_at,
         max(ts) FILTER (WHERE status = 'RUNNING') AS started_at
  FROM tev GROUP BY task_id)"""], f"""
SELECT task_id, status, {_TS.format('created_at')}, {_TS.format('started_at')},
       strftime(CASE WHEN status IN ('DONE', 'FAILED') THEN last_ts END, '%Y-%m-%d %H:%M:%S') AS finished_at,
       status IN ('QUEUED', 'RUNNING') AS active
FROM st"""))
def r15_task_state(spark, sf):
    s = task_state(task_events(spark, sf))
    return s.select("task_id", "status", _ts("created_at"), _ts("started_at"), _ts("finished_at"), "active")
