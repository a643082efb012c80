"""Registered queries for the streaming family (T1-T4) and the complaint
sink (S6). Streams run over inputs Spark derives from the driver tables,
written under the shared checkpoint folder and replayed with
``availableNow`` triggers in bounded micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.plans.lookup_queries import _JTRIM
from marquee.plans.profile_queries import _opinion_sql, task_events
from marquee.plans.registry import ORACLE, register
from marquee.sources.sinks import complaint_batch_writer, complaint_table, read_complaints
from marquee.sources.tables import table
from marquee.streaming.chat import chat_sessions, classify_updates, dialog_turns, join_replies
from marquee.streaming.jobs import (append_messages, materialize_input, read_stream, run_dir,
                                    run_foreach_batch, run_to_parquet, task_stream)


def updates(spark, sf):
    """Chat updates derived from conversation turns: menu and report
    callbacks, a slash command, blank messages, free text."""
    c = table(spark, sf, "conversations")
    k = F.col("turn") % 7
    cb = (F.when(k == 1, "menu:add_genre").when(k == 3, "report:start")
          .when(k == 5, "menu:add_opinion"))
    text = F.when(cb.isNull(), F.when(k == 2, F.lit("/Profile now")).when(k == 6, F.lit("   "))
                  .otherwise(F.col("text")))
    return c.select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("update_id"),
                    F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60).alias("ts"),
                    cb.alias("callback_data"), text.alias("text"),
                    F.col("text").alias("reply_to_text"))


@register("t1_classify_updates", r"""
SELECT chat_id, update_id,
  CASE WHEN cb = 'report:start' THEN 'report_callback' WHEN cb IS NOT NULL THEN 'menu_callback'
       WHEN text IS NULL THEN 'ignored' WHEN starts_with(t, '/') THEN 'command' ELSE 'free_text' END AS kind,
  CASE WHEN cb IS NULL AND text IS NOT NULL AND starts_with(t, '/')
       THEN lower(string_split_regex(t, '\s+')[1]) END AS command
FROM (SELECT *, regexp_replace(coalesce(text, ''), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS t FROM (
  SELECT conv_id AS chat_id, turn AS update_id,
         CASE WHEN turn % 7 = 1 THEN 'menu:add_genre' WHEN turn % 7 = 3 THEN 'report:start'
              WHEN turn % 7 = 5 THEN 'menu:add_opinion' END AS cb,
         CASE WHEN turn % 7 IN (1, 3, 5) THEN NULL WHEN turn % 7 = 2 THEN '/Profile now'
              WHEN turn % 7 = 6 THEN '   ' ELSE text END AS text
  FROM conversations))""")
def t1_classify_updates(spark, sf):
    return classify_updates(updates(spark, sf)).select("chat_id", "update_id", "kind", "command")


def session_updates(spark, sf):
    """Updates of longer chats (four conversations each) that meet every
    callback and command: the action is picked by conversation and turn."""
    c = table(spark, sf, "conversations").withColumn("k", F.pmod(F.col("conv_id") * 5 + F.col("turn") * 3, F.lit(18)))
    k, text = F.col("k"), F.coalesce("text", F.lit(""))
    cb = (F.when(k == 0, "menu:add_genre").when(k == 1, "menu:add_opinion").when(k == 2, "report:start")
          .when(k == 3, "menu:reset").when(k == 4, "menu:show"))
    short = F.substring(text, 1, 40)
    said = (F.when(k == 5, "/like_actor").when(k == 6, "/Block now").when(k == 7, "/report")
            .when(k == 8, F.concat(F.lit("/report "), short)).when(k == 9, "/watched")
            .when(k == 10, F.concat(F.lit("/watched "), short)).when(k == 11, "/recommend").when(k == 12, "/Profile now")
            .when(k == 13, "   ").when(k == 14, F.replace(short, F.lit(" "), F.lit(","))).when(k == 15, "/reset_profile")
            .otherwise(text))
    seq = F.pmod("conv_id", F.lit(4)) * 1000 + F.col("turn")
    even, third = F.col("turn") % 2 == 0, F.pmod("conv_id", F.lit(3)) == 0
    return c.select(
        F.floor(F.col("conv_id") / 4).alias("chat_id"), seq.alias("update_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + seq * 60).alias("ts"), cb.alias("callback_data"),
        F.when(cb.isNull(), said).alias("text"), F.pmod("conv_id", F.lit(50)).alias("user_id"),
        F.when(even, "Ann ").alias("first_name"), F.when(third, " Lee").alias("last_name"),
        F.when(F.col("turn") % 3 == 0, "ann").alias("username"), F.when(even, F.col("text")).otherwise("  ").alias("reply_to_text"),
        F.when(~third, F.col("turn")).alias("reply_message_id"), F.when(even, "id=7").alias("reply_author"))


SESSION_SQL = [f"""src AS (
  SELECT *, (conv_id * 5 + turn * 3) % 18 AS k, left(coalesce(text, ''), 40) AS short FROM conversations)""",
               f"""upd AS (
  SELECT conv_id // 4 AS chat_id, conv_id % 4 * 1000 + turn AS update_id, k,
         CASE k WHEN 0 THEN 'await' WHEN 1 THEN 'await' WHEN 2 THEN 'report' WHEN 3 THEN 'reset' WHEN 4 THEN NULL
                WHEN 5 THEN 'await' WHEN 6 THEN 'await' WHEN 7 THEN 'report'
                WHEN 8 THEN CASE WHEN {_JTRIM.format('short')} = '' THEN 'report' ELSE 'complain' END WHEN 9 THEN 'await'
                WHEN 10 THEN CASE WHEN {_JTRIM.format('short')} = '' THEN 'await' ELSE 'opinion' END
                WHEN 11 THEN 'recommend' WHEN 12 THEN 'command' WHEN 15 THEN 'reset' ELSE 'say' END AS act,
         CASE k WHEN 0 THEN 'ADD_GENRE' WHEN 1 THEN 'ADD_OPINION' WHEN 5 THEN 'ADD_ACTOR' WHEN 6 THEN 'ADD_BLOCK'
                WHEN 9 THEN 'ADD_OPINION' WHEN 10 THEN 'ADD_OPINION' END AS want,
         CASE WHEN k IN (8, 10) THEN {_JTRIM.format('short')} WHEN k = 11 THEN 'дай рекомендации' WHEN k = 12 THEN '/profile'
              WHEN k = 13 THEN '' WHEN k = 14 THEN {_JTRIM.format("replace(short, ' ', ',')")}
              WHEN k >= 16 THEN {_JTRIM.format("coalesce(text, '')")} END AS said,
         CASE WHEN turn % 2 = 0 THEN 'Ann' || CASE WHEN conv_id % 3 = 0 THEN ' Lee' ELSE '' END
              WHEN conv_id % 3 = 0 THEN 'Lee' END AS name,
         turn % 3 = 0 AS has_at, conv_id % 50 AS user_id,
         CASE WHEN turn % 2 = 0 THEN nullif({_JTRIM.format('text')}, '') END AS reported, turn % 2 = 0 AS even,
         CASE WHEN conv_id % 3 <> 0 THEN turn END AS message
  FROM src)""",
               """labelled AS (
  SELECT *, CASE WHEN name IS NOT NULL AND has_at THEN name || ' (@ann, id=' || user_id || ')'
                 WHEN name IS NOT NULL THEN name || ' (id=' || user_id || ')'
                 WHEN has_at THEN '@ann (id=' || user_id || ')' ELSE 'id=' || user_id END AS label,
         coalesce(left(reported, 500), 'message #' || message || CASE WHEN even THEN ' by id=7' ELSE '' END, '') AS target,
         coalesce(said, '') AS raw
  FROM upd WHERE act IS NOT NULL AND NOT (act = 'say' AND starts_with(said, '/')))""",
               f"parsed AS ({_opinion_sql('SELECT * FROM labelled')})",
               """step AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY update_id) AS i FROM parsed)""",
               """fold AS (
  SELECT chat_id, CAST(0 AS BIGINT) AS i, 'NONE' AS wait, CAST(NULL AS VARCHAR) AS r_label, CAST(NULL AS VARCHAR) AS r_target,
         'NONE' AS had, CAST(NULL AS VARCHAR) AS had_label, CAST(NULL AS VARCHAR) AS had_target
  FROM (SELECT DISTINCT chat_id FROM step)
  UNION ALL
  SELECT f.chat_id, s.i,
         CASE WHEN act = 'await' THEN want WHEN act = 'report' THEN 'REPORT_COMPLAINT'
              WHEN act IN ('complain', 'reset') OR act = 'opinion' AND ok THEN 'NONE'
              WHEN act <> 'say' OR wait = 'NONE' THEN wait
              WHEN wait = 'ADD_OPINION' THEN CASE WHEN ok THEN 'NONE' ELSE wait END
              WHEN wait = 'REPORT_COMPLAINT' THEN CASE WHEN said <> '' THEN 'NONE' ELSE wait END ELSE 'NONE' END,
         CASE WHEN act = 'report' THEN label WHEN act = 'complain' OR act = 'say' AND wait = 'REPORT_COMPLAINT' AND said <> '' THEN NULL ELSE r_label END,
         CASE WHEN act = 'report' THEN target WHEN act = 'complain' OR act = 'say' AND wait = 'REPORT_COMPLAINT' AND said <> '' THEN NULL ELSE r_target END,
         wait, r_label, r_target
  FROM fold f JOIN step s ON s.chat_id = f.chat_id AND s.i = f.i + 1)""",
               f"""did AS (
  SELECT s.*, had, had_label, had_target,
         CASE WHEN act = 'reset' THEN ['preference'] WHEN act = 'recommend' THEN ['enqueue'] WHEN act = 'command' THEN ['command']
              WHEN act = 'complain' THEN ['complaint'] WHEN act = 'opinion' THEN CASE WHEN ok THEN ['opinion'] END
              WHEN act <> 'say' THEN NULL
              WHEN had IN ('ADD_GENRE', 'ADD_ACTOR', 'ADD_BLOCK') THEN ['preference']
              WHEN had = 'ADD_OPINION' THEN CASE WHEN ok THEN ['opinion'] END
              WHEN had = 'REPORT_COMPLAINT' THEN CASE WHEN said <> '' THEN ['complaint'] END
              WHEN said <> '' THEN ['enqueue'] END[1] AS event,
         list_filter(list_transform(string_split_regex(said, '[,;\n]'), lambda x: {_JTRIM.format('x')}), lambda x: x <> '') AS tags
  FROM fold JOIN step s USING (chat_id, i))""",
               """chat_event AS (
  SELECT chat_id, update_id, event,
         CASE WHEN event = 'command' THEN said WHEN event = 'preference' THEN CASE WHEN act = 'reset' THEN 'reset'
              WHEN had = 'ADD_GENRE' THEN 'add_genre' WHEN had = 'ADD_ACTOR' THEN 'add_actor' ELSE 'block' END END AS kind,
         unnest(CASE WHEN event = 'preference' AND act = 'say' THEN tags ELSE [NULL] END) AS tag,
         CASE WHEN event = 'opinion' THEN title END AS title, CASE WHEN event = 'opinion' THEN opinion END AS opinion,
         CASE WHEN event = 'complaint' THEN said END AS complaint_text,
         CASE WHEN event = 'complaint' THEN CASE WHEN act = 'complain' THEN target ELSE coalesce(had_target, '') END END AS target_description,
         CASE WHEN event = 'complaint' THEN CASE WHEN act = 'complain' THEN label ELSE coalesce(had_label, 'chat ' || chat_id) END END AS user_label,
         CASE WHEN event = 'enqueue' THEN said END AS text
  FROM did WHERE event IS NOT NULL)"""]


def _recursive(ctes, body):
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body.strip()


#: Slices in which a stream meets its input, in time order (update ids up to).
SLICES = (999, 1999, 2999, 1 << 40)


def replay(spark, df, name, order="update_id"):
    """A file stream over ``df`` that comes in the time slices, one a batch."""
    src = run_dir(spark, f"{name}-in")
    low = -1
    for n, high in enumerate(SLICES):
        part = df.where((F.col(order) > low) & (F.col(order) <= high))
        part.coalesce(1).write.parquet(f"{src}/slice={n}")
        low = high
    return (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
            .option("latestFirst", "false").parquet(src))


def chat_events(spark, sf):
    """The chat events of the session stream (T2), run to its end."""
    out = run_dir(spark, "t2-out")
    run_to_parquet(chat_sessions(replay(spark, session_updates(spark, sf), "t2"), expire_days=30), out, run_dir(spark, "t2-ck"))
    return spark.read.parquet(out)


@register("t2_chat_sessions", _recursive(SESSION_SQL, "SELECT * FROM chat_event"))
def t2_chat_sessions(spark, sf):
    return chat_events(spark, sf).drop("ts")


# Fixed values of the stand-in: what the model replies to a turn, by kind.
REPLIES = ("What genre do you like?", "```\n__Recommend__\n```", "1. Alpha\n2. Beta", "Which **actor** do you mean?")


def replies(turns):
    """A reply a minute after each turn; its kind by chat and update."""
    k = F.pmod(F.col("chat_id") * 3 + F.col("update_id") * 7, F.lit(10)).cast("int")
    pick = F.when(k < 5, F.lit(REPLIES[0])).when(k == 5, REPLIES[1]).when(k == 6, REPLIES[2]).otherwise(REPLIES[3])
    return turns.select("chat_id", "update_id", (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("ts"),
                        pick.alias("reply"), (k == 9).alias("has_actors"))


# Questions of a run count 1, 2, and the third turn recommends; any turn that
# recommends for itself begins a new run.
DIALOG_SQL = ["""turn AS (
  SELECT *, (chat_id * 3 + update_id * 7) % 10 AS r,
         list_any_value(list_filter(['дай рекоменда', 'предложи фильм', 'предложи фильмы', 'не задавай вопросы', 'хочу рекомендации',
           'порекомендуй', 'давай фильмы', 'give recommendation', 'recommend now'], lambda p: contains(lower(text), p))) IS NOT NULL AS phrase
  FROM chat_event WHERE event = 'enqueue')""",
              """run AS (
  SELECT *, r IN (5, 6, 9) OR phrase AS gives,
         sum(CASE WHEN r IN (5, 6, 9) OR phrase THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY update_id) AS g FROM turn)""",
              """asked AS (
  SELECT *, sum(CASE WHEN gives THEN 0 ELSE 1 END) OVER (PARTITION BY chat_id, g ORDER BY update_id) % 3 AS n FROM run)""",
              """decided AS (
  SELECT chat_id, update_id, CASE WHEN gives OR n = 0 THEN 'recommend' ELSE 'clarify' END AS decision,
         CAST(CASE WHEN gives THEN 0 ELSE n END AS INTEGER) AS clarified, text,
         CASE WHEN NOT gives AND n > 0 THEN CASE WHEN r < 5 THEN 'What genre do you like?' ELSE 'Which <b>actor</b> do you mean?' END END AS answer
  FROM asked)"""]


@register("t2_dialog_turns", _recursive(SESSION_SQL + DIALOG_SQL, "SELECT * FROM decided"))
def t2_dialog_turns(spark, sf):
    turns = chat_events(spark, sf).where("event = 'enqueue'").select("chat_id", "update_id", "ts", "text")
    asked, answered = replay(spark, turns, "turns"), replay(spark, replies(turns), "replies")
    out = run_dir(spark, "dialog-out")
    run_to_parquet(dialog_turns(join_replies(asked, answered)), out, run_dir(spark, "dialog-ck"))
    return spark.read.parquet(out).drop("ts")


@register("s6_write_complaints", _recursive(SESSION_SQL, """
SELECT user_label, complaint_text, target_description FROM chat_event WHERE event = 'complaint'"""))
def s6_write_complaints(spark, sf):
    path = run_dir(spark, "complaints")
    complaint_table(spark, path)
    run_foreach_batch(chat_sessions(replay(spark, session_updates(spark, sf), "s6")), complaint_batch_writer(path),
                      run_dir(spark, "s6-ck"))
    return read_complaints(spark, path)


@register("t3_task_stream")
def t3_task_stream(spark, sf):
    src = run_dir(spark, "t3-in")
    ev = task_events(spark, sf)
    materialize_input(ev, src, files=8)
    stream = read_stream(spark, src, ev.schema, files_per_trigger=2)
    st = task_stream(spark, stream, run_dir(spark, "t3-events"), run_dir(spark, "t3-ck"))
    ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return st.select("task_id", "status", ts("created_at"), ts("started_at"), ts("finished_at"), "active")


# the streamed fold must equal the batch fold of the same events
ORACLE["t3_task_stream"] = ORACLE["r15_task_state"]


@register("t4_append_messages", """
SELECT conv_id AS chat_id, turn AS id,
       CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) ELSE text END AS text
FROM conversations""")
def t4_append_messages(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("chat_id"), F.col("turn").alias("id"), "text")
    src, out, ck = run_dir(spark, "t4-in"), run_dir(spark, "t4-out"), run_dir(spark, "t4-ck")
    materialize_input(c, src, files=4)
    append_messages(read_stream(spark, src, c.schema, 2), out, ck)
    return spark.read.parquet(out).select("chat_id", "id", "text")
