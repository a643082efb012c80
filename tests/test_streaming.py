"""Streaming family: T1 classification, T2 session golden rows (complaint
flow, slash command leaves the wait pending), T2 stream == one-batch
result, T3 stream == batch fold, S6 sink."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marquee.plans.profile_queries import task_events
from marquee.operators.tasks import task_state
from marquee.plans.stream_queries import replay, replies, session_updates
from marquee.sources.ledger import commit_epoch, create_ledger, read_ledger
from marquee.sources.sinks import (complaint_batch_writer, complaint_table, describe_target, describe_user,
                                   read_complaints, write_complaints)
from marquee.streaming.chat import (NONE_AWAIT, advance, chat_sessions, classify_updates, dialog_turns, join_replies,
                                    session_inputs, turn_messages)
from marquee.streaming.jobs import (current_tasks, materialize_input, read_stream, run_dir, run_foreach_batch,
                                    run_to_parquet, task_changes, task_stream)
from tests.conftest import SF001

SCHEMA = ("chat_id long, update_id long, ts timestamp, callback_data string, text string, reply_to_text string, "
          "user_id long, first_name string, last_name string, username string, reply_message_id long, reply_author string")
T0 = datetime(2024, 1, 1)


def _u(chat, i, cb=None, text=None, reply=None, user=None, message=None, author=None):
    return (chat, i, T0 + timedelta(seconds=i), cb, text, reply, *(user or (None,) * 4), message, author)


def _run(spark, rows):
    """Events of one chat's updates and its session after them."""
    session, out = {"wait": NONE_AWAIT, "label": None, "target": None}, []
    for u in session_inputs(spark.createDataFrame(rows, SCHEMA)).orderBy("ts", "update_id").collect():
        out += [{"update_id": u["update_id"], **e} for e in advance(session, u)]
    return out, session


def test_t2_complaint_golden(spark):
    events, st = _run(spark, [_u(100, 1, cb="report:start", reply="original message"),
                              _u(100, 2, text="  Something broke ")])
    c = [e for e in events if e["event"] == "complaint"]
    assert len(c) == 1 and c[0]["complaint_text"] == "Something broke"
    assert c[0]["target_description"] == "original message" and st["wait"] == "NONE" and st["label"] is None


def test_t2_blank_complaint_keeps_waiting(spark):
    events, st = _run(spark, [_u(77, 1, cb="report:start", reply="x"), _u(77, 2, text="   ")])
    assert not [e for e in events if e["event"] == "complaint"] and st["wait"] == "REPORT_COMPLAINT"


def test_t2_slash_leaves_wait_pending(spark):
    events, st = _run(spark, [_u(5, 1, cb="menu:add_genre"), _u(5, 2, text="/profile"), _u(5, 3, text="drama")])
    prefs = [e for e in events if e["event"] == "preference"]
    assert [(e["kind"], e["tag"]) for e in prefs] == [("add_genre", "drama")]
    assert [e["kind"] for e in events if e["event"] == "command"] == ["/profile"]


def test_t2_commands_arm_and_act(spark):
    events, st = _run(spark, [
        _u(6, 1, text="/like_actor"), _u(6, 2, text="Al Pacino, Brad Pitt"), _u(6, 3, text="/block x"), _u(6, 4, text="horror"),
        _u(6, 5, text="/watched"), _u(6, 6, text="  "), _u(6, 7, text="Dune; great"), _u(6, 8, text="/WATCHED Heat - good"),
        _u(6, 9, text="/like_genre"), _u(6, 10, text="/reset_profile"), _u(6, 11, text="noir"), _u(6, 12, text="/recommend"),
        _u(6, 13, text="/like_director"), _u(6, 14, cb="menu:reset"), _u(6, 15, cb="menu:show"), _u(6, 16, cb="other")])
    assert [(e["update_id"], e["event"], e.get("kind") or e.get("title") or e.get("text"), e.get("tag") or e.get("opinion")) for e in events] == [
        (2, "preference", "add_actor", "Al Pacino"), (2, "preference", "add_actor", "Brad Pitt"), (4, "preference", "block", "horror"),
        (7, "opinion", "Dune", "great"), (8, "opinion", "Heat", "good"), (10, "preference", "reset", None), (11, "enqueue", "noir", None),
        (12, "enqueue", "дай рекомендации", None), (14, "preference", "reset", None)]
    assert st["wait"] == "NONE"


def test_t2_report_command(spark):
    ann = (7, " Ann", "Lee ", "ann")
    events, st = _run(spark, [
        _u(8, 1, text="/report it is broken ", user=ann, reply="the answer"),       # at once
        _u(8, 2, text="/report", user=(8, None, None, "bob"), message=12, author="id=1"), _u(8, 3, text="/help"), _u(8, 4, text="later"),
        _u(8, 5, text="/like_genre"), _u(8, 6, text="/report now", user=(9, None, None, None)), _u(8, 7, text="drama")])
    assert [(e["event"], e.get("complaint_text"), e.get("user_label"), e.get("target_description")) for e in events] == [
        ("complaint", "it is broken", "Ann Lee (@ann, id=7)", "the answer"), ("command", None, None, None),
        ("complaint", "later", "@bob (id=8)", "message #12 by id=1"), ("complaint", "now", "id=9", ""), ("enqueue", None, None, None)]


def test_labels(spark):
    df = spark.createDataFrame([_u(1, 1), _u(1, 2, user=(3, "A", " ", None), reply="  " + "x" * 600, message=4),
                                _u(1, 3, user=(3, None, None, " "), message=4)], SCHEMA)
    got = [tuple(r) for r in df.orderBy("update_id").select(describe_user(), describe_target()).collect()]
    assert got == [("unknown", ""), ("A (id=3)", "x" * 500), ("id=3", "message #4")]


def test_t1_classify(spark):
    df = spark.createDataFrame([_u(1, 1, cb="report:start"), _u(1, 2, cb="menu:show"),
                                _u(1, 3, text=" /Help me"), _u(1, 4, text="hi"), _u(1, 5)], SCHEMA)
    got = [(r.kind, r.command) for r in classify_updates(df).orderBy("update_id").collect()]
    assert got == [("report_callback", None), ("menu_callback", None), ("command", "/help"),
                   ("free_text", None), ("ignored", None)]


def _stream(spark, df, by, n):
    """``df`` as a file stream: a file for each value of update_id % n."""
    src = run_dir(spark, "test-in")
    for i in range(n):
        materialize_input(df.filter(by == i), f"{src}/s={i}", files=1)
    return lambda: (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
                    .option("recursiveFileLookup", "true").parquet(src)), src


def _events(spark, out):
    return sorted(tuple(r) for r in spark.read.parquet(out).collect())


def test_t2_replay_and_restart_change_nothing(spark):
    rows = []
    for chat in (1, 2, 3):
        rows += [_u(chat, 1, cb="menu:add_opinion"), _u(chat, 2, text="   "),
                 _u(chat, 3, text="Dune\ngreat"), _u(chat, 4, cb="menu:add_actor"),
                 _u(chat, 5, text="Al Pacino, Brad Pitt"), _u(chat, 6, text="/report"), _u(chat, 7, text="bad")]
    df = spark.createDataFrame(rows, SCHEMA)
    results = []
    for n in (1, 4, 7):
        made, src = _stream(spark, df, F.floor(F.col("update_id") * n / 8), n)
        out, ck = run_dir(spark, "t2test-out"), run_dir(spark, "t2test-ck")
        run_to_parquet(chat_sessions(made()), out, ck)
        results.append(_events(spark, out))
        run_to_parquet(chat_sessions(made()), out, ck)  # nothing new
        assert _events(spark, out) == results[-1]
        # a later update finds the state of before
        materialize_input(spark.createDataFrame([_u(1, 8, cb="menu:add_block")], SCHEMA), f"{src}/s=8", files=1)
        run_to_parquet(chat_sessions(made()), out, ck)
        materialize_input(spark.createDataFrame([_u(1, 9, text="war")], SCHEMA), f"{src}/s=9", files=1)
        run_to_parquet(chat_sessions(made()), out, ck)
        new = [r for r in _events(spark, out) if r not in results[-1]]
        assert [(r[0], r[4], r[5]) for r in new] == [(1, "block", "war")]
    assert results[0] == results[1] == results[2]
    assert len([r for r in results[0] if r[3] == "opinion"]) == len([r for r in results[0] if r[3] == "complaint"]) == 3


def test_t2_waits_expire_by_event_time(spark):
    day = 86_400
    rows = [_u(1, 1, cb="menu:add_genre"), _u(1, 2 * day, text="too late"), _u(2, day, cb="menu:add_genre"),
            _u(2, 2 * day - 5, text="drama"), _u(3, 1, cb="menu:add_genre"), _u(4, 9 * day, text="hi"), _u(3, 9 * day + 1, text="x")]
    df = spark.createDataFrame(rows, SCHEMA)
    made, _ = _stream(spark, df, F.floor(F.col("update_id") / (day * 3)), 4)
    out = run_dir(spark, "t2exp-out")
    run_to_parquet(chat_sessions(made(), expire_days=1), out, run_dir(spark, "t2exp-ck"))
    got = {(r.chat_id, r.event, r.tag or r.text) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "enqueue", "too late"), (2, "preference", "drama"), (4, "enqueue", "hi"), (3, "enqueue", "x")}


def test_t2_dialog(spark):
    """Two questions, then a recommendation; marks, lists, phrases and actors."""
    turns = spark.createDataFrame([(9, i, T0 + timedelta(seconds=i), t) for i, t in enumerate(
        ["a", "b", "c", "d", "recommend now", "e", "f", "g", "h"])], "chat_id long, update_id long, ts timestamp, text string")
    q = "What?"
    told = [q, q, q, q, q, "```\n__RECOMMEND__\n```", "1. Alien", q, q]
    reply = spark.createDataFrame([(9, i, T0 + timedelta(seconds=i + 5), r, i == 8) for i, r in enumerate(told)] +
                                  [(9, 7, T0 + timedelta(hours=2), "too late", False)],
                                  "chat_id long, update_id long, ts timestamp, reply string, has_actors boolean")
    want = ["clarify", "clarify", "recommend", "clarify", "recommend", "recommend", "recommend", "clarify", "recommend"]
    for n in (1, 3):
        asked, _ = _stream(spark, turns, F.floor(F.col("update_id") / (9 / n)), n)
        answered, _ = _stream(spark, reply, F.floor(F.col("update_id") / (9 / n)), n)
        out = run_dir(spark, "dialog")
        run_to_parquet(dialog_turns(join_replies(asked(), answered())), out, run_dir(spark, "dialog-ck"))
        got = spark.read.parquet(out)
        assert [r.decision for r in got.orderBy("update_id").collect()] == want
    log = turn_messages(got).orderBy("id").collect()
    assert [r.text for r in log][:4] == ["User: a", "Bot: What?", "User: b", "Bot: What?"] and len(log) == 9 + 4


def test_epochs_are_committed_once(spark):
    path = run_dir(spark, "ledger")
    create_ledger(spark, path, "a long")
    create_ledger(spark, path, "a long")
    assert read_ledger(spark, path, "a long").collect() == []
    one = spark.createDataFrame([(1,), (2,)], "a long")
    assert commit_epoch(one, path, 0) and not commit_epoch(one, path, 0)
    # a broken epoch: rows without a record are not seen, and written again
    one.withColumn("writer", F.lit("main")).withColumn("epoch", F.lit(1).cast("long")).write.parquet(f"{path}/data/main-1")
    assert sorted(r.a for r in read_ledger(spark, path, "a long").collect()) == [1, 2]
    assert commit_epoch(spark.createDataFrame([(3,)], "a long"), path, 1)
    assert commit_epoch(spark.createDataFrame([(4,)], "a long"), path, 0, writer="other")
    assert sorted(r.a for r in read_ledger(spark, path, "a long").collect()) == [1, 2, 3, 4]


def test_s6_replayed_epoch_adds_nothing(spark):
    path = run_dir(spark, "complaints")
    complaint_table(spark, path)
    batch = spark.createDataFrame([("complaint", "u", None, "t"), ("command", "u", "c", "t")],
                                  "event string, user_label string, complaint_text string, target_description string")
    write = complaint_batch_writer(path)
    for epoch in (0, 0, 1, 0):
        write(batch, epoch)
    assert [tuple(r) for r in read_complaints(spark, path).collect()] == [("u", "", "t")] * 2


def test_t3_stream_equals_batch(spark):
    ev = task_events(spark, SF001)
    src = run_dir(spark, "t3test-in")
    materialize_input(ev, src, files=4)
    streamed = task_stream(spark, read_stream(spark, src, ev.schema, 1),
                           run_dir(spark, "t3test-ev"), run_dir(spark, "t3test-ck"))
    a = sorted(tuple(r) for r in streamed.select(*task_state(ev).columns).collect())
    b = sorted(tuple(r) for r in task_state(ev).collect())
    assert a == b


def test_t3_replayed_and_late_epochs_change_nothing(spark):
    ev = spark.createDataFrame(
        [(t, e, T0 + timedelta(seconds=e), s) for t, e, s in ((1, 1, "QUEUED"), (1, 2, "RUNNING"), (1, 3, "DONE"), (2, 1, "QUEUED"),
                                                              (2, 5, "RUNNING"), (3, 2, "QUEUED"), (3, 9, "FAILED"))],
        "task_id long, event_id long, ts timestamp, status string")
    path, ck, src = run_dir(spark, "t3b"), run_dir(spark, "t3b-ck"), run_dir(spark, "t3b-in")
    create_ledger(spark, path, "task_id long, status string, created_at timestamp, started_at timestamp, "
                               "finished_at timestamp, error string, result_text string, version long")
    materialize_input(ev, src, files=1)
    first = sorted(map(tuple, task_stream(spark, read_stream(spark, src, ev.schema), path, ck).collect()))
    assert [(r[0], r[1], r[-1]) for r in first] == [(1, "DONE", False), (2, "RUNNING", True), (3, "FAILED", False)]
    want = sorted(map(tuple, task_state(ev).select("task_id", "status", "created_at", "started_at", "finished_at").collect()))
    assert [r[:5] for r in first] == want
    # the same events again as a new epoch, and a late one that changes nothing
    ev.unionByName(ev.limit(2)).coalesce(1).write.mode("append").parquet(src)
    ev.where("task_id = 1 AND event_id = 2").coalesce(1).write.mode("append").parquet(src)
    again = sorted(map(tuple, task_stream(spark, read_stream(spark, src, ev.schema), path, ck).collect()))
    assert again == first and read_ledger(spark, path, "task_id long, version long").count() == 3
    # one event: one changed row
    one = spark.createDataFrame([(2, 6, T0 + timedelta(seconds=60), "DONE")], ev.schema)
    one.coalesce(1).write.mode("append").parquet(src)
    last = task_stream(spark, read_stream(spark, src, ev.schema), path, ck)
    assert [r.status for r in last.orderBy("task_id").collect()] == ["DONE", "DONE", "FAILED"]
    assert read_ledger(spark, path, "task_id long, version long").count() == 4


def test_s6_sink_nulls_to_empty(spark, tmp_dir):
    df = spark.createDataFrame([("u", None, "t")], "user_label string, complaint_text string, "
                                                   "target_description string")
    write_complaints(df, tmp_dir + "/c")
    write_complaints(df, tmp_dir + "/c")
    rows = spark.read.parquet(tmp_dir + "/c").collect()
    assert len(rows) == 2 and rows[0].complaint_text == ""


def test_streams_bring_their_own_state_store(spark):
    # a session that was not made by get_spark: typed state needs RocksDB
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    plain = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(name, plain)
    try:
        df = spark.createDataFrame([_u(1, 1, cb="menu:add_genre"), _u(1, 2, text="war")], SCHEMA)
        out = run_dir(spark, "plain-out")
        run_to_parquet(chat_sessions(replay(spark, df, "plain")), out, run_dir(spark, "plain-ck"))
        assert [(r.kind, r.tag) for r in spark.read.parquet(out).collect()] == [("add_genre", "war")]
        assert spark.conf.get(name) == plain
    finally:
        spark.conf.set(name, before)
