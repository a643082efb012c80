"""Chat updates: stateless classification (T1), per-chat session state (T2) and
the clarify-or-recommend decision on the model's replies, kept as typed keyed
state of Structured Streaming (``transformWithState``, RocksDB).

All text work (trimming, tags, opinions, user and target labels) is done by
column expressions before the state is met; a processor sees short rows and
only moves a session from one state to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marquee.functions.text import (MAX_CLARIFY_TURNS, java_trim, looks_like_recommendation, recommend_now,
                                    sanitize_message, strip_code_fence)
from marquee.operators.profiles import ADD_KINDS, RESET, parse_opinion, parse_tag_list
from marquee.session import ship_package
from marquee.sources.sinks import describe_target, describe_user

# Callback payloads, commands, awaited-input kinds and limits.
REPORT_CALLBACK = "report:start"
MENU_AWAITS = {"menu:add_genre": "ADD_GENRE", "menu:add_actor": "ADD_ACTOR",
               "menu:add_director": "ADD_DIRECTOR", "menu:add_block": "ADD_BLOCK",
               "menu:add_opinion": "ADD_OPINION"}
MENU_RESET = "menu:reset"
COMMAND_AWAITS = {"/like_genre": "ADD_GENRE", "/like_actor": "ADD_ACTOR",
                  "/like_director": "ADD_DIRECTOR", "/block": "ADD_BLOCK"}
COMMAND_RESET, COMMAND_WATCHED, COMMAND_REPORT, COMMAND_RECOMMEND = "/reset_profile", "/watched", "/report", "/recommend"
RECOMMEND_TEXT = "дай рекомендации"
AWAIT_EVENT_KIND = dict(zip(("ADD_GENRE", "ADD_ACTOR", "ADD_DIRECTOR", "ADD_BLOCK"), ADD_KINDS))
NONE_AWAIT, OPINION_AWAIT, REPORT_AWAIT = "NONE", "ADD_OPINION", "REPORT_COMPLAINT"
RECOMMEND_MARK = "__recommend__"


def classify_updates(updates: DataFrame) -> DataFrame:
    """kind = report_callback / menu_callback / command / free_text /
    ignored, plus the lower-cased first token of a command. Stateless, so
    the same plan runs on a batch table or a stream."""
    cb = F.col("callback_data")
    t = java_trim(F.coalesce(F.col("text"), F.lit("")))
    kind = (F.when(cb == REPORT_CALLBACK, "report_callback")
            .when(cb.isNotNull(), "menu_callback")
            .when(F.col("text").isNull(), "ignored")
            .when(t.startswith("/"), "command")
            .otherwise("free_text"))
    command = F.when(kind == "command", F.lower(F.split(t, r"\s+", 2)[0]))
    return updates.withColumn("kind", kind).withColumn("command", command)


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def session_inputs(updates: DataFrame) -> DataFrame:
    """One short row per update: ``act`` (what it does), ``want`` (the input it
    waits for), ``said`` (the text or a command's argument) and, parsed from
    it, ``tags`` and ``title, opinion, ok``; ``label`` and ``target`` of a report."""
    kind, command = F.col("kind"), F.col("command")
    text = java_trim(F.coalesce(F.col("text"), F.lit("")))
    argument = java_trim(F.substring(text, F.length(command) + 1, F.length(text)))
    cb = F.col("callback_data")
    bare = argument == ""
    act = (F.when(kind == "report_callback", "report")
           .when(kind == "menu_callback", F.when(cb.isin(*MENU_AWAITS), "await").when(cb == MENU_RESET, "reset"))
           .when(kind == "free_text", "say")
           .when(command.isin(*COMMAND_AWAITS), "await")
           .when(command == COMMAND_RESET, "reset")
           .when(command == COMMAND_RECOMMEND, "recommend")
           .when(command == COMMAND_WATCHED, F.when(bare, "await").otherwise("opinion"))
           .when(command == COMMAND_REPORT, F.when(bare, "report").otherwise("complain"))
           .when(kind == "command", "command"))
    want = (F.when(cb.isNotNull(), _lookup(MENU_AWAITS, cb))
            .when(command == COMMAND_WATCHED, OPINION_AWAIT).otherwise(_lookup(COMMAND_AWAITS, command)))
    rows = classify_updates(updates).withColumn("act", act).where(F.col("act").isNotNull())
    rows = rows.withColumn("said", F.when(F.col("act") == "say", text).when(F.col("act") == "command", command)
                           .when(F.col("act") == "recommend", RECOMMEND_TEXT).when(kind == "command", argument))
    rows = rows.withColumn("parsed", F.when(F.col("act").isin("say", "opinion"), parse_opinion("said")))
    report = F.col("act").isin("report", "complain")
    return rows.select(
        "chat_id", "update_id", "ts", "act", F.when(F.col("act") == "await", want).alias("want"), "said",
        F.when(F.col("act") == "say", parse_tag_list("said")).alias("tags"),
        "parsed.title", "parsed.opinion", F.coalesce("parsed.ok", F.lit(False)).alias("ok"),
        F.when(report, describe_user()).alias("label"), F.when(report, describe_target()).alias("target"))


EVENT_SCHEMA = ("chat_id long, update_id long, ts timestamp, event string, kind string, tag string, title string, "
                "opinion string, complaint_text string, target_description string, user_label string, text string")
_FIELDS = [f.split(" ")[0] for f in EVENT_SCHEMA.split(", ")]


def advance(session: dict, u) -> list[dict]:
    """Move one chat's ``session`` (wait, label, target) by one input row; what
    it does comes back as events."""
    act, wait, out = u["act"], session["wait"], []

    def event(name: str, **fields) -> None:
        out.append({"event": name, **fields})

    def complain(label, target) -> None:
        event("complaint", complaint_text=u["said"], user_label=label, target_description=target)
        session.update(wait=NONE_AWAIT, label=None, target=None)
    if act == "await":
        session["wait"] = u["want"]
    elif act == "report":
        session.update(wait=REPORT_AWAIT, label=u["label"], target=u["target"])
    elif act == "complain":
        complain(u["label"], u["target"])
    elif act == "reset":
        event("preference", kind=RESET)
        session["wait"] = NONE_AWAIT
    elif act == "recommend":
        event("enqueue", text=u["said"])
    elif act == "command":
        event("command", kind=u["said"])
    elif act == "say" and wait in AWAIT_EVENT_KIND:
        for tag in u["tags"]:
            event("preference", kind=AWAIT_EVENT_KIND[wait], tag=tag)
        session["wait"] = NONE_AWAIT
    elif act == "opinion" or wait == OPINION_AWAIT:
        if u["ok"]:  # what is no opinion leaves the wait as it is
            event("opinion", title=u["title"], opinion=u["opinion"])
            session["wait"] = NONE_AWAIT
    elif wait == REPORT_AWAIT:
        if u["said"]:  # a blank complaint keeps waiting
            complain(session["label"] or f"chat {u['chat_id']}", session["target"] or "")
    elif u["said"]:
        event("enqueue", text=u["said"])
    return out


class _InOrder(StatefulProcessor):
    """Rows of a chat in one batch, by (ts, update_id); a batch is bounded by
    its trigger, so this sorts a few rows, never a chat's history."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from self.handle(sorted(rows, key=lambda r: (r["ts"], r["update_id"])))

    def close(self) -> None:
        pass


class ChatSession(_InOrder):
    """``wait``: the input that a chat is asked for and since when; ``report``:
    whom and what a report is about, from its start to its complaint."""

    def __init__(self, expire_ms: int | None):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle_of = handle
        self.wait = handle.getValueState("wait", "kind string, since long")
        self.report = handle.getValueState("report", "label string, target string")

    def _over(self, since: int, now: int) -> bool:
        return self.expire_ms is not None and now - since >= self.expire_ms

    def handle(self, rows):
        wait, report = self.wait.get(), self.report.get()
        session = {"wait": wait[0] if wait else NONE_AWAIT, "label": report[0] if report else None,
                   "target": report[1] if report else None}
        since, before, had = wait[1] if wait else 0, dict(session), wait[1] if wait else 0
        for u in rows:
            now = u["at"]
            if session["wait"] != NONE_AWAIT and self._over(since, now):
                session.update(wait=NONE_AWAIT, label=None, target=None)
            for e in advance(session, u):
                e.update(chat_id=u["chat_id"], update_id=u["update_id"], ts=u["ts"])
                yield Row(**{f: e.get(f) for f in _FIELDS})
            if u["act"] in ("await", "report"):
                since = now
        if (session["wait"], since) != (before["wait"], had):
            if session["wait"] == NONE_AWAIT:
                self.wait.clear()
            else:
                self.wait.update((session["wait"], since))
                if self.expire_ms is not None:
                    self.handle_of.registerTimer(since + self.expire_ms)
        if (session["label"], session["target"]) != (before["label"], before["target"]):
            if session["label"] is None:
                self.report.clear()
            else:
                self.report.update((session["label"], session["target"]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        wait = self.wait.get()
        if wait and self._over(wait[1], expiredTimerInfo.getExpiryTimeInMs()):
            self.wait.clear()
            self.report.clear()
        return iter(())


def chat_sessions(updates: DataFrame, expire_days: int | None = None) -> DataFrame:
    """``updates(chat_id, update_id, ts, callback_data, text, user_id,
    first_name, last_name, username, reply_to_text, reply_message_id,
    reply_author)`` to preference, opinion, complaint, command and enqueue
    events. A wait is consumed by the next plain text; a command leaves it
    pending or sets another; a failed opinion or blank complaint keeps it.

    With ``expire_days`` an unanswered wait lapses that long after it was set,
    by event time (the stream is watermarked by as much, later rows are
    dropped), and a timer frees its state; without, waits stay."""
    ship_package(updates.sparkSession)
    rows = session_inputs(updates)
    rows = rows.withColumn("at", F.unix_millis("ts"))
    if expire_days is not None:
        rows = rows.withWatermark("ts", f"{expire_days} days")
    return rows.groupBy("chat_id").transformWithState(
        ChatSession(None if expire_days is None else expire_days * 86_400_000), EVENT_SCHEMA, "Append",
        "None" if expire_days is None else "EventTime")


def join_replies(turns: DataFrame, replies: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Stream-stream join of ``turns(chat_id, update_id, ts, text)`` with the
    model's ``replies(chat_id, update_id, ts, reply, has_actors)``, each reply
    at most ``within`` after its turn. Both sides are watermarked by that, so
    the state holds a bounded time of turns, not all of them."""
    t = turns.select("chat_id", "update_id", "ts", "text").withWatermark("ts", within)
    r = replies.select(F.col("chat_id").alias("r_chat"), F.col("update_id").alias("r_update"), F.col("ts").alias("r_ts"),
                       "reply", "has_actors").withWatermark("r_ts", within)
    same = ((F.col("chat_id") == F.col("r_chat")) & (F.col("update_id") == F.col("r_update"))
            & (F.col("r_ts") >= F.col("ts")) & (F.col("r_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}")))
    return t.join(r, same).select("chat_id", "update_id", "ts", "text", "reply", "has_actors")


DECISION_SCHEMA = "chat_id long, update_id long, ts timestamp, decision string, clarified int, text string, answer string"


class Dialog(_InOrder):
    """``clarified``: questions asked in a row since the last recommendation."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clarified = handle.getValueState("clarified", "n int")

    def handle(self, rows):
        held = self.clarified.get()
        n = held[0] if held else 0
        for r in rows:
            ask = not (r["sure"] or n >= MAX_CLARIFY_TURNS or r["gives"])
            n = n + 1 if ask else 0
            yield Row(chat_id=r["chat_id"], update_id=r["update_id"], ts=r["ts"], decision="clarify" if ask else "recommend",
                      clarified=n, text=r["text"], answer=r["answer"] if ask else None)
        if n:
            self.clarified.update((n,))
        else:
            self.clarified.clear()


def dialog_turns(answered: DataFrame) -> DataFrame:
    """T2 with the model: ``answered`` (of :func:`join_replies`) to one decision
    a turn. A turn recommends if its intent names actors, a trigger phrase is in
    it, two questions were asked, or the reply is the mark or looks like a list
    of films; else its reply is a question, which counts. ``answer`` is the
    question as it is shown; ``clarified`` the count after the turn."""
    ship_package(answered.sparkSession)
    reply = java_trim(strip_code_fence(F.coalesce("reply", F.lit(""))))
    rows = answered.select(
        "chat_id", "update_id", "ts", "text", (F.coalesce("has_actors", F.lit(False)) | recommend_now("text")).alias("sure"),
        ((F.lower(reply) == RECOMMEND_MARK) | looks_like_recommendation(reply)).alias("gives"),
        sanitize_message(reply).alias("answer"))
    return rows.groupBy("chat_id").transformWithState(
        Dialog(), DECISION_SCHEMA, "Append", "None")


def turn_messages(decisions: DataFrame) -> DataFrame:
    """Both sides of answered turns as message rows for the log (T4):
    ``chat_id, id, created_at, text``; a turn's own row comes first."""
    said = F.array(F.struct(F.lit(0).alias("side"), F.concat(F.lit("User: "), F.col("text")).alias("text")),
                   F.struct(F.lit(1).alias("side"), F.concat(F.lit("Bot: "), F.col("answer")).alias("text")))
    return (decisions.select("chat_id", "update_id", "ts", F.explode(said).alias("m")).where("m.text IS NOT NULL")
            .select("chat_id", (F.col("update_id") * 2 + F.col("m.side")).alias("id"), F.col("ts").alias("created_at"),
                    F.col("m.text").alias("text")))
