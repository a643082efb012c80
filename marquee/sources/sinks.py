"""The complaint sink -- a table of (user label, complaint, target
description), NULLs written as ''. Batches append; a stream writes through the
epoch ledger, so a replayed epoch adds nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.text import java_trim
from marquee.sources.ledger import create_ledger, epoch_writer, read_ledger

COMPLAINT_COLUMNS = ("user_label", "complaint_text", "target_description")
COMPLAINT_SCHEMA = ", ".join(f"{c} string" for c in COMPLAINT_COLUMNS)
#: Code points of a reported message that are kept.
TARGET_MAX = 500


def _text(c: str) -> Column:
    """The trimmed text, NULL when blank."""
    t = java_trim(F.col(c))
    return F.when(t != "", t)


def describe_user(user_id: str = "user_id", first: str = "first_name", last: str = "last_name",
                  username: str = "username") -> Column:
    """``First Last (@name, id=1)``, with what is there; ``unknown`` without a user."""
    name = F.concat_ws(" ", _text(first), _text(last))
    at, uid = F.col(username), F.concat(F.lit("id="), F.col(user_id).cast("string"))
    has_name, has_at = name != "", F.coalesce(_text(username), F.lit("")) != ""
    return (F.when(F.col(user_id).isNull(), "unknown")
            .when(has_name & has_at, F.concat(name, F.lit(" (@"), at, F.lit(", "), uid, F.lit(")")))
            .when(has_name, F.concat(name, F.lit(" ("), uid, F.lit(")")))
            .when(has_at, F.concat(F.lit("@"), at, F.lit(" ("), uid, F.lit(")")))
            .otherwise(uid))


def describe_target(text: str = "reply_to_text", message_id: str = "reply_message_id",
                    author: str = "reply_author") -> Column:
    """The reported message's text (cut), else its number and author, else ''."""
    number = F.concat(F.lit("message #"), F.col(message_id).cast("string"),
                      F.coalesce(F.concat(F.lit(" by "), F.col(author)), F.lit("")))
    return F.coalesce(F.substring(_text(text), 1, TARGET_MAX), number, F.lit(""))


def complaint_rows(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in COMPLAINT_COLUMNS])


def write_complaints(df: DataFrame, path: str) -> None:
    """Batch append of complaint rows."""
    complaint_rows(df).write.mode("append").parquet(path)


def complaint_table(spark: SparkSession, path: str) -> None:
    """An empty complaint table that streams append to."""
    create_ledger(spark, path, COMPLAINT_SCHEMA)


def complaint_batch_writer(path: str, writer: str = "main"):
    """A ``foreachBatch`` function: the complaints among a batch's chat events,
    each epoch once."""
    return epoch_writer(path, lambda batch: complaint_rows(batch.filter(F.col("event") == "complaint")), writer)


def read_complaints(spark: SparkSession, path: str) -> DataFrame:
    return read_ledger(spark, path, COMPLAINT_SCHEMA)
