"""Threads: listing, conversation, arc, expansion of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import direction, display_sender, main_text, not_quoted, prefix_snippet

ORDERS = {"message_count": "message_count", "participants": "participant_count", "last_message": "last_message", "first_message": "first_message"}


def list_threads(messages: DataFrame, sort_by: str = "message_count", sort_order: str = "desc", limit: int | None = 10) -> DataFrame:
    """One row a thread, quoted rows aside: counts, first and last time, and its latest message. One
    aggregate; no second look at the messages. participant_count counts distinct sender-and-recipients
    combinations, n_people distinct addresses."""
    rows = messages.where(F.col("thread_id").isNotNull() & not_quoted())
    latest = F.max_by(F.struct("id", "subject", "ts_raw", "from_address", "from_name", "subject_thread_key"), F.struct("ts_raw", "id"))
    people = F.size(F.array_distinct(F.flatten(F.collect_set(F.concat(F.array("from_address"), "recipients")))))
    threads = rows.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.countDistinct(F.concat("sender", F.to_json("recipients"))).alias("participant_count"), people.cast("long").alias("n_people"),
        F.min("ts_raw").alias("first_message"), F.max("ts_raw").alias("last_message"), latest.alias("latest"))
    key = F.col(ORDERS.get(sort_by, "message_count"))
    ordered = threads.orderBy(key.asc() if sort_order == "asc" else key.desc(), "thread_id")
    out = ordered if limit is None else ordered.limit(limit)
    return out.select("thread_id", "message_count", "participant_count", "n_people", "first_message", "last_message", F.col("latest.subject_thread_key").alias("subject_thread_key"),
                      F.col("latest.id").alias("latest_id"), F.col("latest.subject").alias("latest_subject"), F.col("latest.from_address").alias("latest_from"))


def of_thread(messages: DataFrame, thread_id: str) -> Column:
    """Rows of a thread: by thread_id, or, if there is none of that name, by subject key."""
    key = thread_id.replace("thread-", "")
    known = messages.where(F.col("thread_id") == thread_id).limit(1).count()
    return F.col("thread_id") == thread_id if known else F.col("subject_thread_key") == key


def conversation(messages: DataFrame, thread_id: str) -> DataFrame:
    """All messages of a thread, quoted ones too, oldest first."""
    return messages.where(of_thread(messages, thread_id)).orderBy("ts_raw", "id")


def summary(rows: DataFrame) -> DataFrame:
    """One row about a thread's messages; none if there are none."""
    people = F.array_distinct(F.flatten(F.collect_set(F.concat(F.array("from_address"), F.coalesce("to_addresses", F.array().cast("array<string>")), F.coalesce("cc_addresses", F.array().cast("array<string>"))))))
    return rows.agg(
        F.count(F.lit(1)).alias("message_count"), F.sort_array(people).alias("participants"), F.coalesce(F.sum(F.col("has_attachments").cast("long")), F.lit(0)).alias("attachment_count"),
        F.min("ts_raw").alias("first_message"), F.max("ts_raw").alias("last_message"), F.min_by("subject", F.struct("ts_raw", "id")).alias("subject")).where("message_count > 0")


def arc(messages: DataFrame, thread_id: str, mode: str = "summary", max_messages: int = 20) -> DataFrame:
    """The first messages of a thread, quoted ones aside: sender, direction and a beginning of the text (full: all of it)."""
    rows = messages.where(of_thread(messages, thread_id) & not_quoted()).orderBy("ts_raw", "id").limit(max_messages)
    text = prefix_snippet(200) if mode == "summary" else F.coalesce(main_text(), F.lit(""))
    return rows.select("id", "ts_raw", display_sender().alias("from"), "from_address", direction().alias("direction"), "subject", text.alias("text"), "recipients").orderBy("ts_raw", "id")


def expand(page: DataFrame, messages: DataFrame) -> DataFrame:
    """All messages, quoted ones aside, of the threads a page touches: one row a thread."""
    rows = messages.where(not_quoted()).join(page.select("thread_id").distinct(), "thread_id", "left_semi")
    each = F.struct("ts_raw", "id", "from_address", "subject", prefix_snippet(500).alias("snippet"))
    return rows.groupBy("thread_id").agg(F.sort_array(F.collect_list(each)).alias("messages"))
