"""Predicates and projections of a search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from epistle.functions import sqlsem
from epistle.schema import QUOTED

DEFAULT_FIELDS = ("id", "subject", "from_address", "from_name", "recipients", "ts_raw", "thread_id", "has_attachments", "attachments", "is_outbound", "category_tags", "project_tags")
HIDDEN = ("raw_eml", "embedding")
FIELDS = ("id", "message_id", "thread_id", "subject_thread_key", "ts_raw", "from_address", "from_name", "sender", "to_addresses", "cc_addresses", "recipients", "subject", "body_markdown",
          "body_text", "body_main_text", "has_attachments", "attachments", "folder", "source", "parent_id", "content_hash", "category_tags", "project_tags", "is_outbound", "x_mailer")


def not_quoted() -> Column:
    return F.col("source").isNull() | (F.col("source") != QUOTED)


def any_contains(arrays: Column, text: str) -> Column:
    """LIKE %text% over the elements of an array; null holds nothing."""
    return F.coalesce(F.exists(arrays, lambda t: sqlsem.contains(t, text)), F.lit(False))


def tag_group(category: str | None, project: str | None, match: str = "substring") -> Column | None:
    """One OR over all comma-separated tags of both parameters, in either tag column."""
    tags = [t.strip() for p in (category, project) if p for t in p.split(",") if t.strip()]
    if not tags:
        return None
    test = any_contains if match == "substring" else lambda c, t: F.coalesce(F.array_contains(c, t), F.lit(False))
    return reduce(lambda a, b: a | b, [test(F.col(c), t) for t in tags for c in ("category_tags", "project_tags")])


def where(*, category=None, project=None, date_from=None, date_to=None, from_address=None, from_name=None, to_address=None, is_outbound=None, has_attachments=None,
          folder=None, cursor=None, ascending=False, include_quoted=False, tag_match="substring", chronological=False) -> Column:
    """The conjunction of all given conditions. Dates compare as text, or as time if chronological."""
    at = F.col("ts") if chronological else F.col("ts_raw")
    limit = (lambda v: F.to_timestamp(F.lit(v))) if chronological else F.lit
    conditions = [None if include_quoted else not_quoted(), tag_group(category, project, tag_match)]
    for value, make in (
        (date_from, lambda v: at >= limit(v)), (date_to, lambda v: at <= limit(v)), (from_address, lambda v: F.col("from_address") == v),
        (from_name, lambda v: sqlsem.contains(F.col("from_name"), v)), (to_address, lambda v: any_contains(F.col("recipients"), v)),
        (is_outbound, lambda v: F.col("is_outbound") == v), (has_attachments, lambda v: F.col("has_attachments") == v), (folder, lambda v: F.col("folder") == v),
        (cursor, lambda v: sqlsem.after(F.col("ts_raw"), F.col("id"), sqlsem.decode_cursor(v), ascending)),
    ):
        if value is not None:
            conditions.append(make(value))
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def names(fields: list[str] | None) -> list[str]:
    """The fields to show: unknown and hidden names are dropped, nothing left means id."""
    return [f for f in dict.fromkeys(DEFAULT_FIELDS if fields is None else fields) if f in FIELDS] or ["id"]


def columns(fields: list[str] | None) -> list[Column]:
    """Projection of the named fields."""
    made = {"body_text": body_text(), "body_main_text": main_text()}
    return [made.get(f, F.col(f)).alias(f) for f in names(fields)]


def body_text() -> Column:
    return F.coalesce("body_text", "body_markdown")


def main_text() -> Column:
    return F.coalesce(F.nullif("body_main_text", F.lit("")), "body_text", "body_markdown")


def prefix_snippet(n: int) -> Column:
    """The first n characters of the text to show."""
    return F.substring(F.coalesce(main_text(), F.lit("")), 1, n)


def display_sender() -> Column:
    return F.coalesce(F.nullif("from_name", F.lit("")), "from_address")


def direction() -> Column:
    return F.when(F.col("is_outbound"), "outbound").otherwise("inbound")
