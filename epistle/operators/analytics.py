"""Timelines, contact profiles, owner detection, projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epistle.functions import sqlsem

from .filters import any_contains, not_quoted, prefix_snippet
from .fulltext import search, tag_phrase


def timeline(messages: DataFrame, granularity: str = "year") -> DataFrame:
    """period, n, first and last time: the total and the bounds of a timeline follow from its rows. Times
    that can't be read have no period."""
    rows = messages.withColumn("period", sqlsem.period(F.col("ts"), granularity))
    return rows.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.min("ts_raw").alias("first_occurrence"), F.max("ts_raw").alias("last_occurrence"))


def mention_timeline(messages: DataFrame, keyword: str, granularity: str = "year", where: Column | None = None) -> DataFrame:
    """The timeline of messages that match a full-text query, quoted ones included as the index holds them."""
    hits = search(messages, keyword, keep=("ts", "ts_raw", "from_address", "is_outbound", "source"))
    return timeline(hits if where is None else hits.where(where), granularity)


def of_contact(name: str | None, address: str | None) -> Column | None:
    """Messages a contact takes part in; a name and an address must both fit."""
    out = None
    if name:
        out = sqlsem.contains(F.col("from_name"), name) | sqlsem.contains(F.col("sender"), name)
        for c in ("recipients", "to_addresses", "cc_addresses"):
            out = F.coalesce(out, F.lit(False)) | any_contains(F.col(c), name)
    if address:
        by_address = (F.col("from_address") == address) | any_contains(F.col("recipients"), address)
        out = by_address if out is None else out & by_address
    return out


def contact_profile(messages: DataFrame, name: str | None = None, address: str | None = None) -> DataFrame:
    """One row: total, first and last time, senders, a display name; none if nothing fits."""
    wanted = of_contact(name, address)
    if wanted is None:
        wanted = F.lit(False)
    return messages.where(wanted & not_quoted()).agg(
        F.count(F.lit(1)).alias("total_messages"), F.min("ts_raw").alias("first_contact"), F.max("ts_raw").alias("last_contact"),
        F.sort_array(F.collect_set("sender")).alias("addresses"), F.min("from_name").alias("display_name")).where("total_messages > 0")


def contact_histogram(messages: DataFrame, name: str | None = None, address: str | None = None) -> DataFrame:
    rows = messages.where(of_contact(name, address) & not_quoted())
    return rows.groupBy(sqlsem.period(F.col("ts"), "year").alias("year")).agg(F.count(F.lit(1)).alias("n")).orderBy("year")


def contact_samples(messages: DataFrame, name: str | None = None, address: str | None = None, limit: int = 10) -> DataFrame:
    rows = messages.where(of_contact(name, address) & not_quoted())
    return rows.orderBy(F.desc("ts_raw"), F.desc("id")).limit(limit).select("id", "subject", "ts_raw", "from_address", prefix_snippet(300).alias("snippet"))


def find_recipient(messages: DataFrame, address: str, limit: int = 50) -> DataFrame:
    """Messages from or to an address, newest first."""
    rows = messages.where((sqlsem.contains(F.col("from_address"), address) | any_contains(F.col("recipients"), address)) & not_quoted())
    return rows.orderBy(F.desc("ts_raw"), F.desc("id")).limit(limit)


def owner(messages: DataFrame) -> DataFrame:
    """The most frequent sender, the first by name of equals."""
    counts = messages.where("from_address IS NOT NULL AND from_address <> ''").groupBy("from_address").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "from_address").limit(1)


def aliases(c: Column) -> Column:
    """Aliases from a JSON array or a comma list."""
    listed = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != "")
    return F.when(F.trim(c).startswith("["), F.coalesce(F.from_json(c, "array<string>"), listed)).otherwise(listed)


def list_projects(registry: DataFrame, limit: int = 20) -> DataFrame:
    return registry.orderBy("name").limit(limit).select("name", aliases(F.col("aliases")).alias("aliases"), "summary", "created_at")


def find_project(registry: DataFrame, name: str) -> DataFrame:
    """The project of that name, else the first whose aliases contain it."""
    rows = registry.where((F.col("name") == name) | sqlsem.contains(F.col("aliases"), name))
    return rows.orderBy((F.col("name") == name).desc(), "name").limit(1)


def project_messages(messages: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Messages tagged with a project, newest first."""
    rows = messages.where(tag_phrase(F.col("project_tags"), name) & not_quoted())
    return rows.orderBy(F.desc("ts_raw"), F.desc("id")).limit(limit).select("id", "subject", "ts_raw", "from_address", "project_tags", prefix_snippet(500).alias("snippet"))
