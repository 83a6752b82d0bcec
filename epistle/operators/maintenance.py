"""Deduplication, enrichment, backfills and quality checks of the archive."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epistle.functions import text as X
from epistle.schema import QUOTED

from .analytics import aliases, owner

# The words that put a message into a category.
CATEGORIES = {
    "scheduling": ["meeting", "calendar", "invite", "accepted", "declined", "tentative"],
    "security": ["security", "audit", "compliance", "nist", "cmmc", "assessment", "risk"],
    "infrastructure": ["server", "network", "exchange", "vmware", "domain join", "active directory"],
    "project_management": ["project", "pmo", "requirements", "deliverable", "milestone", "sprint", "scrum"],
    "finance": ["invoice", "payment", "budget", "cost", "purchase", "contract", "renewal"],
    "hr": ["benefits", "enrollment", "performance", "training", "onboarding", "pto"],
    "social": ["coffee", "conversation", "lunch", "birthday", "holiday", "celebration"],
    "vendor": ["demo", "trial", "license", "renewal", "contract", "proposal", "quote"],
    "system_notification": ["undeliverable", "bounce", "auto-reply", "out of office", "delivery status"],
}
SIMILAR = 0.98


# -- deduplication ---------------------------------------------------------------------------------

def new_messages(parsed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Parsed messages whose message_id is not stored, the one of the least path of each."""
    rows = parsed if stored is None else parsed.join(stored.select("message_id"), "message_id", "left_anti")
    first = F.row_number().over(Window.partitionBy("message_id").orderBy("source_path", "id"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def new_quotes(quotes: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Quotes whose content is not stored, the earliest (time, id) of each content."""
    rows = quotes
    if stored is not None:
        rows = rows.join(stored.where("content_hash IS NOT NULL").select("content_hash"), "content_hash", "left_anti")
    first = F.row_number().over(Window.partitionBy("content_hash").orderBy("ts_raw", "id"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def unlike_in_thread(quotes: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Quotes without one nearly alike that was kept before them in their thread, in order of time and id."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_raw", "id"])
        kept: list[np.ndarray] = []
        mask = []
        for v in pdf["embedding"]:
            x = None if v is None else np.asarray(v, float) / max(np.linalg.norm(v), 1e-12)
            mask.append(x is None or not kept or float((np.stack(kept) @ x).max()) < least)
            if x is not None and mask[-1]:
                kept.append(x)
        return pdf[mask]

    return quotes.groupBy("thread_id").applyInPandas(keep, quotes.schema)


def attachment_registry(attachments: DataFrame) -> DataFrame:
    """One row for each content: the first owner (by order, then message) and how many hold it."""
    first = F.min_by(F.struct("id", "path", "filename", "mime_type", "size_bytes"), F.struct("ts_raw", "id", "filename"))
    return attachments.groupBy("sha256").agg(first.alias("f"), F.count(F.lit(1)).alias("n_uses")).select(
        "sha256", F.col("f.id").alias("first_message_id"), "f.path", "f.filename", "f.mime_type", "f.size_bytes", "n_uses")


def only_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key right lacks: files without an entry, vectors without a message."""
    return left.join(right.select(key).distinct(), key, "left_anti")


# -- enrichment ------------------------------------------------------------------------------------

def categories(subject: Column, body: Column) -> Column:
    """Sorted names of all categories one of whose words occurs in the subject or the first 1500 characters. A word is
    looked for as a plain string first; only where it occurs does a pattern decide whether it stands alone."""
    text = F.lower(F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, 1500)))

    def named(t):
        stands = lambda w: t.contains(w) if " " in w else t.contains(w) & t.rlike(rf"(?U)\b{w}\b")
        return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, map(stands, words)), F.lit(name)) for name, words in sorted(CATEGORIES.items())]))

    # bound in a lambda, so that the text is lowered once
    return F.get(F.transform(F.array(text), named), F.lit(0))


def tag_projects(messages: DataFrame, registry: DataFrame, most_names: int = 100_000) -> DataFrame:
    """Adds project_tags: sorted names of the projects one of whose names occurs in subject or the first 2000 characters, and CR
    numbers of the subject. The registry is broadcast up to `most_names` names; a larger one is refused,
    because looking for each name in each text is the wrong plan for it."""
    names = registry.select(F.col("name").alias("_project"), F.explode(F.array_distinct(F.concat(F.array("name"), aliases(F.col("aliases"))))).alias("_alias")).where("_alias <> ''")
    if names.limit(most_names + 1).count() > most_names:
        raise ValueError(f"more than {most_names} project names")
    listed = names.agg(F.collect_list(F.struct(F.col("_project").alias("project"), F.lower("_alias").alias("alias"))).alias("_names"))
    text = F.lower(F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.substring(F.coalesce("body_markdown", F.lit("")), 1, 2000)))
    rows = messages.drop("project_tags").withColumn("_text", text).crossJoin(F.broadcast(listed))  # one row
    found = F.expr("transform(filter(_names, n -> contains(_text, n.alias)), n -> n.project)")
    crs = F.regexp_extract_all(F.coalesce("subject", F.lit("")), F.lit(r"CR\d+"), F.lit(0))
    return rows.withColumn("project_tags", F.array_sort(F.array_distinct(F.concat(found, crs)))).drop("_text", "_names")


def is_outbound(owners: list[str]) -> Column:
    """Sent by one of the owners, whatever the case."""
    return F.coalesce(F.lower("from_address").isin([o.lower() for o in owners]), F.lit(False))


def merge_tags(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers of a classifier (id, categories, projects) merged: categories joined, projects replaced."""
    none = F.array().cast("array<string>")
    rows = messages.join(answers, "id", "left")
    answered = F.col("categories").isNotNull() | F.col("projects").isNotNull()
    joined = F.array_sort(F.array_union(F.coalesce("category_tags", none), F.coalesce("categories", none)))
    return rows.withColumn("category_tags", F.when(answered, joined).otherwise(F.col("category_tags"))).withColumn(
        "project_tags", F.when(answered, F.coalesce("projects", none)).otherwise(F.col("project_tags"))).drop("categories", "projects")


def untagged(messages: DataFrame, after: tuple[str, str] | None = None, limit: int = 100) -> DataFrame:
    """A batch of messages without project tags, by (time, id), from after a key on."""
    rows = messages.where("project_tags IS NULL OR size(project_tags) = 0")
    if after is not None:
        rows = rows.where((F.col("ts_raw") > after[0]) | ((F.col("ts_raw") == after[0]) & (F.col("id") > after[1])))
    return rows.orderBy("ts_raw", "id").limit(limit)


def discovery_sample(messages: DataFrame, n: int = 500, seed: int = 0) -> DataFrame:
    """n random messages with more than 100 characters of text, the same for the same seed."""
    rows = messages.where(F.length("body_text") > 100)
    return rows.orderBy(F.xxhash64(F.col("id"), F.lit(seed)), "id").limit(n)


# -- backfills: fill what is missing, change nothing else ------------------------------------------

def backfill(messages: DataFrame, kind: str, registry: DataFrame | None = None) -> DataFrame:
    """messages with one kind of missing values filled in. Running it again changes nothing."""
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    none = F.array().cast("array<string>")
    if kind == "sender":
        return messages.withColumns({"sender": F.when(empty("sender"), F.col("from_address")).otherwise(F.col("sender")), "body_text": F.coalesce("body_text", "body_plain", "body_markdown"), "source": F.coalesce("source", F.lit("original"))})
    if kind == "from_name":
        return messages.withColumn("from_name", F.when(empty("from_name"), X.derived_name(F.col("from_address"))).otherwise(F.col("from_name")))
    if kind == "thread_id":
        key = X.subject_key(F.col("subject"))
        return messages.withColumn("thread_id", F.when(empty("thread_id") & (key != "no-subject"), X.thread_hash(key, "thread-subj-")).otherwise(F.col("thread_id")))
    if kind == "recipients":
        both = F.array_distinct(F.concat(F.coalesce("to_addresses", none), F.coalesce("cc_addresses", none)))
        return messages.withColumn("recipients", F.when(F.col("recipients").isNull() | (F.size("recipients") == 0), both).otherwise(F.col("recipients")))
    if kind == "is_outbound":
        return messages.crossJoin(F.broadcast(owner(messages).select(F.lower("from_address").alias("_owner")))).withColumn(  # one row
            "is_outbound", F.coalesce("is_outbound", F.lower("from_address") == F.col("_owner"))).drop("_owner")
    if kind == "categories":
        made = categories(F.col("subject"), F.col("body_markdown"))
        return messages.withColumn("category_tags", F.when(F.col("category_tags").isNull() | (F.size("category_tags") == 0), made).otherwise(F.col("category_tags")))
    if kind == "projects":
        found = tag_projects(messages.withColumnRenamed("project_tags", "_had"), registry)
        return found.withColumn("project_tags", F.when(F.col("_had").isNull() | (F.size("_had") == 0), F.col("project_tags")).otherwise(F.col("_had"))).drop("_had").select(*messages.columns)
    if kind == "body_text":
        plain = F.when(X.has_formatting(F.col("body_markdown")), X.markdown_plain(F.col("body_markdown"))).otherwise(F.col("body_markdown"))
        return messages.withColumn("body_text", F.when(empty("body_text"), F.coalesce(F.nullif("body_plain", F.lit("")), plain)).otherwise(F.col("body_text")))
    if kind == "body_main_text":
        return messages.withColumn("body_main_text", F.when(empty("body_main_text"), X.main_text("body_text", "body_markdown")).otherwise(F.col("body_main_text")))
    raise ValueError(f"no backfill {kind!r}")


# -- quality ---------------------------------------------------------------------------------------

def _rate(name: str, bad: Column, of: Column | None = None) -> list[Column]:
    scope = F.lit(True) if of is None else of
    return [F.sum((scope & bad).cast("long")).alias(f"{name}_bad"), F.sum(scope.cast("long")).alias(f"{name}_of")]


def quality(messages: DataFrame) -> DataFrame:
    """check, n_bad, n_checked, rate (0 where nothing was checked), for every check that one scan answers."""
    quoted = F.coalesce(F.col("source") == QUOTED, F.lit(False))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    checks = {
        "headers": (F.col("from_address").isNull() | F.col("subject").isNull() | F.col("ts").isNull(), None),
        "raw_html": (X.raw_html(F.col("body_markdown")), None),
        "empty_text": (F.trim(F.coalesce(F.nullif("body_main_text", F.lit("")), "body_text", "body_markdown", F.lit(""))) == "", None),
        "text_missing": (F.col("body_text").isNull(), None),
        "text_is_markdown": (F.coalesce((F.col("body_text") == F.col("body_markdown")) & X.has_formatting(F.col("body_markdown")), F.lit(False)), F.col("body_text").isNotNull()),
        "attachment_flag": (F.coalesce(F.col("has_attachments"), F.lit(False)) != (size("attachments") > 0), None),
        "embedding_missing": (F.col("embedding").isNull(), ~quoted),
        "quote_links": (F.col("parent_id").isNull() | F.col("content_hash").isNull(), quoted),
        "quote_length": (F.length(F.coalesce("body_text", F.lit(""))) <= 50, quoted),
        "calendar_subjects": (F.coalesce(F.col("subject").rlike("^(Accepted|Declined|Canceled|Tentative):"), F.lit(False)), None),
    }
    wide = with_all(messages).agg(*[c for name, (bad, of) in checks.items() for c in _rate(name, bad, of)])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(f"{n}_bad", F.lit(0)).alias("n_bad"), F.coalesce(f"{n}_of", F.lit(0)).alias("n_checked")) for n in checks])).alias("r")
    return wide.select(rows).select("r.*").withColumn("rate", F.round(F.coalesce(F.try_divide("n_bad", "n_checked"), F.lit(0.0)), 6))


def with_all(messages: DataFrame) -> DataFrame:
    from epistle.schema import with_defaults

    return with_defaults(messages)


def repeated_hashes(messages: DataFrame) -> DataFrame:
    """content_hash that more than one quote has, with their number."""
    rows = messages.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"))
    return rows.where("n > 1")


def lost_parents(messages: DataFrame) -> DataFrame:
    """Quotes whose parent is not in the table."""
    return messages.where(F.col("parent_id").isNotNull()).join(messages.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")


def agreement(left: DataFrame, right: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """How well two tables agree: n rows in both, and of each field the share that is equal."""
    joined = left.select(key, *[F.col(f).alias(f"_l_{f}") for f in fields]).join(right.select(key, *[F.col(f).alias(f"_r_{f}") for f in fields]), key)
    return joined.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(f"_l_{f}").eqNullSafe(F.col(f"_r_{f}")).cast("double")), 6).alias(f) for f in fields])


def leak_class(markdown: Column) -> Column:
    """What a markdown body is: EMPTY, RAW_HTML, CLEAN (formatted) or PLAIN; NO_RECORD where it is null."""
    return F.when(markdown.isNull(), "NO_RECORD").when(F.trim(markdown) == "", "EMPTY").when(X.raw_html(markdown), "RAW_HTML").when(X.has_formatting(markdown), "CLEAN").otherwise("PLAIN")


def stratified(messages: DataFrame, by: str, each: int) -> DataFrame:
    """`each` rows of every value of `by`, the first by hash of id."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64("id"), "id"))
    return messages.withColumn("_n", n).where(F.col("_n") <= each).drop("_n")


def salvage_rate(messages: DataFrame, least: int = 200) -> DataFrame:
    """Quotes per message with more than `least` characters of text."""
    quoted = F.coalesce(F.col("source") == QUOTED, F.lit(False))
    sums = messages.agg(F.sum(quoted.cast("long")).alias("n_quotes"), F.sum((~quoted & (F.length("body_text") > least)).cast("long")).alias("n_candidates"))
    return sums.withColumn("rate", F.round(F.coalesce(F.try_divide("n_quotes", "n_candidates"), F.lit(0.0)), 6))


def index_report(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row about the vector index: embedded messages, vectors, missing, orphans."""
    have = messages.where("embedding IS NOT NULL").select("id")
    sides = have.withColumn("_m", F.lit(1)).join(vectors.select("id").withColumn("_v", F.lit(1)), "id", "full_outer")
    return sides.agg(F.count("_m").alias("n_embedded"), F.count("_v").alias("n_vectors"), F.count_if(F.col("_v").isNull()).alias("n_missing"), F.count_if(F.col("_m").isNull()).alias("n_orphans"))
