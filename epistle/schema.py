"""The message table, its side tables, and a message view over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _B, _A = T.StringType(), T.BooleanType(), T.ArrayType(T.StringType())
ATTACHMENT = T.StructType([T.StructField(n, _S) for n in ("filename", "path", "mime_type")] + [T.StructField("size_bytes", T.LongType()), T.StructField("sha256", _S)])
#: One row a message. raw_eml and embedding are never projected by a query.
MESSAGES = T.StructType(
    [T.StructField(n, _S, n not in ("id", "message_id")) for n in ("id", "message_id", "thread_id", "subject_thread_key", "ts_raw")]
    + [T.StructField("ts", T.TimestampType())]
    + [T.StructField(n, _S) for n in ("from_address", "from_name", "sender")]
    + [T.StructField(n, _A) for n in ("to_addresses", "cc_addresses", "recipients")]
    + [T.StructField(n, _S) for n in ("subject", "body_markdown", "body_plain", "body_text", "body_main_text", "x_mailer")]
    + [T.StructField("has_attachments", _B), T.StructField("attachments", T.ArrayType(ATTACHMENT)), T.StructField("folder", _S)]
    + [T.StructField("raw_eml", T.BinaryType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
    + [T.StructField(n, _S) for n in ("source", "parent_id", "content_hash")]
    + [T.StructField(n, _A) for n in ("category_tags", "project_tags")]
    + [T.StructField("is_outbound", _B), T.StructField("source_path", _S)]
)
VECTORS = T.StructType([T.StructField("id", _S, False), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("norm", T.DoubleType()), T.StructField("searchable", _B),
                        T.StructField("ts_raw", _S), T.StructField("from_address", _S), T.StructField("is_outbound", _B), T.StructField("has_attachments", _B)])
REGISTRY = T.StructType([T.StructField(n, _S) for n in ("name", "aliases", "summary", "created_at")])
QUOTED = "quoted_reply"


def validate_schema(df: DataFrame, expected: T.StructType, required: tuple[str, ...] | None = None) -> DataFrame:
    """df, or ValueError naming every missing column and every column of another type."""
    types = dict(df.dtypes)
    wrong = [f"{f.name} is missing" for f in expected if f.name not in types and (required is None or f.name in required)]
    wrong += [f"{f.name} is {types[f.name]}, not {f.dataType.simpleString()}" for f in expected if types.get(f.name, f.dataType.simpleString()) != f.dataType.simpleString()]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df


def with_defaults(df: DataFrame) -> DataFrame:
    """df with every column of MESSAGES that it lacks, as null: tables of older layouts stay readable."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in MESSAGES if f.name not in df.columns})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages: events give time and recipient, labels and embeddings the rest."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    lab, vec = table(spark, sf_dir, "labels").select("doc_id", "toxic"), table(spark, sf_dir, "embeddings")
    joined = d.join(e, d.doc_id == e.event_id).join(lab, "doc_id", "left").join(vec.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    to = F.array(F.format_string("user%d@example.com", "user_id"))
    cc = F.when(F.col("doc_id") % 3 == 0, F.array(F.format_string("user%d@example.com", F.col("user_id") % 7))).otherwise(F.array().cast("array<string>"))
    return joined.select(
        F.col("doc_id").alias("id"), F.format_string("<doc%d@example.com>", "doc_id").alias("message_id"), F.concat(F.lit("thread-"), (F.col("doc_id") % 97).cast("string")).alias("thread_id"),
        F.lower(F.substring("text", 1, 20)).alias("subject_thread_key"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_raw"), "ts",
        F.concat(d.source, F.lit("@example.com")).alias("from_address"), F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("Name "), d.source)).alias("from_name"),
        F.concat(d.source, F.lit("@example.com")).alias("sender"), to.alias("to_addresses"), cc.alias("cc_addresses"), F.concat(to, cc).alias("recipients"),
        F.substring("text", 1, 60).alias("subject"), F.col("text").alias("body_markdown"), F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("body_text"),
        F.when(F.col("doc_id") % 6 == 0, "").when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 400)).alias("body_main_text"),
        (F.col("event_type") == "purchase").alias("has_attachments"), F.lit("Archive").alias("folder"), "embedding",
        F.when(F.col("toxic") == 1, QUOTED).otherwise("original").alias("source"), F.array(d.lang).alias("category_tags"),
        F.when(F.col("label").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("P"), F.col("label").cast("string")))).alias("project_tags"),
        (F.col("event_type") == "click").alias("is_outbound"), "toxic", "label",
    )


#: The same view for the SQL side, to follow WITH.
CORPUS_SQL = """corpus AS (
  SELECT d.doc_id AS id, 'thread-' || CAST(d.doc_id % 97 AS VARCHAR) AS thread_id, lower(substr(d.text, 1, 20)) AS subject_thread_key,
         strftime(e.ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_raw, e.ts AS ts, d.source || '@example.com' AS from_address,
         CASE WHEN d.doc_id % 5 <> 0 THEN 'Name ' || d.source END AS from_name, d.source || '@example.com' AS sender,
         'user' || CAST(e.user_id AS VARCHAR) || '@example.com' AS to_one,
         CASE WHEN d.doc_id % 3 = 0 THEN 'user' || CAST(e.user_id % 7 AS VARCHAR) || '@example.com' END AS cc_one,
         substr(d.text, 1, 60) AS subject, d.text AS body_markdown, CASE WHEN d.doc_id % 4 <> 0 THEN d.text END AS body_text,
         CASE WHEN d.doc_id % 6 = 0 THEN '' WHEN d.doc_id % 2 = 0 THEN substr(d.text, 1, 400) END AS body_main_text,
         e.event_type = 'purchase' AS has_attachments, e.event_type = 'click' AS is_outbound,
         CASE WHEN l.toxic = 1 THEN 'quoted_reply' ELSE 'original' END AS source, d.lang AS category,
         CASE WHEN v.label IS NOT NULL THEN 'P' || CAST(v.label AS VARCHAR) END AS project, v.embedding AS embedding
  FROM documents d JOIN events e ON e.event_id = d.doc_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings v ON v.vec_id = d.doc_id)"""
