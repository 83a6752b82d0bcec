"""From raw documents to packed training sequences in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet
and reads again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epistle.llm.common import own_prefix, stage
from epistle.llm.langid import fit, identify
from epistle.llm.mixing import mixed_documents
from epistle.llm.packing import pack
from epistle.llm.pii import replace_entities
from epistle.llm.queries import TOKENIZER, documents, surrogate_key
from epistle.llm.simhash import near_duplicates

#: Near duplicates: five-word shingles of Jaccard 0.8 differ in 9.7 of 64 bits on average and in 19.4 of 128; links
#: reach so far beyond that nine in ten of such pairs are found, and most of the closer ones.
SHINGLE, RADIUS, CHECK = 5, 14, 28


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents, drop those too far from every language (and those without a
    letter, so null and empty texts too); a missing lang is filled in. Repeated rows and null doc_id are judged like any
    other. An empty table gives no rows. Where no text has a label nothing can be too far: texts with a letter stay."""
    model = fit(docs, F.lit(True))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = own_prefix(docs)
    named = identify(docs, model, names=own).where(~F.col(own + "rejected"))
    return named.withColumn("lang", F.coalesce("lang", F.col(own + "lang_pred"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that of the smallest (doc_id, hash of the text). A row's group
    is that of its text, so rows of one doc_id or of none are told apart; a row without one stays only if no row of its
    group has any. Of repeated rows one stays. Null and empty texts are one group; an empty table gives no rows."""
    groups = near_duplicates(docs.select("doc_id", "text"), shingle=SHINGLE, radius=RADIUS, check=CHECK)
    own = own_prefix(docs)
    kept = groups.where("first").select(F.col("doc_id").alias(own + "id"), F.col("key").alias(own + "kept")).distinct()
    rows = docs.withColumn(own, F.xxhash64("text"))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(own + "id")) & (F.col(own) == F.col(own + "kept")), "left_semi")
    twin = F.row_number().over(Window.partitionBy("doc_id", own).orderBy(F.xxhash64(*docs.columns)))
    return rows.withColumn(own + "twin", twin).where(F.col(own + "twin") == 1).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates; n_chars, if there is one, follows the text. Null and empty texts stay; repeated rows
    are replaced alike; an empty table gives no rows."""
    replaced = replace_entities(docs, key=surrogate_key(spark))
    if "n_chars" in docs.columns:
        replaced = replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return replaced.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes it. Null and empty texts are never taken, a null source is a source, repeated
    rows are taken alike; an empty table gives no rows."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens in the proportions of the mix. Null and empty texts are an end token, repeated
    rows are packed once each; an empty table gives no rows."""
    return pack(docs, TOKENIZER)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL can express fitting, linking and packing; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
