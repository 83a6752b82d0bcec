"""The opN queries over the documents and embeddings tables, with their SQL where there is any."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession



def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the public tokenizers, or of the folder TOKENIZER_DIR names."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


TOKENIZER = tokenizer_path()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), TOKENIZER).drop("source")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .attribution import count_tokens

    return count_tokens(documents(spark, sf_dir), TOKENIZER)


def surrogate_key(spark: SparkSession) -> str:
    """The secret behind the surrogates: spark.epistle.pii.key. Where it is unset, as in tests and checks, a key that protects nothing."""
    return spark.conf.get("spark.epistle.pii.key", "not a secret: set spark.epistle.pii.key")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace_entities

    return replace_entities(documents(spark, sf_dir), key=surrogate_key(spark)).select("doc_id", "text", "n_entities")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .common import crc_mod
    from .langid import fit, identify

    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 3) == 1
    named = identify(docs, fit(docs, ~held_out))
    return named.select("doc_id", held_out.alias("held_out"), F.col("lang_pred"), "score", "rejected")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spotsigs import fingerprints_of_edits

    return fingerprints_of_edits(documents(spark, sf_dir))


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import crc_mod
    from .ppm import score

    return score(documents(spark, sf_dir), crc_mod("doc_id", 10) == 0)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(documents(spark, sf_dir), length=35, keep_text=False)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .ann import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


QUERIES = {
    "op1_ppm": op1_ppm,
    "op2_substring": op2_substring,
    "op10_ann": op10_ann,
    "op3_pii": op3_pii,
    "op5_language_id": op5_language_id,
    "op7_simhash": op7_simhash,
    "op8_spotsigs": op8_spotsigs,
    "op4_packing": op4_packing,
    "op6_mixing": op6_mixing,
    "op9_token_counts": op9_token_counts,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op6_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS ord
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS n,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, 2 * n AS most, row_number() OVER (ORDER BY 2 * n / w, source NULLS LAST) AS k FROM s),
p AS (
  SELECT *, 1.5 * sum(n) OVER () - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight FROM c),
f AS (SELECT min(k) AS k FROM p WHERE w * rest / weight <= most),
t AS (
  SELECT p.source, p.n, CASE WHEN p.k < f.k THEN p.most ELSE p.w * q.rest / q.weight END AS target
  FROM p, f JOIN p q ON q.k = f.k),
r AS (
  SELECT source, CAST(n AS BIGINT) AS n, target, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t),
g AS (
  SELECT d.doc_id, d.size, r.n AS source_size, r.target,
         CASE WHEN r.n = 0 THEN 0 ELSE r.quota // r.n END AS rounds, CASE WHEN r.n = 0 THEN 0 ELSE r.quota % r.n END AS rest,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(rounds * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM g
"""
