"""All queries of the archive engine by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epistle.functions import sqlsem
from epistle.functions import text as X
from epistle.operators import analytics as A
from epistle.operators import filters as P
from epistle.operators import fulltext as S
from epistle.operators import maintenance as M
from epistle.operators import threads as T
from epistle.operators import vectors as V
from epistle.schema import CORPUS_SQL, corpus, table
from epistle.streaming.ingest import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOT_QUOTED = "(source IS NULL OR source <> 'quoted_reply')"
MAIN = "coalesce(nullif(body_main_text, ''), body_text, body_markdown)"


def query(name: str, sql: str | None = None):
    """Register a function of (corpus or spark, sf_dir). SQL over `corpus` gets the view in front."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql if sql.startswith("WITH") or "corpus" not in sql else f"WITH {CORPUS_SQL} {sql.strip()}"
        return f

    return add


def _over_corpus(name: str, make: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(lambda spark, sf_dir: make(corpus(spark, sf_dir)))


# -- threads ---------------------------------------------------------------------------------------

THREADS = f"""
, t AS (SELECT thread_id, count(*) AS message_count,
        count(DISTINCT sender || to_one || coalesce(',' || cc_one, '')) AS participant_count,
        min(ts_raw) AS first_message, max(ts_raw) AS last_message,
        arg_max(id, (ts_raw, id)) AS latest_id FROM corpus WHERE {NOT_QUOTED} GROUP BY thread_id),
 p AS (SELECT thread_id, count(DISTINCT a) AS n_people FROM (
        SELECT thread_id, from_address AS a FROM corpus WHERE {NOT_QUOTED} UNION ALL SELECT thread_id, to_one FROM corpus WHERE {NOT_QUOTED}
        UNION ALL SELECT thread_id, cc_one FROM corpus WHERE {NOT_QUOTED} AND cc_one IS NOT NULL) GROUP BY thread_id)
SELECT t.thread_id, message_count, participant_count, n_people, first_message, last_message, c.subject_thread_key, latest_id,
       c.subject AS latest_subject, c.from_address AS latest_from
FROM t JOIN p USING (thread_id) JOIN corpus c ON c.id = t.latest_id"""

for _name, _sort, _order in (("count", "message_count", "desc"), ("participants", "participants", "desc"), ("last", "last_message", "desc"), ("first", "first_message", "asc")):
    _over_corpus(f"list_threads_{_name}", lambda m, s=_sort, o=_order: T.list_threads(m, s, o, 10),
                 f"WITH {CORPUS_SQL} {THREADS} ORDER BY {T.ORDERS[_sort]} {_order}, t.thread_id LIMIT 10")

_over_corpus("thread_arc_summary", lambda m: T.arc(m, "thread-5", "summary", 8).drop("recipients"), f"""
SELECT id, ts_raw, coalesce(nullif(from_name, ''), from_address) AS "from", from_address, CASE WHEN is_outbound THEN 'outbound' ELSE 'inbound' END AS direction,
       subject, substr(coalesce({MAIN}, ''), 1, 200) AS text
FROM corpus WHERE thread_id = 'thread-5' AND {NOT_QUOTED} ORDER BY ts_raw, id LIMIT 8""")
_over_corpus("thread_arc_full", lambda m: T.arc(m, "thread-6", "full", 5).drop("recipients"), f"""
SELECT id, ts_raw, coalesce(nullif(from_name, ''), from_address) AS "from", from_address, CASE WHEN is_outbound THEN 'outbound' ELSE 'inbound' END AS direction,
       subject, coalesce({MAIN}, '') AS text
FROM corpus WHERE thread_id = 'thread-6' AND {NOT_QUOTED} ORDER BY ts_raw, id LIMIT 5""")
_over_corpus("thread_conversation", lambda m: T.summary(T.conversation(m, "thread-7")).withColumn("participants", F.array_join("participants", ",")), """
, m AS (SELECT * FROM corpus WHERE thread_id = 'thread-7'),
 a AS (SELECT from_address AS a FROM m UNION SELECT to_one FROM m UNION SELECT cc_one FROM m WHERE cc_one IS NOT NULL)
SELECT (SELECT count(*) FROM m) AS message_count, (SELECT string_agg(a, ',' ORDER BY a) FROM a) AS participants,
       (SELECT CAST(sum(CASE WHEN has_attachments THEN 1 ELSE 0 END) AS BIGINT) FROM m) AS attachment_count, (SELECT min(ts_raw) FROM m) AS first_message,
       (SELECT max(ts_raw) FROM m) AS last_message, (SELECT arg_min(subject, (ts_raw, id)) FROM m) AS subject""")
_over_corpus("thread_by_subject_key", lambda m: T.conversation(m.withColumn("subject_thread_key", F.concat(F.lit("key"), (F.col("id") % 31).cast("string"))), "thread-key3").select("id", "ts_raw", "source"),
             "SELECT id, ts_raw, source FROM corpus WHERE id % 31 = 3")
_over_corpus("thread_expansion", lambda m: T.expand(m.where(P.not_quoted()).orderBy(F.desc("ts_raw"), F.desc("id")).limit(10), m).select(
    "thread_id", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda x: x.id.cast("string")), ",").alias("ids")), f"""
, page AS (SELECT thread_id FROM corpus WHERE {NOT_QUOTED} ORDER BY ts_raw DESC, id DESC LIMIT 10)
SELECT thread_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY ts_raw, id) AS ids FROM corpus
WHERE {NOT_QUOTED} AND thread_id IN (SELECT thread_id FROM page) GROUP BY thread_id""")
query("conversation_arc", """
SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       arg_min(substr(text, 1, 200), turn) AS opening FROM conversations GROUP BY conv_id""")(
    lambda spark, d: table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x.role), ">").alias("roles"),
        F.sum(F.length("text")).cast("long").alias("n_chars"), F.min_by(F.substring("text", 1, 200), "turn").alias("opening")))

# -- timelines, contacts, owner ---------------------------------------------------------------------

_PERIODS = {"year": "strftime(ts, '%Y')", "month": "strftime(ts, '%Y-%m')", "quarter": "strftime(ts, '%Y-') || CAST(quarter(ts) AS VARCHAR)"}
for _g, _sql in _PERIODS.items():
    _over_corpus(f"timeline_{_g}", lambda m, g=_g: A.timeline(m, g),
                 f"SELECT {_sql} AS period, count(*) AS n, min(ts_raw) AS first_occurrence, max(ts_raw) AS last_occurrence FROM corpus GROUP BY 1")
query("timeline_events_month", "SELECT strftime(ts, '%Y-%m') AS period, event_type, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda spark, d: table(spark, d, "events").groupBy(sqlsem.period(F.col("ts"), "month").alias("period"), "event_type").agg(F.count(F.lit(1)).alias("n")))
TOKENS = "regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\\p{{L}}\\p{{N}}]+')"
_over_corpus("mention_timeline_month", lambda m: A.mention_timeline(m, "than", "month"), f"""
SELECT strftime(ts, '%Y-%m') AS period, count(*) AS n, min(ts_raw) AS first_occurrence, max(ts_raw) AS last_occurrence FROM corpus
WHERE list_contains({TOKENS.format('subject')}, 'than') OR list_contains({TOKENS.format('body_text')}, 'than') GROUP BY 1""")
_CONTACT = f"(lower(from_name) LIKE '%src1%' OR lower(sender) LIKE '%src1%' OR lower(to_one) LIKE '%src1%' OR lower(cc_one) LIKE '%src1%') AND {NOT_QUOTED}"
_over_corpus("contact_profile", lambda m: A.contact_profile(m, "SRC1").withColumn("addresses", F.array_join("addresses", ",")), f"""
SELECT count(*) AS total_messages, min(ts_raw) AS first_contact, max(ts_raw) AS last_contact, string_agg(DISTINCT sender, ',' ORDER BY sender) AS addresses,
       min(from_name) AS display_name FROM corpus WHERE {_CONTACT}""")
_over_corpus("contact_profile_both", lambda m: A.contact_profile(m, "src2", "user3@example.com").withColumn("addresses", F.array_join("addresses", ",")), f"""
SELECT count(*) AS total_messages, min(ts_raw) AS first_contact, max(ts_raw) AS last_contact, string_agg(DISTINCT sender, ',' ORDER BY sender) AS addresses,
       min(from_name) AS display_name FROM corpus WHERE (lower(from_name) LIKE '%src2%' OR lower(sender) LIKE '%src2%') AND {NOT_QUOTED}
       AND (from_address = 'user3@example.com' OR lower(to_one) LIKE '%user3@example.com%' OR lower(cc_one) LIKE '%user3@example.com%') HAVING count(*) > 0""")
_over_corpus("contact_histogram", lambda m: A.contact_histogram(m, "src1"), f"SELECT strftime(ts, '%Y') AS year, count(*) AS n FROM corpus WHERE {_CONTACT} GROUP BY 1")
_over_corpus("contact_samples", lambda m: A.contact_samples(m, "src1"), f"""
SELECT id, subject, ts_raw, from_address, substr(coalesce({MAIN}, ''), 1, 300) AS snippet FROM corpus WHERE {_CONTACT} ORDER BY ts_raw DESC, id DESC LIMIT 10""")
_over_corpus("find_recipient", lambda m: A.find_recipient(m, "user3@example.com").select("id", "ts_raw", "from_address"), f"""
SELECT id, ts_raw, from_address FROM corpus WHERE {NOT_QUOTED} AND (lower(from_address) LIKE '%user3@example.com%' OR lower(to_one) LIKE '%user3@example.com%'
OR lower(cc_one) LIKE '%user3@example.com%') ORDER BY ts_raw DESC, id DESC LIMIT 50""")
_over_corpus("owner_detection", A.owner, "SELECT from_address, count(*) AS n FROM corpus WHERE from_address <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
_over_corpus("direction_flag", lambda m: m.select("id", M.is_outbound(["SRC1@example.com", "src2@EXAMPLE.com"]).alias("outbound"), P.direction().alias("direction")), """
SELECT id, lower(from_address) IN ('src1@example.com', 'src2@example.com') AS outbound, CASE WHEN is_outbound THEN 'outbound' ELSE 'inbound' END AS direction FROM corpus""")

# -- filters, projections, pages ---------------------------------------------------------------------

_over_corpus("filter_metadata_all", lambda m: m.where(P.where(date_from="2024-01-01T12", date_to="2024-01-20", from_name="NAME src1", is_outbound=False)).select("id", "ts_raw", "from_address"), f"""
SELECT id, ts_raw, from_address FROM corpus WHERE ts_raw >= '2024-01-01T12' AND ts_raw <= '2024-01-20' AND lower(from_name) LIKE '%name src1%' AND NOT is_outbound AND {NOT_QUOTED}""")
_over_corpus("filter_to_address", lambda m: m.where(P.where(to_address="USER1", has_attachments=True)).select("id"), f"""
SELECT id FROM corpus WHERE (lower(to_one) LIKE '%user1%' OR coalesce(lower(cc_one) LIKE '%user1%', false)) AND has_attachments AND {NOT_QUOTED}""")
_over_corpus("filter_from_folder", lambda m: m.where(P.where(from_address="src3@example.com", folder="Archive")).select("id", "folder"),
             f"SELECT id, 'Archive' AS folder FROM corpus WHERE from_address = 'src3@example.com' AND {NOT_QUOTED}")
_over_corpus("tag_filter_or_group", lambda m: m.where(P.where(category="fr, DE", project="p3")).select("id", "source"), f"""
SELECT id, source FROM corpus WHERE {NOT_QUOTED} AND (lower(category) LIKE '%fr%' OR lower(category) LIKE '%de%' OR lower(category) LIKE '%p3%'
OR coalesce(lower(project) LIKE '%fr%' OR lower(project) LIKE '%de%' OR lower(project) LIKE '%p3%', false))""")
_over_corpus("tag_filter_exact", lambda m: m.where(P.where(project="P3", tag_match="exact")).select("id"), f"SELECT id FROM corpus WHERE {NOT_QUOTED} AND project = 'P3'")


def _page(m: DataFrame, ascending: bool) -> DataFrame:
    start = m.where(P.not_quoted()).orderBy("ts_raw", "id").select("ts_raw", "id").limit(100).orderBy(F.desc("ts_raw"), F.desc("id")).first()
    rows = m.where(P.where(cursor=sqlsem.encode_cursor(start.ts_raw, start.id), ascending=ascending))
    order = ("ts_raw", "id") if ascending else (F.desc("ts_raw"), F.desc("id"))
    return rows.orderBy(*order).limit(25).select("id", "ts_raw", "subject")


for _name, _op, _dir in (("asc", ">", "ASC"), ("desc", "<", "DESC")):
    _over_corpus(f"keyset_page_{_name}", lambda m, a=_name == "asc": _page(m, a), f"""
, k AS (SELECT ts_raw AS t, id AS i FROM corpus WHERE {NOT_QUOTED} ORDER BY ts_raw, id LIMIT 1 OFFSET 99)
SELECT id, ts_raw, subject FROM corpus, k WHERE {NOT_QUOTED} AND (ts_raw {_op} t OR (ts_raw = t AND id {_op} i)) ORDER BY ts_raw {_dir}, id {_dir} LIMIT 25""")
_over_corpus("count_only", lambda m: S.search(m, "the AND of", keep=("source",)).where(P.not_quoted()).agg(F.count(F.lit(1)).alias("n")), f"""
SELECT count(*) AS n FROM corpus WHERE {NOT_QUOTED}
AND (list_contains({TOKENS.format('subject')}, 'the') OR list_contains({TOKENS.format('body_text')}, 'the'))
AND (list_contains({TOKENS.format('subject')}, 'of') OR list_contains({TOKENS.format('body_text')}, 'of'))""")
_over_corpus("point_lookup", lambda m: m.where(F.col("id") == 42).select("id", "subject", P.body_text().alias("body_text")),
             "SELECT id, subject, coalesce(body_text, body_markdown) AS body_text FROM corpus WHERE id = 42")
_over_corpus("field_projection_fallbacks", lambda m: m.select(*P.columns(["id", "body_text", "nonsense", "embedding", "body_main_text", "from_name"]), P.display_sender().alias("shown"), P.prefix_snippet(300).alias("snippet")), f"""
SELECT id, coalesce(body_text, body_markdown) AS body_text, {MAIN} AS body_main_text, from_name, coalesce(nullif(from_name, ''), from_address) AS shown,
       substr(coalesce({MAIN}, ''), 1, 300) AS snippet FROM corpus""")
_over_corpus("snippet_prefix", lambda m: m.select("id", *[P.prefix_snippet(n).alias(f"s{n}") for n in (200, 300, 500)]),
             f"SELECT id, substr({MAIN}, 1, 200) AS s200, substr({MAIN}, 1, 300) AS s300, substr({MAIN}, 1, 500) AS s500 FROM corpus")

# -- full text -----------------------------------------------------------------------------------------

_DOC_WORDS = "w AS (SELECT doc_id AS id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) AS term FROM documents)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("subject"), F.col("text").alias("body_text"), "lang")


query("postings_stats", f"WITH {_DOC_WORDS} SELECT term, count(DISTINCT id) AS n_docs, count(*) AS n_occurrences FROM w GROUP BY term")(
    lambda spark, d: S.term_statistics(_docs(spark, d)))
query("postings", f"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents),
w AS (SELECT id, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS pos FROM d)
SELECT term, id, count(*) AS n, min(pos) AS first_at, max(pos) AS last_at FROM w GROUP BY term, id""")(
    lambda spark, d: S.postings(_docs(spark, d), ("body_text",)).select("term", "id", F.size("positions").cast("long").alias("n"), F.array_min("positions").cast("long").alias("first_at"), F.array_max("positions").cast("long").alias("last_at")))
query("doc_stats", f"WITH {_DOC_WORDS} SELECT d.doc_id AS id, count(w.term) AS length FROM documents d LEFT JOIN w ON w.id = d.doc_id GROUP BY 1")(
    lambda spark, d: S.document_lengths(_docs(spark, d)).select("id", F.col("length").cast("long").alias("length")))


def _bm25_sql(hits: list[str], match: str, tail: str = "") -> str:
    """SQL of a ranked search: hits are expressions over w (the tokens) that count each phrase."""
    n = len(hits)
    score = " + ".join(f"greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * len / av))" for k in range(n))
    return f"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
c AS (SELECT id, CAST(len(w) AS DOUBLE) AS len, {', '.join(f'CAST({h} AS DOUBLE) AS f{k}' for k, h in enumerate(hits))} FROM d),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len) AS av, {', '.join(f'CAST(sum(CASE WHEN f{k} > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS d{k}' for k in range(n))} FROM c),
h AS (SELECT id, -({score}) AS r FROM c, s WHERE {match})
{tail or 'SELECT id, round(r, 6) AS rank FROM h'}"""


def _term(t: str) -> str:
    return f"len(list_filter(w, lambda x: x = '{t}'))"


_INDEXES: dict = {}


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The stored index over the documents: postings by ranges of terms, and lengths. Built by the first query of a session that
    needs it, as an archive builds it when it loads."""
    key = spark.sparkContext.applicationId, d
    if key not in _INDEXES:
        path = scratch(spark, "index")
        S.postings(_docs(spark, d)).repartitionByRange("term").sortWithinPartitions("term", "id").write.parquet(f"{path}/postings")
        S.document_lengths(_docs(spark, d)).write.parquet(f"{path}/lengths")
        _INDEXES[key] = path
    return spark.read.parquet(f"{_INDEXES[key]}/postings"), spark.read.parquet(f"{_INDEXES[key]}/lengths")


def _ranked(query_text: str):
    return lambda spark, d: S.search_index(*_index(spark, d), query_text).select("id", F.round("rank", 6).alias("rank"))


query("bm25_and", _bm25_sql([_term("the"), _term("than"), _term("with")], "f0 > 0 AND f1 > 0 AND f2 > 0"))(_ranked("the than with"))
query("bm25_or", _bm25_sql([_term("than"), _term("pour")], "f0 > 0 OR f1 > 0"))(_ranked("than OR pour"))
query("bm25_not", _bm25_sql([_term("der"), _term("und"), _term("nicht")], "f0 > 0 AND f1 > 0 AND NOT f2 > 0"))(_ranked("(der AND und) NOT nicht"))
query("bm25_phrase", _bm25_sql(["len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))"], "f0 > 0"))(_ranked('"of the"'))
query("bm25_prefix", _bm25_sql(["len(list_filter(w, lambda x: starts_with(x, 'tha')))"], "f0 > 0"))(_ranked("tha*"))
query("bm25_column", _bm25_sql([_term("than")], "f0 > 0"))(_ranked("body_text : than"))
query("bm25_near", _bm25_sql([_term("the"), _term("with"), "len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'the' AND (list_contains(w[i + 1 : i + 3], 'with') OR list_contains(w[greatest(i - 3, 1) : i - 1], 'with'))))"],
                            "f2 > 0").replace(" + greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * len / av))", ""))(_ranked("NEAR(the with, 2)"))
query("bm25_minmax", _bm25_sql([_term("the"), _term("than")], "f0 > 0 AND f1 > 0", """
, p AS (SELECT id, round(r, 6) AS rank FROM h ORDER BY rank, id LIMIT 20)
SELECT id, rank, CASE WHEN max(rank) OVER () = min(rank) OVER () THEN 1.0 ELSE round(1 - (rank - min(rank) OVER ()) / (max(rank) OVER () - min(rank) OVER ()), 4) END AS relevance FROM p"""))(
    lambda spark, d: S.relevance(_ranked("the AND than")(spark, d).orderBy("rank", "id").limit(20)))
query("bm25_worst_first", _bm25_sql([_term("the"), _term("than")], "f0 > 0 AND f1 > 0", "SELECT id, round(r, 6) AS rank FROM h ORDER BY round(r, 6) DESC, id LIMIT 20"))(
    lambda spark, d: _ranked("the AND than")(spark, d).orderBy(F.desc("rank"), "id").limit(20))
query("bm25_from_postings", _bm25_sql([_term("the"), _term("than")], "f0 > 0 AND f1 > 0"))(
    lambda spark, d: S.search_postings(S.postings(_docs(spark, d), ("body_text",)), S.document_lengths(_docs(spark, d)), ["the", "than"]).select("id", F.round("rank", 6).alias("rank")))
query("bm25_scan", _bm25_sql([_term("the"), _term("than")], "f0 > 0 AND f1 > 0"))(
    lambda spark, d: S.search(_docs(spark, d), "the AND than").select("id", F.round("rank", 6).alias("rank")))
query("snippet_fts")(lambda spark, d: S.snippets(S.search(_docs(spark, d), '"of the" OR pour', keep=("body_text",)).orderBy("rank", "id").limit(50), '"of the" OR pour').select("id", "rank", "snippet"))

# -- vectors ----------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _seed(v: DataFrame, seed: int) -> list[float]:
    row = v.where(F.col("id") == seed).select("embedding").first()
    return list(row.embedding) if row else [1.0]


_COS = "1 - list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_KNN = f"SELECT v.vec_id AS id, round({_COS}, 6) AS distance FROM embeddings v, embeddings q WHERE q.vec_id = 7 {{}} ORDER BY distance, id LIMIT {{}}"
_rounded = lambda df: df.select("id", F.round("distance", 6).alias("distance"))
query("knn_cosine", _KNN.format("", 10))(lambda spark, d: _rounded(V.knn(_vectors(spark, d), _seed(_vectors(spark, d), 7), 10)))
query("knn_scalar_equal", _KNN.format("", 10))(lambda spark, d: _rounded(V.knn_matrix(_vectors(spark, d), _seed(_vectors(spark, d), 7), 10)))
query("knn_prefilter", _KNN.format("AND v.label IN (1, 2, 3)", 15))(lambda spark, d: _rounded(V.knn(_vectors(spark, d), _seed(_vectors(spark, d), 7), 15, F.col("label").isin(1, 2, 3))))
query("knn_similar_to", _KNN.format("AND v.vec_id <> 7", 10))(lambda spark, d: _rounded(V.similar_to(_vectors(spark, d), 7, 10)))
query("knn_prefilter_archive", f"""WITH {CORPUS_SQL}
SELECT v.id, round(1 - list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS distance FROM corpus v, embeddings q
WHERE q.vec_id = 7 AND v.embedding IS NOT NULL AND v.source <> 'quoted_reply' AND v.ts_raw >= '2024-01-01T12' AND NOT v.is_outbound ORDER BY distance, v.id LIMIT 10""")(
    lambda spark, d: _rounded(V.knn(V.vector_table(corpus(spark, d)), _seed(_vectors(spark, d), 7), 10, V.prefilter(date_from="2024-01-01T12", is_outbound=False))))
query("near_dup_pairs_in_group", """
SELECT a.label, a.vec_id AS id1, b.vec_id AS id2, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.45""")(
    lambda spark, d: V.near_pairs(_vectors(spark, d), "label", 0.45).withColumn("similarity", F.round("similarity", 6)))
_HYBRID_TAIL = """
, t AS (SELECT id, row_number() OVER (ORDER BY round(r, 9), id) - 1 AS tr FROM (SELECT * FROM h ORDER BY r, id LIMIT 50)),
v AS (SELECT id, row_number() OVER (ORDER BY round(distance, 9), id) - 1 AS vr FROM (
  SELECT v.vec_id AS id, 1 - list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS distance
  FROM embeddings v, embeddings q WHERE q.vec_id = 7 ORDER BY distance, id LIMIT 50)),
b AS (SELECT coalesce(v.id, t.id) AS id, coalesce(0.6::DOUBLE / (60 + vr + 1), 0) + coalesce(0.4::DOUBLE / (60 + tr + 1), 0) AS s,
      CASE WHEN tr IS NULL THEN 'vector' WHEN vr IS NULL THEN 'fts' ELSE 'both' END AS method FROM v FULL JOIN t ON v.id = t.id)
SELECT id, round(s, 6) AS score, method FROM b ORDER BY s DESC, id LIMIT 20"""
query("hybrid_rrf", _bm25_sql([_term("the"), _term("than")], "f0 > 0 AND f1 > 0", _HYBRID_TAIL))(
    lambda spark, d: V.fuse(V.knn(_vectors(spark, d), _seed(_vectors(spark, d), 7), 50), S.search_index(*_index(spark, d), "the than"), 20))
query("vector_upsert", "SELECT vec_id AS id, CASE WHEN label = 3 THEN 99 ELSE label END AS label FROM embeddings")(
    lambda spark, d: V.upsert(_vectors(spark, d).select("id", "label"), _vectors(spark, d).where("label = 3").select("id", F.lit(99).cast("int").alias("label"))))
query("encode_texts")(lambda spark, d: V.embed(_docs(spark, d).withColumn("embedding", F.lit(None).cast("array<float>")), F.col("body_text"), 64).select("id", F.round(V.norm(F.col("embedding")), 5).alias("norm")))

# -- deduplication, enrichment, maintenance, quality ---------------------------------------------------------

#: Signatures go before letters and digits are kept, which SQL can't say; compared with plain Python on a fixture.
query("content_normalise")(lambda spark, d: _docs(spark, d).select("id", F.length(X.content_normal(F.col("body_text"))).cast("long").alias("n"),
                                                                  F.md5(X.content_normal(F.col("body_text")).cast("binary")).alias("digest")))
query("content_hash_dups", "SELECT sha256(text) AS content_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")(
    lambda spark, d: M.repeated_hashes(table(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))))
query("first_writer_registry", """SELECT sha256(text) AS sha256, arg_min(doc_id, (source, doc_id)) AS first_message_id, arg_min(source, (source, doc_id)) AS path, count(*) AS n_uses FROM documents GROUP BY 1""")(
    lambda spark, d: M.attachment_registry(table(spark, d, "documents").select(
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("doc_id").alias("id"), F.col("source").alias("ts_raw"), F.col("source").alias("path"), F.lit("x").alias("filename"),
        F.lit("text/plain").alias("mime_type"), F.length("text").cast("long").alias("size_bytes"))).select("sha256", "first_message_id", "path", "n_uses"))
_over_corpus("message_dedup", lambda m: M.new_messages(m.withColumns({"message_id": F.concat(F.lit("m"), (F.col("id") % 300).cast("string")), "source_path": F.format_string("p%08d", "id")}), m.where("id % 300 < 50").select(F.concat(F.lit("m"), (F.col("id") % 300).cast("string")).alias("message_id"))).select("message_id", "id"),
             "SELECT 'm' || CAST(id % 300 AS VARCHAR) AS message_id, min(id) AS id FROM corpus WHERE id % 300 >= 50 GROUP BY 1")
_over_corpus("quote_tier1", lambda m: M.new_quotes(m.where("source = 'quoted_reply'").withColumn("content_hash", F.sha2(F.col("body_markdown").cast("binary"), 256))).select("content_hash", "id"),
             "SELECT sha256(body_markdown) AS content_hash, arg_min(id, (ts_raw, id)) AS id FROM corpus WHERE source = 'quoted_reply' GROUP BY 1")
query("quote_tier2")(lambda spark, d: M.unlike_in_thread(_vectors(spark, d).select("id", "embedding", F.concat(F.lit("t"), F.col("label").cast("string")).alias("thread_id"), F.format_string("%08d", "id").alias("ts_raw")), 0.45).select("id", "thread_id"))
_KEY = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^(re:|fwd:|fw:|aw:|sv:|fw)\s*', '', 'i'), '^\[.*?\]\s*', ''), '^\(.*?\)\s*', ''), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"""
query("subject_thread_key", rf"""WITH d AS (SELECT doc_id AS id, (CASE doc_id % 4 WHEN 0 THEN 'Re: [tag] ' WHEN 1 THEN 'FW: (x) ' WHEN 2 THEN 'AW:' ELSE '' END) || substr(text, 1, 40) AS s FROM documents)
SELECT id, CASE WHEN {_KEY} = '' THEN 'no-subject' ELSE lower({_KEY}) END AS key,
       'thread-subj-' || substr(sha256(CASE WHEN {_KEY} = '' THEN 'no-subject' ELSE lower({_KEY}) END), 1, 16) AS thread_id FROM d""")(
    lambda spark, d: table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.expr("CASE doc_id % 4 WHEN 0 THEN 'Re: [tag] ' WHEN 1 THEN 'FW: (x) ' WHEN 2 THEN 'AW:' ELSE '' END"), F.substring("text", 1, 40)).alias("s")).select(
        "id", X.subject_key(F.col("s")).alias("key"), X.thread_hash(X.subject_key(F.col("s")), "thread-subj-").alias("thread_id")))


def _category_sql(words: list[str]) -> str:
    return "|".join(w if " " in w else rf"\b{w}\b" for w in words)


query("category_rules", "SELECT doc_id AS id, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(lower(t), '{_category_sql(w)}') THEN '{n}' END" for n, w in sorted(M.CATEGORIES.items())) +
    "], lambda x: x IS NOT NULL), ',') AS categories FROM (SELECT doc_id, (CASE doc_id % 5 WHEN 0 THEN 'Budget meeting ' WHEN 1 THEN 'Domain join audits ' WHEN 2 THEN 'License quote ' WHEN 3 THEN 'Auto-reply: lunch ' ELSE '' END) || ' ' || substr(text, 1, 1500) AS t FROM documents)")(
    lambda spark, d: table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(M.categories(
        F.expr("CASE doc_id % 5 WHEN 0 THEN 'Budget meeting ' WHEN 1 THEN 'Domain join audits ' WHEN 2 THEN 'License quote ' WHEN 3 THEN 'Auto-reply: lunch ' ELSE '' END"), F.col("text")), ",").alias("categories")))
query("project_tags", """SELECT id, array_to_string(list_sort(list_filter([CASE WHEN contains(t, 'than') OR contains(t, 'pour') THEN 'Alpha' END,
CASE WHEN contains(t, 'beta') OR contains(t, 'nicht') OR contains(t, 'und') THEN 'Beta' END, CASE WHEN id % 10 = 0 THEN 'CR' || CAST(id AS VARCHAR) END], lambda x: x IS NOT NULL)), ',') AS tags
FROM (SELECT doc_id AS id, lower((CASE WHEN doc_id % 10 = 0 THEN 'see CR' || CAST(doc_id AS VARCHAR) ELSE '' END) || ' ' || substr(text, 1, 2000)) AS t FROM documents)""")(
    lambda spark, d: M.tag_projects(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.expr("CASE WHEN doc_id % 10 = 0 THEN concat('see CR', doc_id) ELSE '' END").alias("subject"), F.col("text").alias("body_markdown")),
                                    spark.createDataFrame([("Alpha", '["than", "pour"]', None, None), ("Beta", "nicht, und", None, None)], "name string, aliases string, summary string, created_at string")).select("id", F.array_join("project_tags", ",").alias("tags")))
_over_corpus("project_context", lambda m: A.project_messages(m, "p3", 10).withColumn("project_tags", F.array_join("project_tags", ",")), f"""
SELECT id, subject, ts_raw, from_address, project AS project_tags, substr(coalesce({MAIN}, ''), 1, 500) AS snippet FROM corpus WHERE {NOT_QUOTED} AND lower(project) = 'p3' ORDER BY ts_raw DESC, id DESC LIMIT 10""")
query("list_projects", "SELECT p_brand AS name, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS aliases, count(*) AS n FROM part GROUP BY 1 ORDER BY 1 LIMIT 20")(
    lambda spark, d: (lambda r: A.list_projects(r).join(r.select("name", "n"), "name").select("name", F.array_join("aliases", ",").alias("aliases"), "n"))(
        table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.array_join(F.sort_array(F.collect_set("p_type")), ", ").alias("aliases"), F.count(F.lit(1)).alias("n")).withColumns({"summary": F.lit(""), "created_at": F.lit("")})))
_over_corpus("untagged_batch", lambda m: M.untagged(m, None, 40).select("id", "ts_raw"), "SELECT id, ts_raw FROM corpus WHERE project IS NULL ORDER BY ts_raw, id LIMIT 40")
_over_corpus("merge_tags", lambda m: M.merge_tags(m, m.where("id % 3 = 0").select("id", F.array(F.lit("zz"), F.lit("en")).alias("categories"), F.array(F.lit("Q")).alias("projects"))).select("id", F.array_join("category_tags", ",").alias("c"), F.array_join("project_tags", ",").alias("p")), """
SELECT id, CASE WHEN id % 3 <> 0 THEN category WHEN category = 'en' THEN 'en,zz' ELSE array_to_string(list_sort([category, 'en', 'zz']), ',') END AS c,
       CASE WHEN id % 3 = 0 THEN 'Q' ELSE coalesce(project, '') END AS p FROM corpus""")
query("sample_random_500")(lambda spark, d: M.discovery_sample(_docs(spark, d), 500).select("id"))
query("anti_missing_vectors", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")(lambda spark, d: M.only_left(_docs(spark, d).select("id"), _vectors(spark, d), "id"))
query("anti_orphans", "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")(
    lambda spark, d: M.only_left(_vectors(spark, d).select("id"), table(spark, d, "labels").withColumnRenamed("doc_id", "id"), "id"))
_over_corpus("coverage_ratio", lambda m: M.index_report(m, V.vector_table(m.where("id % 5 > 0"))).select("*", F.round(F.try_divide("n_vectors", "n_embedded"), 6).alias("coverage")), """
SELECT count(embedding) AS n_embedded, count(embedding) FILTER (id % 5 > 0) AS n_vectors, count(embedding) FILTER (id % 5 = 0) AS n_missing, CAST(0 AS BIGINT) AS n_orphans,
       round(count(embedding) FILTER (id % 5 > 0) / CAST(count(embedding) AS DOUBLE), 6) AS coverage FROM corpus""")
_over_corpus("backfill_from_name", lambda m: M.backfill(m, "from_name").select("id", "from_name"),
             "SELECT id, coalesce(from_name, upper(substr(from_address, 1, 1)) || substr(split_part(from_address, '@', 1), 2)) AS from_name FROM corpus")
_over_corpus("backfill_recipients", lambda m: M.backfill(m.withColumn("recipients", F.lit(None).cast("array<string>")), "recipients").select("id", F.array_join("recipients", ",").alias("recipients")),
             "SELECT id, to_one || CASE WHEN cc_one IS NULL OR cc_one = to_one THEN '' ELSE ',' || cc_one END AS recipients FROM corpus")
_over_corpus("backfill_is_outbound", lambda m: M.backfill(m.withColumn("is_outbound", F.when(F.col("id") % 2 == 0, F.col("is_outbound"))), "is_outbound").select("id", "is_outbound"), """
, o AS (SELECT from_address AS a FROM corpus GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT id, CASE WHEN id % 2 = 0 THEN is_outbound ELSE from_address = a END AS is_outbound FROM corpus, o""")
_over_corpus("backfill_sender", lambda m: M.backfill(m.withColumns({"sender": F.lit(None).cast("string"), "body_plain": F.lit(None).cast("string")}), "sender").select("id", "sender", "body_text", "source"),
             "SELECT id, from_address AS sender, body_markdown AS body_text, source FROM corpus")
def _formatted_sql(c: str) -> str:
    """Whether a text holds markdown marks, in patterns without look-around; white space, digits and letters as Unicode has them."""
    blank, other = r"[\s\x0b\x{85}\p{Z}]", r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"
    marks = [rf"^#{{1,6}}{blank}+", r"!?\[.*?\]\([^\)]*\)", rf"^{blank}*[-*+]{blank}+", rf"^{blank}*\p{{Nd}}+\.{blank}+", rf"^>{blank}+", "```|~~~", "`[^`]+`", r"\*\*[^*]+\*\*", "__[^_]+__"]
    for sign in "*_":
        marks.append(rf"(?:^|{other})\{sign}[^\{sign}\s\x0b\x{{85}}\p{{Z}}][^\{sign}\n]*\{sign}(?:{other}|$)")
    return f"regexp_matches(coalesce({c}, ''), '(?m){'|'.join(f'(?:{m})' for m in marks)}')"


def _raw_html_sql(c: str) -> str:
    return f"regexp_matches(lower(substr(coalesce({c}, ''), 1, 500)), '<!doctype html|<html|<head|<body|<div|<table|<style')"


def _check_sql(name: str, bad: str, where: str = "true") -> str:
    return (f"""SELECT '{name}' AS "check", count(*) FILTER ({bad}) AS n_bad, count(*) AS n_checked, """
            f"CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE round(count(*) FILTER ({bad}) / CAST(count(*) AS DOUBLE), 6) END AS rate FROM corpus WHERE {where}")


_over_corpus("quality_checks", M.quality, "\n" + "\nUNION ALL ".join([
    _check_sql("headers", "from_address IS NULL OR subject IS NULL OR ts IS NULL"),
    _check_sql("raw_html", _raw_html_sql("body_markdown")),
    _check_sql("empty_text", "trim(coalesce(nullif(body_main_text, ''), body_text, body_markdown, '')) = ''"),
    _check_sql("text_missing", "body_text IS NULL"),
    _check_sql("text_is_markdown", f"body_text = body_markdown AND {_formatted_sql('body_markdown')}", "body_text IS NOT NULL"),
    _check_sql("attachment_flag", "has_attachments"),
    _check_sql("embedding_missing", "embedding IS NULL", "source <> 'quoted_reply'"),
    _check_sql("quote_links", "true", "source = 'quoted_reply'"),
    _check_sql("quote_length", "length(coalesce(body_text, '')) <= 50", "source = 'quoted_reply'"),
    _check_sql("calendar_subjects", "regexp_matches(subject, '^(Accepted|Declined|Canceled|Tentative):')")]))
_over_corpus("parent_check", lambda m: M.lost_parents(m.withColumn("parent_id", F.when(F.col("source") == "quoted_reply", F.col("id") + F.when(F.col("id") % 2 == 0, 1).otherwise(10_000_000)))).select("id", "parent_id"), """
SELECT id, id + CASE WHEN id % 2 = 0 THEN 1 ELSE 10000000 END AS parent_id FROM corpus WHERE source = 'quoted_reply'
AND id + CASE WHEN id % 2 = 0 THEN 1 ELSE 10000000 END NOT IN (SELECT id FROM corpus)""")
_over_corpus("salvage_rate", M.salvage_rate, """
SELECT count(*) FILTER (source = 'quoted_reply') AS n_quotes, count(*) FILTER (source <> 'quoted_reply' AND length(body_text) > 200) AS n_candidates,
       round(count(*) FILTER (source = 'quoted_reply') / CAST(count(*) FILTER (source <> 'quoted_reply' AND length(body_text) > 200) AS DOUBLE), 6) AS rate FROM corpus""")
_over_corpus("field_agreement", lambda m: M.agreement(m, m.withColumn("subject", F.when(F.col("id") % 10 > 0, F.col("subject"))), "id", ("subject", "from_address")),
             "SELECT count(*) AS n, round(avg(CASE WHEN id % 10 > 0 THEN 1.0 ELSE 0.0 END), 6) AS subject, 1.0::DOUBLE AS from_address FROM corpus")
_over_corpus("has_attachment_groups", lambda m: m.groupBy("has_attachments").agg(F.count(F.lit(1)).alias("n")), "SELECT has_attachments, count(*) AS n FROM corpus GROUP BY 1")
_over_corpus("stratified_sample", lambda m: M.stratified(m, "source", 5).groupBy("source").agg(F.count(F.lit(1)).alias("n")), "SELECT source, least(count(*), 5) AS n FROM corpus GROUP BY 1")
query("raw_html_class", f"""SELECT class, count(*) AS n FROM (SELECT CASE WHEN html IS NULL THEN 'NO_RECORD' WHEN trim(html) = '' THEN 'EMPTY' WHEN {_raw_html_sql('html')} THEN 'RAW_HTML'
WHEN {_formatted_sql('html')} THEN 'CLEAN' ELSE 'PLAIN' END AS class FROM (SELECT html FROM pages UNION ALL SELECT text FROM documents)) GROUP BY 1""")(
    lambda spark, d: table(spark, d, "pages").select("html").unionByName(table(spark, d, "documents").select(F.col("text").alias("html"))).groupBy(
        M.leak_class(F.col("html")).alias("class")).agg(F.count(F.lit(1)).alias("n")))
query("html_text_extract")(lambda spark, d: _html(table(spark, d, "pages")))
#: Whole texts of all rows; look-behind is beyond SQL's patterns, so both are compared with plain Python.
query("markdown_plain")(lambda spark, d: _docs(spark, d).select("id", X.markdown_plain(F.col("body_text")).alias("plain")))
query("markdown_plain_pages")(lambda spark, d: table(spark, d, "pages").select("page_id", X.markdown_plain(F.col("html")).alias("plain")))
query("main_text")(lambda spark, d: _docs(spark, d).select("id", X.main_text(F.concat("body_text", F.lit("\n\nSent from my iPhone\nFrom: a@b.c\nSent: now")), F.lit(None).cast("string")).alias("main")))
query("salvage_explode")(lambda spark, d: _salvage(table(spark, d, "conversations")))
query("json_props_extract", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")(
    lambda spark, d: table(spark, d, "events").select("event_type", F.from_json("props", "k long").alias("p")).groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count(F.lit(1)).alias("n")))
query("format_size", """SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN b < 1024 THEN format('{:.1f} B', b) WHEN b < 1048576 THEN format('{:.1f} KB', b / 1024) ELSE format('{:.1f} MB', b / 1048576) END AS size
FROM (SELECT l_orderkey, l_linenumber, floor(l_extendedprice) * 37 AS b FROM lineitem)""")(
    lambda spark, d: table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), X.format_size(F.floor("l_extendedprice") * 37).alias("size")))
query("stream_ingest_available_now", "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")(lambda spark, d: _stream(spark, d))
query("stream_sessions_window", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda spark, d: table(spark, d, "events").groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n")))


def _html(pages: DataFrame) -> DataFrame:
    from epistle.sources.html import text_column

    return pages.select("page_id", F.length(text_column(F.col("html"))).alias("n_chars"))


def _salvage(conversations: DataFrame) -> DataFrame:
    """Each turn quotes the one before it; the quotes come back out."""
    from epistle.sources.eml import quotes_column

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = conversations.withColumn("_mail", F.concat("text", F.lit("\n\nOn Monday A B wrote:\n> "), F.regexp_replace(before, "\n", "\n> ")))
    return rows.select("conv_id", "turn", F.explode(quotes_column(F.col("_mail"), F.lit(None).cast("string"))).alias("quote"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from epistle.streaming.ingest import events_available_now

    return events_available_now(spark, sf_dir)
