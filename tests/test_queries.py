"""Every registered archive query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from epistle import registry

NAMES = list(registry.QUERIES)
#: A cross-section runs always; EPISTLE_ALL=1 runs every query.
SHORT = ["list_threads_count", "thread_conversation", "thread_expansion", "timeline_quarter", "contact_profile", "filter_metadata_all", "tag_filter_or_group", "keyset_page_asc", "keyset_page_desc",
         "field_projection_fallbacks", "bm25_not", "bm25_phrase", "bm25_near", "bm25_minmax", "bm25_from_postings", "knn_cosine", "knn_scalar_equal", "hybrid_rrf", "subject_thread_key", "category_rules",
         "project_tags", "merge_tags", "backfill_is_outbound", "quality_checks", "coverage_ratio", "stream_ingest_available_now", "format_size"]


def rows(df):
    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v)

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    for f in os.listdir(tables):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{tables}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES if os.environ.get("EPISTLE_ALL") else SHORT)
def test_same_as_sql(spark, tables, duck, name):
    got = registry.QUERIES[name](spark, tables).toPandas()
    if name in registry.ORACLE_SQL:
        want = duck.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def whole_texts(tmp_path, spark):
    texts = ["# Head\n- item\n1. one\n[label](http://x) `code` **bold** __b__ *i* _j_ <b>tag</b> 5 - 3\n> quote\n```\nfence\n``` end", "word " * 100 + "**late** [a](b)", "plain", "", None,
             "Body 1\n--\nSent from my iPhone yes", "Text\nOn Monday A wrote:\nmore", "a\n----------\nb\n***\nc", "x\nFrom: a\nSent: b\nTo: c\nSubject: d\ny IMPORTANT: z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    return texts


def test_markdown_plain_of_whole_texts(spark, tables, tmp_path):
    """Every row, every character: against the plain function."""
    from epistle.functions.text import markdown_to_plain_text

    texts = whole_texts(tmp_path, spark)
    assert {r.id: r.plain for r in registry.QUERIES["markdown_plain"](spark, str(tmp_path)).collect()} == {i: markdown_to_plain_text(t) for i, t in enumerate(texts)}
    pages = spark.read.parquet(f"{tables}/pages.parquet").select("page_id", "html").toPandas()
    got = {r.page_id: r.plain for r in registry.QUERIES["markdown_plain_pages"](spark, tables).collect()}
    assert got == {i: markdown_to_plain_text(t) for i, t in zip(pages.page_id, pages.html)}


def test_content_normalise_strips_signatures(spark, tmp_path):
    import hashlib
    import re

    from epistle.functions.text import QUOTE_SIGNATURES

    def plain(t):
        for p in QUOTE_SIGNATURES:
            t = re.sub(p, "", t)
        return re.sub("[^a-z0-9]", "", t.lower())

    want = {i: (None, None) if t is None else (len(plain(t)), hashlib.md5(plain(t).encode()).hexdigest()) for i, t in enumerate(whole_texts(tmp_path, spark))}
    assert {r.id: (r.n, r.digest) for r in registry.QUERIES["content_normalise"](spark, str(tmp_path)).collect()} == want
    assert want[5][0] == len("body1") and want[6][0] == len("textmore")


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["id", "score", "method"]


def test_near_pairs_of_large_groups_and_odd_vectors(spark, monkeypatch):
    """Against the SQL's own definition: groups cut into blocks, copies, a zero vector, an infinite one, missing values."""
    import numpy as np

    from epistle.operators import vectors as V

    monkeypatch.setattr(V, "BLOCK", 40)
    monkeypatch.setattr(V, "POOLED", 30)
    rng = np.random.default_rng(9)
    made = [(k, rng.normal(size=6).round(2).tolist(), "ab"[k % 7 == 0] if k < 300 else f"g{k % 50}") for k in range(500)]
    made += [(500 + k, made[k][1], made[k][2]) for k in range(30)] + [(600, [0.0] * 6, "a"), (601, [math.inf] + [1.0] * 5, "b"), (602, [3.0, 4.0, 0.0, 0.0, 0.0, 0.0], "z"), (603, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], "z")]
    odd = [(700, None, "a"), (701, [1.0] * 6, None), (702, [1.0, None, 1.0, 1.0, 1.0, 1.0], "a"), (None, [1.0] * 6, "a"), (703, [1.0] * 5, "a"), (704, [], "a"), (705, [], "a")]
    schema = "id long, embedding array<float>, name string"
    got = V.near_pairs(spark.createDataFrame(made + odd, schema), "name", 0.6)
    assert got.columns == ["name", "id1", "id2", "similarity"]
    c = duckdb.connect()
    e = pd.DataFrame(made, columns=["id", "v", "name"])  # noqa: F841
    cosine = "list_cosine_similarity(CAST(CAST(a.v AS FLOAT[]) AS DOUBLE[]), CAST(CAST(b.v AS FLOAT[]) AS DOUBLE[]))"
    want = c.execute(f"SELECT a.name, a.id AS id1, b.id AS id2, {cosine} AS similarity FROM e a JOIN e b ON a.name = b.name AND a.id < b.id WHERE {cosine} >= 0.6").df()
    assert len(want) > 1000 and rows(got.toPandas()) == rows(want)
    assert V.near_pairs(spark.createDataFrame([], schema), "name").count() == 0
