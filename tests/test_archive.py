"""From files to searches: parsing, salvage, storing, streaming, tools."""

import io
import json

import pytest
from pyspark.sql import functions as F

from epistle import server
from epistle.api import NAMES, Tools
from epistle.operators import analytics as A
from epistle.operators import fulltext as S
from epistle.operators import maintenance as M
from epistle.operators import threads as T
from epistle.operators import vectors as V
from epistle.schema import MESSAGES, validate_schema
from epistle.sources import eml
from epistle.sources.archive import Archive
from epistle.streaming import ingest

QUOTED = "We should move the whole service to the second region before the end of the month, please confirm."


def mail(n, subject="Plan", sender="Ann Lee <ann@x.org>", to="bob@x.org", body="Text of the message", extra="", date="Mon, 01 Jan 2024 10:0{}:00 +0200"):
    return f"Message-ID: <m{n}@x.org>\nFrom: {sender}\nTo: {to}\nSubject: {subject}\nDate: {date.format(n % 10)}\n{extra}\n{body}\n".encode()


ATTACHED = b"""Message-ID: <a1@x.org>
From: "Cy" <cy@x.org>
To: ann@x.org, Bob <bob@x.org>
Cc: dee@x.org
Subject: =?utf-8?q?Caf=C3=A9_meeting?=
Date: Tue, 02 Jan 2024 08:00:00 +0000
References: <m1@x.org> <m2@x.org>
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=B

--B
Content-Type: text/html; charset=utf-8

<p>See <img src="cid:i1">the <b>file</b></p>
--B
Content-Type: application/pdf
Content-Disposition: attachment; filename="a?.pdf"
Content-Transfer-Encoding: base64

aGVsbG8=
--B
Content-Type: image/png
Content-Disposition: inline; filename="i.png"
Content-ID: <i1>
Content-Transfer-Encoding: base64

aGVsbG8=
--B--
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("mail")
    (d / "sub").mkdir()
    reply = "I agree.\n\nOn Monday Ann wrote:\n" + "\n".join(f"> {x}" for x in (QUOTED, "Thanks, Ann"))
    for name, raw in {"1.eml": mail(1), "2.eml": mail(2, "Re: Plan", "Bob <bob@x.org>", "ann@x.org", reply, "In-Reply-To: <m1@x.org>\n"), "sub/3": mail(3, body=reply, subject="CR42 budget meeting"), "4.eml": ATTACHED,
                      "5.eml": mail(1, body="duplicate"), "6.eml": b"no headers at all", "7.eml": mail(7, date="rubbish"), "skip.msf": b"x", ".hidden": b"x"}.items():
        (d / name).write_bytes(raw)
    return str(d)


@pytest.fixture(scope="module")
def messages(spark, folder):
    registry = spark.createDataFrame([("Plan B", '["region", "move"]', "s", "2024")], "name string, aliases string, summary string, created_at string")
    return eml.read(spark, folder, registry=registry).cache()


def test_parse(messages):
    validate_schema(messages, MESSAGES)
    rows = {r.message_id: r for r in messages.collect()}
    assert rows["m1@x.org"].ts_raw == "2024-01-01T10:01:00+02:00" and str(rows["m1@x.org"].ts) == "2024-01-01 08:01:00"
    assert rows["m7@x.org"].ts_raw == eml.EPOCH and "duplicate" not in {r.body_text.strip() for r in rows.values()}
    a = rows["a1@x.org"]
    assert a.subject == "Café meeting" and a.from_name == "Cy" and a.recipients == ["ann@x.org", "bob@x.org", "dee@x.org"]
    assert a.body_text == "See the file" and "**file**" in a.body_markdown and a.category_tags == ["scheduling"]
    assert [(x.filename, x.size_bytes, x.mime_type) for x in a.attachments] == [("a_.pdf", 5, "application/pdf")]
    assert a.thread_id == rows["m2@x.org"].thread_id  # both go back to m1
    assert rows["m3@x.org"].project_tags == ["CR42", "Plan B"] and rows["m3@x.org"].category_tags == ["finance", "scheduling"]
    quotes = [r for r in rows.values() if r.source == "quoted_reply"]
    assert len(quotes) == 1 and QUOTED in quotes[0].body_text and quotes[0].subject.startswith("[Salvaged]")
    assert quotes[0].parent_id in {r.id for r in rows.values()}
    assert rows["m1@x.org"].is_outbound and not a.is_outbound  # ann sends most


def test_a_broken_file_becomes_an_error_row(spark, monkeypatch):
    raw = spark.createDataFrame([("p", None), ("q", bytearray(mail(9)))], "path string, content binary")
    got = {r.source_path: r.error for r in eml.parse(raw).collect()}
    assert got["q"] is None and got["p"].startswith("TypeError")


def test_quote_blocks():
    block = "Hello\n\nFrom: A\nSent: now\nTo: B\nSubject: S\n\n" + QUOTED + " " + QUOTED
    assert len(eml.quotes_of(block, None)) == 1
    assert len(eml.quotes_of("x\n\n----- Original Message -----\n" + QUOTED * 2, None)) == 1
    assert eml.quotes_of("short\n> hi", None) == [] and eml.quotes_of(None, None) == []
    same = "\n".join(f"> {QUOTED}" for _ in range(2))
    assert len(eml.quotes_of(f"a\n{same}\nb\n{same}\n", None)) == 1


def test_compression_round_trip(spark):
    df = spark.createDataFrame([(bytearray(b"abc" * 100),), (None,)], "b binary")
    assert [r.o for r in df.select(eml.decompress(eml.compress(F.col("b"))).alias("o")).collect()] == [bytearray(b"abc" * 100), None]


def test_archive(spark, messages, tmp_path):
    archive = Archive(spark, str(tmp_path))
    archive.append(messages)
    archive.append(messages)
    assert archive.messages().count() == messages.count()
    report = archive.fill_embeddings(F.col("body_text"), 16)
    assert report == {"n_embedded": messages.count(), "n_vectors": messages.count(), "n_missing": 0, "n_orphans": 0}
    archive.rebuild_index()
    assert archive.search_terms(["file"]).count() == 1
    assert archive._read("attachments").count() == 1
    with pytest.raises(Exception, match="expected 16"):
        bad = spark.createDataFrame([([1.0] * 3,)], "e array<float>")
        bad.select(V.check_dimension(F.col("e"), 16)).collect()


def test_streaming_ingest(spark, folder, tmp_path):
    archive = Archive(spark, str(tmp_path / "a"))
    assert ingest.ingest_available(spark, folder, archive, str(tmp_path / "c"), files_per_batch=4) >= 2
    first = archive.messages().count()
    assert ingest.ingest_available(spark, folder, archive, str(tmp_path / "c")) == 0
    assert archive.messages().count() == first == archive.messages().select("message_id").distinct().count()
    assert archive.messages().where("source = 'quoted_reply'").count() == 1
    assert {r.path.rsplit("/", 1)[1] for r in ingest.pending(spark, folder, archive).collect()} <= {"5.eml"}


def test_tools(messages):
    tools = Tools(V.embed(messages, F.col("body_text"), 16), encode=lambda t: V.encode_text(t, 16))
    assert tools.query_email_database(count_only=True) == {"count": 6}
    pages, cursor = [], None
    while True:
        page = tools.query_email_database(limit=2, cursor=cursor, fields=["id", "subject", "embedding"])
        pages += [r["id"] for r in page["results"]]
        assert all("embedding" not in r and "raw_eml" not in r for r in page["results"])
        cursor = page["next_cursor"]
        if not page["has_more"]:
            break
    assert len(pages) == len(set(pages)) == 6
    words = tools.query_email_database(exact_keywords="agree", snippet_only=True, include_full_thread=True)
    assert len(words["results"]) == 2 and "<mark>agree</mark>" in words["results"][0]["snippet"] and words["threads"]
    both = tools.query_email_database(exact_keywords="file", semantic_query="See the file")
    assert both["results"][0]["subject"] == "Café meeting" and both["results"][0]["method"] == "both"
    assert tools.query_email_database(semantic_query="See the file")["results"][0]["relevance_score"] < 1e-6
    assert "error" in tools.query_email_database(exact_keywords="don't")
    thread = messages.where("message_id = 'm2@x.org'").first().thread_id
    assert tools.get_thread_by_id(thread)["message_count"] == 3 and tools.get_thread_arc(thread)["message_count"] == 2
    assert tools.get_contact_profile(name="ann")["contact"]["total_messages"] >= 3 and tools.get_contact_profile() is None
    assert tools.get_mention_timeline("file", granularity="month")["timeline"] == {"2024-01": 1}
    assert tools.list_threads()["count"] >= 3
    some = messages.first().id
    assert tools.get_email_by_id(some)["id"] == some and tools.search_emails("*", limit=3)["results"]
    assert tools.search_emails(similar_to_email_id="none")["reason"]


def test_server(messages):
    tools = Tools(messages)
    out = io.StringIO()
    requests = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "list_projects"}},
                {"id": 4, "method": "tools/call", "params": {"name": "get_email_by_id", "arguments": {"email_id": "x"}}}, {"id": 5, "method": "nope"}, {"id": 6, "method": "resources/read", "params": {"uri": "email://none/body"}}]
    server.serve(tools, [json.dumps(r) for r in requests] + ["{broken"], out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [t["name"] for t in answers[1]["result"]["tools"]] == list(NAMES)
    assert answers[2]["result"]["isError"] is False and answers[3]["result"]["isError"] is True
    assert answers[4]["error"]["code"] == -32601 and answers[5]["error"]["code"] == -32601 and answers[6]["error"]["code"] == -32700


def test_backfills_fill_only_what_is_missing(messages):
    for kind in ("sender", "from_name", "thread_id", "recipients", "is_outbound", "categories", "body_text", "body_main_text"):
        once = M.backfill(messages, kind).select("id", "sender", "from_name", "recipients").orderBy("id").collect()
        assert once == messages.select("id", "sender", "from_name", "recipients").orderBy("id").collect()
    gone = messages.withColumn("body_main_text", F.lit(None).cast("string"))
    assert M.backfill(gone, "body_main_text").where("body_main_text IS NULL").count() == 0
    with pytest.raises(ValueError):
        M.backfill(messages, "nothing")


def test_similar_quotes_in_a_thread(spark):
    rows = spark.createDataFrame([("1", "t", "a", [1.0, 0.0]), ("2", "t", "b", [0.999, 0.01]), ("3", "t", "c", [0.0, 1.0]), ("4", "u", "a", [1.0, 0.0]), ("5", "t", "d", None)], "id string, thread_id string, ts_raw string, embedding array<float>")
    assert sorted(r.id for r in M.unlike_in_thread(rows).collect()) == ["1", "3", "4", "5"]


def test_plans(spark, tables):
    """Filters and columns reach the scan, top-k needs no full sort, no join is a cartesian product."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    scan = plan(docs.where("source = 'src1'").select("doc_id"))
    assert "EqualTo(source,src1)" in scan and "ReadSchema: struct<doc_id:bigint,source:string>" in scan
    from epistle.schema import corpus

    assert "TakeOrderedAndProject" in plan(T.list_threads(corpus(spark, tables)))
    assert "text" not in plan(A.owner(corpus(spark, tables))).split("ReadSchema: ")[1].split("\n")[0]
    assert "CartesianProduct" not in plan(T.list_threads(corpus(spark, tables)))


def test_command_line(spark, folder, tmp_path):
    from epistle import cli

    assert cli.main([str(tmp_path / "a"), "--load", folder])["load"] >= 1
    report = cli.main([str(tmp_path / "a"), "--embed", "missing", "--rebuild", "--backfill", "from_name"])
    assert report["embed"]["n_missing"] == 0 and report["rebuild"]["n_orphans"] == 0 and report["backfill"] == "from_name"


def test_classifier(spark, messages):
    from epistle.operators import classify as C

    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise C.ModelError("busy")
        return 'Here: [{"name": "Alpha", "aliases": ["al"], "summary": "s"}]'

    waits = []
    assert C.json_array(C.ask(flaky, "p", wait=waits.append))[0]["name"] == "Alpha" and waits == [1.0, 2.0]
    registry = spark.createDataFrame([("Alpha", "old", None, None), ("Beta", "b", None, None)], "name string, aliases string, summary string, created_at string")
    got = {r.name: r.aliases for r in C.discover_projects(messages, registry, flaky).collect()}
    assert got == {"Alpha": '["al"]', "Beta": "b"} and C.discover_projects(messages, registry, flaky, reset=True).count() == 1
    with pytest.raises(ValueError):
        C.discover_projects(messages, registry, lambda p: "nothing")
    untagged = messages.where("size(project_tags) = 0").count()
    tagged, at, rows = 0, None, messages
    while True:
        rows, at = C.tag_batch(rows, lambda p: '[["new"], ["P"]]', at, 3)
        if at is None:
            break
        tagged += 1
    assert tagged == -(-untagged // 3) and rows.where("array_contains(category_tags, 'new')").count() == untagged


def test_loads_keep_the_index_and_attachments(spark, folder, tmp_path):
    """What is loaded after an index was built is found in it; attachments' bytes are stored once; owners count over the whole store."""
    archive = Archive(spark, str(tmp_path / "a"))
    rows = eml.read(spark, folder)
    first = rows.where("message_id = 'm1@x.org'")
    archive.append(first)
    archive.rebuild_index("postings")
    archive.rebuild_index("attachments")
    assert archive.search("region").count() == 0
    archive.append(rows)
    assert {r.id for r in archive.search("meeting OR region").collect()} == {r.id for r in S.search(archive.messages(), "meeting OR region").collect()} != set()
    assert archive._read("lengths").count() == archive.messages().count() and archive.sync_index() == {"lengths": 0, "attachments": 0}
    raw = eml.files(spark, folder)
    archive.store_attachments(eml.attachment_contents(raw))
    archive.store_attachments(eml.attachment_contents(raw))
    digest = archive._read("attachments").first().sha256
    assert archive._read("attachment_data").count() == 1 and archive.attachment(digest) == b"hello" and archive.attachment("x") is None
    archive.store_attachments(spark.createDataFrame([("0", bytearray(b"z"))], "sha256 string, content binary"))
    assert archive.delete_orphans() == 1 and archive.attachment(digest) == b"hello"
    stored = archive.messages().where("message_id = 'a1@x.org'").select(eml.decompress(F.col("raw_eml")).alias("raw")).first()
    assert bytes(stored.raw) == ATTACHED
    late = eml.messages(eml.parse(spark.createDataFrame([("p", bytearray(mail(9, sender="zed@x.org")))], "path string, content binary")), stored=archive.messages()).first()
    assert not late.is_outbound  # the store's most frequent sender is another
