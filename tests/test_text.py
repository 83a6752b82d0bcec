from pyspark.sql import functions as F

from epistle.functions import sqlsem
from epistle.functions import text as X
from epistle.sources import html as H


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


MARKDOWN = ["# Head\n\n* one\n* two\n\n1. first\n> quoted\n", "[label](http://x) and ![pic](y.png)", "**bold** __also__ `code` *it* _em_ a_b_c", "```\nblock\n``` rest", "<b>tag</b>", None, "plain  text"]


def test_markdown_column_is_the_function(spark):
    assert column(spark, MARKDOWN, X.markdown_plain) == [X.markdown_to_plain_text(m) for m in MARKDOWN]
    assert X.markdown_to_plain_text(MARKDOWN[0]) == "Head one two first quoted"
    assert column(spark, MARKDOWN, X.has_formatting) == [True, True, True, True, False, False, False]


def test_main_text():
    assert X.derive_main_text("Please see the numbers below, thanks.\nFrom: a@b.c\nSent: now\nold text", None) == "Please see the numbers below, thanks."
    assert X.derive_main_text("Fine.\nFrom: a@b.c\nSent: today", None).startswith("Fine. From:")  # too short to stand alone
    assert X.derive_main_text("The plan is ready for review\n\nSent from my iPhone", None) == "The plan is ready for review"
    assert X.derive_main_text("Numbers are attached here. CONFIDENTIALITY NOTICE: secret", None) == "Numbers are attached here."
    assert X.derive_main_text("| a | b |\n|---|---|\n| 1 | [two](x) |", None) == "a b 1 two"
    assert X.derive_main_text("see OneLogin Logo and image001.png logo", None) == "see OneLogin Logo and logo" or "OneLogin Logo" in X.derive_main_text("see OneLogin Logo and image001.png", None)
    assert X.derive_main_text(None, "**only** markdown") == "only markdown" and X.derive_main_text(None, None) == ""


def test_content_hash(spark):
    texts = ["Hello World!", "hello   world", "Hello World!\nSent from my iPhone", "Hello World!\n--\n", "other", ""]
    got = column(spark, texts, X.content_hash)
    assert len(set(got[:4])) == 1 and got[4] not in got[:4]
    assert got == [X.content_hash_of(t) for t in texts]


def test_subject_keys(spark):
    subjects = ["Re: Budget", "RE: [ext] Budget", "Re: Re: x", "(fyi) A  B", "fwd things", "", None, "Über?!"]
    assert column(spark, subjects, X.subject_key) == ["budget", "budget", "re x", "a b", "d things", "no-subject", "no-subject", "über"]
    assert column(spark, ["Re: Re: x"], lambda c: X.subject_key(c, strict=False)) == ["x"]


def test_like_knows_ascii_only(spark):
    assert column(spark, ["ABC", "xabcx", "É", "a_c", None], lambda c: sqlsem.contains(c, "aBc")) == [True, True, False, False, None]
    assert column(spark, ["É"], lambda c: sqlsem.contains(c, "é")) == [False]
    assert column(spark, ["a1c"], lambda c: sqlsem.contains(c, "a_c")) == [True]
    assert column(spark, ["a\\c"], lambda c: sqlsem.contains(c, "a\\c")) == [True]


def test_small_functions(spark):
    assert column(spark, [10, 2048, 5 * 1024**2], X.format_size, "long") == ["10.0 B", "2.0 KB", "5.0 MB"]
    assert column(spark, ["john.q_doe@x.org"], X.derived_name) == ["John Q Doe"]
    assert column(spark, ["a/b?.txt", "x" * 300 + ".pdf"], X.safe_filename) == ["a_b_.txt", "x" * 251 + ".pdf"]
    assert column(spark, ["<HTML><p>", "text", None], X.raw_html) == [True, False, False]
    assert X.useful_fragment("From: a\n" + "word " * 10) and not X.useful_fragment("From: a\nshort")


def test_cursor():
    import pytest

    assert sqlsem.decode_cursor(sqlsem.encode_cursor("2024", "a")) == ("2024", "a")
    with pytest.raises(ValueError):
        sqlsem.decode_cursor("nonsense")


def test_html():
    page = "<html><head><style>x{}</style></head><body><h1>T</h1><p>a <b>b</b> <a href='u'>c</a></p><ul><li>x</li><li>y</li></ul><script>z</script></body></html>"
    assert H.html_to_text(page) == "T a b c x y" and H.html_to_text(None) == ""
    md = H.html_to_markdown(page)
    assert md.startswith("# T") and "**b**" in md and "[c](u)" in md and "* x" in md and "z" not in md and "\n\n\n" not in md
    lines = H.quote_lines("<div>Hi</div><div><b>From:</b> A</div><div>Sent: now</div><div>To: B</div><div>Subject: S</div><div>Body</div>")
    assert lines == "Hi\n\nFrom: A\nSent: now\nTo: B\nSubject: S\n\nBody"
