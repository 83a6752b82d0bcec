"""HTML to text and to markdown, with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Labels of quoted headers.
LABELS = ("From", "Sent", "To", "Cc", "Subject", "Bcc", "Reply-To", "Date")
_SKIP = {"script", "style"}
_BLOCK = {"p", "div", "section", "article", "header", "footer", "table", "ul", "ol", "blockquote", "pre", "tr", "br", "hr", "li", "h1", "h2", "h3", "h4", "h5", "h6"}
_VOID = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Texts(HTMLParser):
    """Text nodes, stripped, without scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.texts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in _SKIP

    def handle_endtag(self, tag):
        self.depth -= tag in _SKIP and self.depth > 0

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.texts.append(data.strip())


def _texts(html: str | None) -> list[str]:
    parser = _Texts()
    parser.feed(html or "")
    parser.close()
    return parser.texts


def html_to_text(html: str | None) -> str:
    """Text nodes joined by a blank."""
    return " ".join(" ".join(_texts(html)).split())


def quote_lines(html: str | None) -> str:
    """Text nodes by line, shaped so that quoted headers can be recognised: a label alone on its line joins the
    next line, an empty line stands before a header block and after its subject."""
    lines = [x.strip() for t in _texts(html) for x in t.split("\n") if x.strip()]
    joined: list[str] = []
    for line in lines:
        waits = bool(joined) and joined[-1].endswith(":") and joined[-1][:-1] in LABELS
        if waits and not line.endswith(":") and not line.startswith(tuple(f"{x}:" for x in LABELS)):
            joined[-1] += " " + line
        else:
            joined.append(line)
    out: list[str] = []
    for k, line in enumerate(joined):
        if line.startswith("From:") and k and not joined[k - 1].startswith(("From:", "Sent:", "To:", "Subject:")):
            out.append("")
        out.append(line)
    return re.sub(r"(Subject:[^\n]+)\n(?=[^\n])", r"\1\n\n", "\n".join(out))


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.lists, self.links, self.pre = [], 0, [], [], 0

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in _SKIP:
            self.skip += 1
        elif tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1:]) + " ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "a":
            self.links.append(attrs.get("href") or "")
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{attrs.get('alt') or ''}]({attrs.get('src') or ''})")
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
            self.out.append("\n")
        elif tag == "li":
            number = self.lists[-1] if self.lists else None
            if number is not None:
                self.lists[-1] = number + 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + ("* " if number is None else f"{number + 1}. "))
        elif tag == "br":
            self.out.append("  \n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in ("td", "th"):
            self.out.append("| ")
        elif tag == "blockquote":
            self.out.append("\n\n> ")
        elif tag in _BLOCK:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "a":
            href = self.links.pop() if self.links else ""
            self.out.append(f"]({href})")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n\n")
        elif tag in ("td", "th"):
            self.out.append(" ")
        elif tag == "tr":
            self.out.append("|\n")
        elif tag in _BLOCK - _VOID - {"li"}:
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_to_markdown(html: str | None) -> str:
    """Markdown with # headings; scripts and styles go, runs of empty lines are squeezed."""
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    text = re.sub(r"[ \t]+\n(?!\n)", "\n", "".join(parser.out))
    return re.sub(r"\n[ \t]*(\n[ \t]*)+", "\n\n", text).strip()


@F.pandas_udf(StringType())
def text_column(html: pd.Series) -> pd.Series:
    return html.map(html_to_text).astype(object)


@F.pandas_udf(StringType())
def markdown_column(html: pd.Series) -> pd.Series:
    return html.map(html_to_markdown).astype(object)
