"""RFC-822 files as a source of messages: parsing, bodies, attachments, quoted replies."""

from __future__ import annotations

import email
import email.header
import email.utils
import hashlib
import mimetypes
import os
import re
import uuid
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epistle.functions import text as X
from epistle.operators import maintenance as M
from epistle.schema import MESSAGES, QUOTED

from .html import html_to_markdown, html_to_text, quote_lines

CHARSETS = ("utf-8", "iso-8859-1")
EPOCH = "1970-01-01T00:00:00Z"
# The blocks that mail programs put around a quoted message.
QUOTE_BLOCKS = (
    r"(?:^|\n\n)(From:[^\n]+\nSent:[^\n]+\nTo:[^\n]+\n(?:Cc:[^\n]+\n)?Subject:[^\n]+\n\n.+?)(?=\n{2}From:[^\n]+\n|\Z)",
    r"(?:^|\n\n)(----- ?Original Message ?-----\n.+?)(?=\n{2}----- ?Original Message ?-----\n|\Z)",
    r"(?:^|\n\n)(On\s[^\n]+?wrote:\n.+?)(?=\n{2}On\s[^\n]+?wrote:\n|\Z)",
)
_BLOCKS = [re.compile(p, re.MULTILINE | re.DOTALL) for p in QUOTE_BLOCKS]
_PARSED = T.StructType([f for f in MESSAGES if f.name not in ("ts", "category_tags", "project_tags", "is_outbound")] + [T.StructField("error", T.StringType())])


def decode_bytes(raw: bytes, charset: str | None) -> str:
    for name in (charset, *CHARSETS):
        try:
            if name:
                return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("utf-8", "replace")


def header(message, name: str, default: str = "") -> str:
    """A header as text, its encoded words decoded and joined by one blank."""
    value = message.get(name)
    if value is None:
        return default
    try:
        parts = email.header.decode_header(str(value))
    except (ValueError, email.errors.HeaderParseError):
        return default
    return " ".join((decode_bytes(p, c) if isinstance(p, bytes) else p).strip() for p, c in parts).strip() or default


def addresses(value: str) -> tuple[str | None, list[str]]:
    """The first display name of a comma list (else one made from the first address) and all addresses."""
    pairs = [email.utils.parseaddr(p.strip()) for p in value.split(",")]
    found = [a for _, a in pairs if a]
    name = next((n for n, _ in pairs if n), None)
    if not name and found:
        name = found[0].split("@")[0].translate(str.maketrans("._", "  ")).title()
    return name, found


def date_of(value: str) -> str:
    """ISO-8601 with the offset kept; without zone it is UTC; unreadable: the epoch."""
    parsed = None
    try:
        parsed = email.utils.parsedate_to_datetime(value)
    except (TypeError, ValueError, IndexError):
        try:
            parsed = datetime.fromisoformat(value.strip())
        except ValueError:
            return EPOCH
    return (parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)).isoformat()


def thread_of(message, subject_key: str) -> str | None:
    """thread- and a hash of the root message; thread-subj- and one of the subject where no header names it."""
    references = (message.get("References") or "").split()
    replies = re.findall(r"<([^>]+)>", message.get("In-Reply-To") or "")
    root = references[0].strip("<>") if references else replies[0] if replies else message.get("X-Outlook-Thread-ID") or ""
    if root:
        return "thread-" + hashlib.sha256(root.encode()).hexdigest()[:16]
    return None if subject_key == "no-subject" else "thread-subj-" + hashlib.sha256(subject_key.encode()).hexdigest()[:16]


def subject_key_of(subject: str) -> str:
    for p in (r"^(re:|fwd:|fw:|aw:|sv:|fw)\s*", r"^\[.*?\]\s*", r"^\(.*?\)\s*"):
        subject = re.sub(p, "", subject, flags=re.IGNORECASE)
    return " ".join(re.sub(r"[^\w\s]", "", subject).split()).lower() or "no-subject"


def bodies(message) -> tuple[str, str]:
    """(html, plain): the last HTML part and the first plain part that is not empty."""
    html, plain = "", ""
    for part in message.walk():
        if part.is_multipart() or "attachment" in (part.get("Content-Disposition") or "").lower():
            continue
        kind = part.get_content_type()
        if kind in ("text/html", "text/plain"):
            text = decode_bytes(part.get_payload(decode=True) or b"", part.get_content_charset())
            if kind == "text/html":
                html = text
            elif not plain:
                plain = text
    return html, plain


def payloads_of(message, html: str) -> list[tuple]:
    """Part, name and bytes of a message's files: what is disposed as an attachment, and named inline parts that the HTML does not show."""
    shown, out = set(re.findall(r"cid:([^\"'>\s]+)", html)), []
    for part in message.walk():
        disposition = (part.get("Content-Disposition") or "").lower()
        name = part.get_filename()
        inline = "inline" in disposition and "attachment" not in disposition
        if not disposition.strip() or "attachment" not in disposition and not inline or inline and (not name or (part.get("Content-ID") or "").strip("<>") in shown):
            continue
        content = part.get_payload(decode=True)
        if content is not None:
            out.append((part, name, content))
    return out


def attachments_of(message, html: str, thread_id: str | None, ts_raw: str) -> list[dict]:
    """The files of a message as structs. The path holds a prefix of the content's hash, so different contents never share one."""
    out = []
    for part, name, content in payloads_of(message, html):
        name = re.sub(r"[^\w\s\-.]", "_", name or f"attachment{mimetypes.guess_extension(part.get_content_type()) or '.bin'}")
        stem, ext = os.path.splitext(name)
        name = stem[: 255 - len(ext)] + ext
        digest = hashlib.sha256(content).hexdigest()
        when = datetime.fromisoformat(ts_raw)
        path = f"attachments/{when:%Y}/{when:%m_%b}/{thread_id or 'no-thread'}/{digest[:12]}-{name}"
        out.append({"filename": name, "path": path, "mime_type": mimetypes.guess_type(name)[0] or part.get_content_type(), "size_bytes": len(content), "sha256": digest})
    return out


def reply_fragments(text: str) -> list[str]:
    """Quoted fragments of a plain text: runs of lines that start with >, with the "wrote:" line before them."""
    out, run = [], []
    lines = text.replace("\r\n", "\n").split("\n")
    for i, line in enumerate([*lines, ""]):
        if line.startswith(">"):
            if not run and i and re.match(r"On\s.*wrote:\s*$", lines[i - 1].strip()):
                run.append(lines[i - 1].strip())
            run.append(re.sub(r"^>+ ?", "", line))
        elif run:
            out.append("\n".join(run).strip())
            run = []
    return out


def quotes_of(plain: str | None, html: str | None) -> list[str]:
    """Quoted messages worth keeping, each content once: quoted runs, or else the blocks of mail programs."""
    text = plain if plain and plain.strip() else quote_lines(html) if html and html.strip() else ""
    found, least = reply_fragments(text), 100
    if not found:
        found, least = [m.strip() for b in _BLOCKS for m in b.findall(text)], 101
    kept: dict[str, str] = {}
    for q in found:
        if len(q) >= least and X.useful_fragment(q):
            kept.setdefault(X.content_hash_of(q), q)
    return list(kept.values())


def _id(message_id: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, message_id))


def parse_message(raw: bytes, source_path: str = "") -> list[dict]:
    """The message and its salvaged quotes, as rows of MESSAGES."""
    message = email.message_from_bytes(raw)
    message_id = header(message, "Message-ID").strip().strip("<>") or f"<generated-{hashlib.sha256(raw).hexdigest()[:32]}@epistle.invalid>"
    subject, ts_raw = header(message, "Subject"), date_of(header(message, "Date"))
    key = subject_key_of(subject)
    name, senders = addresses(header(message, "From"))
    to, cc = addresses(header(message, "To"))[1], addresses(header(message, "Cc"))[1]
    html, plain = bodies(message)
    markdown = html_to_markdown(html) if html.strip() else plain
    text = plain if plain.strip() else html_to_text(html)
    thread_id = thread_of(message, key)
    files = attachments_of(message, html, thread_id, ts_raw)
    row = dict.fromkeys(f.name for f in _PARSED) | {
        "id": _id(message_id), "message_id": message_id, "thread_id": thread_id, "subject_thread_key": key, "ts_raw": ts_raw, "from_address": senders[0] if senders else "",
        "from_name": name, "sender": senders[0] if senders else "", "to_addresses": to, "cc_addresses": cc, "recipients": to + cc, "subject": subject, "body_markdown": markdown,
        "body_plain": plain or None, "body_text": text, "body_main_text": X.derive_main_text(text, markdown), "x_mailer": header(message, "X-Mailer") or None,
        "has_attachments": bool(files), "attachments": files, "folder": "Archive", "raw_eml": raw, "source": "original", "source_path": source_path,
    }
    out = [row]
    for q in quotes_of(plain, html):
        digest = X.content_hash_of(q)
        out.append(row | {"id": _id(f"{message_id}#{digest}"), "message_id": f"{message_id}#{digest[:16]}", "subject": f"[Salvaged] {subject}", "body_markdown": q, "body_plain": q, "body_text": q,
                          "body_main_text": q, "has_attachments": False, "attachments": [], "raw_eml": None, "source": QUOTED, "parent_id": row["id"], "content_hash": digest})
    return out


def files(spark: SparkSession, path: str) -> DataFrame:
    """Raw files below a folder: *.eml and any other but *.msf and *.dat; nothing hidden."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(~name.rlike(r"^\.|\.(msf|dat)$") & ~F.col("path").rlike(r"/\.[^/]")).select("path", "content")


def parse(raw: DataFrame) -> DataFrame:
    """Rows of MESSAGES (without tags) from path and content; a file that can't be read gives one row with error set."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += parse_message(bytes(content), path)
                except Exception as error:  # noqa: BLE001  any fault of a file goes to the error table
                    rows.append(dict.fromkeys(f.name for f in _PARSED) | {"id": _id(path), "message_id": path, "source_path": path, "error": f"{type(error).__name__}: {error}"})
            yield pd.DataFrame(rows, columns=[f.name for f in _PARSED])

    return raw.mapInPandas(run, _PARSED)


def compress(c: Column, level: int = 3) -> Column:
    """zstd of a binary column."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        import zstandard

        z = zstandard.ZstdCompressor(level=level)
        return values.map(lambda b: None if b is None else z.compress(bytes(b)))

    return run(c)


def decompress(c: Column) -> Column:
    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        import zstandard

        z = zstandard.ZstdDecompressor()
        return values.map(lambda b: None if b is None else z.decompress(bytes(b)))

    return run(c)


def quotes_column(plain: Column, html: Column) -> Column:
    """Quoted messages of texts, as an array."""

    @F.pandas_udf("array<string>")
    def run(p: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([quotes_of(a, b) for a, b in zip(p, h)])

    return run(plain, html)


def attachment_contents(raw: DataFrame) -> DataFrame:
    """sha256 and content of the attachments of raw messages (column content), as `attachments_of` lists them."""

    def run(batches):
        for pdf in batches:
            out = []
            for content in pdf["content"]:
                try:
                    message = email.message_from_bytes(bytes(content))
                    out += payloads_of(message, bodies(message)[0])
                except Exception:  # noqa: BLE001  the file has its row in the error table already
                    continue
            yield pd.DataFrame([(hashlib.sha256(c).hexdigest(), c) for _, _, c in out], columns=["sha256", "content"])

    return raw.select("content").mapInPandas(run, "sha256 string, content binary")


def messages(parsed: DataFrame, registry: DataFrame | None = None, owners: list[str] | None = None, stored: DataFrame | None = None, encoder=None, dims: int = 384) -> DataFrame:
    """Parsed rows ready to store: deduplicated (messages by message_id, quotes by content and, given an encoder, by likeness
    within their thread), tagged, raw bytes compressed, with time and direction. Owners default to the most frequent sender
    of what is stored and parsed."""
    good = parsed.where("error IS NULL").drop("error")
    originals = M.new_messages(good.where(F.col("source") != QUOTED), stored)
    quotes = M.new_quotes(good.where(F.col("source") == QUOTED).join(originals.select(F.col("id").alias("parent_id")), "parent_id", "left_semi"), stored)
    if encoder is not None:
        from epistle.operators import vectors as V

        quotes = M.unlike_in_thread(V.embed(quotes, F.col("body_text"), dims, encoder))
    rows = originals.unionByName(quotes).withColumn("ts", F.try_to_timestamp("ts_raw")).withColumn("category_tags", M.categories(F.col("subject"), F.col("body_markdown")))
    if owners is None:
        senders = originals.select("from_address")
        if stored is not None:
            senders = senders.unionByName(stored.where(F.coalesce("source", F.lit("original")) != QUOTED).select("from_address"))
        owners = [r.from_address for r in _owner(senders).collect()]
    rows = rows.withColumn("is_outbound", M.is_outbound(owners) if owners else F.lit(False))
    rows = M.tag_projects(rows, registry) if registry is not None else rows.withColumn("project_tags", F.array().cast("array<string>"))
    return rows.withColumn("raw_eml", compress(F.col("raw_eml"))).select(*[f.name for f in MESSAGES])


def _owner(rows: DataFrame) -> DataFrame:
    from epistle.operators.analytics import owner

    return owner(rows)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Messages of all files below a folder."""
    return messages(parse(files(spark, path)), **options)


