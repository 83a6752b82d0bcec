"""Comparison semantics of the archive: ASCII-only LIKE, time as text, keyset cursors."""

from __future__ import annotations

import base64
import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def like(c: Column, pattern: str) -> Column:
    """LIKE that ignores case in ASCII only and has no escape character."""
    folded = pattern.translate(str.maketrans(_UPPER, _LOWER)).replace("\x02", "\x02\x02")
    # the SQL form, because only it takes an escape character; \x02 can't be meant in a pattern
    return F.like(ascii_lower(c), F.lit(folded), F.lit("\x02"))


def contains(c: Column, text: str) -> Column:
    """LIKE %text%; % and _ in text are wildcards."""
    return like(c, f"%{text}%")


def period(ts: Column, granularity: str) -> Column:
    """Calendar bucket of a timestamp; anything but month and quarter means year."""
    if granularity == "month":
        return F.date_format(ts, "yyyy-MM")
    if granularity == "quarter":
        return F.concat(F.date_format(ts, "yyyy"), F.lit("-"), F.quarter(ts).cast("string"))
    return F.date_format(ts, "yyyy")


def encode_cursor(ts: str, id_) -> str:
    return base64.b64encode(json.dumps({"ts": ts, "id": id_}).encode()).decode()


def decode_cursor(cursor: str) -> tuple[str, object]:
    try:
        found = json.loads(base64.b64decode(cursor, validate=True))
        return found["ts"], found["id"]
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError(f"not a cursor: {cursor!r}") from error


def after(ts: Column, id_: Column, at: tuple, ascending: bool) -> Column:
    """Rows that follow (ts, id) in keyset order."""
    if ascending:
        return (ts > F.lit(at[0])) | ((ts == F.lit(at[0])) & (id_ > F.lit(at[1])))
    return (ts < F.lit(at[0])) | ((ts == F.lit(at[0])) & (id_ < F.lit(at[1])))


def _accents() -> tuple[str, str]:
    """Lower-case letters that are a base letter with marks, and those base letters, by Unicode decomposition."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    plain = [(c, d[0]) for c, d in pairs if c == c.lower() and len(d) > 1 and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in plain), "".join(b for _, b in plain)


ACCENTED, BASES = _accents()


def fold(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(c), ACCENTED, BASES)


def tokens(c: Column) -> Column:
    """Index tokens of a text: folded runs of letters and digits; null has none."""
    return F.regexp_extract_all(F.coalesce(fold(c), F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fold_text(text: str) -> str:
    return text.lower().translate(str.maketrans(ACCENTED, BASES))
