"""Offset-mapped token counts: tokens of whole documents, attributed to sections by character spans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune
from .token_ids import encoder, in_pieces

COLUMNS = ("section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens")
RULES = ("majority", "start", "end")


def token_spans(text: str, ids: np.ndarray, byte_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token. A token that holds only part of a
    character's bytes covers the whole character."""
    sizes = byte_lengths[ids]
    ends = np.cumsum(sizes)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return character[ends - sizes], character[ends - 1] + 1


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of token spans with sorted, disjoint sections: the section of each token
    (-1: none) and whether the token crosses an edge. By `rule` a crossing token
    goes to the section of its first character (start), of its last (end), or to the one
    that holds most of its characters, the earlier of equals (majority)."""
    a = np.searchsorted(starts, first, "right") - 1
    a = np.where((a >= 0) & (first < ends[np.maximum(a, 0)]), a, -1)
    b = np.searchsorted(starts, last - 1, "right") - 1
    b = np.where((b >= 0) & (last - 1 < ends[np.maximum(b, 0)]), b, -1)
    chosen = (b if rule == "end" else a).copy()
    across = np.flatnonzero((a != b) | (a < 0))
    if rule == "majority":
        for i in across:
            lo = max(int(np.searchsorted(starts, first[i], "right")) - 1, 0)
            hi = int(np.searchsorted(starts, last[i] - 1, "right"))
            shared = [min(last[i], ends[k]) - max(first[i], starts[k]) for k in range(lo, hi)]
            chosen[i] = lo + int(np.argmax(shared)) if shared and max(shared) > 0 else -1
    crossing = np.zeros(len(first), bool)
    crossing[across] = True
    return chosen, crossing


def count_tokens(docs: DataFrame, tokenizer: str, *, rule: str = "majority") -> DataFrame:
    """Tokens of each line of each document: doc_id, section (from 0), start_char, end_char,
    n_tokens, n_crossing (of those, how many cross the section's edge), doc_tokens.

    The whole document is encoded once; a line is never encoded alone, so the counts
    of a document's lines add up to the document's tokens. Null and empty texts have one section without
    tokens. Repeated rows are counted once each, null doc_id stays null, an empty table gives no
    rows and other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    tune(docs.sparkSession)

    def run(batches):
        enc = encoder(tokenizer)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            ids = pdf["doc_id"].to_numpy(dtype=object)
            for piece in in_pieces(texts, 1_000_000):
                owner, parts = [], []
                for doc_id, text, tokens in zip(ids[piece], texts[piece], enc.encode(texts[piece])):
                    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
                    starts = np.append(0, ends[:-1])
                    ends[-1] -= 1
                    n = len(starts)
                    counts = over = np.zeros(n, np.int64)
                    if len(tokens):
                        section, crossing = attribute(*token_spans(text, tokens, enc.byte_lengths), starts, ends, rule)
                        counts, over = np.bincount(section, minlength=n), np.bincount(section[crossing], minlength=n)
                    owner += [doc_id] * n
                    parts.append(np.stack((np.arange(n), starts, ends, counts, over, np.full(n, len(tokens)))))
                columns = np.concatenate(parts, axis=1)
                yield pd.DataFrame({"doc_id": pd.Series(owner, dtype=object)} | dict(zip(COLUMNS, columns)))

    wanted = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string").alias("text"))
    counted = wanted.mapInPandas(run, "doc_id string, " + ", ".join(f"{c} long" for c in COLUMNS))
    return counted.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
