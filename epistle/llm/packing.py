"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of token ids. A schedule (piecewise linear in time, exact integers) says how many
ids of each queue belong to the first t ids of the output; blocks of whole windows are cut from that schedule, so what a
block owes a source is settled by arithmetic alone and carried over block and partition
boundaries without any sequential pass. Inside a block classic deficit round-robin fills
window after window: each window credits every source with its share, sources are visited in
turn and served while they have credit, and what is over or short is carried to the next window.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, tune
from .token_ids import encoder, in_pieces

PIECES = "doc_id string, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Schedule:
    """How many ids of each queue lie among the first t ids of the output.

    sizes: ids by queue; weights: the proportions wanted (integers), renormalised over the
    queues that are not yet empty. Between two moments at which a queue runs out every
    count is linear, so both directions are closed forms."""

    def __init__(self, sizes: dict, weights: dict):
        self.times, self.phases = [], []
        done, t = dict.fromkeys(sizes, 0), 0
        while left := {s: sizes[s] - done[s] for s in sizes if sizes[s] > done[s]}:
            live = {s: weights.get(s, 0) for s in left}
            if not any(live.values()):
                live = left
            total = sum(live.values())
            self.times.append(t)
            self.phases.append((dict(done), live, total))
            step = max(1, min(-(-left[s] * total // w) for s, w in live.items() if w))
            done = {s: min(sizes[s], done[s] + step * live.get(s, 0) // total) for s in sizes}
            t += step
        self.sizes, self.end = sizes, t

    def taken(self, s, t: int) -> int:
        if t >= self.end:
            return self.sizes[s]
        k = bisect_right(self.times, t) - 1
        done, live, total = self.phases[k]
        return min(self.sizes[s], done[s] + (t - self.times[k]) * live.get(s, 0) // total)

    def block_of(self, s, position: int, block: int) -> int:
        """The block whose range of queue s holds the id at `position`."""
        low, high = 0, self.end // block + 1
        while low < high:
            mid = (low + high) // 2
            if self.taken(s, (mid + 1) * block) > position:
                high = mid
            else:
                low = mid + 1
        return low


def id_type(vocabulary: int) -> str:
    """How ids are kept between stages: as few bytes as hold the vocabulary."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


#: Rows of queue bases up to which they are broadcast; beyond, they are joined by shuffling.
BROADCAST_ROWS = 200_000


def encode_queues(docs: DataFrame, tokenizer: str, eos: int, source: str = "source") -> DataFrame:
    """doc_id, source, pid, local (ids of that source before it in its partition), n_tokens, ids
    (binary, little-endian, 2 or 4 bytes an id). Null text counts as empty: only the end id."""

    def run(batches):
        enc, pid, seen = encoder(tokenizer), TaskContext.get().partitionId(), {}
        dtype = id_type(enc.vocabulary)
        for pdf in batches:
            texts, parts = pdf["text"].tolist(), []
            for piece in in_pieces(texts):
                parts += enc.encode(texts[piece])
            queues = [None if pd.isna(s) else str(s) for s in pdf["source"]]
            local = []
            for s, ids in zip(queues, parts):
                local.append(seen.get(s, 0))
                seen[s] = local[-1] + len(ids) + 1
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "source": pd.Series(queues, dtype=object), "pid": pid, "local": local,
                "n_tokens": [len(ids) + 1 for ids in parts],
                "ids": [np.append(ids, eos).astype(dtype).tobytes() for ids in parts],
            })

    wanted = docs.select(F.col("doc_id").cast("string"), F.col(source).cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return wanted.mapInPandas(run, "doc_id string, source string, pid long, local long, n_tokens long, ids binary")


def _fill(block: int, queues: list[list[list[int]]], window: int, least: int) -> list[tuple]:
    """Deficit round-robin over one block. queues: by source, [row, offset, left] in order.
    Returns (row, offset, length, sequence, place)."""
    totals = [sum(x[2] for x in q) for q in queues]
    whole = sum(totals)
    heads, credit, out, first = [0] * len(queues), [0.0] * len(queues), [], 0
    served, sequence = 0, block << 20
    while served < whole:
        rest = whole - served
        # full windows; what is left at the end of the block is cut at powers of two
        size = window if rest >= window else 1 << (rest.bit_length() - 1)
        credit = [c + size * t / whole for c, t in zip(credit, totals)]
        at = 0
        while at < size:
            live = [s for s in range(len(queues)) if heads[s] < len(queues[s])]
            turn = [s for s in live if credit[s] >= min(least, queues[s][heads[s]][2])]
            # no source has credit for a piece worth cutting: the one owed most goes first
            s = min(turn, key=lambda x: (x - first) % len(queues)) if turn else max(live, key=lambda x: credit[x])
            while at < size and heads[s] < len(queues[s]):
                item = queues[s][heads[s]]
                length = min(item[2], size - at, max(least, int(credit[s])))
                out.append((item[0], item[1], length, sequence, at))
                item[1] += length
                item[2] -= length
                heads[s] += not item[2]
                credit[s] -= length
                at += length
                if credit[s] < least:
                    break
            first = (s + 1) % len(queues)
        served += size
        sequence += 1
    return out


def pack(docs: DataFrame, tokenizer: str, *, eos: int = 1, window: int = 2048, source: str = "source",
         weights: dict | None = None, block_windows: int = 64, least: int = 256) -> DataFrame:
    """Cut the ids of all documents into sequences of at most `window` ids and return the pieces.

    weights: source (as text; None for null) -> whole number, the proportions wanted; by default the sources' own
    sizes, so that all queues end together. A source's proportions hold over any run of windows to
    within `least` ids and one window. Sequences are full, except that the end of a block is cut at
    powers of two, so nothing is padded.

    Null and empty texts give one piece, the end id. Null sources form a queue of their own.
    Repeated rows are packed once each; doc_id may be null. An empty table gives no rows. Other
    columns are ignored. The driver keeps a few numbers for each source and phase.
    """
    spark = docs.sparkSession
    tune(spark)
    encoded = stage(encode_queues(docs, tokenizer, eos, source), "packing-ids")
    encoded = encoded.withColumn("queue", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    parts = stage(encoded.groupBy("queue", "pid").agg(F.sum("n_tokens").alias("part")), "packing-parts")
    dtype = np.dtype(id_type(encoder(tokenizer).vocabulary))
    width = dtype.itemsize
    totals = {r["queue"]: r["n"] for r in parts.groupBy("queue").agg(F.sum("part").alias("n")).collect()}
    wanted = totals if weights is None else {"" if s is None else "=" + s: w for s, w in weights.items()}
    schedule, block = Schedule(totals, wanted), block_windows * window
    before = F.sum("part").over(Window.partitionBy("queue").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    bases = parts.select("queue", "pid", F.coalesce(before, F.lit(0)).alias("base"))
    if parts.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)

    @F.pandas_udf("array<long>")
    def cuts(queue: pd.Series, begin: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for s, g, n in zip(queue, begin, size):
            b = schedule.block_of(s, g, block)
            row = [b, 0]
            while (edge := schedule.taken(s, (b + 1) * block) - g) < n:
                if edge > row[-1]:
                    row.append(edge)
                else:  # a block without ids of this queue: nothing between two equal edges
                    row.append(row[-1])
                b += 1
            out.append([*row, int(n)])
        return pd.Series(out)

    placed = (
        encoded.join(bases, ["queue", "pid"])
        .withColumn("begin", F.col("base") + F.col("local"))
        .withColumn("cuts", cuts("queue", "begin", "n_tokens"))
        .withColumn("part", F.explode(F.expr("transform(sequence(1, size(cuts) - 2), i -> struct(cuts[0] + i - 1 AS block, cuts[i] AS lo, cuts[i + 1] - cuts[i] AS n))")))
        .where("part.n > 0")
        .select("doc_id", "source", "queue", "n_tokens", F.col("part.block").alias("block"), F.col("part.lo").alias("lo"), F.col("part.n").alias("n"),
                (F.col("begin") + F.col("part.lo")).alias("at"), F.expr(f"substring(ids, CAST({width} * part.lo + 1 AS INT), CAST({width} * part.n AS INT))").alias("ids"))
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["queue", "at"], kind="stable").reset_index(drop=True)
        queues = [[[i, 0, n] for i, n in zip(g.index.tolist(), g["n"].tolist())] for _, g in pdf.groupby("queue", sort=True)]
        found = _fill(int(pdf["block"].iat[0]), queues, window, least)
        rows = np.array([f[0] for f in found])
        blobs = pdf["ids"].tolist()
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].to_numpy()[rows], "source": pdf["source"].to_numpy()[rows],
            "start": pdf["lo"].to_numpy()[rows] + [f[1] for f in found], "length": [f[2] for f in found],
            "ids_crc32": [zlib.crc32(np.frombuffer(blobs[f[0]], dtype)[f[1] : f[1] + f[2]].astype("<u4").tobytes()) for f in found],
            "doc_tokens": pdf["n_tokens"].to_numpy()[rows], "sequence_id": [f[3] for f in found], "offset": [f[4] for f in found],
        })

    return placed.groupBy("block").applyInPandas(fill, PIECES).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
