"""Repeated passages by seed and extend.

Seeds: every run of SEED words has a hash, and the leftmost least seed of each window of `length` words is its
anchor (winnowing), so equal windows have equal anchors at equal places. An anchor serves a run of consecutive
windows; the words these cover are its reach. Texts are joined on their anchors, and only anchors that stand in
more than one place go on. Extend: places of an anchor whose whole reach is alike match at once, through one row a
reach. Where a reach has no equal, its match is extended both ways, word by word: a window that begins k words
before the seed matches another place if the k words to the left of the seed and those to its right as far as the
window's end are alike there. Overlapping matches make the maximal repeats.

Anchors are counted before rows are sent and hot ones joined by broadcast, and of each reach one place is extended, so
neither copies of a text nor the places of an anchor are ever gathered in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage, tune
from .words import WordBatch, runs, scramble, spans_of

#: Words in a seed; at most the length of a repeat.
SEED = 12
#: Characters of text handled at once, which bounds a worker's memory.
CHUNK = 4_000_000
#: A key with more than one in so many of all rows is joined by broadcast; there are fewer such keys than this.
HOT = 1000
_U = np.uint64


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least value of every `width` consecutive ones."""
    place, best, span = np.arange(len(values)), values, 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        first = left <= right
        place = np.where(first, place[:-step], place[step:])
        best = np.where(first, left, right)
        span += step
    return place


def anchors(batch: WordBatch, length: int):
    """Of each anchor, in order: its text, the first of its windows and its seed as words of that text, the number
    of its windows, its hash and the hash of its reach."""
    seed = min(SEED, length)
    hashes = batch.hashes()
    if len(hashes) < length:
        none = np.empty(0, np.int64)
        return none, none, none, none, np.empty(0, _U), np.empty(0, _U)
    owner = batch.owners()
    at = np.flatnonzero(owner[: len(owner) - length + 1] == owner[length - 1 :])
    seeds = runs(hashes, seed)
    place = _least(seeds, length - seed + 1)[at]
    head = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else np.empty(0, np.int64)
    many = np.diff(np.append(head, len(at)))
    first, place = at[head], place[head]
    text = owner[first]
    begin = batch.bounds[text]
    return text, first - begin, place - begin, many, seeds[place], spans_of(hashes, first, first + many - 1 + length)


def _chunks(batches):
    """Rows of Arrow batches as lists of columns, CHUNK characters of text at a time (the last column)."""
    rows, held = [], 0
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            rows.append(row)
            held += len(row[-1])
            if held >= CHUNK:
                yield list(zip(*rows))
                rows, held = [], 0
    if rows:
        yield list(zip(*rows))


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _meet(rows: DataFrame, facts: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of rows with facts, one for each key. `weight` sums to `total` at most; keys with more than one
    HOT-th of it, of which there are fewer than HOT, are broadcast, so no task gets all rows of a hot key."""
    hot = F.broadcast(facts.where(F.col(weight) * HOT > total))
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(facts.where(F.col(weight) * HOT <= total), on))


def matches(texts: DataFrame, *, length: int = 35) -> DataFrame:
    """id, at, many: in that text, the `many` windows that begin with word `at` and after it also start anywhere else.
    `texts` has a row for each text: id, text."""
    width = length - min(SEED, length) + 1

    def seed(batches):
        for ids, listed in _chunks(batches):
            text, at, place, many, anchor, reach = anchors(WordBatch(list(listed)), length)
            place = (at * width + place - at) * width + many - 1
            yield pd.DataFrame({"id": np.array(ids, np.int64)[text], "place": place, "anchor": _signed(anchor), "reach": _signed(reach)})

    # a place: first window, words from there to the seed, windows less 1, as digits to the base `width`
    at, to_seed, many = F.expr(f"place div {width * width}"), F.expr(f"place div {width} % {width}"), F.expr(f"place % {width} + 1")
    places = stage(texts.select("id", "text").mapInPandas(seed, "id long, place long, anchor long, reach long"), "substring-places", "zstd")
    total = places.count()
    shared = places.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("reach").alias("least"), F.max("reach").alias("most")).where("c > 1")
    met = stage(_meet(places, shared, ["anchor"], "c", total).select("id", "place", "anchor", "reach", (F.col("least") < F.col("most")).alias("several")), "substring-met")
    discard(places)

    # every place of the anchor has the same reach, or this reach stands elsewhere: all its windows match
    alike, unlike = met.where("NOT several"), met.where("several").drop("several")
    on = ["anchor", "reach"]
    reaches = stage(unlike.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "place")).alias("one")), "substring-reaches")
    whole = _meet(unlike, reaches.where("n > 1").select(*on, "n"), on, "n", total)
    whole = alike.select("id", "place").unionByName(whole.select("id", "place")).select("id", at.alias("at"), many.alias("many"))

    # one place of each reach is extended
    todo = reaches.select("one.*", "anchor", "n").select("id", at.alias("at"), to_seed.alias("to_seed"), many.alias("many"), "anchor", "n")
    todo = todo.groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("at", "to_seed", "many", "anchor", "n")).alias("todo"))

    def extend(batches):
        for ids, todos, listed in _chunks(batches):
            batch = WordBatch(list(listed))
            counts = [len(t) for t in todos]
            column = lambda name: np.array([x[name] for t in todos for x in t], np.int64)
            many = column("many")
            rows = np.repeat(np.arange(len(many)), many)
            begin = np.repeat(batch.bounds[:-1], counts)
            first = begin + column("at")
            start = first[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
            seeds = (first + column("to_seed"))[rows]
            hashes = batch.hashes()
            yield pd.DataFrame(
                {"id": np.repeat(np.array(ids, np.int64), counts)[rows], "at": start - begin[rows], "n": column("n")[rows], "anchor": column("anchor")[rows],
                 "left": _signed(spans_of(hashes, start, seeds)), "right": _signed(spans_of(hashes, seeds + min(SEED, length), start + length))}
            )

    texts_with = texts.join(todo, F.col("id") == F.col("of")).select("id", "todo", "text")
    around = stage(texts_with.mapInPandas(extend, "id long, at long, n long, anchor long, left long, right long"), "substring-around", "zstd")
    on = ["anchor", "left", "right"]
    again = around.groupBy(*on).agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("d")).where("c > 1")
    parts = _meet(around.where("n = 1").drop("n"), again, on, "d", around.count())
    return whole.unionByName(parts.select("id", "at", F.lit(1).cast("long").alias("many")))


def merge(starts: np.ndarray, length: int) -> list[int]:
    """Sorted window starts -> [start, end, start, end, ...] of the words they cover."""
    cut = np.flatnonzero(np.diff(starts) > length)
    begin, end = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + length
    return np.stack((begin, end), axis=1).ravel().tolist()


def remove_repeats(docs: DataFrame, *, length: int = 35, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if keep_text, kept (the words left, joined by
    one space), for every document.

    Every word in a window of `length` words that also starts anywhere else, in whatever document, goes; windows are
    judged on the input. Null and empty texts have no words. Repeated rows repeat each other,
    so all their long passages go. Null doc_id stays null. An empty table gives no rows; other columns are ignored.
    Windows are told apart by three hashes of 64 bits (of the seed and of the words left and right of it) or by two (of
    the seed and its reach)."""
    tune(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = stage(docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", text.alias("text")), "substring-texts", "zstd")
    found = stage(matches(texts, length=length), "substring-matches")
    found = found.groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("at", "many")).alias("found"))
    joined = texts.join(found, F.col("id") == F.col("of"), "left").select(F.col("doc_id").cast("string"), "found", "text")

    def cut(batches):
        for ids, founds, listed in _chunks(batches):
            batch = WordBatch(list(listed))
            out = []
            for d, (i, found) in enumerate(zip(ids, founds)):
                a, b = int(batch.bounds[d]), int(batch.bounds[d + 1])
                spans = []
                if found is not None and len(found):
                    at, many = np.array([x["at"] for x in found]), np.array([x["many"] for x in found])
                    starts = np.repeat(at - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    spans = merge(np.unique(starts), length)
                edges = [0, *spans, b - a]
                kept = b" ".join(batch.raw[batch.starts[a + s] : batch.ends[a + e - 1]] for s, e in zip(edges[::2], edges[1::2]) if e > s)
                removed = sum(spans[1::2]) - sum(spans[::2])
                out.append((i, b - a, removed, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if keep_text else None))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    result = joined.mapInPandas(cut, "doc_id string, n_words long, n_removed long, kept_sha256 string, kept string")
    result = result.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    return result if keep_text else result.drop("kept")
