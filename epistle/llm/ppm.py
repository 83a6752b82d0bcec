"""Scoring by prediction by partial matching over bytes.

Training counts every run of `order` + 1 bytes (texts lower-cased in A-Z, start padded, end
marked); shorter contexts are its suffixes. From the counts a trie of contexts is built and turned into an automaton: a state for
each context, and for each state and byte the next state and the log probability, with method-C
escapes (distinct / (total + distinct)) and exclusion of the symbols that the longer context has
seen. Escapes from the empty context share what is left evenly among unseen bytes. Scoring a text is then a few array
lookups a byte.

The broadcast trie keeps the most frequent contexts, `states` of them at most. A context is kept with all its symbols,
and with it all its suffixes and prefixes, so what it says behind a kept context of full length is exact. All other
bytes are asked of the staged counts: grams are sent to the part that holds their contexts, which answers with
their exact probability. `states` bounds memory and decides nothing else; the model grows with the corpus.

Beside it stands a unigram model of words, whose vocabulary grows with the corpus: it is never gathered, words
and their counts meet by hash.
"""

from __future__ import annotations

import json
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, stage, tune
from .words import WordBatch, _LOWER, scramble

END, PAD = 0xFE, 0xFF  # never in UTF-8
#: Symbols that may follow any context: all bytes but PAD.
SYMBOLS = 255
#: Characters in a chunk, entries a task holds before it hands them on, bytes of text behind one joining task.
CHUNK, HELD, TASK_BYTES = 4_000_000, 2_000_000, 16_000_000
#: Words this frequent (as a share of all, so at most as many) are counted where they stand.
HOT = 1 / 65_536
_U = np.uint64
_END_WORD = _U(0x5EED)
_COUNTS = "kind string, p long, codes binary, counts binary"


def stream(texts: list, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as bytes, each after `order` pads and before an end mark; starts of texts there."""
    lead, blobs = bytes([PAD]) * order, [t.encode("utf-8", "surrogatepass").translate(_LOWER) if t else b"" for t in texts]
    sizes = np.fromiter((len(b) + order + 1 for b in blobs), np.int64, len(blobs))
    return np.frombuffer(b"".join(x for b in blobs for x in (lead, b, b"\xfe")), np.uint8), np.cumsum(sizes) - sizes


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """Each predicted byte with the `order` bytes before it, as one number, the byte lowest."""
    if not len(data):
        return np.empty(0, _U)
    code = np.zeros(len(data) - order, _U)
    for j in range(order + 1):
        code = (code << _U(8)) | data[j : len(data) - order + j]
    return code[data[order:] != PAD]


def tally(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, with their counts (or sums of weights)."""
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    sums = np.diff(np.append(first, len(values))) if weights is None else np.add.reduceat(weights, first) if len(first) else weights
    return values[first], sums


@dataclass
class Automaton:
    order: int
    column: np.ndarray  # byte -> column; bytes unseen in training share one
    following: np.ndarray  # states x columns: next state
    score: np.ndarray  # states x columns: log10 probability
    deepest: int = 0  # the first state of full length

    def scores(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text with its end, but for the bytes behind contexts that were not
        kept in full length: the grams of these, and the text of each."""
        if not texts:
            return np.empty(0), np.empty(0, _U), np.empty(0, np.int64)
        data, starts = stream(texts, self.order)
        column, wide = self.column[data].astype(np.int32), self.following.shape[1]
        state, table = np.zeros(len(data), np.int32), self.following.ravel()
        for _ in range(self.order):
            moved = table[state[:-1] * wide + column[1:]]
            state[0], state[1:] = 0, moved
        logs = np.zeros(len(data))
        logs[1:] = self.score.ravel()[state[:-1] * wide + column[1:]]
        if self.order == 0:
            logs[0] = self.score[0, column[0]]
        cold = np.append(False, (state[:-1] < self.deepest) & (data[1:] != PAD))
        logs[cold] = 0.0
        at = np.flatnonzero(cold)
        codes = np.zeros(len(at), _U)
        for j in range(self.order, -1, -1):
            codes = (codes << _U(8)) | data[at - j]
        return np.add.reduceat(logs, starts), codes, np.searchsorted(starts, at, side="right") - 1


def build(order: int, entries: dict[int, tuple[np.ndarray, np.ndarray]]) -> Automaton:
    """From, by length of context, codes (context and symbol) and counts of all kept contexts."""
    zero_codes, zero_counts = entries.get(0, (np.empty(0, _U), np.empty(0, np.int64)))
    context_bytes = {int(c >> _U(8 * j)) & 0xFF for k, (codes, _) in entries.items() for j in range(1, k + 1) for c in np.unique(codes >> _U(8 * j) & _U(0xFF)) << _U(8 * j)}
    known = sorted({int(c) for c in zero_codes} | context_bytes | {PAD, END})
    column = np.full(256, len(known), np.uint8 if len(known) < 256 else np.uint16)
    column[known] = np.arange(len(known))
    wide = len(known) + 1
    contexts, base = {0: np.zeros(1, _U)}, {0: 0}
    for k in range(1, order + 1):
        codes = entries.get(k, (np.empty(0, _U), None))[0]
        contexts[k] = np.unique(codes >> _U(8))
        base[k] = base[k - 1] + len(contexts[k - 1])
    total = base[order] + len(contexts[order])
    score = np.zeros((total, wide), np.float32)
    # of the contexts one byte shorter: counts, and each symbol's probability once they are escaped from
    counts_before = after_before = None
    for k in range(order + 1):
        codes, counts = entries.get(k, (np.empty(0, _U), np.empty(0, np.int64)))
        n = len(contexts[k])
        table, fallen = np.zeros((n, wide), np.float32), np.zeros((n, wide), np.float32)
        table[np.searchsorted(contexts[k], codes >> _U(8)), column[(codes & _U(0xFF)).astype(np.int64)]] = counts
        for a in range(0, n, 4096):  # by blocks of rows, so that temporaries stay small
            c = table[a : a + 4096].astype(float)
            seen = c > 0
            whole, kinds = c.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
            if k == 0:
                after = np.full((1, wide), 1.0 / max(1, SYMBOLS - int(kinds[0, 0])))
            else:
                up = np.searchsorted(contexts[k - 1], contexts[k][a : a + 4096] & _U((1 << 8 * (k - 1)) - 1)) if k > 1 else np.zeros(len(c), np.int64)
                above = counts_before[up].astype(float)
                left, left_kinds = np.where(seen, 0.0, above), ((above > 0) & ~seen).sum(axis=1, keepdims=True)
                below = np.maximum(left.sum(axis=1, keepdims=True) + left_kinds, 1e-300)
                after = np.where(above > 0, left / below, np.where(left_kinds > 0, left_kinds / below, 1.0) * after_before[up])
            fallen[a : a + 4096] = after
            below = np.maximum(whole + kinds, 1e-300)
            p = np.where(seen, c / below, np.where(kinds > 0, kinds / below, 1.0) * after)
            score[base[k] + a : base[k] + a + len(c)] = np.log10(np.maximum(p, 1e-30))
        counts_before, after_before = table, fallen
    score[:, column[PAD]] = 0.0
    following = np.zeros((total, wide), np.int32)
    for k in range(order + 1):
        for i, byte in enumerate(known):
            rows = slice(base[k], base[k] + len(contexts[k]))
            target = np.zeros(len(contexts[k]), np.int32)
            # the longest kept suffix of context + byte; longer ones overwrite shorter ones
            for j in range(0, min(k, order - 1) + 1):
                want = ((contexts[k] & _U((1 << 8 * j) - 1)) << _U(8)) | _U(byte)
                at = np.searchsorted(contexts[j + 1], want)
                hit = at < len(contexts[j + 1])
                hit[hit] = contexts[j + 1][at[hit]] == want[hit]
                target[hit] = base[j + 1] + at[hit]
            following[rows, i] = target
    return Automaton(order, column, following, score, base[order])


class Counts:
    """Exact log10 probabilities of grams from the counts of all contexts: sorted codes and counts by length of context."""

    def __init__(self, order: int, entries: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.order, self.levels = order, []
        for k in range(order + 1):
            codes, counts = entries.get(k, (np.empty(0, _U), np.empty(0, np.int64)))
            first, totals = _contexts(codes, counts)
            above = np.zeros(len(first), np.int64)  # what the shorter context counts of the symbols seen here
            if k and len(first):
                above = np.add.reduceat(self._count(k - 1, codes), first)
            self.levels.append((codes, counts, codes[first] >> _U(8), totals, np.diff(np.append(first, len(codes))), above))

    def _count(self, k: int, grams: np.ndarray) -> np.ndarray:
        codes, counts = self.levels[k][:2]
        at, hit = _find(codes, grams & _U((1 << 8 * (k + 1)) - 1))
        return np.where(hit, counts[at], 0) if len(codes) else np.zeros(len(grams), np.int64)

    def logs(self, grams: np.ndarray) -> np.ndarray:
        n = len(grams)
        p, after, lower, lower_whole, lower_kinds = np.full(n, 1.0 / SYMBOLS), np.full(n, 1.0 / SYMBOLS), None, None, None
        for k, (codes, _, contexts, totals, kinds_of, above_of) in enumerate(self.levels):
            at, hit = _find(contexts, (grams >> _U(8)) & _U((1 << 8 * k) - 1))
            if not len(contexts):
                break
            whole, kinds, above = (np.where(hit, x[at], 0) for x in (totals, kinds_of, above_of))
            count = self._count(k, grams)
            if k == 0:
                then = np.full(n, 1.0 / max(1, SYMBOLS - int(kinds_of[0])))
            else:
                left_kinds = lower_kinds - kinds
                below = np.maximum(lower_whole - above + left_kinds, 1)
                then = np.where(lower > 0, lower / below, np.where(left_kinds > 0, left_kinds / below, 1.0) * after)
            p = np.where(hit, np.where(count > 0, count, kinds * then) / np.maximum(whole + kinds, 1), p)
            after, lower, lower_whole, lower_kinds = then, count, whole, kinds
        return np.log10(p)


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted values in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def _flush(kind, codes, counts, part, parts):
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    return [(kind, int(p), codes[rows].astype("<u8").tobytes(), counts[rows].astype("<u8").tobytes()) for p in np.flatnonzero(np.diff(edges)) for rows in (order[edges[p] : edges[p + 1]],)]


def _part_of_gram(codes: np.ndarray, parts: int) -> np.ndarray:
    """Grams with the same last two context bytes meet, so all contexts of two bytes or more are whole."""
    return (scramble((codes >> _U(8)) & _U(0xFFFF)) % _U(parts)).astype(np.int64)


def count_corpus(training: DataFrame, order: int, parts: int) -> DataFrame:
    """Counts of all grams (kind g0 to g<order>, by length of context) and words (kind w) of column text,
    by part: codes and counts, sorted, one row for each kind and part. g1 is split over parts."""

    def count(batches):
        kept = {"g": (np.empty(0, _U), np.empty(0, np.int64)), "w": (np.empty(0, _U), np.empty(0, np.int64))}

        def add(kind, values):
            a, b = tally(values)
            if kept[kind][0].size:
                a, b = tally(np.concatenate((kept[kind][0], a)), np.concatenate((kept[kind][1], b)))
            kept[kind] = a, b

        def give(kind):
            a, b = kept[kind]
            kept[kind] = np.empty(0, _U), np.empty(0, np.int64)
            return _flush(kind, a, b, _part_of_gram(a, parts) if kind == "g" else (a % _U(parts)).astype(np.int64), parts)

        texts, held = [], 0

        def take():
            add("g", grams(stream(texts, order)[0], order))
            add("w", np.concatenate((WordBatch(texts, lower=True).hashes(), np.full(len(texts), _END_WORD))))
            return [r for kind in "gw" if len(kept[kind][0]) > HELD for r in give(kind)]

        names = [c.split()[0] for c in _COUNTS.split(", ")]
        for pdf in batches:
            for t in pdf["text"]:
                texts.append(t)
                held += len(t) if t else 0
                if held >= CHUNK:
                    yield pd.DataFrame(take(), columns=names)
                    texts, held = [], 0
        if texts:
            yield pd.DataFrame(take(), columns=names)
        yield pd.DataFrame([r for kind in "gw" for r in give(kind)], columns=names)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out, p = [], int(pdf["p"].iat[0])
        for kind, part in pdf.groupby("kind"):
            codes, counts = tally(np.frombuffer(b"".join(part["codes"]), "<u8").astype(_U), np.frombuffer(b"".join(part["counts"]), "<u8").astype(np.int64))
            if kind == "w":
                out.append(("w", p, codes.tobytes(), counts.tobytes()))
                continue
            for k in range(order, 0, -1):
                codes, counts = tally(codes & _U((1 << 8 * (k + 1)) - 1), counts) if k < order else (codes, counts)
                out.append((f"g{k}", p, codes.tobytes(), counts.tobytes()))
        return pd.DataFrame(out, columns=["kind", "p", "codes", "counts"])

    return training.select("text").mapInPandas(count, _COUNTS).groupBy("p").applyInPandas(total, _COUNTS)


def _contexts(codes: np.ndarray, counts: np.ndarray):
    """First entry and total of each context of sorted codes."""
    context = codes >> _U(8)
    first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(codes) else np.empty(0, np.int64)
    return first, np.add.reduceat(counts, first) if len(first) else counts


def _bin(totals: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(totals, 1)) * 16).astype(np.int64)


def train(counted: DataFrame, order: int, states: int) -> tuple[Automaton, dict]:
    """The automaton of the most frequent contexts, `states` at most beside those of length 0 and 1, and the counts of these two lengths."""

    def histogram(batches):
        for pdf in batches:
            found = np.zeros(1024, np.int64)
            for kind, codes, counts in zip(pdf["kind"], pdf["codes"], pdf["counts"]):
                if kind > "g1":
                    _, totals = _contexts(np.frombuffer(codes, "<u8"), np.frombuffer(counts, "<i8"))
                    found += np.bincount(_bin(totals), minlength=1024)
            yield pd.DataFrame({"bin": np.arange(1024), "n": found})

    trie = counted.where("kind <> 'w'")
    sizes = np.zeros(1024, np.int64)
    for r in trie.mapInPandas(histogram, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        sizes[r["bin"]] = r["n"]
    above = np.cumsum(sizes[::-1])[::-1]
    least = int(np.argmax(above <= states))  # the lowest bin from which all contexts fit

    def keep(batches):
        for pdf in batches:
            out = []
            for kind, codes, counts in zip(pdf["kind"], pdf["codes"], pdf["counts"]):
                codes, counts = np.frombuffer(codes, "<u8"), np.frombuffer(counts, "<i8")
                if kind > "g1":
                    first, totals = _contexts(codes, counts)
                    mask = np.repeat(_bin(totals) >= least, np.diff(np.append(first, len(codes))))
                    codes, counts = codes[mask], counts[mask]
                out.append((int(kind[1:]), codes.tobytes(), counts.tobytes()))
            yield pd.DataFrame(out, columns=["k", "codes", "counts"])

    found: dict[int, list] = {}
    for r in trie.mapInPandas(keep, "k int, codes binary, counts binary").toLocalIterator():
        found.setdefault(r["k"], []).append((np.frombuffer(r["codes"], "<u8"), np.frombuffer(r["counts"], "<i8")))
    entries = {k: tally(*(np.concatenate(x) for x in zip(*parts))) for k, parts in found.items()}
    if 1 in entries:
        entries[0] = tally(entries[1][0] & _U(0xFF), entries[1][1])
    return build(order, entries), {k: entries[k] for k in (0, 1) if k in entries}


def score(docs: DataFrame, held_out: Column, *, order: int = 5, states: int = 100_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    Learns from documents where `held_out` is false. score: log10 probability of the whole text
    (A-Z lower-cased) and its end by the byte model. base_score: sum over words and one end of
    log10((c + 0.1) / (N + 0.1 (V + 1))). Null and empty texts are an end only. Null `held_out` counts as true.
    Repeated rows are scored once each, null doc_id stays null, an empty table gives no rows;
    other columns are ignored. Words are told apart by a 64-bit hash.
    """
    if not 1 <= order <= 7:
        raise ValueError("order must be 1 to 7")
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col("doc_id").cast("string"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_width(spark), size // TASK_BYTES)
    counted = stage(count_corpus(rows.where("NOT held_out"), order, parts), "ppm-counts")

    def sums(batches):
        for pdf in batches:
            each = [np.frombuffer(c, "<i8") for c in pdf["counts"]]
            yield pd.DataFrame({"n": [int(c.sum()) for c in each], "v": [len(c) for c in each]})

    words = counted.where("kind = 'w'")
    found = words.mapInPandas(sums, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    n_train, vocabulary = found[0] or 0, found[1] or 0
    floor = n_train + 0.1 * (vocabulary + 1)
    hot_from = max(1, math.ceil(n_train * HOT))

    def hottest(batches):
        for pdf in batches:
            for codes, counts in zip(pdf["codes"], pdf["counts"]):
                codes, counts = np.frombuffer(codes, "<u8"), np.frombuffer(counts, "<i8")
                yield pd.DataFrame({"code": codes[counts >= hot_from].view("<i8"), "n": counts[counts >= hot_from]})

    hot = words.mapInPandas(hottest, "code long, n long").toPandas()  # at most 1 / HOT rows
    hot = hot.assign(code=hot["code"].to_numpy(np.int64).view(_U)).sort_values("code")
    model, short = train(counted, order, states)
    shared = spark.sparkContext.broadcast((model, hot["code"].to_numpy(_U), hot["n"].to_numpy(np.int64), short))

    def local(name, texts, ids, held):
        model, hot_codes, hot_counts, _ = shared.value
        batch = WordBatch(texts, lower=True)
        codes, owner = batch.hashes(), batch.owners()
        n = len(texts)
        found = [(a, *model.scores(texts[a : a + 64])) for a in range(0, n, 64)]
        scores = np.concatenate([f[1] for f in found])
        codes, owner = np.append(codes, np.full(n, _END_WORD)), np.append(owner, np.arange(n))
        at = np.minimum(np.searchsorted(hot_codes, codes), max(len(hot_codes) - 1, 0)) if len(hot_codes) else np.zeros(len(codes), np.int64)
        is_hot = hot_codes[at] == codes if len(hot_codes) else np.zeros(len(codes), bool)
        base = np.bincount(owner[is_hot], np.log10((hot_counts[at[is_hot]] + 0.1) / floor), minlength=n)
        known = np.bincount(owner[is_hot], minlength=n)
        out = []

        def ask(kind, codes, owner, part_of):
            order_ = np.argsort(codes, kind="stable")
            codes, owner = codes[order_], owner[order_]
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
            times = np.diff(np.append(first, len(codes)))
            part = part_of(codes[first])
            by_part = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[by_part], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edges)):
                r = by_part[edges[p] : edges[p + 1]]
                each = times[r]
                index = np.repeat(first[r] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
                out.append((kind, int(p), name, codes[first[r]].tobytes(), each.astype("<u4").tobytes(), owner[index].astype("<u4").tobytes(), n))

        ask("x", codes[~is_hot], owner[~is_hot], lambda c: (c % _U(parts)).astype(np.int64))
        ask("y", np.concatenate([f[2] for f in found]), np.concatenate([f[3] + f[0] for f in found]), lambda c: _part_of_gram(c, parts))
        about = json.dumps([ids, held, (batch.counts + 1).tolist(), known.tolist(), base.tolist(), scores.tolist()]).encode()
        out.append(("d", zlib.crc32(name.encode()) % parts, name, about, None, None, n))
        return pd.DataFrame(out, columns=["kind", "p", "chunk", "codes", "counts", "owners", "n"])

    def spread(batches):
        # named by partition and number, so that a task that runs again names its chunks alike
        pid, k, texts, ids, flags, held = TaskContext.get().partitionId(), 0, [], [], [], 0
        for pdf in batches:
            for i, h, t in zip(pdf["doc_id"], pdf["held_out"], pdf["text"]):
                texts.append(t)
                ids.append(i)
                flags.append(bool(h))
                held += len(t) if t else 0
                if held >= CHUNK:
                    yield local(f"{pid}-{k}", texts, ids, flags)
                    k, texts, ids, flags, held = k + 1, [], [], [], 0
        if texts:
            yield local(f"{pid}-{k}", texts, ids, flags)

    form = "kind string, p long, chunk string, codes binary, counts binary, owners binary, n int"

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf[pdf["kind"] == "w"]
        codes = np.frombuffer(table["codes"].iat[0], "<u8") if len(table) else np.empty(0, _U)
        counts = np.frombuffer(table["counts"].iat[0], "<i8") if len(table) else np.empty(0, np.int64)
        about = pdf[pdf["kind"] == "d"]
        out = [(c, a, None, None, None) for c, a in zip(about["chunk"], about["codes"])]
        asked = pdf[pdf["kind"] == "x"]
        for chunk, want, times, owners, n in zip(asked["chunk"], asked["codes"], asked["counts"], asked["owners"], asked["n"]):
            want, times, owners = np.frombuffer(want, "<u8"), np.frombuffer(times, "<u4"), np.frombuffer(owners, "<u4")
            c = np.zeros(len(want), np.int64)
            if len(codes):
                at = np.minimum(np.searchsorted(codes, want), len(codes) - 1)
                c = np.where(codes[at] == want, counts[at], 0)
            each = np.repeat(c, times)
            out.append((chunk, None, np.bincount(owners, np.log10((each + 0.1) / floor), minlength=n).tobytes(), np.bincount(owners, each > 0, minlength=n).astype("<i8").tobytes(), None))
        asked = pdf[pdf["kind"] == "y"]
        if len(asked):
            entries = dict(shared.value[3])
            for kind, codes, counts in zip(pdf["kind"], pdf["codes"], pdf["counts"]):
                if kind > "g1" and kind[0] == "g":
                    entries[int(kind[1:])] = np.frombuffer(codes, "<u8"), np.frombuffer(counts, "<i8")
            table = Counts(order, entries)
            for chunk, want, times, owners, n in zip(asked["chunk"], asked["codes"], asked["counts"], asked["owners"], asked["n"]):
                logs = np.repeat(table.logs(np.frombuffer(want, "<u8")), np.frombuffer(times, "<u4"))
                out.append((chunk, None, None, None, np.bincount(np.frombuffer(owners, "<u4"), logs, minlength=n).tobytes()))
        return pd.DataFrame(out, columns=["chunk", "about", "base", "known", "score"])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, held, tokens, known, base, scores = json.loads(pdf["about"].dropna().iat[0])
        base, known, scores = np.array(base), np.array(known), np.array(scores)
        for b, k in zip(pdf["base"].dropna(), pdf["known"].dropna()):
            base, known = base + np.frombuffer(b, "<f8"), known + np.frombuffer(k, "<i8")
        for more in pdf["score"].dropna():
            scores = scores + np.frombuffer(more, "<f8")
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "held_out": held, "n_tokens": tokens, "n_known": known, "train_tokens": n_train, "base_score": base, "score": scores})

    asked = rows.mapInPandas(spread, form)
    table = counted.where("kind <> 'g1'").select("kind", "p", F.lit(None).cast("string").alias("chunk"), "codes", "counts", F.lit(None).cast("binary").alias("owners"), F.lit(0).alias("n"))
    met = asked.unionByName(table).groupBy("p").applyInPandas(meet, "chunk string, about binary, base binary, known binary, score binary")
    out = met.groupBy("chunk").applyInPandas(finish, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
