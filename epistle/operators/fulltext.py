"""Full-text search: token tables, MATCH, BM25, relevance, snippets, tag phrases."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epistle.functions.sqlsem import fold_text, tokens
from epistle.plans import fts_query as Q

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMNS = ("subject", "body_text")


def postings(messages: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """term, id, col, positions: the inverted index. Positions of a text are gathered from one row,
    so the aggregate combines before it shuffles."""
    each = [messages.select("id", F.lit(c).alias("col"), F.posexplode(tokens(F.col(c))).alias("pos", "term")) for c in columns]
    rows = each[0]
    for more in each[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("term", "id", "col").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def document_lengths(messages: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """id and the number of tokens of each column and of all."""
    sized = messages.select("id", *[F.size(tokens(F.col(c))).alias(f"len_{c}") for c in columns])
    return sized.withColumn("length", sum((F.col(f"len_{c}") for c in columns[1:]), F.col(f"len_{columns[0]}")))


def term_statistics(messages: DataFrame, column: str = "body_text") -> DataFrame:
    """term, documents it occurs in, occurrences."""
    words = messages.select("id", F.explode(tokens(F.col(column))).alias("term"))
    return words.groupBy("term", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_occurrences"))


def idf(n_docs: Column, with_phrase: Column) -> Column:
    return F.greatest(F.log((n_docs - with_phrase + 0.5) / (with_phrase + 0.5)), F.lit(LEAST_IDF))


def _tally(found: list, groups: list, column: str, words: Column, length: Column | None = None) -> Column:
    """len, f0, f1, ... (places of each phrase) and g0, ... (whether each NEAR group holds) of the tokens of a column."""

    # bound in a lambda, so that the tokens are made once wherever the optimizer puts this
    def about(w):
        counts = [(F.size(Q.places(p, w)) if Q.found_in(p, column) else F.lit(0)).alias(f"f{k}") for k, p in enumerate(found)]
        near = [(Q.near(g, w) if all(Q.found_in(p, column) for p in g.phrases) else F.lit(False)).alias(f"g{k}") for k, g in enumerate(groups)]
        return F.struct((F.size(w) if length is None else length).alias("len"), *counts, *near)

    return F.get(F.transform(F.array(words), about), F.lit(0))


def _ranked(tree, found: list, groups: list, counted: DataFrame, keep: tuple[str, ...], n: Column, average: Column) -> DataFrame:
    """id, keep and rank of the rows of `counted` (id, keep, _len, _f0, ..., _g0, ...; _n, _avg, _d0, ...) that match."""
    counts, near = {p: F.col(f"_f{k}") for k, p in enumerate(found)}, {g: F.col(f"_g{k}") for k, g in enumerate(groups)}
    score = F.lit(0.0)
    for k in range(len(found)):
        f = F.col(f"_f{k}").cast("double")
        score = score + idf(n, F.col(f"_d{k}")) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / average))
    return counted.where(Q.matches(tree, counts, near)).select("id", *keep, (-score).alias("rank"))


def search(messages: DataFrame, query: str, columns: tuple[str, ...] = COLUMNS, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, rank (BM25, negative, less is better) and `keep` columns of the messages that match, for tables without an index.

    Two scans: one counts each phrase where it stands, one aggregates corpus size, mean length and document
    frequencies. Statistics cover all messages given, so filter afterwards."""
    tree = Q.parse(query, columns)
    found, groups = list(dict.fromkeys(Q.phrases(tree))), list(dict.fromkeys(Q.nears(tree)))
    held = messages.select("id", *keep, *[_tally(found, groups, c, tokens(F.col(c))).alias(f"_t_{c}") for c in columns])
    total = lambda name: sum((F.col(f"_t_{c}.{name}") for c in columns[1:]), F.col(f"_t_{columns[0]}.{name}"))
    some = lambda name: reduce(lambda a, b: a | b, [F.col(f"_t_{c}.{name}") for c in columns])
    counted = held.select("id", *keep, total("len").alias("_len"), *[total(f"f{k}").alias(f"_f{k}") for k in range(len(found))], *[some(f"g{k}").alias(f"_g{k}") for k in range(len(groups))])
    stats = counted.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("_len").alias("_avg"), *[F.sum((F.col(f"_f{k}") > 0).cast("long")).cast("double").alias(f"_d{k}") for k in range(len(found))])
    return _ranked(tree, found, groups, counted.crossJoin(F.broadcast(stats)), keep, F.col("_n"), F.col("_avg"))  # stats: one row


def search_index(index: DataFrame, lengths: DataFrame, query: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """id and rank of the messages that match, the whole query language from a stored index: only the postings of the
    query's terms and prefixes are read, and the lengths.

    From a column's postings a sketch of its tokens is drawn: the query's tokens in order, gaps between
    them no longer than any phrase or NEAR group can span. Phrases are counted in the sketch as in a text."""
    tree = Q.parse(query, columns)
    found, groups = list(dict.fromkeys(Q.phrases(tree))), list(dict.fromkeys(Q.nears(tree)))
    whole = sorted({t for p in found for t in (p.tokens[:-1] if p.prefix else p.tokens)})
    begun = sorted({p.tokens[-1] for p in found if p.prefix and p.tokens})
    wanted = reduce(lambda a, b: a | b, [F.col("term").isin(whole), *(F.col("term").startswith(t) for t in begun)])
    reach = max([2, *(len(p.tokens) + 1 for p in found), *(g.distance + sum(len(p.tokens) for p in g.phrases) + 1 for g in groups)])
    placed = F.collect_list(F.transform("positions", lambda i: F.struct(i.alias("i"), F.col("term").alias("term"))))
    marks = index.where(wanted & F.col("col").isin(*columns)).groupBy("id", "col").agg(F.array_sort(F.flatten(placed)).alias("at"))

    def drawn(at):
        before = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(at, k - 1).i)
        return F.flatten(F.transform(at, lambda m, k: F.concat(F.array_repeat(F.lit(""), F.least(m.i - before(k) - 1, F.lit(reach))), F.array(m.term))))

    sketch = F.get(F.transform(F.array(F.col("at")), drawn), F.lit(0))
    told = None
    for c in columns:
        told = F.when(F.col("col") == c, _tally(found, groups, c, sketch, F.lit(0))) if told is None else told.when(F.col("col") == c, _tally(found, groups, c, sketch, F.lit(0)))
    each = marks.select("id", told.alias("t"))
    counted = each.groupBy("id").agg(*[F.sum(f"t.f{k}").alias(f"_f{k}") for k in range(len(found))], *[F.max(f"t.g{k}").alias(f"_g{k}") for k in range(len(groups))], F.count(F.lit(1)).alias("_columns"))
    frequencies = counted.agg(F.lit(1).alias("_one"), *[F.coalesce(F.sum((F.col(f"_f{k}") > 0).cast("long")), F.lit(0)).cast("double").alias(f"_d{k}") for k in range(len(found))])
    stats = lengths.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg("length").alias("_avg"))
    known = counted.join(lengths.select("id", F.col("length").alias("_len")), "id").crossJoin(F.broadcast(frequencies)).crossJoin(F.broadcast(stats))  # one row each
    return _ranked(tree, found, groups, known, (), F.col("_n"), F.col("_avg"))


def search_postings(index: DataFrame, lengths: DataFrame, terms: list[str]) -> DataFrame:
    """id and rank of messages holding all terms, from a stored index: only the terms' postings are read."""
    wanted = [fold_text(t) for t in dict.fromkeys(terms)]
    hits = index.where(F.col("term").isin(wanted)).groupBy("id", "term").agg(F.sum(F.size("positions")).alias("f"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("d"))
    stats = lengths.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("length").alias("avg"))
    f = F.col("f").cast("double")
    scored = hits.join(F.broadcast(df), "term").join(lengths.select("id", "length"), "id").crossJoin(F.broadcast(stats))  # one row a term; one row
    part = idf(F.col("n"), F.col("d")) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("avg")))
    return scored.groupBy("id").agg((-F.sum(part)).alias("rank"), F.count(F.lit(1)).alias("_terms")).where(F.col("_terms") == len(wanted)).drop("_terms")


def relevance(page: DataFrame, rank: str = "rank") -> DataFrame:
    """Adds relevance: ranks of a page scaled to 1 (best) .. 0; all equal: 1. For pages, not for tables: one window."""
    over = Window.partitionBy()
    low, high = F.min(rank).over(over), F.max(rank).over(over)
    return page.withColumn("relevance", F.when(high == low, 1.0).otherwise(F.round(1 - (F.col(rank) - low) / (high - low), 4)))


def _best_window(words: list[tuple[int, int]], hits: set[int], n: int) -> int:
    """First token of the n-token window with most hits, the earliest of equals."""
    if len(words) <= n:
        return 0
    starts = sorted({max(0, min(h, len(words) - n)) for h in hits} | {max(0, min(h - n // 2, len(words) - n)) for h in hits} | {0})
    return max(starts, key=lambda s: (sum(s <= h < s + n for h in hits), -s))


def snippet_of(text: str | None, tree, n: int = 32, column: str = "body_text") -> str:
    """The n tokens of a text that hold most hits, hits in <mark>, ... at cut ends, at most 500 characters."""
    import re

    text = text or ""
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    words = [fold_text(text[a:b]) for a, b in spans]
    hits: set[int] = set()
    for p in Q.phrases(tree):
        if not p.tokens or p.columns is not None and column not in p.columns:
            continue
        k = len(p.tokens)
        for i in range(len(words) - k + 1):
            same = all(words[i + j] == t or p.prefix and j == k - 1 and words[i + j].startswith(t) for j, t in enumerate(p.tokens))
            if same and not (p.first and i):
                hits |= set(range(i, i + k))
    first = _best_window(spans, hits, n)
    last = min(first + n, len(spans))
    out, at = ["..." if first else ""], spans[first][0] if first and spans else 0
    for i in range(first, last):
        a, b = spans[i]
        begin, end = i in hits and i - 1 not in hits or i in hits and i == first, i in hits and (i + 1 not in hits or i == last - 1)
        out.append(text[at:a] + ("<mark>" if begin else "") + text[a:b] + ("</mark>" if end else ""))
        at = b
    out.append("..." if last < len(spans) else text[at:])
    return "".join(out)[:500]


def snippets(page: DataFrame, query: str, n: int = 32, column: str = "body_text") -> DataFrame:
    """Adds snippet to the rows of a page."""
    tree = Q.parse(query)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet_of(t, tree, n, column)).astype(object)

    return page.withColumn("snippet", cut(F.col(column)))


def tag_phrase(tags: Column, name: str) -> Column:
    """Whether a tag holds the tokens of `name` side by side: "Alpha" is found in "Alpha Two", not in "AlphaX"."""
    wanted = tuple(Q._PIECES.findall(fold_text(name)))
    if not wanted:
        return F.lit(False)
    found = F.transform(F.transform(tags, tokens), lambda w: F.size(Q.places(Q.Phrase(wanted), w)) > 0)
    return F.coalesce(F.exists(found, lambda x: x), F.lit(False))
