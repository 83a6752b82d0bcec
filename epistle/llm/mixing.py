"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to (their pattern). Each pattern can
give its words once at no cost and again at a cost that rises with every repetition; each
source takes up to its quota. The flow of least cost says how many words each pattern gives;
whole repetitions go to all its documents, the rest to documents in a seeded order.
"""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_prefix, stage, word_count

#: Patterns up to which their sums are broadcast to the documents; beyond, they are joined by shuffling.
BROADCAST_PATTERNS = 100_000


def water_fill(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Targets in proportion to weights that add up to total; none exceeds `most` times its
    source's size, and what that cuts off is shared again by weight."""
    order = sorted((s for s in sizes if weights[s] > 0), key=lambda s: (most * sizes[s] / weights[s], s is None, s or ""))
    left, weight, targets = float(total), float(sum(weights[s] for s in order)), dict.fromkeys(sizes, 0.0)
    for k, s in enumerate(order):
        if weights[s] * left / weight <= most * sizes[s]:
            targets |= {x: weights[x] * left / weight for x in order[k:]}
            break
        targets[s] = float(most * sizes[s])
        left, weight = left - targets[s], weight - weights[s]
    return targets


def min_cost_flow(supply: dict, quota: dict, tiers: Iterable[float]) -> dict:
    """Words each (pattern, source) edge carries. supply: pattern (tuple of sources) -> words;
    quota: source -> words (integers); tiers: cost of the 1st, 2nd, ... repetition, rising.

    Successive shortest paths. Costs lie on a pattern's repetitions alone, so the cheapest path
    starts at the cheapest pattern from which a source with quota left can be reached,
    over reversed edges if need be. One augmentation fills a tier or a quota or empties an edge: the
    work depends on patterns and sources only, never on documents."""
    costs = list(tiers)
    flow = {(p, s): 0 for p in supply for s in p}
    used, filled = dict.fromkeys(supply, 0), dict.fromkeys(quota, 0)
    members: dict = {}
    for p in supply:
        for s in p:
            members.setdefault(s, []).append(p)

    def path_from(starts):
        came_p, came_s, todo = dict.fromkeys(starts), {}, deque(starts)
        while todo:
            p = todo.popleft()
            for s in p:
                if s in came_s:
                    continue
                came_s[s] = p
                if filled[s] < quota[s]:
                    steps = []
                    while s is not _NONE:
                        p = came_s[s]
                        steps.append((p, s, 1))
                        s = _NONE if came_p[p] is None else came_p[p][0]
                        if s is not _NONE:
                            steps.append((p, s, -1))
                    return steps
                for x in members[s]:
                    if flow[x, s] > 0 and x not in came_p:
                        came_p[x] = (s,)
                        todo.append(x)
        return None

    while True:
        open_ = {p: used[p] // w for p, w in supply.items() if w and used[p] < w * len(costs)}
        for tier in sorted(set(open_.values())):
            if steps := path_from([p for p, k in open_.items() if k == tier]):
                break
        else:
            return flow
        goal, start = steps[0][1], steps[-1][0]
        amount = min([quota[goal] - filled[goal], supply[start] * (tier + 1) - used[start], *(flow[x, y] for x, y, d in steps if d < 0)])
        for x, y, d in steps:
            flow[x, y] += d * amount
        used[start] += amount
        filled[goal] += amount


#: Ends a path; None may be the name of a source.
_NONE = object()


def seeded(seed: str, text: str = "text") -> Column:
    """The seeded order of documents: MD5 of seed, doc_id and text, in hexadecimal. Only repeated rows share one."""
    parts = [F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", text))]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def mix(docs: DataFrame, *, weights: dict | None = None, cycle: tuple = (5, 2, 1), share: float = 1.5, most: int = 2,
        sources: str = "source", text: str = "text", seed: str = "mix") -> DataFrame:
    """Every document with size (words), source_size and target (of its first source), taken
    (words that the mix takes, repetitions counted) and copies (the whole copies nearest to that).

    sources: a column with a source (string) or with all sources of a document (array of
    strings). weights: source -> weight; by default the sources by code point, null last,
    weigh `cycle`, repeating. Targets add up to share * all words and stop at `most` times a
    source's words. The document at which a quota ends is taken in part, so that
    every quota is met exactly wherever the flow can; no document is taken more than `most` times.

    Null and empty texts have size 0 and are never taken. Null sources are a source, null doc_id is as good as any:
    rows are told apart by doc_id and text. A repeated row
    counts anew and is treated as its twin is (what is left for twins is shared evenly, rounded down). An empty table gives no rows. Columns of
    the input are kept; where one is named like a result, the result replaces it. The driver
    keeps sums by pattern and source, not documents.
    """
    spark = docs.sparkSession
    many = docs.schema[sources].dataType.typeName() == "array"
    listed = F.array_sort(F.array_distinct(F.coalesce(F.col(sources), F.array(F.lit(None).cast("string"))))) if many else F.array(F.col(sources).cast("string"))
    own = own_prefix(docs)
    pattern_of, order_of = own + "pattern", own + "order"
    sized = docs.withColumns({pattern_of: F.to_json(listed), "size": word_count(F.col(text)), order_of: seeded(seed, text)})
    slim = stage(sized.select(F.col(pattern_of).alias("pattern"), "size", F.col(order_of).alias("order")), "mixing-sizes")
    found = slim.groupBy("pattern").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect()
    sums = [(r["pattern"], tuple(json.loads(r["pattern"])), r["w"], r["n"]) for r in found]
    source_size: dict = {}
    for _, pattern, words, _ in sums:
        for s in pattern:
            source_size[s] = source_size.get(s, 0) + words
    names = sorted(source_size, key=lambda s: (s is None, s or ""))
    weights = weights or {s: cycle[k % len(cycle)] for k, s in enumerate(names)}
    targets = water_fill(source_size, {s: weights.get(s, 0) for s in names}, share * sum(w for _, _, w, _ in sums), most)
    flow = min_cost_flow({p: w for _, p, w, _ in sums}, {s: int(t + 0.5) for s, t in targets.items()}, [k * k for k in range(most)])
    rows = []
    for key, p, w, n in sums:
        rounds, rest = divmod(sum(flow[p, s] for s in p), w) if w else (0, 0)
        rows.append((key, rounds, rest, source_size[p[0]], float(targets[p[0]]), math.isqrt(n) + 1))
    plan = spark.createDataFrame(rows, "pattern string, rounds long, rest long, source_size long, target double, buckets long")
    # one row a pattern, here and in what is cut from it below
    near = F.broadcast if len(rows) <= BROADCAST_PATTERNS else lambda df: df
    plan = near(plan)

    # The seeded order is cut where a pattern's rest ends: first among about sqrt(n) buckets by
    # their sums, then among the about sqrt(n) documents of one bucket.
    place = F.conv(F.substring("order", 1, 12), 16, 10).cast("double") / float(1 << 48)
    dealt = slim.join(plan, "pattern").where("rest > 0").withColumn("bucket", (place * F.col("buckets")).cast("long"))
    sizes = dealt.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    edge = _ends(sizes, "bucket").select("pattern", "bucket", F.col("before").alias("skipped"))
    close = dealt.join(near(edge), ["pattern", "bucket"]).groupBy("pattern", "order").agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("twins"), F.first(F.col("rest") - F.col("skipped")).alias("rest"))
    part = F.floor((F.col("rest") - F.col("before")) / F.col("twins"))
    cut = _ends(close, "order").select("pattern", F.struct(F.col("order"), part.alias("part")).alias("edge"))
    cut = near(plan.join(near(cut), "pattern", "left").select(F.col("pattern").alias(pattern_of), F.struct("rounds", "source_size", "target", "edge").alias(own)))

    mine = lambda name: F.col(f"{own}.{name}")
    extra = F.when(F.col(order_of) < mine("edge.order"), F.col("size")).when(F.col(order_of) == mine("edge.order"), mine("edge.part")).otherwise(0)
    taken = sized.join(cut, pattern_of).withColumns({"source_size": mine("source_size"), "target": mine("target"), "taken": mine("rounds") * F.col("size") + extra})
    copies = mine("rounds") + F.when(F.col("size") > 0, F.round(extra / F.col("size"))).otherwise(0)
    return taken.withColumn("copies", copies.cast("int")).drop(own, pattern_of, order_of)


def _ends(sums: DataFrame, order: str) -> DataFrame:
    """Of each pattern, the row at which the running sum of words reaches rest, with what is before it."""
    upto = F.sum("words").over(Window.partitionBy("pattern").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words")).where("before < rest AND upto >= rest")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: whole documents, each as often as it has copies, with the input's columns. Nulls, repeats
    and empty tables as in `mix`."""
    times = own_prefix(docs)
    mixed = mix(docs, **options)
    return mixed.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*docs.columns)
