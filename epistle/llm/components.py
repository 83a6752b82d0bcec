"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, stage

#: Edges that a task holds before it contracts them, and rows of an Arrow batch of them.
HELD, BATCH = 400_000, 20_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges (a[k], b[k]) connect: from the least node of each group to each other one, so fewer
    than there are nodes."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[i], least[j])
        now = least.copy()
        for end in (least[i], least[j]):
            np.minimum.at(now, end, low)
        while (now[now] != now).any():
            now = now[now]
        if (now == least).all():
            break
        least = now
    other = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[least[other]], nodes[other]


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of edges (a[k], b[k]), fewer than there are nodes, that connect what all of them connect: of each group the first edge
    that leaves it, again and again (Boruvka)."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    group, taken, left = np.arange(len(nodes)), [], np.arange(len(a))
    while True:
        left = left[group[i[left]] != group[j[left]]]
        if not len(left):
            return np.sort(np.concatenate(taken)) if taken else left
        first = np.full(len(nodes), len(a))
        for end in (i, j):
            np.minimum.at(first, group[end[left]], left)
        own = np.flatnonzero(first < len(a))
        edge = first[own]
        taken.append(np.unique(edge))
        to = np.arange(len(nodes))
        to[own] = np.where(group[i[edge]] == own, group[j[edge]], group[i[edge]])
        both = own[(to[to[own]] == own) & (own < to[own])]  # two groups that chose one edge: the lesser stays
        to[both] = both
        while (to[to] != to).any():
            to = to[to]
        group = to[group]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges a, b with those of one task replaced by stars. A crowd that many links hold together comes down to an edge a node before
    anything is shuffled. A task holds at most HELD edges and a batch: stars that are too many go out as they are."""

    def run(batches):
        a = b = np.empty(0, np.int64)
        for pdf in batches:
            a, b = np.append(a, pdf["a"].to_numpy(np.int64)), np.append(b, pdf["b"].to_numpy(np.int64))
            if len(a) > HELD:
                a, b = stars(a, b)
                if len(a) > HELD // 2:
                    yield pd.DataFrame({"a": a, "b": b})
                    a = b = np.empty(0, np.int64)
        if len(a):
            a, b = stars(a, b)
            yield pd.DataFrame({"a": a, "b": b})

    return edges.mapInPandas(run, "a long, b long")


def _least(edges: DataFrame) -> DataFrame:
    """Of each node, the least of itself and its neighbours."""
    return edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of edges (a, b: long, in either order).

    Edges are contracted in each task first. A round replaces edges by edges to smaller nodes; no neighbourhood is ever gathered in one
    place, only minima are, so a node with very many edges costs a partial aggregate and a skew-split
    join. Rounds end when the edges no longer change, after about log(nodes) of them. Each
    round is written to the shared folder, which ends the lineage."""
    with arrow_rows(edges.sparkSession, BATCH):
        edges = stage(_contracted(edges.where("a <> b").select("a", "b")).distinct(), "components-edges")
    last = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: a node's larger neighbours go to the least it knows
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: a node's smaller neighbours, and the node, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
        edges = stage(small.where("a <> b").distinct(), "components-edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
