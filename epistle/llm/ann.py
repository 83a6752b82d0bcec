"""Maximum-inner-product search with few projections, a kd-tree and a chi-square stopping test.

Vectors get one more component, so that all have the length of the longest and the largest inner product is the
least distance. Gaussian (2-stable) projections to M dimensions turn a distance d into a projected distance
whose square is d^2 times a chi-square variable with M degrees of freedom. A kd-tree over the projected vectors
yields neighbours of a query in order of projected distance; they are verified with the
true vectors until the test holds: a vector nearer than the k-th best found would, with
probability CONFIDENCE, have come up already.

The upper part of the tree, fitted on a bounded sample, deals all vectors to cells; each cell has a tree of
its own. A query first visits the cell it lies in, which bounds its k-th distance, and then
every other cell that the test does not rule out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Projected dimensions (even) and the probability of the stopping test.
M, CONFIDENCE = 8, 0.97
#: Vectors in a cell on average (more beyond MOST_CELLS cells), in a leaf, and to fit the upper tree on.
CELL, MOST_CELLS, LEAF, SAMPLE = 8192, 16_384, 256, 50_000


def chi_square_limit(p: float, m: int = M) -> float:
    """The p-quantile of the chi-square distribution with m (even) degrees of freedom."""
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return low


def median_splits(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A complete kd-tree of `depth` levels in heap order: dimension (the widest) and median of each node."""
    splits: list[tuple[int, float]] = []
    level = [points]
    for _ in range(depth):
        following = []
        for part in level:
            wide = int(np.ptp(part, axis=0).argmax()) if len(part) else 0
            cut = float(np.median(part[:, wide])) if len(part) else 0.0
            splits.append((wide, cut))
            right = part[:, wide] > cut
            following += [part[~right], part[right]]
        level = following
    return splits


def cell_of(points: np.ndarray, splits: list[tuple[int, float]], depth: int) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    if depth:
        wide, cut = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
        for _ in range(depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), wide[node]] > cut[node])
    return node - ((1 << depth) - 1)


def leaves(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Rows of the leaves of a kd-tree over points."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part = points[rows]
        wide = int(np.ptp(part, axis=0).argmax())
        order = np.argsort(part[:, wide], kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


class Space:
    """Augmentation and projection, the same everywhere."""

    def __init__(self, dims: int, longest: float, seed: int = 11):
        self.longest = longest
        self.planes = np.random.default_rng(seed).standard_normal((dims + 1, M))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", x, x), 0.0))
        return x @ self.planes[:-1] + more[:, None] * self.planes[-1]

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.planes[:-1]


def _search(space: Space, x: np.ndarray, flat: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int, limit: float):
    """For each query the k best rows of x, by leaves in order of projected distance, until the test holds.
    bounds: a squared distance within which k candidates are known already (inf: none); rows beyond it are left out."""
    groups = leaves(flat)
    low, high = np.stack([flat[g].min(axis=0) for g in groups]), np.stack([flat[g].max(axis=0) for g in groups])
    parts = [np.ascontiguousarray(x[g]) for g in groups]
    at = space.of_queries(queries)
    for q, y, bound in zip(queries, at, bounds):
        gap = np.maximum(np.maximum(low - y, y - high), 0.0)
        far = np.einsum("ij,ij->i", gap, gap)
        whole = float(q @ q) + space.longest**2
        # inner products below `least` can't be among the k best; a little slack for rounding
        least = (whole - bound) / 2 - 1e-9 * whole
        rows, inner, kth = np.empty(0, np.int64), np.empty(0), bound
        for g in np.argsort(far, kind="stable"):
            if far[g] > limit * kth:
                break
            found = parts[g] @ q
            better = np.flatnonzero(found >= least)
            if not len(better):
                continue
            rows, inner = np.append(rows, groups[g][better]), np.append(inner, found[better])
            if len(rows) > k:
                edge = np.partition(inner, -k)[-k]
                best = np.flatnonzero(inner >= edge)  # equal ones at the edge all stay: the smaller identifier decides later
                rows, inner = rows[best], inner[best]
            if len(rows) >= k:
                least = max(least, float(inner.min()))
                kth = min(kth, max(0.0, whole - 2 * least))
        yield rows


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def search(vectors: DataFrame, is_query: Column, *, k: int = 20, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where `is_query` holds the k rows of largest inner product found.

    Ties go to the smaller vec_id. Vectors null, zero or with null or non-finite components take no part,
    nor do those of another length than most; a row is not its own neighbour, but a repeated
    row (same vec_id) is none either. With k candidates or fewer, all are returned. Null vec_id takes no part. An
    empty table gives no rows; other columns are ignored. Of equal vectors the k + 1 smallest vec_id are kept,
    which are all that any query can need.
    """
    spark = vectors.sparkSession
    clean = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))
    sizes = clean.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest")).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], empty)
    main = max(sizes, key=lambda r: (r["n"], r["dims"]))
    dims, n = main["dims"], main["n"]
    clean = clean.where(F.size("v") == dims)
    space, limit = Space(dims, main["longest"]), chi_square_limit(confidence)
    depth = max(0, math.ceil(math.log2(max(1, min(n / CELL, MOST_CELLS)))))
    fraction = min(1.0, SAMPLE / n)
    picked = clean.where(F.abs(F.xxhash64("vec_id", F.lit(3)) % (1 << 30)) < int(fraction * (1 << 30)) + 1).select("v").toPandas()
    sample = space.of_rows(np.array(picked["v"].tolist())) if len(picked) else np.zeros((1, M))
    splits = median_splits(sample, depth)

    @F.pandas_udf("cell int, y array<double>")
    def place(v: pd.Series) -> pd.DataFrame:
        y = space.of_rows(np.array(v.tolist()).reshape(len(v), dims))
        return pd.DataFrame({"cell": cell_of(y, splits, depth), "y": list(y)})

    distinct = clean.select("vec_id", "v").distinct()
    ranked = distinct.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    groups = ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    index = stage(groups.withColumn("_at", place("v")).select("v", "ids", F.col("_at.cell").alias("cell"), F.col("_at.y").alias("y")), "ann-index")
    edges = [f(F.get("y", F.lit(i))).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(M)]
    boxes = index.groupBy("cell").agg(*edges).orderBy("cell").collect()  # at most 2 * MOST_CELLS rows
    cells = np.array([b["cell"] for b in boxes])
    low, high = (np.array([[b[f"{f}{i}"] for i in range(M)] for b in boxes]) for f in ("min", "max"))

    def gaps(q: np.ndarray) -> np.ndarray:
        y = space.of_queries(q)[:, None, :]
        gap = np.maximum(np.maximum(low - y, y - high), 0.0)
        return np.einsum("ijk,ijk->ij", gap, gap)

    @F.pandas_udf("int")
    def home(v: pd.Series) -> pd.Series:
        q = np.array(v.tolist()).reshape(len(v), dims)
        return pd.Series(np.concatenate([cells[gaps(q[a : a + 64]).argmin(axis=1)] for a in range(0, len(q), 64)]), dtype="int32") if len(q) else pd.Series([], dtype="int32")

    @F.pandas_udf("array<int>")
    def others(v: pd.Series, first: pd.Series, bound: pd.Series) -> pd.Series:
        q = np.array(v.tolist()).reshape(len(v), dims)
        out = []
        for a in range(0, len(q), 64):
            for g, f, b in zip(gaps(q[a : a + 64]), first[a : a + 64], bound[a : a + 64]):
                out.append(cells[(g <= limit * b) & (cells != f)].tolist())
        return pd.Series(out)

    def visit(asked: DataFrame) -> DataFrame:
        """asked: query_id, v, bound, cell -> query_id, found (array of vec_id and score), for each cell."""
        rows = index.select("cell", "v", "ids", "y", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("double").alias("bound"))
        both = rows.unionByName(asked.select("cell", "v", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<double>").alias("y"), "query_id", "bound"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            asks = pdf["query_id"].notna()
            have, want = pdf[~asks], pdf[asks]
            names = ["query_id", "vec_id", "score"]
            if not len(have) or not len(want):
                return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in zip(names, ("int64", "int64", "float64"))})
            x, flat, ids = np.array(have["v"].tolist()), np.array(have["y"].tolist()), have["ids"].tolist()
            queries, bounds = np.array(want["v"].tolist()), want["bound"].fillna(np.inf).to_numpy()
            out = []
            for qid, q, rows in zip(want["query_id"].astype("int64"), queries, _search(space, x, flat, queries, bounds, k + 1, limit)):
                exact = (x[rows] * q).sum(axis=1)
                found = sorted((-s, i) for r, s in zip(rows, exact.tolist()) for i in ids[r] if i != qid)[:k]
                out += [(qid, i, -s) for s, i in found]
            return pd.DataFrame(out, columns=names)

        return both.groupBy("cell").applyInPandas(run, "query_id long, vec_id long, score double")

    asked = clean.where("asks").select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id"]).withColumn("cell", home("v"))
    first = stage(visit(asked.withColumn("bound", F.lit(None).cast("double"))), "ann-first")
    length2 = F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)
    kth = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    bound = F.when(F.col("kth").isNotNull(), F.greatest(F.lit(0.0), length2 + F.lit(float(main["longest"]) ** 2) - 2 * F.col("kth"))).otherwise(F.lit(float("inf")))
    second = asked.join(kth, "query_id", "left").withColumn("bound", bound)
    second = second.withColumn("cell", F.explode(others("v", "cell", "bound")))
    found = first.unionByName(visit(second))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
