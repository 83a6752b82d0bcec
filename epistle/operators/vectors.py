"""Vector search: exact cosine k-nearest neighbours, encoders, upserts, rank fusion."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epistle.functions.sqlsem import fold_text
from epistle.schema import QUOTED


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def encode_text(text: str, dims: int = 384) -> list[float]:
    """A deterministic stand-in for a sentence encoder: hashed words, unit length. It knows spelling, not meaning."""
    out = np.zeros(dims)
    for word in fold_text(text).split():
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        out[h % dims] += 1 if h >> 63 else -1
    return (out / max(np.linalg.norm(out), 1e-12)).astype(np.float32).tolist()


def embed(messages: DataFrame, text: Column, dims: int = 384, encoder=encode_text) -> DataFrame:
    """Adds embedding where it is null; `encoder` maps a text to `dims` numbers."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: encoder(t or "", dims))

    return messages.withColumn("embedding", F.when(F.col("embedding").isNotNull(), F.col("embedding")).otherwise(run(text)))


def check_dimension(c: Column, dims: int) -> Column:
    """The vector; fails where its size is not dims."""
    return F.when(c.isNull() | (F.size(c) == dims), c).otherwise(F.raise_error(F.format_string(f"expected {dims} components, got %d", F.size(c))).cast("array<float>"))


def vector_table(messages: DataFrame) -> DataFrame:
    """The index row of every embedded message, with the columns that searches filter on beside the vector."""
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("is_outbound", "has_attachments")]
    searchable = F.coalesce(F.col("source") != QUOTED, F.lit(True)).alias("searchable")
    return messages.where("embedding IS NOT NULL").select("id", "embedding", norm(F.col("embedding")).alias("norm"), searchable, "ts_raw", "from_address", *flags)


def upsert(stored: DataFrame, new: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """stored with rows of `new` in place of those of the same key. Of several new rows the last by `version`
    (or any) wins."""
    if version:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_n = 1").drop("_n")
    else:
        new = new.dropDuplicates([key])
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def prefilter(date_from=None, date_to=None, from_address=None, is_outbound=None, has_attachments=None, searchable: bool = True) -> Column:
    """What a search may require of a vector row before neighbours are ranked."""
    out = F.col("searchable") if searchable else F.lit(True)
    for value, make in ((date_from, lambda v: F.col("ts_raw") >= v), (date_to, lambda v: F.col("ts_raw") <= v), (from_address, lambda v: F.col("from_address") == v),
                        (is_outbound, lambda v: F.col("is_outbound") == v), (has_attachments, lambda v: F.col("has_attachments") == v)):
        if value is not None:
            out = out & make(value)
    return out


def knn(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """id and distance of the k rows nearest to a vector, nearest first, ties by id: a filtered scan and a top-k."""
    rows = vectors if where is None else vectors.where(where)
    point = F.array(*[F.lit(float(x)) for x in query])
    return rows.select("id", cosine_distance(F.col("embedding"), point).alias("distance")).orderBy("distance", "id").limit(k)


def knn_matrix(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """As knn, with one matrix product a batch in place of expressions."""
    rows = vectors if where is None else vectors.where(where)
    q = np.asarray(query, float)
    q = q / np.linalg.norm(q)

    @F.pandas_udf("double")
    def distance(embedding: pd.Series) -> pd.Series:
        x = np.stack(embedding.to_numpy()).astype(float)
        return pd.Series(1 - x @ q / np.linalg.norm(x, axis=1))

    return rows.select("id", distance("embedding").alias("distance")).orderBy("distance", "id").limit(k)


def similar_to(vectors: DataFrame, seed_id, k: int, where: Column | None = None) -> DataFrame:
    """The k rows nearest to a stored vector, itself excluded; none if it has no vector."""
    seed = vectors.where(F.col("id") == F.lit(seed_id)).select(F.col("embedding").alias("_seed")).limit(1)
    rows = (vectors if where is None else vectors.where(where)).where(F.col("id") != F.lit(seed_id))
    near = rows.crossJoin(F.broadcast(seed))  # one row
    return near.select("id", cosine_distance(F.col("embedding"), F.col("_seed")).alias("distance")).orderBy("distance", "id").limit(k)


VECTOR_WEIGHT, TEXT_WEIGHT, DAMPING, POOL = 0.6, 0.4, 60, 50


def fuse(by_vector: DataFrame, by_text: DataFrame, limit: int) -> DataFrame:
    """Reciprocal rank fusion of two pools (id, distance) and (id, rank): id, score, method, best first.

    Pools are pages, so ranking them takes one small window each."""
    pool = max(limit, POOL)
    v = by_vector.orderBy("distance", "id").limit(pool).withColumn("vr", F.row_number().over(Window.orderBy(F.round("distance", 9), "id")) - 1)
    t = by_text.orderBy("rank", "id").limit(pool).withColumn("tr", F.row_number().over(Window.orderBy(F.round("rank", 9), "id")) - 1)
    both = v.select("id", "vr").join(t.select("id", "tr"), "id", "full_outer")
    part = lambda weight, c: F.coalesce(F.lit(float(weight)) / (DAMPING + F.col(c) + 1), F.lit(0.0))
    method = F.when(F.col("tr").isNull(), "vector").when(F.col("vr").isNull(), "fts").otherwise("both")
    scored = both.select("id", (part(VECTOR_WEIGHT, "vr") + part(TEXT_WEIGHT, "tr")).alias("_score"), method.alias("method"))
    return scored.orderBy(F.desc("_score"), "id").limit(limit).select("id", F.round("_score", 6).alias("score"), "method")


#: Rows of a block of a large group; rows of all small groups of a task; rows compared with a block at a time.
BLOCK, POOLED, STRIP = 4096, 20_000, 256


class Vectors:
    """Some rows' vectors: exact lengths, summed in the order of components, and unit vectors of single precision. Rows
    without a direction (zero, not finite) have none: they are candidates of every pair."""

    def __init__(self, x: np.ndarray):
        self.by_component = np.ascontiguousarray(x.T, dtype=float)
        squares = np.zeros(len(x))
        for c in self.by_component:
            squares += c * c
        self.length = np.sqrt(squares)
        self.unit = (self.by_component / self.length).T.astype(np.float32)
        self.unit[~np.isfinite(self.length) | (self.length == 0)] = np.nan

    def cosine(self, i: np.ndarray, other: Vectors, j: np.ndarray) -> np.ndarray:
        """Exact to the last bit of a sum over components; NaN where a row has no direction."""
        out = np.zeros(len(i))
        for x, y in zip(self.by_component, other.by_component):
            out += x[i] * y[j]
        return np.clip(out / (self.length[i] * other.length[j]), -1, 1)


def _pairs_of(x: Vectors, y: Vectors, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and cosines of pairs, strip by strip: of rows of x with rows of y, or of x alone if y is x. A matrix product of unit
    vectors chooses candidates, by a margin beyond its rounding; their exact cosine decides."""
    bound = least - 1.2e-7 * (x.unit.shape[1] + 4)
    for at in range(0, len(x.unit), STRIP):
        start = at + 1 if x is y else 0
        hit = ~(x.unit[at : at + STRIP] @ y.unit[start:].T < bound)
        if x is y:
            hit = np.triu(hit)
        i, j = np.nonzero(hit)
        i, j = i + at, j + start
        cosine = x.cosine(i, y, j)
        keep = ~(cosine < least)  # NaN counts as large, as in SQL
        if keep.any():
            yield i[keep], j[keep], cosine[keep]


def near_pairs(vectors: DataFrame, group: str, least: float = 0.98) -> DataFrame:
    """All pairs of one group (id1 < id2) whose cosine is at least `least`: group, id1, id2, similarity. A group of more than `BLOCK`
    rows is cut into blocks by a hash, and each pair of blocks is one piece of work; small groups share tasks. Every pair is
    compared, so the work grows with the square of a group. As in SQL, a pair with a vector that has no direction has similarity NaN, which
    is at least anything. Rows without id, group or vector, and vectors with a null component or none, are in no pair,
    nor are vectors of different sizes."""
    kind = {f.name: f.dataType for f in vectors.schema.fields}
    rows = vectors.select(F.col(group).alias("_group"), F.col("id").alias("_id"), F.col("embedding").alias("_vector"))
    rows = rows.where("_group IS NOT NULL AND _id IS NOT NULL AND size(_vector) > 0").where(~F.exists("_vector", lambda v: v.isNull()))
    if kind["embedding"].elementType.typeName() != "float":
        rows = rows.withColumn("_vector", F.col("_vector").cast("array<double>"))
    rows = rows.withColumn("_size", F.size("_vector")).withColumn("_hash", F.xxhash64("_group", "_size"))
    counts = rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    pools = 1 + (counts.where(F.col("_n") <= BLOCK).agg(F.sum("_n")).first()[0] or 0) // POOLED
    large = counts.where(F.col("_n") > BLOCK)  # at most one for BLOCK rows
    dealt = rows.join(F.broadcast(large), "_hash", "left").withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int"))
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("_id", "_vector"), F.col("_blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda k: F.struct(F.col("_hash").alias("p"), F.least("_block", k).alias("i"), F.greatest("_block", k).alias("j")))
    alone = F.array(F.struct(F.pmod("_hash", F.lit(pools)).alias("p"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    dealt = dealt.withColumn("_work", F.explode(F.when(F.col("_blocks").isNull(), alone).otherwise(meets)))
    dealt = dealt.select(F.col("_work.p").alias("_p"), F.col("_work.i").alias("_i"), F.col("_work.j").alias("_j"), "_block", "_hash", "_size", "_group", "_id", "_vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        code, size, block = (table[c].to_numpy(zero_copy_only=False) for c in ("_hash", "_size", "_block"))
        flat = table["_vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        at = np.cumsum(size) - size
        i, j = table["_i"][0].as_py(), table["_j"][0].as_py()
        order = np.lexsort((size, code))
        ends = np.flatnonzero(np.append((np.diff(code[order]) != 0) | (np.diff(size[order]) != 0), True)) + 1
        with np.errstate(all="ignore"):
            for start, end in zip(np.append(0, ends[:-1]), ends):
                own = order[start:end]
                sides = [own] if i == j else [own[block[own] == i], own[block[own] == j]]
                sides = [(side, Vectors(flat[at[side][:, None] + np.arange(size[own[0]])])) for side in sides]
                (x_rows, x), (y_rows, y) = sides[0], sides[-1]
                for a, b, cosine in _pairs_of(x, y, least):
                    a, b = pa.array(x_rows[a]), pa.array(y_rows[b])
                    found = [table["_group"].take(a), table["_group"].take(b), table["_id"].take(a), table["_id"].take(b), pa.chunked_array([cosine])]
                    yield from pa.table(found, ["g1", "g2", "a", "b", "similarity"]).to_batches()

    names = {"g1": kind[group], "g2": kind[group], "a": kind["id"], "b": kind["id"]}
    schema = ", ".join(f"{k} {t.simpleString()}" for k, t in names.items()) + ", similarity double"
    found = dealt.groupBy("_p", "_i", "_j").applyInArrow(run, schema).where("g1 = g2 AND a <> b")
    return found.select(F.col("g1").alias(group), F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), "similarity")
