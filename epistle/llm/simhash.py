"""SimHash near-duplicates by the general pigeonhole principle.

The 64 bits of all distinct fingerprints are grouped into partitions of correlated bits. A
dynamic programme gives each partition a threshold t (-1: unused), so that the thresholds
add up to radius - partitions + 1 and the estimated cost is least: two fingerprints
within the radius then differ in at most t bits of some partition. How many pairs differ in how many bits of a partition
is estimated from the joint counts of all its pairs of bits, by the best tree of dependences. A partition with threshold
t is probed under every mask that leaves out t of its bits; fingerprints equal under a mask share
a bucket and are verified there. Buckets too large for one task are dealt anew on their remaining
bits, by the same principle, until none is.

Where masks are many, the fingerprints that the first of them link get the name of their group; under the other masks
only links between groups are emitted, of each task a spanning forest. A crowd of near copies, linked under nearly every
mask, thus costs a few edges a member.

A second word of 64 bits can be asked for as a check: far fewer pairs then agree by chance, so that a wide
radius stays sound however many documents there are.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, shuffle_width, stage, tune
from .components import HELD, components, forest
from .token_ids import in_pieces
from .words import WordBatch, scramble, xxh64

#: Fingerprints that a bucket of one task may hold; larger buckets are dealt anew, never cut.
BUCKET = 400_000
#: Rows a task meets in one pass over some of the masks, and in an Arrow batch of such narrow rows.
PASS_ROWS, NARROW_ROWS = 2_000_000, 20_000
#: A bucket of up to STEPS rows is compared row by following row together with others, a larger one by itself in blocks.
STEPS, BLOCK = 1024, 64
#: Masks probed before fingerprints are named by group; as many or fewer are probed at once.
FIRST = 8
#: Characters hashed at a time in a worker; a longer text is hashed by itself, whole.
PIECE = 300_000
#: What a probe costs, in comparisons.
PROBE = 400.0


def fingerprints(texts: list, shingle: int = 3, seed: int = 42, words: int = 1) -> np.ndarray:
    """64-bit SimHash of each text: lower-case A-Z, words, runs of `shingle` words with
    repeats (the whole sequence if shorter), XXH64; a bit is 1 if set in over half. With words=2 a row of two: the
    second is made alike of the hashes' scrambled values."""
    batch = WordBatch(texts, lower=True)
    counts, first = batch.counts, batch.bounds[:-1]
    spans = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    starts_at = np.cumsum(spans) - spans
    word = np.repeat(first - starts_at, spans) + np.arange(int(spans.sum()))
    last = word + np.repeat(np.minimum(counts, shingle), spans) - 1
    hashes = xxh64(batch.raw, batch.starts[word], batch.ends[last], seed)
    out = np.zeros((len(counts), words), np.uint64)
    rows = np.flatnonzero(spans)
    if len(rows):
        for w in range(words):
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, starts_at[rows], axis=0, dtype=np.int32)
            major = (2 * ones > spans[rows][:, None]).astype(np.uint8)
            out[rows, w] = np.packbits(major, axis=1, bitorder="little").view("<u8")[:, 0]
            hashes = scramble(hashes + np.uint64(w + 1))
    return out[:, 0] if words == 1 else out


def with_fingerprint(docs: DataFrame, shingle: int = 3, seed: int = 42, words: int = 1) -> DataFrame:
    """doc_id, key (xxhash64 of the text), fp (64 bits as a signed long) and more (the second word, or 0) of every
    document; no words: 0."""
    tune(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            found = [fingerprints(texts[piece], shingle, seed, words).reshape(-1, words) for piece in in_pieces(texts, PIECE)]
            fp = np.concatenate(found).view(np.int64) if found else np.empty((0, words), np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": pdf["key"], "fp": fp[:, 0], "more": fp[:, 1] if words > 1 else 0})

    wanted = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("key"))
    hashed = wanted.mapInPandas(run, "doc_id string, key long, fp long, more long")
    return hashed.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many each pair of bits is set (64 x 64)."""

    def run(batches):
        n, both = 0, np.zeros((64, 64))
        for pdf in batches:
            bits = np.unpackbits(pdf["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(bits)
            both += bits.T @ bits
        yield pd.DataFrame({"k": np.arange(64 * 64 + 1), "n": np.append(both.ravel().astype(np.int64), n)})

    rows = fps.mapInPandas(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(64 * 64 + 1)
    for r in rows:
        flat[r["k"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits 0-63 in groups of about equal size: a group starts with the free bit least like what is
    grouped and takes the free bit most correlated with its members, again and again."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    like = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, groups = set(range(64)), []
    for k in range(parts):
        size = 64 * (k + 1) // parts - 64 * k // parts
        group: list[int] = []
        while len(group) < size:
            score = (lambda b: like[b, group].sum()) if group else (lambda b: max(like[b, c] for c in free if c != b) if len(free) > 1 else 0)
            best = max(sorted(free), key=score)
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def distances(n: int, both: np.ndarray, group: list[int]) -> np.ndarray:
    """Probability that two fingerprints differ in 0, 1, ... bits of a group. Whether they agree in a bit depends on the
    bit next to it in the tree of the group's strongest dependences, as the joint counts of the two bits say."""
    n = max(n, 1)
    p = np.diag(both) / n
    joint = both / n
    # agree[i, j, a, b]: the pair of fingerprints agrees (1) or not (0) in bits i and j
    cells = joint, p[:, None] - joint, p[None] - joint, 1 - p[:, None] - p[None] + joint
    one = p * p + (1 - p) ** 2
    whole = np.clip(sum(np.clip(c, 0, 1) ** 2 for c in cells), 1e-12, 1)
    agree = np.empty((64, 64, 2, 2))
    agree[..., 1, 1] = whole
    agree[..., 1, 0] = np.clip(one[:, None] - whole, 1e-12, 1)
    agree[..., 0, 1] = np.clip(one[None] - whole, 1e-12, 1)
    agree[..., 0, 0] = np.clip(1 - one[:, None] - one[None] + whole, 1e-12, 1)
    alone = np.stack((1 - one, one), axis=1).clip(1e-12, 1)
    tie = (agree * np.log(agree / (alone[:, None, :, None] * alone[None, :, None, :]))).sum(axis=(2, 3))
    parent, order, rest = {group[0]: None}, [group[0]], set(group[1:])
    while rest:
        a, b = max(((a, b) for a in order for b in sorted(rest)), key=lambda e: tie[e])
        parent[b] = a
        order.append(b)
        rest.remove(b)
    below = {x: [np.array([0.0, 1.0]), np.array([1.0])] for x in order}  # by agreement of x: differing bits in its part of the tree
    for x in reversed(order[1:]):
        up = parent[x]
        for state in (0, 1):
            chance = agree[up, x, state] / agree[up, x, state].sum()
            mixed = np.zeros(max(map(len, below[x])))
            for own in (0, 1):
                mixed[: len(below[x][own])] += chance[own] * below[x][own]
            below[up][state] = np.convolve(below[up][state], mixed)
    top = below[group[0]]
    out = np.zeros(len(group) + 1)
    for state in (0, 1):
        out[: len(top[state])] += alone[group[0], state] * top[state]
    return out


def allocate(n: int, both: np.ndarray, radius: int, most_parts: int = 8, most_bits: int = 3) -> list[int]:
    """The masks to probe, by the cheapest of all partitionings and threshold allocations.

    A group with threshold t is probed under all masks that leave out t of its bits; a pair that differs in d of
    them meets under C(bits - d, t - d). A probe itself costs as much as PROBE of these comparisons."""
    probe, best = PROBE * n, (math.inf, [])
    for parts in range(1, most_parts + 1):
        groups = group_bits(n, both, parts)
        apart = [distances(n, both, group) for group in groups]

        def cost(k, t):
            if t < 0:
                return 0.0
            bits = len(groups[k])
            met = sum(apart[k][d] * math.comb(bits - d, t - d) for d in range(t + 1))
            return math.comb(bits, t) * probe + n * n / 2 * met

        goal = radius + 1
        table = {0: (0.0, [])}  # sum of (t + 1) so far -> cost, thresholds
        for k, group in enumerate(groups):
            grown: dict = {}
            for total, (spent, chosen) in table.items():
                for t in range(-1, min(most_bits + 1, len(group))):
                    if total + t + 1 <= goal:
                        offer = (spent + cost(k, t), [*chosen, t])
                        if total + t + 1 not in grown or offer < grown[total + t + 1]:
                            grown[total + t + 1] = offer
            table = grown
        if goal in table and table[goal][0] < best[0]:
            masks = [sum(1 << b for b in group) & ~sum(1 << b for b in out) for group, t in zip(groups, table[goal][1]) if t >= 0 for out in combinations(group, t)]
            best = (table[goal][0], masks)
    return best[1]


def split_mask(mask: int, parts: int) -> list[int]:
    """For a bucket that agrees under mask: the masks to deal it by, on its other bits."""
    rest = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in rest[k::parts]) for k in range(min(parts, max(1, len(rest))))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Near:
    """Which of two fingerprints (first words, second words) are linked: at most `radius` bits differ in the
    first, and at most `check` in both if a check is asked for."""

    def __init__(self, radius: int, check: int | None = None):
        self.radius, self.check = radius, check

    def pairs(self, fp, more, i, j) -> np.ndarray:
        """Which of the pairs of rows (i[k], j[k]) are linked."""
        apart = np.bitwise_count(fp[i] ^ fp[j])
        hit = np.flatnonzero(apart <= self.radius)
        if self.check is not None and len(hit):
            hit = hit[apart[hit] + np.bitwise_count(more[i[hit]] ^ more[j[hit]]) <= self.check]
        return hit

    def block(self, fp, more, rows, others) -> np.ndarray:
        """Which of rows are linked with which of others, as a matrix."""
        apart = np.bitwise_count(fp[rows][:, None] ^ fp[others])
        hit = apart <= self.radius
        if self.check is not None and hit.any():
            i, j = np.nonzero(hit)
            hit[i, j] = apart[i, j] + np.bitwise_count(more[rows[i]] ^ more[others[j]]) <= self.check
        return hit


def _blocks(fp, more, left, near, most):
    """Places (i, j) of all links among rows `left`, by blocks; None as soon as there are more than `most`, with a row that has many."""
    i_all, j_all, found = [], [], 0
    for at in range(0, len(left), BLOCK):
        rows, others = left[at : at + BLOCK], left[at:]
        hit = near.block(fp, more, rows, others)
        hit &= np.arange(len(others)) > np.arange(len(rows))[:, None]
        i, j = np.nonzero(hit)
        i_all.append(rows[i])
        j_all.append(others[j])
        found += len(i)
        if found > most:
            return None, rows[hit.sum(axis=1).argmax()]
    return (np.concatenate(i_all), np.concatenate(j_all)), None


def tree_links(fp: np.ndarray, more: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Links (places of rows) that connect what all links among distinct fingerprints connect. Where links are few, all of
    them. Where they are many, groups are taken out one by one: breadth first, each row linked to the one it was reached
    from, and no two rows of a group are compared once both are in it."""
    left, parents, children = np.arange(len(fp)), [], []
    while len(left) > 1:
        pairs, root = _blocks(fp, more, left, near, 4 * len(left))
        if pairs is not None:
            parents.append(pairs[0])
            children.append(pairs[1])
            break
        left, queue = left[left != root], [np.array([root])]
        while queue and len(left):
            waiting = queue.pop()
            for at in range(0, len(waiting), BLOCK):
                if not len(left):
                    break
                rows = waiting[at : at + BLOCK]
                hit = near.block(fp, more, rows, left)
                reached = hit.any(axis=0)
                if reached.any():
                    parents.append(rows[hit[:, reached].argmax(axis=0)])
                    children.append(left[reached])
                    queue.append(children[-1])
                    left = left[~reached]
    return (np.concatenate(parents), np.concatenate(children)) if parents else (left[:0], left[:0])


def _bucket_links(mask, value, fp, more, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Links (places of rows) of sorted rows, bucket by bucket: small buckets together, each row with the following ones of its bucket;
    large ones, and those with many links, by tree."""
    first = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])))
    sizes = np.diff(np.append(first, len(fp)))
    bucket = np.repeat(np.arange(len(first)), sizes)
    behind = np.repeat(first + sizes, sizes) - np.arange(len(fp))  # rows of the bucket from here on
    at = np.flatnonzero((behind > 1) & (sizes[bucket] <= STEPS))
    links_of, out_a, out_b, by_tree = np.zeros(len(first), np.int64), [], [], sizes > STEPS
    step = 1
    while len(at):
        hit = at[near.pairs(fp, more, at, at + step)]
        if len(hit):
            out_a.append(hit)
            out_b.append(hit + step)
            links_of += np.bincount(bucket[hit], minlength=len(first))
            crowded = (links_of > 8 * sizes) & ~by_tree
            if crowded.any():
                by_tree |= crowded
                at = at[~by_tree[bucket[at]]]
        step += 1
        at = at[behind[at] > step]
    for k in np.flatnonzero(by_tree):
        rows = slice(first[k], first[k] + sizes[k])
        a, b = tree_links(fp[rows], more[rows], near)
        out_a.append(first[k] + a)
        out_b.append(first[k] + b)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (first[:0], first[:0])


def links(fps: DataFrame, radius: int = 3, check: int | None = None) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (column fp; with a check also more) as all their links do: at most
    `radius` differing bits in fp, and at most `check` in fp and more. A task emits a spanning forest of what it finds."""
    before, _, after = _links(fps, radius, check)
    return reduce(DataFrame.unionByName, before + after)


def linked(fps: DataFrame, radius: int = 3, check: int | None = None) -> DataFrame:
    """node, component (its least node) of every fingerprint with links."""
    before, groups, after = _links(fps, radius, check)
    if groups is None:
        return components(reduce(DataFrame.unionByName, before))
    known = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
    return components(reduce(DataFrame.unionByName, after, known))


def _links(fps: DataFrame, radius: int, check: int | None) -> tuple[list[DataFrame], DataFrame | None, list[DataFrame]]:
    """Edges of the first masks, the components (node, component) that these make, and the edges of all other masks between those
    components; where masks are few, the edges of all of them and None. Masks are probed in passes of about `PASS_ROWS` rows a task,
    each written to the shared folder, so that memory does not grow with their number."""
    spark = fps.sparkSession
    if "more" not in fps.columns:
        fps = fps.withColumn("more", F.lit(0).cast("long"))
    n, both = bit_counts(fps)
    masks, parts = allocate(n, both, radius), radius + 1
    name_at = FIRST if len(masks) > FIRST else None
    if name_at:  # masks of all partitions come first
        apart = [k * len(masks) // FIRST for k in range(FIRST)]
        masks = [masks[k] for k in apart] + [m for k, m in enumerate(masks) if k not in apart]
    width = max(shuffle_width(spark), 1)
    edges, before, groups = [], [], None
    rows, count, dealt = fps.withColumn("crowd", F.col("fp")), n, {None: [_signed(m) for m in masks]}  # dealt: masks by the mask that rows have in common
    while dealt:
        crowds, found = [], {}
        each, most = max(1, width * PASS_ROWS // max(count, 1)), max(map(len, dealt.values()))
        starts = sorted({*range(0, most, each), *([name_at] if name_at and None in dealt else [])})
        for k, end in zip(starts, [*starts[1:], most]):
            if name_at == k and None in dealt:
                before, edges = edges, []
                groups = components(reduce(DataFrame.unionByName, before))
                named = rows.drop("crowd").join(groups.withColumnRenamed("node", "fp"), "fp", "left")
                rows = stage(named.select("fp", "more", F.coalesce("component", "fp").alias("crowd")), "simhash-crowds")
            now = {m: _array(to[k:end]) for m, to in dealt.items() if to[k:end]}
            if None in now:
                probes = now[None]
            else:
                probes = F.create_map([F.lit(x) for pair in now.items() for x in pair])[F.col("mask")]
            keyed = rows.select("fp", "more", "crowd", F.explode(probes).alias("mask"))
            with arrow_rows(spark, NARROW_ROWS):
                done = stage(_within_buckets(keyed, width, BUCKET, Near(radius, check)), "simhash-links")
            edges.append(done.where("mask IS NULL").select("a", "b"))
            crowded = done.where("mask IS NOT NULL").select(F.col("a").alias("fp"), F.col("b").alias("more"), "crowd", "mask")
            counts = crowded.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).collect()  # masks, a few hundred at most
            for r in counts:
                found[r["mask"]] = found.get(r["mask"], 0) + r["n"]
            if counts:
                crowds.append(crowded)
        dealt = {m: [_signed(x) for x in split_mask(m & (1 << 64) - 1, parts)] for m in found}
        count = sum(found.values())
        rows = reduce(DataFrame.unionByName, crowds) if crowds else None
    return (edges, None, []) if groups is None else (before, groups, edges)


def _within_buckets(keyed: DataFrame, width: int, limit: int, near: Near) -> DataFrame:
    """Of rows fp, more, mask, crowd: links a, b of the buckets of at most `limit` rows (mask null), and the rows of larger
    buckets as they came (a: fp, b: more, mask, crowd). A large bucket passes through in pieces and is never held. The links of a task
    connect the crowds that all of its links connect, without circles; those within a crowd are left out."""

    def run(batches):
        none = np.empty(0, np.int64)
        held, crowded = (none, none, none, none, none), None  # rows not given yet, whole buckets but the last; the large bucket that is passing

        pending = [none, none, none, none]  # links not given yet: both ends, both crowds

        def thin(a, b, x, y):
            chosen = forest(x, y)
            return [e[chosen] for e in (a, b, x, y)]

        def give(mask, value, fp, more, crowd):
            """Rows of whole buckets."""
            new = np.append(True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))
            sizes = np.diff(np.append(np.flatnonzero(new), len(fp)))
            big = np.repeat(sizes > limit, sizes)
            yield from hand_on(mask[big], fp[big], more[big], crowd[big])
            if not big.all():
                i, j = _bucket_links(*(x[~big].view(np.uint64) for x in (mask, value, fp, more)), near)
                fp, crowd = fp[~big], crowd[~big]
                pending[:] = (np.append(x, y) for x, y in zip(pending, thin(fp[i], fp[j], crowd[i], crowd[j])))
                if len(pending[0]) > HELD:
                    pending[:] = thin(*pending)
                    if len(pending[0]) > HELD // 2:
                        yield from give_links()

        def give_links():
            a, b = pending[:2]
            if len(a):
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "mask": pd.array([None] * len(a), "Int64"), "crowd": 0})
            pending[:] = none, none, none, none

        def hand_on(mask, fp, more, crowd):
            if len(fp):
                yield pd.DataFrame({"a": fp, "b": more, "mask": pd.array(mask, "Int64"), "crowd": crowd})

        def pass_by(mask, value, fp, more, crowd):
            """Hand on the rows of the large bucket that is passing; the rest."""
            same = (mask == crowded[0]) & (value == crowded[1])
            return hand_on(mask[same], fp[same], more[same], crowd[same]), tuple(x[~same] for x in (mask, value, fp, more, crowd)), bool(same.all())

        waiting, count = [], 0
        for pdf in batches:
            mask, fp, more, crowd = (pdf[c].to_numpy(np.int64) for c in ("mask", "fp", "more", "crowd"))
            waiting.append((mask, fp & mask, fp, more, crowd))
            count += len(pdf)
            if count < min(100_000, 2 * limit):
                continue
            held = tuple(np.concatenate(x) for x in zip(held, *waiting))
            waiting, count = [], 0
            if crowded is not None:
                gone, held, going_on = pass_by(*held)
                yield from gone
                crowded = crowded if going_on else None
            mask, value = held[:2]
            if len(mask):
                cut = int(((mask == mask[-1]) & (value == value[-1])).argmax())
                if cut:
                    yield from give(*(x[:cut] for x in held))
                held = tuple(x[cut:] for x in held)
                if len(held[0]) > limit:
                    crowded = held[0][0], held[1][0]
                    yield from hand_on(held[0], *held[2:])
                    held = none, none, none, none, none
        held = tuple(np.concatenate(x) for x in zip(held, *waiting))
        if crowded is not None:
            gone, held, _ = pass_by(*held)
            yield from gone
        if len(held[0]):
            yield from give(*held)
        pending[:] = thin(*pending)
        yield from give_links()

    value = F.col("fp").bitwiseAND(F.col("mask"))
    dealt = keyed.repartition(width, F.col("mask"), value).sortWithinPartitions(F.col("mask"), value)
    return dealt.mapInPandas(run, "a long, b long, mask long, crowd long")


def _array(masks: list[int]):
    return F.array([F.lit(m) for m in masks])


def near_duplicates(docs: DataFrame, *, shingle: int = 3, radius: int = 3, seed: int = 42, check: int | None = None) -> DataFrame:
    """Every document's doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest
    doc_id reachable over links of at most `radius` differing bits, itself included), component (a long that names
    the component), key (xxhash64 of its text) and first (whether its doc_id and key are the component's least, rows
    with a doc_id before those without). check: also at most so many of 128 bits may differ.

    Null and empty texts have fingerprint 0 and link like any other. Documents of equal
    fingerprint are one node, so copies cost nothing beyond their own row. Null doc_id: the row
    counts, but names no component unless all its doc_id are null (then component_id is null). Repeated rows stay (and are
    all first if one is). An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    hashed = stage(with_fingerprint(docs, shingle, seed, 1 if check is None else 2), "simhash-fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("least")
    nodes = stage(hashed.groupBy("fp").agg(least, F.min("more").alias("more"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    labels = linked(nodes.select("fp", "more"), radius, check)  # node, component: only nodes with links
    named = stage(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")).select("fp", "n", "component", "least"), "simhash-named")
    sums = named.groupBy("component").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("nodes"))
    sums = stage(sums, "simhash-components")
    # components of many nodes and fingerprints of many rows are few: these few are broadcast, the others shuffled
    edge = max(1, hashed.count() // (4 * shuffle_width(spark)))
    of_node = join_few(named.select("fp", "n", "component"), sums, "component", sums.where(F.col("nodes") > edge))
    of_node = stage(of_node.select("fp", "n", "component", "least"), "simhash-nodes")
    found = join_few(hashed, of_node, "fp", of_node.where(F.col("n") > edge))
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("key") == F.col("least.key"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"), "component", "key", first.alias("first"))


def join_few(rows: DataFrame, table: DataFrame, key: str, few: DataFrame) -> DataFrame:
    """Join rows with table (one row a key), whose rows `few` belong to the keys that many rows have: at most as many as rows can
    hold above that number, so they are broadcast and their rows stay where they are."""
    keys = [r[0] for r in few.select(key).collect()]
    if not keys:
        return rows.join(table, key)
    hot = F.col(key).isin(keys)
    return rows.where(hot).join(F.broadcast(table.where(hot)), key).unionByName(rows.where(~hot).join(table.where(~hot), key))
