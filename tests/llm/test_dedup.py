"""SimHash, repeated passages, SpotSigs and components against brute force."""

import collections
import hashlib
import random
import re

import pytest
import numpy as np
import xxhash
from pyspark.sql import functions as F

from epistle.llm import simhash, spotsigs
from epistle.llm.components import components
from epistle.llm.substring import remove_repeats
from epistle.llm.words import WordBatch, runs, xxh64

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, fp int, component int, spans int"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text):
    return WORD.findall((text or "").encode())


def random_texts(seed, n=150, vocabulary=60):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, 120))) for _ in range(n)]
    copies = [t.replace("w1 ", "x ", 1) for t in base[:30]] + base[:20] + [t + " tail" for t in base[20:40]]
    return [None, "", "One", "one", "a b", " \t\n", *base, *copies, base[3] * 30]


def test_words_and_hashes():
    texts = random_texts(1) + ["ünï cödé x"]
    batch = WordBatch(texts)
    for k, t in enumerate(texts):
        a, b = batch.bounds[k], batch.bounds[k + 1]
        assert [batch.raw[s:e] for s, e in zip(batch.starts[a:b], batch.ends[a:b])] == words(t)
    assert len(set(zip(batch.hashes().tolist(), [batch.raw[s:e] for s, e in zip(batch.starts, batch.ends)]))) == len(set(batch.hashes().tolist()))
    h = batch.hashes()
    grams = [tuple(h[i : i + 4]) for i in range(len(h) - 3)]
    assert len(set(grams)) == len(set(runs(h, 4).tolist())) == len(set(zip(grams, runs(h, 4).tolist())))


def test_xxh64_is_the_librarys():
    rng = np.random.default_rng(0)
    raw = rng.integers(0, 256, 40_000, dtype=np.uint8).tobytes()
    sizes = np.repeat(np.arange(1, 300), 30)
    starts = rng.integers(0, 39_000, len(sizes))
    assert xxh64(raw, starts, starts + sizes).tolist() == [xxhash.xxh64_intdigest(raw[s : s + n], 42) for s, n in zip(starts, sizes)]


def brute_fingerprint(text, k):
    w = [x.translate(LOWER) for x in words(text)]
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    label = list(range(len(fps)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(fps))]


def test_simhash(spark):
    texts = random_texts(2)
    for k, radius in ((3, 3), (5, 12)):
        docs = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in enumerate(texts)], SCHEMA)
        got = {r.doc_id: r for r in simhash.near_duplicates(docs, shingle=k, radius=radius).collect()}
        fps = [brute_fingerprint(t, k) for t in texts]
        assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == fps
        assert [got[i].component_id for i in range(len(texts))] == brute_components(fps, radius)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d", 0, 0, 0), (7, "a b c d", 0, 0, 0), (None, "zz yy xx", 0, 0, 0), (7, "a b c d", 0, 0, 0)], SCHEMA)
    assert sorted(str(r.component_id) for r in simhash.near_duplicates(odd).collect()) == ["7", "7", "7", "None"]


def test_links_in_crowded_buckets(spark, monkeypatch):
    """One crowd of fingerprints a few bits apart: buckets are split, no link is lost."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    crowd = {centre ^ sum(1 << int(b) for b in rng.choice(40, rng.integers(0, 9), replace=False)) for _ in range(1500)}
    fps = sorted(crowd | {int(x) for x in rng.integers(1 << 62, size=1500)})
    monkeypatch.setattr(simhash, "BUCKET", 256)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = simhash.links(df, 3).collect()
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 3 for r in found)
    at = {x: i for i, x in enumerate(fps)}
    label = list(range(len(fps)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for r in found:
        x, y = find(at[r.a]), find(at[r.b])
        label[max(x, y)] = min(x, y)
    assert [find(a) for a in range(len(fps))] == brute_components(fps, 3)
    assert len(found) < 40 * len(fps)


def test_masks_in_passes_lose_no_link(spark, monkeypatch):
    """A pass of one mask at a time, with crowded buckets, joins what all masks at once join; the pipeline asks for 0.8 of five-word shingles."""
    import corpus_pipeline as C

    assert C.SHINGLE == 5 and C.RADIUS >= 12
    monkeypatch.setattr(simhash, "PASS_ROWS", 1)
    rng = np.random.default_rng(11)
    fps = np.unique(rng.integers(0, 1 << 63, 40).astype(np.uint64).repeat(10) ^ np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in range(400)], np.uint64))
    monkeypatch.setattr(simhash, "allocate", lambda n, both, radius: [0xFFFF << 16 * k for k in range(3)] + [0])  # the last: one bucket of all
    found = simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), 3).collect()
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3

    def groups(pairs):
        label = {int(x): int(x) for x in fps.view(np.int64)}
        for a, b in pairs:
            x, y = label[a], label[b]
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
        return label

    signed = fps.view(np.int64)
    assert groups([(r.a, r.b) for r in found]) == groups([(int(signed[i]), int(signed[j])) for i, j in zip(*np.nonzero(near)) if i < j])


def test_every_near_pair_shares_a_mask():
    rng = np.random.default_rng(4)
    bits = (rng.random((500, 64)) < rng.uniform(0.1, 0.9, 64)).astype(float)
    for radius in (0, 1, 3, 7, 12):
        masks = simhash.allocate(200_000, bits.T @ bits * 400, radius)
        for _ in range(300):
            change = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(m & change == 0 for m in masks)
    for parts in (4, 13):
        deeper = simhash.split_mask(0xFF, parts)
        for _ in range(100):
            change = sum(1 << int(b) for b in rng.choice(np.arange(8, 64), parts - 1, replace=False))
            assert any(m & change == 0 for m in deeper) and all(m & 0xFF == 0xFF for m in deeper)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}

    def find(a):
        while label.setdefault(a, a) != a:
            a = label[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    assert got == {a: find(a) for a in label}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts, n):
    listed = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + n]) for w in listed for i in range(len(w) - n + 1))
    out = []
    for w in listed:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def test_repeated_passages(spark, monkeypatch):
    texts = random_texts(7, 60, 400)
    shared = " ".join(f"s{i}" for i in range(50))
    texts += [f"{t} {shared} {t}" for t in texts[10:40] if t] + ["same " * 200, "the end " * 30]
    docs = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    import epistle.llm.substring as S

    for n, chunk in ((35, S.CHUNK), (35, 2000), (5, 3000)):
        monkeypatch.setattr(S, "CHUNK", chunk)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in remove_repeats(docs, length=n).collect()}
        assert [got[i] for i in range(len(texts))] == brute_repeats(texts, n)
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, shared, 0, 0, 0), (1, shared, 0, 0, 0), (None, "x " + shared, 0, 0, 0)], SCHEMA)
    assert sorted((r.n_removed, r.kept) for r in remove_repeats(twice).collect()) == [(50, ""), (50, ""), (50, "x")]


def brute_signatures(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    at = [i for i, x in enumerate(w) if x not in spotsigs.COMMON]
    out = {(w[p - 1], w[p], w[at[r + 1]] if r + 1 < len(at) else None) for r, p in enumerate(at) if p > 0 and (r == 0 or at[r - 1] != p - 1)}
    n = sum(1 for r, p in enumerate(at) if p > 0 and (r == 0 or at[r - 1] != p - 1))
    if n < spotsigs.FEW:
        out = {(x, w[i + 1] if i + 1 < len(w) else None, w[i + 2] if i + 2 < len(w) else None) for i, x in enumerate(w)}
    return out


def test_spotsigs(spark):
    rng = random.Random(8)
    texts = [None, "", "!!", "word", "the the the", *[" ".join(rng.choice(["the", "of", "and", *(f"c{i}" for i in range(30))]) for _ in range(rng.randint(1, 90))) for _ in range(80)]]
    ids = rng.sample(range(10_000), len(texts))
    docs = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in zip(ids, texts)], SCHEMA).repartition(5)
    got = {r.doc_id: r for r in spotsigs.fingerprints_of_edits(docs).collect()}
    order = sorted(zip(ids, texts))

    def likeness(a, b):
        a, b = brute_signatures(a), brute_signatures(b)
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert len(r.fingerprint) == 8 * len(brute_signatures(t)) and len(r.edited_fingerprint) == 8 * len(brute_signatures(edited))
        assert abs(r.near_edited - likeness(t, edited)) < 1e-9 and abs(r.near_next - likeness(t, after)) < 1e-9
    one = spark.createDataFrame([(1, "the cat sat", 0, 0, 0)], SCHEMA)
    assert spotsigs.fingerprints_of_edits(one).first().near_next == 1.0
    assert spotsigs.fingerprints_of_edits(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(None, "a b c", 0, 0, 0), (3, "x y z", 0, 0, 0), (3, "x y z", 0, 0, 0)], SCHEMA)
    assert spotsigs.fingerprints_of_edits(odd).count() == 3


def test_spotsig_order_is_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "SPLIT_DOCS", 10)
    docs = spark.range(300).select((F.col("id") * 7).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows = spotsigs.with_next(docs).select("doc_id", "next_text").collect()
    assert {r.doc_id: r.next_text for r in rows} == {7 * i: f"text {(i + 1) % 300}" for i in range(300)}


def test_spotsig_pairs(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice(["the", "of", *(f"c{i}" for i in range(200))]) for _ in range(150)) for _ in range(20)]
    texts = base + [t.replace(" the ", " the q ", 1) for t in base[:10]] + base[:3]
    docs = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in enumerate(texts)], SCHEMA)
    got = {(r.a, r.b) for r in spotsigs.pairs(docs, least=0.6).collect()}
    sets = [brute_signatures(t) for t in texts[:30]]
    assert got == {(a, b) for b in range(30) for a in range(b) if sets[a] != sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}


@pytest.mark.parametrize("nodes,edges", [(1, 0), (2, 1), (60, 40), (60, 90), (3000, 2500)])
def test_stars_connect_what_edges_connect(nodes, edges):
    """Against a plain union-find; every edge starts at the least node of its group."""
    from epistle.llm.components import stars

    rng = np.random.default_rng(nodes + edges)
    a, b = rng.integers(-nodes, nodes, (2, edges))
    a, b = a[a != b], b[a != b]

    def least(pairs):
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for x, y in pairs:
            x, y = root(x), root(y)
            up[max(x, y)] = min(x, y)
        return {x: root(x) for x in list(up)}

    x, y = stars(a, b)
    want = least(zip(a.tolist(), b.tolist()))
    assert {**{k: k for k in x.tolist()}, **dict(zip(y.tolist(), x.tolist()))} == want


@pytest.mark.parametrize("nodes,edges", [(1, 0), (2, 1), (60, 40), (60, 300), (3000, 9000)])
def test_forest_of_edges(nodes, edges):
    """Its edges are some of those given, close no circle and connect what all of them connect."""
    from epistle.llm.components import forest, stars

    rng = np.random.default_rng(nodes + edges)
    a, b = rng.integers(-nodes, nodes, (2, edges))
    chosen = forest(a, b)
    assert len(set(chosen.tolist())) == len(chosen) == len(stars(a, b)[0])
    assert [x.tolist() for x in stars(a[chosen], b[chosen])] == [x.tolist() for x in stars(a, b)]


def test_a_crowd_linked_under_every_mask_is_a_few_edges_a_member(spark):
    """Near copies of two texts and others: what is emitted does not grow with the number of masks; no group changes."""
    rng = np.random.default_rng(5)
    flips = lambda n, most: [sum(1 << int(b) for b in rng.choice(62, rng.integers(0, most), replace=False)) for _ in range(n)]
    one, two = (int(x) for x in rng.integers(1 << 62, size=2))
    fps = sorted({one ^ x for x in flips(500, 8)} | {two ^ x for x in flips(300, 4)} | {int(x) for x in rng.integers(1 << 62, size=400)})
    df = spark.createDataFrame([(x, x >> 7) for x in fps], "fp long, more long")
    assert len(simhash.allocate(*simhash.bit_counts(df), 9)) > 2 * simhash.FIRST
    near = np.array([[bin(x ^ y).count("1") <= 9 and bin(x ^ y).count("1") + bin(x >> 7 ^ y >> 7).count("1") <= 16 for y in fps] for x in fps])
    found = simhash.links(df, 9, 16).collect()
    at = {x: i for i, x in enumerate(fps)}
    assert all(near[at[r.a], at[r.b]] for r in found)
    assert len(found) < 5 * len(fps)  # tasks of a pass x members at most; the forests of all masks would be far more
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None], len(fps)).min(axis=1)
        if (low == label).all():
            break
        label = low
    want = {fps[i]: fps[label[i]] for i in range(len(fps)) if near[i].sum() > 1}
    assert {r.node: r.component for r in simhash.linked(df, 9, 16).collect()} == want
