"""Language ID, byte model, nearest neighbours, mixing, surrogates and the pipeline."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from epistle.llm import ann, common, langid, mixing, pii, ppm, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], SCHEMA)


# -- language ID

def test_language_of_held_out_documents(spark):
    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(queries.documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang"), "doc_id").toPandas()
    assert set(got.lang_pred) <= set(got.lang) and got.score.between(0, 1).all()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.98
    assert got.rejected.mean() < 0.005
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()


def test_rejection_and_odd_texts(spark):
    rows = [(i, "the cat sat on the mat with other cats and dogs of the house " * 3, "en") for i in range(80)] + [(100 + i, "der hund und die katze sind nicht in dem haus mit anderen " * 3, "de") for i in range(80)]
    model = langid.fit(docs_of(spark, rows), F.lit(True))
    odd = docs_of(spark, [(1, None, None), (2, "", None), (3, "12 345 !!", None), (4, "жзщ " * 200, None), (5, "the cat and dogs", None), (None, "der hund und die katze", "xx"), (5, "the cat and dogs", None)])
    got = langid.identify(odd, model).orderBy(F.col("doc_id").asc_nulls_last()).collect()
    assert [(r.lang_pred, r.rejected) for r in got[:3]] == [("und", True)] * 3
    assert got[3].rejected and [(r.lang_pred, r.rejected) for r in got[4:]] == [("en", False), ("en", False), ("de", False)]
    assert langid.identify(docs_of(spark, []), model).count() == 0
    nothing = langid.fit(docs_of(spark, []), F.lit(True))
    assert {r.lang_pred for r in langid.identify(odd, nothing).collect()} == {"und"}


# -- byte model

def brute_ppm(train, texts, order):
    contexts = collections.defaultdict(collections.Counter)
    stream = lambda t: [255] * order + list((t or "").encode().translate(ppm._LOWER)) + [254]
    for t in train:
        b = stream(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                contexts[tuple(b[i - k : i])][b[i]] += 1
    out = []
    for t in texts:
        b, total = stream(t), 0.0
        for i in range(order, len(b)):
            p, excluded = 1.0, set()
            for k in range(order, -1, -1):
                seen = contexts.get(tuple(b[i - k : i]), {})
                live = {s: n for s, n in seen.items() if s not in excluded}
                if live:
                    whole, kinds = sum(live.values()), len(live)
                    if b[i] in live:
                        p *= live[b[i]] / (whole + kinds)
                        break
                    p *= kinds / (whole + kinds)
                excluded |= set(seen)
            else:
                p /= 255 - len(excluded)
            total += math.log10(p)
        out.append(total)
    return out


def test_byte_model_and_words(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["Ab", "ab", "ba", "cad", "é", f"r{rng.randrange(40)}"]) for _ in range(rng.randint(0, 30)))) for i in range(120)] + [(200, None), (201, ""), (None, "zz \x7f new"), (5, "twin"), (5, "twin")]
    docs = docs_of(spark, rows).repartition(3)
    got = collections.defaultdict(list)
    for r in ppm.score(docs, common.crc_mod("doc_id", 10) == 0, order=3).collect():
        got[r.doc_id].append(r)
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    train = [t for (_, t), h in zip(rows, held) if not h]
    words = lambda t: [*re.findall("[^\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)})), None]
    count = collections.Counter(w for t in train for w in words(t))
    n = sum(count.values())
    scores = brute_ppm(train, [t for _, t in rows], 3)
    for (i, t), h, s in zip(rows, held, scores):
        r = next(x for x in got[i] if x.n_tokens == len(words(t)))
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (len(count) + 1))) for w in words(t))
        assert (r.held_out, r.n_known, r.train_tokens) == (h, sum(count[w] > 0 for w in words(t)), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(s, rel=1e-5)
    assert len(got[5]) == sum(i == 5 for i, _ in rows)
    assert ppm.score(docs_of(spark, []), F.lit(False)).count() == 0
    assert ppm.score(docs.limit(3), F.lit(True)).count() == 3  # nothing to learn from


def test_contexts_beyond_the_trie_count(spark):
    """However few contexts are broadcast, scores are those of all counts."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["Ab", "ba", "cad", "é", f"r{rng.randrange(40)}"]) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    want = brute_ppm([t for (_, t), h in zip(rows, held) if not h], [t for _, t in rows], 5)
    for states in (0, 30):
        got = {r.doc_id: r.score for r in ppm.score(docs_of(spark, rows), common.crc_mod("doc_id", 10) == 0, states=states).collect()}
        assert [got[i] for i, _ in rows] == pytest.approx(want, rel=1e-5)


def test_a_smaller_trie_still_sums_to_one():
    texts = ["the cat sat on the mat", "the dog sat on the log"] * 3
    codes, counts = ppm.tally(ppm.grams(ppm.stream(texts, 3)[0], 3))
    entries = {}
    for k in range(3, -1, -1):
        codes, counts = ppm.tally(codes & np.uint64((1 << 8 * (k + 1)) - 1), counts)
        first, totals = ppm._contexts(codes, counts)
        mask = np.repeat((totals >= 6) | (k < 2), np.diff(np.append(first, len(codes))))
        entries[k] = codes[mask], counts[mask]
    model = ppm.build(3, entries)
    known = np.setdiff1d(np.flatnonzero(model.column < model.column.max()), [ppm.PAD])
    others = ppm.SYMBOLS - len(known)
    sums = (10.0 ** model.score[:, model.column[known]]).sum(axis=1) + others * 10.0 ** model.score[:, -1]
    assert np.allclose(sums, 1, atol=1e-4)


# -- nearest neighbours

def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    x[100:400] = 3 * x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [None] * 16), (9080, [1.0]), (9100, [float("inf")] + [0.0] * 15)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "score": F.lit(1)}).repartition(3)
    got = collections.defaultdict(list)
    for r in ann.search(vectors, F.col("vec_id") % 20 == 0).orderBy("rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 3000, 20):
        s = (x * x[q]).sum(axis=1)
        best = sorted((-s[i], i) for i in range(3000) if i != q)[:20]
        assert [r[0] for r in got[q]] == list(range(1, 21)) and all(abs(s[i] - v) < 1e-9 for _, i, v in got[q])
        assert [(r[2], -r[1]) for r in got[q]] == sorted(((r[2], -r[1]) for r in got[q]), reverse=True)
        hits += len({r[1] for r in got[q]} & {i for _, i in best})
        total += 20
    assert hits / total >= 0.95 and set(got) == set(range(0, 3000, 20))
    equal = [i for _, i, _ in got[120] if 100 <= i < 400]
    assert equal == [100 + i for i in range(21) if i != 20][: len(equal)] and len(equal) == 20  # equal ones: smaller ids first
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert ann.search(few, F.col("vec_id") % 20 == 0).count() == 3
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_chi_square_limit():
    assert ann.chi_square_limit(0.95, 8) == pytest.approx(15.507, abs=1e-3) and ann.chi_square_limit(0.5, 2) == pytest.approx(1.386, abs=1e-3)


# -- mixing

def test_mixing_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 60), None, "abcde"[min(4, rng.randrange(9))] if i % 11 else None) for i in range(600)] + [(7, None, None, "a"), (None, "x y", None, "b"), (8, "q " * 5, None, "e"), (8, "q " * 5, None, "e")]
    got = mixing.mix(docs_of(spark, rows).repartition(3)).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    for _, part in got.groupby("source", dropna=False):
        assert part["size"].sum() == part.source_size.iat[0] and abs(part.taken.sum() - part.target.iat[0]) <= 1
    assert abs(got.groupby("source", dropna=False).target.first().sum() - 1.5 * got["size"].sum()) < 1e-6
    again = mixing.mix(docs_of(spark, rows).repartition(2)).toPandas()
    key = lambda d: sorted(map(str, zip(d.doc_id, d.source, d["size"], d.taken)))
    assert key(got) == key(again)
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix(docs_of(spark, [(1, None, None, "a"), (2, "", None, None)])).collect()} == {0}


def brute_flow_cost(supply, quota, most):
    """Least cost of all ways to route, word by word; None where a quota can't be met."""
    from functools import lru_cache

    patterns, sources = list(supply), list(quota)

    @lru_cache(None)
    def best(k, left):
        if k == len(patterns):
            return (sum(left), 0)
        p, found = patterns[k], None
        index = [sources.index(s) for s in p]

        def go(j, used, now):
            nonlocal found
            if j == len(index):
                cost = sum(supply[p] and (u // supply[p]) ** 2 for u in range(used))
                rest = best(k + 1, tuple(now))
                offer = (rest[0], rest[1] + cost)
                found = offer if found is None or offer < found else found
                return
            for give in range(min(now[index[j]], most * supply[p] - used) + 1):
                nxt = list(now)
                nxt[index[j]] -= give
                go(j + 1, used + give, nxt)

        go(0, 0, list(left))
        return found

    return best(0, tuple(quota[s] for s in sources))


def test_flow_is_of_least_cost():
    rng = random.Random(4)
    for _ in range(40):
        sources = ["a", "b", None][: rng.randint(1, 3)]
        patterns = {tuple(sorted(rng.sample(sources, rng.randint(1, len(sources))), key=str)) for _ in range(3)}
        supply = {p: rng.randint(0, 3) for p in patterns}
        quota = {s: rng.randint(0, 4) for s in sources}
        flow = mixing.min_cost_flow(supply, quota, [0, 1])
        used = {p: sum(flow[p, s] for s in p) for p in supply}
        assert all(used[p] <= 2 * supply[p] for p in supply)
        short = sum(quota[s] - sum(flow[p, s] for p in supply if s in p) for s in quota)
        cost = sum((u // supply[p]) ** 2 for p in supply for u in range(used[p]))
        assert (short, cost) == brute_flow_cost(supply, quota, 2)


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, [["a"], ["b"], ["a", "b"], None][i % 4]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    got = mixing.mix(docs, weights={"a": 1, "b": 1, None: 1}, share=1.0)
    assert abs(got.agg(F.sum("taken")).first()[0] - 2000) <= 2
    assert mixing.mixed_documents(docs, share=1.0).columns == docs.columns


# -- surrogates

ENTITIES = "Mail hein.19@mail5.example.com or HEIN.19@MAIL5.EXAMPLE.COM, call +1 (974) 555-3436 or +1 974-555-3436, pay 9807915762804490 from 97.51.17.173. token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"! Mrs. Anna Smith met Mr Smith, г-жа Анна Иванова."


def test_surrogates(spark):
    clean = "Apache License, Version 2.0. CC BY-NC 4.0, version 3. In 2024 there were 1,234,567 words; see 1.2.3.4.5 and 12345678901."
    rows = [(1, ENTITIES), (2, clean), (3, None), (4, ""), (None, "x a@b.org y"), (5, "x a@b.org y"), (5, "x a@b.org y"), (6, "9807 9157 6280 4490")]
    out = pii.replace_entities(docs_of(spark, rows), key="k")
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].text == clean and got[3].text is None and got[4].text == "" and [got[i].n_entities for i in (2, 3, 4)] == [0, 0, 0]
    t = got[1].text
    for secret in ("hein", "HEIN", "974", "555-3436", "9807915762804490", "97.51.17.173", "04dbebab", "Anna", "Smith", "Анна", "Иванова"):
        assert secret not in t
    first, second = re.findall(r"\S+@\S+\.(?:com|COM)", t)
    assert first.upper() == second and re.fullmatch(r"[a-z]{4}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", first)
    a, b = re.findall(r"\+1 (\(\d{3}\) \d{3}-\d{4}|\d{3}-\d{3}-\d{4})", t)
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b)
    card = re.search(r"pay (\d{16}) ", t)[1]
    assert got[6].text.replace(" ", "") == card and len(got[6].text) == 19
    assert re.search(r'token = "[0-9a-f]{40}"', t) and re.search(r"from (24\d|25[0-5])(\.\d{1,3}){3}\.", t)
    mrs, mr, russian = re.search(r"Mrs\. (\w+ \w+) met", t)[1], re.search(r"Mr (\w+),", t)[1], re.search(r"г-жа (\w+) (\w+)\.", t)
    assert mrs.split()[1] == mr and mrs.split()[0].endswith("na") and re.fullmatch("[А-я]+", russian[1]) and russian[1].endswith("на")
    assert got[5].text == got[None].text != "x a@b.org y" and out.where("doc_id = 5").count() == 2
    assert pii.replace_entities(docs_of(spark, rows), key="other").where("doc_id = 1").first().text != t
    assert pii.replace_entities(docs_of(spark, []), key="k").count() == 0


def test_surrogates_stay_distinct(spark):
    """A kind with few surrogates, so that collisions do occur."""
    entities = spark.createDataFrame([("ssn", f"{i:02d}") for i in range(45)] + [("card", "11")], "kind string, canon string")
    got = pii.assign(entities, "k").collect()
    made = [r.surrogate for r in got if r.kind == "ssn"]
    assert len(made) == len(set(made)) == 45 and not set(made) & {f"{i:02d}" for i in range(45)}


# -- the pipeline and the driver's view

def test_pipeline_stages(spark):
    """Each stage does to its own input what its operator promises."""
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "pii", "mixing", "packing"]
    d = "/root/testdata/sf0.001"
    docs = queries.documents(spark, d)
    seen = [docs.toPandas()]
    for name, f in C.STAGES:
        docs = common.stage(f(spark, docs, d), name)
        seen.append(docs.toPandas())
        assert name == "packing" or list(seen[-1].columns) == list(seen[0].columns)
    raw, known, unique, private, mixed, packed = seen
    assert set(known.doc_id) <= set(raw.doc_id) and len(known) > 0.98 * len(raw)
    texts = known.set_index("doc_id").text
    from epistle.llm.simhash import fingerprints

    fps = fingerprints(texts.tolist(), C.SHINGLE, words=2)
    apart = np.bitwise_count(fps[:, None] ^ fps[None])
    near = (apart[..., 0] == 0) | (apart[..., 0] <= C.RADIUS) & (apart.sum(axis=2) <= C.CHECK)
    label = list(range(len(fps)))
    for a, b in zip(*np.nonzero(np.tril(near, -1))):
        x, y = label[a], label[b]
        label = [min(x, y) if v == max(x, y) else v for v in label]
    groups = collections.defaultdict(list)
    for i, v in zip(texts.index, label):
        groups[v].append(i)
    assert sorted(unique.doc_id) == sorted(min(g) for g in groups.values())
    assert sorted(private.doc_id) == sorted(unique.doc_id) and (private.n_chars == private.text.str.len()).all()
    before = unique.set_index("doc_id").text
    changed = [i for i, t in zip(private.doc_id, private.text) if before[i] != t]
    assert changed == [i for i in private.doc_id if re.search(r"@mail\d|\(\d{3}\) 555|\b\d{16}\b|\b(\d{1,3}\.){3}\d|[0-9a-fA-F]{40}", before[i])]
    assert mixed.groupby("doc_id").size().max() <= 2 and set(mixed.doc_id) <= set(private.doc_id)
    assert sorted(set(packed.doc_id)) == sorted(set(mixed.doc_id))
    whole = packed.groupby("doc_id").length.sum()
    assert (whole == packed.groupby("doc_id").doc_tokens.first() * mixed.groupby("doc_id").size()).all()


def test_near_dedup_of_repeated_and_missing_doc_ids(spark):
    """One doc_id with two texts keeps both; near copies without a doc_id go."""
    import corpus_pipeline as C

    rng = random.Random(5)
    long = [" ".join(f"w{rng.randrange(1000)}" for _ in range(300)) for _ in range(4)]
    near = [t + " tail" for t in long]
    rows = [(1, long[0]), (1, long[1]), (None, near[0]), (2, near[1]), (None, long[2]), (None, near[2]), (3, long[3]), (3, long[3]), (None, near[3])]
    got = C.drop_near_duplicates(spark, docs_of(spark, rows), "").collect()
    groups = collections.Counter(next(i for i, t in enumerate(long) if r.text.startswith(t)) for r in got)
    assert groups == {0: 1, 1: 1, 2: 1, 3: 1}
    assert sorted((r.doc_id for r in got), key=str) == [1, 1, 3, None]


def test_mixing_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = c.execute(queries.ORACLE_SQL["op6_mixing"]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.op6_mixing(spark, d).toPandas()[want.columns].sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want)


def test_surrogates_of_names_in_documents(spark):
    """Parts of a titled name are found wherever the document repeats them, in one form for all."""
    rows = [(1, "Mrs Ada Lovelace met John Smith. Ada wrote to Mr Smith. Dr. Mary Q. O'Brien-Jones and MR SMITH left; Adam stays. Prof Lovelace!"), (2, "Ada Lovelace and Smith, untitled here")]
    got = {r.doc_id: r for r in pii.replace_entities(docs_of(spark, rows), key="k").collect()}
    t = got[1].text
    for name in ("Ada ", "Lovelace", "John", "Smith", "Mary", "Q.", "O'Brien", "Jones"):
        assert name not in t
    assert "Adam stays" in t and got[2].text == rows[1][1] and got[2].n_entities == 0
    first, last, given, smith = re.match(r"Mrs (\w+) (\w+) met (\w+) (\w+)\. ", t).groups()
    assert f". {first} wrote to Mr {smith}. Dr. " in t and t.endswith(f"Prof {last}!") and first.endswith("na") and len({first, last, given, smith}) == 4


def test_surrogates_keep_check_digits_and_domains(spark):
    text = "4111 1111 1111 1111 or 378282246310005 not 1234567890123, DE89 3704 0044 0532 0130 00, bob@x.com ann@x.com bob@x.org ab@c.com a@bc.com, fe80:0:0:0:1:2:3:4 2001:db8::1 face::bad 10:20:30"
    out = pii.replace_entities(docs_of(spark, [(1, text)]), key="k").first()
    t = out.text
    luhn = lambda d: sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(reversed(d))) % 10
    visa, amex = re.match(r"(\d{4} \d{4} \d{4} \d{4}) or (\d{15}) not 1234567890123, ", t).groups()
    assert visa != "4111 1111 1111 1111" and luhn(visa.replace(" ", "")) == luhn(amex) == 0
    iban = re.search(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", t)[0].replace(" ", "")
    assert iban != "DE89370400440532013000" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    mails = re.findall(r"(\w+)@(\w+)\.(\w+)", t)
    assert len({m[:2] for m in mails}) == 5 and mails[0][1] == mails[1][1] != mails[2][1] and [m[2] for m in mails] == ["com", "com", "org", "com", "com"]
    assert "fe80" not in t and "db8" not in t and "face::bad 10:20:30" in t and out.n_entities == 10


def test_surrogates_when_a_space_is_full(spark):
    """More one-letter mailboxes than letters, more names of one form than it has: longer surrogates, all distinct."""
    rows = [(i, f"{c}@y.com") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    got = pii.replace_entities(docs_of(spark, rows), key="k").collect()
    assert len({r.text for r in got}) == 26 and all(re.fullmatch(r"[a-z0-9]+@[a-z0-9]+\.com", r.text) and r.text not in {t for _, t in rows} for r in got)


def test_surrogates_in_hostile_texts(spark):
    """Long runs that tempt a regular expression to recurse, columns named like the operator's own."""
    rows = [(1, "a@" + "b." * 200_000 + "com"), (2, "A" + "-a" * 300_000), (3, "Mr " + "A." * 200_000 + "Mr " + "Bb " * 100_000), (4, "1 " * 300_000 + "12:" * 100_000), (5, "a" * 600_000 + "@x.com"),
            (6, "f" * 500_000 + ":" * 500_000), (7, "x " * 200_000 + "bob@mail.com")]
    docs = docs_of(spark, rows).withColumns({c: F.lit(1) for c in ("_own", "_ownmade", "id", "hash", "found", "surface", "n_entities", "at", "_pii_id", "_new")})
    got = {r.doc_id: r for r in pii.replace_entities(docs, key="k").collect()}
    assert len(got) == 7 and got[7].n_entities == 1 and "bob@" not in got[7].text and got[1].text == rows[0][1]
    assert got[1]._own == 1 and got[1].hash == 1


def test_mixing_tells_rows_of_one_doc_id_apart(spark):
    rows = [(1, "w", None, "a"), (1, "w " * 99, None, "a"), (2, "w " * 50, None, "a"), (3, "w " * 400, None, "b"), (None, "x", None, "a"), (None, "y " * 70, None, "a")]
    docs = docs_of(spark, rows).withColumns({c: F.lit(1) for c in ("_rest", "_own", "_ownorder")})
    got = mixing.mix(docs).collect()
    assert len(got) == 6 and all(0 <= r.taken <= 2 * r["size"] and r._rest == 1 for r in got)


def test_languages_without_doc_ids(spark):
    """Null doc_id and repeated rows do the fit no harm; at most fit_rows rows are fitted on."""
    en, de = "the cat sat on the mat with other cats of house {}", "der hund und die katze sind nicht in dem haus {}"
    rows = [(None, t.format("abcdefghij"[i % 10] * (i // 10 + 1)), lang) for i in range(100) for t, lang in ((en, "en"), (de, "de"))] + [(None, en, "en")] * 300
    model = langid.fit(docs_of(spark, rows), F.lit(True), fit_rows=60)
    assert model.languages == ["de", "en"]
    odd = docs_of(spark, [(1, "the cat and the house"), (2, "die katze und der hund")]).withColumn("_found", F.lit(1))
    assert [(r.lang_pred, r._found) for r in langid.identify(odd, model).orderBy("doc_id").collect()] == [("en", 1), ("de", 1)]
