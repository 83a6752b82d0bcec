"""Token ids, packing and attribution."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from epistle.llm import packing
from epistle.llm.attribution import attribute, count_tokens
from epistle.llm.queries import TOKENIZER
from epistle.llm.token_ids import TextEncoder

SCHEMA = "doc_id long, text string, source string, extra int, start int"
DOCS = [(1, "one two three four", "a", 1, 1), (2, None, "a", 1, 1), (3, "", None, 1, 1), (4, "word " * 9000, "a", 1, 1), (None, "no id here\n\nbut lines", "b", None, None),
        (5, "same", "b", 1, 1), (5, "same", "b", 1, 1), *[(100 + i, f"text {i} " * (i % 40), "c", 1, 1) for i in range(60)]]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t


def test_ids_are_the_librarys(tokenizer):
    rng = random.Random(5)
    alphabet = " \n\t\r\xa0 \x1c\x01ab'stéñ9.,!²́\U0001f600<|endoftext|>  \n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["I'm don't <|endoftext|> x", "\n", "a\n", "  a b", "a b\nc d", "\x01a", None]
    got = TextEncoder(TOKENIZER).encode(texts)
    assert [g.tolist() for g in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def check_pieces(rows, docs, tokenizer, window):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == window or at & (at - 1) == 0 and at < window
    for doc_id, text in {(d[0], d[1]) for d in docs}:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        copies = sum(d[0] == doc_id for d in docs)
        covered = np.zeros(len(ids), int)
        for r in by_doc[doc_id]:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            covered[r.start : r.start + r.length] += 1
        assert (covered == copies).all()


@pytest.mark.parametrize("window,block", [(2048, 64), (256, 2)])
def test_packing_round_trip(spark, tokenizer, window, block):
    docs = spark.createDataFrame(DOCS, SCHEMA).repartition(3)
    rows = packing.pack(docs, TOKENIZER, window=window, block_windows=block, least=32).collect()
    check_pieces(rows, DOCS, tokenizer, window)


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), TOKENIZER).count() == 0


def test_windows_keep_the_proportions(spark):
    docs = spark.createDataFrame([(i, "word " * 300, "abc"[i % 3], 1, 1) for i in range(300)], SCHEMA)
    rows = packing.pack(docs, TOKENIZER, window=512, block_windows=4, least=64, weights={"a": 2, "b": 1, "c": 1}).toPandas()
    first = rows[rows.sequence_id.isin(sorted(rows.sequence_id.unique())[: rows.sequence_id.nunique() // 2])]
    share = first.groupby("source").length.sum() / first.length.sum()
    assert abs(share["a"] - 0.5) < 0.02 and abs(share["b"] - 0.25) < 0.02
    running = first.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum").fillna(0).cumsum()
    assert (abs(running["a"] - running.sum(axis=1) / 2) <= 512 + 64).all()  # what is owed never grows


def test_schedule_adds_up():
    rng = random.Random(1)
    for _ in range(30):
        sizes = {s: rng.randint(1, 5000) for s in range(rng.randint(1, 6))}
        s = packing.Schedule(sizes, {k: rng.randint(0, 9) for k in sizes})
        for k, n in sizes.items():
            taken = [s.taken(k, t) for t in range(0, s.end + 100, 97)]
            assert taken == sorted(taken) and s.taken(k, s.end) == n
            for p in rng.sample(range(n), min(n, 20)):
                b = s.block_of(k, p, 200)
                assert s.taken(k, b * 200) <= p < s.taken(k, (b + 1) * 200)


def brute_counts(text, tokenizer):
    """Tokens by line, each token to the line that holds most of its characters."""
    encoded = tokenizer.encode(text, add_special_tokens=False)
    edges, at = [], 0
    for line in text.split("\n"):
        edges.append((at, at + len(line) + 1))
        at += len(line) + 1
    counts = [0] * len(edges)
    for a, b in encoded.offsets:
        counts[max(range(len(edges)), key=lambda k: (min(b, edges[k][1]) - max(a, edges[k][0]), -k))] += 1
    return counts, len(encoded.ids)


def test_attribution_is_brute_force(spark, tokenizer):
    docs = [*DOCS[:40], (900, "a\n\n\n\n b \n  \n é\n😀😀\n", "a", 1, 1), (901, "\n", "a", 1, 1)]
    got = {}
    for r in count_tokens(spark.createDataFrame(docs, SCHEMA), TOKENIZER).orderBy("section").collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc_id, text, *_ in docs:
        counts, total = brute_counts(text or "", tokenizer)
        rows = got[doc_id] if doc_id != 5 else got[doc_id][::2]
        assert [r.n_tokens for r in rows] == counts and all(r.doc_tokens == total for r in rows)
        assert rows[0].start_char == 0 and rows[-1].end_char == len(text or "")
    assert count_tokens(spark.createDataFrame([], SCHEMA), TOKENIZER).count() == 0


def test_rules():
    first, last = np.array([0, 2, 5, 8]), np.array([2, 5, 8, 9])
    starts, ends = np.array([0, 4, 7]), np.array([4, 7, 8])
    assert attribute(first, last, starts, ends, "start")[0].tolist() == [0, 0, 1, -1]
    assert attribute(first, last, starts, ends, "end")[0].tolist() == [0, 1, 2, -1]
    assert attribute(first, last, starts, ends, "majority")[0].tolist() == [0, 0, 1, -1]
    assert attribute(first, last, starts, ends, "majority")[1].tolist() == [False, True, True, True]


def test_other_vocabularies_and_special_tokens():
    """A vocabulary of another kind is given whole texts; the strings of special tokens are text unless asked for."""
    import json
    from pathlib import Path

    other = str(Path(TOKENIZER).with_name("word_bpe_49k.json"))
    texts = ["Hello  World, it's 2024\n\n ünï <|endoftext|> x", "", None, "a b"]
    for path, special in ((other, False), (TOKENIZER, True), (TOKENIZER, False)):
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = not special
        assert [g.tolist() for g in TextEncoder(path, special).encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    parts = json.loads(Path(TOKENIZER).read_text())
    from epistle.llm.token_ids import falls_into_units

    assert falls_into_units(parts) and not falls_into_units(parts | {"normalizer": {"type": "NFC"}}) and not falls_into_units(json.loads(Path(other).read_text()))


def test_merges_are_the_librarys(tokenizer):
    """Every kind of new unit gets the library's ids, and so many new words cost the library few calls."""
    rng = random.Random(9)
    alphabet = [*"aabcdeeéñßüç.,!'\"-²́ \n\t\x01_09ÀЖ中文語ー\U0001f642ʰªⅠ０ำ￾￿\x1c"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["\n", "a\n", "\na", "a\n\nb", "a" * 63 + " " + "a" * 62 + " " + "a" * 64 + "!!", " " + "!" * 70, "\x01 \x01a \n\x01", " a" * 5, "abc" * 100]
    texts += [f"ab{chr(c)} x{chr(c)}{chr(c)}, \n{chr(c)}d" for c in range(0x21, 0x20000, 31) if not 0xD800 <= c < 0xE000]
    texts += [" ".join("".join(rng.choice(["th", "eau", "ung", "ción", "ble", "ß", "er"]) for _ in range(rng.randint(1, 9))) + rng.choice(["", ",", ".", "!!"]) for _ in range(4000))]
    assert [g.tolist() for g in TextEncoder(TOKENIZER).encode(texts)] == [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    class Counting:
        given = 0

        def encode_batch_fast(self, units, **options):
            self.given += len(units)
            return tokenizer.encode_batch_fast(units, **options)

        def tokenize(self, unit):
            self.given += 1
            return tokenizer.model.tokenize(unit)

    enc = TextEncoder(TOKENIZER)
    enc.encode(["a"])
    enc.tokenizer = enc.model = library = Counting()
    assert enc.encode(texts[-1:])[0].tolist() == tokenizer.encode(texts[-1], add_special_tokens=False).ids
    assert len(set(texts[-1].split())) > 2000 and library.given <= 1


def test_merges_by_their_order():
    """A pair that a later merge replaces, equal pairs side by side, pairs that share a place in the table, more than one height."""
    from epistle.llm.bpe import Merges
    from epistle.llm.token_ids import _FORMS

    vocabulary = {c: i for i, c in enumerate(_FORMS.values())}
    merges = []
    for a, b in [("a", "a"), ("aa", "aa"), ("b", "c"), ("a", "b"), ("ab", "c"), ("a", "bc"), ("aaaa", "bc")] + [(x, y) for x in "defghij" for y in "defghij"]:
        vocabulary.setdefault(a + b, len(vocabulary))
        merges.append((a, b))
    names, made = {i: t for t, i in vocabulary.items()}, Merges(vocabulary, merges, _FORMS)
    ranks, rng = {p: r for r, p in enumerate(merges)}, random.Random(2)
    words = ["a", "aaa", "abc", "aaaabc", "z" * 64] + ["".join(rng.choice("aaabcdefghijz") for _ in range(rng.randint(1, 64))) for _ in range(500)]
    sizes = np.array([len(w) for w in words])
    ids, counts = made.encode(np.frombuffer("".join(words).encode(), np.uint8), np.cumsum(sizes) - sizes, sizes)
    for word, got in zip(words, np.split(ids, np.cumsum(counts)[:-1])):
        parts = list(word)
        while due := min(((ranks[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in ranks), default=None):
            parts[due[1] : due[1] + 2] = ["".join(parts[due[1] : due[1] + 2])]
        assert [names[i] for i in got.tolist()] == parts
