"""Token ids of whole texts by a byte-level BPE of the `tokenizers` library.

The pre-tokenizer of such a vocabulary never joins characters across white space except
one leading space, so a text falls into units (optional space + non-space run, or white
space) whose ids do not depend on each other. Each distinct unit is encoded once, simple ones many at a time (`bpe`), others by the
library, and looked up afterwards, which yields the ids of the whole text at several times the speed.

A unit's key is what follows its leading space, or "\\n" and what follows a line end, or
"\\x01" and the unit as it is.

This holds for byte-level BPE without normalizer and with the usual pattern; the file's parts say whether
it is one. With any other vocabulary, texts go to the library whole. The strings of special tokens in a text are ordinary
text, as the description of the vocabulary files has it (`special=True` gives them their ids).
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections import defaultdict

import numpy as np

from .bpe import LONGEST, Merges

#: Fixed value: the code points with the Unicode property White_Space, which the pre-tokenizer's \s means.
_BLANK = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_UNIT = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]")
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte -> character of a byte-level vocabulary: printed bytes as they are, the others from U+0100 on.
_FORMS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}
#: Units a worker remembers before it starts afresh; bounds memory, not results.
CACHE_UNITS = 500_000


_RARE = [c for c in _BLANK if c not in " \n"] + ["\x01", "  "]
_ASCII_RARE = [c for c in _RARE if c.isascii()]


@functools.cache
def _kinds() -> np.ndarray:
    """By code point: 1 for a letter, 2 for a sign (neither letter, digit, underscore nor white space), 0 for others and beyond U+FFFE."""
    chars = map(chr, range(0xFFFF))
    return np.array([1 if c.isalpha() else 0 if c.isalnum() or c == "_" or c.isspace() else 2 for c in chars] + [0], np.uint8)


def _keys(text: str) -> list[str]:
    """The keys of a text's units. Where white space is single spaces and line ends only, splitting will do."""
    if not any(c in text for c in (_ASCII_RARE if text.isascii() else _RARE)):
        parts = text.replace("\n", " \n").split(" ")
        if "" not in parts and "\n" not in parts:
            parts[0] = "\x01" + parts[0]
            return parts
    return [u[1:] if len(u) > 1 and u[0] == " " and u[1] not in "\n\x01" else "\x01" + u for u in _UNIT.findall(text)]


def _unit(key: str) -> str:
    return key[1:] if key[0] == "\x01" else key if key[0] == "\n" else " " + key


def falls_into_units(parts: dict) -> bool:
    """Whether a vocabulary file (its parts) cuts texts as this module does: BPE on bytes, the usual pattern, nothing else."""
    before, model = parts.get("pre_tokenizer") or {}, parts.get("model") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    merges = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    return bool(plain and merges and parts.get("normalizer") is None and parts.get("truncation") is None)


def parts_of(tokenizer) -> dict:
    """The parts of a loaded tokenizer that decide how it cuts texts, named as in its file. The whole file as Python objects
    would take more memory than the tokenizer does."""
    names = "dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"
    model = {k: getattr(tokenizer.model, k, None) for k in names} | {"type": type(tokenizer.model).__name__}
    before = tokenizer.pre_tokenizer
    return {"pre_tokenizer": before and json.loads(before.__getstate__()), "model": model, "normalizer": tokenizer.normalizer, "truncation": tokenizer.truncation}


class TextEncoder:
    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.in_units = falls_into_units(parts_of(self.tokenizer))
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added if special or not t.special]
        self._reset()

    def _reset(self):
        self.slots = defaultdict(itertools.count().__next__)  # key -> slot; a new key gets the next one
        self.learnt, self.used = 0, 0
        self.flat = np.empty(1 << 16, np.int32)
        self.start = np.empty(1 << 14, np.int64)
        self.length = np.empty(1 << 14, np.int64)

    def _learn(self):
        """Find the ids of the keys that have come in since."""
        first = self.learnt
        fresh = list(itertools.islice(reversed(self.slots), len(self.slots) - first))[::-1]
        while len(self.start) < len(self.slots):
            self.start, self.length = (np.concatenate((a, np.empty_like(a))) for a in (self.start, self.length))
        for at in range(0, len(fresh), 20_000):
            keys = fresh[at : at + 20_000]
            simple, ids, sizes = self._merged(keys)
            self._store(first + at + np.flatnonzero(simple), ids, sizes)
            rest = np.flatnonzero(~simple)
            encoded = self.tokenizer.encode_batch_fast([_unit(keys[i]) for i in rest.tolist()], add_special_tokens=False)
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            self._store(first + at + rest, np.fromiter((i for e in encoded for i in e.ids), np.int32, int(sizes.sum())), sizes)
        self.learnt = len(self.slots)

    def _store(self, rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[rows] = sizes
        self.start[rows] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def _merged(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are simple: letters, with a space or a line end before them, and signs behind them; the ids of these
        keys' units and how many each has. The line end, the letters with their space and the signs are one pre-token each, so
        the merges are applied to them at once; all other units take the library's whole way."""
        if self.merges is None:
            return np.zeros(len(keys), bool), np.empty(0, np.int32), np.empty(0, np.int64)
        joined = " " + " ".join(keys)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.fromiter(map(len, keys), np.int64, len(keys))
        begins = np.cumsum(chars + 1) - chars - 1  # where the space before each key is
        kinds = _kinds()
        kind = kinds[np.minimum(points, len(kinds) - 1)]
        kind[begins] = 0
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        line = points[begins + 1] == 10
        other = kind == 0
        other[1:] |= (kind[1:] == 1) & (kind[:-1] == 2)
        other[begins] = other[begins[line] + 1] = False
        letter = begins + 1 + line
        simple = ~np.logical_or.reduceat(other, begins) & (letter <= begins + chars) & (kind[np.minimum(letter, len(kind) - 1)] == 1)
        simple &= (points[begins + 1] != 1) & (np.add.reduceat(width, begins) <= LONGEST)

        sign = np.flatnonzero((kind[1:] == 2) & (kind[:-1] != 2)) + 1
        owner = np.searchsorted(begins, sign, "right") - 1
        sign = sign[simple[owner]]
        # each pre-token begins where the one before it ends; those of keys that aren't simple, and the spaces before line ends, are left out
        marked = np.zeros(len(points), bool)
        for places in (begins, begins[line] + 1, letter[simple & line], sign):
            marked[places] = True
        marks = np.flatnonzero(marked)
        at = np.concatenate(([0], np.cumsum(width)))
        starts, sizes = at[marks], np.diff(at[np.append(marks, len(points))])
        owner = np.searchsorted(begins, marks, "right") - 1
        wanted = simple[owner] & ~(line[owner] & (marks == begins[owner]))
        ids, counts = self.merges.encode(np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8), starts[wanted], sizes[wanted])
        return simple, ids, np.bincount(owner[wanted], counts, len(keys)).astype(np.int64)[simple]

    @functools.cached_property
    def merges(self) -> Merges | None:
        """None where the vocabulary lacks a byte: what becomes of it is left to the library."""
        model = json.loads(self.tokenizer.model.__getstate__())
        if all(c in model["vocab"] for c in _FORMS.values()):
            return Merges(model["vocab"], model["merges"], _FORMS)
        return None

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, int32; null and empty texts have none."""
        whole = [bool(t) and (not self.in_units or any(x in t for x in self.special)) for t in texts]
        if any(whole):
            encoded = iter(self.tokenizer.encode_batch_fast([t for t, w in zip(texts, whole) if w], add_special_tokens=False))
            others = iter(self._by_units([t for t, w in zip(texts, whole) if not w]))
            return [np.array(next(encoded).ids, np.int32) if w else next(others) for w in whole]
        return self._by_units(texts)

    def _by_units(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.slots) > CACHE_UNITS:
            self._reset()
        look = self.slots.__getitem__
        found = [np.fromiter(map(look, _keys(t)), np.int64) if t else np.empty(0, np.int64) for t in texts]
        if len(self.slots) > self.learnt:
            self._learn()
        out = []
        for slots in found:
            sizes = self.length[slots]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.repeat(self.start[slots] - ends + sizes, sizes) + np.arange(total)])
        return out

    @functools.cached_property
    def byte_lengths(self) -> np.ndarray:
        """Bytes of text that each id stands for: one for each character of its byte-level form."""
        out = np.zeros(self.vocabulary, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = len(token)
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder for each Python worker and file."""
    return TextEncoder(path)


def in_pieces(texts: list, most: int = 4_000_000):
    """Slices of a batch holding about `most` characters at most, so that temporaries stay small."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= most:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))
