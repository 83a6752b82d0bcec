"""Byte-pair merges of many pre-tokens at once.

A pre-token is a column of ids, one for each byte at first. In every round each column makes the one merge that
is due in it: the pair of least rank, the leftmost of equals, which is the order of the `tokenizers` library. Merged
places are linked past, not moved, so a round costs a minimum over the columns and a few look-ups a column.
"""

from __future__ import annotations

import numpy as np

#: Bytes of the longest pre-token that is merged here; a place takes six bits of a pair's code.
LONGEST = 64
#: Columns are as high as the next of these, so that few tables hold pre-tokens of many lengths.
_HEIGHTS = (1, 2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, LONGEST)
#: The code of a pair that doesn't merge.
_NEVER = np.int32(2**31 - 1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Merges:
    """The merges of a byte-level BPE. vocabulary: token -> id; merges: pairs of tokens in order of rank;
    forms: byte -> its character in tokens. A later merge of the same pair replaces an earlier one."""

    def __init__(self, vocabulary: dict[str, int], merges: list, forms: dict[int, str]):
        self.bytes = np.array([vocabulary[forms[b]] for b in range(256)], np.int32)
        self.stride = np.uint64(max(vocabulary.values()) + 2)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = (np.array([vocabulary[p[k]] for p in pairs], np.int32) for k in (0, 1))
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.none = len(pairs)
        if self.none >= 1 << 24:
            raise ValueError("too many merges for the codes of pairs")
        self.keys = np.append(self._key(left, right), np.uint64(0))
        bits = max(4, (8 * self.none).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, self.none, np.int32)
        last = {k: i for i, k in enumerate(self.keys[:-1].tolist())}
        rest = np.fromiter(last.values(), np.int64, len(last))
        at = self._home(self.keys[rest])
        while len(rest):  # those whose place is free take it, one a place; the others go on to the next
            free = np.flatnonzero(self.table[at] == self.none)
            _, one = np.unique(at[free], return_index=True)
            self.table[at[free[one]]] = rest[free[one]]
            left_over = np.ones(len(rest), bool)
            left_over[free[one]] = False
            rest, at = rest[left_over], (at[left_over] + 1) & self.mask

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A pair as one number; -1, which stands for no id, is in the key of no merge."""
        return (left + 1).astype(np.uint64) * self.stride + (right + 1).astype(np.uint64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _FACTOR) >> self.shift).astype(np.int64)

    def _codes(self, left: np.ndarray, right: np.ndarray, place) -> np.ndarray:
        """rank * 64 + place of each pair that merges, so that the least code is the merge that is due."""
        keys = self._key(left, right).ravel()
        at = self._home(keys)
        rank = self.table[at]
        todo = np.flatnonzero((self.keys[rank] != keys) & (rank != self.none))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            rank[todo] = found = self.table[at[todo]]
            todo = todo[(self.keys[found] != keys[todo]) & (found != self.none)]
        rank = rank.reshape(left.shape)
        return np.where(rank == self.none, _NEVER, (rank << np.int32(6)) | place.astype(np.int32))

    def _merge(self, ids: np.ndarray) -> np.ndarray:
        """ids: (height + 1, n), -1 beyond the end of a column and in the last row. Merged in place; ids that are gone become -1."""
        height, n = ids.shape[0] - 1, ids.shape[1]
        codes = np.full(ids.shape, _NEVER, np.int32)
        codes[: height - 1] = self._codes(ids[: height - 1], ids[1:height], np.arange(height - 1)[:, None])
        flat, columns = ids.reshape(-1), np.arange(n)
        after = np.repeat(np.arange(1, height + 2, dtype=np.int32), n)
        before = np.repeat(np.arange(-1, height, dtype=np.int32), n)
        before[:n] = height  # the last row, where there is never an id
        while n:
            due = codes.min(axis=0)
            live = np.flatnonzero(due != _NEVER)
            if not len(live):
                break
            if len(live) < 0.8 * len(columns):
                codes, columns, due = codes[:, live], columns[live], due[live]
                live = np.arange(len(columns))
            due, column = due[live], columns[live]
            first, new = (due & 63).astype(np.int64), self.made[due >> 6]
            here = first * n + column
            second = after[here].astype(np.int64)
            there = second * n + column
            third, previous = after[there].astype(np.int64), before[here].astype(np.int64)
            flat[here], flat[there] = new, -1
            after[here] = third
            before[third * n + column] = first
            codes[second, live] = _NEVER
            codes[first, live] = self._codes(new, flat[third * n + column], first)
            codes[previous, live] = self._codes(flat[previous * n + column], new, previous)
        return ids

    def encode(self, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens buf[start : start + size] of 1 to LONGEST bytes, one after the other, and how many each has."""
        counts, parts = np.empty(len(starts), np.int64), []
        kind = np.searchsorted(_HEIGHTS, sizes)
        for k in np.unique(kind).tolist():
            rows, height = np.flatnonzero(kind == k), _HEIGHTS[k]
            place = np.arange(height + 1)[:, None]
            ids = self.bytes[buf[np.minimum(starts[rows] + place, len(buf) - 1)]]
            ids[place >= sizes[rows]] = -1
            ids = self._merge(ids).T
            there = ids >= 0
            counts[rows] = there.sum(axis=1)
            parts.append((rows, ids[there]))
        out, begins = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for rows, ids in parts:
            n = counts[rows]
            out[np.repeat(begins[rows] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return out, counts
