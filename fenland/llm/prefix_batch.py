"""The prefix table of last tokens filled for many words at once.

All words go forward one symbol at a time through one automaton over the vocabulary, kept as a table
of moves. At each end the entries that end there are tried longest first, for all words
together, against the token that ends the prefix before them; which neighbours fit is looked
up in a sorted array that grows as new pairs are met.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np

from fenland.llm.merge_tree import SHIFT

MOST_PAIRS = 2_000_000  # neighbours remembered in one task


class PrefixBatch:
    def __init__(self, entries: Iterable[tuple[Sequence[int], int]], symbols: int, fits: Callable[[int, int], bool]):
        """`entries` are (symbols, id) with symbols from 0 to `symbols` - 1; `fits(left, right)` tells neighbours."""
        self.fits, self.symbols = fits, symbols
        children: list[dict[int, int]] = [{}]
        self.entry, self.size = [-1], [0]
        for spelled, i in entries:
            node = 0
            for c in spelled:
                found = children[node].get(c)
                if found is None:
                    found = children[node][c] = len(children)
                    children.append({})
                    self.entry.append(-1)
                    self.size.append(self.size[node] + 1)
                node = found
            self.entry[node] = i
        n = len(children)
        self.entry, self.size = np.array(self.entry, np.int64), np.array(self.size, np.int64)
        # moves of every state, the last symbol stands for the end of a word; `ending`: the longest entry that ends
        # in a state, `shorter`: the next one
        self.moves = np.zeros((n, symbols + 1), np.uint16 if n < 2**16 else np.int32)
        self.ending, self.shorter = np.zeros(n, np.int32), np.zeros(n, np.int32)
        fail, level = np.zeros(n, np.int64), []
        for c, child in children[0].items():
            self.moves[0, c] = child
            level.append(child)
        for child in level:
            self.ending[child] = child if self.entry[child] >= 0 else 0
        while level:
            below = []
            for node in level:
                self.moves[node] = self.moves[fail[node]]
                for c, child in children[node].items():
                    fail[child] = self.moves[fail[node], c]
                    self.moves[node, c] = child
                    below.append(child)
            for child in below:
                behind = self.ending[fail[child]]
                if self.entry[child] >= 0:
                    self.ending[child], self.shorter[child] = child, behind
                else:
                    self.ending[child] = behind
            level = below
        self.renew()

    def renew(self) -> None:
        self.keys, self.known = np.full(1, -1, np.int64), np.zeros(1, bool)
        self.late: dict[int, bool] = {}  # pairs met since the arrays were sorted last

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << SHIFT | right
        place = np.searchsorted(self.keys, wanted)
        place[place == len(self.keys)] = 0
        good = self.known[place]
        strange = np.flatnonzero(self.keys[place] != wanted)
        if strange.size:
            new, back = np.unique(wanted[strange], return_inverse=True)
            good[strange] = np.fromiter(map(self._met, new.tolist()), bool, len(new))[back]
            if len(self.late) > 4096 + len(self.keys) // 4:
                self._sort()
        return good

    def _met(self, key: int) -> bool:
        found = self.late.get(key)
        if found is None:
            found = self.late[key] = self.fits(key >> SHIFT, key & ((1 << SHIFT) - 1))
        return found

    def _sort(self) -> None:
        late, self.late = self.late, {}
        if len(self.keys) + len(late) > MOST_PAIRS:
            self.renew()
        keys = np.concatenate((self.keys, np.fromiter(late.keys(), np.int64, len(late))))
        known = np.concatenate((self.known, np.fromiter(late.values(), bool, len(late))))
        order = np.argsort(keys, kind="stable")
        self.keys, self.known = keys[order], known[order]

    def fill(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last token, its length) at every prefix: arrays (word, end) for words as rows of symbols.

        Rows shorter than the longest are padded with `symbols`.
        """
        count, longest = codes.shape
        token, length = np.zeros((count, longest + 1), np.int64), np.zeros((count, longest + 1), np.int64)
        state = np.zeros(count, self.moves.dtype)
        for end in range(1, longest + 1):
            state = self.moves[state, codes[:, end - 1]]
            rows = np.flatnonzero(sizes >= end)
            node = self.ending[state[rows]]
            while rows.size:
                new, size = self.entry[node], self.size[node]
                start = end - size
                good = start == 0
                inner = np.flatnonzero(~good)
                good[inner] = self._fit(token[rows[inner], start[inner]], new[inner])
                done = rows[good]
                token[done, end], length[done, end] = new[good], size[good]
                rows, node = rows[~good], self.shorter[node[~good]]
        return token, length


def padded(flat: np.ndarray, sizes: np.ndarray, symbols: int) -> np.ndarray:
    """Words as rows of symbols, padded with `symbols`; `flat` holds their symbols one word behind the other."""
    codes = np.full((len(sizes), int(sizes.max())), symbols, np.int32)
    codes[np.arange(codes.shape[1]) < sizes[:, None]] = flat
    return codes


def backwards(token: np.ndarray, length: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    """The ids of every word, read from its end."""
    rows, at, found, counts = np.arange(len(sizes)), sizes.copy(), [], np.zeros(len(sizes), np.int64)
    while rows.size:
        ids = np.full(len(sizes), -1, np.int64)
        ids[rows] = token[rows, at[rows]]
        found.append(ids)
        counts[rows] += 1
        at[rows] -= length[rows, at[rows]]
        rows = rows[at[rows] > 0]
    table = np.stack(found[::-1], axis=1) if found else np.zeros((len(sizes), 0), np.int64)
    deep = table.shape[1]
    return [ids[deep - n :] for ids, n in zip(table.tolist(), counts.tolist(), strict=True)]
