"""Which two vocabulary entries the merges leave apart, told from how the entries come about.

Every entry is the last merge of two shorter ones of lower rank. Side by side, the right edge of
the left entry and the left edge of the right one grow in the order of the ranks; the entries
stay apart unless at some moment the two pieces at the border form a pair whose
rank is due before the next merge on either side. A walk up the two edges finds that out.
"""

from __future__ import annotations

NEVER = 1 << 40
SHIFT = 21  # ids are below 2 ** 21


class MergeTree:
    """Entries are added in the order of their ranks, single symbols first."""

    def __init__(self):
        # entry -> ((piece on its edge, rank of the merge that takes the piece in), ...) from the symbol up
        self.starts: dict[int, tuple[tuple[int, int], ...]] = {}
        self.ends: dict[int, tuple[tuple[int, int], ...]] = {}
        self.rank: dict[int, int] = {}
        self.pairs: dict[int, int] = {}

    def symbol(self, entry: int) -> None:
        self.rank[entry] = -1
        self.starts[entry] = self.ends[entry] = ((entry, NEVER),)

    def add(self, entry: int, left: int, right: int, rank: int) -> bool:
        """Add an entry if the merges so far leave its two parts apart; the answer says so."""
        if left not in self.rank or right not in self.rank or entry in self.rank:
            return False
        if self.rank[left] >= rank or self.rank[right] >= rank or not self.apart(left, right):
            return False
        self.rank[entry] = rank
        self.pairs[left << SHIFT | right] = rank
        self.starts[entry] = (*self.starts[left][:-1], (left, rank), (entry, NEVER))
        self.ends[entry] = (*self.ends[right][:-1], (right, rank), (entry, NEVER))
        return True

    def apart(self, left: int, right: int) -> bool:
        """True if the merges of the two entries' symbols end in just these two; unknown ids never merge."""
        ends, starts = self.ends.get(left), self.starts.get(right)
        if ends is None or starts is None:
            return True
        pairs, i, j = self.pairs, 0, 0
        x, due_x = ends[0]
        y, due_y = starts[0]
        while True:
            due = pairs.get(x << SHIFT | y)
            if due is not None and due < due_x and due <= due_y:  # of equal ranks the leftmost merge is first
                return False
            if due_x <= due_y:
                if due_x == NEVER:
                    return True
                i += 1
                x, due_x = ends[i]
            else:
                j += 1
                y, due_y = starts[j]
