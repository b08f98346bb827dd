"""Merging sorted runs that arrive as blocks, by a tree of losers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any


class Losers:
    """Cursors over open blocks, least row first. An inner node holds the loser of its match, the top the winner of all.

    A leaf is a run's place: its row is compared with one loser a level when it moves on, so a row costs log2(runs)
    comparisons. Places are doubled, and all matches played again, when more runs are open than there are places.
    """

    def __init__(self) -> None:
        self.rows: list[Iterator | None] = [None]
        self.heads: list[Any] = [None]
        self.free = [0]
        self.tree = [0]

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and x <= y

    def _rebuild(self) -> None:
        n = len(self.heads)
        winners = [0] * n + list(range(n))
        self.tree = [0] * n
        for node in range(n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            first = self._before(a, b)
            winners[node], self.tree[node] = (a, b) if first else (b, a)
        self.tree[0] = winners[1]

    def _replay(self, place: int) -> None:
        node = (place + len(self.heads)) // 2
        while node:
            if self._before(self.tree[node], place):
                self.tree[node], place = place, self.tree[node]
            node //= 2
        self.tree[0] = place

    def head(self) -> Any:
        """The least row of all, or None if no run is open."""
        return self.heads[self.tree[0]]

    def open(self, rows: Iterable) -> None:
        """Add a sorted block."""
        rows = iter(rows)
        if (first := next(rows, None)) is None:
            return
        if not self.free:
            n = len(self.heads)
            self.rows += [None] * n
            self.heads += [None] * n
            self.free = list(range(2 * n - 1, n - 1, -1))
        place = self.free.pop()
        self.rows[place], self.heads[place] = rows, first
        self._rebuild()  # a block is opened once in thousands of rows

    def pop(self) -> Any:
        place = self.tree[0]
        row = self.heads[place]
        self.heads[place] = next(self.rows[place], None)
        if self.heads[place] is None:
            self.rows[place] = None
            self.free.append(place)
        self._replay(place)
        return row


def merge(blocks: Iterable[tuple[Any, Iterable]]) -> Iterator[Any]:
    """All rows of sorted blocks in order. Blocks come as (first row, rows), by first row.

    A block is opened only when its first row is due, so no more are held than there are runs that overlap there.
    """
    tree = Losers()
    for first, rows in blocks:
        while (head := tree.head()) is not None and head < first:
            yield tree.pop()
        tree.open(rows)
    while tree.head() is not None:
        yield tree.pop()
