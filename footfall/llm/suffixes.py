"""Enhanced suffix arrays in numpy: prefix doubling, common-prefix lengths, and the scan for their intervals."""

from __future__ import annotations

import numpy as np


class RepeatArray:
    """The part of a suffix array in which neighbours share at least ``least`` symbols, with what they share.

    ``symbols`` are codes, in any order, of words or bytes. Ends must be marked by codes of their own, so that no match
    runs over them. Doubling goes on only with suffixes that still have an equal, so text without repeats costs one sort.

    ``order``: starts of suffixes, sorted; ``shared[i]``: length of the common prefix of order[i - 1] and order[i], 0
    where it is below ``least``.

    With ``packs`` doubling begins with ``width`` symbols: one number for the symbols from each place on, and in ``ahead`` how many
    of them stand before the first end. An end sorts below all symbols, or it would part suffixes that share more than it has.
    """

    def __init__(self, symbols: np.ndarray, least: int, packs: np.ndarray | None = None, ahead: np.ndarray | None = None, width: int = 1):
        n = len(symbols)
        kind = np.int32 if n < 2**31 - 2 else np.int64
        self.symbols, self.width = symbols, width
        packs = symbols if packs is None else packs
        order = np.argsort(packs, kind="stable") if ahead is None else np.lexsort((ahead, packs))
        start, twin = self._groups(packs[order], None if ahead is None else ahead[order] < width)
        rank = np.empty(n + 1, np.int64)
        rank[order], rank[n] = start, -1
        active, chosen = order[twin], order[twin]
        self.levels = [(width, rank.astype(kind))]
        while len(active):
            key = rank[active] * np.int64(n + 2) + rank[np.minimum(active + width, n)] + 1
            by = np.argsort(key, kind="stable")
            active, key = active[by], key[by]
            start, twin = self._groups(key)
            old_start, _ = self._groups(rank[active])
            rank[active] += start - old_start
            width *= 2
            self.levels.append((width, rank.astype(kind)))
            active = active[twin]
            if width <= least:
                chosen = active
        self.order = chosen[np.argsort(rank[chosen], kind="stable")]
        self.shared = np.zeros(len(chosen), np.int64)
        if len(chosen) > 1:
            self.shared[1:] = self.common(self.order[:-1], self.order[1:])
            self.shared[self.shared < least] = 0

    @staticmethod
    def _groups(ranked: np.ndarray, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For sorted keys: the place where each one's group of equals begins, and whether the group has more than one."""
        n = len(ranked)
        new = np.ones(n, bool)
        new[1:] = ranked[1:] != ranked[:-1]
        if alone is not None:
            new |= alone
            new[1:] |= alone[:-1]
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, n))
        return np.repeat(heads, size), np.repeat(size > 1, size)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b."""
        n = len(self.levels[0][1]) - 1
        a, b, length = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for width, rank in reversed(self.levels):
            step = np.where((rank[np.minimum(a, n)] == rank[np.minimum(b, n)]) & (a < n) & (b < n), width, 0)
            a, b, length = a + step, b + step, length + step
        for _ in range(self.width - 1):  # what is left is shorter than the first level
            step = (a < n) & (b < n)
            step &= self.symbols[np.minimum(a, n - 1)] == self.symbols[np.minimum(b, n - 1)]
            a, b, length = a + step, b + step, length + step
        return length


class StartArray:
    """The same part of a suffix array, but of given suffixes only, none longer than a row of words.

    ``rows``: the bytes from each of ``starts`` on, eight in a number, zeros behind the suffix's end; ``lengths``: its bytes, ``least`` or
    more. Suffixes are sorted by one word after the other, as long as they have an equal, and then by length, so that an end sorts
    below all bytes. ``order`` and ``shared`` as above.
    """

    def __init__(self, starts: np.ndarray, rows: np.ndarray, lengths: np.ndarray, least: int):
        order = np.argsort(rows[:, 0])
        start, twin = RepeatArray._groups(rows[order, 0])
        slots = chosen = np.flatnonzero(twin)
        for k in range(1, rows.shape[1] + 1):
            if not len(slots):
                break
            active = order[slots]
            word = rows[active, k] if k < rows.shape[1] else lengths[active]
            by = np.argsort(word)
            rank = np.empty(len(by), np.int64)
            rank[by], _ = RepeatArray._groups(word[by])
            key = start[slots] * np.int64(len(by) + 1) + rank
            by = np.argsort(key)
            order[slots] = active[by]
            head, twin = RepeatArray._groups(key[by])
            start[slots] = slots[head]
            slots = slots[twin]
            if 8 * (k + 1) <= least:
                chosen = slots
        chosen = order[chosen]
        self.order = starts[chosen]
        self.shared = np.zeros(len(chosen), np.int64)
        if len(chosen) > 1:
            self.shared[1:] = np.minimum(common_bytes(rows[chosen[:-1]], rows[chosen[1:]]), np.minimum(lengths[chosen[:-1]], lengths[chosen[1:]]))
            self.shared[self.shared < least] = 0


def common_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes rows of words have in common from their first on."""
    apart = a ^ b
    unlike = apart != 0
    first = unlike.argmax(1)
    word = apart[np.arange(len(apart)), first]
    ahead = sum((word < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(1, 8))
    return np.where(unlike.any(1), 8 * first + ahead, 8 * a.shape[1])


def longest_at(array: RepeatArray, n: int) -> np.ndarray:
    """For each symbol the length of the longest repeat that starts there, 0 for none."""
    longest = np.zeros(n, np.int64)
    if len(array.order):
        longest[array.order] = np.maximum(array.shared, np.append(array.shared[1:], 0))
    return longest


def union(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """True for each symbol that one of the spans covers."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def intervals(shared: np.ndarray) -> list[tuple[int, int, int]]:
    """The tree of common-prefix intervals, children before parents, by one scan with a stack.

    Each is (length, first, last): the members order[first..last] share ``length`` symbols, and no larger run of
    neighbours shares as many. ``shared[0]`` counts as 0; runs that share nothing are left out.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    values = shared.tolist() + [0]
    for i in range(1, len(values)):
        left = i - 1
        while stack and stack[-1][0] > values[i]:
            length, left = stack.pop()
            out.append((length, left, i - 1))
        if values[i] and (not stack or stack[-1][0] < values[i]):
            stack.append((values[i], left))
    return out


def maximal_intervals(array: RepeatArray, before: np.ndarray) -> np.ndarray:
    """Rows (length, first, last) of the intervals whose members do not all follow the same symbol.

    ``before[i]`` is the code of the symbol ahead of suffix i; ends need codes of their own, so that they differ from all.
    """
    ahead = before[array.order]
    change = np.zeros(len(ahead), np.int64)
    change[1:] = ahead[1:] != ahead[:-1]
    changes = np.cumsum(change)
    found = np.array(intervals(array.shared), np.int64).reshape(-1, 3)
    return found[changes[found[:, 1]] != changes[found[:, 2]]]


def maximal_repeats(array: RepeatArray, before: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Maximal repeats as (length, starts of all occurrences)."""
    return [(size, array.order[a : b + 1]) for size, a, b in maximal_intervals(array, before).tolist()]
