"""Byte-pair merging with a heap over a linked list."""

from __future__ import annotations

from collections.abc import Callable
from heapq import heapify, heappop, heappush


def merge(symbols: list, rank_of: Callable) -> int:
    """Merges adjacent symbols in place, lowest rank first, leftmost on ties; returns the merges made.

    ``rank_of(a, b)`` is the pair's rank or None. The list keeps the merged symbols; symbols that
    were swallowed are removed. A heap entry is stale if its left symbol is gone or its pair's rank
    has changed, so nothing is ever searched for: n symbols take O(n log n).
    """
    n = len(symbols)
    heap = [(r, i) for i in range(n - 1) if (r := rank_of(symbols[i], symbols[i + 1])) is not None]
    if not heap:
        return 0
    heapify(heap)
    after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        rank, i = heappop(heap)
        left, j = symbols[i], after[i]
        if left is None or j >= n or rank_of(left, symbols[j]) != rank:
            continue
        left = symbols[i] = left + symbols[j]
        symbols[j] = None
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank_of(left, symbols[k])) is not None:
                heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := rank_of(symbols[h], left)) is not None:
            heappush(heap, (r, h))
    symbols[:] = [s for s in symbols if s is not None]
    return merges
