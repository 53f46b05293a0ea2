"""Byte-pair contraction of one word: always the leftmost pair of the smallest rank."""

from __future__ import annotations

import heapq


def contract(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """pairs: (left, right) -> (rank, merged id)."""
    if len(ids) > 40:
        return _contract_long(ids, pairs)
    get = pairs.get
    found = [get(p) for p in zip(ids, ids[1:], strict=False)]
    while True:
        best, at = None, -1
        for k, f in enumerate(found):
            if f is not None and (best is None or f[0] < best[0]):
                best, at = f, k
        if best is None:
            return ids
        ids[at : at + 2] = [best[1]]
        del found[at]
        if at:
            found[at - 1] = get((ids[at - 1], ids[at]))
        if at < len(found):
            found[at] = get((ids[at], ids[at + 1]))


def _contract_long(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The same by a heap over a linked list, for long words."""
    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(f[0], k, a, b) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (f := pairs.get((a, b)))]
    heapq.heapify(heap)
    while heap:
        _, k, a, b = heapq.heappop(heap)
        j = after[k]
        if not alive[k] or j >= n or ids[k] != a or ids[j] != b:
            continue
        ids[k] = pairs[a, b][1]
        alive[j] = False
        after[k] = after[j]
        if after[k] < n:
            before[after[k]] = k
        for left, right in ((before[k], k), (k, after[k])):
            if left >= 0 and right < n and (f := pairs.get((ids[left], ids[right]))):
                heapq.heappush(heap, (f[0], left, ids[left], ids[right]))
    return [x for k, x in enumerate(ids) if alive[k]]
