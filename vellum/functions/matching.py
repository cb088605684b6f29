"""Opcodes between two short sequences by longest matching blocks (Ratcliff, Obershelp)."""

from __future__ import annotations

#: Fixed value: from this length on, what is too common in the second text starts no match.
LONG = 200


def blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """``(i, j, n)``: the longest common block, the first in a and then in b, and so again
    on either side of it; in order, neighbours joined."""
    at: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)
    if len(b) >= LONG:
        at = {x: js for x, js in at.items() if len(js) <= len(b) // 100 + 1}
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        size, i, j = 0, alo, blo
        ending: dict[int, int] = {}  # length of the common block that ends at a place in b
        for p in range(alo, ahi):
            new = {q: ending.get(q - 1, 0) + 1 for q in at.get(a[p], ()) if blo <= q < bhi}
            for q, n in new.items():
                if n > size:
                    size, i, j = n, p - n + 1, q - n + 1
            ending = new
        # common signs that start no match may still lengthen one
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            size, i, j = size + 1, i - 1, j - 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if size:
            found.append((i, j, size))
            todo += [(alo, i, blo, j), (i + size, ahi, j + size, bhi)]
    joined: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1] = (*joined[-1][:2], joined[-1][2] + n)
        else:
            joined.append((i, j, n))
    return joined


def opcodes(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """``(tag, i1, i2, j1, j2)`` that turn a into b."""
    out, i, j = [], 0, 0
    for x, y, n in [*blocks(a, b), (len(a), len(b), 0)]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        if n:
            out.append(("equal", x, x + n, y, y + n))
        i, j = x + n, y + n
    return out
