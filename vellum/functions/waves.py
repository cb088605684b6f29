"""Edit distance and affine alignment of many texts at once, one antidiagonal at a time.

The cells of an antidiagonal do not depend on each other, so a numpy operation does those
of all texts of a group.  Only diagonals near the main one are computed; the score found
proves that no path beyond them is as good, else the band is widened to where it does.
Results, ties included, are those of ``distance.edits`` and ``affine.align``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from vellum.functions import reaches
from vellum.functions.affine import Spans, align

#: Cells of an antidiagonal of a group, and cells that are held for tracing.
FRONT, HELD = 1 << 14, 1 << 23
BAND = 32
Job = tuple[int, np.ndarray, np.ndarray, int]  # number, codes of both texts, band


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def reach(n: int, m: int, w: int) -> tuple[int, int]:
    """First and last diagonal ``j - i`` of a band, not beyond the table."""
    return max(-n, min(0, m - n) - w), min(m, max(0, m - n) + w)


def groups(jobs: list[Job], held: int) -> Iterator[tuple[list[Job], int, int]]:
    """Jobs of like size, with the diagonals that hold all their bands."""
    jobs = sorted(jobs, key=lambda job: (len(job[1]) + len(job[2]), job[3]))
    group, low, high = [], 0, 0
    for job in jobs:
        lo, hi = reach(len(job[1]), len(job[2]), job[3])
        lo, hi = (min(low, lo), max(high, hi)) if group else (lo, hi)
        steps, places = len(job[1]) + len(job[2]), (hi - lo) // 2 + 1
        if group:
            own = reach(len(group[0][1]), len(group[0][2]), group[0][3])
            alike = steps <= 1.3 * (len(group[0][1]) + len(group[0][2])) + 64 and hi - lo <= 2 * (own[1] - own[0]) + 64
            if not alike or places * (len(group) + 1) > FRONT or places * (len(group) + 1) * steps > held:
                yield group, low, high
                group, (lo, hi) = [], reach(len(job[1]), len(job[2]), job[3])
        group.append(job)
        low, high = lo, hi
    if group:
        yield group, low, high


class Front:
    """Texts of a group, a column each, so that what an antidiagonal compares is two
    contiguous blocks: ``x`` runs backward, ``y`` forward."""

    def __init__(self, group: list[Job], lo: int, hi: int, shift: int):
        self.lo, self.places = lo, (hi - lo) // 2 + 1
        self.n, self.m = max(len(j[1]) for j in group), max(len(j[2]) for j in group)
        self.steps = max(len(j[1]) + len(j[2]) for j in group)
        top = max(int(t.max()) for j in group for t in j[1:3]) + 3
        kind = np.int16 if top << shift < 1 << 15 and self.steps < 7000 else np.int32
        self.kind, self.size = kind, len(group)
        pad = self.places + max(-lo, hi) + 4
        self.pad = pad
        self.x = np.full((self.n + self.steps + 2 * pad, self.size), 1 << shift, kind)
        self.y = np.full((self.m + self.steps + 2 * pad, self.size), 2 << shift, kind)
        for b, (_, x, y, _) in enumerate(group):
            self.x[len(self.x) - pad - len(x) : len(self.x) - pad, b] = ((x[::-1] + 3) << shift) if shift else x[::-1] + 3
            self.y[pad : pad + len(y), b] = ((y + 3) << shift) if shift else y + 3

    def differ(self, t: int, out: np.ndarray, first: int = 0) -> np.ndarray:
        """Of the cells ``(i, j)`` with ``i + j = t``, by diagonal from a first one, 0 where a[i-1] = b[j-1]."""
        odd = (t - self.lo) & 1
        k = self.lo + odd + 2 * first
        i, j = (t - k) // 2, (t + k) // 2
        at, by = len(self.x) - self.pad - i, self.pad + j - 1
        return np.bitwise_xor(self.x[at : at + len(out)], self.y[by : by + len(out)], out=out)


def front_distances(group: list[Job], lo: int, hi: int) -> list[int]:
    """Edit distances of a group over paths within the band."""
    f = Front(group, lo, hi, 0)
    far = f.kind(16000 if f.kind is np.int16 else 1 << 29)
    sides = [np.full((f.places + 2, f.size), far, f.kind) for _ in range(2)]
    cost, near = np.empty((f.places, f.size), f.kind), np.empty((f.places, f.size), f.kind)
    one = f.kind(1)
    last: dict[int, list[int]] = {}
    for b, (_, x, y, _) in enumerate(group):
        last.setdefault(len(x) + len(y), []).append(b)
    found = [0] * f.size
    sides[-lo & 1][(-lo >> 1) + 1] = 0
    for t in range(1, f.steps + 1):
        odd = (t - lo) & 1
        own, other = sides[odd], sides[1 - odd]
        here = own[1:-1]
        np.minimum(f.differ(t, cost), one, out=cost)
        np.add(here, cost, out=here)
        np.minimum(other[odd : f.places + odd], other[odd + 1 : f.places + odd + 1], out=near)
        np.add(near, one, out=near)
        np.minimum(here, near, out=here)
        if t in last:
            for b in last[t]:
                found[b] = int(here[(len(group[b][2]) - len(group[b][1]) - lo) >> 1, b])
    return found


class Waves:
    """Scores of a group's alignments, doubled, by antidiagonals; those that do not fit are
    computed again from states at intervals."""

    def __init__(self, group: list[Job], lo: int, hi: int, scores: tuple[int, int, int], local: bool, held: int):
        self.open, self.extend, self.match = scores
        self.front, self.lo, self.local = Front(group, lo, hi, self.match.bit_length() - 1), lo, local
        f = self.front
        if f.kind is np.int16 and self.match * f.steps > 1 << 14:
            f.x, f.y, f.kind = f.x.astype(np.int32), f.y.astype(np.int32), np.int32
        self.low = f.kind(-(1 << 14) if f.kind is np.int16 else -(1 << 29))
        self.every = max(1, held // (f.places * f.size) - 2)
        self.marks: list[tuple[np.ndarray, ...]] = []
        self.blocks: dict[int, np.ndarray] = {}

    def block(self, number: int) -> np.ndarray:
        """Rows ``number * every - 2`` up to ``(number + 1) * every``, not included."""
        if number not in self.blocks:
            if len(self.blocks) > 2:
                del self.blocks[max(self.blocks)]
            self.blocks[number] = self.run(number, self.marks[number])[0]
        return self.blocks[number]

    def run(self, number: int, state: tuple[np.ndarray, ...]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        f = self.front
        best = [s.copy() for s in state[:2]]  # of both parities, with a row beyond either end
        gaps = [[s.copy() for s in state[2:4]], [s.copy() for s in state[4:6]]]  # by parity: gap in a, gap in b
        first, stop = number * self.every, min(f.steps + 1, (number + 1) * self.every)
        rows = np.empty((stop - first + 2, f.places, f.size), f.kind)
        for back in (2, 1):
            rows[2 - back] = best[(first - back - self.lo) & 1][1:-1]
        cost, new = np.empty((f.places, f.size), f.kind), np.empty((f.places, f.size), f.kind)
        opened = np.empty((f.places + 2, f.size), f.kind)
        match, opening, extend = f.kind(self.match), f.kind(self.open), f.kind(self.extend)
        for t in range(first, stop):
            odd = (t - self.lo) & 1
            here, other = best[odd], best[1 - odd]
            np.minimum(f.differ(t, cost), match, out=cost)
            np.subtract(here[1:-1], cost, out=new)
            np.add(new, match, out=new)
            np.add(other, opening, out=opened)
            for g, at in ((0, odd), (1, odd + 1)):
                out = gaps[odd][g][1:-1]
                np.add(gaps[1 - odd][g][at : at + f.places], extend, out=out)
                np.maximum(out, opened[at : at + f.places], out=out)
                np.maximum(out, self.low, out=out)
                np.maximum(new, out, out=new)
            if self.local:
                np.maximum(new, 0, out=new)
            here[1:-1] = new
            rows[t - first + 2] = new
        return rows, (*best, *gaps[0], *gaps[1])

    def forward(self) -> Iterator[tuple[int, np.ndarray]]:
        """First step and rows of each block; states are kept, and of blocks the last."""
        f = self.front
        zero, low = np.zeros((f.places + 2, f.size), f.kind), np.full((f.places + 2, f.size), self.low, f.kind)
        zero[0] = zero[-1] = self.low
        state = (zero, zero, low, low, low, low)
        for number in range(-(-(f.steps + 1) // self.every)):
            self.marks.append(state)
            rows, state = self.run(number, state)
            self.blocks = {number: rows}
            yield number * self.every, rows[2:]

    def cells(self, t: np.ndarray, k: np.ndarray, b: int) -> np.ndarray:
        """Scores of cells of one text by antidiagonal and diagonal."""
        place, out = (k - self.lo) >> 1, np.empty(len(t), np.int64)
        number = np.maximum(t, 0) // self.every
        for one in np.unique(number)[::-1].tolist():
            pick = number == one
            out[pick] = self.block(one)[t[pick] - one * self.every + 2, place[pick], b]
        return out

    def ends(self, group: list[Job]) -> list[tuple[int, int, int]]:
        """Score and the earliest best end ``(i, j)`` of each alignment."""
        f = self.front
        if self.local:
            top = [(-1, 0, 0)] * f.size  # score, -i, -j
            for first, rows in self.forward():
                for parity in (0, 1):
                    part = rows[parity::2]
                    if not len(part):
                        continue
                    peak, odd = part.max(axis=0), (first + parity - self.lo) & 1
                    most = peak.max(axis=0)
                    for b in range(f.size):
                        if most[b] < max(top[b][0], 1):
                            continue
                        for p in np.flatnonzero(peak[:, b] == most[b]).tolist():
                            t = first + parity + 2 * int((part[:, p, b] == most[b]).argmax())
                            k = self.lo + 2 * p + odd
                            top[b] = max(top[b], (int(most[b]), -((t - k) // 2), -((t + k) // 2)))
            return [(max(s, 0), -i, -j) for s, i, j in top]
        edges = []  # the last row by j, then the last column by i
        for _, x, y, _ in group:
            n, m = len(x), len(y)
            i, j = np.concatenate((np.full(m + 1, n), np.arange(n))), np.concatenate((np.arange(m + 1), np.full(n, m)))
            inside = (j - i >= self.lo) & (j - i < self.lo + 2 * f.places)
            edges.append((i[inside], j[inside]))
        scores = [np.empty(len(i), np.int64) for i, _ in edges]
        for first, rows in self.forward():
            for b, (i, j) in enumerate(edges):
                here = np.flatnonzero((i + j >= first) & (i + j < first + len(rows)))
                scores[b][here] = rows[(i + j)[here] - first, (j - i - self.lo)[here] >> 1, b]
        best = [int(s.argmax()) for s in scores]
        return [(int(s[e]), int(i[e]), int(j[e])) for s, e, (i, j) in zip(scores, best, edges, strict=True)]

    def trace(self, b: int, x: np.ndarray, y: np.ndarray, i: int, j: int) -> Spans:
        spans: Spans = []
        while i and j:
            size, run = 64, 0
            now = int(self.cells(np.array([i + j]), np.array([j - i]), b)[0])
            if self.local and now <= 0:
                break
            while True:  # along the diagonal as far as pairs give the scores
                n = min(size, i - run, j - run)
                at = run + np.arange(n + 1)
                found = self.cells(i + j - 2 * at, np.full(n + 1, j - i), b)
                pair = found[:-1] - found[1:] == np.where(x[i - 1 - at[:-1]] == y[j - 1 - at[:-1]], self.match, 0)
                if self.local:
                    pair &= found[:-1] > 0
                ok = n if pair.all() else int(pair.argmin())
                run, size = run + ok, size * 4
                if ok < n or run == min(i, j):
                    break
            if run:
                if spans and spans[-1][0] == i and spans[-1][2] == j:
                    spans[-1] = (i - run, spans[-1][1], j - run, spans[-1][3])
                else:
                    spans.append((i - run, i, j - run, j))
                i, j = i - run, j - run
                continue
            up = self.gap(b, now, i + j, j - i, 1, i)
            if up:
                i -= up
            else:
                j -= self.gap(b, now, i + j, j - i, -1, j)
        return spans[::-1]

    def gap(self, b: int, now: int, t: int, k: int, side: int, most: int) -> int:
        """Length of the shortest gap that ends here with this score; 0 if none does."""
        room = self.lo + 2 * self.front.places - 1 - k if side > 0 else k - self.lo
        most, done, size = min(most, room), 0, 16
        while done < most:
            g = np.arange(done + 1, min(most, done + size) + 1)
            fit = self.cells(t - g, k + side * g, b) + self.open + (g - 1) * self.extend == now
            if fit.any():
                return int(g[fit.argmax()])
            done, size = done + len(g), size * 4
        return 0


def align_all(pairs: Sequence[tuple[str, str]], mode: str = "local", gap_open: float = -1.0, gap_extend: float = -0.5, match: float = 1.0, free_ends: bool = False, band: int = BAND, held: int = HELD, few: int = 3, near: bool = True) -> list[tuple[float, Spans]]:
    """``affine.align`` of many pairs, with mismatches of 0; ``global`` with free ends only.
    Like texts are told by their reaches first (``near``), the others by antidiagonals."""
    scores = tuple(int(2 * s) for s in (gap_open, gap_extend, match))
    found: list = [None] * len(pairs)
    jobs: list[Job] = []
    for i, (a, b) in enumerate(pairs):
        if a and b and a != b:
            jobs.append((i, codes(a), codes(b), band))
        else:
            found[i] = align(a, b, mode, gap_open, gap_extend, match, 0.0, free_ends)
    if near:
        like, left = reaches.align_near([job[:3] for job in jobs], scores, mode == "local")
        for k, (score, spans) in like.items():
            found[k] = score / 2, spans
        # the band that the score found proves wide enough, but not far beyond what was looked at
        jobs = [(k, x, y, max(band, min(2 * left[k][1], min(len(x), len(y)) - left[k][0] // scores[2] + 1))) for k, x, y, _ in jobs if k in left]
    while jobs:
        again = []
        for group, lo, hi in groups(jobs, held):
            if len(group) < few and len(group[-1][1]) * len(group[-1][2]) < 1 << 20:
                for k, *_ in group:
                    found[k] = align(*pairs[k], mode, gap_open, gap_extend, match, 0.0, free_ends)
                continue
            waves = Waves(group, lo, hi, scores, mode == "local", held)
            first, last = lo, lo + 2 * waves.front.places - 1
            for b, ((k, x, y, w), (score, i, j)) in enumerate(zip(group, waves.ends(group), strict=True)):
                n, m = len(x), len(y)
                # pairs on a path that meets a diagonal beyond the band
                beyond = max(min(n, m - last - 1), min(m, n + first - 1))
                if score > scores[2] * beyond or first <= -n and last >= m:
                    found[k] = score / 2, waves.trace(b, x, y, i, j)
                else:
                    again.append((k, x, y, max(2 * w, min(n, m) - score // scores[2] + 1)))
        jobs = again
    return found


def local_ends(pairs: Sequence[tuple[str, str]], gap_open: float = -1.0, gap_extend: float = -0.5, match: float = 1.0) -> list[tuple[int, int] | None]:
    """Where the best local alignments end first: the earliest end in a and that in b, as
    aligning (a, b) and (b, a) would give; None where nothing aligns."""
    scores = tuple(int(2 * s) for s in (gap_open, gap_extend, match))
    jobs = [(i, codes(a), codes(b), max(len(a), len(b))) for i, (a, b) in enumerate(pairs) if a and b]
    found: list[tuple[int, int] | None] = [None] * len(pairs)
    for group, lo, hi in groups(jobs, 1 << 62):  # nothing is held for tracing
        for (k, *_), end in zip(group, front_ends(group, lo, hi, scores), strict=True):
            found[k] = end
    return found


def front_ends(group: list[Job], lo: int, hi: int, scores: tuple[int, int, int]) -> list[tuple[int, int] | None]:
    """``local_ends`` of a group.  Scores never fall along a diagonal, so its last rise is where
    its best alignments end first."""
    start = Waves(group, lo, hi, scores, True, 1)
    f, parts = start.front, slice(1, -1)
    match, opening, extend = f.kind(start.match), f.kind(start.open), f.kind(start.extend)
    best = [np.zeros((f.places + 2, f.size), f.kind) for _ in range(2)]
    for side in best:
        side[0] = side[-1] = start.low
    gaps = [[np.full((f.places + 2, f.size), start.low, f.kind) for _ in range(2)] for _ in range(2)]
    rise = [np.zeros((f.places, f.size), f.kind) for _ in range(2)]
    room = [np.empty((f.places, f.size), f.kind) for _ in range(3)]
    one, n, m = f.kind(1), f.n, f.m
    for t in range(1, f.steps + 1):
        odd = (t - lo) & 1
        # the diagonals that this antidiagonal meets within the largest table
        p, q = max(0, (max(-t, t - 2 * n) - lo) >> 1), min(f.places, ((min(t, 2 * m - t) - lo) >> 1) + 1)
        if p >= q:
            continue
        cost, new, opened = (r[: q - p] for r in room)
        here, other = best[odd][p + 1 : q + 1], best[1 - odd]
        np.minimum(f.differ(t, cost, p), match, out=cost)
        np.subtract(here, cost, out=new)
        np.add(new, match, out=new)
        for g, at in ((0, p + odd), (1, p + odd + 1)):
            out = gaps[odd][g][p + 1 : q + 1]
            np.add(gaps[1 - odd][g][at : at + q - p], extend, out=out)
            np.add(other[at : at + q - p], opening, out=opened)
            np.maximum(out, opened, out=out)
            np.maximum(new, out, out=new)
        np.subtract(new, here, out=cost)
        np.maximum(here, new, out=here)
        np.minimum(cost, one, out=cost)
        np.multiply(cost, f.kind(t), out=cost)
        np.maximum(rise[odd][p:q], cost, out=rise[odd][p:q])
    k = (lo + 2 * np.arange(f.places) + np.array([[0], [1]]))[:, :, None]
    score, t = np.stack([b[parts] for b in best]), np.stack(rise).astype(np.int64)
    most = score.max(axis=(0, 1))
    far = 1 << 40
    i, j = (np.where(score == most, (t + side * k) // 2, far).min(axis=(0, 1)) for side in (-1, 1))
    return [(int(p), int(q)) if s > 0 else None for s, p, q in zip(most, i, j, strict=True)]


def sound(mode: str, gap_open: float = -1.0, gap_extend: float = -0.5, match: float = 1.0, mismatch: float = 0.0, free_ends: bool = False) -> bool:
    """Whether ``align_all`` takes these scores."""
    doubled = [2 * s for s in (gap_open, gap_extend, match)]
    whole = all(s == int(s) for s in doubled) and max(map(abs, doubled)) <= 64
    return whole and gap_open < 0 and gap_open <= gap_extend <= 0 and match > 0 and mismatch == 0 and int(doubled[2]).bit_count() == 1 and (mode == "local" or free_ends)
