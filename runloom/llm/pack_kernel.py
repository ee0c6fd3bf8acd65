"""Pattern packing of a length histogram: non-negative least squares over few-document patterns, then best fit for the rest.

All work is on histograms, so time and memory depend on capacities and not on the number of items. A packing is a list of
(lengths in a container as {length: how often}, number of such containers, whether a pattern made it).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np

#: Length bins of a block and documents of a pattern.
BINS, DOCS = 96, 4
#: Rounds of fitting patterns to what is left; a round that places less than this share of it is the last.
ROUNDS, LEAST_SHARE = 12, 0.02

Group = tuple[dict[int, int], int, int]  # lengths, containers, of which items by patterns


def patterns(bins: list[int], size: int = BINS, docs: int = DOCS) -> list[tuple[int, ...]]:
    """Multisets of at most ``docs`` bins, largest first, that fill ``size`` bins or all but one."""
    out: list[tuple[int, ...]] = []
    bins = sorted(bins, reverse=True)

    def grow(chosen: tuple[int, ...], left: int, start: int) -> None:
        if chosen and left <= 1:
            out.append(chosen)
        if len(chosen) == docs or left <= 0:
            return
        for k in range(start, len(bins)):
            b = bins[k]
            if b > left:
                continue
            if b * (docs - len(chosen)) < left - 1:
                break
            grow((*chosen, b), left - b, k)

    grow((), size, 0)
    return out


def nnls(found: list[tuple[int, ...]], want: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts of patterns whose weighted distance to the histogram ``want`` (by bin) is least.

    An active set: patterns enter one at a time by their gradient, those that would turn negative leave. The solution is
    basic, with no more patterns in use than there are bins."""
    rows = np.zeros((len(found), max(map(len, found))), np.int64)
    for k, p in enumerate(found):
        rows[k, : len(p)] = p
    rows[rows == 0] = len(want)  # a bin beyond all others takes up missing documents
    scale = max(1.0, float(want.max()))
    target = want * weight / scale
    x, used = np.zeros(len(found)), []
    columns: list[np.ndarray] = []

    def column(k: int) -> np.ndarray:
        c = np.zeros(len(want) + 1)
        np.add.at(c, rows[k], 1.0)
        return c[:-1] * weight

    for _ in range(3 * len(want)):
        left = target - (np.stack(columns, 1) @ x[used] if used else 0.0)
        gradient = np.append(left * weight, 0.0)[rows].sum(1)
        gradient[used] = -1.0
        k = int(gradient.argmax())
        if gradient[k] <= 1e-7 * float(weight.max()) or len(used) >= len(want):
            break
        used.append(k)
        columns.append(column(k))
        while True:
            best = np.linalg.lstsq(np.stack(columns, 1), target, rcond=None)[0]
            if best.min() > 0:
                x[used] = best
                break
            at = np.asarray(used)
            low = best <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - best[low], 1e-30))
            x[at] += step * (best - x[at])
            keep = [i for i, u in enumerate(used) if x[u] > 1e-12 and not (low[i] and x[u] <= 1e-9)]
            if len(keep) == len(used):
                keep = [i for i in keep if not low[i]]
            for i, u in enumerate(used):
                if i not in keep:
                    x[u] = 0.0
            used, columns = [used[i] for i in keep], [columns[i] for i in keep]
            if not used:
                break
    return x * scale


class _Lengths:
    """A histogram of lengths with lookup of the longest one that still fits."""

    def __init__(self, hist: dict[int, int]):
        self.n = Counter({k: v for k, v in hist.items() if v > 0})
        self.keys = sorted(self.n)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.keys.pop(bisect_left(self.keys, length))

    def longest(self, limit: float, above: float = 0, taken: dict[int, int] | None = None) -> int | None:
        """The longest length up to ``limit`` and over ``above`` of which more are left than ``taken`` has."""
        k = bisect_left(self.keys, limit + 1) - 1
        while k >= 0 and self.keys[k] > above:
            length = self.keys[k]
            if not taken or self.n[length] > taken.get(length, 0):
                return length
            k -= 1
        return None


def _round(left: _Lengths, size: int, most: int, slack: float) -> list[Group]:
    """Containers from patterns once fitted to ``left``: repeat counts rounded, documents the longest of their bins, the last
    one the longest that then fits; containers that would leave more than ``slack`` unused are not made."""
    width = size / BINS
    want = np.zeros(BINS + 1)
    for length, n in left.n.items():
        want[min(BINS, max(1, -int(-length // width)))] += n
    found = patterns(np.flatnonzero(want).tolist())
    if not found:
        return []
    repeats = np.floor(nnls(found, want, np.sqrt(np.arange(BINS + 1) + 1.0)) + 0.5).astype(np.int64)
    out: list[Group] = []
    for k in np.argsort(-repeats, kind="stable").tolist():
        x = min(int(repeats[k]), most)
        while x > 0:
            chosen: dict[int, int] = {}
            room = size
            for b in found[k][:-1]:
                length = left.longest(min(room, b * width), (b - 1) * width, chosen)
                if length is None:
                    break
                chosen[length] = chosen.get(length, 0) + 1
                room -= length
            else:
                length = left.longest(room, 0, chosen)
                if length is not None and room - length <= slack:
                    chosen[length] = chosen.get(length, 0) + 1
                    m = min(x, *(left.n[a] // c for a, c in chosen.items()))
                    for a, c in chosen.items():
                        left.take(a, m * c)
                    out.append((chosen, m, sum(chosen.values())))
                    x, most = x - m, most - m
                    continue
            break
    return out


def _fit(left: _Lengths, size: int, most: int | None = None) -> list[Group]:
    """At most ``most`` containers from patterns, fitted again and again to what the round before left over."""
    out: list[Group] = []
    for k in range(ROUNDS):
        items = sum(left.n.values())
        if not items:
            break
        made = _round(left, size, (1 << 62) if most is None else most - sum(n for _, n, _ in out), max(1.0, size / BINS / 4 * (1 + k // 3)))
        out += made
        if sum(n * by for _, n, by in made) < LEAST_SHARE * items and k % 3 == 2:
            break
    return out


def _best_fit(open_: list[Group], left: _Lengths, capacity: int, new: bool = True) -> list[Group]:
    """Remaining lengths, longest first, into the container with the least room that suffices, new ones where none does."""
    gaps: dict[int, list[list]] = {}
    order: list[int] = []
    done: list[Group] = []
    least = left.keys[0] if left.keys else capacity + 1

    def put(lengths: dict[int, int], n: int, by: int) -> None:
        gap = capacity - sum(a * c for a, c in lengths.items())
        if gap < least:
            done.append((lengths, n, by))
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append([lengths, n, by])

    for group in open_:
        put(*group)
    for length in list(reversed(left.keys)):
        n = left.n[length]
        while n > 0:
            k = bisect_left(order, length)
            if k < len(order):
                gap = order[k]
                entry = gaps[gap][-1]
                m = min(n, entry[1])
                each = 1
                if m == entry[1]:  # all containers of the group take as many as fit
                    each = max(1, min(gap // length, n // m))
                entry[1] -= m
                if not entry[1]:
                    gaps[gap].pop()
                    if not gaps[gap]:
                        del gaps[gap]
                        order.pop(k)
                put(entry[0] | {length: entry[0].get(length, 0) + each}, m, entry[2])
                n -= m * each
                left.take(length, m * each)
            elif new:
                each = max(1, capacity // length)
                m, rest = divmod(n, each)
                left.take(length, n)
                if m:
                    put({length: each}, m, 0)
                if rest:
                    put({length: rest}, 1, 0)
                n = 0
            else:
                break
    return done + [(e[0], e[1], e[2]) for g in order for e in gaps[g]]


def _join(blocks: list[Group], capacity: int, each: int) -> list[Group]:
    """Blocks put together, ``each`` to a container, those that hold most beside those that hold least."""
    if each == 1:
        return blocks
    size = lambda g: sum(a * c for a, c in g[0].items())
    out: list[Group] = []
    rest: list[list] = []
    for lengths, n, by in sorted(blocks, key=lambda g: (-size(g), sorted(g[0].items()))):
        m, over = divmod(n, each)
        if m and each * size((lengths,)) <= capacity:
            out.append(({a: c * each for a, c in lengths.items()}, m, by * each))
        else:
            over = n
        if over:
            rest.append([lengths, over, by, size((lengths,))])
    # what is left, in order of size: containers take one group after the other, as many at once as possible
    while rest:
        lengths, used, by, held = Counter(), 0, 0, 0
        takes: list[tuple[int, int]] = []
        for k, (some, n, made, s) in enumerate(rest):
            c = min(n, each - held, (capacity - used) // s if s else each)
            if c > 0:
                takes.append((k, c))
                used, held, by = used + c * s, held + c, by + c * made
                for a, q in some.items():
                    lengths[a] += c * q
            if held == each:
                break
        m = min(rest[k][1] // c for k, c in takes)
        for k, c in takes:
            rest[k][1] -= m * c
        out.append((dict(lengths), m, by))
        rest = [r for r in rest if r[1]]
    return out


def pack(hist: dict[int, int], capacity: int) -> list[Group]:
    """A packing of all lengths of ``hist`` (1 to capacity) into containers of ``capacity``.

    Where containers hold many items, patterns are made for blocks, equal parts of a container that three items of middling
    length fill, and blocks are joined. A capacity need not be a multiple of its blocks: where tokens are left over, so many
    blocks of a container are one token longer. Items longer than a block have containers of their own, which others fill up."""
    hist = {int(k): int(v) for k, v in hist.items() if v > 0}
    if not hist:
        return []
    keys = sorted(hist)
    total = sum(hist.values())
    half, median = 0, keys[-1]
    for k in keys:
        half += hist[k]
        if 2 * half >= total:
            median = k
            break
    each = 1
    while capacity // (2 * each) >= (DOCS - 1) * median:
        each *= 2
    block, longer = divmod(capacity, each)
    small = _Lengths({k: v for k, v in hist.items() if k <= block})
    big = _Lengths({k: v for k, v in hist.items() if k > block})
    out: list[Group] = []
    if big.keys:
        with_big = _best_fit(_fit(big, capacity), big, capacity)
        out = _best_fit(with_big, small, capacity, new=False)
    blocks: list[Group] = []
    if longer:
        tokens = sum(k * n for k, n in small.n.items())
        blocks = _fit(small, block + 1, longer * -(-tokens // capacity))
    blocks += _fit(small, block)
    return _best_fit(out + _join(blocks, capacity, each), small, capacity)


def places(packing: list[Group]) -> np.ndarray:
    """Rows (length, first rank, container of that rank, items of that length in a container, tokens used, items of the container that patterns placed) sorted
    by length and rank: where the items of each length go.

    Items of one length are ranked from 0; a row holds for ranks up to the next row's, and as many as it says share a container."""
    rows, base = [], 0
    for lengths, n, by in packing:
        used = sum(a * c for a, c in lengths.items())
        for length, c in lengths.items():
            rows.append((length, n * c, base, c, used, by))
        base += n
    a = np.array(rows, np.int64).reshape(-1, 6)
    a = a[np.argsort(a[:, 0], kind="stable")]
    ends = np.cumsum(a[:, 1])
    firsts = ends - a[:, 1]
    starts = np.searchsorted(a[:, 0], a[:, 0], "left")
    a[:, 1] = firsts - firsts[starts] if len(a) else firsts
    return a
