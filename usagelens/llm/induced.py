"""Suffix arrays with common-prefix values by external induced sorting.

Each level finds the S* positions of its string, names the substrings between them in order, sorts the shorter
string of names (by recursion, or by doubling once it fits in memory), and induces the order of the L and then
of the S suffixes from that of the S* suffixes. The induction is driven by a priority queue of tuples (first
symbol, rank of the suffix that follows, position), which keeps at most ``memory`` tuples and else sorted runs
on disk; it is drained a symbol's round at a time, so that each step works on arrays. Common-prefix values go
the same way: two induced neighbours share one symbol more than the least value between the suffixes that
induced them, where an L and an S suffix meet the shorter run of their symbol decides, and those of S* suffixes
come from the values of the names. The string, its types, and all arrays over ``memory`` entries lie in files; runs of the queue are
read a symbol at a time and never written again. The names of a level are in memory while they are sorted.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict

import numpy as np

#: Entries an array or queue may hold in memory.
MEMORY = 1 << 19
#: Names that are sorted by doubling rather than by a further level.
BASE = 4 << 20


class Space:
    """Arrays in memory or, where large, in scratch files of the task that lose their names at once, so that they go with the array or the process.

    Counts what was spilled and how deep the recursion went. ``kind`` holds any place of the string.
    """

    def __init__(self, memory: int, n: int):
        self.memory, self.spills, self.levels = memory, 0, 0
        self.kind = np.int32 if n < 1 << 30 else np.int64

    def file(self, kind: type, shape: tuple[int, ...]) -> np.ndarray:
        with tempfile.TemporaryFile(prefix="induced-") as f:
            return np.memmap(f, kind, "w+", shape=shape)

    def array(self, n: int, kind: type) -> np.ndarray:
        return np.zeros(n, kind) if n <= self.memory else self.file(kind, (n,))


class Run:
    """Tuples on disk by symbol, each symbol's in the order of rank; read a symbol at a time, never written again."""

    def __init__(self, space: Space, held: dict[int, list[np.ndarray]], count: int):
        self.symbols = np.array(sorted(held))
        sizes = np.array([sum(map(len, held[c])) for c in self.symbols.tolist()])
        self.ends = np.cumsum(sizes)
        self.rows = space.file(space.kind, (count, 2))
        at = 0
        for c in self.symbols.tolist():
            for part in held[c]:
                self.rows[at : at + len(part)] = part
                at += len(part)
        self.taken: int | None = None

    def take(self, symbol: int) -> np.ndarray | None:
        if self.taken == symbol:
            return None
        i = int(np.searchsorted(self.symbols, symbol))
        if i == len(self.symbols) or self.symbols[i] != symbol:
            return None
        self.taken = symbol
        return np.array(self.rows[self.ends[i - 1] if i else 0 : self.ends[i]])


class Queue:
    """A priority queue of (symbol, rank, position). Pushes come in the order of rank and symbols are drained in order, so each symbol's tuples are the runs' and then those held."""

    def __init__(self, space: Space):
        self.space, self.held, self.count = space, defaultdict(list), 0
        self.runs: list[Run] = []

    def push(self, symbol: np.ndarray, rank: np.ndarray, place: np.ndarray) -> None:
        if not len(symbol):
            return
        order = np.argsort(symbol.astype(np.uint16) if symbol.max() < 1 << 16 else symbol, kind="stable")
        symbol, rows = symbol[order], np.column_stack([rank[order], place[order]]).astype(self.space.kind)
        cuts = np.flatnonzero(np.diff(symbol)) + 1
        for s, part in zip(symbol[np.append(0, cuts)].tolist(), np.split(rows, cuts), strict=True):
            self.held[s].append(part)
        self.count += len(rows)
        if self.count > self.space.memory:
            self.runs.append(Run(self.space, self.held, self.count))
            self.space.spills += 1
            self.held, self.count = defaultdict(list), 0

    def pop(self, symbol: int) -> np.ndarray | None:
        """All tuples of the symbol so far, in the order of rank: (rank, position)."""
        parts = [x for x in (r.take(symbol) for r in self.runs) if x is not None]
        held = self.held.pop(symbol, [])
        self.count -= sum(map(len, held))
        parts += held
        return np.concatenate(parts) if parts else None


def dense(x: np.ndarray) -> np.ndarray:
    """The values' ranks from 0 without gaps, equal ones alike. The values go from 0 to no more than some times their number."""
    there = np.zeros(int(x.max(initial=0)) + 1, bool)
    there[x] = True
    return (np.cumsum(there, dtype=np.int32 if len(there) < 1 << 31 else np.int64) - 1)[x]


def doubled(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common-prefix values of a string that fits in memory, whose symbols are as in ``dense``."""
    n = len(s)
    rank = dense(s)
    ranks, k = [rank], 1
    while True:
        key = rank.astype(np.int64)
        key *= n + 1
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, rank.dtype)
        rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1]), dtype=rank.dtype)
        del key
        if rank[order[-1]] == n - 1:
            break
        ranks.append(rank)
        k *= 2
    order = order.astype(rank.dtype)
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, rank.dtype)
    for j in range(len(ranks) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[ok] = ranks[j][a[ok]] == ranks[j][b[ok]]
        # rank j tells the first 2^j symbols apart only where they aren't cut off by the end, which is unique
        same &= (a + (1 << j) <= n) & (b + (1 << j) <= n)
        step = same * (1 << j)
        lcp[1:] += step
        a += step
        b += step
    return order, lcp


def names_of(t: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each start to the next (both included); equal ones share a rank. A substring's extensions come before it."""
    ends = np.append(starts[1:], len(t) - 1)
    bits = int(t.max() + 2).bit_length()
    per, pad = max(1, 63 // bits), np.uint64((1 << bits) - 1)
    n = len(starts)
    name, active, r = np.zeros(n, starts.dtype), np.arange(n, dtype=starts.dtype), 0
    while len(active):
        key = np.zeros(len(active), np.uint64)
        for j in range(per):
            at = starts[active] + r * per + j
            inside = at <= ends[active]
            key = key << np.uint64(bits) | np.where(inside, t[np.where(inside, at, 0)].astype(np.uint64), pad)
        order = np.lexsort((key, name[active])) if r else np.argsort(key)
        active, key = active[order], key[order]
        old = name[active]
        group = np.append(True, old[1:] != old[:-1])
        fresh = group | np.append(True, key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0))
        head = np.maximum.accumulate(np.where(group, np.arange(len(active)), 0))
        name[active] = old + first - head
        size = np.diff(np.append(np.flatnonzero(fresh), len(active)))
        r += 1
        more = np.repeat(size > 1, size) & (starts[active] + r * per <= ends[active])
        active = active[more]
    return dense(name)


def shared(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at a and b share, by comparing them."""
    out, on, n = np.zeros(len(a), a.dtype), np.arange(len(a), dtype=a.dtype), len(t)
    while len(on):
        i, j = a[on] + out[on], b[on] + out[on]
        inside = (i < n) & (j < n)
        on, i, j = on[inside], i[inside], j[inside]
        on = on[t[i] == t[j]]
        out[on] += 1
    return out


def between(values: np.ndarray, ranks: np.ndarray, before: int) -> np.ndarray:
    """Least of values[r' + 1 .. r] for each rank r and the one before it; the first counts from ``before``."""
    edges = np.append(before, ranks[:-1]) + 1 - (before + 1)
    return np.minimum.reduceat(values[before + 1 : ranks[-1] + 1], edges)


#: Positions that one step of a pass over a string works on.
CHUNK = 1 << 20


def types(t: np.ndarray, space: Space) -> np.ndarray:
    """Whether each suffix is of type S, from the end to the front in chunks."""
    n = len(t)
    out = space.array(n, np.bool_)
    out[n - 1] = True
    after = True  # the type of what follows the chunk
    for a in range((n - 2) // CHUNK * CHUNK, -1, -CHUNK):
        b = min(n - 1, a + CHUNK)
        x, y = np.asarray(t[a:b]), np.asarray(t[a + 1 : b + 1])
        # Each position goes by the first unequal neighbours at or after it.
        first = np.where(x != y, np.arange(b - a), b - a)[::-1]
        first = np.minimum.accumulate(first)[::-1]
        out[a:b] = np.append(x < y, after)[first]
        after = bool(out[a])
    return out


def level(t: np.ndarray, space: Space, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common-prefix values (with the suffix before) of t, whose last symbol is the only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    space.levels += 1
    is_s = types(t, space)
    found = []
    for a in range(0, n, CHUNK):
        here = np.asarray(is_s[a : a + CHUNK])
        before = np.append(is_s[a - 1] if a else True, here[:-1])
        found.append((a + np.flatnonzero(here & ~before)).astype(space.kind))
    star = np.concatenate(found)
    del found, here, before

    def run_of(p: int) -> int:
        """Equal symbols from p on."""
        size, width = 0, 64
        while True:
            part = np.asarray(t[p + size : p + size + width])
            other = np.flatnonzero(part != t[p])
            if len(other):
                return size + int(other[0])
            size += len(part)
            if p + size >= n:
                return size
            width *= 2

    names = names_of(t, star)
    if names.max() == len(star) - 1:
        order, same = np.argsort(names), np.zeros(len(star), space.kind)
    elif len(star) <= base:
        order, same = doubled(names)
    else:
        order, same = level(names, space, base)
    del names
    seeds = star[order]
    whole = star[np.minimum(order + same, len(star) - 1)] - seeds  # what equal names cover
    del star, order, same
    seed_lcp = np.zeros(len(seeds), space.kind)
    if len(seeds) > 1:
        seed_lcp[1:] = whole[1:] + shared(t, seeds[:-1] + whole[1:], seeds[1:] + whole[1:])
    del whole

    symbols, counts = np.unique(t, return_counts=True)
    first_seed = np.searchsorted(t[seeds], symbols)
    last_seed = np.searchsorted(t[seeds], symbols, "right")

    # L suffixes, in ascending order, with the S* suffixes that induce them.
    n_l = int(n - is_s.sum())
    place, lcp = space.array(n_l + len(seeds), space.kind), space.array(n_l + len(seeds), space.kind)
    bounds, q, queue = [], 0, Queue(space)

    def induce_l(a: int, b: int) -> None:
        p = np.asarray(place[a:b])
        on = np.flatnonzero(p > 0)
        before = p[on] - 1
        l_type = ~is_s[before]
        on, before = on[l_type], before[l_type]
        queue.push(t[before], on + a, before)

    for c, fs, ls in zip(symbols.tolist(), first_seed.tolist(), last_seed.tolist(), strict=True):
        start, last = q, None
        while (got := queue.pop(c)) is not None:
            k = len(got)
            place[q : q + k] = got[:, 1]
            if last is None:
                lcp[q] = 0
                if k > 1:
                    lcp[q + 1 : q + k] = 1 + between(lcp, got[1:, 0], int(got[0, 0]))
            else:
                lcp[q : q + k] = 1 + between(lcp, got[:, 0], last)
            last = int(got[-1, 0])
            q += k
            induce_l(q - k, q)
        bounds.append((start, q))
        if fs < ls:
            k = ls - fs
            place[q : q + k], lcp[q : q + k] = seeds[fs:ls], seed_lcp[fs:ls]
            lcp[q] = min(run_of(int(place[q - 1])), run_of(int(place[q]))) if q > start else 0
            q += k
            induce_l(q - k, q)

    # S suffixes, in descending order, with all L suffixes. down[z]: shared with down's entry before.
    down, dlcp = space.array(n, space.kind), space.array(n, space.kind)
    z, queue = 0, Queue(space)

    def induce_s(a: int, b: int) -> None:
        p = np.asarray(down[a:b])
        on = np.flatnonzero(p > 0)
        before = p[on] - 1
        s_type = is_s[before]
        on, before = on[s_type], before[s_type]
        queue.push(t[before], on + a, before)

    for c, (a, b) in zip(symbols.tolist()[::-1], bounds[::-1], strict=True):
        start, last = z, None
        while (got := queue.pop(c)) is not None:
            k = len(got)
            down[z : z + k] = got[:, 1]
            if last is None:
                dlcp[z] = 0
                if k > 1:
                    dlcp[z + 1 : z + k] = 1 + between(dlcp, got[1:, 0], int(got[0, 0]))
            else:
                dlcp[z : z + k] = 1 + between(dlcp, got[:, 0], last)
            last = int(got[-1, 0])
            z += k
            induce_s(z - k, z)
        if c == 0:  # the end of the string follows nothing
            down[z] = n - 1
            z += 1
            induce_s(z - 1, z)
        if a < b:
            k = b - a
            down[z : z + k] = place[a:b][::-1]
            dlcp[z + 1 : z + k] = lcp[a + 1 : b][::-1]
            dlcp[z] = min(run_of(int(down[z - 1])), run_of(int(down[z]))) if z > start else 0
            z += k
            induce_s(z - k, z)
    assert z == n
    out = space.array(n, space.kind)
    out[1:] = dlcp[1:][::-1]
    return down[::-1], out


#: Of this process: queue runs written to disk and the deepest recursion, since it began.
counters = {"spills": 0, "levels": 0}


def suffix_array(t: np.ndarray, memory: int = MEMORY, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common-prefix values) of a string of non-negative symbols, in files where they are over ``memory``."""
    space = Space(memory, len(t))
    string = space.array(len(t) + 1, np.uint16 if not len(t) or int(t.max()) < 65535 else np.int64)
    for a in range(0, len(t), CHUNK):
        part = t[a : a + CHUNK]
        string[a : a + len(part)] = part + 1
    order, lcp = level(string, space, base)
    counters["spills"] += space.spills
    counters["levels"] = max(counters["levels"], space.levels)
    order, lcp = order[1:], lcp[1:]
    if len(lcp):
        lcp[0] = 0
    return order, lcp
