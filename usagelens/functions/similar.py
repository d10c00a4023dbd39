"""All pairs of texts whose sequence-matcher ratio is at a threshold or more, within a tile of two blocks of texts.

No pair is left out. A ratio of t needs M >= t/2 x (sum of the lengths) matched characters, in at most k blocks, and so
M - k(q - 1) common q-grams. Two blocks have an unmatched character between them, so k is at most 1 + those unmatched;
where the matcher drops the second text's popular characters (200 characters or more), each block holds one that is
left or is the texts' common start, so k is at most their number and one. Common q-grams are bounded from above by a product of
count vectors, for the pairs that stay by their hashes side by side, then by the longest common subsequence, of which the
matched characters are one. Most texts have the block's greatest length; bounds of pairs of these are a number a text,
so such a text meets those with which it shares enough of its rarest grams, found by an index of the other block.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np

SLOTS, SUB, FEW = 2048, 2048, 8
STEP = 208  # bits of a text in the subsequence's bit vector, the last one free for what is carried
MASKS = 64  # characters of which a block keeps the bits
PAIRS = 4096  # pairs whose hashes lie side by side
INDEXED = (4, 5, 7)  # lengths of the grams of a block's index
LOOK = 500  # hits that take as long as a closer look at a pair
SLOT_BITS = 18  # slots of an index; grams that share one are hits too many, none is lost
HITS, ROWS = 1 << 22, 256  # hits and texts that are counted at once


def most_blocks(text: str) -> int:
    """As many matching blocks as ``text`` can have as the sequence matcher's second: positions of the characters it keeps as starts, and the common start."""
    if len(text) < 200:
        return len(text)
    counts = {c: text.count(c) for c in set(text)}
    return sum(n for n in counts.values() if n <= len(text) // 100 + 1) + 1


class Block:
    """Texts with their lengths, most blocks, gram hashes and vectors, and, when asked for, character masks."""

    def __init__(self, texts: list[str], q: int):
        self.texts, self.q = texts, q
        self.size = np.array([len(t) for t in texts], np.int64)
        self.most = np.array([most_blocks(t) for t in texts], np.int64)
        self.hashes, slots = self._hashes(self.q)
        self.grams = self._vectors(slots)
        #: A text is wanted as the first of pairs whose second one's ``high`` is at its ``low`` or more.
        self.low, self.high = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        #: Which texts have the block's greatest length.
        self.top = self.size == self.size.max(initial=0)
        self._index: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._probes: dict[float, tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]] = {}
        width = min(STEP - 1, int(self.size.max(initial=0)))
        self.codes = np.zeros((len(texts), STEP), np.uint32)
        self.codes[:, :width] = self._codes(int(self.size.max(initial=0)))[:, :width]
        self.inside = np.arange(STEP) < np.minimum(self.size, STEP - 1)[:, None]
        self._masks: dict[int, int] = {}
        self._packed: dict[int, np.ndarray] = {}
        self._own: dict[int, dict[str, int]] = {}

    def _codes(self, width: int) -> np.ndarray:
        return np.frombuffer("".join(t.ljust(width, "\0") for t in self.texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(self.texts), width)

    def _hashes(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of (gram, how many times it came before), 0 where a text has no more, and their slots, ``SLOTS`` there."""
        n, width = len(self.texts), int(self.size.max(initial=0))
        grams = width - q + 1
        if grams < 1:
            return np.zeros((n, 0), np.uint32), np.zeros((n, 0), np.int64)
        c = self._codes(width).astype(np.uint64)
        code = c[:, :grams].copy()
        for i in range(1, q):
            code = code * np.uint64(0x9E3779B97F4A7C15) + c[:, i : grams + i]
        there = np.arange(grams) < (self.size - q + 1)[:, None]
        code[~there] = 0
        code.sort(axis=1)
        there = np.arange(grams) >= (grams - there.sum(1))[:, None]  # those that aren't there are sorted first
        at = np.arange(grams)
        new = np.ones((n, grams), bool)
        new[:, 1:] = code[:, 1:] != code[:, :-1]
        new[:, 1:] |= ~there[:, :-1]
        nth = (at - np.maximum.accumulate(np.where(new, at, 0), axis=1)).astype(np.uint64)
        h = code ^ (nth * np.uint64(0xC2B2AE3D27D4EB4F))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        hashes = np.where(there, (h >> np.uint64(8)).astype(np.uint32) | np.uint32(1), np.uint32(0))
        return hashes, np.where(there, (h & np.uint64(SLOTS - 1)).astype(np.int64), SLOTS)

    def _vectors(self, slots: np.ndarray) -> np.ndarray:
        """Counts of grams by slot: a product of two rows is no less than the common grams. Counts of 255 or more, of longer texts, stay whole."""
        n = len(self.texts)
        row = np.broadcast_to(np.arange(n)[:, None] * (SLOTS + 1), slots.shape)
        counts = np.bincount((row + slots).ravel(), minlength=n * (SLOTS + 1)).reshape(n, SLOTS + 1)[:, :SLOTS]
        return counts.astype(np.uint8 if slots.shape[1] < 256 else np.float32)

    def _slots(self, q: int) -> np.ndarray:
        """The slots of the grams of the texts of the greatest length."""
        return (self._hashes(q)[0][self.top] >> np.uint32(32 - SLOT_BITS)).astype(np.int64)

    def index(self, q: int, slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where each slot's texts of the greatest length begin, and these texts."""
        if q not in self._index:
            slots = self._slots(q) if slots is None else slots
            begin = np.zeros((1 << SLOT_BITS) + 1, np.int32)
            np.cumsum(np.bincount(slots.ravel(), minlength=1 << SLOT_BITS), out=begin[1:])
            texts = (slots << 32 | np.flatnonzero(self.top)[:, None]).ravel()
            texts.sort()
            self._index[q] = begin, texts.astype(np.int32)
        return self._index[q]

    def probes(self, threshold: float) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """For texts of the greatest length as the second of pairs of that length: those whose bound is too low for the index, the hits that a
        pair needs, and by gram length (text, slot) of so many of a text's rarest grams that a pair at the threshold has these hits.

        Of g grams a pair has ``least`` in common, so of any g - least + n it has n. The gram length is the one of the least work in the block itself.
        """
        if threshold not in self._probes:
            rows, top, hits = np.flatnonzero(self.top), int(self.size.max(initial=0)), np.full(len(self.texts), np.iinfo(np.int64).max)
            taken, work, lists = np.zeros(len(rows), np.int64), np.full(len(rows), np.inf), {}
            for q in INDEXED:
                least = least_grams(np.array([2 * top]), self.most[rows], q, threshold)
                if top < q or not (least > 0).any():
                    continue
                slots = self._slots(q)
                begin, _ = self.index(q, slots)
                slots |= (begin[slots + 1] - begin[slots]).astype(np.int64) << 32
                slots.sort(axis=1)
                needs = 1 + np.maximum(least, 0) // 4
                kept = np.arange(slots.shape[1]) < (slots.shape[1] - least + needs)[:, None]
                share = ((slots >> 32) * kept).sum(1) / len(rows)
                # As if hits fell by chance.
                looks = np.minimum(0, needs * np.log(share + 1e-9) - np.cumsum(np.log(np.arange(1, needs.max() + 1)))[needs - 1])
                own = np.where(least > 0, share + LOOK * np.exp(looks), np.inf)
                better = own < work
                work[better], taken[better], hits[rows[better]] = own[better], q, needs[better]
                lists[q] = (slots & ((1 << SLOT_BITS) - 1)).astype(np.int32), kept
            weak = np.zeros(len(self.texts), bool)
            weak[rows[taken == 0]] = True
            for q, (slots, kept) in lists.items():
                at, of = np.nonzero(kept & (taken == q)[:, None])
                lists[q] = rows[at].astype(np.int32), slots[at, of]
            self._probes[threshold] = weak, hits, lists
        return self._probes[threshold]

    def _bits(self, c: int, rows: np.ndarray | None) -> int:
        """Where a character stands in the first ``STEP`` of each text, or of each of ``rows``."""
        if (packed := self._packed.get(c)) is None:
            packed = np.packbits(self.codes == c, axis=1, bitorder="little")
            if len(self._packed) < MASKS:
                self._packed[c] = packed
        return int.from_bytes((packed if rows is None else packed[rows]).tobytes(), "little")

    def may_match(self, text: str, rows: np.ndarray, threshold: float) -> np.ndarray:
        """Which of ``rows`` may have as many characters matched with ``text`` as needed, all in one bit vector.

        Of the first h of ``text`` all but as many are matched as it can have unmatched; looked at after a part of it, then at its end.
        """
        m = needed(self.size[rows] + len(text), threshold)
        most = len(text) if self.size[rows].max() < STEP else max(0, min(len(text), STEP - 1 - int((self.size[rows] - m).max())))
        every = 8 * len(rows) > 7 * len(self.texts)
        among = np.arange(len(self.texts)) if every else rows
        own: dict[int, int] = self._masks if every else {}
        v = inside = int.from_bytes(np.packbits(self.inside[among], axis=1, bitorder="little").tobytes(), "little")
        length, at = self.inside.sum(1)[rows], rows if every else np.arange(len(rows))
        fits, h = np.ones(len(rows), bool), 0
        for to in sorted({min(most, len(text) * k // 16) for k in (11, 13, 16)} | {most}):
            for c in map(ord, text[h:to]):
                if (where := own.get(c)) is None:
                    where = self._bits(c, None if every else rows)
                    if not every or len(own) < MASKS:
                        own[c] = where
                u = v & where
                v = ((v + u) | (v - u)) & inside
            h = to
            left = np.bitwise_count(np.frombuffer(v.to_bytes(len(among) * STEP // 8, "little"), np.uint8).reshape(len(among), -1)).sum(1)
            fits = length - left[at].astype(np.int64) >= h - (len(text) - m)
            if h < most and 8 * np.count_nonzero(fits) < len(rows):
                if fits.any():
                    fits[fits] = self.may_match(text, rows[fits], threshold)
                break
        return fits

    def matches(self, i: int, text: str, m: int) -> bool:
        """Whether the longest common subsequence of ``text`` with the i-th text has ``m`` characters; most texts fall short of it long before their end."""
        if (masks := self._own.get(i)) is None:
            masks = self._own[i] = {}
            for j, c in enumerate(self.texts[i]):
                masks[c] = masks.get(c, 0) | 1 << j
        n = len(self.texts[i])
        v = inside = (1 << n) - 1
        h = len(text) * 5 // 8
        for part in (text[:h], text[h:]):
            for c in part:
                if c in masks and (u := v & masks[c]):
                    v = ((v + u) | (v - u)) & inside
            if n - v.bit_count() + len(text) - h < m:
                return False
            h = len(text)
        return True


def needed(size: np.ndarray, threshold: float) -> np.ndarray:
    """Least matched characters for lengths that add up to ``size``."""
    return np.ceil(size * (threshold - 1e-6) / 2).astype(np.int64)


def least_grams(size: np.ndarray, most: np.ndarray, q: int, threshold: float) -> np.ndarray:
    """Least common grams for lengths that add up to ``size`` and as many blocks at ``most``."""
    m = needed(size, threshold)
    return m - np.minimum(size - 2 * m + 1, most) * (q - 1)


def shared(x: Block, y: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """No less than the grams that x's i-th and y's j-th texts have in common, for each pair."""
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), PAIRS):
        both = np.concatenate([x.hashes[i[k : k + PAIRS]], y.hashes[j[k : k + PAIRS]]], axis=1)
        both.sort(axis=1)
        out[k : k + PAIRS] = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != 0)).sum(1)
    return out


def met(one: Block, other: Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of texts of the greatest length that share enough of the rarest grams of ``other``'s j-th, the second; texts with a low bound left out."""
    _, hits, lists = other.probes(threshold)
    n = len(one.texts)
    for q, (rows, slots) in lists.items():
        begin, texts = one.index(q)
        first = begin[slots]
        often = begin[slots + 1] - first
        total = np.concatenate([[0], np.cumsum(often, dtype=np.int64)])
        at = 0
        while at < len(rows):
            # All the grams of some texts: no more than ROWS of them, nor than HITS hits if it is more than one.
            to = int(np.searchsorted(rows, rows[at] + ROWS))
            if total[to] - total[at] > HITS:
                full = int(np.searchsorted(total, total[at] + HITS, "right")) - 1
                to = int(np.searchsorted(rows, rows[min(full, to - 1)]))
                to = to if to > at else int(np.searchsorted(rows, rows[at], "right"))
            k = int(total[to] - total[at])
            if k:
                of = often[at:to]
                place = np.arange(k) + np.repeat(first[at:to] - (total[at:to] - total[at]), of)
                low = int(rows[at])
                code = np.repeat((rows[at:to] - low).astype(np.int64) * n, of) + texts[place]
                seen = np.bincount(code, minlength=(int(rows[to - 1]) - low + 1) * n).reshape(-1, n)
                j, i = np.divmod(np.flatnonzero(seen >= hits[low : low + len(seen), None]), n)
                yield i, j + low
            at = to


def near(x: Block, y: Block, threshold: float) -> Iterator[tuple[int, int, bool, float]]:
    """(i, j, turned, ratio of x's i-th text to y's j-th as the second, or the other way if turned) at the threshold or more."""
    top, q = int(max(x.size.max(), y.size.max())), x.q
    whole, also = x.size == top, y.size == top
    rows, columns, none = np.flatnonzero(whole), np.flatnonzero(also), np.zeros(0, np.int64)
    found, common, weak = [none], [none], [none, none]
    if len(rows) and len(columns):
        weak = [np.flatnonzero(b.probes(threshold)[0]) for b in (x, y)]
        for i, j in met(x, y, threshold):
            found.append((i * len(y.size) + j)[x.low[i] <= y.high[j]])
        for j, i in met(y, x, threshold) if x is not y else ():
            found.append((i * len(y.size) + j)[y.low[j] <= x.high[i]])
        common = [np.full(sum(map(len, found)), np.iinfo(np.int64).max)]
    # The others, shorter or with a low bound, by all their grams.
    for some, others in ((np.flatnonzero(~whole), np.arange(len(y.size))), (rows, np.flatnonzero(~also)), (weak[0], columns), (rows, weak[1])):
        if len(some) and len(others):
            size = x.size[some][:, None] + y.size[others][None]
            product = x.grams[some].astype(np.float32) @ y.grams[others].astype(np.float32).T
            may = (product >= least_grams(size, y.most[others][None], q, threshold)) & (x.low[some][:, None] <= y.high[others][None])
            may |= (product >= least_grams(size, x.most[some][:, None], q, threshold)) & (y.low[others][None] <= x.high[some][:, None])
            i, j = np.nonzero(may & (np.minimum(x.size[some][:, None], y.size[others][None]) >= needed(size, threshold)))
            found.append(some[i] * len(y.size) + others[j])
            common.append(product[i, j].astype(np.int64))
    code, first = np.unique(np.concatenate(found), return_index=True)
    i, j = np.divmod(code, len(y.size))
    n, size = np.concatenate(common)[first], x.size[i] + y.size[j]
    least = [least_grams(size, b.most[k], q, threshold) for b, k in ((y, j), (x, i))]
    # A bound that few common grams meet isn't worth the looking.
    tell = np.flatnonzero(np.minimum(*least) * 4 > size // 2)
    n[tell] = shared(x, y, i[tell], j[tell])
    ways = [(n >= least[0]) & (x.low[i] <= y.high[j]), (n >= least[1]) & (y.low[j] <= x.high[i])]
    stay = np.flatnonzero(ways[0] | ways[1])
    i, j, ways, m = i[stay], j[stay], [w[stay] for w in ways], needed(size[stay], threshold)
    # Texts with several pairs left are held against all of them at once, those with most first.
    fits, done = np.ones(len(i), bool), np.zeros(len(i), bool)
    for few in (SUB // 4, SUB // 32, FEW):
        for one, other, a, b in ((x, y, i, j), (y, x, j, i)):
            at = np.flatnonzero(~done)
            at = at[np.argsort(a[at], kind="stable")]
            ends = np.searchsorted(a[at], np.arange(len(one.texts) + 1))
            for k in np.flatnonzero(np.diff(ends) > few):
                own = at[ends[k] : ends[k + 1]]
                fits[own] = other.may_match(one.texts[k], b[own], threshold)
                done[own] = True
    for k in np.flatnonzero(fits):
        fits[k] = x.matches(i[k], y.texts[j[k]], int(m[k]))
    x._own.clear()
    for turned, (one, other, a, b) in enumerate(((x, y, i, j), (y, x, j, i))):
        if turned and one is other:
            return
        at = np.flatnonzero(fits & ways[turned])
        at = at[np.argsort(b[at], kind="stable")]
        last, s = -1, None
        for k in at:
            if b[k] != last:
                last, s = b[k], SequenceMatcher(None, "", other.texts[b[k]])
            s.set_seq1(one.texts[a[k]])
            if s.quick_ratio() >= threshold - 1e-6 and (r := s.ratio()) >= threshold - 1e-6:
                yield int(i[k]), int(j[k]), bool(turned), r


def tile(left: list[str], right: list[str] | None, threshold: float, spans: list[np.ndarray] | None = None) -> Iterator[tuple[int, int, bool, float]]:
    """(i, j, turned, ratio) for the texts of two blocks in either order; without ``right``, of a block with itself, equal positions included once.

    With ``spans``, (low, high) of the left texts and of the right, only pairs whose second one's high is at the first one's low or more.
    """
    # Of fewer than 200 characters a text may be matched in as many blocks as it has characters, which shorter grams bear better.
    q = 4 if any(len(t) >= 200 for side in (left, right or ()) for t in side) else 3

    def blocks(side: list[str], span: np.ndarray | None) -> Iterator[Block]:
        for a in range(0, len(side), SUB):
            block = Block(side[a : a + SUB], q)
            if span is not None:
                block.low, block.high = span[:, a : a + SUB]
            yield block

    xs = list(blocks(left, spans and spans[0]))
    # The right side's blocks are made one after the other, so that those of one side lie in memory.
    for b, y in enumerate(xs if right is None else blocks(right, spans and spans[1])):
        for a, x in enumerate(xs[: b + 1] if right is None else xs):
            yield from ((a * SUB + i, b * SUB + j, turned, r) for i, j, turned, r in near(x, y, threshold))
