"""Spaced-seed matching of evaluation items in documents, over arrays of token hashes.

A seed looks at some positions of a window and ignores the others, so a hit survives replaced words at the ignored
positions. Around hits, document and item are then aligned with a chain of equal tokens that tolerates replaced, added
and missing words, and what they share is counted, apart from words that many items have.
"""

from __future__ import annotations

import numpy as np

# Masks of weight 4 to 7 over spans of 6 to 14 tokens; a 1 is a position looked at.
MASKS = ("1101100111", "11010011011", "1110010101001", "10110010010111", "111011101", "100110101111", "110100101", "1010011001", "100100111", "1011001")
#: A token counts as shared between items, and as no evidence, in more than this share of all items (and in more than two).
COMMON_SHARE = 0.02
#: Tokens in common order and distinct rare tokens among them from which an item, or a passage of it, has leaked. An item that
#: has fewer of either has leaked where all of them are found.
LEAST_TOKENS, LEAST_RARE = 20, 4


def common_above(items: int) -> int:
    """Items that may hold a token before it counts as shared."""
    return max(2, int(np.ceil(COMMON_SHARE * items)))


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _started(n: int, salt: int) -> np.ndarray:
    return np.full(n, np.uint64((salt + 1) * 0xD1B54A32D192ED03 % 2**64), np.uint64)


def seed_hashes(tokens: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the looked-at positions for every window start of a flat token array (uint64)."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = _started(n, salt)
    for i, c in enumerate(mask):
        if c == "1":
            h = _mix(h, tokens[i : i + n])
    return h


class SeedIndex:
    """The seeds of a bounded block of evaluation items that look at one rare token or more.

    Whatever several items share, such as an instruction that all begin with, has no rare token and so no seed; what a few share
    keeps its seeds. Items shorter than every mask have their whole text as a seed."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, flat: np.ndarray, rare: np.ndarray, masks: tuple[str, ...], h: np.ndarray, p: np.ndarray):
        self.ids, self.offsets, self.flat, self.rare, self.masks, self.h, self.p = ids, offsets, flat, rare, masks, h, p
        self.owner = np.repeat(np.arange(len(ids)), np.diff(offsets))
        # whether a token, by some bits of its hash, may be one of an item's, and a rare one
        self.bits = np.uint64((1 << max(16, len(flat).bit_length() + 4)) - 1)
        self.known, self.seldom = np.zeros(int(self.bits) + 1, bool), np.zeros(int(self.bits) + 1, bool)
        self.known[flat & self.bits] = True
        self.seldom[flat[rare] & self.bits] = True
        own = np.unique(np.stack([self.owner[rare], flat[rare].view(np.int64)]), axis=1) if rare.any() else np.empty((2, 0), np.int64)
        self.least_tokens = np.minimum(LEAST_TOKENS, np.diff(offsets))
        self.least_rare = np.clip(np.bincount(own[0], minlength=len(ids)), 1, LEAST_RARE)

    @classmethod
    def build(cls, ids: list[int], tokens: list[np.ndarray], common: np.ndarray) -> SeedIndex:
        """Of items' token hashes; ``common``: the tokens that count as shared, over all items and not this block's alone."""
        lens = np.array([len(t) for t in tokens], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        flat = np.concatenate(tokens).astype(np.uint64) if len(tokens) else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(ids)), lens)
        rare = ~np.isin(flat, common)
        least = min(map(len, MASKS))
        masks = MASKS + tuple("1" * n for n in sorted({int(n) for n in lens if 0 < n < least}))
        hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for k, mask in enumerate(masks):
            h = seed_hashes(flat, mask, k)
            if not len(h):
                continue
            seen = np.zeros(len(h), bool)
            for i, c in enumerate(mask):
                if c == "1":
                    seen |= rare[i : i + len(h)]
            inside = seen & (owner[: len(h)] == owner[len(mask) - 1 :])
            if k >= len(MASKS):  # the whole text of a short item, and no part of a longer one
                inside &= lens[owner[: len(h)]] == len(mask)
            hashes.append(h[inside])
            places.append(np.flatnonzero(inside))
        h, p = np.concatenate(hashes), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        return cls(np.asarray(ids, np.int64), offsets, flat, rare, masks, h[order], p[order])

    def arrays(self) -> tuple:
        """What the index is made of, in plain arrays, to be sent."""
        return self.ids, self.offsets, self.flat, self.rare, self.masks, self.h, self.p

    def hits(self, flat: np.ndarray, doc_of: np.ndarray):
        """(document position, item position) of every seed that documents and items share."""
        at_doc, at_item = [], []
        if len(self.h):
            known, seldom = self.known[flat & self.bits], self.seldom[flat & self.bits]
            for k, mask in enumerate(self.masks):
                n = len(flat) - len(mask) + 1
                if n <= 0:
                    continue
                looked = [i for i, c in enumerate(mask) if c == "1"]
                may, rare = known[looked[0] : looked[0] + n].copy(), seldom[looked[0] : looked[0] + n].copy()
                for i in looked[1:]:
                    may &= known[i : i + n]
                    rare |= seldom[i : i + n]
                may &= rare
                at = np.flatnonzero(may)
                at = at[doc_of[at] == doc_of[at + len(mask) - 1]]
                h = _started(len(at), k)
                for i in looked:
                    h = _mix(h, flat[at + i])
                lo = np.searchsorted(self.h, h, "left")
                found = self.h[np.minimum(lo, len(self.h) - 1)] == h
                at, lo, h = at[found], lo[found], h[found]
                if not len(at):
                    continue
                n = np.searchsorted(self.h, h, "right") - lo
                at_doc.append(np.repeat(at, n))
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at_item.append(self.p[np.repeat(lo, n) + step])
        if not at_doc:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(at_doc), np.concatenate(at_item)

    def overlaps(self, flat: np.ndarray, doc_of: np.ndarray, doc_start: np.ndarray):
        """{(document index, item index): (tokens in common order, distinct rare tokens among them)} of every pair that shares a
        seed and a stretch with both least counts, for such a stretch with most rare tokens. Words put in, left out or
        replaced between equal tokens do no harm. Stretches that hold too few of an item's rare tokens in any order are not aligned."""
        at_doc, at_item = self.hits(flat, doc_of)
        out: dict[tuple[int, int], tuple[int, int]] = {}
        if not len(at_doc):
            return out
        owner, doc = self.owner[at_item], doc_of[at_doc]
        order = np.lexsort((at_doc, owner, doc))
        at_doc, owner, doc = at_doc[order], owner[order], doc[order]
        cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]), [True]]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            dk, ik = int(doc[a]), int(owner[a])
            item = self.flat[self.offsets[ik] : self.offsets[ik + 1]]
            rare = self.rare[self.offsets[ik] : self.offsets[ik + 1]]
            own = np.unique(item[rare])
            least_tokens, least_rare = int(self.least_tokens[ik]), int(self.least_rare[ik])
            best, k = None, a
            while k < b:  # stretches of hits no further apart than the item is long
                reach = WINDOW_SLACK + 2 * len(item)
                e = k
                while e + 1 < b and at_doc[e + 1] - at_doc[e] <= reach and at_doc[e + 1] - at_doc[k] <= 4 * reach:
                    e += 1
                lo, hi = max(int(doc_start[dk]), int(at_doc[k]) - reach), min(int(doc_start[dk + 1]), int(at_doc[e]) + reach)
                if np.isin(own, flat[lo:hi]).sum() >= least_rare:
                    found = common(flat[lo:hi], item, rare)
                    if found[0] >= least_tokens and found[1] >= least_rare and (best is None or found[::-1] > best[::-1]):
                        best = found
                k = e + 1
            if best:
                out[dk, ik] = best
        return out


#: Tokens around a hit that are compared with the item, besides twice its length.
WINDOW_SLACK = 24


def common(doc: np.ndarray, item: np.ndarray, rare: np.ndarray) -> tuple[int, int]:
    """(length, distinct rare tokens) of the longest common subsequence in which rare tokens count most and gaps are short."""
    # chain of equal tokens: dynamic programme over the pairs of equal positions, sorted by document position
    order = np.argsort(item, kind="stable")
    keys = item[order]
    lo, hi = np.searchsorted(keys, doc, "left"), np.searchsorted(keys, doc, "right")
    n = hi - lo
    di = np.repeat(np.arange(len(doc)), n)
    if not len(di):
        return 0, 0
    ij = order[np.repeat(lo, n) + np.arange(len(di)) - np.repeat(np.cumsum(n) - n, n)]
    # only pairs that have another pair nearby on almost the same diagonal can be part of a passage
    weight = np.where(rare[ij], 3.0, 1.0)
    by = np.lexsort((-ij, di))
    di, ij, weight = di[by], ij[by], weight[by]
    score = weight.copy()
    back = np.full(len(di), -1)
    start = 0
    for k in range(1, len(di)):
        while di[k] - di[start] > MAX_GAP:
            start += 1
        if start == k:
            continue
        gi, gj = di[k] - di[start:k], ij[k] - ij[start:k]
        gain = np.where((gi > 0) & (gj > 0) & (gj <= MAX_GAP), score[start:k] - GAP_COST * (gi + gj - 2), -1.0)
        m = int(gain.argmax())
        if gain[m] > 0:
            score[k] += gain[m]
            back[k] = start + m
    k, chain = int(score.argmax()), []
    while k >= 0:
        chain.append(k)
        k = int(back[k])
    picked = ij[chain]
    return len(picked), len(np.unique(item[picked][rare[picked]]))


#: Tokens that may lie between two equal ones, and what each costs a passage.
MAX_GAP, GAP_COST = 14, 0.2
