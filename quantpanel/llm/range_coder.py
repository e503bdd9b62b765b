"""Adaptive context-mixing range coder for token ids, many lanes of a block in lockstep.

A block is cut into lanes of consecutive ids. At every step each lane codes one id with a linear mix of three
predictions: an order-2 and an order-1 context each name one id with a confidence, and order 0 is an
adaptive frequency table over the whole vocabulary. Mixing weights are learned per pair of confidences from the
hits so far. All lanes share one model, which starts anew with every block, so blocks decode independently.
"""

from __future__ import annotations

import numpy as np

ORDER0_BITS, MIX_BITS, CONTEXT_BITS = 20, 6, 18
LANE_IDS, MAX_LANES = 256, 4096
BLOCK_IDS = LANE_IDS * MAX_LANES
U = np.uint64
_M32, _T32, _SHIFT, _B0 = U(0xFFFFFFFF), U(1 << 32), U(ORDER0_BITS + MIX_BITS), U(ORDER0_BITS)


# next confidence by 2 * confidence + hit: up by one to 7, else halved
_STEP = np.array([x for s in range(8) for x in (s >> 1, min(s + 1, 7))], np.int64)


class _Model:
    def __init__(self, vocab: int):
        self.vocab = vocab
        self.counts = np.zeros(vocab, np.int64)
        self.next1, self.sure1 = np.zeros(vocab, np.int64), np.zeros(vocab, np.int64)
        self.next2, self.sure2 = np.zeros(1 << CONTEXT_BITS, np.int64), np.zeros(1 << CONTEXT_BITS, np.int64)
        self.seen = np.zeros((128, 4), np.int64)  # per pair of confidences: neither right, order 1 alone, order 2, both
        self.seen[:, 0], self.seen[:, 1], self.seen[:, 2] = 2, 1, 1
        self.refresh(np.zeros(0, np.int64))

    def refresh(self, ids: np.ndarray) -> None:
        """Order-0 frequencies and mixing weights from all that the block has coded so far."""
        if ids.size:
            self.counts += np.bincount(ids, minlength=self.vocab)
        spare, seen = (1 << ORDER0_BITS) - self.vocab, max(1, int(self.counts.sum()))
        f = 1 + self.counts * spare // seen
        f[int(np.argmax(self.counts))] += (1 << ORDER0_BITS) - int(f.sum())
        self.freq, self.cum = f.astype(U), (np.cumsum(f) - f).astype(U)
        self.at = np.repeat(np.arange(self.vocab, dtype=np.int32), f)
        units, tries = (1 << MIX_BITS) - 2, self.seen.sum(axis=1)
        w2, w1 = (self.seen[:, 2] + self.seen[:, 3]) * units // tries, self.seen[:, 1] * units // tries
        w0 = (1 << MIX_BITS) - w1 - w2
        self.w0, self.w1, self.w2 = w0.astype(U), w1.astype(U) << _B0, w2.astype(U) << _B0
        self.inverse = -(-(1 << 40) // w0).astype(U)  # x * inverse >> 40 is x // w0 for x < w0 * 2**20, w0 <= 64

    def predict(self, p1: np.ndarray, p2: np.ndarray) -> None:
        self.p1 = p1
        self.h = ((p1 * 0x9E3779B1 + p2 * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - CONTEXT_BITS)
        self.c1, self.c2, self.s1, self.s2 = self.next1.take(p1), self.next2.take(self.h), self.sure1.take(p1), self.sure2.take(self.h)
        self.ctx = (self.s2 << 4) | (self.s1 << 1) | (self.c1 == self.c2)
        self.v0, self.v1, self.v2 = self.w0.take(self.ctx), self.w1.take(self.ctx), self.w2.take(self.ctx)

    def span(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, width) of id x in the mixed distribution."""
        v0, v1, v2 = self.v0, self.v1, self.v2
        return v0 * self.cum.take(x) + v2 * (x > self.c2) + v1 * (x > self.c1), v0 * self.freq.take(x) + v2 * (x == self.c2) + v1 * (x == self.c1)

    def find(self, v: np.ndarray) -> np.ndarray:
        """The id whose span holds v: order 0 once the spans of the named ids below v are taken out, else a named id."""
        v0, v1, v2, c1, c2 = self.v0, self.v1, self.v2, self.c1, self.c2
        same = c1 == c2
        a2, a1 = v0 * self.cum.take(c2) + v1 * (c2 > c1), v0 * self.cum.take(c1) + v2 * (c1 > c2)
        e2, e1 = a2 + v0 * self.freq.take(c2) + v2 + v1 * same, a1 + v0 * self.freq.take(c1) + v1 + v2 * same
        over2, over1 = v >= e2, v >= e1
        rest = ((v - v2 * over2 - v1 * over1) * self.inverse.take(self.ctx)) >> U(40)
        x = self.at.take(rest.astype(np.int64), mode="clip")
        x = np.where((v >= a1) & ~over1, c1, x)
        return np.where((v >= a2) & ~over2, c2, x)

    def learn(self, x: np.ndarray) -> None:
        hit1, hit2 = x == self.c1, x == self.c2
        self.seen += np.bincount((self.ctx << 2) | (hit2 << 1) | hit1, minlength=512).reshape(128, 4)
        for at, into, sure, s, hit in ((self.p1, self.next1, self.sure1, self.s1, hit1), (self.h, self.next2, self.sure2, self.s2, hit2)):
            swap = np.flatnonzero((s <= 1) > hit)
            into[at.take(swap)] = x.take(swap)
            sure[at] = _STEP.take((s << 1) | hit)


def _refreshes(t: int) -> bool:
    return t in (1, 2, 4, 8) or t % 16 == 0


def _shape(n: int) -> tuple[int, int]:
    lanes = min(MAX_LANES, max(1, n // LANE_IDS))
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray, vocab: int) -> np.ndarray:
    """Little-endian unsigned 32-bit code words of ``ids`` (each below ``vocab``)."""
    n = len(ids)
    if not n:
        return np.zeros(0, "<u4")
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model, p1, p2 = _Model(vocab), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    low, width = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
    who, what, since = [], [], 0
    for t in range(steps):
        if t and _refreshes(t):
            model.refresh(grid[since:t].ravel())
            since = t
        x = grid[t]
        model.predict(p1, p2)
        start, size = model.span(x)
        unit = width >> _SHIFT
        low += unit * start
        width = unit * size
        out = np.flatnonzero(width < _T32)
        if out.size:
            lo = low[out]
            who.append(out)
            what.append((lo >> U(32)).astype("<u4"))
            width[out] = np.minimum(width[out], _T32 - (lo & _M32)) << U(32)
            low[out] = lo << U(32)
        model.learn(x)
        p2, p1 = p1, x
    who, what = (np.concatenate(who), np.concatenate(what)) if who else (np.zeros(0, np.int64), np.zeros(0, "<u4"))
    # a decoder reads two words of each lane first, then stays two words ahead of the encoder
    counts = np.bincount(who, minlength=lanes)
    begin = np.cumsum(counts + 2) - (counts + 2)
    by_lane = np.argsort(who, kind="stable")
    nth = np.empty(len(who), np.int64)
    nth[by_lane] = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
    words = np.empty(len(who) + 2 * lanes, "<u4")
    words[begin[who] + nth] = what
    words[begin + counts] = low >> U(32)
    words[begin + counts + 1] = low & _M32
    return np.concatenate([words[begin], words[begin + 1], words[begin[who] + nth + 2]])


def decode_block(words: np.ndarray, n: int, vocab: int) -> np.ndarray:
    if not n:
        return np.zeros(0, "<u4")
    lanes, steps = _shape(n)
    grid = np.zeros((steps, lanes), np.int64)
    model, p1, p2 = _Model(vocab), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    words = words.astype(U)
    low, width, code, at, since = np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U), (words[:lanes] << U(32)) | words[lanes : 2 * lanes], 2 * lanes, 0
    top = (U(1) << _SHIFT) - U(1)
    for t in range(steps):
        if t and _refreshes(t):
            model.refresh(grid[since:t].ravel())
            since = t
        model.predict(p1, p2)
        unit = width >> _SHIFT
        x = model.find(np.minimum((code - low) // unit, top))
        start, size = model.span(x)
        low += unit * start
        width = unit * size
        out = np.flatnonzero(width < _T32)
        if out.size:
            lo = low[out]
            width[out] = np.minimum(width[out], _T32 - (lo & _M32)) << U(32)
            low[out] = lo << U(32)
            code[out] = (code[out] << U(32)) | words[at : at + out.size]
            at += out.size
        grid[t] = x
        model.learn(x)
        p2, p1 = p1, x
    return np.ascontiguousarray(grid.T).ravel()[:n].astype("<u4")
