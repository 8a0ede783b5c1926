"""Hashed n-gram features of whole texts and a logistic regression by follow-the-regularised-leader.

A feature's value is its count over the number of n-grams of its kind in the text, so that a score is the sum of
the weights looked up for each n-gram, divided by that number: texts are scored without sorting their n-grams. All
steps are numpy operations over the bytes or code points of one text.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

BITS = 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_SLICE = 1 << 18  # bytes whose powers are kept
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

with np.errstate(over="ignore"):
    _POWER = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_SLICE, _BASE, np.uint64))])
    _BACK = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_SLICE, pow(_BASE, -1, 1 << 64), np.uint64))])

#: Classes of bytes for the shapes of words: other, lower case, upper case, digit, non-ASCII, and each ASCII sign.
_KIND = np.zeros(256, np.uint64)
for _c in range(0x21, 0x7F):
    _KIND[_c] = 1 if chr(_c).islower() else 2 if chr(_c).isupper() else 3 if chr(_c).isdigit() else 8 + _c
_KIND[0x80:] = 4


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in UTF-8 bytes."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~SPACE[raw]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal words have equal hashes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + _SLICE, "right")))
        if ends[to - 1] - lo <= _SLICE:
            sums = np.concatenate([[np.uint64(0)], np.cumsum((raw[lo : ends[to - 1]].astype(np.uint64) + np.uint64(1)) * _POWER[: ends[to - 1] - lo])])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            out[at:to] = (sums[e] - sums[s]) * _BACK[s]
        else:  # one word longer than a slice
            total, scale = 0, 1
            for p in range(lo, ends[at], _SLICE):
                part = raw[p : min(p + _SLICE, ends[at])].astype(np.uint64) + np.uint64(1)
                total = (total + scale * int(np.sum(part * _POWER[: len(part)], dtype=np.uint64))) % (1 << 64)
                scale = scale * int(_POWER[_SLICE]) % (1 << 64)
            out[at] = total
        at = to
    return mix(out)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n hashes."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mix(out * np.uint64(0x100000001B3) + h[i : len(h) - n + 1 + i])
    return out


def _slots(h: np.ndarray, kind: int, bits: int) -> np.ndarray:
    return ((h * np.uint64(2 * kind + 0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Features:
    """Which n-grams count: of words, of word shapes (first and last two bytes by kind, and whether the word repeats the one before), of characters."""

    words: tuple[int, ...] = (1, 2)
    shapes: tuple[int, ...] = ()
    chars: tuple[int, ...] = ()
    bits: int = BITS

    def slots(self, text: str) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
        """For each kind of n-gram that the text has, their number and the slots of all occurrences, a slice at a time."""
        raw = np.frombuffer(text.encode(), np.uint8)
        s, e = word_spans(raw)
        if not len(s):
            return
        with np.errstate(over="ignore"):
            h = word_hashes(raw, s, e)
            shape = _shapes(raw, s, e, h) if self.shapes else h

        def of(hashes: np.ndarray, n: int, kind: int) -> tuple[int, Iterator[np.ndarray]]:
            def parts() -> Iterator[np.ndarray]:
                for i in range(0, len(hashes) - n + 1, _SLICE):
                    with np.errstate(over="ignore"):
                        part = _slots(grams(hashes[i : i + _SLICE + n - 1], n), kind, self.bits)
                    yield part

            return len(hashes) - n + 1, parts()

        def of_chars(n: int) -> tuple[int, Iterator[np.ndarray]]:
            def parts() -> Iterator[np.ndarray]:
                for i in range(0, len(text) - n + 1, _SLICE):
                    points = np.frombuffer(text[i : i + _SLICE + n - 1].encode("utf-32-le"), np.uint32).astype(np.uint64)
                    with np.errstate(over="ignore"):
                        part = _slots(_char_grams(points, n), 32 + n, self.bits)
                    yield part

            return len(text) - n + 1, parts()

        yield from (of(h, n, n) for n in self.words if len(h) >= n)
        yield from (of(shape, n, 16 + n) for n in self.shapes if len(h) >= n)
        yield from (of_chars(n) for n in self.chars if len(text) >= n)

    def sparse(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct slots and values of a text; none for null and wordless texts.

        The occurrences of a very long text are added up in a table of all slots, in the same order as otherwise.
        """
        found = list(self.slots(text or ""))
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        if sum(n for n, _ in found) > 4 * _SLICE:
            total = np.zeros(1 << self.bits)
            for n, parts in found:
                for part in parts:
                    np.add.at(total, part, 1 / n)
            slots = np.flatnonzero(total)
            return slots.astype(np.int32), total[slots].astype(np.float32)
        parts = [(part, np.full(len(part), 1 / n)) for n, own in found for part in own]
        slots, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        return slots.astype(np.int32), np.bincount(at, np.concatenate([v for _, v in parts])).astype(np.float32)

    def dot(self, text: str | None, weights: np.ndarray) -> float:
        total = 0
        for n, parts in self.slots(text or ""):
            own, at = np.empty(n, weights.dtype), 0
            for part in parts:
                own[at : at + len(part)] = weights[part]
                at += len(part)
            total += own.mean(dtype=np.float64)
        return float(total)


def _shapes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes of the shapes of words, a slice at a time."""
    out = np.empty(len(h), np.uint64)
    for i in range(0, len(h), _SLICE):
        a, z, own = s[i : i + _SLICE], e[i : i + _SLICE], h[i : i + _SLICE]
        again = np.zeros(len(own), np.uint64)
        again[1:] = own[1:] == own[:-1]
        again[0] = i > 0 and h[i - 1] == own[0]
        out[i : i + _SLICE] = mix(_KIND[raw[a]] + (_KIND[raw[z - 1]] << np.uint64(8)) + (_KIND[raw[np.maximum(z - 2, a)]] << np.uint64(16)) + (again << np.uint64(24)))
    return out


def _char_grams(points: np.ndarray, n: int) -> np.ndarray:
    if len(points) < n:
        return points[:0]
    out = points[: len(points) - n + 1]
    for i in range(1, n):
        out = out * np.uint64(0x9E3779B1) + points[i : len(points) - n + 1 + i]
    return out


@dataclass
class Model:
    """Weights, bias, and the two numbers of the calibration 1 / (1 + exp(-(slope * z + shift)))."""

    features: Features
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, text: str | None) -> float:
        return self.features.dot(text, self.weights) + self.bias

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35))))


Row = tuple[np.ndarray, np.ndarray, int, float]


def train_ftrl(rows: Iterable[Row], features: Features, epochs: int = 4, alpha: float = 0.5, beta: float = 0.02, l1: float = 1e-5, l2: float = 1e-4, keep_bytes: int = 200_000_000) -> Model:
    """FTRL-proximal over (slots, values, label, importance) rows in the order given.

    Rows are kept for later epochs: in memory up to ``keep_bytes``, the others in a temporary file that ends with the
    training. Every row is seen in each epoch, in the same order.
    """
    size = 1 << features.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    def learn(row: Row) -> None:
        i, x, y, importance = row
        i, x = np.append(i, size), np.append(x, 1.0)
        w = weight(i)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x * importance
        z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
        n[i] += g * g

    kept, used, more = [], 0, 0
    with tempfile.TemporaryFile() as rest:
        for row in rows:
            learn(row)
            if used < keep_bytes:
                kept.append(row)
                used += row[0].nbytes + row[1].nbytes + 200
            elif epochs > 1:
                pickle.dump(row, rest, pickle.HIGHEST_PROTOCOL)
                more += 1
        for _ in range(epochs - 1):
            for row in kept:
                learn(row)
            rest.seek(0)
            for _ in range(more):
                learn(pickle.load(rest))
    w = weight(np.arange(size + 1))
    return Model(features, w[:-1].astype(np.float32), float(w[-1]))


def calibrate(model: Model, margins: np.ndarray, labels: np.ndarray, importance: np.ndarray, steps: int = 50) -> None:
    """Platt scaling with smoothed targets, by Newton's method; nothing changes unless both labels occur."""
    pos, neg = int((labels == 1).sum()), int((labels == 0).sum())
    if not pos or not neg:
        return
    t = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        d, v = importance * (p - t), importance * p * (1 - p)
        g = np.array([d @ margins, d.sum()])
        h = np.array([[v @ (margins * margins), v @ margins], [v @ margins, v.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    if a > 0:
        model.slope, model.shift = float(a), float(b)
