"""Trigrams that lines share with the lines of a reference, counted exactly, many lines at a time.

A score of ``t`` or more needs ``t / (1 + t)`` of both lines' sizes shared. The reference's commonest trigrams, where nearly all shared ones lie, are
counted for all pairs by one product of matrices; a pair whose count stays under the need, even if the line's other trigrams were all shared, is out.
The few pairs left are counted in full. Nothing is left out of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Trigrams in the product; lines and reference lines in one product.
COMMON, LINES, VERSES = 1024, 256, 2048


def joined(words: pa.ListArray) -> pa.Array:
    """Each line's words as one string, as :func:`inkweave.functions.text.trigrams` joins them; empty for null."""
    out = pc.fill_null(pc.binary_join(words.cast(pa.list_(pa.string())), "_"), "")
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and each text's length."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32), sizes


class Reference:
    """``poem_id``, ``verse`` and ``words`` of the lines to match. The trigrams ``hot`` are left out of the other side. What counting needs is made where it
    is used first, and then kept."""

    def __init__(self, rows: pa.Table, hot: frozenset[str] = frozenset()):
        self.rows, self.hot, self.made = rows.sort_by([("poem_id", "ascending"), ("verse", "ascending")]).combine_chunks(), hot, False

    def __getstate__(self):
        return {"rows": self.rows, "hot": self.hot, "made": False}

    def make(self) -> None:
        if self.made:
            return
        hot = sorted(self.hot)
        points, sizes = _points(pa.concat_arrays([joined(self.rows["words"]), pa.array(hot, pa.string())]))
        self.letters = np.unique(points)
        #: A letter's number; those that the reference doesn't have get theirs for a batch.
        self.code = np.full(0x110000, -1, np.int32)
        self.code[self.letters] = np.arange(len(self.letters))
        line, key, self.bits = self._grams(points, sizes)
        keys, gram, df = np.unique(key, return_inverse=True, return_counts=True)
        cold = np.ones(len(keys), bool)
        cold[gram[line >= len(self.rows)]] = False
        own = line < len(self.rows)
        line, gram = line[own], gram[own]
        order = np.lexsort((-df, ~cold))
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        self.keys, self.place, gram = keys, place, place[gram]
        self.cold = int(cold.sum())
        self.common = min(COMMON, self.cold)
        n = np.bincount(line, minlength=len(self.rows))
        self.by_size = np.argsort(n, kind="stable")
        self.n, at = n[self.by_size], np.empty(len(n), np.int64)
        at[self.by_size] = np.arange(len(n))
        column = at[line]
        self.product = np.zeros((self.common + 1, len(n)), np.float32)
        self.product[gram[gram < self.common], column[gram < self.common]] = 1
        rest = (gram >= self.common) & (gram < self.cold)
        self.rest = np.sort(gram[rest] * len(n) + column[rest])
        self.n_rest = np.bincount(column[rest], minlength=len(n))
        self.made = True

    def _grams(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """line, key of each line's distinct trigrams, by line; and the bits of a letter in a key."""
        code = self.code[points].astype(np.int64)
        letters = len(self.letters)
        if (new := code < 0).any():
            more, codes = np.unique(points[new], return_inverse=True)
            code[new] = letters + codes
            letters += len(more)
        bits = max(1, int(letters).bit_length())
        ends, out, step = np.cumsum(sizes), [], 1 << min(24, 63 - 3 * bits)
        for a in range(0, len(sizes), step):
            of, start = sizes[a : a + step], ends[a] - sizes[a]
            part = code[start : ends[min(a + step, len(sizes)) - 1]]
            if len(part) < 3:
                continue
            line = np.repeat(np.arange(len(of)), of)
            inside = line[2:] == line[:-2]
            key = ((line[:-2] << bits | part[:-2]) << bits | part[1:-1]) << bits | part[2:]
            key = np.sort(key[inside])
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
            out.append(((key >> 3 * bits) + a, key & ((1 << 3 * bits) - 1)))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *[x for x, _ in out]]), np.concatenate([none, *[x for _, x in out]]), bits

    def _placed(self, key: np.ndarray, bits: int) -> np.ndarray:
        """The place of each trigram among the reference's, common ones first; -1 where it has none."""
        mask, own = (1 << bits) - 1, self.bits
        parts = key >> 2 * bits, key >> bits & mask, key & mask
        known = (parts[0] < len(self.letters)) & (parts[1] < len(self.letters)) & (parts[2] < len(self.letters))
        key = (parts[0] << own | parts[1]) << own | parts[2]
        if 3 * own <= 21:
            if not hasattr(self, "table"):
                self.table = np.full(1 << 3 * own, -1, np.int32)
                self.table[self.keys] = self.place
            return np.where(known, self.table[np.where(known, key, 0)], -1).astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(known & (self.keys[at] == key), self.place[at], -1)

    def pairs(self, texts: pa.Array, threshold: float, best: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """line, row of ``rows``, score of all pairs that share a trigram and reach the threshold; ``best``: of each line the best, of equal ones the first."""
        self.make()
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not self.cold or not len(texts):
            return none
        line, key, bits = self._grams(*_points(texts))
        size, gram = np.bincount(line, minlength=len(texts)), self._placed(key, bits)
        if self.cold < len(self.keys):
            size = size - np.bincount(line[gram >= self.cold], minlength=len(texts))
        line, gram = line[(gram >= 0) & (gram < self.cold)], gram[(gram >= 0) & (gram < self.cold)]
        order = np.argsort(size, kind="stable")
        place = np.empty(len(texts), np.int64)
        place[order] = np.arange(len(texts))
        by = np.argsort(place[line], kind="stable")
        line, gram = place[line[by]], gram[by]
        size, upto = size[order], np.searchsorted(line, np.arange(len(texts) + 1))
        part, found = threshold / (1 + threshold), []
        self.product[-1] = -part * self.n
        for a in range(0, len(texts), LINES):
            b = min(a + LINES, len(texts))
            low, high = np.searchsorted(self.n, [size[a] * threshold - 1, size[b - 1] / max(threshold, 1e-9) + 1])
            if upto[a] == upto[b] or low == high:
                continue
            of, g = line[upto[a] : upto[b]] - a, gram[upto[a] : upto[b]]
            left = np.zeros((b - a, self.common + 1), np.float32)
            left[of[g < self.common], g[g < self.common]] = 1
            left[:, -1] = 1
            others, rest = of[g >= self.common], g[g >= self.common]
            n_rest = np.bincount(others, minlength=b - a)
            from_ = np.searchsorted(others, np.arange(b - a + 1))
            need = part * size[a:b] - 0.01 - 1e-6 * size[a:b]
            for c in range(low, high, VERSES):
                counts = left @ self.product[:, c : min(c + VERSES, high)]
                i, j = np.nonzero(counts >= (need - n_rest).astype(np.float32)[:, None])
                o = np.rint(counts[i, j] + part * self.n[c + j]).astype(np.int64)
                j = j + c
                both = np.minimum(n_rest[i], self.n_rest[j])
                keep = (o + both > 0) & (o + both >= part * (size[a + i] + self.n[j]) - 0.01)
                i, j, o = i[keep], j[keep], o[keep]
                o = o + self._shared(i, j, from_, rest)
                score = o / (size[a + i] + self.n[j] - o)
                keep = (o > 0) & (score >= threshold)
                found.append((a + i[keep], j[keep], score[keep]))
        if not found:
            return none
        line, row, score = (np.concatenate(x) for x in zip(*found))
        line, row = order[line], self.by_size[row]
        if best:
            by = np.lexsort((row, -score, line))
            line, row, score = line[by], row[by], score[by]
            first = np.concatenate([[True], line[1:] != line[:-1]]) if len(line) else np.zeros(0, bool)
            line, row, score = line[first], row[first], score[first]
        return line, row, score

    def _shared(self, i: np.ndarray, j: np.ndarray, from_: np.ndarray, rest: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """How many of line i's less common trigrams reference line j has."""
        n, out = from_[i + 1] - from_[i], np.zeros(len(i), np.int64)
        if not len(self.rest):
            return out
        ends, a = np.cumsum(n), 0
        while a < len(i):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most)))
            m = n[a:b]
            pair = np.repeat(np.arange(b - a), m)
            k = rest[np.arange(len(pair)) + np.repeat(from_[i[a:b]] - (np.cumsum(m) - m), m)] * len(self.n) + j[a:b][pair]
            at = np.minimum(np.searchsorted(self.rest, k), len(self.rest) - 1)
            out[a:b] = np.bincount(pair[self.rest[at] == k], minlength=b - a)
            a = b
        return out
