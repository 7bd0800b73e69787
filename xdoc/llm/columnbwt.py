"""Burrows-Wheeler transform and common prefixes of a collection, column by column.

All strings grow leftwards together: each round puts one more symbol of every
string before the suffixes built so far. Where a new suffix belongs follows from
the transform itself (its place among the suffixes that begin with its symbol is
the number of equal symbols before it), and its common prefix with the one above
is one more than the least common prefix since the last equal symbol. A round
reads the files of the last one from front to back and writes those of the next;
memory holds one block of them and a few numbers per string.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

#: Entries of a block, and of the pieces whose least values answer range queries in it.
BLOCK, PIECE = 1 << 20, 16
_FIELDS = {"symbol": np.uint8, "common": np.uint8}


class _Least:
    """Least values of ranges (a, b] of an array."""

    def __init__(self, values: np.ndarray):
        pad = -len(values) % PIECE
        self.values = np.concatenate([values, np.full(pad + PIECE, 255, np.uint8)])
        level = self.values.reshape(-1, PIECE).min(1)
        self.levels = [level]
        while len(level) > 1:
            step = 1 << len(self.levels) - 1
            if len(level) <= step:
                break
            level = np.minimum(level[:-step], level[step:])
            self.levels.append(level)

    def range(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        first, last = a + 1, b
        span, found = np.arange(PIECE), np.full(len(a), 255, np.uint8)
        for k in range(0, len(a), 1 << 14):  # a bounded number of rows of PIECE values at a time
            f, l = first[k : k + (1 << 14), None], last[k : k + (1 << 14), None]
            head = f + span
            tail = l - span
            low = np.where(head <= l, self.values[np.minimum(head, len(self.values) - 1)], 255).min(1)
            high = np.where(tail >= f, self.values[np.maximum(tail, 0)], 255).min(1)
            found[k : k + (1 << 14)] = np.minimum(low, high)
        p, q = first // PIECE + 1, last // PIECE - 1  # whole pieces between
        inner = np.flatnonzero(q >= p)
        if len(inner):
            p, q = p[inner], q[inner]
            depth = np.frexp((q - p + 1).astype(np.float64))[1] - 1
            least = found[inner]
            for d in np.unique(depth):
                at = depth == d
                level = self.levels[d]
                least[at] = np.minimum(least[at], np.minimum(level[p[at]], level[q[at] - (1 << int(d)) + 1]))
            found[inner] = least
        return found


class ColumnBwt:
    """Transform of ``strings``; common prefixes count up to ``cap``."""

    def __init__(self, strings: list[bytes], cap: int = 100, folder: str | None = None, block: int = BLOCK):
        self.strings, self.cap, self.block = strings, cap, block
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.zeros(len(strings) + 1, np.int64)
        np.cumsum(self.lengths, out=self.starts[1:])
        self.text = np.frombuffer(b"".join(strings), np.uint8)
        self.longest = int(self.lengths.max(initial=0))
        self.folder = tempfile.mkdtemp(prefix="xdoc-bwt-", dir=folder)
        self.round = 0
        self.total = 0
        try:
            self._build()
        except BaseException:
            self.close()
            raise

    def __enter__(self) -> ColumnBwt:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    # symbols are one more than their byte; 0 ends a string
    def _symbols(self, rows: np.ndarray, depth: int) -> np.ndarray:
        """What stands before the last ``depth`` bytes of each string. Byte 255 never occurs in UTF-8, so one more fits."""
        left = self.lengths[rows] - depth - 1
        found = np.zeros(len(rows), np.uint8)
        has = left >= 0
        found[has] = self.text[self.starts[rows[has]] + left[has]] + 1
        return found

    def _path(self, name: str, generation: int) -> str:
        return os.path.join(self.folder, f"{name}.{generation & 1}")

    def read(self, n: int, at: int = 0, names=tuple(_FIELDS)) -> list[np.ndarray]:
        """Entries from ``at`` of the current files."""
        return [np.fromfile(self._path(k, self.round), _FIELDS[k], n, offset=at * _FIELDS[k]().itemsize) for k in names]

    def _build(self) -> None:
        m = len(self.strings)
        every = np.arange(m)
        symbols = self._symbols(every, 0)
        symbols.tofile(self._path("symbol", 0))
        np.zeros(m, np.uint8).tofile(self._path("common", 0))
        self.total, counts = m, np.bincount(symbols, minlength=256)
        active, places, chars = every[symbols > 0], every[symbols > 0], symbols[symbols > 0]
        depth = 0
        while len(active):
            depth += 1
            active, places, chars, counts = self._step(active, places, chars, counts, depth)

    def _step(self, active, places, chars, counts, depth):
        """One more symbol of each active string; ``places``: where its suffix stands, in ascending order, ``chars``: the symbol there."""
        m = len(self.strings)
        heads = np.zeros(256, np.int64)  # where the suffixes that begin with a symbol start
        heads[1:] = m + np.concatenate([[0], np.cumsum(counts[1:-1])])
        targets, common = np.zeros(len(active), np.int64), np.zeros(len(active), np.uint8)
        seen, least = np.zeros(256, np.int64), np.zeros(256, np.uint8)  # equal symbols so far, least common prefix since the last
        fresh = np.zeros(256, bool)  # whether the last one is new, so that the next old one's common prefix changes
        changed_at, changed_to = [], []
        for at in range(0, self.total, self.block):
            n = min(self.block, self.total - at)
            symbol, lcp = self.read(n, at, ("symbol", "common"))
            order = np.argsort(symbol, kind="stable")
            ordered = symbol[order]
            bounds = np.searchsorted(ordered, np.arange(257))
            lo, hi = np.searchsorted(places, [at, at + n])
            own = places[lo:hi] - at
            is_new = np.zeros(n, bool)
            is_new[own] = True
            in_order = is_new[order]
            # in the order of symbols, those to look at are new or follow a new one
            follows = np.zeros(n, bool)
            follows[1:] = in_order[:-1] & (ordered[1:] == ordered[:-1])
            first = bounds[:-1][np.diff(bounds) > 0]
            follows[first] = fresh[ordered[first]]
            look = np.flatnonzero((in_order | follows) & (ordered > 0))
            here, sym = order[look], ordered[look].astype(np.int64)
            is_first = look == bounds[sym]
            before = np.where(is_first, -1, order[np.maximum(look - 1, 0)])
            ranges = _Least(lcp)
            low = ranges.range(before, here)
            low = np.where(is_first, np.minimum(low, least[sym]), low)
            alone = is_first & (seen[sym] == 0)
            value = np.where(alone, 0, np.minimum(low.astype(np.int64) + 1, self.cap)).astype(np.uint8)
            new = in_order[look]
            slot = lo + np.searchsorted(own, here[new])
            target = heads[sym] + seen[sym] + look - bounds[sym]
            targets[slot] = target[new]
            common[slot] = value[new]
            old = ~new
            changed_at.append(target[old])
            changed_to.append(value[old])
            has = np.flatnonzero(np.diff(bounds) > 0)
            lasts = order[bounds[1:][has] - 1]
            tail = ranges.range(lasts, np.full(len(lasts), n - 1))
            whole = lcp.min()
            least = np.minimum(least, whole)
            least[has] = tail
            fresh[has] = is_new[lasts]
            seen += np.diff(bounds)
        return self._write(active, targets, common, np.concatenate(changed_at), np.concatenate(changed_to), counts, depth)

    def _write(self, active, targets, common, changed_at, changed_to, counts, depth):
        by = np.argsort(targets)
        active, targets, common = active[by], targets[by], common[by]
        symbols = self._symbols(active, depth)
        values = {"symbol": symbols, "common": common}
        old_at = targets - np.arange(len(targets))  # each goes before this entry of the old files
        by = np.argsort(changed_at)
        changed_at, changed_to = changed_at[by], changed_to[by]
        total, offset = self.total, 0
        # the files of two rounds ago are shorter: written over, which is cheaper than to empty them first
        names = {k: self._path(k, self.round + 1) for k in _FIELDS}
        out = {k: open(name, "r+b" if os.path.exists(name) else "wb") for k, name in names.items()}
        try:
            for at in range(0, max(total, 1), self.block):
                n = min(self.block, total - at)
                end = at + n + (at + n >= total)
                lo, hi = np.searchsorted(old_at, [at, end])
                written = n + hi - lo
                for k, old in zip(_FIELDS, self.read(n, at), strict=True):
                    new = np.insert(old, old_at[lo:hi] - at, values[k][lo:hi])
                    if k == "common":
                        a, b = np.searchsorted(changed_at, [offset, offset + written])
                        new[changed_at[a:b] - offset] = changed_to[a:b]
                    new.tofile(out[k])
                offset += written
        finally:
            for f in out.values():
                f.close()
        self.round += 1
        self.total += len(active)
        counts = counts + np.bincount(symbols, minlength=256)
        go = symbols > 0
        return active[go], targets[go], symbols[go], counts

    def places(self):
        """For 0, 1, 2, ... bytes: the strings that are so long or longer, and where their suffixes of that length stand."""
        following = np.empty(self.total, np.int64)
        counts = np.zeros(257, np.int64)
        for at in range(0, self.total, self.block):
            counts[1:] += np.bincount(self.read(self.block, at, ("symbol",))[0], minlength=256)
        heads = len(self.strings) - counts[1] + np.cumsum(counts)[:-1]
        for at in range(0, self.total, self.block):
            symbol = self.read(min(self.block, self.total - at), at, ("symbol",))[0]
            order = np.argsort(symbol, kind="stable")
            own = np.bincount(symbol, minlength=256)
            following[at + order] = np.repeat(heads - np.cumsum(own) + own, own) + np.arange(len(order))
            heads += own
        rows, at = np.arange(len(self.strings)), np.arange(len(self.strings))
        for depth in range(self.longest + 1):
            keep = self.lengths[rows] >= depth
            rows, at = rows[keep], at[keep]
            yield rows, at
            go = self.lengths[rows] > depth
            rows, at = rows[go], following[at[go]]

    def groups(self, length: int):
        """Suffixes that share their first ``length`` bytes with another: owner, bytes from its start to the string's end, group."""
        number = np.zeros(self.total, np.int64)  # 0: alone
        last = 0
        for at in range(0, self.total, self.block):
            long = self.read(min(self.block, self.total - at), at, ("common",))[0] >= length
            after = np.append(long[1:], False)
            if at + self.block < self.total:
                after[-1] = self.read(1, at + self.block, ("common",))[0][0] >= length
            ids = last + np.cumsum(after & ~long)
            number[at : at + len(long)] = np.where(long | after, ids, 0)
            last = int(ids[-1])
        found = []
        for depth, (rows, at) in enumerate(self.places()):
            own = number[at]
            found.append((rows[own > 0], np.full(int((own > 0).sum()), depth), own[own > 0]))
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 3
