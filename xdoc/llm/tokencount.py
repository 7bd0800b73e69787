"""Token counts of a sentencepiece BPE model by rank-synchronous array merging.

Texts are cut into pre-tokens (a run of word marks and what follows up to the
next mark; no piece has a mark after another character, so merges never cross).
Pre-tokens not seen before are held together as ragged numpy arrays of symbols,
parted once more where two characters meet that stand together in no piece. In
each round every sequence merges its lowest-rank adjacent pair, from left to right
wherever it stands, unless a merge makes a pair of no higher rank, which then comes
first; so a sequence takes about as many rounds as it has different pairs, however
long it is. When no sequence has a pair left, surviving symbols count one each, and
those outside the vocabulary one for each of their bytes.

Defined results: a null or empty text has no tokens and no bytes; strings of
control pieces inside a text are ordinary text; repeated rows get the same row
each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, utf8

MARK = "▁"
LIMIT = 4096
#: Pre-tokens remembered by a worker, and characters of the longest of them; characters merged at once.
REMEMBERED, LONG, SLICE = 300_000, 256, 1 << 18
#: What a model must leave as it is, and must count as here.
PROBE = "Probe  of ﬁ, Å and 12\u3000ｶ: \U0001f9ea unbelievable, don't"
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
_NONE = np.int64(1) << 62


class PieceCounter:
    """Counts what a sentencepiece BPE model with byte fallback and identity normalisation makes of a text."""

    def __init__(self, pieces: dict[str, float]):
        """pieces: each ordinary piece and its score."""
        rank = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.rank = {p: rank[s] for p, s in pieces.items()}
        self.symbol = {p: k for k, p in enumerate(pieces)}
        for p in pieces:
            for c in p:
                self.symbol.setdefault(c, len(self.symbol))
        n = len(self.symbol)
        self.radix = np.int64(n + 1)
        known = np.full(0x110000, n, np.int64)  # n: outside the vocabulary
        for p, k in self.symbol.items():
            if len(p) == 1:
                known[ord(p)] = k
        self.known = known
        point = np.arange(0x110000)
        self.weight_of_point = np.where(point < 0x80, 1, np.where(point < 0x800, 2, np.where(point < 0x10000, 3, 4)))
        for p in pieces:
            if len(p) == 1:
                self.weight_of_point[ord(p)] = 1
        found = {}
        for p in pieces:
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    found[a * (n + 1) + b] = (self.rank[p], self.symbol[p])
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k][0] for k in self.keys.tolist()] + [_NONE], np.int64)
        self.merged = np.array([found[k][1] for k in self.keys.tolist()] + [0], np.int64)
        self.together = np.unique(np.array([self.symbol[p[k]] * (n + 1) + self.symbol[p[k + 1]] for p in pieces for k in range(len(p) - 1)], np.int64))
        self.seen: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> PieceCounter:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = (k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
        counter = cls({model.id_to_piece(k): model.get_score(k) for k in plain})
        if counter.count([PROBE]) != [len(model.encode(PROBE))]:
            raise ValueError(f"{path} isn't a BPE model with byte fallback, a mark in front and identity normalisation")
        return counter

    def _symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of a text's characters, and whether each may merge with the next one."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.known[points]
        near = np.zeros(len(symbols), bool)
        if len(symbols) > 1 and len(self.together):
            wanted = symbols[:-1] * self.radix + symbols[1:]
            near[:-1] = self.together[np.minimum(np.searchsorted(self.together, wanted), len(self.together) - 1)] == wanted
        return symbols, near

    def _slices(self, segment: str) -> Iterator[str]:
        """``segment`` in parts of about SLICE characters that no merge crosses; longer ones only where there is no such place."""
        at, size = 0, SLICE
        while at + size < len(segment):
            apart = np.flatnonzero(~self._symbols(segment[at : at + size + 1])[1][:-1])
            if len(apart):
                yield segment[at : at + apart[-1] + 1]
                at, size = at + int(apart[-1]) + 1, SLICE
            else:
                size *= 2
        yield segment[at:]

    def _places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place in ``ranks`` of each pair of symbols; the last place stands for none."""
        wanted = a * self.radix + b
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, place, len(self.keys))

    def _chosen(self, hits: np.ndarray, symbols: np.ndarray, rows: np.ndarray, merged: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Which of the lowest pairs (by their first symbols, in order) merge in this round; ``merged`` and ``best`` by symbol."""
        k = np.arange(len(hits))
        run = np.maximum.accumulate(np.where(np.r_[True, np.diff(hits) != 1], k, 0))
        hits = hits[(k - run) % 2 == 0]  # of overlapping ones every other
        head = np.r_[True, rows[hits[1:]] != rows[hits[:-1]]]
        if head.all():
            return hits
        # what a merge puts beside its new symbol: on its left merges are done, on its right they aren't
        new, last = merged[hits], len(symbols) - 1
        before, after = np.maximum(hits - 1, 0), np.minimum(hits + 2, last)
        left = np.where(np.r_[False, np.diff(hits) == 2] & ~head, np.r_[0, new[:-1]], symbols[before])
        lower = (rows[before] == rows[hits]) & (before < hits) & (self.ranks[self._places(left, new)] <= best[hits])
        lower |= (rows[after] == rows[hits]) & (after == hits + 2) & (self.ranks[self._places(new, symbols[after])] <= best[hits])
        earlier = np.cumsum(lower) - lower
        return hits[earlier == earlier[head][np.cumsum(head) - 1]]

    def count_many(self, segments: list[str]) -> np.ndarray:
        """Tokens of each segment."""
        counts = np.zeros(len(segments), np.int64)
        text = "".join(segments)
        if not text:
            return counts
        symbols, near = self._symbols(text)
        weights = self.weight_of_point[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        owner = np.repeat(np.arange(len(segments)), np.array([len(s) for s in segments], np.int64))
        new = np.r_[True, ~near[:-1] | (owner[1:] != owner[:-1])]
        rows, owner = np.cumsum(new) - 1, owner[new]
        while len(symbols):
            pairs = np.full(len(symbols), len(self.keys), np.int64)
            inner = np.flatnonzero(rows[:-1] == rows[1:])
            if len(self.keys):
                pairs[inner] = self._places(symbols[inner], symbols[inner + 1])
            ranks = self.ranks[pairs]
            heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            sizes = np.diff(np.r_[heads, len(rows)])
            best = np.minimum.reduceat(ranks, heads)
            done = best == _NONE
            np.add.at(counts, owner[rows[heads[done]]], np.add.reduceat(weights, heads)[done])
            best_of = np.repeat(best, sizes)
            hits = np.flatnonzero((ranks == best_of) & (best_of != _NONE))
            if not len(hits):
                break
            merged = self.merged[pairs]
            hits = self._chosen(hits, symbols, rows, merged, best_of)
            symbols[hits] = merged[hits]
            weights[hits] = 1
            stay = np.repeat(~done, sizes)
            stay[hits + 1] = False
            symbols, weights, rows = symbols[stay], weights[stay], rows[stay]
        return counts

    def _learn(self, segments: list[str]) -> None:
        if len(self.seen) + len(segments) > REMEMBERED:
            self.seen.clear()
        part, size = [], 0

        def flush() -> None:
            for s, n in zip((s for s, _ in part), self.count_many([x for _, x in part]).tolist(), strict=True):
                self.seen[s] = self.seen.get(s, 0) + n

        for s in segments:
            for x in self._slices(s):
                if part and size + len(x) > SLICE:
                    flush()
                    part, size = [], 0
                part.append((s, x))
                size += len(x)
        flush()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        cut = []
        for text in texts:
            marked = (MARK + text.replace(" ", MARK)) if text else ""
            if marked.endswith(MARK) or MARK * 2 in marked:
                cut.append(_SEGMENT.findall(marked))
            else:
                cut.append([MARK + s for s in marked.split(MARK)[1:]])
        distinct = set().union(*cut)
        if new := distinct - self.seen.keys():
            if len(new) + len(self.seen) > REMEMBERED:
                new = distinct
            self._learn(list(new))
        known = self.seen.__getitem__
        counts = [sum(map(known, segments)) for segments in cut]
        for s in new:
            if len(s) > LONG:
                del self.seen[s]
        return counts


_LOADED: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``model``: a file that every executor has at the same place."""
    def run(batches):
        counter = _LOADED.get(model) or _LOADED.setdefault(model, PieceCounter.load(model))
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets):
                n = counter.count([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                tokens = pa.array(n, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), tokens, pa.array(np.array(n, np.int64) > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
