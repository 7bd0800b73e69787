"""Quality rules as a short-circuit cascade.

Each rule has a cost, that of the features which it needs included, and a share
of documents that it rejects, both estimated on a bounded sample; rules then run
in descending order of rejections per cost, and a document that one rule rejects
is not looked at by the next: what only later rules need is never computed of it.
The verdict is the conjunction of all rules, so the order changes the time only,
never a result. ``quality_features`` reports the base counts of every document,
so there only what the other rules need is spared.

Defined results: a null or empty text has no words and fails the base rule; ties
in rejections per cost keep the order of ``RULES``; repeated rows get the same
row each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import time
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Spans, chunks, mix, ngrams, utf8, words

#: Costs and selectivities are estimated on the first rows of so many partitions, evenly spaced, so many rows in all at most.
SAMPLE_ROWS, SAMPLE_PARTITIONS = 2048, 64

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LETTER, _DIGIT, _CONTINUED = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC2:0xF5] = True
_DIGIT[48:58] = True
_CONTINUED[0x80:0xC0] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _within(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes that differ from row to row."""
    with np.errstate(over="ignore"):
        return mix(hashes + rows.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


class Texts:
    """A few texts as one byte array. Features are computed when a rule first asks for them, and carried over to subsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, found: dict[str, np.ndarray] | None = None):
        self.data, self.offsets, self.n = data, offsets - offsets[0], len(offsets) - 1
        self.found = {} if found is None else found

    def subset(self, keep: np.ndarray) -> Texts:
        if keep.all():
            return self
        lengths = np.diff(self.offsets)[keep]
        offsets = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        return Texts(self.data[np.repeat(keep, np.diff(self.offsets))], offsets, {k: v[keep] for k, v in self.found.items()})

    def feature(self, name: str) -> np.ndarray:
        if name not in self.found:
            self.found[name] = getattr(self, "_" + name)()
        return self.found[name]

    def __getitem__(self, name: str) -> np.ndarray:
        return self.feature(name)

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return words(self.data, self.offsets)

    @cached_property
    def spans(self) -> Spans:
        return Spans(self.data)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.spans.hash(*self.words[:2])

    def _n_words(self):
        return np.bincount(self.words[2], minlength=self.n)

    def _word_chars(self):
        return _per_row(~SPACE[self.data] & ~_CONTINUED[self.data], self.offsets)

    def _n_symbols(self):
        return _per_row(_SYMBOL[self.data], self.offsets)

    def _n_lines(self):
        return _per_row(self.data == 10, self.offsets) + 1

    def _capitals(self):
        return _per_row(_UPPER[self.data], self.offsets)

    def _letters(self):
        return _per_row(_LETTER[self.data], self.offsets)

    def _digits(self):
        return _per_row(_DIGIT[self.data], self.offsets)

    def _n_distinct(self):
        rows = self.words[2]
        _, first = np.unique(_within(self.word_hashes, rows), return_index=True)
        return np.bincount(rows[first], minlength=self.n)

    def _n_repeat_words(self):
        rows = self.words[2]
        grams, at = ngrams(self.word_hashes, rows, 3)
        repeated = np.zeros(len(rows), bool)
        if len(grams):
            _, inverse, counts = np.unique(_within(grams, rows[at]), return_inverse=True, return_counts=True)
            again = at[counts[inverse] > 1]
            for k in range(3):
                repeated[again + k] = True
        return np.bincount(rows[repeated], minlength=self.n)

    def _n_dup_lines(self):
        """Lines with a word that equal an earlier line of their text."""
        n = len(self.data)
        breaks = np.flatnonzero(self.data == 10)
        starts = np.unique(np.concatenate([self.offsets[:-1], breaks + 1]))
        starts = starts[starts < n]
        if not len(starts):
            return np.zeros(self.n, np.int64)
        nonspace = np.zeros(n + 1, np.int64)
        np.cumsum(~SPACE[self.data], out=nonspace[1:])
        ends = np.append(starts[1:], n)
        ends = ends - (self.data[ends - 1] == 10)
        rows = np.searchsorted(self.offsets, starts, "right") - 1
        wordy = nonspace[ends] > nonspace[starts]
        starts, ends, rows = starts[wordy], ends[wordy], rows[wordy]
        _, first = np.unique(_within(self.spans.hash(starts, ends), rows), return_index=True)
        return np.bincount(rows, minlength=self.n) - np.bincount(rows[first], minlength=self.n)


# Each rule: texts in, a mask of rejected ones out.

def _few_words(t):
    """Under 50 words."""
    return t["n_words"] < 50


def _repeated_words(t):
    """Over half of the words stand in 3-word windows that the text has twice or more."""
    return 2 * t["n_repeat_words"] > t["n_words"]


def _symbols(t):
    """More than one symbol to ten words."""
    return 10 * t["n_symbols"] > t["n_words"]


def _word_length(t):
    """Mean word length under 2 or over 20 characters."""
    return (t["word_chars"] < 2 * t["n_words"]) | (t["word_chars"] > 20 * t["n_words"])


def _repeated_lines(t):
    """Over half of the lines equal an earlier one that has a word."""
    return 2 * t["n_dup_lines"] > t["n_lines"]


def _shouting(t):
    """Over 40 % of the letters are capitals."""
    return 5 * t["capitals"] > 2 * t["letters"]


def _few_letters(t):
    """Under 60 % of the word characters are letters."""
    return 5 * t["letters"] < 3 * t["word_chars"]


def _many_digits(t):
    """Over 20 % of the word characters are digits."""
    return 5 * t["digits"] > t["word_chars"]


def _few_distinct(t):
    """Under 5 % of the words are distinct."""
    return 20 * t["n_distinct"] < t["n_words"]


BASE = {f.__name__[1:]: f for f in (_few_words, _repeated_words)}
RULES = BASE | {f.__name__[1:]: f for f in (_symbols, _word_length, _repeated_lines, _shouting, _few_letters, _many_digits, _few_distinct)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def cascade(texts: Texts, order: list[str], alive: np.ndarray | None = None) -> np.ndarray:
    """Which texts pass all rules; those that one rule rejects aren't looked at by the next, nor what it needs of them computed."""
    kept = np.ones(texts.n, bool) if alive is None else alive
    at = np.flatnonzero(kept)
    left = texts.subset(kept)
    for name in order:
        if not len(at):
            break
        passed = ~RULES[name](left)
        at, left = at[passed], left.subset(passed)
    kept = np.zeros(texts.n, bool)
    kept[at] = True
    return kept


def plan(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rules in descending order of rejections per second, both measured on ``sample_rows`` rows at most."""
    docs = docs.select(F.col(text).cast("string"))
    there = docs.rdd.getNumPartitions()
    step = max(1, -(-there // SAMPLE_PARTITIONS))
    each = max(1, sample_rows // -(-max(1, there) // step))

    def measure(batches):
        if TaskContext.get().partitionId() % step:
            return
        for batch in batches:
            data, offsets = utf8(batch.column(0).slice(0, each))
            for a, b in chunks(offsets):
                for name, rule in RULES.items():
                    t = Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1])
                    began = time.perf_counter()
                    rejected = rule(t)
                    took = time.perf_counter() - began
                    yield pa.RecordBatch.from_pydict({"rule": [name], "seconds": [took], "rejected": [int(rejected.sum())], "n": [t.n]})
            return  # the rest of the partition isn't read

    found = docs.mapInArrow(measure, "rule string, seconds double, rejected long, n long")
    rows = {r.rule: r for r in found.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n")).collect()}
    gain = {name: (rows[name].rejected + 0.5) / (rows[name].seconds + 1e-6) if name in rows else 0.0 for name in RULES}
    return sorted(RULES, key=lambda name: -gain[name])


def quality_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """A row per document with its base counts, ``base_failed`` and ``kept``."""
    order = plan(docs, text) if order is None else order

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets):
                t = Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1])
                counts = [t[k] for k in COUNTS]
                failed = np.any([rule(t) for rule in BASE.values()], axis=0)
                kept = cascade(t, [r for r in order if r not in BASE], ~failed)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(kept)], names=["doc_id", *COUNTS, "base_failed", "kept"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def quality_filter(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs``, all their columns unchanged, whose text passes every rule.

    Rows are filtered where they are read; nothing is shuffled or joined.
    """
    order = plan(docs, text) if order is None else order
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            kept = [cascade(Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1]), order) for a, b in chunks(offsets)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
