"""Byte-level BPE by prefix dynamic programming.

For each prefix of a byte string there is exactly one token that ends the
prefix's encoding, so a table of last tokens holds the encodings of all
prefixes. A token may follow another only if merging would leave the two alone,
which is decided from how merges built them. The table grows by appends without
a second look at what stands before, and after an edit it is recomputed from
the edit to where it falls back into step with the old one.

Defined results: a null or empty text has no ids; special strings in a text are
ordinary text; repeated rows get the same row each; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, utf8

#: Strings remembered by a worker, of at most so many characters each.
REMEMBERED, SHORT = 400_000, 64
#: Pairs of tokens of which is remembered whether they may stand together.
PAIRS = 1_000_000


class Vocabulary:
    """Ranks of byte strings, as in a .tiktoken file: a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._allowed: dict[int, bool] = {}
        # every end of a token, with the token that it is or -1: tells when no longer token can match
        self._ends = {b[k:]: -1 for b in ranks for k in range(len(b))} | ranks

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merge(self, text: bytes, below: int | None = None) -> list[int]:
        """Plain merging of the lowest rank first, for short strings; ``below`` leaves out later ranks."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            r, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if r >= (1 << 60 if below is None else below):
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes and tokens that merges never make."""
        if token not in self._parts:
            made = self.merge(self.bytes_of[token], token)
            self._parts[token] = (made[0], made[1]) if len(made) == 2 else None
        return self._parts[token]

    def allowed(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` as they are when they stand together."""
        key = left << 32 | right
        known = self._allowed.get(key)
        if known is None:
            if len(self._allowed) > PAIRS:
                self._allowed.clear()
            known = self._allowed[key] = self._undisturbed(left, right)
        return known

    def last_token(self, text: bytes, last: list[int], end: int) -> int:
        """The token that ends the encoding of text[:end]; ``last`` has those of all shorter prefixes."""
        ends, known = self._ends.get, self._allowed.get
        start = end - 1
        while start >= 0 and (token := ends(text[start:end])) is not None:
            if token >= 0:
                if start:
                    ok = known(last[start - 1] << 32 | token)
                    if ok is None:
                        ok = self.allowed(last[start - 1], token)
                    if ok:
                        return token
                elif end == 1 or self.parts(token) is not None:
                    return token
            start -= 1
        raise ValueError(f"no token ends at byte {end}")

    def back(self, last: list[int], end: int) -> list[int]:
        """The encoding of the first ``end`` bytes, from its last token to its first."""
        found = []
        while end:
            found.append(last[end - 1])
            end -= len(self.bytes_of[found[-1]])
        return found[::-1]

    def _undisturbed(self, left: int, right: int) -> bool:
        # Undo merges on either side of the seam, latest first. A pair across the seam would
        # have been merged if it became possible before the merge just undone took place; at
        # equal rank the leftmost comes first, so the left side's own merge wins a tie.
        bound, a, b = 1 << 60, left, right
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < bound:
                return False
            of_a, of_b = self.parts(a), self.parts(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or (of_a is not None and a > b):
                bound, a = a, of_a[1]
            else:
                bound, b = b + 1, of_b[0]


class PrefixTable:
    """Last tokens of all prefixes of a byte string."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary, self.text, self.last = vocabulary, b"", []
        self.append(text)

    def append(self, more: bytes) -> None:
        self.text += more
        text, last, find = self.text, self.last, self.vocabulary.last_token
        for end in range(len(last) + 1, len(text) + 1):
            last.append(find(text, last, end))

    def replace(self, start: int, stop: int, by: bytes) -> int:
        """Put ``by`` in place of bytes ``start`` to ``stop``; returns how many prefixes were looked at again."""
        text, shift = self.text[:start] + by + self.text[stop:], len(by) - (stop - start)
        old, last, same = self.last, self.last[:start], 0
        for end in range(start + 1, len(text) + 1):
            last.append(self.vocabulary.last_token(text, last, end))
            before = end - shift
            same = same + 1 if before > stop and old[before - 1] == last[-1] else 0
            if same >= self.vocabulary.longest:  # what follows depends on these prefixes alone
                self.text, self.last = text, last + old[before:]
                return end - start
        self.text, self.last = text, last
        return len(text) - start

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        return self.vocabulary.back(self.last, len(self.text) if end is None else end)


#: A space between other white space: one match of the split pattern holds both sides.
_BETWEEN = re.compile(r" (?<=\s )\s")


def pieces_at_spaces(text: str) -> list[str] | None:
    """Cut before each space that stands alone, so that the split pattern never matches across a cut:
    such a space joins the run after it, and white space before it ends there. None where that doesn't
    hold: spaces follow each other, end the text or stand between other white space."""
    if "  " in text or text.endswith(" ") or _BETWEEN.search(text):
        return None
    first, *rest = text.split(" ")
    return [first, *(" " + p for p in rest)] if first else [" " + p for p in rest]


class Encoder:
    """Splits by a pattern, encodes each match by a prefix table, remembers short strings."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.matches = vocabulary, regex.compile(pattern).findall
        self.of_match: dict[str, bytes] = {}
        self.of_piece: dict[str, bytes] = {}

    def _match(self, match: str) -> bytes:
        found = self.of_match.get(match)
        if found is None:
            raw = match.encode()
            token = self.vocabulary.ranks.get(raw)
            ids = [token] if token is not None else PrefixTable(self.vocabulary, raw).ids()  # a whole match that is a token stays one
            found = array("I", ids).tobytes()
            if len(match) <= SHORT:
                if len(self.of_match) >= REMEMBERED:
                    self.of_match.clear()
                self.of_match[match] = found
        return found

    def _piece(self, piece: str) -> bytes:
        found = b"".join(map(self._match, self.matches(piece)))
        if len(piece) <= SHORT:
            if len(self.of_piece) >= REMEMBERED:
                self.of_piece.clear()
            self.of_piece[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = pieces_at_spaces(text)
        if pieces is None:
            return b"".join(map(self._match, self.matches(text)))
        get, new = self.of_piece.get, self._piece
        return b"".join([get(p) or new(p) for p in pieces if p])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    return _LOADED.get((path, pattern)) or _LOADED.setdefault((path, pattern), Encoder(Vocabulary.load(path), pattern))


def encode_texts(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and hashes of the ids and of the bytes decoded from them; ``keep_ids`` adds the ids.

    ``ranks``: a file that every executor has at the same place.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if keep_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        own = encoder(ranks, pattern)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets):
                rows = []
                for t in batch.column(1).slice(a, b - a).to_pylist():
                    ids = own.encode(t or "")
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest(), *([ids] if keep_ids else [])))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=False))], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
