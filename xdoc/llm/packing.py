"""Cost-balanced packing of documents into sequences of fixed length.

A piece of n tokens costs LINEAR * n + QUADRATIC * n ** 2 (attention). Documents
are dealt by hash into groups of about ``GROUP`` documents. In a group, whole
sequences of a document stand alone, and its tail joins the others: tails go in
descending order to the lowest-cost sequence with enough room. One that fits
nowhere is cut at the room there is. A group's tails fill all its sequences; what
is left over fills sequences of powers of two, which need no padding.

Defined results: a null or empty text is its end token alone; ties in length go
by document id, ties in cost to the first sequence; a row that repeats another
is packed again; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import Encoder, Vocabulary
from .common import chunks, utf8

LENGTH, GROUP, END_ID = 2048, 512, 1
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH
#: Characters from which a text is split by an engine that doesn't backtrack on the stack.
LONG = 100_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padding long"


def _byte_of_symbol() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others moved up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class Tokenizer:
    """Ids that the tokenizers library gives for a byte-level BPE file, with its special strings, without added ones.

    The file's vocabulary has its tokens in the order of merges, so rank encoders apply; texts go
    through tiktoken, and very long ones through the prefix tables of ``bytebpe``.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        of = _byte_of_symbol()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"] if t["special"]}
        ranks = {bytes(map(of.__getitem__, t)): k for t, k in model["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.ranks, self.pattern, self.slow = ranks, pattern, None  # tables for long texts only when one comes

    def ids(self, text: str) -> np.ndarray:
        if len(text) < LONG:
            return np.array(self.fast.encode(text, allowed_special="all"), np.uint32)
        self.slow = self.slow or Encoder(Vocabulary(self.ranks), self.pattern)
        parts = [(text, None)]
        for mark, k in self.special.items():
            parts = [x for t, own in parts for x in (self._cut(t, mark, k) if own is None else [(t, own)])]
        return np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(self.slow.encode(t), np.uint32) if own is None else np.array([own], np.uint32) for t, own in parts)])

    @staticmethod
    def _cut(text: str, mark: str, k: int):
        first, *rest = text.split(mark)
        yield first, None
        for part in rest:
            yield mark, k
            yield part, None


_LOADED: dict[tuple[str, str], Tokenizer] = {}


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def place(lengths: np.ndarray, length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Tails in descending order in; (tail, start in it, length, sequence, offset) and each sequence's tokens out."""
    total = int(lengths.sum())
    room = [length] * (total // length)
    for bit in reversed(range(length.bit_length())):
        if total % length >> bit & 1:
            room.append(1 << bit)
    room = np.array(room, np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    pieces = []

    def put(tail: int, start: int, n: int, k: int) -> None:
        pieces.append((tail, start, n, k, int(used[k])))
        used[k] += n
        cost[k] += LINEAR * n + QUADRATIC * n * n

    for tail, n in enumerate(lengths.tolist()):
        start = 0
        while start < n:
            free = room - used
            fits = free >= n - start
            if fits.any():
                put(tail, start, n - start, int(np.argmin(np.where(fits, cost, np.inf))))
                break
            k = int(np.argmax(free))
            part = int(free[k])
            put(tail, start, part, k)
            start += part
    return pieces, room.tolist()


def pack(docs: DataFrame, tokenizer: str, pattern: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """A row per piece. ``tokenizer``: a file that every executor has at the same place."""
    groups = max(1, -(-docs.count() // group))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def tokenise(batches):
        tok = _LOADED.get((tokenizer, pattern)) or _LOADED.setdefault((tokenizer, pattern), Tokenizer(tokenizer, pattern))
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets):
                counts, crcs, tails = [], [], []
                for t in batch.column(1).slice(a, b - a).to_pylist():
                    ids = np.append(tok.ids(t or ""), np.uint32(END_ID))
                    whole = len(ids) // length
                    counts.append(len(ids))
                    crcs.append([_crc(ids[k * length : (k + 1) * length]) for k in range(whole)])
                    tail = ids[whole * length :]
                    tails.append(tail.astype(np.uint16 if int(ids.max()) < 1 << 16 else np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())], names=["doc_id", "doc_tokens", "crcs", "tail"])

    def arrange(key, table):
        docs_ = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "crcs", "tail")), strict=True), key=lambda r: (-(r[1] % length), r[0] is None, r[0], r[1]))
        base, rows = key[0].as_py() << 32, []
        tails = [d for d in docs_ if d[1] % length]
        pieces, room = place(np.array([d[1] % length for d in tails], np.int64), length)
        for tail, start, n, k, offset in pieces:
            d, total, crcs, raw = tails[tail]
            ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * (total % length) else np.uint32)
            full = room[k]
            rows.append((d, len(crcs) * length + start, n, _crc(ids[start : start + n]), total, base + k, offset, full, 0 if not full & (full - 1) else length - full))
        k = len(room)
        for d, total, crcs, _ in docs_:
            for j, crc in enumerate(crcs):
                rows.append((d, j * length, length, crc, total, base + k, 0, length, 0))
                k += 1
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    tokens = own.mapInArrow(tokenise, "doc_id long, doc_tokens long, crcs array<long>, tail binary")
    # by the tail too: documents of one id, or without any, don't meet in one group unless their tails agree
    dealt = tokens.withColumn("__group", F.pmod(F.xxhash64("doc_id", "doc_tokens", "tail", F.spark_partition_id()), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(arrange, SCHEMA)
