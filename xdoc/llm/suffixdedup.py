"""Removal of repeated 100-byte strings, by the transform of segment collections.

A text falls into segments by minimizers: each 100-byte string has an anchor,
the leftmost of its least-hashed ``ANCHOR``-byte substrings, and consecutive
strings with one anchor make a segment. Equal strings have equal anchors at
equal places in them, so only segments with equal anchors need to meet, and a
segment is at most ``2 * LENGTH`` bytes long, whatever the text's length.

1. Segments meet by their anchor's hash, as hashes and places only, each task
   sending one of equal ones. All but the first of equal segments are repeats;
   where segments of an anchor differ, the first of each kind goes on.
2. These segments, as bytes, unless neither side of the anchor reaches another's, form collections of bounded size, whose
   Burrows-Wheeler transform and common prefixes are built column by column in
   sequential files (``columnbwt``). Common prefixes of LENGTH and more tell
   equal strings; all but the first of them are repeats.
3. Each document's repeats become maximal runs and are cut out of its bytes.

Defined results: a null or empty text has no bytes and no repeats; rows that agree
in id and text are one document, each edited alike; rows of one id with different
texts are documents of their own, in the order of their texts' hashes, and each
loses its own repeats only; a null id comes before all others; an empty table
gives an empty table; other columns are not read. What remains of a text need not
be valid UTF-8.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columnbwt import ColumnBwt
from .common import ShortSpans, chunks, materialize, mix, partitions, utf8

LENGTH, ANCHOR = 100, 24
#: Bytes of segments in one collection: a whole number of anchors, one at least.
COLLECTION_BYTES = 4 << 20
#: Segments that a task holds before it sends them.
HELD = 1 << 20

_NO_ID = -(1 << 63)
# doc and text tell a document: text is 0 but where an id has several texts
_RECORD = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("start", "<u4"), ("count", "u1"), ("place", "u1")])


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Where the leftmost least value of each window of ``width`` stands."""
    at = np.arange(len(values))
    best, span = values, 1
    while span < width:
        step = min(span, width - span)
        right = best[step:] < best[:-step]
        at = np.where(right, at[step:], at[:-step])
        best = np.where(right, best[step:], best[:-step])
        span += step
    return at


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Of texts in one array (offsets from 0): row, start in the text, strings, the anchor's place, and hashes of anchor and content, of each segment."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    n = len(data)
    if n < length:
        return none
    spans = ShortSpans(data)
    at = np.arange(n - anchor + 1)
    hashes = spans.hash(at, at + anchor)
    least = window_argmin(hashes, length - anchor + 1)  # one for each start 0 .. n - length
    row = np.searchsorted(offsets, np.arange(n - length + 1), "right") - 1
    inside = np.arange(n - length + 1) + length <= offsets[row + 1]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none
    least, row = least[starts], row[starts]
    first = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (row[1:] != row[:-1])])
    last = np.append(first[1:], len(starts)) - 1
    begin, end = starts[first], starts[last]
    key = hashes[least[first]]
    place = (least[first] - begin).astype(np.uint64)
    content = mix(spans.hash(begin, end + length) ^ place * np.uint64(0x9E3779B97F4A7C15))
    return row[first], begin - offsets[row[first]], end - begin + 1, place.astype(np.int64), key, content


def _pack(records: np.ndarray) -> bytes:
    """Field after field, so that what is alike stands together and compresses."""
    return b"".join(np.ascontiguousarray(records[f]).tobytes() for f in records.dtype.names)


def _unpack(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    found = np.zeros(sum(len(b) for b in blobs) // kind.itemsize, kind)
    at = 0
    for blob in blobs:
        n, byte = len(blob) // kind.itemsize, 0
        for f in kind.names:
            found[f][at : at + n] = np.frombuffer(blob, kind[f], n, byte)
            byte += n * kind[f].itemsize
        at += n
    return found


def _blobs(found: np.ndarray, buckets: int):
    """Records packed by bucket."""
    bucket = (mix(found["anchor"]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, bucket = found[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    heads = np.r_[0, cuts]
    parts = [_pack(found[a:b]) for a, b in zip(heads, np.r_[cuts, len(found)], strict=True)]
    return pa.array(bucket[heads], pa.int32()), pa.array(parts, pa.binary())


def _by_doc(docs: np.ndarray, texts: np.ndarray, payload: np.ndarray):
    """Rows of ``payload`` packed by document, for rows sorted by document."""
    cuts = np.flatnonzero((np.diff(docs) != 0) | (np.diff(texts) != 0)) + 1
    heads = np.r_[0, cuts]
    return pa.array(docs[heads], pa.int64()), pa.array(texts[heads], pa.int64()), pa.array([payload[a:b].tobytes() for a, b in zip(heads, np.r_[cuts, len(docs)], strict=True)], pa.binary())


_FOUND = "bucket int, doc long, text long, data binary"
_SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])
_WANT = np.dtype([("start", "<u4"), ("count", "u1"), ("place", "u1"), ("anchor", "<u8")])


def _first_of_equals(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by anchor, content, place; and which records come first of their content."""
    found = found[np.lexsort((found["start"], found["text"], found["doc"], found["content"], found["anchor"]))]
    new = np.ones(len(found), bool)
    new[1:] = (found["anchor"][1:] != found["anchor"][:-1]) | (found["content"][1:] != found["content"][:-1])
    return found, new


def _repeated(found: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Those that are repeats of an earlier record, without further copies of the same place."""
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = (found["doc"] == found["doc"][head]) & (found["text"] == found["text"][head]) & (found["start"] == found["start"][head])
    return found[~new & ~same]


def _marks(found: np.ndarray, length: int):
    found = found[np.lexsort((found["text"], found["doc"]))]
    spans = np.zeros(len(found), _SPAN)
    spans["start"], spans["end"] = found["start"], found["start"].astype(np.int64) + found["count"] + length - 1
    return _by_doc(found["doc"], found["text"], spans)


def documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, text, body): each row's document and its whole text.

    Ids that stand with several texts are told by the least and greatest hash of their texts, and
    looked up from their table (usually empty, so that the lookup needs no shuffle).
    """
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("body")).withColumn("hash", F.xxhash64("body"))
    several = own.where("id IS NOT NULL").groupBy("id").agg((F.min("hash") != F.max("hash")).alias("several")).where("several")
    several = materialize(several, "several")
    own = own.join(several, "id", "left")
    mark = F.when(F.col("id").isNull() | F.coalesce("several", F.lit(False)), F.col("hash")).otherwise(F.lit(0))
    return own.select(F.coalesce("id", F.lit(_NO_ID)).alias("doc"), mark.alias("text"), "body")


def _texts(own: DataFrame) -> DataFrame:
    """doc, text and the compressed bytes."""
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([squeeze.compress((t or "").encode()) for t in part.column(2).to_pylist()], pa.binary())], names=["doc", "text", "z"])

    return own.mapInArrow(run, "doc long, text long, z binary")


def find_segments(own: DataFrame, length: int, anchor: int, buckets: int) -> DataFrame:
    """Step 1's map side: records by bucket; repeats within a task are told at once (bucket null)."""
    def run(batches):
        held, count = [], 0

        def flush():
            found, new = _first_of_equals(np.concatenate(held))
            if len(again := _repeated(found, new)):
                docs_, texts, data = _marks(again, length)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(docs_), pa.int32()), docs_, texts, data], names=["bucket", "doc", "text", "data"])
            buckets_, data = _blobs(found[new], buckets)
            yield pa.RecordBatch.from_arrays([buckets_, pa.nulls(len(data), pa.int64()), pa.nulls(len(data), pa.int64()), data], names=["bucket", "doc", "text", "data"])

        for batch in batches:
            data, offsets = utf8(batch.column(2))
            ids, marks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for a, b in chunks(offsets):
                row, start, n, place, key, content = segments(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, anchor)
                if not len(row):
                    continue
                found = np.zeros(len(row), _RECORD)
                found["anchor"], found["content"], found["doc"], found["text"], found["start"], found["count"], found["place"] = key, content, ids[a + row], marks[a + row], start, n, place
                held.append(found)
                count += len(found)
                if count >= HELD:
                    yield from flush()
                    held, count = [], 0
        if held:
            yield from flush()

    return own.mapInArrow(run, _FOUND)


def meet(found: DataFrame, length: int) -> DataFrame:
    """Step 1's reduce side: a row per document with repeats (kind 0) or with segments that go on (kind 1)."""
    def run(batches):
        parts = [b for batch in batches for b in batch.column(0).to_pylist()]
        if not parts:
            return
        all_, new = _first_of_equals(_unpack(parts, _RECORD))
        if len(again := _repeated(all_, new)):
            docs_, texts, data = _marks(again, length)
            yield pa.RecordBatch.from_arrays([docs_, texts, pa.array(np.zeros(len(docs_), np.int32)), data], names=["doc", "text", "kind", "data"])
        kinds = all_[new]
        beside = np.zeros(len(kinds), bool)
        equal = kinds["anchor"][1:] == kinds["anchor"][:-1]
        beside[1:] |= equal
        beside[:-1] |= equal
        go = kinds[beside]
        if len(go):
            go = go[np.lexsort((go["text"], go["doc"]))]
            want = np.zeros(len(go), _WANT)
            for c in _WANT.names:
                want[c] = go[c]
            docs_, texts, data = _by_doc(go["doc"], go["text"], want)
            yield pa.RecordBatch.from_arrays([docs_, texts, pa.array(np.ones(len(docs_), np.int32)), data], names=["doc", "text", "kind", "data"])

    return found.select("data").mapInArrow(run, "doc long, text long, kind int, data binary")


def cut_segments(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Bytes of the segments that go on, by anchor."""
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, text, z, blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = unpack.decompress(z)
                want = np.concatenate([np.frombuffer(b, _WANT) for b in blobs])
                parts = [raw[s : s + n + length - 1] for s, n in zip(want["start"].tolist(), want["count"].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(want["anchor"].view(np.int64)), pa.array(np.full(len(want), doc), pa.int64()), pa.array(np.full(len(want), text), pa.int64()), pa.array(want["start"].astype(np.int64)), pa.array(want["place"].astype(np.int32)), pa.array(parts, pa.binary())], names=["anchor", "doc", "text", "start", "place", "segment"])

    by_doc = wanted.groupBy("doc", "text").agg(F.collect_list("data").alias("blobs"))
    return texts.join(by_doc, ["doc", "text"]).select("doc", "text", "z", "blobs").mapInArrow(run, "anchor long, doc long, text long, start long, place int, segment binary")


def repeats_in(collection: list[tuple[int, int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, ascending, and spans of the strings of (doc, text, start, bytes) that an earlier one equals."""
    collection.sort(key=lambda x: x[:3])
    docs, texts, starts = (np.array([c[k] for c in collection], np.int64) for k in range(3))
    sizes = np.array([len(c[3]) for c in collection], np.int64)
    with ColumnBwt([c[3] for c in collection], length) as transform:
        owner, left, group = transform.groups(length)
    at = starts[owner] + sizes[owner] - left
    order = np.lexsort((at, texts[owner], docs[owner], group))
    owner, at, group = owner[order], at[order], group[order]
    head = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    again = ~((docs[owner] == docs[owner[first]]) & (texts[owner] == texts[owner[first]]) & (at == at[first]))
    doc, text, at = docs[owner[again]], texts[owner[again]], at[again]
    order = np.lexsort((at, text, doc))
    spans = np.zeros(len(order), _SPAN)
    spans["start"], spans["end"] = at[order], at[order] + length
    return doc[order], text[order], spans


def with_partners(held: list[tuple[int, int, int, int, int, bytes]], length: int, anchor: int) -> list[tuple[int, int, int, bytes]]:
    """Of (anchor, doc, text, start, place, bytes), the segments that may share a string with another.

    A string reaches half of what it has beside its anchor, or more, to one side of it; so two
    segments that share one agree in that half, to the left or to the right of their anchors.
    """
    half = -(-(length - anchor) // 2)
    sides = [((a, 0, s[p - half : p]) if p >= half else None, (a, 1, s[p + anchor : p + anchor + half]) if len(s) >= p + anchor + half else None) for a, _, _, _, p, s in held]
    seen = Counter(side for pair in sides for side in pair if side)
    return [(doc, text, start, s) for (_, doc, text, start, _, s), (left, right) in zip(held, sides, strict=True) if seen[left] > 1 or seen[right] > 1]


def compare_segments(cut: DataFrame, length: int, anchor: int = ANCHOR) -> DataFrame:
    """Step 2: repeats among the segments of collections."""
    def run(batches):
        held, size, last = [], 0, None

        def flush():
            docs_, texts, spans = repeats_in(with_partners(held, length, anchor), length)
            if len(docs_):
                yield pa.RecordBatch.from_arrays(list(_by_doc(docs_, texts, spans)), names=["doc", "text", "data"])

        for batch in batches:
            for key, doc, text, start, place, segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last and size >= COLLECTION_BYTES:
                    yield from flush()
                    held, size = [], 0
                held.append((key, doc, text, start, place, segment))
                size += len(segment)
                last = key
        if held:
            yield from flush()

    n = partitions(cut.sparkSession)
    return cut.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc long, text long, data binary")


def runs(spans: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by spans, within ``size`` bytes."""
    if not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = spans["start"].astype(np.int64), np.minimum(spans["end"].astype(np.int64), size)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.r_[True, start[1:] > end[:-1]]
    return start[head], end[np.append(np.flatnonzero(head)[1:] - 1, len(end) - 1)]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, keep_bytes: bool = False) -> DataFrame:
    """A row per document; ``keep_bytes`` adds what remains of its bytes."""
    spark = docs.sparkSession
    buckets = partitions(spark)
    own = documents(docs, doc_id, text)
    found = materialize(find_segments(own, length, anchor, buckets), "segments")
    met = materialize(meet(found.where(F.col("bucket").isNotNull()).repartition(buckets, "bucket"), length), "met")
    texts = _texts(own)
    cut = cut_segments(met.where(F.col("kind") == 1), texts, length)
    compared = compare_segments(cut, length, anchor)
    key = ["doc", "text"]
    marks = found.where(F.col("bucket").isNull()).select(*key, "data").union(met.where(F.col("kind") == 0).select(*key, "data")).union(compared)
    by_doc = marks.groupBy(*key).agg(F.collect_list("data").alias("blobs"))
    schema = RESULT + (", kept binary" if keep_bytes else "")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc, z, blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = unpack.decompress(z)
                spans = np.concatenate([np.frombuffer(b, _SPAN) for b in blobs]) if blobs else np.zeros(0, _SPAN)
                start, end = runs(spans, len(raw))
                kept = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True))
                rows.append((None if doc == _NO_ID else doc, len(raw), len(raw) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), *([kept] if keep_bytes else [])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=[x.split()[0] for x in schema.split(", ")])

    return texts.join(by_doc, key, "left").select("doc", "z", "blobs").mapInArrow(run, schema)
