"""Shared plumbing: reading tables, shared storage, vectorised text hashing."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step holds at a time (a longer single text is one step).
CHUNK_BYTES = 1 << 19


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset, a temporary one on a single machine, an error elsewhere."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="xdoc-shared-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/xdoc-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder once, read it from there.

    The table survives lost executors, unlike a local checkpoint, and is compressed, unlike a plain one.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.xdoc_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for tables that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table.xdoc_path)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- arrays of texts

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    n, (_, offsets, data) = len(column), column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, 8 * column.offset) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows that hold about ``limit`` bytes together, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def texts(data: np.ndarray, offsets: np.ndarray):
    """Each row's bytes."""
    view = memoryview(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield bytes(view[a:b])


# ---------------------------------------------------------------- hashing of spans

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Two primes below 2 ** 31 and a base for each.
_PRIMES = ((2147483647, 1583458089), (2147483629, 784588716))
_POWERS: dict[tuple, np.ndarray] = {}


def _powers(key: tuple, n: int, make) -> np.ndarray:
    """Powers up to the n-th at least; long ones aren't kept."""
    have = _POWERS.get(key)
    if have is None or len(have) <= n:
        have = make(max(n, CHUNK_BYTES) + 1)
        if n <= CHUNK_BYTES:
            _POWERS[key] = have
    return have


def _wrapping(base: np.uint64):
    def make(n: int) -> np.ndarray:
        step = np.full(n, base, np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            return np.cumprod(step, dtype=np.uint64)

    return make


def _modular(base: int, prime: int):
    def make(n: int) -> np.ndarray:
        out, have = np.ones(n, np.uint64), 1
        while have < n:  # each step doubles what there is
            more = min(have, n - have)
            out[have : have + more] = out[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
            have += more
        return out

    return make


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class Spans:
    """Hashes of arbitrary spans of one byte array, from prefix sums of polynomials modulo two primes: 62 bits, whatever the spans' length."""

    def __init__(self, data: np.ndarray):
        n, values = len(data), data.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for prime, base in _PRIMES:
            terms = values * _powers((base, prime), n, _modular(base, prime))[:n]
            if n >= 1 << 23:  # sums of so many terms would pass 2 ** 63
                terms %= np.uint64(prime)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.sums.append((np.uint64(prime), sums, _powers((-base, prime), n, _modular(pow(base, -1, prime), prime))))

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        (p, a, x), (q, b, y) = self.sums
        low, high = (a[ends] - a[starts]) % p * x[starts] % p, (b[ends] - b[starts]) % q * y[starts] % q
        return mix(low | high << np.uint64(31))


class ShortSpans:
    """The same modulo 2 ** 64, which is faster; for spans of a few hundred bytes (very long ones of few symbols can collide)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[data] * _powers(("wrapping",), n, _wrapping(_BASE))[:n], out=self.sums[1:])
        self.inverse = _powers(("inverse",), n, _wrapping(_BASE_INVERSE))

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes other than 0x20 and 0x09 to 0x0D; offsets begin at 0."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def ngrams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n consecutive words of one row, and where each begins."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
    return sequence(hashes, at, n), at


def sequence(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    total = np.full(len(at), n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k])
    return total
