"""Arrow functions between text, binary and navigable forms: what built-in expressions can't do.

Documents are parsed once, at ingest; navigation and predicates then run on VARIANT without Python.
A null in gives a null out. ``try_`` forms give null where the others fail the query.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, StringType

from .. import binary, text, values
from ..text import ParseError, ParseOptions, WriteOptions


#: By function: the columns that it last had, and what it made of them.
_LAST: dict[str, tuple[tuple[pd.Series, ...], pd.Series]] = {}


def _once(name: str, columns: tuple[pd.Series, ...], run: Callable) -> pd.Series:
    """An expression that stands twice in a query has the same batch of columns twice, one right after the other."""
    if name not in _LAST or any(a is not b for a, b in zip(_LAST[name][0], columns, strict=True)):
        _LAST[name] = columns, run(*columns)
    return _LAST[name][1]


def _each(one: Callable, kind: DataType, arguments: int = 1, name: str | None = None):
    def cell(*xs):
        if any(x is None for x in xs):
            return None
        return one(*(bytes(x) if isinstance(x, (bytearray, memoryview)) else x for x in xs))

    if arguments == 1:
        def rows(a: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else one(bytes(x) if isinstance(x, (bytearray, memoryview)) else x) for x in a], dtype=object)

        def run(a: pd.Series) -> pd.Series:
            return _once(name, (a,), rows) if name else rows(a)
    else:
        def run(*columns: pd.Series) -> pd.Series:
            return pd.Series([cell(*xs) for xs in zip(*columns, strict=True)], dtype=object)
    return F.pandas_udf(run, kind)


def _tried(one: Callable) -> Callable:
    def run(*xs):
        try:
            return one(*xs)
        except (ValueError, ArithmeticError):
            return None

    return run


def _encode_text(options: ParseOptions, t: str) -> bytes:
    return binary.encode(text.parse(t, options))


def _write(options: WriteOptions, b: bytes) -> str:
    return text.stringify(binary.decode(b), options)


def _text(b: bytes) -> str:
    return text.stringify(binary.decode(b))


def parser(options: ParseOptions = ParseOptions(), attempt: bool = False):
    """Text to canonical binary, under preset options."""
    one = partial(_encode_text, options)
    return _each(_tried(one) if attempt else one, BinaryType())


def writer(options: WriteOptions = WriteOptions(), name: str | None = None):
    """Canonical binary to text, under preset options."""
    return _each(partial(_write, options) if options != WriteOptions() else _text, StringType(), name=name)


def transformer(hook: Callable):
    """Canonical binary to canonical binary by a Python function of the document."""
    return _each(lambda b: binary.encode(hook(binary.decode(b))), BinaryType())


def _or_default(t: str, default: str) -> bytes:
    try:
        return binary.encode(text.parse(t))
    except ParseError:
        return binary.encode(text.parse(default))


def _pretty(b: bytes, indent: int) -> str:
    return text.stringify(binary.decode(b), WriteOptions(indent=max(0, indent)))


def _added(a: bytes, b: bytes):
    """An instant document moved by a duration document; null for any other types."""
    x, y = binary.decode(a), binary.decode(b)
    return binary.encode(values.Instant(x.ns + y.total_ns)) if isinstance(x, values.Instant) and isinstance(y, values.Duration) else None


def _path_text(b: bytes, path) -> str | None:
    try:
        found = values.walk(binary.decode(b), [None if p is None else str(p) for p in path])
    except KeyError:
        return None
    return None if found is None else found if isinstance(found, str) else text.stringify(found)


def _round_trips(b: bytes) -> bool:
    return binary.encode(text.parse(text.stringify(binary.decode(b)))) == b


def _with_member(d: bytes, key: str, member: bytes) -> bytes:
    """A key that is there keeps its place; a new one comes last."""
    whole = binary.decode(d)
    if not isinstance(whole, dict):
        raise ValueError("not an object")
    return binary.encode(whole | {key: binary.decode(member)})


def _appended(d: bytes, element: bytes) -> bytes:
    whole = binary.decode(d)
    if not isinstance(whole, list):
        raise ValueError("not an array")
    return binary.encode([*whole, binary.decode(element)])


def _keys(d: bytes) -> list[str]:
    """In stored order."""
    whole = binary.decode(d)
    if not isinstance(whole, dict):
        raise ValueError("not an object")
    return list(whole)


UDFS = {
    "xd_parse": parser(),
    "xd_try_parse": parser(attempt=True),
    "xd_parse_or": _each(_or_default, BinaryType(), 2),
    "xd_stringify": writer(name="xd_stringify"),
    "xd_to_json": writer(WriteOptions(json=True)),
    "xd_pretty": _each(_pretty, StringType(), 2),
    "xd_stringify_sorted": writer(WriteOptions(sort_keys=True)),
    "xd_is_valid": _each(text.is_valid, BooleanType()),
    "xd_decode": _each(lambda b: text.stringify(binary.decode(b)), StringType()),
    "xd_try_decode": _each(_tried(lambda b: text.stringify(binary.decode(b))), StringType()),
    "xd_is_valid_binary": _each(binary.decodable, BooleanType()),
    "xd_navigable": _each(lambda b: binary.navigable(binary.decode(b)), StringType(), name="xd_navigable"),
    "xd_from_navigable": _each(lambda t: binary.encode(binary.from_navigable(t)), BinaryType(), name="xd_from_navigable"),
    "xd_sort_key": _each(lambda b: binary.sort_key(binary.decode(b)), BinaryType()),
    "xd_strip_nulls": _each(lambda b: binary.encode(values.strip_nulls(binary.decode(b))), BinaryType()),
    "xd_contains": _each(lambda a, b: values.contains(binary.decode(a), binary.decode(b)), BooleanType(), 2),
    "xd_equal": _each(lambda a, b: values.equal(binary.decode(a), binary.decode(b)), BooleanType(), 2),
    "xd_add": _each(_added, BinaryType(), 2),
    "xd_round_trips": _each(_round_trips, BooleanType()),
    "xd_with_member": _each(_with_member, BinaryType(), 3),
    "xd_appended": _each(_appended, BinaryType(), 2),
    "xd_stored_keys": _each(_keys, ArrayType(StringType())),
    "xd_path_text_of": _each(_path_text, StringType(), 2),
}
