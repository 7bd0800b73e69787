"""The binary format, a memcomparable sort key, and the navigable JSON form of documents."""

from __future__ import annotations

import json
import math
import struct
from decimal import Decimal
from functools import lru_cache
from uuid import UUID

from .values import UNDEFINED, BigInt, Duration, Instant, type_name

# Fixed values of the binary format: type bytes. 0x32 and 0x33 are this library's own.
NULL, FALSE, TRUE, INT8, INT16, INT32, INT64, UINT64, FLOAT32, FLOAT64, BIGINT, DECIMAL = 0x00, 0x01, 0x02, 0x10, 0x11, 0x12, 0x13, 0x14, 0x15, 0x16, 0x17, 0x18
STRING, BINARY, DATE, UUID_, INSTANT, DURATION, ARRAY, OBJECT, UNDEF = 0x20, 0x21, 0x30, 0x31, 0x32, 0x33, 0x40, 0x41, 0xF0


_SMALL = [bytes([n]) for n in range(128)]


class DecodeError(ValueError):
    pass


def varint(n: int) -> bytes:
    if n < 128:
        return _SMALL[n]
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


_DOUBLE, _SHORT, _INT, _LONG = (struct.Struct(c) for c in ("<Bd", "<Bh", "<Bi", "<Bq"))  # with the type byte
_TINY = [bytes([INT8, n & 255]) for n in range(-128, 128)]
_TEXT = [bytes([STRING, n]) for n in range(128)]
_CONSTANT = {NULL: None, FALSE: False, TRUE: True, UNDEF: UNDEFINED}
# Keys repeat from document to document: bytes of names and names of bytes, the first so many that come.
_RAW_KEYS: dict[str, bytes] = {}
_KEYS: dict[bytes, str] = {}
_HELD_KEYS, _HELD_LENGTH = 4096, 64


def encode(value) -> bytes:
    out: list[bytes] = []
    _encode(value, out)
    return b"".join(out)


def _raw_key(key: str) -> bytes:
    raw = key.encode("utf-8", "surrogatepass")
    raw = varint(len(raw)) + raw
    if len(_RAW_KEYS) < _HELD_KEYS and len(raw) <= _HELD_LENGTH:
        _RAW_KEYS[key] = raw
    return raw


def _encode(value, out: list[bytes]) -> None:
    """What is commonest comes first."""
    kind = type(value)
    if kind is str:
        raw = value.encode("utf-8", "surrogatepass")
        n = len(raw)
        out.append((_TEXT[n] if n < 128 else b"\x20" + varint(n)) + raw)
    elif kind is int:
        out.append(_integer(value))
    elif kind is float:
        out.append(_real(value))
    elif kind is dict:
        out.append(b"\x41" + varint(len(value)))
        held = _RAW_KEYS.get
        for k, v in value.items():
            out.append(held(k) or _raw_key(k))
            _encode(v, out)
    elif kind is list:
        out.append(b"\x40" + varint(len(value)))
        for v in value:
            _encode(v, out)
    elif value is None:
        out.append(b"\x00")
    else:
        _encode_typed(value, out)


def _encode_typed(value, out: list[bytes]) -> None:
    kind = type_name(value)
    if kind == "boolean":
        out.append(b"\x02" if value else b"\x01")
    elif kind == "undefined":
        out.append(b"\xf0")
    elif kind == "bigint":
        digits = str(abs(value)).encode()
        out.append(b"\x17" + varint(len(digits) << 1 | (value < 0)) + digits)
    elif kind == "decimal128":
        digits = str(value).encode()
        out.append(b"\x18" + varint(len(digits)) + digits)
    elif kind == "binary":
        out.append(b"\x21" + varint(len(value)) + value)
    elif kind == "uuid":
        out.append(b"\x31" + value.bytes)
    elif kind == "instant":
        out.append(b"\x32" + value.ns.to_bytes(16, "little", signed=True))
    elif kind == "duration":
        out.append(b"\x33" + _SPAN.pack(value.years, value.months, value.days, value.hours, value.minutes, value.ns, value.negative))
    elif kind == "unknown":
        raise TypeError(f"no document value: {type(value).__name__}")
    else:  # subclasses of plain types
        plain = {"string": str, "array": list, "object": dict}.get(kind) or (float if isinstance(value, float) else int)
        _encode(plain(value), out)


def _integer(value: int) -> bytes:
    if -128 <= value < 128:
        return _TINY[value + 128]
    if -(1 << 15) <= value < 1 << 15:
        return _SHORT.pack(INT16, value)
    if -(1 << 31) <= value < 1 << 31:
        return _INT.pack(INT32, value)
    if -(1 << 63) <= value < 1 << 63:
        return _LONG.pack(INT64, value)
    return _DOUBLE.pack(FLOAT64, float(value))


def _real(value: float) -> bytes:
    if not value.is_integer():
        return _DOUBLE.pack(FLOAT64, value) if math.isfinite(value) else b"\x00"
    if abs(value) > 1 << 53 or (value == 0 and math.copysign(1, value) < 0):
        return _DOUBLE.pack(FLOAT64, value)
    return _integer(int(value))


_SPAN = struct.Struct("<5iq?")
_FIXED = {t: struct.Struct(c) for t, c in ((INT8, "<b"), (INT16, "<h"), (INT32, "<i"), (INT64, "<q"), (UINT64, "<Q"), (FLOAT32, "<f"), (FLOAT64, "<d"))}


def _size(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(data):
            raise DecodeError("unexpected end")
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7
        if shift > 35:
            raise DecodeError("length too long")


def _name(raw: bytes) -> str:
    key = raw.decode("utf-8", "surrogatepass")
    if len(_KEYS) < _HELD_KEYS and len(raw) <= _HELD_LENGTH:
        _KEYS[raw] = key
    return key


@lru_cache(4096)
def _span(raw: bytes) -> Duration:
    return Duration(*_SPAN.unpack(raw))


def _value(data: bytes, at: int) -> tuple:
    """The value at a place, and where the next one begins."""
    if at >= len(data):
        raise DecodeError("unexpected end")
    tag = data[at]
    at += 1
    if tag == STRING:
        n = data[at] if at < len(data) else 128
        if n < 128:
            at += 1
        else:
            n, at = _size(data, at)
        end = at + n
        if end > len(data):
            raise DecodeError("unexpected end")
        return data[at:end].decode("utf-8", "surrogatepass"), end
    if fixed := _FIXED.get(tag):
        end = at + fixed.size
        if end > len(data):
            raise DecodeError("unexpected end")
        return fixed.unpack_from(data, at)[0], end
    if tag in _CONSTANT:
        return _CONSTANT[tag], at
    if tag == OBJECT:
        count, at = _size(data, at)
        found, held, whole = {}, _KEYS.get, len(data)
        for _ in range(count):
            if at >= whole:
                raise DecodeError("unexpected end")
            n = data[at]
            if n < 128:
                at += 1
            else:
                n, at = _size(data, at)
            end = at + n
            if end > whole:
                raise DecodeError("unexpected end")
            raw = data[at:end]
            key = held(raw)
            if key is None:
                key = _name(raw)
            found[key], at = _value(data, end)
        return found, at
    if tag == ARRAY:
        count, at = _size(data, at)
        items = []
        for _ in range(count):
            item, at = _value(data, at)
            items.append(item)
        return items, at
    if tag in (BIGINT, DECIMAL, BINARY):
        n, at = _size(data, at)
        end = at + (n >> 1 if tag == BIGINT else n)
    elif tag in (DATE, UUID_, INSTANT, DURATION):
        end = at + (8 if tag == DATE else 29 if tag == DURATION else 16)
    else:
        raise DecodeError(f"unknown type {tag:#x}")
    if end > len(data):
        raise DecodeError("unexpected end")
    raw = data[at:end]
    if tag == BIGINT:
        return BigInt(("-" if n & 1 else "") + raw.decode()), end
    if tag == DECIMAL:
        return Decimal(raw.decode()), end
    if tag == INSTANT:
        return Instant(int.from_bytes(raw, "little", signed=True)), end
    if tag == DURATION:
        return _span(raw), end
    if tag == UUID_:
        return UUID(bytes=raw), end
    return (raw if tag == BINARY else Instant(struct.unpack("<q", raw)[0] * 1_000_000)), end


def decode(data: bytes):
    """The document at the start of ``data``; what follows it is ignored."""
    return _value(data if type(data) is bytes else bytes(data), 0)[0]


def decodable(data: bytes) -> bool:
    try:
        decode(data)
    except (ValueError, ArithmeticError):
        return False
    return True


# ---------------------------------------------------------------- order

RANK = {k: n for n, k in enumerate(("null", "boolean", "number", "bigint", "decimal128", "string", "uuid", "instant", "array", "object", "duration", "binary", "undefined"))}


def sort_key(value) -> bytes:
    """Bytes in the order of documents; equal only for equal encodings."""
    return _key(value) + b"\x00" + encode(value)


def _escaped(raw: bytes) -> bytes:
    return raw.replace(b"\x00", b"\x00\xff") + b"\x00\x01"


def _signed(n: int) -> bytes:
    """Integers of any size: sign, length of length, length, magnitude."""
    raw = abs(n).to_bytes((abs(n).bit_length() + 7) // 8, "big")
    body = len(raw).to_bytes(4, "big") + raw
    return b"\x01" + body if n >= 0 else b"\x00" + bytes(255 - b for b in body)


def _decimal(value: Decimal) -> bytes:
    sign, digits, exponent = value.as_tuple()
    text = "".join(map(str, digits)).lstrip("0").rstrip("0")
    if not text:
        return b"\x01"
    top = len("".join(map(str, digits)).lstrip("0")) + exponent
    body = (top + (1 << 31)).to_bytes(4, "big") + text.encode() + b"\x00"
    return b"\x00" + bytes(255 - b for b in body) if sign else b"\x02" + body


def _key(value) -> bytes:
    kind = type_name(value)
    head = bytes([RANK[kind] + 1])
    if kind == "boolean":
        return head + (b"\x01" if value else b"\x00")
    if kind == "number":
        bits = struct.unpack(">Q", struct.pack(">d", float(value) + 0.0))[0]
        return head + (bits ^ (1 << 64) - 1 if bits >> 63 else bits ^ 1 << 63).to_bytes(8, "big")
    if kind == "bigint":
        return head + _signed(int(value))
    if kind == "decimal128":
        return head + _decimal(value)
    if kind == "string":
        return head + _escaped(value.encode("utf-8", "surrogatepass"))
    if kind == "uuid":
        return head + value.bytes
    if kind == "instant":
        return head + _signed(value.ns)
    if kind == "duration":
        return head + _signed(value.total_ns)
    if kind == "binary":
        return head + _escaped(value)
    if kind == "array":
        return head + b"".join(map(_key, value)) + b"\x00"
    if kind == "object":
        return head + b"".join(b"\x01" + _escaped(k.encode("utf-8", "surrogatepass")) + _key(value[k]) for k in sorted(value)) + b"\x00"
    return head


# ---------------------------------------------------------------- navigation

_TO_JSON = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


def navigable(value) -> str:
    """JSON for Spark's VARIANT: typed scalars as one-key objects, keys that begin with $ with one more."""
    return _TO_JSON(_navigable(value))


_WRAP = {"bigint": ("$n", lambda v: str(int(v))), "decimal128": ("$m", str), "uuid": ("$u", str), "instant": ("$i", lambda v: v.ns), "duration": ("$p", str), "binary": ("$b", bytes.hex), "undefined": ("$t", lambda _: "undefined")}


def _navigable(value):
    plain = type(value)
    if plain is str or plain is int:
        return value
    if plain is dict:
        return {("$" + k if k[:1] == "$" else k): _navigable(v) for k, v in value.items()}
    kind = type_name(value)
    if kind == "object":
        return {("$" + k if k.startswith("$") else k): _navigable(v) for k, v in value.items()}
    if kind == "array":
        return [_navigable(v) for v in value]
    if kind == "number":
        return value if isinstance(value, int) or math.isfinite(value) else None
    if kind in _WRAP:
        tag, make = _WRAP[kind]
        return {tag: make(value)}
    return value


_MAKE = {"$n": BigInt, "$m": Decimal, "$u": UUID, "$i": lambda v: Instant(int(v)), "$p": Duration.parse, "$b": bytes.fromhex, "$t": lambda _: UNDEFINED}


def _unwrapped(members: dict):
    if len(members) == 1:
        (tag, inner), = members.items()
        if make := _MAKE.get(tag):
            return make(inner)
    for k in members:
        if k[:2] == "$$":
            return {(k[1:] if k.startswith("$$") else k): v for k, v in members.items()}
    return members


_FROM_JSON = json.JSONDecoder(object_hook=_unwrapped).decode


def from_navigable(text: str):
    """The document of such JSON (also of plain JSON whose keys don't begin with $)."""
    return _FROM_JSON(text)
