"""The text format: a JSON superset with typed scalars, comments, bare keys and trailing commas."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from decimal import Decimal
from uuid import UUID

from .values import UNDEFINED, BigInt, Duration, Instant


class ParseError(ValueError):
    """Why and where a text is not a document."""

    def __init__(self, code: str, message: str, text: str, position: int):
        self.code, self.position = code, position
        self.line = text.count("\n", 0, position) + 1
        self.column = position - text.rfind("\n", 0, position)
        super().__init__(f"{message} at line {self.line}, column {self.column}")


@dataclass(frozen=True)
class ParseOptions:
    trailing_commas: bool = True
    comments: bool = True
    unquoted_keys: bool = True
    instants: bool = True
    durations: bool = True
    max_depth: int = 1000
    max_string: int = 1 << 30


@dataclass(frozen=True)
class WriteOptions:
    bigint_suffix: bool = True
    instants: bool = True
    durations: bool = True
    indent: int = 0
    quote_keys: bool = False
    sort_keys: bool = False
    ascii: bool = False
    json: bool = False  #: valid JSON: typed scalars as strings, decimals as numbers


_SPACE = re.compile(r"[ \t\r\n]+")
_SPACE_COMMENTS = re.compile(r"(?:[ \t\r\n]+|//[^\n]*|/\*(?s:.*?)\*/)+")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![\w$-])")
_INSTANT = re.compile(r"\d{4}-\d\d-\d\dT[\d:.]+(?:Z|[+-]\d\d:?\d\d)?(?![\w$])")
_DURATION = re.compile(r"-?P[0-9TYMWDHS.]+(?![\w$])")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?([nm])?(?![\w$.])")
_WORD = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_PLAIN = {q: re.compile(rf"[^{q}\\]*") for q in "\"'`"}
# What most members and elements are: a key and its colon; a number, string without escapes or constant, and what ends it.
_S = r"[ \t\r\n]*+"
_TOKEN = r"""('[^'\\]*+'|-?(?:0|[1-9]\d*+)(?:n|(?:\.\d++)?m?)|"[^"\\]*+"|true|false|null|\d{4}-\d\d-\d\dT[\d:.]++Z|P[0-9TYMWDHS.]++)"""
_MEMBER = re.compile(rf"""{_S}([A-Za-z_$][A-Za-z0-9_$]*+|"[^"\\]*+"|'[^'\\]*+'){_S}:{_S}(?:{_TOKEN}{_S}([,}}]))?""", re.ASCII)
_ELEMENT = re.compile(rf"{_S}{_TOKEN}{_S}([,\]])", re.ASCII)
_ESCAPES = {'"': '"', "'": "'", "`": "`", "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_WORDS = {"true": True, "false": False, "null": None, "undefined": UNDEFINED}


def _number(digits: str, inexact: str | None) -> int | float:
    if inexact or len(digits) > 17:
        return float(digits)
    return int(digits) if abs(int(digits)) <= 1 << 53 else float(digits)


_MISS = object()
# Keys repeat from document to document: what the first so many that come stand for.
_KEYS: dict[str, str] = {}


def _key_of(token: str) -> str | None:
    """None where it is a reserved word."""
    if token in _WORDS:
        return None
    key = token[1:-1] if token[0] in "\"'" else token
    if len(_KEYS) < 4096 and len(token) <= 64:
        _KEYS[token] = key
    return key


def _scalar(token: str, longest: int):
    """The value of a ``_TOKEN``, or ``_MISS`` where it takes a closer look."""
    first, last = token[0], token[-1]
    if first == "'" or first == '"':
        return token[1:-1] if len(token) - 2 <= longest else _MISS
    if last <= "9" and first != "P":
        return float(token) if "." in token else int(token) if len(token) < 16 else _number(token, None)
    if last == "n":
        return BigInt(token[:-1])
    if last == "m":
        return Decimal(token[:-1]) if len(token) <= 35 else _MISS
    if token in _WORDS:
        return _WORDS[token]
    try:
        return Duration.parse(token) if first == "P" else Instant.parse(token)
    except ValueError:
        return _MISS


class _Parser:
    def __init__(self, text: str, options: ParseOptions):
        self.text, self.options, self.at = text, options, 0
        self.space = _SPACE_COMMENTS if options.comments else _SPACE
        self.quick = options.instants and options.durations

    def fail(self, code: str, message: str, at: int | None = None):
        raise ParseError(code, message, self.text, self.at if at is None else at)

    def skip(self) -> str:
        """The next significant character, empty at the end."""
        c = self.text[self.at : self.at + 1]
        if c and c not in " \t\r\n/":
            return c
        m = self.space.match(self.text, self.at)
        if m:
            self.at = m.end()
        c = self.text[self.at : self.at + 1]
        if c == "/":
            self.fail("comment", "comment that does not end" if self.options.comments and self.text.startswith("/*", self.at) else "unexpected '/'")
        return c

    def document(self):
        value = self.value(0)
        if self.skip():
            self.fail("trailing_data", "unexpected text after the document")
        return value

    def value(self, depth: int):
        if depth > self.options.max_depth:
            self.fail("depth", "nested too deeply")
        c = self.skip()
        if not c:
            self.fail("unexpected_end", "unexpected end")
        if c == "{":
            return self.object(depth)
        if c == "[":
            return self.array(depth)
        if c in _PLAIN:
            return self.string(c)
        return self.scalar(c)

    def scalar(self, c: str):
        text, at, options = self.text, self.at, self.options
        if text[at + 8 : at + 9] == "-" and (m := _UUID.match(text, at)):
            self.at = m.end()
            return UUID(m[0])
        if options.instants and c.isdigit() and (m := _INSTANT.match(text, at)):
            self.at = m.end()
            try:
                return Instant.parse(m[0])
            except ValueError:
                self.fail("instant", "invalid instant", at)
        if options.durations and (c == "P" or text.startswith("-P", at)) and (m := _DURATION.match(text, at)):
            self.at = m.end()
            try:
                return Duration.parse(m[0])
            except ValueError:
                self.fail("duration", "invalid duration", at)
        if m := _NUMBER.match(text, at):
            self.at = m.end()
            fraction, exponent, suffix = m.groups()
            digits = m[0][:-1] if suffix else m[0]
            if suffix == "n":
                if fraction or exponent:
                    self.fail("bigint", "a bigint has no fraction or exponent", at)
                return BigInt(digits)
            if suffix == "m":
                value = Decimal(digits)
                if len(value.as_tuple().digits) > 34 or not -6143 - 33 <= value.as_tuple().exponent <= 6144:
                    self.fail("decimal", "a decimal has 34 digits at most", at)
                return value
            return _number(digits, fraction or exponent)
        m = _WORD.match(text, at)
        if m and m[0] in _WORDS:
            self.at = m.end()
            return _WORDS[m[0]]
        self.fail("unexpected_token", f"unexpected {text[at : at + 1]!r}")

    def string(self, quote: str) -> str:
        text, start = self.text, self.at
        plain, parts = _PLAIN[quote], []
        self.at += 1
        while True:
            m = plain.match(text, self.at)
            parts.append(m[0])
            self.at = m.end()
            c = text[self.at : self.at + 1]
            if c == quote:
                self.at += 1
                break
            if not c:
                self.fail("unexpected_end", "string that does not end", start)
            e = text[self.at + 1 : self.at + 2]
            if e == "u":
                code = self.unit(self.at)
                self.at += 6
                if 0xD800 <= code < 0xDC00 and text.startswith("\\u", self.at):
                    low = self.unit(self.at)
                    if 0xDC00 <= low < 0xE000:
                        code = 0x10000 + ((code - 0xD800) << 10) + low - 0xDC00
                        self.at += 6
                parts.append(chr(code) if not 0xD800 <= code < 0xE000 else "\ufffd")
            elif e in _ESCAPES and e:
                parts.append(_ESCAPES[e])
                self.at += 2
            else:
                self.fail("escape", "invalid escape")
        value = "".join(parts)
        if len(value) > self.options.max_string:
            self.fail("string_length", "string too long", start)
        return value

    def unit(self, at: int) -> int:
        digits = self.text[at + 2 : at + 6]
        if not re.fullmatch(r"[0-9a-fA-F]{4}", digits):
            self.fail("escape", "invalid \\u escape", at)
        return int(digits, 16)

    def key(self) -> str:
        c = self.skip()
        if c in _PLAIN and c:
            return self.string(c)
        m = _WORD.match(self.text, self.at)
        if not m or not self.options.unquoted_keys:
            self.fail("key", "expected a key")
        if m[0] in _WORDS:
            self.fail("key", f"reserved word {m[0]} as a key")
        self.at = m.end()
        return m[0]

    def more(self, close: str) -> bool:
        """After a member: whether another follows."""
        c = self.skip()
        if c == close:
            self.at += 1
            return False
        if c != ",":
            self.fail("unexpected_end" if not c else "unexpected_token", f"expected ',' or '{close}'")
        self.at += 1
        return not self.closed(close)

    def closed(self, close: str) -> bool:
        """After a comma: whether nothing follows it."""
        if self.skip() == close:
            if not self.options.trailing_commas:
                self.fail("trailing_comma", "trailing comma")
            self.at += 1
            return True
        return False

    def object(self, depth: int) -> dict:
        self.at += 1
        found: dict = {}
        if self.skip() == "}":
            self.at += 1
            return found
        text, longest, held = self.text, self.options.max_string, _KEYS.get
        match = _MEMBER.match if self.quick and self.options.unquoted_keys and depth < self.options.max_depth else None
        comma = False  # whether one was just read, so that the object may end
        while True:
            m = match(text, self.at) if match else None
            if m and m.end() - self.at <= longest and (key := held(m[1]) or _key_of(m[1])) is not None:
                if (end := m[3]) and (value := _scalar(m[2], longest)) is not _MISS:
                    found[key] = value
                    self.at = m.end()
                    if end == "}":
                        return found
                    comma = True
                    continue
                self.at = m.start(2) if end else m.end()
            else:
                if comma and self.closed("}"):
                    return found
                key = self.key()
                if self.skip() != ":":
                    self.fail("unexpected_token", "expected ':'")
                self.at += 1
            found[key] = self.value(depth + 1)
            if not self.more("}"):
                return found
            comma = False

    def array(self, depth: int) -> list:
        self.at += 1
        found: list = []
        if self.skip() == "]":
            self.at += 1
            return found
        text, longest = self.text, self.options.max_string
        match = _ELEMENT.match if self.quick and depth < self.options.max_depth else None
        comma = False
        while True:
            m = match(text, self.at) if match and text[self.at : self.at + 1] != "{" else None
            if m and (value := _scalar(m[1], longest)) is not _MISS:
                found.append(value)
                self.at = m.end()
                if m[2] == "]":
                    return found
                comma = True
                continue
            if comma and self.closed("]"):
                return found
            found.append(self.value(depth + 1))
            if not self.more("]"):
                return found
            comma = False


def parse(text: str, options: ParseOptions = ParseOptions()):
    """The document that a text holds; ParseError where it holds none."""
    try:
        return _Parser(text, options).document()
    except RecursionError:
        raise ParseError("depth", "nested too deeply", text, 0) from None


def is_valid(text: str, options: ParseOptions = ParseOptions()) -> bool:
    return parse_or(text, _WORDS, options) is not _WORDS


def parse_or(text: str, default, options: ParseOptions = ParseOptions()):
    try:
        return parse(text, options)
    except ParseError:
        return default


# ---------------------------------------------------------------- writing

_BARE = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*\Z")
_SPECIAL, _SPECIAL_ASCII = re.compile(r"""[\x00-\x1f\\"'`]"""), re.compile(r"""[^ -~]|[\\"'`]""")
_CONTROL = {"\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def quote(text: str, options: WriteOptions = WriteOptions()) -> str:
    """In the quotes that need fewest escapes: single before double before backtick."""
    if not (_SPECIAL_ASCII if options.ascii else _SPECIAL).search(text):
        return f'"{text}"' if options.json else f"'{text}'"
    mark = '"' if options.json else min("'\"`", key=text.count)
    out = []
    for c in text:
        if c == mark:
            out.append("\\" + c)
        elif c in _CONTROL:
            out.append(_CONTROL[c])
        elif c < " " or (options.ascii and c > "~"):
            out.append("".join(f"\\u{int.from_bytes(u, 'big'):04x}" for u in _units(c)))
        else:
            out.append(c)
    return mark + "".join(out) + mark


def _units(c: str):
    raw = c.encode("utf-16-be", "surrogatepass")
    return [raw[k : k + 2] for k in range(0, len(raw), 2)]


def number(value: float | int) -> str:
    """Shortest text that reads back as the same number; null where there is none."""
    if isinstance(value, int):
        return str(value)
    if value.is_integer() and abs(value) < 1e21:
        return "-0" if value == 0 and math.copysign(1, value) < 0 else str(int(value))
    text = repr(value)
    if "e" in text:
        return text.replace("e+", "e").replace("e-0", "e-")
    return text if math.isfinite(value) else "null"


def _plain(value: Decimal) -> str:
    text = str(value)
    return text.replace("E", "e").replace("e+", "e") if "E" in text else text


_DEFAULT = WriteOptions()


def stringify(value, options: WriteOptions = _DEFAULT) -> str:
    """Text of a document; compact unless an indent is given."""
    return _compact(value) if options is _DEFAULT or options == _DEFAULT else _write(value, options, "")


# Keys repeat from document to document: the texts of the first so many that come.
_KEY_TEXTS: dict[str, str] = {}


def _key_text(key: str) -> str:
    text = (key if _bare(key, _DEFAULT) else quote(key)) + ":"
    if len(_KEY_TEXTS) < 4096 and len(key) <= 64:
        _KEY_TEXTS[key] = text
    return text


def _compact(value) -> str:
    """As ``_write`` under default options."""
    kind = type(value)
    if kind is str:
        return f"'{value}'" if not _SPECIAL.search(value) else quote(value)
    if kind is int:
        return str(value)
    if kind is float:
        return number(value)
    if kind is BigInt:
        return f"{int(value)}n"
    if kind is Decimal:
        return _plain(value) + "m"
    if isinstance(value, dict):
        held = _KEY_TEXTS.get
        return "{" + ",".join([(held(k) or _key_text(k)) + _compact(v) for k, v in value.items()]) + "}"
    if isinstance(value, list):
        return "[" + ",".join([_compact(v) for v in value]) + "]"
    if value is None:
        return "null"
    return scalar_text(value)


def scalar_text(value, options: WriteOptions = WriteOptions()) -> str:
    if value is None:
        return "null"
    if value is UNDEFINED:
        return "null" if options.json else "undefined"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, BigInt):
        return f'"{int(value)}"' if options.json else f"{int(value)}{'n' if options.bigint_suffix else ''}"
    if isinstance(value, (int, float)):
        return number(value)
    if isinstance(value, Decimal):
        return _plain(value) + ("" if options.json else "m")
    if isinstance(value, str):
        return quote(value, options)
    if isinstance(value, (Instant, Duration)):
        bare = not options.json and (options.instants if isinstance(value, Instant) else options.durations)
        return str(value) if bare else quote(str(value), options)
    if isinstance(value, UUID):
        return f'"{value}"' if options.json else str(value)
    if isinstance(value, bytes):
        return quote(value.hex(), options)
    raise TypeError(f"no document value: {type(value).__name__}")


def _write(value, options: WriteOptions, margin: str) -> str:
    if type(value) is str:
        return quote(value, options)
    if type(value) is int or type(value) is float:
        return number(value)
    if not isinstance(value, (dict, list)):
        return scalar_text(value, options)
    if not value:
        return "{}" if isinstance(value, dict) else "[]"
    inner = margin + " " * options.indent
    if isinstance(value, dict):
        items = sorted(value.items()) if options.sort_keys else value.items()
        colon = ": " if options.indent else ":"
        parts = [(k if _bare(k, options) else quote(k, options)) + colon + _write(v, options, inner) for k, v in items]
        a, b = "{}"
    else:
        parts, (a, b) = [_write(v, options, inner) for v in value], "[]"
    if options.indent <= 0:
        return a + ",".join(parts) + b
    return f"{a}\n{inner}" + f",\n{inner}".join(parts) + f"\n{margin}{b}"


def _bare(key: str, options: WriteOptions) -> bool:
    return not options.json and not options.quote_keys and key not in _WORDS and _BARE.match(key) is not None
