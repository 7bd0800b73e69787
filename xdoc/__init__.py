"""Typed documents on Spark: text and binary codecs, navigation, predicates, order, aggregates, time, sources and an index."""

from .functions.register import call, document, register
from .text import ParseError, ParseOptions, WriteOptions, parse, stringify
from .values import UNDEFINED, BigInt, Duration, Instant

__all__ = ["UNDEFINED", "BigInt", "Duration", "Instant", "ParseError", "ParseOptions", "WriteOptions", "call", "document", "parse", "register", "stringify"]
