"""Containment of a constant document as native predicates: nothing is decoded per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..binary import navigable
from ..functions.native import field, inner, is_object, keys, kind, let
from ..text import parse
from ..values import type_name


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Compiler:
    def __init__(self):
        self.n = 0

    def contains(self, v: str, doc) -> str:
        if isinstance(doc, dict):
            parts = [is_object(v)]
            for k, x in doc.items():
                at = field(v, _literal(k))
                parts.append(self.contains(at, x) if isinstance(x, (dict, list)) else self.equal(at, x))
            return "(" + " AND ".join(parts) + ")"
        if isinstance(doc, list):
            array = f"try_variant_get({v}, '$', 'array<variant>')"
            parts = [f"{array} IS NOT NULL"]
            for x in doc:
                self.n += 1
                parts.append(f"exists({array}, xd_e{self.n} -> {self.equal(f'xd_e{self.n}', x)})")
            return "(" + " AND ".join(parts) + ")"
        return self.equal(v, doc)

    def equal(self, v: str, doc) -> str:
        """Structural equality with a constant; false where ``v`` is null."""
        name = type_name(doc)
        if name == "object":
            parts = [is_object(v), f"size({keys(v)}) = {len(doc)}", *(self.equal(field(v, _literal(k)), x) for k, x in doc.items())]
        elif name == "array":
            array = f"try_variant_get({v}, '$', 'array<variant>')"
            parts = [f"size({array}) = {len(doc)}", *(self.equal(f"get({array}, {i})", x) for i, x in enumerate(doc))]
        elif name == "null":
            parts = [f"{kind(v)} = 'null'"]
        elif name == "boolean":
            parts = [f"{kind(v)} = 'boolean'", f"try_variant_get({v}, '$', 'boolean') = {str(doc).lower()}"]
        elif name == "number":
            parts = [f"{kind(v)} = 'number'", f"try_variant_get({v}, '$', 'double') = CAST('{doc!r}' AS DOUBLE)"]
        elif name == "string":
            parts = [f"{kind(v)} = 'string'", f"try_variant_get({v}, '$', 'string') = {_literal(doc)}"]
        else:
            tag, text = navigable(doc)[2:-1].split('":', 1)
            parts = [f"{kind(v)} = '{name}'", f"{inner(v, tag, 'string')} = {_literal(text.strip(chr(34)))}"]
        return "coalesce(" + " AND ".join(parts) + ", false)"


def contains(column: str, doc) -> Column:
    """Whether the VARIANT column contains a document given as a value or as text; null where the column is."""
    doc = parse(doc) if isinstance(doc, str) else doc
    return F.expr(let(column, lambda v: f"CASE WHEN {v} IS NOT NULL THEN {_Compiler().contains(v, doc)} END"))
