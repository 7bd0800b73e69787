"""Documents from columns and rows, and columns from documents, by type at plan time, without Python.

A *fragment* is the navigable JSON of one value (see ``binary.navigable``): fragments
join to arrays and objects as text and become a VARIANT with ``parse_json``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.register import call

NULL = "null"


def quoted(text: Column) -> Column:
    """A string as a JSON string; null where it is."""
    array = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(array, F.lit(2), F.length(array) - 2))


def _tagged(tag: str, text: Column) -> Column:
    return F.concat(F.lit(f'{{"{tag}":"'), text, F.lit('"}'))


def fragment(value: Column, kind: T.DataType, plain: bool = False) -> Column:
    """The fragment of a column of that type; null where the column is. ``plain``: ordinary JSON, without types."""
    if isinstance(kind, T.BooleanType):
        return value.cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), NULL).otherwise(value.cast("double").cast("string"))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)) or plain and isinstance(kind, (T.LongType, T.DecimalType)):
        return value.cast("string")
    if isinstance(kind, T.LongType) or isinstance(kind, T.DecimalType) and kind.scale == 0:
        return _tagged("$n", value.cast("string"))
    if isinstance(kind, T.DecimalType):
        return _tagged("$m", value.cast("string"))
    if isinstance(kind, T.TimestampType) and not plain:
        return F.concat(F.lit('{"$i":'), (F.unix_micros(value) * 1000).cast("string"), F.lit("}"))
    if isinstance(kind, T.TimestampNTZType) and not plain:
        return F.concat(F.lit('{"$i":'), (F.unix_micros(F.to_utc_timestamp(value, "UTC").cast("timestamp")) * 1000).cast("string"), F.lit("}"))
    if isinstance(kind, T.BinaryType):
        return quoted(F.hex(value)) if plain else _tagged("$b", F.lower(F.hex(value)))
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    if isinstance(kind, T.ArrayType):
        return F.when(value.isNotNull(), joined(F.transform(value, lambda x: F.coalesce(fragment(x, kind.elementType, plain), F.lit(NULL)))))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), members([(f.name, fragment(value[f.name], f.dataType, plain)) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.concat(_key(e["key"].cast("string")), F.coalesce(fragment(e["value"], kind.valueType, plain), F.lit(NULL))))
        return F.when(value.isNotNull(), F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")))
    return quoted(value.cast("string"))


def _key(key: Column) -> Column:
    return F.concat(quoted(F.when(key.startswith("$"), F.concat(F.lit("$"), key)).otherwise(key)), F.lit(":"))


def joined(fragments: Column) -> Column:
    """An array of fragments as the fragment of an array."""
    return F.concat(F.lit("["), F.array_join(fragments, ","), F.lit("]"))


def members(pairs: list[tuple[str | Column, Column]]) -> Column:
    """Keys and fragments as the fragment of an object, in that order; a null key is an error."""
    parts = []
    for key, value in pairs:
        key = F.lit(key) if isinstance(key, str) else F.when(key.isNull(), F.raise_error(F.lit("null key"))).otherwise(key.cast("string"))
        parts.append(F.concat(_key(key), F.coalesce(value, F.lit(NULL))))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def typed(df: DataFrame, value: Column | str, plain: bool = False) -> Column:
    """The fragment of a column of ``df``."""
    value = F.col(value) if isinstance(value, str) else value
    return fragment(value, df.select(value.alias("x")).schema["x"].dataType, plain)


def build_object(df: DataFrame, *arguments, plain: bool = False) -> Column:
    """A VARIANT object of keys and columns by turns."""
    if len(arguments) % 2:
        raise ValueError("keys and values come in pairs")
    pairs = zip(arguments[::2], arguments[1::2], strict=True)
    return F.parse_json(members([(k, typed(df, v if isinstance(v, Column) else F.lit(v), plain)) for k, v in pairs]))


def object_document(df: DataFrame, *arguments) -> Column:
    """As ``build_object``, but canonical: members stay in this order."""
    if len(arguments) % 2:
        raise ValueError("keys and values come in pairs")
    pairs = zip(arguments[::2], arguments[1::2], strict=True)
    return call("from_navigable", members([(k, typed(df, v if isinstance(v, Column) else F.lit(v))) for k, v in pairs]))


def row_document(df: DataFrame, *columns: str) -> Column:
    """A row as a canonical document, members in column order."""
    return call("from_navigable", members([(c, typed(df, F.col(f"`{c}`"))) for c in columns or df.columns]))


def build_array(df: DataFrame, *values, plain: bool = False) -> Column:
    return F.parse_json(joined(F.array(*(F.coalesce(typed(df, v if isinstance(v, Column) else F.lit(v), plain), F.lit(NULL)) for v in values))))


def from_row(df: DataFrame, *columns: str, plain: bool = False, omit_empty: bool = False) -> Column:
    """A row as a VARIANT object, whose members a VARIANT keeps sorted by key (``members`` writes them in column order); ``omit_empty`` leaves null columns out."""
    names = columns or df.columns
    if not omit_empty:
        return F.parse_json(members([(c, typed(df, F.col(f"`{c}`"), plain)) for c in names]))
    parts = [F.concat(_key(F.lit(c)), typed(df, F.col(f"`{c}`"), plain)) for c in names]  # null where the column is: concat_ws skips it
    return F.parse_json(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def project(v: Column, schema: T.StructType) -> list[Column]:
    """Typed columns of an object's members; unknown members are ignored, misfits null."""
    out = []
    for f in schema.fields:
        at = call("field", v, f.name)
        if isinstance(f.dataType, T.DecimalType):
            found = call("numeric", at).cast(f.dataType)
        elif isinstance(f.dataType, T.LongType):
            found = call("numeric", at).cast("long")
        elif isinstance(f.dataType, T.TimestampType):
            ns = F.try_variant_get(at, '$["$i"]', "bigint")
            found = F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000)))
        elif isinstance(f.dataType, T.StringType):
            found = F.when(call("typeof", at) != "null", call("text", at))
        else:
            found = F.try_variant_get(at, "$", f.dataType.simpleString())
        out.append(found.alias(f.name))
    return out


# ---------------------------------------------------------------- aggregates

def array_agg(value: Column, *order_by: Column, descending: bool = False) -> Column:
    """Fragments as the fragment of an array, nulls skipped; no rows give an empty array. Order only with ``order_by``."""
    if not order_by:
        return joined(F.collect_list(value))
    keyed = F.when(value.isNotNull(), F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order_by)), value.alias("x")))
    return joined(F.transform(F.sort_array(F.collect_list(keyed), not descending), lambda s: s["x"]))


def object_agg(key: Column, value: Column, *order_by: Column) -> Column:
    """Keys and fragments as the fragment of an object; pairs with a null are skipped. The last of a key's pairs wins and gives its place."""
    pair = F.when(key.isNotNull() & value.isNotNull(), F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order_by)), key.cast("string").alias("k"), value.alias("x")))
    pairs = F.collect_list(pair)
    pairs = F.sort_array(pairs) if order_by else pairs
    placed = F.array_sort(F.transform(pairs, lambda s, i: F.struct(s["k"].alias("k"), i.alias("i"), s["x"].alias("x"))))
    last = lambda a: F.filter(a, lambda s, i: F.coalesce(F.get(a, i + 1)["k"] != s["k"], F.lit(True)))
    kept = F.get(F.transform(F.array(placed), last), F.lit(0))  # sorted once, not once for each pair
    in_place = F.array_sort(F.transform(kept, lambda s: F.struct(s["i"].alias("i"), s["k"].alias("k"), s["x"].alias("x"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(in_place, lambda s: F.concat(_key(s["k"]), s["x"])), ","), F.lit("}"))
