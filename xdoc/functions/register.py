"""Registration: every xd_ function becomes a temporary SQL function of a session."""

from __future__ import annotations

import weakref

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import decimals
from .codec import UDFS
from .native import DEFINITIONS

_DONE: weakref.WeakSet = weakref.WeakSet()
_FIRST = ("xd_typeof", "xd_text", "xd_field", "xd_element", "xd_path", "xd_numeric", "xd_instant", "xd_utc_ns", "xd_to_timestamp", "xd_duration", "xd_elements", "xd_extract_instant", "xd_path_text")


def register(spark: SparkSession) -> SparkSession:
    """Make the functions known to a session, once."""
    if spark not in _DONE:
        for name, udf in (UDFS | decimals.UDFS).items():
            spark.udf.register(name, udf)
        for name in [*_FIRST, *(n for n in DEFINITIONS if n not in _FIRST)]:
            parameters, result, body = DEFINITIONS[name]
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
        _DONE.add(spark)
    return spark


def call(name: str, *arguments) -> Column:
    """A registered function on columns; plain Python values become literals, lists arrays of them."""
    def column(x):
        if isinstance(x, Column):
            return x
        if isinstance(x, (list, tuple)):
            return F.array(*map(F.lit, x)).cast("array<string>")
        return F.lit(x)

    return F.call_function(name if name.startswith("xd_") else f"xd_{name}", *map(column, arguments))


def document(d: Column) -> Column:
    """The navigable VARIANT of a canonical binary column; do it once, at ingest."""
    return F.parse_json(call("navigable", d))
