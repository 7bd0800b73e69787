"""Decimals over the whole range of 34 digits and exponents from -6143 to 6144, as text, by Arrow functions.

``xd_decimal`` and ``xd_round`` stay native where DECIMAL(38,10) is enough; these
keep every digit, exponent and trailing zero. A null in gives a null out, as does
what is no decimal, a division by zero and a result out of range.
"""

from __future__ import annotations

import decimal
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

CONTEXT = decimal.Context(prec=34, rounding=decimal.ROUND_HALF_EVEN, Emin=-6143, Emax=6144, traps=[decimal.InvalidOperation, decimal.DivisionByZero, decimal.Overflow])
#: For digits asked for beyond those that an operand may have.
_WIDE = decimal.Context(prec=7000, rounding=decimal.ROUND_HALF_EVEN)
MODES = {"floor": decimal.ROUND_FLOOR, "ceil": decimal.ROUND_CEILING, "trunc": decimal.ROUND_DOWN, "even": decimal.ROUND_HALF_EVEN, "half": decimal.ROUND_HALF_UP}
OPERATIONS = {"add": CONTEXT.add, "subtract": CONTEXT.subtract, "multiply": CONTEXT.multiply, "divide": CONTEXT.divide, "remainder": CONTEXT.remainder}


def of(text: str) -> Decimal:
    value = Decimal(text.removesuffix("m"))
    if not value.is_finite() or len(value.as_tuple().digits) > CONTEXT.prec or not CONTEXT.Etiny() <= value.as_tuple().exponent <= CONTEXT.Emax:
        raise ValueError("no decimal of 34 digits")
    return value


def _text(value: Decimal) -> str:
    return str(value).replace("E", "e").replace("e+", "e")


def _precision(t: str, n: int) -> str:
    """That many significant digits."""
    if n < 1:
        raise ValueError("a precision is 1 at least")
    x = of(t)
    return _text(x.quantize(Decimal(1).scaleb((x.adjusted() if x else 0) - n + 1), context=_WIDE))


def _function(kind, one):
    def cell(xs):
        if any(x is None or x != x for x in xs):
            return None
        try:
            return one(*xs)
        except (KeyError, ValueError, ArithmeticError):
            return None

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([cell(xs) for xs in zip(*columns, strict=True)], dtype=object)

    return F.pandas_udf(run, kind)


UDFS = {
    "xd_decimal_calc": _function(StringType(), lambda a, operation, b: _text(OPERATIONS[operation](of(a), of(b)))),
    "xd_decimal_cmp": _function(IntegerType(), lambda a, b: int(of(a).compare(of(b)))),
    "xd_decimal_abs": _function(StringType(), lambda t: _text(of(t).copy_abs())),
    "xd_decimal_negate": _function(StringType(), lambda t: _text(of(t).copy_negate())),
    "xd_decimal_sign": _function(IntegerType(), lambda t: (of(t) > 0) - (of(t) < 0)),
    "xd_decimal_round": _function(StringType(), lambda t, n, mode: f"{of(t).quantize(Decimal(1).scaleb(-int(n)), MODES[mode], _WIDE):f}"),
    "xd_decimal_fixed": _function(StringType(), lambda t, n: f"{of(t).quantize(Decimal(1).scaleb(-int(n)), context=_WIDE):f}"),
    "xd_decimal_precision": _function(StringType(), lambda t, n: _precision(t, int(n))),
}
