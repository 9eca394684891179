"""Primitive types: their Spark types, what they accept from JSON, how they are stored and emitted."""

from __future__ import annotations

import math
import re
import struct
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatch

#: Type names of the schema language, with the Spark type that stores each.
PRIMITIVES: dict[str, T.DataType] = {
    "String": T.StringType(), "Bool": T.BooleanType(), "Int": T.LongType(), "UInt": T.DecimalType(20, 0),
    "Float": T.FloatType(), "Double": T.DoubleType(), "DateTime": T.TimestampType(),
}
_I64, _U64 = 1 << 63, 1 << 64
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: A date, a time of day and an offset are all required.
_INSTANT = re.compile(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(\.\d+)?([Zz]|[+-]\d\d:\d\d)")
#: Milliseconds that a timestamp of microseconds can hold.
_MOST_MS = (_I64 - 1) // 1000


def _whole(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def _milliseconds(value: object) -> int | None:
    if _whole(value):
        return value if -_MOST_MS <= value <= _MOST_MS else None
    if not isinstance(value, str) or not (m := _INSTANT.fullmatch(value)):
        return None
    day, time, fraction, offset = m.groups()
    try:
        at = datetime.fromisoformat(f"{day}T{time}{'+00:00' if offset in 'Zz' else offset}")
    except ValueError:
        return None
    return (at - _EPOCH) // timedelta(milliseconds=1) + int(((fraction or ".") + "000")[1:4])


def coerce(kind: str, value: object, field: str) -> object:
    """The stored value of a JSON value; TypeMismatch if the type doesn't take it.  Instants become epoch milliseconds."""
    if kind == "String" and isinstance(value, str):
        return value
    if kind == "Bool" and isinstance(value, bool):
        return value
    if kind == "Int" and _whole(value) and -_I64 <= value < _I64:
        return value
    if kind == "UInt" and _whole(value) and 0 <= value < _U64:
        return Decimal(value)
    if kind in ("Float", "Double") and (_whole(value) or isinstance(value, float)):
        try:
            out = float(value)
            out = struct.unpack("<f", struct.pack("<f", out))[0] if kind == "Float" else out
        except OverflowError:
            out = math.inf
        if math.isfinite(out):
            return out
    if kind == "DateTime" and (ms := _milliseconds(value)) is not None:
        return ms
    raise TypeMismatch(field, kind)


def incoming_type(kind: str) -> T.DataType:
    """Type of a coerced value."""
    return T.LongType() if kind == "DateTime" else PRIMITIVES[kind]


def store(kind: str, value: Column) -> Column:
    """From a coerced value to the stored one."""
    return F.timestamp_millis(value) if kind == "DateTime" else value


def emit(kind: str, value: Column) -> Column:
    """From the stored value to the one that answers hold: epoch milliseconds, rounded down, and widened floats."""
    if kind == "DateTime":
        return F.unix_millis(value)
    return value.cast("double") if kind == "Float" else value
