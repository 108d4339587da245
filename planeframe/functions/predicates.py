"""The eight predicates of Filter as null-safe expressions, lowered by type family."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExecutionError, KernelValidationError

OPERATORS = ("eq", "ne", "lt", "le", "gt", "ge", "in", "contains")


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, T.NumericType | T.BooleanType):
        return "number"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, T.NullType):
        return "null"
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "time"
    return kind.typeName()


def _family_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, str):
        return "text"
    if isinstance(value, bool | int | float):
        return "number"
    return "array" if isinstance(value, list | tuple) else "object"


def _same(c: Column, kind: T.DataType, value: Any) -> Column:
    """Null-safe equality; values of different families are never equal, and true equals 1."""
    if value is None:
        return c.isNull()
    own = family(kind)
    if own == "time" and isinstance(value, str):
        return c.eqNullSafe(F.lit(value).cast(kind))
    if own != _family_of(value):
        return F.lit(False)
    if own == "number":
        value = int(value) if isinstance(value, bool) else value
        c = c.cast("int") if isinstance(kind, T.BooleanType) else c
    if own == "array":
        value = F.array(*map(F.lit, value)).cast(kind)
        return c.eqNullSafe(value)
    return c.eqNullSafe(F.lit(value))


def predicate(c: Column, kind: T.DataType, op: str, value: Any, name: str = "field") -> Column:
    """A boolean column, never null. Ordered comparisons fail on null and on values that have no order with the constant."""
    if op not in OPERATORS:
        raise KernelValidationError(f"no operator {op}")
    if op == "eq":
        return _same(c, kind, value)
    if op == "ne":
        return ~_same(c, kind, value)
    if op == "in":
        if not isinstance(value, list | tuple):
            raise ExecutionError("'in' expects an array")
        return reduce(lambda a, b: a | b, [_same(c, kind, v) for v in value], F.lit(False))
    if op == "contains":
        if family(kind) == "text":
            if not isinstance(value, str):
                raise ExecutionError(f"{name} is text, which contains only text")
            held = F.contains(c, F.lit(value))
        elif family(kind) == "array":
            held = F.exists(c, lambda x: _same(x, kind.elementType, value))
        else:
            raise ExecutionError(f"{name} is neither text nor an array")
        return F.when(c.isNull(), F.raise_error(F.lit(f"{name} is null"))).otherwise(held)
    own = family(kind)
    if own != _family_of(value) and not (own == "time" and isinstance(value, str)):
        raise ExecutionError(f"{name} has no order with the constant")
    if own == "number":
        c = c.cast("int") if isinstance(kind, T.BooleanType) else c
        right = F.lit(int(value) if isinstance(value, bool) else value)
    else:
        right = F.lit(value).cast(kind)
    told = {"lt": c < right, "le": c <= right, "gt": c > right, "ge": c >= right}[op]
    return F.when(c.isNull(), F.raise_error(F.lit(f"{name} is null"))).otherwise(told)
