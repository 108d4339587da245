"""JSON of any shape: its schema from all rows, and columns of its leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def inferred(df: DataFrame, column: str) -> DataType:
    """The type that all values of a JSON column have in common: types of tasks are merged, so one pass and no sample. Text that isn't JSON counts as null."""
    told = df.agg(F.schema_of_variant_agg(F.try_parse_json(column))).first()[0] or "VOID"
    plain = told.replace("OBJECT<", "STRUCT<")
    return df.sparkSession.sql(f"SELECT CAST(NULL AS {plain.replace('VOID', 'STRING')}) AS x").schema["x"].dataType


def _leaves(kind: DataType, path: str = "$") -> list[tuple[str, str, DataType]]:
    if isinstance(kind, StructType):
        return [x for f in kind.fields for x in _leaves(f.dataType, f"{path}.{f.name}" if f.name.isidentifier() else f'{path}["{f.name}"]')]
    return [(path, path.removeprefix("$").lstrip("."), kind)]


def shredded(df: DataFrame, column: str, kind: DataType | None = None, prefix: str = "") -> DataFrame:
    """``df`` with a column for each leaf of its JSON ``column``, named by its path; arrays stay arrays.

    A value that hasn't the leaf's type gives null, as does one without the leaf.
    With a given ``kind`` there is no pass to infer it.
    """
    kind = kind or inferred(df, column)
    parsed = df.withColumn("_v", F.try_parse_json(column))
    return parsed.select(*df.columns, *[F.try_variant_get("_v", path, k.simpleString()).alias(f"{prefix}{name or column}") for path, name, k in _leaves(kind)])
