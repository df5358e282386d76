"""Structs to columns, and schemas to plain Python."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from lamella.plans.naming import col
from lamella.plans.schema import schema_of

FIXED_SIZE = "fixed_size"


def unnest_rename(df: DataFrame, column: str, separator: str = ".") -> DataFrame:
    """A struct column's fields as columns in its place, named ``<column><separator><field>``."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.StructType):
        raise ValueError(f"Column '{column}' has type {kind.simpleString()}, not a struct.")
    out: list[Column] = []
    for n in df.columns:
        out += [col(n).getField(f).alias(f"{n}{separator}{f}") for f in kind.names] if n == column else [col(n)]
    return df.select(*out)


def unnest_all(df: DataFrame, separator: str = ".") -> DataFrame:
    """Every struct at any depth to columns, in one projection; arrays stay as they are."""
    out: list[Column] = []

    def walk(value: Column, kind: T.DataType, name: str) -> None:
        if isinstance(kind, T.StructType) and kind.fields:
            for f in kind.fields:
                walk(value.getField(f.name), f.dataType, f"{name}{separator}{f.name}")
        else:
            out.append(value.alias(name))

    if not any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        return df
    for f in df.schema.fields:
        walk(col(f.name), f.dataType, f.name)
    return df.select(*out)


def convert_schema(schema: T.StructType | DataFrame) -> dict[str, Any]:
    """A schema as nested Python: arrays ``[inner]``, fixed-size arrays (by field metadata) ``(inner, size)``, structs dictionaries, other types themselves."""

    def of(kind: T.DataType, metadata: dict | None = None) -> Any:
        if isinstance(kind, T.ArrayType):
            inner = of(kind.elementType)
            return (inner, metadata[FIXED_SIZE]) if metadata and FIXED_SIZE in metadata else [inner]
        if isinstance(kind, T.StructType):
            return {f.name: of(f.dataType, f.metadata) for f in kind.fields}
        return kind

    return {f.name: of(f.dataType, f.metadata) for f in schema_of(schema).fields}
