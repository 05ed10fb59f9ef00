"""A deterministic trial of changes: which rows are inserted, upserted and updated follows from a hash of their key, so that
every run makes the same trial, and the table that a trial should give is computed beside it, by another way."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import dml


@dataclass(frozen=True)
class Slices:
    """There from the start; new to it; known and new rows with changed values; rows that are updated in place."""

    base: DataFrame
    inserts: DataFrame
    upserts: DataFrame
    updated: Column


def _part(key: list[str], seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in key]), F.lit(100))


def mutated(c: Column, kind: T.DataType) -> Column:
    """Another value of the same type, the same for the same value: numbers by one more, text backwards, times a day on."""
    if isinstance(kind, T.BooleanType):
        return ~c
    if isinstance(kind, T.NumericType):
        return (c + 1).cast(kind)
    if isinstance(kind, T.StringType):
        return F.concat(F.reverse(c), F.lit("*"))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return (c + F.expr("interval 1 day")).cast(kind)
    return c


def slices(df: DataFrame, key: list[str], seed: int = 42, absent: int = 30, changed: int = 40) -> Slices:
    """Of a hundred rows about `absent` aren't there at first; half of them are inserted, and the rest, with about
    `changed` known ones in changed form, upserted."""
    part, rest = _part(key, seed), [f for f in df.schema if f.name not in key]
    new = df.where(part < absent)
    other = df.select(*[F.col(f"`{k}`") for k in key], *[mutated(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rest]).select(*df.columns)
    return Slices(df.where(part >= absent), new.where(part < absent // 2), new.where(part >= absent // 2).unionByName(other.where((part >= absent) & (part < absent + changed))), part >= 100 - absent)


def expected(df: DataFrame, key: list[str], column: str, value, seed: int = 42, absent: int = 30, changed: int = 40) -> DataFrame:
    """What slices and an update of `column` should lead to, row by row, without joins."""
    part, out = _part(key, seed), []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.name not in key:
            c = F.when((part >= absent) & (part < absent + changed), mutated(c, f.dataType)).otherwise(c)
        if f.name == column:
            c = F.when(part >= 100 - absent, F.lit(value).cast(f.dataType)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def trial(df: DataFrame, key: list[str], column: str, value, insert: Callable | None = None, upsert: Callable | None = None, seed: int = 42) -> DataFrame:
    """The keys at which a cycle of inserts, upserts and an update differs from what it should give; none if all is well."""
    s = slices(df, key, seed)
    table = (insert or (lambda t, rows: t.unionByName(rows)))(s.base, s.inserts)
    table = (upsert or (lambda t, rows: dml.upsert(t, rows, key)))(table, s.upserts)
    table = table.withColumn(column, F.when(s.updated, F.lit(value).cast(df.schema[column].dataType)).otherwise(F.col(f"`{column}`")))
    return dml.differing(table, expected(df, key, column, value, seed), key)
