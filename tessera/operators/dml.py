"""Insert, upsert, update and merge as plans: a table and rows in, the new table out."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.predicate import compile_predicate, literal, parse_predicate, resolve
from tessera.sources.spec import TableSpec

REASON = "_reason"


@dataclass
class Change:
    """The new table, and rows that were not taken (with the reason), where the operation has such."""

    table: DataFrame
    rejected: DataFrame | None = None
    accepted: DataFrame | None = None


def matched_names(df: DataFrame, target: DataFrame) -> DataFrame:
    """df with the target's spelling of its columns; one that the target lacks is an error."""
    names = {c: resolve(c, target.columns) for c in df.columns}
    if missing := [c for c, n in names.items() if n is None]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return df.withColumnsRenamed({c: n for c, n in names.items() if c != n})


def last_of_key(df: DataFrame, key: list[str], order_by: list[str] | None = None) -> DataFrame:
    """Of the rows of a key the last by order_by; rows with a null in the key all stay. Without an order, and among equals,
    the row that is largest column by column holds, so that the same rows always give the same table."""
    none = F.lit(False)
    for c in key:
        none = none | F.col(f"`{c}`").isNull()
    rest = [c for c in df.columns if c not in key]
    sortable = [f.name for f in df.schema if f.name in rest and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order_by = [*(order_by or []), *[c for c in sortable if c not in (order_by or [])]]
    if not order_by:
        return df.where(~none).dropDuplicates(key).unionByName(df.where(none))
    # the largest (order, row) by key is an aggregate with a partial step, so that a hot key is no sorted group
    ranked = df.where(~none).groupBy(*[F.col(f"`{c}`") for c in key]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[F.col(f"`{c}`") for c in order_by])).alias("_r"))
    return ranked.select(*[F.col(f"`{c}`") if c in key else F.col(f"_r.`{c}`").alias(c) for c in df.columns]).unionByName(df.where(none))


def upsert(target: DataFrame, source: DataFrame, key: list[str], order_by: list[str] | None = None) -> DataFrame:
    """Rows whose key the target has overwrite the columns that they bring (nulls too); the others are added.

    Of several rows of a key the last by order_by holds; columns of order_by that the target lacks serve for that only.
    A null in a key matches nothing. Without further columns, rows of known keys change nothing. One full join on the key.
    """
    order_by = order_by or []
    extra = [c for c in order_by if resolve(c, target.columns) is None]
    names = {c: resolve(c, target.columns) for c in source.columns if c not in extra}
    if missing := [c for c, n in names.items() if n is None]:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    source = source.withColumnsRenamed({c: n for c, n in names.items() if c != n})
    key = [resolve(k, target.columns) for k in key]
    if None in key or not set(key) <= set(source.columns):
        raise ValueError("the rows and the table need all columns of the key")
    source = last_of_key(source, key, [c if c in extra else names.get(c, c) for c in order_by]).drop(*extra)
    s = source.select(*[F.col(f"`{c}`").cast(target.schema[c].dataType).alias(f"_s_{c}") for c in source.columns], F.lit(True).alias("_s"))
    t = target.withColumn("_t", F.lit(True))
    cond = None
    for k in key:
        one = F.col(f"`{k}`") == F.col(f"`_s_{k}`")
        cond = one if cond is None else cond & one
    out = []
    for c in target.columns:
        if c in key:
            out.append(F.coalesce(F.col(f"`{c}`"), F.col(f"`_s_{c}`")).alias(c))
        elif c in source.columns:
            out.append(F.when(F.col("_s"), F.col(f"`_s_{c}`")).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return t.join(s, cond, "full_outer").select(*out)


def upsert_checked(target: DataFrame, source: DataFrame, spec: TableSpec, key: list[str], order_by: list[str] | None = None) -> Change:
    """An upsert of the rows that violate nothing; the others are rejected with a reason, the first that holds:

    not_null:column, key:columns (a null in the key), later:columns (a later row of the batch has the key). Columns that
    the rows lack must be nullable only where a row is new.
    """
    source = matched_names(source, target)
    key = [resolve(k, target.columns) for k in key]
    reason: Column = F.lit(None).cast("string")
    for c in reversed(key):
        reason = F.when(F.col(f"`{c}`").isNull(), F.lit(f"key:{','.join(key)}")).otherwise(reason)
    for c in reversed([c for c in spec.required() if c in source.columns and c not in key]):
        reason = F.when(F.col(f"`{c}`").isNull(), F.lit(f"not_null:{c}")).otherwise(reason)
    rows = source.withColumn(REASON, reason)
    if lacking := [c for c in spec.required() if c not in source.columns]:
        known = target.select(*[F.col(f"`{k}`") for k in key]).distinct().withColumn("_known", F.lit(True))
        rows = rows.join(known, key, "left").withColumn(REASON, F.coalesce(REASON, F.when(F.col("_known").isNull(), F.lit(f"not_null:{lacking[0]}")))).drop("_known")
    good = rows.where(F.col(REASON).isNull()).drop(REASON)
    accepted = last_of_key(good, key, order_by)
    # what a later row of its key stands for: all but one of each key's rows
    later = good.exceptAll(accepted).withColumn(REASON, F.lit(f"later:{','.join(key)}"))
    return Change(upsert(target, accepted, key), rows.where(F.col(REASON).isNotNull()).unionByName(later), accepted)


class Rejected(ValueError):
    """A row that an operation would not take."""


def taken_or_raise(change: Change, order_by: list[str]) -> DataFrame:
    """The new table if nothing was rejected; else an error that names the first rejected row and its reason."""
    first = first_errors(change.rejected, order_by, 1).collect()
    if first:
        row = first[0].asDict()
        raise Rejected(f"{row.pop(REASON)}: {row}")
    return change.table


def key_difference(one: DataFrame, two: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more often on one side: (key, side), side being 'one' or 'two'; a key comes as often as it is over."""
    a, b = (df.select(*[F.col(f"`{k}`") for k in key]) for df in (one, two))
    return a.exceptAll(b).withColumn("side", F.lit("one")).unionAll(b.exceptAll(a).withColumn("side", F.lit("two")))


def distinct_union(frames: list[DataFrame]) -> DataFrame:
    """The rows of all frames, each once; columns by name, null where a frame lacks one."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.distinct()


def first_errors(rejected: DataFrame, order_by: list[str], most: int = 10) -> DataFrame:
    """The first rejected rows by an order, with their reasons: a bounded sort."""
    return rejected.orderBy(*[F.col(f"`{c}`") for c in order_by], REASON).limit(most)


def chunk_counts(change: Change, chunk: Column) -> DataFrame:
    """(chunk, total, success, failed) of a checked change, by what chunk says of a row."""
    sides = change.accepted.select(chunk.alias("chunk"), F.lit(1).alias("ok")).union(change.rejected.select(chunk.alias("chunk"), F.lit(0).alias("ok")))
    return sides.groupBy("chunk").agg(F.count(F.lit(1)).alias("total"), F.sum("ok").alias("success"), F.sum(1 - F.col("ok")).alias("failed"))


def upsert_counts(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """(inserted, updated): how many rows an upsert adds and overwrites."""
    s = last_of_key(source, key).select(*[F.col(f"`{k}`").alias(f"_s{n}") for n, k in enumerate(key)])
    t = target.select(*[F.col(f"`{k}`").alias(f"_t{n}") for n, k in enumerate(key)], F.lit(True).alias("_t"))
    cond = None
    for n in range(len(key)):
        one = F.col(f"_s{n}") == F.col(f"_t{n}")
        cond = one if cond is None else cond & one
    return s.join(t, cond, "left").agg(F.count_if(F.col("_t").isNull()).alias("inserted"), F.count_if(F.col("_t").isNotNull()).alias("updated"))


def insert(target: DataFrame, source: DataFrame, spec: TableSpec, order_by: list[str] | None = None) -> Change:
    """Rows that violate nothing are added; the others are rejected with a reason.

    Reasons, the first that holds: not_null:column, key:columns (the table has the key), batch:columns (an earlier row of
    the batch has it). Columns that the rows lack are null. A null in a unique set matches nothing.
    """
    source = matched_names(source, target)
    reason: Column = F.lit(None).cast("string")
    for c in reversed(spec.required()):
        bad = F.col(f"`{c}`").isNull() if c in source.columns else F.lit(True)
        reason = F.when(bad, F.lit(f"not_null:{c}")).otherwise(reason)
    rows = source.withColumn(REASON, reason)
    for n, key in enumerate(spec.keys()):
        if not set(key) <= set(source.columns):
            continue
        name = ",".join(key)
        there = target.select(*[F.col(f"`{k}`").alias(f"_k{n}_{m}") for m, k in enumerate(key)], F.lit(True).alias(f"_there{n}")).distinct()
        cond, full = None, F.lit(True)
        for m, k in enumerate(key):
            one = F.col(f"`{k}`") == F.col(f"_k{n}_{m}")
            cond = one if cond is None else cond & one
            full = full & F.col(f"`{k}`").isNotNull()
        order = [F.col(f"`{c}`") for c in order_by or source.columns]
        # rows with a null in the key repeat nothing; a hash spreads them, so that they don't sort in one task
        apart = F.when(~full, F.xxhash64(*[F.col(f"`{c}`") for c in source.columns]))
        first = F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in key], apart).orderBy(F.col(REASON).isNotNull(), *order))
        rows = rows.join(there, cond, "left").drop(*[f"_k{n}_{m}" for m in range(len(key))])
        rows = rows.withColumn(REASON, F.coalesce(REASON, F.when(F.col(f"_there{n}"), F.lit(f"key:{name}")))).drop(f"_there{n}")
        rows = rows.withColumn(REASON, F.coalesce(REASON, F.when(full & (first > 1), F.lit(f"batch:{name}"))))
    accepted = rows.where(F.col(REASON).isNull()).drop(REASON)
    accepted = accepted.select(*[F.col(f"`{c}`").cast(target.schema[c].dataType).alias(c) for c in accepted.columns])
    return Change(target.unionByName(accepted, allowMissingColumns=True), rows.where(F.col(REASON).isNotNull()), accepted)


def with_all(df: DataFrame, spec: TableSpec) -> DataFrame:
    """All columns of the table, null where df lacks one."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in spec.schema])


def insert_if_absent(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """Rows of keys that the table lacks are added, one of each."""
    source = matched_names(source, target)
    new = last_of_key(source, key).join(target.select(*[F.col(f"`{k}`") for k in key]), key, "left_anti")
    return target.unionByName(new.select(*[c for c in target.columns if c in new.columns]), allowMissingColumns=True)


def update(target: DataFrame, values: Mapping[str, Any], conditions: Any, expression: str | None = None, allow_missing: bool = True) -> DataFrame:
    """Columns set to values (or to a Column's) where the predicate holds; a projection, without any join."""
    if not values:
        raise ValueError("nothing is set")
    names = {resolve(c, target.columns): v for c, v in values.items()}
    if None in names:
        raise ValueError(f"the table has no column {', '.join(c for c in values if resolve(c, target.columns) is None)}")
    known = {c.lower(): v for c, v in values.items()}
    holds = compile_predicate(parse_predicate(conditions, expression), target.schema, source=lambda f: F.lit(known[f.lower()]) if f.lower() in known else None, target=lambda n: F.col(f"`{n}`"), allow_missing=allow_missing)
    return target.withColumns({n: F.when(holds, v if isinstance(v, Column) else literal(v, target.schema[n].dataType).cast(target.schema[n].dataType)).otherwise(F.col(f"`{n}`")) for n, v in names.items()})


def updated_rows(target: DataFrame, conditions: Any, expression: str | None = None) -> DataFrame:
    """(updated): how many rows the predicate of an update selects."""
    return target.agg(F.count_if(compile_predicate(parse_predicate(conditions, expression), target.schema, target=lambda n: F.col(f"`{n}`"))).alias("updated"))


def merge(target: DataFrame, source: DataFrame, conditions: Any, expression: str | None = None, set_columns: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """A table and rows matched by any predicate in which ? stands for the row's value of the condition's column.

    Table rows with a match take set_columns (default: all the rows bring) from the last matching row by order_by; rows
    without a match are added. Equalities among the conditions make it a keyed join.
    """
    source = matched_names(source, target)
    order = order_by or source.columns
    s = source.select(*[F.col(f"`{c}`").cast(target.schema[c].dataType).alias(f"_s_{c}") for c in source.columns]).withColumn("_id", F.xxhash64(*[F.col(f"`_s_{c}`") for c in source.columns]))
    own = {c.lower(): c for c in source.columns}
    on = compile_predicate(parse_predicate(conditions, expression), target.schema, source=lambda f: F.col(f"`_s_{own[f.lower()]}`") if f.lower() in own else None, target=lambda n: F.col(f"`{n}`"))
    names = [resolve(c, target.columns) for c in set_columns] if set_columns is not None else source.columns
    # rows are known by two hashes of their columns: equal rows match alike, and a task that runs again finds the same
    every = [F.col(f"`{c}`") for c in target.columns]
    t = target.withColumns({"_r1": F.xxhash64(*every), "_r2": F.xxhash64(F.lit(1), *every)})
    best = t.join(s, on, "inner").groupBy("_r1", "_r2").agg(F.max_by(F.struct(*[F.col(f"`_s_{c}`").alias(c) for c in names]), F.struct(*[F.col(f"`_s_{c}`") for c in order])).alias("_b")) if names else t.select("_r1", "_r2").limit(0).withColumn("_b", F.lit(None))
    hit = F.col("_b").isNotNull()
    changed = t.join(best, ["_r1", "_r2"], "left").select(*[F.when(hit, F.col(f"_b.`{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in names else F.col(f"`{c}`") for c in target.columns])
    new = s.join(target, on, "left_anti").select(*[F.col(f"`_s_{c}`").alias(c) for c in source.columns])
    return changed.unionByName(new, allowMissingColumns=True)


def overlay(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Base rows with the values of changes that aren't null; keys that base lacks are passed over."""
    c = changes.select(*[F.col(f"`{k}`") for k in key], *[F.col(f"`{x}`").alias(f"_c_{x}") for x in changes.columns if x not in key])
    return base.join(c, key, "left").select(*[F.coalesce(F.col(f"`_c_{x}`"), F.col(f"`{x}`")).alias(x) if x in changes.columns and x not in key else F.col(f"`{x}`") for x in base.columns])


def differing(actual: DataFrame, expected: DataFrame, key: list[str], rtol: float = 1e-5, atol: float = 1e-8, seconds: float = 5) -> DataFrame:
    """Keys whose rows aren't close (fractions by tolerance, times by seconds, all else equal) or stand on one side only."""
    names = [c for c in expected.columns if c not in key]
    a = actual.select(*[F.col(f"`{k}`") for k in key], *[F.col(f"`{c}`").alias(f"_a_{c}") for c in names], F.lit(True).alias("_a"))
    e = expected.select(*[F.col(f"`{k}`") for k in key], *[F.col(f"`{c}`").alias(f"_e_{c}") for c in names], F.lit(True).alias("_e"))
    close = F.col("_a").isNotNull() & F.col("_e").isNotNull()
    for c in names:
        x, y, kind = F.col(f"`_a_{c}`"), F.col(f"`_e_{c}`"), expected.schema[c].dataType
        if isinstance(kind, T.FractionalType):
            near = F.abs(x - y) <= atol + rtol * F.abs(y)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            near = F.abs(F.unix_micros(x.cast("timestamp")) - F.unix_micros(y.cast("timestamp"))) <= seconds * 1_000_000
        else:
            near = x == y
        close = close & (x.isNull() & y.isNull() | F.coalesce(near, F.lit(False)))
    return a.join(e, key, "full_outer").where(~close).select(*key)
