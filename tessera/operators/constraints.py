"""Violations of references, keys, nullability and lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.profile import duplicates
from tessera.sources.spec import TableSpec


def _renamed(parent: DataFrame, columns: list[str], parent_columns: list[str]) -> DataFrame:
    return parent.select(*[F.col(f"`{p}`").alias(f"_p{k}") for k, p in enumerate(parent_columns[: len(columns)])])


def _matched(child: DataFrame, parent: DataFrame, columns: list[str], parent_columns: list[str], how: str) -> DataFrame:
    keys = _renamed(parent, columns, parent_columns)
    cond = None
    for k, c in enumerate(columns):
        one = child[f"`{c}`"] == keys[f"_p{k}"]
        cond = one if cond is None else cond & one
    return child.join(keys, cond, how)


def reference_violations(child: DataFrame, parent: DataFrame, columns: list[str], parent_columns: list[str]) -> DataFrame:
    """Child rows whose whole reference is not in the parent; a null in any part is no violation.

    An anti join, which Spark broadcasts where the parent's keys are measured to be small and sorts otherwise.
    """
    return _matched(child.dropna("any", subset=columns), parent, columns, parent_columns, "left_anti")


def reference_found(child: DataFrame, parent: DataFrame, columns: list[str], parent_columns: list[str]) -> DataFrame:
    """Child rows whose reference is in the parent."""
    return _matched(child, parent, columns, parent_columns, "left_semi")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, violations): nulls of each column, all counted in one aggregation."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{k}") for k, c in enumerate(columns)])
    pairs = ", ".join(f"'{c}', c{k}" for k, c in enumerate(columns))
    return row.selectExpr(f"stack({len(columns)}, {pairs}) as (column_name, violations)")


def length_counts(df: DataFrame, most: dict[str, int]) -> DataFrame:
    """(column_name, violations): values longer than allowed, all counted in one aggregation."""
    cols = list(most)
    row = df.agg(*[F.count_if(F.length(F.col(f"`{c}`")) > most[c]).alias(f"c{k}") for k, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', c{k}" for k, c in enumerate(cols))
    return row.selectExpr(f"stack({len(cols)}, {pairs}) as (column_name, violations)")


def duplicate_rows(df: DataFrame, key: list[str], keep_first: bool = False) -> DataFrame:
    """(rows): how many rows share their key with another; with keep_first, all but one of each key."""
    d = duplicates(df, key, "_n")
    return d.agg(F.coalesce(F.sum(F.col("_n") - (1 if keep_first else 0)), F.lit(0)).alias("rows"))


def check(df: DataFrame, spec: TableSpec, parents: dict[str, DataFrame] | None = None) -> dict[str, int]:
    """Violations by name: not_null:c, length:c, key:(c, ...), reference:(c, ...). Columns that df lacks are passed over."""
    own = set(df.columns)
    required = [c for c in spec.required() if c in own]
    most = {c: n for c, n in spec.max_length.items() if c in own}
    out: dict[str, int] = {}
    exprs = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"not_null:{c}") for c in required] + [F.count_if(F.length(F.col(f"`{c}`")) > n).alias(f"length:{c}") for c, n in most.items()]
    if exprs:
        out |= df.agg(*exprs).first().asDict()
    for key in spec.keys():
        if own.issuperset(key):
            out[f"key:({', '.join(key)})"] = duplicate_rows(df.dropna("any", subset=list(key)), list(key)).first()["rows"]
    for fk in spec.foreign_keys:
        if own.issuperset(fk.columns) and parents and fk.parent in parents:
            out[f"reference:({', '.join(fk.columns)})"] = reference_violations(df, parents[fk.parent], list(fk.columns), list(fk.parent_columns)).count()
    return out
