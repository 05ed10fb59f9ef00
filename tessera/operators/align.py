"""Alignment of a frame to a table: names, strict conversions with failure limits, constraints, and new columns."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import casting, outliers
from tessera.operators.constraints import check
from tessera.plans.predicate import resolve
from tessera.sources.spec import TableSpec


@dataclass(frozen=True)
class AlignConfig:
    """failure_threshold: the share of values that may fail in a column (None: any). mode: strict raises beyond it,
    balanced and permissive leave the column as it came; outliers: failures that are outliers don't count."""

    mode: str = "balanced"
    failure_threshold: float | None = 0.1
    add_missing: bool = False
    outlier_method: str | None = None
    dayfirst: bool = True

    def __post_init__(self):
        if self.mode not in ("strict", "balanced", "permissive"):
            raise ValueError(f"mode {self.mode!r} is none of strict, balanced, permissive")


PRESETS = {"strict": AlignConfig("strict", 0.01), "balanced": AlignConfig("balanced", 0.1), "fast": AlignConfig("permissive", 0.2)}


class AlignmentError(ValueError):
    pass


@dataclass
class AlignReport:
    mapping: dict[str, str] = field(default_factory=dict)
    extra: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    added: list[str] = field(default_factory=list)
    rows: int = 0
    failures: dict[str, int] = field(default_factory=dict)
    untouched: list[str] = field(default_factory=list)
    violations: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def rates(self) -> dict[str, float]:
        return {c: n / self.rows if self.rows else 0.0 for c, n in self.failures.items()}

    def summary(self) -> dict:
        r = self.rates()
        return {"columns": len(self.mapping), "columns_with_failures": [c for c, n in self.failures.items() if n], "total_failures": sum(self.failures.values()), "average_rate": sum(r.values()) / len(r) if r else 0.0, "untouched": self.untouched, "violations": self.violations, "warnings": self.warnings}


@dataclass
class Aligned:
    df: DataFrame
    report: AlignReport
    spec: TableSpec


def strict(c: Column, kind: T.DataType, max_length: int | None = None, bits: int = 64, json: bool = False, source: T.DataType | None = None, dayfirst: bool = True) -> Column:
    """A value as the column's type, null where it isn't one in full: whole numbers in range, decimal numbers, words for
    true and false, times by format, JSON that parses, text of valid UTF-8 within its length, bytes that are bytes."""
    if json:
        return casting.to_json_text(F.to_json(c) if isinstance(source, (T.StructType, T.ArrayType, T.MapType)) else c)
    if isinstance(kind, T.IntegralType):
        return casting.to_integer(c, min(bits, {"byte": 8, "short": 16, "integer": 32}.get(kind.typeName(), 64))).cast(kind)
    if isinstance(kind, T.DecimalType):
        return casting.to_number(c).try_cast(kind)
    if isinstance(kind, T.FractionalType):
        return casting.to_number(c).cast(kind)
    if isinstance(kind, T.BooleanType):
        return casting.to_boolean(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        if isinstance(source, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return c.cast(kind)
        return casting.to_time(c, dayfirst).cast(kind)
    if isinstance(kind, T.BinaryType):
        return c if isinstance(source, T.BinaryType) else F.lit(None).cast("binary")
    s = F.to_json(c) if isinstance(source, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")
    ok = F.is_valid_utf8(s)
    if max_length:
        ok = ok & (F.length(s) <= max_length)
    return F.when(ok, s)


class Aligner:
    def __init__(self, spec: TableSpec, config: AlignConfig = AlignConfig()):
        self.spec, self.config = spec, config

    def mapping(self, df: DataFrame, col_map: dict[str, str] | None = None) -> tuple[dict[str, str], list[str]]:
        """({frame's column: table's}, columns that the table lacks); col_map comes first, then names in any case."""
        given = {k.lower(): v for k, v in (col_map or {}).items()}
        mapped, extra = {}, []
        for c in df.columns:
            own = resolve(given.get(c.lower(), c), self.spec.columns)
            if own is None or own in mapped.values():
                extra.append(c)
            else:
                mapped[c] = own
        return mapped, extra

    def align(self, df: DataFrame, col_map: dict[str, str] | None = None, parents: dict[str, DataFrame] | None = None) -> Aligned:
        """Two passes over the frame: one aggregation measures the failures of all columns, one projection converts.

        A column that the frame lacks stays out, so that an upsert leaves it alone; one that the table lacks is dropped
        with a warning, or with add_missing becomes a column of the table.
        """
        spec, cfg, report = self.spec, self.config, AlignReport()
        mapped, extra = self.mapping(df, col_map)
        if cfg.add_missing and extra:
            names = {c: (col_map or {}).get(c, c) for c in extra}
            plan = casting.plan_cast(df.select(*[F.col(f"`{c}`") for c in extra]))
            cast = plan.apply(df.select(*[F.col(f"`{c}`") for c in extra]))
            spec = replace(spec, schema=T.StructType([*spec.schema.fields, *[T.StructField(names[c], T.StringType() if isinstance(cast.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else cast.schema[c].dataType) for c in extra]]))
            mapped |= names
            report.added = [names[c] for c in extra]
            extra = []
        if extra:
            report.warnings.append(f"dropped: {', '.join(extra)}")
        report.mapping, report.extra, report.missing = mapped, extra, [c for c in spec.columns if c not in mapped.values()]
        back = {v: k for k, v in mapped.items()}
        order = [c for c in spec.columns if c in back]
        made = {}
        for c in order:
            kind, source = spec.schema[c].dataType, df.schema[back[c]].dataType
            made[c] = strict(F.col(f"`{back[c]}`"), kind, spec.max_length.get(c), spec.int_bits.get(c, 64), c in spec.json_columns, source, cfg.dayfirst)
        bounds = {}
        if cfg.outlier_method:
            numbers = [c for c in order if isinstance(spec.schema[c].dataType, T.NumericType)]
            measured = df.select(*[casting.to_number(F.col(f"`{back[c]}`")).alias(c) for c in numbers]) if numbers else None
            bounds = outliers.bounds(measured, numbers, method=cfg.outlier_method) if numbers else {}
        fails = {}
        for c in order:
            source = F.col(f"`{back[c]}`")
            bad = source.isNotNull() & made[c].isNull()
            if bounds.get(c):
                bad = bad & ~outliers.is_outlier(casting.to_number(source), bounds[c])
            fails[c] = bad
        row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(fails[c]).alias(f"f{k}") for k, c in enumerate(order)]).first()
        report.rows = row["_rows"]
        report.failures = {c: row[f"f{k}"] for k, c in enumerate(order)}
        out = []
        for c in order:
            rate = report.rates()[c]
            if report.failures[c] and cfg.failure_threshold is not None and rate > cfg.failure_threshold:
                if cfg.mode == "strict":
                    raise AlignmentError(f"{c}: {rate:.1%} of the values are no {spec.schema[c].dataType.simpleString()}")
                report.untouched.append(c)
                report.warnings.append(f"{c} is left as it came: {rate:.1%} of its values fail")
                out.append(F.col(f"`{back[c]}`").alias(c))
            else:
                out.append(made[c].alias(c))
        aligned = df.select(*out)
        report.violations = {k: n for k, n in check(aligned, spec, parents).items() if n}
        if report.violations and cfg.mode == "strict":
            raise AlignmentError("; ".join(f"{k}: {n}" for k, n in report.violations.items()))
        return Aligned(aligned, report, spec)


def align(df: DataFrame, spec: TableSpec, preset: str | AlignConfig = "balanced", **how) -> DataFrame:
    config = PRESETS[preset] if isinstance(preset, str) else preset
    return Aligner(spec, config).align(df, **how).df


def routed(df: DataFrame, spec: TableSpec, on_error: str = "coerce", col_map: dict[str, str] | None = None) -> Aligned:
    """Alignment by what text columns hold: JSON (in nine of ten values) goes on as compact JSON with sorted keys, nested
    values become such text, and other text stays as it is. on_error: coerce makes what doesn't fit null, raise is an
    error at the first column that has such a value."""
    if on_error not in ("coerce", "raise"):
        raise ValueError(f"on_error {on_error!r} is neither coerce nor raise")
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    kinds = casting.plan_cast(df.select(*[F.col(f"`{c}`") for c in text])).semantic if text else {}
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType))]
    made = {c: casting.to_json_text(F.col(f"`{c}`")) for c, k in kinds.items() if k == "STRUCTURED_OBJECT"}
    made |= {c: F.to_json(F.col(f"`{c}`")) for c in nested}
    config = AlignConfig("strict", 0.0) if on_error == "raise" else AlignConfig("permissive", None)
    return Aligner(spec, config).align(df.withColumns(made) if made else df, col_map)


strict_align = functools.partial(align, preset="strict")
fast_align = functools.partial(align, preset="fast")
safe_align = functools.partial(align, preset="balanced")


def aligned_to(spec: TableSpec, preset: str | AlignConfig = "balanced") -> Callable:
    """A decorator: the function's first argument is aligned before the call."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def call(df: DataFrame, *a, **k):
            return f(align(df, spec, preset), *a, **k)

        return call

    return wrap


def with_missing(df: DataFrame, spec: TableSpec) -> DataFrame:
    """All the table's columns in its order, typed null where df lacks one."""
    own = {c: resolve(c, df.columns) for c in spec.columns}
    return df.select(*[(F.col(f"`{own[f.name]}`") if own[f.name] else F.lit(None).cast(f.dataType)).alias(f.name) for f in spec.schema])


def failure_rates(df: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """(column_name, failures, rate) of conversions by column, measured in one aggregation."""
    names = list(kinds)
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNotNull() & kinds[c].isNull()).alias(f"f{k}") for k, c in enumerate(names)])
    pairs = ", ".join(f"'{c}', f{k}, case when _n = 0 then 0D else f{k} / _n end" for k, c in enumerate(names))
    return row.selectExpr(f"stack({len(names)}, {pairs}) as (column_name, failures, rate)")


def failing_values(df: DataFrame, kinds: dict[str, Column], order_by: list[str], most: int = 5) -> DataFrame:
    """(column_name, position, value): the first failing values of each column by an order.

    A bounded sort for each column: a task keeps `most` rows, so that no group of failures is gathered.
    """
    out = None
    for c, made in kinds.items():
        bad = df.where(F.col(f"`{c}`").isNotNull() & made.isNull()).orderBy(*[F.col(f"`{o}`") for o in order_by]).limit(most)
        w = Window.orderBy(*[F.col(f"`{o}`") for o in order_by])
        one = bad.select(F.lit(c).alias("column_name"), F.row_number().over(w).alias("position"), F.col(f"`{c}`").cast("string").alias("value"))
        out = one if out is None else out.unionAll(one)
    return out


def observed(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """df, and its rows and nulls by column, counted as an action runs over it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls:{c}") for c in df.columns]), seen
