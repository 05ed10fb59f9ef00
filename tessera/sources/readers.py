"""Inputs of any form as DataFrames, nested rows made flat, and settings from YAML-like files."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rows_frame(spark: SparkSession, rows: list[Mapping]) -> DataFrame:
    """Rows as mappings; a key that a row lacks is null in it, and keys that differ in case are one. Nested values become
    JSON text."""
    spelled: dict[str, str] = {}
    for k in (k for r in rows for k in r):
        spelled.setdefault(str(k).lower(), str(k))
    rows = [{spelled[str(k).lower()]: v for k, v in r.items()} for r in rows]
    names = list(spelled.values())
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    plain = lambda v: json.dumps(v) if isinstance(v, (dict, list)) else None if isinstance(v, float) and v != v else v
    data = [tuple(plain(r.get(n)) for n in names) for r in rows]
    kinds = [{type(v) for v in column if v is not None} for column in zip(*data, strict=True)]
    mixed = [k not in ({int}, {float}, {str}, {bool}, {bytes}) and len(k) != 1 for k in kinds]
    wide = [k == {int, float} for k in kinds]
    data = [tuple(None if v is None else float(v) if w else str(v) if m and k else v for v, m, w, k in zip(r, mixed, wide, kinds, strict=True)) for r in data]
    fields = []
    for n, k, m, w in zip(names, kinds, mixed, wide, strict=True):
        one = next(iter(k)) if len(k) == 1 else None
        kind = {int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType()}.get(one)
        if kind is None and w:
            kind = T.DoubleType()
        if kind is None and one is not None and one is not str:
            kind = {"datetime": T.TimestampNTZType(), "date": T.DateType(), "Decimal": T.DecimalType(38, 9)}.get(one.__name__)
        fields.append(T.StructField(n, kind or T.StringType()))
    return spark.createDataFrame(data, T.StructType(fields))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN made null in all fractional columns."""
    cols = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in cols}) if cols else df


def read_any(spark: SparkSession, source: Any, schema: T.StructType | str | None = None) -> DataFrame:
    """A DataFrame from a DataFrame (Spark's or pandas'), a mapping, rows, or a path.

    .csv comes as text with a header (types are the caster's business), .parquet, .orc and .json as they are, .xlsx and
    .xls by pandas where it can. A mapping of lists is columns, one of single values is a row. A path that doesn't exist
    or of another kind is an error at once. NaN becomes null.
    """
    if isinstance(source, DataFrame):
        return without_nan(source)
    if hasattr(source, "to_dict") and hasattr(source, "columns"):
        rows = source.astype(object).where(source.notna(), None).to_dict("records")
        return rows_frame(spark, rows) if rows else spark.createDataFrame([], T.StructType([T.StructField(str(c), T.StringType()) for c in source.columns]))
    if isinstance(source, Mapping):
        listed = [isinstance(v, (list, tuple)) for v in source.values()]
        if source and all(listed):
            return rows_frame(spark, [dict(zip(source, r, strict=True)) for r in zip(*source.values(), strict=True)])
        return rows_frame(spark, [dict(source)])
    if isinstance(source, (list, tuple)):
        return rows_frame(spark, [dict(r) for r in source])
    path = str(source)
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not any(c in path for c in "*?[{") and not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == ".csv":
        return reader.option("header", True).option("inferSchema", False).option("multiLine", False).option("escape", '"').csv(path)
    if kind in (".parquet", ".orc", ".json"):
        return without_nan(getattr(reader, kind[1:])(path))
    if kind in (".xlsx", ".xls"):
        try:
            import pandas as pd

            return read_any(spark, pd.read_excel(path))
        except ImportError as e:
            raise ValueError(f"reading {kind} needs a package that isn't there: {e.name}") from e
    raise ValueError(f"files of kind {kind!r} can't be read")


def flatten(df: DataFrame, last_of: tuple[str, ...] = ("photo",), separator: str = "_") -> DataFrame:
    """Structs become columns a_b_c; arrays and maps JSON text, but of arrays named in last_of the last element, flat."""

    def leaves(c: Column, kind: T.DataType, name: str, field: str):
        if isinstance(kind, T.ArrayType) and field in last_of:
            c, kind = F.try_element_at(c, F.lit(-1)), kind.elementType
        if isinstance(kind, T.StructType):
            for f in kind:
                yield from leaves(c.getField(f.name), f.dataType, f"{name}{separator}{f.name}", f.name)
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            yield F.to_json(c).alias(name)
        else:
            yield c.alias(name)

    return df.select(*[x for f in df.schema for x in leaves(F.col(f"`{f.name}`"), f.dataType, f.name, f.name)])


# ---------------------------------------------------------------- settings

_VARIABLE = re.compile(r"\$\{([A-Za-z_]\w*)(?::([^}]*))?\}")


def substitute(value: Any, environ: Mapping[str, str] | None = None) -> Any:
    """${NAME} and ${NAME:default} in all strings of a structure; a name without value or default is an error."""
    environ = os.environ if environ is None else environ
    if isinstance(value, Mapping):
        return {k: substitute(v, environ) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, environ) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        got = environ.get(m[1], m[2])
        if got is None:
            raise ValueError(f"variable {m[1]} isn't set and has no default")
        return got

    return _VARIABLE.sub(one, value)


def load_config(text: str, environ: Mapping[str, str] | None = None, strict: bool = True) -> dict:
    """Settings from YAML where a YAML package is there, else from JSON; strict asks for an active server that is listed."""
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        raw = json.loads(text)
    config = substitute(raw or {}, environ)
    if strict:
        servers = config.get("servers")
        if not isinstance(servers, Mapping) or not servers:
            raise ValueError("settings need servers")
        if config.get("active") not in servers:
            raise ValueError(f"the active server {config.get('active')!r} isn't among {', '.join(servers)}")
    return config


def database_uri(config: Mapping, name: str | None = None) -> str:
    server = config["servers"].get(name or config.get("active"))
    if server is None:
        raise ValueError(f"there is no server {name!r}")
    return server if isinstance(server, str) else server["uri"]
