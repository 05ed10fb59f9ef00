"""CREATE and ALTER statements for five dialects, from a schema and one aggregation over the data."""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.casting import is_structured
from tessera.plans.sqltext import RESERVED, dialect_of

# Longest names, and the longest text and bytes that a sized type holds (0: no sized type).
NAME_LENGTH = {"oracle": 30, "postgresql": 63, "mysql": 64, "mssql": 128, "sqlite": 128}
TEXT_LIMIT = {"oracle": 4000, "postgresql": 10485760, "mysql": 255, "mssql": 4000, "sqlite": 0}
BYTES_LIMIT = {"oracle": 2000, "postgresql": 0, "mysql": 255, "mssql": 0, "sqlite": 0}
TYPES = {
    #            boolean         float               float32          datetime     duration            json             text             bytes
    "sqlite": ("integer", "real", "real", "text", "real", "text", "text", "blob"),
    "postgresql": ("boolean", "double precision", "double precision", "timestamp", "double precision", "jsonb", "text", "bytea"),
    "mysql": ("boolean", "double", "double", "datetime", "bigint", "json", "longtext", "longblob"),
    "mssql": ("bit", "float", "float", "datetime2", "float", "nvarchar(max)", "nvarchar(max)", "varbinary(max)"),
    "oracle": ("NUMBER(1,0)", "BINARY_DOUBLE", "BINARY_FLOAT", "TIMESTAMP", "NUMBER", "JSON", "CLOB", "BLOB"),
}
TEXT_TYPE = {"postgresql": "varchar({})", "mysql": "varchar({})", "mssql": "nvarchar({})", "oracle": "VARCHAR2({} CHAR)"}
BYTES_TYPE = {"mysql": "varbinary({})", "oracle": "RAW({})"}
ON_DELETE = ("CASCADE", "SET NULL", "SET DEFAULT", "RESTRICT", "NO ACTION")


# ---------------------------------------------------------------- names


def sanitize(name: str, dialect: str = "postgresql", fallback: str = "col_1", allow_space: bool = False, lower: bool = True) -> str:
    """A name of word characters: others become _, a leading digit gets _ before it, a keyword _ behind it."""
    s = re.sub(r"[^\w\s]" if allow_space else r"[^\w]", "_", str(name).strip())
    s = re.sub(r"\s+", " ", s) if allow_space else s
    s = re.sub("__+", "_", s.lower() if lower else s).strip("_")
    s = s or fallback
    s = "_" + s if s[0].isdigit() else s
    return s + "_" if s.lower() in RESERVED or keyword.iskeyword(s) or s.upper() in ("DATABASE", "ROLE", "SCHEMA", "LIMIT") else s


def sanitize_all(names: Iterable[str], dialect: str = "postgresql", **how) -> list[str]:
    seen: dict[str, int] = {}
    out, blanks = [], 0
    for n in names:
        own = sanitize(n, dialect, fallback="", **how) if re.search(r"\w", str(n).replace("_", "")) else ""
        if not own:
            blanks += 1
            own = f"col_{blanks}"
        k = seen.get(own, 0)
        seen[own] = k + 1
        out.append(f"{own}_{k}" if k else own)
    return out


def sanitize_columns(df: DataFrame, dialect: str = "postgresql", **how) -> DataFrame:
    return df.toDF(*sanitize_all(df.columns, dialect, **how))


def identifier(name: str, dialect: str) -> str:
    """A column's name in a statement: upper case, C_ before a digit, _COL behind a reserved word, cut to the dialect's
    length; lower case where the dialect writes names so."""
    d = dialect_of(dialect).name
    s = re.sub("__+", "_", re.sub(r"[^A-Za-z0-9_]", "_", str(name).strip())).strip("_").upper() or "COL"
    s = "C_" + s if s[0].isdigit() else s
    s = s + "_COL" if s.lower() in RESERVED else s
    s = s[: NAME_LENGTH[d]]
    return s.lower() if d in ("sqlite", "postgresql", "mysql") else s


def identifiers(names: Sequence[str], dialect: str) -> list[str]:
    """Names without clashes; numbers behind later ones stay within the dialect's length."""
    most, taken, out = NAME_LENGTH[dialect_of(dialect).name], set(), []
    for n in names:
        base = own = identifier(n, dialect)
        k = 0
        while own.lower() in taken:
            k += 1
            own = f"{base[: most - len(str(k)) - 1]}_{k}"
        taken.add(own.lower())
        out.append(own)
    return out


# ---------------------------------------------------------------- measures


@dataclass(frozen=True)
class ColumnStats:
    nullable: bool = True
    longest: int = 0
    low: int | None = None
    high: int | None = None
    json_share: float = 0.0
    values: int = 0


def measure(df: DataFrame) -> dict[str, ColumnStats]:
    """What types need to know of each column: nulls, longest text or bytes, range of integers, share of JSON text."""
    exprs = [F.count(F.lit(1)).alias("n")]
    for k, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        exprs.append(F.count(c).alias(f"v{k}"))
        if isinstance(f.dataType, T.StringType):
            exprs += [F.max(F.length(c)).alias(f"m{k}"), F.count_if(F.coalesce(is_structured(c), F.lit(False))).alias(f"j{k}")]
        elif isinstance(f.dataType, T.BinaryType):
            exprs.append(F.max(F.octet_length(c)).alias(f"m{k}"))
        elif isinstance(f.dataType, T.IntegralType):
            exprs += [F.min(c).alias(f"a{k}"), F.max(c).alias(f"b{k}")]
    row = df.agg(*exprs).first().asDict()
    out = {}
    for k, f in enumerate(df.schema):
        v = row[f"v{k}"]
        out[f.name] = ColumnStats(v < row["n"], row.get(f"m{k}") or 0, row.get(f"a{k}"), row.get(f"b{k}"), (row.get(f"j{k}") or 0) / v if v else 0.0, v)
    return out


def int_precision(low: int | None, high: int | None) -> int:
    """Decimal digits of the largest absolute value, 1 to 38; 38 where there is none."""
    if low is None or high is None:
        return 38
    return min(38, max(1, len(str(max(abs(low), abs(high))))))


def sql_type(kind: T.DataType, stats: ColumnStats, dialect: str, json_threshold: float = 0.85) -> str:
    """A column's type in a dialect's words."""
    d = dialect_of(dialect).name
    boolean, real, real32, time, duration, json, text, raw = TYPES[d]
    if isinstance(kind, T.BooleanType):
        return boolean
    if isinstance(kind, T.IntegralType):
        if d == "oracle":
            return f"NUMBER({int_precision(stats.low, stats.high)},0)"
        if d == "mysql" and stats.low is not None:
            for name, bits in (("tinyint", 8), ("smallint", 16), ("int", 32)):
                if stats.low >= -(2 ** (bits - 1)) and stats.high < 2 ** (bits - 1):
                    return name
        return "integer" if d == "sqlite" else "bigint"
    if isinstance(kind, T.FloatType):
        return real32
    if isinstance(kind, T.FractionalType):
        return real
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return time
    if isinstance(kind, T.DayTimeIntervalType):
        return duration
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return json
    if isinstance(kind, T.BinaryType):
        return BYTES_TYPE[d].format(max(1, stats.longest)) if BYTES_LIMIT[d] and stats.longest <= BYTES_LIMIT[d] else raw
    if stats.values and stats.json_share >= json_threshold:
        return json
    return TEXT_TYPE[d].format(max(1, stats.longest)) if TEXT_LIMIT[d] and stats.longest <= TEXT_LIMIT[d] else text


def semantic_type(kind: T.DataType, stats: ColumnStats, json_threshold: float = 0.85) -> str:
    if isinstance(kind, T.BinaryType):
        return "BINARY_OBJECT"
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return "JSON_OBJECT"
    if not isinstance(kind, T.StringType):
        return "UNKNOWN_OBJECT"
    return "JSON_OBJECT" if stats.values and stats.json_share >= json_threshold else "STRING_OBJECT"


# ---------------------------------------------------------------- statements


@dataclass(frozen=True)
class Ddl:
    create: str
    constraints: list[str] = field(default_factory=list)
    columns: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    semantic: dict[str, str] = field(default_factory=dict)


def create_table(schema: T.StructType, stats: dict[str, ColumnStats], table: str, dialect: str, key: Sequence[str] = (), unique: Sequence[Sequence[str]] = (), foreign_keys: Sequence[tuple[Sequence[str], str, Sequence[str], str | None]] = (), not_null: bool = False, sizes: dict[str, int] | None = None, autoincrement: str | None = None) -> Ddl:
    """CREATE TABLE, and ALTER statements for keys where the dialect adds them so (Oracle, Postgres; else they stand inside).

    foreign_keys: (columns, parent, parent's columns, what happens on delete). sizes: lengths of text columns to give.
    """
    d = dialect_of(dialect).name
    names = dict(zip(schema.fieldNames(), identifiers(schema.fieldNames(), d), strict=True))
    low = {c.lower(): c for c in names}

    def own(cols: Sequence[str]) -> str:
        if missing := [c for c in cols if c.lower() not in low]:
            raise ValueError(f"there is no column {', '.join(missing)}")
        return ", ".join(names[low[c.lower()]] for c in cols)

    types = {f.name: TEXT_TYPE[d].format(sizes[f.name]) if sizes and f.name in sizes and d in TEXT_TYPE else sql_type(f.dataType, stats[f.name], d) for f in schema}
    lines = []
    for f in schema:
        line = f"{names[f.name]} {types[f.name]}"
        if autoincrement and f.name.lower() == autoincrement.lower():
            line += {"postgresql": " GENERATED BY DEFAULT AS IDENTITY", "oracle": " GENERATED BY DEFAULT AS IDENTITY", "mysql": " AUTO_INCREMENT", "mssql": " IDENTITY(1,1)", "sqlite": ""}[d]
        if not_null and not stats[f.name].nullable or f.name.lower() in {k.lower() for k in key} and d not in ("sqlite", "oracle", "postgresql"):
            line += " NOT NULL"
        lines.append(line)
    t = table.upper() if d == "oracle" else table
    inside, after = [], []
    put = (lambda name, text: after.append(f"ALTER TABLE {t} ADD CONSTRAINT {name} {text}")) if d in ("oracle", "postgresql") else (lambda name, text: inside.append(text))
    short = lambda s: s[: NAME_LENGTH[d]]
    if key:
        put(short(f"pk_{table}"), f"PRIMARY KEY ({own(key)})")
    for k, u in enumerate(unique, 1):
        put(short(f"uq_{table}_{k}"), f"UNIQUE ({own(u)})")
    for k, (cols, parent, parent_cols, on_delete) in enumerate(foreign_keys, 1):
        if on_delete and on_delete.upper() not in ON_DELETE:
            raise ValueError(f"ON DELETE {on_delete!r} is none of {', '.join(ON_DELETE)}")
        put(short(f"fk_{table}_{k}"), f"FOREIGN KEY ({own(cols)}) REFERENCES {parent} ({', '.join(identifier(c, d) for c in parent_cols)})" + (f" ON DELETE {on_delete.upper()}" if on_delete else ""))
    body = ",\n    ".join(lines + inside)
    return Ddl(f"CREATE TABLE {t} (\n    {body}\n)", after, names, types, {f.name: semantic_type(f.dataType, stats[f.name]) for f in schema})


def generate(df: DataFrame, table: str, dialect: str, **how) -> Ddl:
    """The statements for a frame; one aggregation measures all columns."""
    if not re.fullmatch(r"[A-Za-z_][\w$]*(\.[A-Za-z_][\w$]*)?", table):
        raise ValueError(f"{table!r} is no table name")
    if not df.columns:
        raise ValueError("a frame without columns has no table")
    return create_table(df.schema, measure(df), table, dialect, **how)


def add_column(table: str, column: str, kind: T.DataType, dialect: str, longest: int = 255) -> str:
    d = dialect_of(dialect).name
    text = sql_type(kind, ColumnStats(longest=longest), d)
    return f"ALTER TABLE {table} ADD ({identifier(column, d)} {text})" if d == "oracle" else f"ALTER TABLE {table} ADD {'COLUMN ' if d != 'mssql' else ''}{identifier(column, d)} {text}"


def alter_type(table: str, column: str, kind: T.DataType, dialect: str, longest: int = 255) -> str | None:
    """None for SQLite, which can't."""
    d, name = dialect_of(dialect).name, identifier(column, dialect)
    text = sql_type(kind, ColumnStats(longest=longest), d)
    return {"sqlite": None, "postgresql": f"ALTER TABLE {table} ALTER COLUMN {name} TYPE {text}", "mysql": f"ALTER TABLE {table} MODIFY COLUMN {name} {text}", "mssql": f"ALTER TABLE {table} ALTER COLUMN {name} {text}", "oracle": f"ALTER TABLE {table} MODIFY ({name} {text})"}[d]


def sequence_and_trigger(table: str, column: str) -> list[str]:
    """Oracle's old way to number rows."""
    t, c = table.upper(), identifier(column, "oracle")
    return [f"CREATE SEQUENCE {t}_SEQ START WITH 1 INCREMENT BY 1", f"CREATE OR REPLACE TRIGGER {t}_TRG BEFORE INSERT ON {t} FOR EACH ROW WHEN (new.{c} IS NULL) BEGIN SELECT {t}_SEQ.NEXTVAL INTO :new.{c} FROM dual; END;"]


def dialect_warnings(schema: T.StructType, dialect: str) -> list[str]:
    """What a dialect will not keep as it is."""
    d, out = dialect_of(dialect).name, []
    for f in schema:
        if len(f.name) > NAME_LENGTH[d]:
            out.append(f"{f.name}: longer than {NAME_LENGTH[d]} characters")
        if f.name.lower() in RESERVED:
            out.append(f"{f.name}: a reserved word")
        if isinstance(f.dataType, T.BooleanType):
            out += {"mysql": [f"{f.name}: stored as TINYINT(1)"], "mssql": [f"{f.name}: stored as BIT"], "oracle": [f"{f.name}: stored as NUMBER(1,0)"]}.get(d, [])
        if isinstance(f.dataType, T.ArrayType):
            out.append(f"{f.name}: an array, stored as {'jsonb' if d == 'postgresql' else 'JSON text'}")
        if d == "sqlite" and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out.append(f"{f.name}: a time, stored as text")
    return out


def schema_source(schema: T.StructType, name: str = "SCHEMA") -> str:
    """Python source of a StructType."""
    fields = "\n".join(f"    T.StructField({f.name!r}, T.{type(f.dataType).__name__}(), {f.nullable})," if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.DecimalType)) else f"    T.StructField({f.name!r}, T._parse_datatype_json_string({f.dataType.json()!r}), {f.nullable})," for f in schema)
    return f"from pyspark.sql import types as T\n\n{name} = T.StructType([\n{fields}\n])\n"


def for_storage(df: DataFrame, dialect: str) -> DataFrame:
    """Columns as a database takes them: its names, nested values as JSON text, durations as seconds."""
    names = identifiers(df.columns, dialect)
    out = []
    for f, n in zip(df.schema, names, strict=True):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.DayTimeIntervalType):
            c = F.expr(f"cast(extract(day from `{f.name}`) * 86400 + extract(hour from `{f.name}`) * 3600 + extract(minute from `{f.name}`) * 60 as double) + cast(extract(second from `{f.name}`) as double)")
        out.append(c.alias(n))
    return df.select(*out)
