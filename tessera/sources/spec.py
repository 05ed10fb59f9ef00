"""What a table is: columns, lengths, keys and references."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    not_null: tuple[str, ...] = ()
    max_length: dict[str, int] = field(default_factory=dict)
    #: Bits of an integer column, 64 where nothing is said; columns that hold JSON text.
    int_bits: dict[str, int] = field(default_factory=dict)
    json_columns: tuple[str, ...] = ()
    identity: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def required(self) -> list[str]:
        return list(dict.fromkeys([*self.primary_key, *self.not_null]))

    def keys(self) -> list[tuple[str, ...]]:
        return [k for k in (self.primary_key, *self.unique) if k]

    def check_upsert_key(self, key: list[str]) -> list[str]:
        """The key as the table spells it; it must be the primary key or a unique set, whole, in any order and case."""
        own = {c.lower(): c for c in self.columns}
        if missing := [k for k in key if k.lower() not in own]:
            raise ValueError(f"table {self.name} has no column {', '.join(missing)}")
        if not any({k.lower() for k in key} == {c.lower() for c in u} for u in self.keys()):
            raise ValueError(f"{', '.join(key)} is neither the primary key nor a unique set of {self.name}")
        return [own[k.lower()] for k in key]

    def describe(self) -> dict:
        return {
            "table": self.name,
            "columns": [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.name not in self.required(), "max_length": self.max_length.get(f.name)} for f in self.schema],
            "primary_key": list(self.primary_key),
            "unique": [list(u) for u in self.unique],
            "foreign_keys": [asdict(k) for k in self.foreign_keys],
            "identity": list(self.identity),
        }

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k != "schema"} | {"schema": self.schema.jsonValue()}, default=list)

    @staticmethod
    def from_json(text: str) -> TableSpec:
        d = json.loads(text)
        d["schema"] = T.StructType.fromJson(d["schema"])
        d["foreign_keys"] = tuple(ForeignKey(tuple(k["columns"]), k["parent"], tuple(k["parent_columns"])) for k in d["foreign_keys"])
        d["unique"] = tuple(tuple(u) for u in d["unique"])
        return TableSpec(**{k: tuple(v) if k in ("primary_key", "not_null", "json_columns", "identity") else v for k, v in d.items()})


def target_kind(name: str, precision: int | None = None, scale: int | None = None, length: int | None = None) -> str:
    """The kind of value that a database type holds: integer, float, string, boolean, datetime, json or binary.

    NUMBER, NUMERIC and DECIMAL are integers only with a scale of zero; one-digit TINYINTs are integers like others.
    """
    n = name.lower().split("(")[0].strip()
    if "json" in n or "array" in n or n in ("variant", "struct", "map"):
        return "json"
    if n in ("number", "numeric", "decimal"):
        return "integer" if scale == 0 and precision is not None else "float"
    if "interval" in n:
        return "string"
    if "int" in n or n == "serial" or n == "bigserial":
        return "integer"
    if n in ("bool", "boolean", "bit"):
        return "boolean"
    if any(x in n for x in ("float", "double", "real", "money")):
        return "float"
    if "date" in n or "time" in n:
        return "datetime"
    if any(x in n for x in ("blob", "binary", "bytea", "raw", "image")):
        return "binary"
    return "string"
