"""Tables as versioned Parquet: each write makes a new version, and a pointer file names the one that holds.

A version is a manifest: the table's specification and the folders that hold its rows. Appending adds a folder, and an
upsert into a table dealt by key writes only the buckets that it touches; the other folders are shared by both versions.
Files are reached through Hadoop's file systems, so that a store need not be local. A folder that a version names is never
written to. Whoever follows a version claims it by creating a marker that must not exist, so that of two writers that
began at the same version one fails; the pointer is written last, so that a lost job leaves the old version in place.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import dml
from tessera.plans.predicate import resolve
from tessera.sources.spec import TableSpec


class ConcurrentWrite(RuntimeError):
    """Another writer followed the version that this one began at."""


@dataclass(frozen=True)
class Manifest:
    """A version: its specification, its folders, and for a table dealt by key the key, the number of buckets and the
    folders of each of them."""

    spec: TableSpec
    folders: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    buckets: int = 0
    parts: dict[int, tuple[str, ...]] = field(default_factory=dict)

    def paths(self) -> list[str]:
        return [*self.folders, *[p for k in sorted(self.parts) for p in self.parts[k]]]

    def to_json(self) -> str:
        return json.dumps({"spec": self.spec.to_json(), "folders": self.folders, "key": self.key, "buckets": self.buckets, "parts": self.parts})

    @staticmethod
    def from_json(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(TableSpec.from_json(d["spec"]), tuple(d["folders"]), tuple(d["key"]), d["buckets"], {int(k): tuple(v) for k, v in d["parts"].items()})


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # ------------------------------------------------------------ files

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def _read(self, *parts: str) -> str:
        path = self._path(*parts)
        stream = self._fs(path).open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, text: str, *parts: str) -> None:
        """Written beside the place and renamed over it, in one step where the file system has that."""
        path, draft = self._path(*parts), self._path(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}")
        out = self._fs(path).create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(kinds, 1)
        over[0] = kinds.OVERWRITE
        whole = self._fs(path).makeQualified
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole(path).toUri(), self._conf).rename(whole(draft), whole(path), over)

    # ------------------------------------------------------------ reading

    def has_table(self, name: str) -> bool:
        path = self._path(name, "current")
        return self._fs(path).exists(path)

    def list_tables(self, pattern: str | None = None) -> list[str]:
        root = self._path()
        fs = self._fs(root)
        names = sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []
        return [n for n in names if self.has_table(n) and (pattern is None or re.search(pattern, n, re.I))]

    def manifest(self, name: str) -> tuple[str, Manifest]:
        """(the version that holds, what it says)."""
        if not self.has_table(name):
            raise ValueError(f"there is no table {name!r}")
        version = self._read(name, "current")
        return version, Manifest.from_json(self._read(name, version + ".json"))

    def spec(self, name: str) -> TableSpec:
        return self.manifest(name)[1].spec

    def _rows(self, name: str, spec: TableSpec, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], spec.schema)
        return self.spark.read.schema(spec.schema).parquet(*[f"{self.root}/{name}/{p}" for p in paths])

    def table(self, name: str) -> DataFrame:
        _, m = self.manifest(name)
        return self._rows(name, m.spec, m.paths())

    def columns(self, name: str) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.spec(name).schema}

    def find_column(self, pattern: str) -> dict[str, list[str]]:
        """Tables with columns whose name matches, in any case."""
        found = {t: [c for c in self.spec(t).columns if re.search(pattern, c, re.I)] for t in self.list_tables()}
        return {t: c for t, c in found.items() if c}

    def primary_key(self, name: str) -> list[str]:
        return list(self.spec(name).primary_key)

    def unique_sets(self, name: str) -> list[list[str]]:
        return [list(u) for u in self.spec(name).unique]

    def identity(self, name: str) -> list[str]:
        return list(self.spec(name).identity)

    def details(self, name: str) -> dict:
        return self.spec(name).describe()

    def row_count(self, name: str) -> int:
        return self.table(name).count()

    # ------------------------------------------------------------ writing

    def _follow(self, name: str, version: str | None, m: Manifest) -> None:
        """Make m the version after `version` (None: whatever holds)."""
        if version is not None:
            claim = self._path(name, f"{version}.next")
            try:
                self._fs(claim).create(claim, False).close()
            except Exception as e:  # a JVM error
                raise ConcurrentWrite(f"{name} was changed by another writer since {version}") from e
        new = f"v-{uuid.uuid4().hex}"
        self._write(m.to_json(), name, f"{new}.json")
        self._write(new, name, "current")

    def _typed(self, df: DataFrame, spec: TableSpec) -> DataFrame:
        return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in spec.schema])

    def save(self, df: DataFrame, spec: TableSpec, partition_by: list[str] | None = None) -> None:
        """A new version of a table with these rows; df may read the old one."""
        folder, out = f"d-{uuid.uuid4().hex}", self._typed(df, spec)
        (out.write.partitionBy(*partition_by) if partition_by else out.write).parquet(f"{self.root}/{spec.name}/{folder}")
        self._follow(spec.name, None, Manifest(spec, (folder,)))

    def append(self, df: DataFrame, name: str) -> None:
        """Rows added in a folder of their own; those there are stay where they are. A table dealt by key deals them."""
        version, m = self.manifest(name)
        folder = f"d-{uuid.uuid4().hex}"
        if m.buckets:
            self._follow(name, version, replace(m, parts=self._dealt(self._typed(df, m.spec), name, m, folder, m.parts)))
            return
        self._typed(df, m.spec).write.parquet(f"{self.root}/{name}/{folder}")
        self._follow(name, version, replace(m, folders=(*m.folders, folder)))

    # ------------------------------------------------------------ tables dealt by key

    def _bucket(self, m: Manifest):
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast(m.spec.schema[k].dataType) for k in m.key]), F.lit(m.buckets)).cast("int")

    def _dealt(self, df: DataFrame, name: str, m: Manifest, folder: str, before: dict[int, tuple[str, ...]]) -> dict[int, tuple[str, ...]]:
        """Rows written by bucket; the folders of all buckets, `before` and these."""
        df.withColumn("_bucket", self._bucket(m)).repartition(m.buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{name}/{folder}")
        path = self._path(name, folder)
        made = [s.getPath().getName() for s in self._fs(path).listStatus(path) if s.getPath().getName().startswith("_bucket=")]
        out = dict(before)
        for p in made:
            k = int(p.removeprefix("_bucket="))
            out[k] = (*out.get(k, ()), f"{folder}/{p}")
        return out

    def deal(self, name: str, key: list[str], buckets: int) -> None:
        """Deal a table's rows by a key into buckets, so that upserts rewrite only those that they touch."""
        version, m = self.manifest(name)
        own = Manifest(m.spec, key=tuple(resolve(k, m.spec.columns) for k in key), buckets=buckets)
        parts = self._dealt(self.table(name), name, own, f"d-{uuid.uuid4().hex}", {})
        self._follow(name, version, replace(own, parts=parts))

    def upsert(self, name: str, rows: DataFrame, key: list[str], order_by: list[str] | None = None) -> list[int]:
        """An upsert; of a table dealt by this key only the touched buckets are read and written. Returns those.

        rows are read more than once; whoever makes them dearly persists them.
        """
        version, m = self.manifest(name)
        if not m.buckets or {k.lower() for k in key} != {k.lower() for k in m.key}:
            folder = f"d-{uuid.uuid4().hex}"
            self._typed(dml.upsert(self.table(name), rows, key, order_by), m.spec).write.parquet(f"{self.root}/{name}/{folder}")
            self._follow(name, version, Manifest(m.spec, (folder,)))
            return []
        spelled = rows.withColumnsRenamed({c: resolve(c, m.spec.columns) for c in rows.columns if resolve(c, m.spec.columns)})
        # as many numbers as there are buckets, at most
        touched = sorted(r["b"] for r in spelled.select(self._bucket(m).alias("b")).distinct().collect())
        if not touched:
            return []
        old = self._rows(name, m.spec, [p for k in touched for p in m.parts.get(k, ())])
        rest = {k: v for k, v in m.parts.items() if k not in touched}
        parts = self._dealt(self._typed(dml.upsert(old, rows, list(m.key), order_by), m.spec), name, m, f"d-{uuid.uuid4().hex}", rest)
        self._follow(name, version, replace(m, parts=parts))
        return touched

    def vacuum(self, name: str) -> list[str]:
        """Delete what the version that holds doesn't name; nobody may be reading older versions. Returns what went."""
        version, m = self.manifest(name)
        used = {p.split("/")[0] for p in m.paths()}
        whole = {f"{p}" for p in m.paths()}
        root = self._path(name)
        fs, gone = self._fs(root), []
        for s in fs.listStatus(root):
            n = s.getPath().getName()
            if n.startswith("d-") and n not in used or n.startswith("v-") and n.split(".")[0] != version:
                fs.delete(s.getPath(), True)
                gone.append(n)
            elif n.startswith("d-") and n not in whole:
                for b in fs.listStatus(s.getPath()):
                    p = f"{n}/{b.getPath().getName()}"
                    if b.getPath().getName().startswith("_bucket=") and p not in whole:
                        fs.delete(b.getPath(), True)
                        gone.append(p)
        return sorted(gone)

    def create(self, spec: TableSpec, if_exists: str = "error") -> None:
        if self.has_table(spec.name):
            if if_exists == "keep":
                return
            if if_exists != "replace":
                raise ValueError(f"table {spec.name!r} exists")
        self.save(self.spark.createDataFrame([], spec.schema), spec)

    def drop(self, name: str, if_exists: bool = True) -> bool:
        path = self._path(name)
        if not self.has_table(name):
            if if_exists:
                return False
            raise ValueError(f"there is no table {name!r}")
        return bool(self._fs(path).delete(path, True))

    def add_columns(self, name: str, fields: list[T.StructField]) -> TableSpec:
        """New columns, null in the rows there are; no data is rewritten."""
        version, m = self.manifest(name)
        spec = m.spec
        if clash := [f.name for f in fields if resolve(f.name, spec.columns)]:
            raise ValueError(f"table {name} has {', '.join(clash)}")
        spec = replace(spec, schema=T.StructType([*spec.schema.fields, *[T.StructField(f.name, f.dataType) for f in fields]]))
        self._follow(name, version, replace(m, spec=spec))
        return spec

    def alter_type(self, name: str, column: str, kind: T.DataType) -> TableSpec:
        """Another type for a column: the table is written anew, and values that don't fit become null."""
        spec, df = self.spec(name), self.table(name)
        own = resolve(column, spec.columns)
        if own is None:
            raise ValueError(f"table {name} has no column {column}")
        new = replace(spec, schema=T.StructType([T.StructField(f.name, kind) if f.name == own else f for f in spec.schema]))
        self.save(df.withColumn(own, F.col(f"`{own}`").try_cast(kind)), new)
        return new


def structure_diff(expected: dict[str, str], schema: T.StructType) -> dict[str, list]:
    """Columns that the table lacks, that it has beside, and whose type name doesn't hold the expected one."""
    own = {f.name.lower(): f for f in schema}
    want = {k.lower(): (k, v) for k, v in expected.items()}
    return {
        "missing_in_db": [k for low, (k, _) in want.items() if low not in own],
        "extra_in_db": [f.name for low, f in own.items() if low not in want],
        "type_mismatch": [(k, v, own[low].dataType.simpleString()) for low, (k, v) in want.items() if low in own and v.lower() not in own[low].dataType.simpleString().lower()],
    }
