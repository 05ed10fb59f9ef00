"""The facade: read, clean, cast, find a key, align and write, in one lazy plan with a write at the end."""

from __future__ import annotations

import functools
import json
import os
import time
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.casting import CastConfig, plan_cast
from tessera.functions.cleaning import quick_clean
from tessera.logs import short, timed
from tessera.operators import dml
from tessera.operators.align import AlignConfig, Aligner, AlignReport
from tessera.operators.profile import decide_key, derive_key, is_unique, profile
from tessera.plans import ddl
from tessera.plans.ddl import sanitize_columns
from tessera.sources.catalog import Catalog
from tessera.sources.readers import read_any
from tessera.sources.spec import TableSpec


@dataclass
class LoadResult:
    table: str
    operation: str
    total: int = 0
    rejected: DataFrame | None = None
    report: AlignReport | None = None
    key: list[str] = field(default_factory=list)
    ok: bool = True
    status: str = "COMPLETED"
    #: The change itself, where an operation keeps it: rows taken and rows rejected, for counts by chunk.
    change: dml.Change | None = None
    #: How long the operation took.
    seconds: float = 0.0


def _timed(f):
    """Logs an operation and notes its time in what it returns."""

    @functools.wraps(f)
    def run(self, *a, **k):
        began = time.perf_counter()
        with timed(f"ETL.{f.__name__}", arguments=[short(x) for x in a]):
            out = f(self, *a, **k)
        (out[0] if isinstance(out, tuple) else out).seconds = time.perf_counter() - began
        return out

    return run


class ETL:
    """Loads into a catalog's tables. dialect serves the statements that are written beside (None: none)."""

    def __init__(self, spark: SparkSession, catalog: Catalog | str, align: AlignConfig = AlignConfig(failure_threshold=None), cast: CastConfig = CastConfig(), dialect: str | None = None):
        self.spark, self.catalog = spark, Catalog(spark, catalog) if isinstance(catalog, str) else catalog
        self.config, self.cast, self.dialect = align, cast, dialect

    def prepare(self, source: Any, rename: bool = True) -> DataFrame:
        df = quick_clean(read_any(self.spark, source))
        df = sanitize_columns(df) if rename else df
        return plan_cast(df, self.cast).apply(df)

    @_timed
    def create_load(self, source: Any, table: str, pk: str | list[str] | None = None, replace: bool = True, unique: tuple = (), rename: bool = True) -> LoadResult:
        """A new table of the source's columns, with its rows; pk: names, 'derive', or None for no key."""
        df = self.prepare(source, rename)
        if self.catalog.has_table(table) and not replace:
            raise ValueError(f"table {table!r} exists")
        key = decide_key(df, pk)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
        spec = TableSpec(table, schema, tuple(key), tuple(tuple(u) for u in unique), not_null=tuple(key))
        self.catalog.save(df, spec)
        total = self.catalog.row_count(table)
        return LoadResult(table, "create_load", total, key=key)

    def _aligned(self, source: Any, table: str, rename: bool, add_missing: bool, col_map: Mapping[str, str] | None = None):
        df = self.prepare(source, rename)
        config = AlignConfig(self.config.mode, self.config.failure_threshold, add_missing, self.config.outlier_method, self.config.dayfirst)
        out = Aligner(self.catalog.spec(table), config).align(df, dict(col_map or {}))
        if out.report.added:
            self.catalog.add_columns(table, [f for f in out.spec.schema if f.name in out.report.added])
        return out

    @_timed
    def append(self, source: Any, table: str, rename: bool = True, add_missing: bool = False, tolerance: int | None = None) -> LoadResult:
        """Rows that violate nothing are added, in files beside those there are; with more than `tolerance` others, nothing is."""
        out = self._aligned(source, table, rename, add_missing)
        change = dml.insert(self.catalog.table(table), out.df, out.spec)
        # one pass decides; what it took is what is written
        taken = change.accepted.persist()
        try:
            total = taken.count()
            bad = out.report.rows - total
            if tolerance is not None and bad > tolerance:
                return LoadResult(table, "append", 0, change.rejected, out.report, ok=False, status="DATA_LOAD_FAILED")
            if total:
                self.catalog.append(dml.with_all(taken, out.spec), table)
        finally:
            taken.unpersist()
        return LoadResult(table, "append", total, change.rejected if bad else None, out.report, change=change)

    @_timed
    def upsert(self, source: Any, table: str, key: str | list[str] | None = None, order_by: list[str] | None = None, rename: bool = True, add_missing: bool = False) -> LoadResult:
        """By the key given, or the table's primary key."""
        out = self._aligned(source, table, rename, add_missing)
        names = [key] if isinstance(key, str) else list(key or out.spec.primary_key)
        if not names:
            raise ValueError(f"table {table} has no primary key, and no key is given")
        own = out.spec.check_upsert_key(names)
        self.catalog.upsert(table, out.df, own, order_by)
        return LoadResult(table, "upsert", out.report.rows, report=out.report, key=own)

    @_timed
    def execute(self, operation: str, source: Any, table: str, key: str | list[str] | None = None, chunk: Column | None = None, rename: bool = True, add_missing: bool = False) -> tuple[LoadResult, DataFrame]:
        """A checked insert or upsert: rows that violate nothing are taken, the others come back with reasons.

        Also returned: (chunk, total, success, failed), a chunk being what `chunk` says of an aligned row (default: all).
        """
        if operation not in ("insert", "upsert"):
            raise ValueError(f"operation {operation!r} is neither insert nor upsert")
        out = self._aligned(source, table, rename, add_missing)
        target, spec = self.catalog.table(table), out.spec
        if operation == "insert":
            change, own = dml.insert(target, out.df, spec), []
        else:
            own = spec.check_upsert_key([key] if isinstance(key, str) else list(key or spec.primary_key))
            change = dml.upsert_checked(target, out.df, spec, own)
        counts = dml.chunk_counts(change, F.lit(0) if chunk is None else chunk)
        # counted before the table changes, as both look at the rows that were there
        rows = counts.collect()
        counts = self.spark.createDataFrame(rows, counts.schema)
        good, bad = sum(r["success"] for r in rows), sum(r["failed"] for r in rows)
        if good and operation == "insert":
            self.catalog.append(dml.with_all(change.accepted, spec), table)
        elif good:
            self.catalog.upsert(table, change.accepted, own)
        return LoadResult(table, operation, good, change.rejected if bad else None, out.report, own, ok=not bad, change=change), counts

    @_timed
    def update(self, values: Mapping[str, Any], table: str, where: Any, expression: str | None = None) -> LoadResult:
        """Columns set where the predicate holds; total is the number of rows that it selects."""
        target = self.catalog.table(table)
        n = dml.updated_rows(target, where, expression).first()["updated"]
        self.catalog.save(dml.update(target, values, where, expression), self.catalog.spec(table))
        return LoadResult(table, "update", n)

    def auto(self, source: Any, table: str, pk: str | list[str] | None = "derive") -> LoadResult:
        """Creates a table that isn't there; else upserts by its key where it has one, or appends."""
        if not self.catalog.has_table(table):
            return self.create_load(source, table, pk)
        if self.catalog.primary_key(table):
            return self.upsert(source, table)
        return self.append(source, table)

    def run_many(self, source: Any, tables: Mapping[str, Catalog], pk=None) -> dict[str, LoadResult]:
        """The same source into tables of several catalogs, each with its own status, the step that failed: ERROR (the
        source), DDL_GEN_FAILED (its statements, where there is a dialect, or its key), DDL_FAILED (the table),
        DATA_LOAD_FAILED (the rows), UNEXPECTED_ERROR, or COMPLETED. One target's failure leaves the others alone."""
        try:
            df = self.prepare(source).persist()
        except Exception as e:
            return {name: LoadResult(name, "create_load", ok=False, status=f"ERROR: {e}") for name in tables}
        out = {}
        for name, catalog in tables.items():
            short, step = name.rsplit(".", 1)[-1], "DDL_GEN_FAILED"
            try:
                if self.dialect:
                    ddl.generate(df, short, self.dialect)
                key = decide_key(df, pk)
                spec = TableSpec(short, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]), tuple(key), not_null=tuple(key))
                step = "DDL_FAILED"
                catalog.create(spec)
                step = "DATA_LOAD_FAILED"
                catalog.append(df, short)
                step = "UNEXPECTED_ERROR"
                out[name] = LoadResult(name, "create_load", catalog.row_count(short), key=key)
            except Exception as e:
                out[name] = LoadResult(name, "create_load", ok=False, status=f"{step}: {e}")
        df.unpersist()
        return out

    def statements(self, df: DataFrame, table: str, dialect: str, **how) -> ddl.Ddl:
        return ddl.generate(df, table, dialect, **how)


def run_etl(spark: SparkSession, source: Any, table: str, root: str, pk=None) -> LoadResult:
    return ETL(spark, root).auto(source, table, pk or "derive")


# ---------------------------------------------------------------- folders of files


def propose(spark: SparkSession, path: str, rows: int = 5000) -> dict:
    """A load's settings from a file's first rows: the table's name, a key if one is unique, and the operation."""
    df = quick_clean(read_any(spark, path)).limit(rows)
    stem = os.path.splitext(os.path.basename(path))[0]
    name = f"{os.path.basename(os.path.dirname(path))}_{stem}"
    if not df.limit(1).count():
        return {"table": name, "pk": None, "operation": "insert"}
    key = derive_key(df, profile(df))
    return {"table": name, "pk": key.columns if key.is_unique else None, "operation": "upsert" if key.is_unique else "insert"}


def generate_configs(spark: SparkSession, root: str, force: bool = False) -> dict[str, dict]:
    """Settings for every CSV file below a folder of any file system, kept as JSON in each folder's loads.json; those there
    stay, but with force."""
    store = Catalog(spark, root)
    at = store._path()
    fs, found = store._fs(at), {}
    files = fs.listFiles(at, True)
    while files.hasNext():
        path = files.next().getPath()
        if path.getName().lower().endswith(".csv"):
            found.setdefault(path.getParent().toString(), []).append(path)
    out = {}
    for folder in sorted(found):
        own = Catalog(spark, folder)
        place = own._path("loads.json")
        # people edit these files: where the file system is this machine's, they are written without Hadoop's checksums
        local = place.toUri().getPath() if own._fs(place).getScheme() == "file" else None
        known = {}
        if fs.exists(place) and not force:
            if local:
                with open(local) as f:
                    known = json.load(f)
            else:
                known = json.loads(own._read("loads.json"))
        for path in sorted(found[folder], key=lambda p: p.getName()):
            if path.getName()[:-4] not in known:
                known[path.getName()[:-4]] = propose(spark, path.toString())
        if local:
            with open(local, "w") as f:
                json.dump(known, f, indent=1)
        else:
            own._write(json.dumps(known, indent=1), "loads.json")
        out |= {f"{folder.removeprefix('file:')}/{k}": v for k, v in known.items()}
    return out


def trace(df: DataFrame, statement: Any, path: str) -> None:
    """A statement's text and parameters, and the plan that stands for it here, added to a file on the driver."""
    plan = df._jdf.queryExecution().toString()
    with open(path, "a") as f:
        f.write(f"{statement}\n{json.dumps(getattr(statement, 'params', {}), default=str)}\n{plan}\n")


def write_csv(df: DataFrame, path: str) -> None:
    """A frame as CSV with its clean headers, in a new place: sources are never written over."""
    df.write.option("header", True).csv(path)


def run_batch(spark: SparkSession, folder: str, root: str, config: Mapping[str, Mapping] | None = None, after: str | None = None) -> dict[str, LoadResult]:
    """Every CSV file of a folder by its settings (proposed where there are none); after: only files modified later."""
    etl, out = ETL(spark, root), {}
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    since = 0
    if after:
        from datetime import datetime, timezone

        since = datetime.fromisoformat(after).replace(tzinfo=timezone.utc).timestamp() * 1000
    files = [s for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at) if s.getPath().getName().lower().endswith(".csv") and s.getModificationTime() > since]
    for s in sorted(files, key=lambda s: s.getPath().getName()):
        path = s.getPath().toString()
        stem = s.getPath().getName()[:-4]
        own = dict((config or {}).get(stem) or propose(spark, path))
        if not etl.catalog.has_table(own["table"]):
            out[stem] = etl.create_load(path, own["table"], own.get("pk"))
        elif own["operation"] == "upsert" and own.get("pk"):
            out[stem] = etl.upsert(path, own["table"], own["pk"])
        else:
            out[stem] = etl.append(path, own["table"])
    return out


def write_artefacts(folder: str, table: str, statements: ddl.Ddl) -> None:
    """A table's statements and columns as <table>.txt and <table>.json on the driver."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{table}.txt"), "w") as f:
        f.write(";\n".join([statements.create, *statements.constraints]))
    with open(os.path.join(folder, f"{table}.json"), "w") as f:
        json.dump({"table": table, "columns": statements.columns, "types": statements.types, "semantic": statements.semantic}, f, indent=1)


def count_check(table: DataFrame, frame: DataFrame) -> DataFrame:
    """(table_rows, frame_rows, equal)."""
    sides = table.select(F.lit(1).alias("t")).union(frame.select(F.lit(0).alias("t")))
    counts = sides.agg(F.count_if(F.col("t") == 1).alias("table_rows"), F.count_if(F.col("t") == 0).alias("frame_rows"))
    return counts.withColumn("equal", F.col("table_rows") == F.col("frame_rows"))


__all__ = ["ETL", "LoadResult", "count_check", "is_unique", "propose", "run_batch", "run_etl", "write_artefacts"]
