"""Versions of tables, tables dealt by key, checked upserts, loads with statuses, and shapes of values."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import casting, outliers
from tessera.operators import dml, profile
from tessera.pipeline import ETL
from tessera.plans import sqltext
from tessera.sources.catalog import Catalog, ConcurrentWrite
from tessera.sources.spec import TableSpec
from tessera.streaming.upsert import file_stream, upsert_stream

KIND = "k long, v string"


def files(root):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


@pytest.fixture
def catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "tables"))
    df = spark.createDataFrame([(k, f"v{k}") for k in range(100)], KIND)
    c.save(df, TableSpec("t", df.schema, ("k",)))
    return c


def rows(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_an_append_writes_the_new_rows_only(spark, catalog):
    before, old = files(catalog.root), catalog.table("t")
    catalog.append(spark.createDataFrame([(200, "x")], KIND), "t")
    after = files(catalog.root)
    assert before.items() <= after.items()
    new = spark.read.parquet(*sorted(set(after) - set(before)))
    assert rows(new) == [(200, "x")]
    # a frame that was read before still sees its own version
    assert old.count() == 100 and catalog.table("t").count() == 101


def test_the_facade_appends_without_rewriting(spark, catalog):
    etl = ETL(spark, catalog)
    before = files(catalog.root)
    got = etl.append(spark.createDataFrame([(5, "again"), (300, "new")], KIND), "t")
    assert (got.total, got.rejected.count(), got.ok) == (1, 1, True)
    assert before.items() <= files(catalog.root).items() and catalog.row_count("t") == 101


def test_two_writers_of_one_version(spark, catalog):
    version, m = catalog.manifest("t")
    catalog.append(spark.createDataFrame([(200, "x")], KIND), "t")
    with pytest.raises(ConcurrentWrite):
        catalog._follow("t", version, m)
    assert catalog.row_count("t") == 101


def test_tables_dealt_by_key(spark, catalog):
    catalog.deal("t", ["K"], 8)
    assert rows(catalog.table("t")) == sorted((k, f"v{k}") for k in range(100))
    before = files(catalog.root)
    _, m = catalog.manifest("t")
    touched = catalog.upsert("t", spark.createDataFrame([(3, "new"), (3, "newer"), (500, "more")], KIND), ["k"], order_by=["v"])
    assert 1 <= len(touched) <= 2
    _, now = catalog.manifest("t")
    assert all(now.parts[b] == m.parts[b] for b in m.parts if b not in touched)
    assert before.items() <= files(catalog.root).items()
    want = sorted([(k, f"v{k}") for k in range(100) if k != 3] + [(3, "newer"), (500, "more")])
    assert rows(catalog.table("t")) == want
    catalog.append(spark.createDataFrame([(900, "a")], KIND), "t")
    assert catalog.vacuum("t") and rows(catalog.table("t")) == sorted([*want, (900, "a")])
    assert not catalog.vacuum("t")
    catalog.add_columns("t", [T.StructField("w", T.LongType())])
    assert catalog.table("t").where("w is null").count() == 102
    assert catalog.upsert("t", spark.createDataFrame([], KIND), ["k"]) == []


def test_streams_touch_buckets(spark, catalog, tmp_path):
    catalog.deal("t", ["k"], 8)
    _, m = catalog.manifest("t")
    spark.createDataFrame([(7, "s")], KIND).write.parquet(str(tmp_path / "in"))
    upsert_stream(file_stream(spark, str(tmp_path / "in"), catalog.spec("t").schema), catalog, "t", ["k"], str(tmp_path / "check")).awaitTermination()
    _, now = catalog.manifest("t")
    assert sum(now.parts[b] != m.parts[b] for b in m.parts) == 1 and (7, "s") in rows(catalog.table("t"))


def test_checked_upsert(spark):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType()), T.StructField("w", T.StringType())])
    spec = TableSpec("t", schema, ("k",), not_null=("k", "v", "w"))
    target = spark.createDataFrame([(1, "a", "b")], schema)
    source = spark.createDataFrame([(1, "x"), (1, "y"), (2, "new without w"), (None, "no key"), (3, None)], KIND)
    got = dml.upsert_checked(target, source, spec, ["K"])
    assert [tuple(r) for r in got.table.collect()] == [(1, "y", "b")]
    assert sorted((str(r.k), str(r.v), r._reason) for r in got.rejected.collect()) == [("1", "x", "later:k"), ("2", "new without w", "not_null:w"), ("3", "None", "not_null:v"), ("None", "no key", "key:k")]
    counts = {r.chunk: (r.total, r.success, r.failed) for r in dml.chunk_counts(got, F.col("k").isNull()).collect()}
    assert counts == {False: (4, 1, 3), True: (1, 0, 1)}
    assert len(dml.first_errors(got.rejected, ["k"], 2).collect()) == 2
    # without an order the same rows give the same table, however they are dealt
    many = spark.createDataFrame([(1, f"v{k % 7}") for k in range(50)], KIND)
    assert {tuple(dml.last_of_key(many.repartition(n), ["k"]).first()) for n in (1, 3, 5)} == {(1, "v6")}


def test_inserted_rows_without_a_key_are_spread(spark):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
    spec = TableSpec("t", schema, (), (("k",),))
    source = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "c")], KIND)
    got = dml.insert(spark.createDataFrame([], schema), source, spec)
    assert sorted((str(r.k), r.v) for r in got.accepted.collect()) == [("1", "b"), ("None", "a"), ("None", "a")]
    assert [(r.v, r._reason) for r in got.rejected.collect()] == [("c", "batch:k")]


def test_statuses_of_targets(spark, catalog, tmp_path):
    etl = ETL(spark, catalog, dialect="oracle")
    got = etl.run_many([{"k": 1, "v": "a"}], {"t": catalog, "new": catalog, "x.bad name": catalog}, pk="k")
    assert [got[n].status.split(":")[0] for n in ("t", "new", "x.bad name")] == ["DDL_FAILED", "COMPLETED", "DDL_GEN_FAILED"]
    assert got["new"].total == 1 and got["new"].key == ["k"]
    assert {v.status.split(":")[0] for v in etl.run_many(str(tmp_path / "none.csv"), {"a": catalog}).values()} == {"ERROR"}
    done, chunks = etl.execute("insert", [{"k": 1, "v": "b"}, {"k": 2, "v": "c"}], "new", chunk=F.col("k"))
    assert (done.total, done.ok) == (1, False) and sorted(map(tuple, chunks.collect())) == [(1, 1, 0, 1), (2, 1, 1, 0)]
    with pytest.raises(ValueError):
        etl.execute("delete", [], "new")


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("yes", "boolean"), ("2020-01-02 and more", "datetime"), ("12", "float"), ("$1.5e3", "float"),
        ("1.23456789.0", "float"), ("123456789%", "integer"), ("12/05/2020", "datetime"), ("1/5/20", "datetime"), ("12:55-x", "datetime"),
        ("ab12", "object"), ("", "object"), (None, None),
    ],
)
def test_shapes_one_rule_each(spark, text, label):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(casting.shape_label(F.col("s")).alias("x")).first().x == label


def test_what_a_value_is_made_of(spark):
    m = spark.createDataFrame([("1a-2.",)], "s string").select(casting.composition(F.col("s")).alias("m")).first().m
    assert (m.digits, m.letters, m.separators, m.points, m.word, m.day, m.number) == (0.4, 0.2, 0.2, 0.2, False, False, False)


@pytest.mark.parametrize(("text", "want"), [("2 Jan 1995 3:04:05 pm", dt.datetime(1995, 1, 2, 15, 4)), ("31/12/2023", dt.datetime(2023, 12, 31)), ("soon", None), ("99 99 99 99", None), ("", None), (None, None), ("2023-01-02 03:04:05", dt.datetime(2023, 1, 2, 3, 4))])
def test_times_of_any_form(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(casting.to_time_free(F.col("s")).alias("x")).first().x == want


def test_clock_times_and_bits(spark):
    df = spark.createDataFrame([(t,) for t in ("7:05", "19:05:06", "7:05 pm", "25:00", "x", None)], "s string")
    assert [r.x for r in df.select(casting.to_clock(F.col("s")).alias("x")).collect()] == ["07:05:00", "19:05:06", "19:05:00", None, None, None]
    df = spark.createDataFrame([(t,) for t in ("1", " 0", "yes", None)], "s string")
    assert [r.x for r in df.select(casting.to_bits(F.col("s")).alias("x")).collect()] == [True, False, None, None]


def test_samples_by_range_and_population_deviation(spark):
    df = spark.range(1000).selectExpr("id", "cast(id as double) v")
    got = profile.stratified_sample(df, "v", 12)
    assert sorted(r["count"] for r in got.groupBy("stratum").count().collect()) == [2, 2, 2, 3, 3]
    assert rows_of(got) == rows_of(profile.stratified_sample(df.repartition(7), "v", 12))
    a, b = (outliers.bounds(df, ["v"], method="zscore", ddof=d)["v"] for d in (0, 1))
    assert a[0] > b[0] and a[1] < b[1]


def rows_of(df):
    return sorted(r.id for r in df.collect())


def test_statements_as_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], KIND)
    out = sqltext.statement_frame(df, lambda row: sqltext.upsert("t", ["k"], row, "mssql"))
    assert [r.params for r in out.orderBy("params").collect()] == ['{"@k":1,"@v":"a"}', '{"@k":2,"@v":null}']
    assert out.select("statement").distinct().count() == 1
    assert sqltext.quote("a#b", "oracle") == "A#B" and sqltext.quote("a#b", "mysql") == "`a#b`"
    assert [sqltext.quote("level", d) for d in ("oracle", "sqlite")] == ['"level"', "level"]


def test_logs_of_calls_and_frames(spark, catalog, caplog):
    import json
    import logging

    from tessera import logs

    @logs.log_call
    def add(a, b=1):
        return a + b

    @logs.log_call(when=lambda: False)
    def quiet():
        return 1

    @logs.log_call
    def fails():
        raise ValueError("no")

    with caplog.at_level(logging.INFO, "tessera"):
        assert add(1, b=2) == 3 and quiet() == 1
        with pytest.raises(ValueError):
            fails()
        assert logs.log_frame(catalog.table("t"), "t", 2).columns == ["k", "v"]
        assert ETL(spark, catalog).update({"v": "z"}, "t", ["k = 1"]).seconds > 0
    lines = [json.loads(r.message) for r in caplog.records if r.name == "tessera"]
    assert lines[0]["arguments"] == ["1", "b=2"] and lines[0]["seconds"] >= 0
    assert lines[1]["error"] == "ValueError: no"
    assert lines[2]["schema"] == {"k": "bigint", "v": "string"} and len(lines[2]["rows"]) == 2
    assert lines[-1]["event"] == "ETL.update"


def test_strict_types_and_first_failure(spark):
    df = spark.createDataFrame([("1",), ("x",)], "s string")
    with pytest.raises(ValueError, match="s: 1 values are no int"):
        casting.safe_astype(df, {"s": "int"}, strict=True)
    with pytest.raises(ValueError):
        casting.safe_astype(df, {"s": "complex"})
    spec = TableSpec("t", df.schema, ("s",))
    change = dml.insert(spark.createDataFrame([("1",)], "s string"), df, spec)
    with pytest.raises(dml.Rejected, match="key:s"):
        dml.taken_or_raise(change, ["s"])
    assert dml.taken_or_raise(dml.insert(df.limit(0), df, spec), ["s"]).count() == 2
