"""Cleaning, casting, profiles, alignment, changes, catalog and the facade, on small frames."""

import datetime as dt
import math
import tracemalloc
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import casting, cleaning, outliers
from tessera.operators import align, constraints, dml, profile
from tessera.pipeline import ETL, propose, run_batch
from tessera.plans import ddl
from tessera.sources.catalog import Catalog, structure_diff
from tessera.sources.readers import flatten, load_config, read_any, substitute
from tessera.sources.spec import ForeignKey, TableSpec, target_kind
from tessera.streaming.upsert import file_stream, tumbling_counts, upsert_stream


def values(df, c):
    return [r[c] for r in df.collect()]


# ---------------------------------------------------------------- functions


def test_clean(spark):
    texts = ["  “Hi”—there…​ ", "null", "None", "Привет\x07", "ﬁ①", " x ", None, "nulls"]
    got = values(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", cleaning.clean(F.col("t")).alias("t")).orderBy("k"), "t")
    assert got == ['"Hi"-there...', None, None, "Пpивeт", "fi1", "x", None, "nulls"]
    twice = values(spark.createDataFrame([(t,) for t in got], "t string").select(cleaning.clean(F.col("t")).alias("t")), "t")
    assert twice == got
    special = cleaning.CleaningConfig(special=True)
    assert values(spark.createDataFrame([("é-a b!",)], "t string").select(cleaning.clean(F.col("t"), special).alias("t")), "t") == ["éa b"]


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKC", "NFKD"])
def test_normal_forms_equal_pythons(spark, form):
    texts = [chr(a) + b for a in range(0x3200) for b in ("", "\u0301")] + ["e\u0323\u0307", "가", "\u1100\u1161\u11a8", "豈", "😀 ﷺ", "½ é", "", None]
    only = cleaning.CleaningConfig(null_words=(), replace={}, normal_form=form, controls=False, trim=False)
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", cleaning.clean(F.col("t"), only).alias("t")).collect()
    assert {r.k: r.t for r in got} == {k: t if t is None else unicodedata.normalize(form, t) for k, t in enumerate(texts)}


def test_only_texts_that_the_form_may_change_reach_python(spark, monkeypatch):
    monkeypatch.setattr(cleaning, "_form", lambda name: lambda c: F.concat(F.lit(f"{name}:"), c))
    texts = ["Éñß ¡", "plain", None, "“é”", "½ é", "e\u0301", "œ"]
    got = values(spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(cleaning.clean(F.col("t")).alias("t")), "t")
    assert got == ["Éñß ¡", "plain", None, '"é"', "NFKC:½ é", "NFKC:e\u0301", "NFKC:œ"]
    assert values(spark.createDataFrame([("é",)], "t string").select(cleaning.clean(F.col("t"), cleaning.CleaningConfig(normal_form="NFD")).alias("t")), "t") == ["NFD:é"]


def test_normal_form_holds_few_strings_at_a_time():
    normal = cleaning._form("NFKC").func
    text = "😀 e\u0301 ﬁ " + "word " * 1000
    batch = pa.array([f"{k} {text}" for k in range(4000)] + [None, ""])
    tracemalloc.start()
    out = normal(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6 < batch.nbytes
    assert out.type == batch.type and out[4000].as_py() is None and out[4001].as_py() == ""
    assert all(out[k].as_py() == unicodedata.normalize("NFKC", f"{k} {text}") for k in (0, 1999, 3999))
    assert normal(batch.slice(0, 0)).to_pylist() == [] and normal(batch.slice(3999, 2)).equals(out.slice(3999, 2))


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int").toDF("﻿Cost Code", "cost-code", "--", "Id")
    assert cleaning.clean_headers(df).columns == ["cost_code", "cost_code_1", "col_3", "id"]
    assert ddl.sanitize_all(["cost_code", "COST_ID", "1st", "user", "", "a b", "a-b"]) == ["cost_code", "cost_id", "_1st", "user_", "col_1", "a_b", "a_b_1"]
    assert [ddl.identifier(n, "oracle") for n in ("user", "1a", "x" * 40)] == ["USER_COL", "C_1A", "X" * 30]
    assert ddl.identifiers(["a", "A", "a"], "sqlite") == ["a", "a_1", "a_2"]


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [
        ("float", "1d", None), ("float", " -1.5e3 ", -1500.0), ("float", "nan", None), ("float", ".5", 0.5), ("float", "1,5", None),
        ("integer", "9007199254740993", 9007199254740993), ("integer", "2.0", 2), ("integer", "2.5", None), ("integer", "1e3", 1000), ("integer", "9223372036854775808", None), ("integer", "x", None),
        ("boolean", " ON ", True), ("boolean", "n", False), ("boolean", "2", None),
        ("currency", "$ 1,234.50", 1234.5), ("currency", "n/a", None),
        ("timestamp", "31/12/2023", dt.datetime(2023, 12, 31)), ("timestamp", "2023-02-30", None), ("timestamp", "20230102030405", dt.datetime(2023, 1, 2, 3, 4, 5)), ("timestamp", "2023-01-02T03:04", dt.datetime(2023, 1, 2, 3, 4)), ("timestamp", "2023", None),
        ("duration", "2 days 01:00:01", 176401.0), ("duration", "3h 5m", 11100.0), ("duration", "x", None),
    ],
)
def test_conversions(spark, kind, text, want):
    assert values(spark.createDataFrame([(text,)], "t string").select(casting.CONVERSIONS[kind](F.col("t")).alias("v")), "v") == [want]


@pytest.mark.parametrize(("text", "ok"), [("{}", True), ("{}}", False), ("1,2", False), ("1,null", False), ("[1] ", True), ("", False), ("nul", False), ("\"a\"", True), ("{} ] , [ {}", False)])
def test_json_is_one_value(spark, text, ok):
    assert values(spark.createDataFrame([(text,)], "t string").select(casting.parse_json(F.col("t")).isNotNull().alias("v")), "v") == [ok]


def test_cast_plan(spark):
    rows = [("2023-01-0%d" % (k % 9 + 1), f"€{k},000", "yes" if k % 2 else "off", f"n{k}", '{"a":%d}' % k) for k in range(20)]
    df = spark.createDataFrame(rows, "created_at string, amount string, flag string, name string, meta string")
    plan = casting.plan_cast(df)
    assert plan.conversions == {"created_at": "timestamp", "amount": "whole", "flag": "boolean"}
    assert plan.semantic["meta"] == "STRUCTURED_OBJECT" and plan.semantic["name"] == "STRING_OBJECT"
    out = plan.apply(df)
    assert [f.dataType.simpleString() for f in out.schema] == ["timestamp_ntz", "bigint", "boolean", "string", "string"]
    assert casting.auto_cast(df).schema["created_at"].dataType == T.DateType()
    assert casting.infer({"integer": 8, "string": 2}) == ("integer", 0.8)
    assert casting.infer({}) == ("string", 0.0)


def test_outliers(spark):
    df = spark.createDataFrame([(float(k),) for k in range(20)] + [(1000.0,), (None,)], "v double")
    low, high = outliers.bounds(df)["v"]
    assert (low, high) == (-10.0, 30.0)
    assert values(outliers.replace_outliers(df), "v").count(0.0) == 3
    assert values(outliers.keep_mask(df, drop_nulls=True), "keep").count(False) == 2
    assert outliers.bounds(df.limit(9))["v"] is None
    assert outliers.bounds(df, method="zscore")["v"][1] < 1000


@pytest.mark.parametrize("enough", [20_000, 300])
def test_quantiles_equal_numpy(spark, enough):
    import numpy as np

    rng = np.random.default_rng(1)
    cols = {"u": rng.uniform(-1, 1, 900), "d": rng.integers(0, 4, 900).astype(float), "two": np.repeat([1.0, 2.0], 450)}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*cols.values())] + [(None,) * 3, (math.nan,) * 3], ", ".join(f"{c} double" for c in cols)).cache()
    got = outliers.quantiles(df, list(cols), [0.25, 0.5, 1.0], enough)
    for c, x in cols.items():
        assert np.allclose(got[c], np.quantile(x, [0.25, 0.5, 1.0]), rtol=1e-12), c
    assert outliers.quantiles(df.where("u is null and u = 0"), ["u"], [0.5]) == {"u": [None]}


# ---------------------------------------------------------------- profiles


def test_profile_and_key(spark):
    rows = [("a", 30.0, dt.datetime(2020, 1, 1), "A", 1, 1.0), ("b", None, None, "B", 2, None), (None, 40.0, dt.datetime(2020, 1, 2), "A", 3, 2.0), ("d", 40.0, dt.datetime(2020, 1, 3), "C", 4, 2.0)]
    df = spark.createDataFrame(rows, "name string, age double, birth_date timestamp_ntz, category string, id long, salary double")
    p = {r.column_name: r for r in profile.profile(df).collect()}
    assert (p["name"].all_unique, p["name"].null_count, p["name"].null_pct, p["age"].distinct_count) == (True, 1, 25.0, 2)
    assert p["birth_date"].is_datetime and not p["category"].is_datetime
    # a column with nulls is no key, unique though the others are
    assert profile.derive_key(df).columns == ["id"]
    two = spark.createDataFrame([(1, k % 2, k // 2) for k in range(10)], "c long, a long, b long")
    assert not profile.derive_key(two, threshold=0.2).is_unique or profile.is_unique(two, profile.derive_key(two, threshold=0.2).columns)
    assert profile.decide_key(df, "ID") == ["id"] and profile.decide_key(df, None) == []
    with pytest.raises(ValueError):
        profile.decide_key(df, "category")
    assert profile.profile(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        profile.derive_key(df.limit(0))


def test_five_columns_make_a_key(spark):
    rows = [(*[(k >> b) & 1 for b in range(5)],) for k in range(32)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int")
    assert profile.derive_key(df, threshold=0.0).is_unique


def test_samples(spark):
    df = spark.createDataFrame([(k, None if k == 5 else "x") for k in range(100)], "k long, s string")
    assert sorted(values(profile.head_tail(df, ["k"], 4), "k")) == [0, 98 + 1] or len(values(profile.head_tail(df, ["k"], 4), "k")) == 2
    assert values(profile.sample_rows(df, 5).orderBy("k"), "k") == values(profile.sample_rows(df.repartition(7), 5).orderBy("k"), "k")
    assert profile.is_unique(df.withColumn("pk", profile.composite(["k", "s"])), ["k"])


# ---------------------------------------------------------------- changes


def harness(spark):
    rows = [(k, f"user{k}", f"user{k}@example.com", k * 10.5, int(k % 2 == 0)) for k in range(10)]
    df = spark.createDataFrame(rows, "id long, username string, email string, score double, active int")
    spec = TableSpec("users", df.schema, ("id",), (("username",),))
    mutate = lambda d: d.withColumns({"email": F.concat("email", F.lit("m")), "score": F.col("score") + 1, "active": F.col("active") + 1})
    return df, spec, mutate


def test_full_cycle(spark):
    df, spec, mutate = harness(spark)
    table = dml.insert(df.limit(0), df.where("id <= 5"), spec).table
    up = mutate(df.where("id between 3 and 6")).unionByName(df.where("id = 7"))
    table = dml.upsert(table, up, ["ID"])
    expected = df.where("id <= 2").unionByName(up)
    assert dml.differing(table, expected, ["id"]).count() == 0 and table.count() == 8
    # row 8 isn't there, and an update does not make it
    table = dml.merge(table, mutate(df.where("id in (1, 7)")), ["id = ?"])
    assert dml.differing(table, expected.where("id not in (1, 7)").unionByName(mutate(df.where("id in (1, 7)"))), ["id"]).count() == 0
    assert dml.differing(table, expected, ["id"]).count() == 2
    assert dml.upsert(table, up, ["id"]).exceptAll(dml.upsert(dml.upsert(table, up, ["id"]), up, ["id"])).count() == 0


def test_upsert_last_wins_nulls_and_partial_columns(spark):
    t = spark.createDataFrame([(1, "alice", "Paris"), (2, "bob", "London")], "id long, username string, city string")
    s = spark.createDataFrame([(1, "Rome", 1), (1, None, 2), (3, "Berlin", 1), (None, "x", 1), (None, "y", 2)], "id long, city string, seq int")
    got = sorted(map(tuple, dml.upsert(t, s, ["id"], ["seq"]).collect()), key=str)
    assert got == sorted([(1, "alice", None), (2, "bob", "London"), (3, None, "Berlin"), (None, None, "x"), (None, None, "y")], key=str)
    assert dml.insert_if_absent(t, t.select("id"), ["id"]).count() == 2
    with pytest.raises(ValueError):
        dml.upsert(t, t.withColumn("zz", F.lit(1)), ["id"])


def test_insert_reasons(spark):
    df, spec, _ = harness(spark)
    new = spark.createDataFrame([(1, "new", None, 1.0, 1), (20, "user3", None, 1.0, 1), (None, "z", None, 1.0, 1), (21, "k", None, 1.0, 1), (21, "l", None, 2.0, 1), (22, None, None, 1.0, 1), (23, None, None, 1.0, 1)], df.schema)
    out = dml.insert(df, new, spec, order_by=["score"])
    assert sorted(values(out.rejected, dml.REASON)) == ["batch:id", "key:id", "key:username", "not_null:id"]
    assert sorted(values(out.accepted, "id")) == [21, 22, 23] and out.table.count() == 13
    assert dml.insert(df, new.select("username"), spec).accepted.count() == 0


def test_update(spark):
    df, _, _ = harness(spark)
    out = dml.update(df, {"EMAIL": None, "score": "7"}, [("id", ">", 7)])
    assert values(out.where("email is null"), "score") == [7.0, 7.0]
    assert dml.updated_rows(df, [("id", ">", 7)]).first().updated == 2
    with pytest.raises(ValueError):
        dml.update(df, {}, [("id", "=", 1)])
    with pytest.raises(ValueError):
        dml.update(df, {"score": "x"}, [("id", "=", 1)])
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- alignment


def test_align(spark):
    spec = TableSpec("sample", T.StructType().add("id", "integer").add("name", "string").add("value", "double").add("created_at", "timestamp_ntz").add("active", "boolean"), ("id",), max_length={"name": 3})
    rows = [(str(k), "abcd" if k == 0 else "ab", "x" if k < 2 else "1.5", "2023-01-01", "yes", "e") for k in range(10)]
    df = spark.createDataFrame(rows, "ID string, NAME string, value string, created_at string, active string, extra string")
    out = align.Aligner(spec).align(df)
    assert out.df.columns == spec.columns and out.report.extra == ["extra"]
    assert out.report.failures == {"id": 0, "name": 1, "value": 2, "created_at": 0, "active": 0}
    # 20 % fail, the limit is 10 %: the column is left as it came
    assert out.report.untouched == ["value"] and out.df.schema["value"].dataType == T.StringType()
    assert align.Aligner(spec, align.AlignConfig(failure_threshold=None)).align(df).df.schema["value"].dataType == T.DoubleType()
    with pytest.raises(align.AlignmentError):
        align.strict_align(df, spec)
    grown = align.Aligner(spec, align.AlignConfig(add_missing=True)).align(df)
    assert grown.report.added == ["extra"] and grown.spec.columns[-1] == "extra"
    again = align.Aligner(spec, align.AlignConfig(failure_threshold=None)).align(align.align(df, spec, align.AlignConfig(failure_threshold=None)))
    assert sum(again.report.failures.values()) == 0
    assert align.aligned_to(spec)(lambda d: d.columns)(df) == spec.columns
    assert align.with_missing(df.select("ID"), spec).columns == spec.columns
    dup = align.Aligner(spec).align(df.select(F.lit("1").alias("id")))
    assert dup.report.violations == {"key:(id)": 10} and dup.report.missing == spec.columns[1:]


def test_constraints(spark):
    parent = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    child = spark.createDataFrame([(1, "a"), (1, "b"), (None, "z"), (3, None)], "p int, q string")
    assert [tuple(r) for r in constraints.reference_violations(child, parent, ["p", "q"], ["x", "y"]).collect()] == [(1, "b")]
    spec = TableSpec("c", child.schema, ("p",), not_null=("q",), max_length={"q": 0}, foreign_keys=(ForeignKey(("p",), "par", ("x",)),))
    assert constraints.check(child, spec, {"par": parent}) == {"not_null:p": 1, "not_null:q": 1, "length:q": 3, "key:(p)": 2, "reference:(p)": 1}
    assert TableSpec.from_json(spec.to_json()) == spec
    assert [target_kind("NUMBER", 10, 0), target_kind("NUMBER", 10, 2), target_kind("TINYINT(1)"), target_kind("timestamp"), target_kind("jsonb"), target_kind("varchar(5)"), target_kind("bytea")] == ["integer", "float", "integer", "datetime", "json", "string", "binary"]


# ---------------------------------------------------------------- DDL


def test_ddl(spark):
    rows = [(1, "Alice", 95.5, True, '{"a": 1}', bytearray(b"xy"), dt.datetime(2020, 1, 1)), (200, "Bob", 88.0, False, "[1]", bytearray(b"z"), None)]
    df = spark.createDataFrame(rows, "id long, name string, score double, active boolean, meta string, raw binary, at timestamp_ntz")
    types = {d: ddl.generate(df, "users", d, key=["ID"]) for d in ddl.TYPES}
    assert list(types["oracle"].types.values()) == ["NUMBER(3,0)", "VARCHAR2(5 CHAR)", "BINARY_DOUBLE", "NUMBER(1,0)", "JSON", "RAW(2)", "TIMESTAMP"]
    assert list(types["mysql"].types.values()) == ["smallint", "varchar(5)", "double", "boolean", "json", "varbinary(2)", "datetime"]
    assert list(types["postgresql"].types.values()) == ["bigint", "varchar(5)", "double precision", "boolean", "jsonb", "bytea", "timestamp"]
    assert types["sqlite"].create == "CREATE TABLE users (\n    id integer,\n    name text,\n    score real,\n    active integer,\n    meta text,\n    raw blob,\n    at text,\n    PRIMARY KEY (id)\n)"
    assert types["oracle"].constraints == ["ALTER TABLE USERS ADD CONSTRAINT pk_users PRIMARY KEY (ID)"]
    assert "PRIMARY KEY (id)" in types["mysql"].create and types["postgresql"].semantic["meta"] == "JSON_OBJECT"
    assert ddl.alter_type("t", "a", T.LongType(), "sqlite") is None
    assert ddl.add_column("t", "a", T.LongType(), "oracle") == "ALTER TABLE t ADD (A NUMBER(38,0))"
    scope: dict = {}
    exec(ddl.schema_source(df.schema), scope)
    assert scope["SCHEMA"] == df.schema
    with pytest.raises(ValueError):
        ddl.generate(df, "bad name", "sqlite")
    stored = ddl.for_storage(df.withColumn("nested", F.struct("id")).withColumn("d", F.expr("interval '1' day + interval '1.5' second")), "oracle")
    assert stored.first().NESTED == '{"id":1}' and stored.first().D == 86401.5


# ---------------------------------------------------------------- sources and the facade


def test_read_any(spark, tmp_path):
    assert read_any(spark, [{"a": 1, "b": "x"}, {"a": 2.5, "c": {"k": 1}}]).schema.simpleString() == "struct<a:double,b:string,c:string>"
    assert read_any(spark, {"a": [1, 2], "b": ["x", "y"]}).count() == 2 and read_any(spark, {"a": 1}).count() == 1
    assert values(read_any(spark, [{"a": math.nan}, {"a": 1.0}]), "a") == [None, 1.0]
    with pytest.raises(FileNotFoundError):
        read_any(spark, str(tmp_path / "no.csv"))
    (tmp_path / "x.txt").write_text("a")
    with pytest.raises(ValueError):
        read_any(spark, str(tmp_path / "x.txt"))
    nested = spark.createDataFrame([((1, "n"), [1, 2], [("p", 1), ("q", 2)])], "sender struct<id:int,name:string>, tags array<int>, photo array<struct<file:string,size:int>>")
    assert flatten(nested).first().asDict() == {"sender_id": 1, "sender_name": "n", "tags": "[1,2]", "photo_file": "q", "photo_size": 2}
    assert substitute({"a": ["${X:d}", "${Y}"]}, {"Y": "y"}) == {"a": ["d", "y"]}
    with pytest.raises(ValueError):
        substitute("${NOT_SET}", {})
    assert load_config('{"servers": {"a": {"uri": "${U:u}"}}, "active": "a"}')["servers"]["a"]["uri"] == "u"
    with pytest.raises(ValueError):
        load_config('{"servers": {"a": 1}, "active": "b"}')


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    c.create(TableSpec("t", df.schema, ("id",)))
    c.append(df, "t")
    c.save(dml.upsert(c.table("t"), spark.createDataFrame([(1, "b"), (2, "c")], df.schema), ["id"]), c.spec("t"))
    assert c.row_count("t") == 2 and c.list_tables("T") == ["t"] and c.find_column("NAM") == {"t": ["name"]}
    c.add_columns("t", [T.StructField("x", T.DoubleType())])
    assert values(c.table("t"), "x") == [None, None]
    c.alter_type("t", "name", T.LongType())
    assert c.columns("t")["name"] == T.LongType() and values(c.table("t"), "name") == [None, None]
    assert c.details("t")["primary_key"] == ["id"] and c.spec("t").check_upsert_key(["ID"]) == ["id"]
    with pytest.raises(ValueError):
        c.spec("t").check_upsert_key(["name"])
    assert structure_diff({"ID": "bigint", "gone": "int"}, c.table("t").schema) == {"missing_in_db": ["gone"], "extra_in_db": ["name", "x"], "type_mismatch": []}
    assert c.drop("t") and not c.has_table("t") and not c.drop("t")


def test_etl(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "users.csv").write_text("﻿User Id,Name,Created At\n1,“Al”,2023-01-01\n2,Bo,2023-01-02\n")
    assert propose(spark, str(folder / "users.csv")) == {"table": "in_users", "pk": ["User_Id"], "operation": "upsert"}
    etl = ETL(spark, str(tmp_path / "tables"))
    out = etl.auto(str(folder / "users.csv"), "users")
    assert (out.operation, out.total, out.key) == ("create_load", 2, ["user_id"])
    out = etl.auto([{"USER_ID": 2, "name": "Bob"}, {"user_id": 3, "name": "Cy"}], "users")
    assert out.operation == "upsert" and etl.catalog.row_count("users") == 3
    rows = {r.user_id: r for r in etl.catalog.table("users").collect()}
    assert rows[1].name == '"Al"' and rows[2].name == "Bob" and rows[2].created_at == dt.datetime(2023, 1, 2)
    assert etl.update({"name": "Z"}, "users", [("USER_ID", ">=", 2)]).total == 2
    out = etl.append([{"user_id": 3, "name": "again"}, {"user_id": 4, "name": "new"}], "users")
    assert out.ok and out.total == 1 and values(out.rejected, dml.REASON) == ["key:user_id"]
    assert not etl.append([{"user_id": 3}], "users", tolerance=0).ok
    etl.upsert([{"user_id": 4, "city": "Rome"}], "users", add_missing=True)
    assert "city" in etl.catalog.columns("users")
    both = run_batch(spark, str(folder), str(tmp_path / "batch"))
    assert both["users"].operation == "create_load" and run_batch(spark, str(folder), str(tmp_path / "batch"), {"users": {"table": "in_users", "pk": ["user_id"], "operation": "upsert"}})["users"].total == 2
    assert run_batch(spark, str(folder), str(tmp_path / "batch"), after="2100-01-01") == {}


def test_configs_and_trace(spark, tmp_path):
    from tessera.pipeline import generate_configs, trace, write_csv
    from tessera.plans.sqltext import where

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("k,v\n1,a\n2,a\n")
    got = generate_configs(spark, str(tmp_path))
    assert list(got.values()) == [{"table": "a_x", "pk": ["k"], "operation": "upsert"}]
    (tmp_path / "a" / "loads.json").write_text('{"x": {"table": "mine"}}')
    assert list(generate_configs(spark, str(tmp_path)).values()) == [{"table": "mine"}]
    df = spark.range(3)
    trace(df, where([("id", "=", 1)]), str(tmp_path / "t.txt"))
    assert "id = :id_1" in (tmp_path / "t.txt").read_text()
    write_csv(df, str(tmp_path / "csv"))
    assert read_any(spark, str(tmp_path / "csv") + "/*.csv").count() == 3
    plan = casting.plan_by_shape(spark.createDataFrame([("1.5", "yes", "2020-01-01", "x")] * 3, "a string, b string, c string, d string"))
    assert plan.conversions == {"a": "float", "b": "boolean", "c": "timestamp"}
    seen, metrics = align.observed(df)
    seen.collect()
    assert metrics.get["rows"] == 3


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(k % 5, float(k)) for k in range(20)], "id long, v double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    c = Catalog(spark, str(tmp_path / "tables"))
    c.create(TableSpec("s", df.schema, ("id",)))
    for _ in range(2):
        upsert_stream(file_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=10), c, "s", ["id"], str(tmp_path / "ck"), order_by=["v"]).awaitTermination()
    assert sorted(values(c.table("s"), "v")) == [15.0, 16.0, 17.0, 18.0, 19.0]
    e = spark.createDataFrame([(dt.datetime(2020, 1, 1, 0, m), "a") for m in (1, 9, 11)], "ts timestamp_ntz, kind string")
    assert sorted(values(tumbling_counts(e, "ts", "kind"), "n")) == [1, 2]
