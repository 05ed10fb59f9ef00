import pytest
from pyspark.sql import types as T

from tessera.plans import sqltext as S
from tessera.plans.predicate import Condition, literal, numbered, parse_condition, parse_predicate, select, where

FOUR = ["cell_id = '00123'", ("vendor", "IN", ["GP", "BL"]), {"field": "tech", "operator": "LIKE", "value": "2G"}, "dt BETWEEN '2023-01-01' and '2023-01-31'"]


def test_condition_forms():
    assert parse_condition("a >= 'x y'") == Condition("a", ">=", "x y")
    assert parse_condition("a IN ('x','y, z', 3)") == Condition("a", "IN", ["x", "y, z", "3"])
    assert parse_condition("a in ()").value == []
    assert parse_condition("a BETWEEN 1 AND 2").value == ("1", "2")
    assert parse_condition("a is not null") == Condition("a", "IS NOT NULL")
    assert parse_condition("a IS NULL") == Condition("a", "IS NULL")
    assert numbered([("a", "between", 3), "b <> 4"]) == {1: [Condition("a", "BETWEEN", (3, 3))], 2: [Condition("b", "!=", "4")]}
    for bad in ("a", "a IN 1", "a BETWEEN 1", "a ="):
        with pytest.raises(ValueError):
            parse_condition(bad)
    with pytest.raises(ValueError):
        numbered([("a", "~", 1)])


def test_predicate_text():
    w = S.where(FOUR, "1 AND (2 OR 3) AND 4", "postgresql")
    assert w.sql == "cell_id = :cell_id_1 AND (vendor IN (:vendor_2_0, :vendor_2_1) OR tech LIKE :tech_3 ESCAPE '\\') AND dt BETWEEN :dt_4_0 AND :dt_4_1"
    assert w.params["tech_3"] == "%2G%" and w.params["cell_id_1"] == "00123"
    assert S.where(FOUR, "1 AND (2 OR 3) AND 4", "oracle").sql.startswith("CELL_ID = :cell_id_1 AND (VENDOR IN")
    assert S.where([("kpi", ">", 90)], "1 AND kpi < 100").sql == "kpi > :kpi_1 AND kpi < :kpi_0"
    assert S.where([("a", "LIKE", "50%_\\")], None, "sqlite").params == {"a_1": "%50\\%\\_\\\\%"}
    for bad in ("1 AND 3", "1 AND", "(1", "1 2"):
        with pytest.raises(ValueError):
            S.where([("a", "=", 1), ("b", "=", 2)], bad)


def test_statement_builders():
    u = S.build_update({"cost_code": "NEW"}, "test_quota", [("COST_ID", "=", 1001)])
    assert u.sql == "UPDATE test_quota SET cost_code = :u_cost_code WHERE COST_ID = :COST_ID_1"
    with pytest.raises(ValueError):
        S.build_update({"cost_code": "NEW"}, "t", [("COST_ID", "=", 1001)], allow_missing=False)
    row = {"sitecode": "a", "eventdate": "b", "kpi": 1}
    s = S.build_select(row, "t", [("SITECODE", "=", "?"), "eventdate > '2023-01-01'", "unknown = ?"], "1 AND 2", "postgres")
    assert s.sql == "SELECT * FROM t WHERE sitecode = :sitecode_1 AND eventdate > :eventdate_2" and s.params == {"sitecode_1": "a", "eventdate_2": "2023-01-01"}
    assert S.build_insert({"a": 1, "user": 2}, "t").sql == 'INSERT INTO t (a, "user") VALUES (:a, :user)'
    assert S.key_lookup("t", ["a", "b"], [{"a": 1, "b": None}]).sql == "SELECT * FROM t WHERE (a = :a_0 AND b IS NULL) ORDER BY a, b"


@pytest.mark.parametrize(
    ("dialect", "text"),
    [
        ("oracle", "MERGE INTO t tgt USING (SELECT :id AS id, :v AS v FROM DUAL) src ON (tgt.id = src.id) WHEN MATCHED THEN UPDATE SET tgt.v = src.v WHEN NOT MATCHED THEN INSERT (id, v) VALUES (src.id, src.v)"),
        ("postgresql", "INSERT INTO t (id, v) VALUES (%(id)s, %(v)s) ON CONFLICT (id) DO UPDATE SET v = EXCLUDED.v"),
        ("sqlite", "INSERT INTO t (id, v) VALUES (:id, :v) ON CONFLICT (id) DO UPDATE SET v = excluded.v"),
        ("mysql", "INSERT INTO t (id, v) VALUES (%(id)s, %(v)s) ON DUPLICATE KEY UPDATE id = VALUES(id), v = VALUES(v)"),
        ("mssql", "MERGE t AS tgt USING (SELECT @id, @v) AS src (id, v) ON (tgt.id = src.id) WHEN MATCHED THEN UPDATE SET tgt.v = src.v WHEN NOT MATCHED THEN INSERT (id, v) VALUES (src.id, src.v);"),
    ],
)
def test_upsert_text(dialect, text):
    assert S.upsert("t", ["id"], {"id": 1, "v": 2}, dialect).sql == text
    assert len(S.bulk_upsert("t", ["id"], [{"id": 1, "v": 2}, {"id": 3, "v": 4}], dialect).params) == 4
    if dialect in ("postgresql", "sqlite"):
        assert S.upsert("t", ["ID"], {"id": 1}, dialect).sql.endswith("DO NOTHING")


def test_plain_text():
    assert S.select("t", [("a", "=", 1), ("b", "LIKE", "x")], "mysql", ["a"]).sql == "SELECT a FROM t WHERE a = %(w_0)s AND b LIKE %(w_1)s"
    assert S.update("t", {"a": 1}, [("b", "IS NOT", None)], "mssql").sql == "UPDATE t SET a = @s_0 WHERE b IS NOT @w_0"
    with pytest.raises(ValueError):
        S.select("t", [("a", "; DROP", 1)])


def test_where_on_frames(spark):
    df = spark.createDataFrame([(1, "a%b", 1.5), (2, "axb", None), (None, None, 3.0)], "Id long, s string, v double")
    ids = lambda *a: sorted(str(r.Id) for r in where(df, *a).collect())
    assert ids([("s", "LIKE", "a%")]) == ["1"]
    assert ids([("s", "RAW LIKE", "a%")]) == ["1", "2"]
    assert ids([("ID", "IS", None)]) == ["None"]
    assert ids([("v", "=", "1.5"), ("id", "=", 2)], "1 OR 2") == ["1", "2"]
    assert ids(["v IS NULL"], "NOT 1") == ["1", "None"]
    assert ids([("id", "IN", [])]) == []
    assert select(df, ["S"], [("id", "=", 1)]).columns == ["s"]
    with pytest.raises(ValueError):
        where(df, [("nope", "=", 1)])
    with pytest.raises(ValueError):
        where(df, [("id", "=", "x")])
    assert "PushedFilters" not in literal(1, T.LongType()).__repr__()


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) s", "id * 2 as v").write.parquet(str(tmp_path / "t"))
    df = select(spark.read.parquet(str(tmp_path / "t")), ["id"], [("ID", ">", "90"), ("s", "LIKE", "9")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,90)" in plan and "StringContains(s,9)" in plan and "v:bigint" not in plan.split("ReadSchema")[1]
    assert parse_predicate([]).children == ()
