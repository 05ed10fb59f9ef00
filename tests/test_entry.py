import os

import pytest

import __spark_entry__ as entry
from tessera import registry

SF = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_the_rest_goes_on_without_the_llm_operators(monkeypatch):
    import sys

    # None makes an import fail as if the module weren't there
    for name in [m for m in sys.modules if m.startswith("tessera.llm")] + ["tessera.llm", "corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delattr(sys.modules["tessera"], "llm", raising=False)
    with pytest.warns(UserWarning, match="llm operators"):
        known = entry.queries()
    assert set(known) == set(registry.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["filter_index_expr", "upsert_orders", "profile_orders", "insert_conflict_split", "merge_template", "strict_int", "fk_violations"])
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(str(v) for v in r) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({registry.SQL[name]})").fetchall())
    assert got == want
