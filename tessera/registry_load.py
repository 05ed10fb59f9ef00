"""Queries on sources, the catalog, statements, names, casts and loads, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import casting, cleaning, outliers
from tessera.operators import align, dml, profile
from tessera.operators.align import AlignConfig, Aligner
from tessera.pipeline import ETL, generate_configs, propose, run_batch, write_csv
from tessera.plans import ddl, predicate, sqltext
from tessera.registry import CLEANED, _shared, query
from tessera.sources.catalog import Catalog
from tessera.sources.readers import flatten, load_config, read_any
from tessera.sources.spec import TableSpec, target_kind
from tessera.streaming.upsert import file_stream, upsert_stream

#: The columns of a view, in order, as DuckDB knows them.
_COLUMNS = "SELECT column_name, ordinal_position FROM information_schema.columns WHERE table_name = '{}'"


def _small_catalog(spark, t, *names: str) -> Catalog:
    catalog = Catalog(spark, _shared(spark))
    for n in names:
        df = t(n)
        catalog.save(df, TableSpec(n, df.schema, (df.columns[0],)))
    return catalog


def _csv(spark, df, name: str) -> str:
    path = f"{_shared(spark)}/{name}.csv"
    write_csv(df, path)
    return path


# ---------------------------------------------------------------- sources


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def scan_csv(spark, t):
    """A CSV file comes as text, whatever its values look like."""
    return read_any(spark, _csv(spark, t("supplier").select("s_suppkey", "s_name", "s_nationkey"), "supplier"))


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey <> 2 THEN n_regionkey END AS n_regionkey FROM nation")
def scan_rows(spark, t):
    """Rows as mappings; a key that a row lacks is null, and keys that differ in case are one."""
    rows = [r.asDict() for r in t("nation").select("n_nationkey", "n_name", "n_regionkey").collect()]
    rows = [{"n_nationkey": r["n_nationkey"], "N_NAME" if r["n_nationkey"] % 2 else "n_name": r["n_name"]} | ({"n_regionkey": r["n_regionkey"]} if r["n_regionkey"] != 2 else {}) for r in rows]
    return read_any(spark, rows).toDF("n_nationkey", "n_name", "n_regionkey")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT max(r_regionkey), max(r_name) FROM region")
def scan_mappings(spark, t):
    """A mapping of lists is columns, one of single values a row."""
    rows = t("region").select("r_regionkey", "r_name").collect()
    lists = {"r_regionkey": [r[0] for r in rows], "r_name": [r[1] for r in rows]}
    return read_any(spark, lists).unionAll(read_any(spark, {k: max(v) for k, v in lists.items()}))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events")
def scan_frame(spark, t):
    """A DataFrame passes through; NaN becomes null."""
    return read_any(spark, t("events").select("event_id", F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("value")).alias("value")))


@query("SELECT n_name AS kind, 'ValueError' AS error FROM nation UNION ALL SELECT r_name, 'FileNotFoundError' FROM region")
def scan_errors(spark, t):
    """Files of kinds that can't be read, and files that aren't there, fail at once."""
    rows = []
    root = _shared(spark)
    t("region").limit(1).write.parquet(f"{root}/there.xyz")
    for name, path in [(r.n_name, f"{root}/there.xyz") for r in t("nation").collect()] + [(r.r_name, f"{root}/{r.r_name}.csv") for r in t("region").collect()]:
        try:
            read_any(spark, path)
        except (ValueError, FileNotFoundError) as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "kind string, error string")


@query("SELECT event_id, event_id AS item_id, user_id AS item_user_id, event_type AS item_user_kind, '[' || event_id || ',' || user_id || ']' AS marks, event_type AS photo_size FROM events")
def json_flatten_deep(spark, t):
    """Structs within structs become columns, arrays JSON text, and of an array of photos the last one's fields."""
    photo = F.array(F.struct(F.lit("small").alias("size")), F.struct(F.col("event_type").alias("size")))
    item = F.struct(F.col("event_id").alias("id"), F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind")).alias("user"))
    return flatten(t("events").select("event_id", item.alias("item"), F.array("event_id", "user_id").alias("marks"), photo.alias("photo")))


@query("SELECT r_name AS server, 'jdbc:' || lower(r_name) || ':5432' AS uri FROM region")
def config_variables(spark, t):
    """Settings with variables and their defaults, the active server's address."""
    from tessera.sources.readers import database_uri

    rows = []
    for r in t("region").collect():
        import json

        text = json.dumps({"servers": {r.r_name: {"uri": "jdbc:${NAME}:${PORT:5432}"}}, "active": r.r_name})
        rows.append((r.r_name, database_uri(load_config(text, {"NAME": r.r_name.lower()}))))
    return spark.createDataFrame(rows, "server string, uri string")


# ---------------------------------------------------------------- catalog


@query("SELECT table_name FROM (SELECT DISTINCT table_name FROM information_schema.columns) WHERE table_name IN ('region', 'nation', 'supplier', 'customer') AND regexp_matches(table_name, '^[rn]|er$')")
def catalog_tables(spark, t):
    c = _small_catalog(spark, t, "region", "nation", "supplier", "customer")
    return spark.createDataFrame([(n,) for n in c.list_tables("^[RN]|ER$") if c.has_table(n) and not c.has_table(n + "_x")], "table_name string")


@query("SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'supplier') AND contains(column_name, 'key')")
def catalog_find_column(spark, t):
    found = _small_catalog(spark, t, "region", "nation", "supplier").find_column("KEY")
    return spark.createDataFrame([(n, c) for n, cols in found.items() for c in cols], "table_name string, column_name string")


@query("SELECT table_name, column_name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'SMALLINT' THEN 'smallint' WHEN 'TINYINT' THEN 'tinyint' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE data_type END AS kind FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'supplier', 'customer', 'part')")
def catalog_columns(spark, t):
    names = ("region", "nation", "supplier", "customer", "part")
    c = _small_catalog(spark, t, *names)
    return spark.createDataFrame([(n, k, v.simpleString()) for n in names for k, v in c.columns(n).items()], "table_name string, column_name string, kind string")


@query("SELECT 'nation' AS table_name, (SELECT string_agg(column_name, ',' ORDER BY ordinal_position) FROM information_schema.columns WHERE table_name = 'nation') AS columns, (SELECT CASE WHEN count(DISTINCT n_nationkey) = count(*) THEN 'n_nationkey' END FROM nation) AS primary_key, (SELECT CASE WHEN count(DISTINCT n_name) = count(*) THEN 'n_name' END FROM nation) AS unique_set, 'n_nationkey' AS identity, (SELECT count(*) FROM nation) AS n")
def catalog_details(spark, t):
    """Keys, unique sets, identity columns and the whole description of a table."""
    c, df = Catalog(spark, _shared(spark)), t("nation")
    unique = [x for x in ("n_nationkey", "n_name") if profile.is_unique(df, [x])]
    c.save(df, TableSpec("nation", df.schema, (unique[0],), ((unique[1],),), identity=("n_nationkey",)))
    d = c.details("nation")
    row = (d["table"], ",".join(x["name"] for x in d["columns"]), ",".join(c.primary_key("nation")), ",".join(c.unique_sets("nation")[0]), ",".join(c.identity("nation")), c.row_count("nation"))
    return spark.createDataFrame([row], "table_name string, columns string, primary_key string, unique_set string, identity string, n long")


@query("SELECT r_name AS name, true AS created, 0 AS n, true AS dropped, false AS still_there FROM region")
def catalog_create_drop(spark, t):
    c, rows = Catalog(spark, _shared(spark)), []
    for r in t("region").collect():
        name = r.r_name.lower().replace(" ", "_")
        c.create(TableSpec(name, t("region").schema))
        c.create(TableSpec(name, t("region").schema), if_exists="keep")
        rows.append((r.r_name, c.has_table(name), c.row_count(name), c.drop(name), c.has_table(name) or c.drop(name)))
    return spark.createDataFrame(rows, "name string, created boolean, n int, dropped boolean, still_there boolean")


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS DOUBLE) END AS o_note FROM orders")
def catalog_alter_type(spark, t):
    """Another type for a column; values that don't fit become null."""
    c = Catalog(spark, _shared(spark))
    o = t("orders").select("o_orderkey", F.col("o_orderkey").alias("o_custkey"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("x").alias("o_note"))
    c.save(o, TableSpec("orders", o.schema))
    c.alter_type("orders", "O_CUSTKEY", T.StringType())
    c.alter_type("orders", "o_note", T.DoubleType())
    return c.table("orders")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 = 1 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 50 = 1")
def upsert_buckets(spark, t):
    """An upsert into a table dealt by key reads and writes the touched buckets only; what it leaves is vacuumed."""
    c, o = Catalog(spark, _shared(spark)), t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c.save(o.where("o_orderkey % 3 <> 0"), TableSpec("orders", o.schema, ("o_orderkey",)))
    c.deal("orders", ["o_orderkey"], 16)
    touched = c.upsert("orders", o.where("o_orderkey % 50 = 1").withColumn("o_orderstatus", F.lit("Z")), ["O_ORDERKEY"])
    c.vacuum("orders")
    out = c.table("orders")
    return out if len(touched) <= 16 else out.limit(0)


# ---------------------------------------------------------------- statements


def _statement_sql(table: str, key: str) -> str:
    rest = f"FILTER (WHERE column_name <> '{key}')"
    by = "ORDER BY ordinal_position"
    return f"""
WITH c AS ({_COLUMNS.format(table)}),
s AS (SELECT string_agg(column_name, ', ' {by}) AS names, string_agg(':' || column_name, ', ' {by}) AS colon, string_agg('%(' || column_name || ')s', ', ' {by}) AS form, string_agg('@' || column_name, ', ' {by}) AS at_,
  string_agg('src.' || column_name, ', ' {by}) AS src, string_agg(':' || column_name || ' AS ' || column_name, ', ' {by}) AS dual,
  string_agg(column_name || ' = excluded.' || column_name, ', ' {by}) {rest} AS low, string_agg(column_name || ' = EXCLUDED.' || column_name, ', ' {by}) {rest} AS up,
  string_agg('tgt.' || column_name || ' = src.' || column_name, ', ' {by}) {rest} AS tgt, string_agg(column_name || ' = VALUES(' || column_name || ')', ', ' {by}) AS vals FROM c),
i AS (SELECT *, 'INSERT INTO {table} (' || names || ') VALUES (' AS head FROM s)"""


@query(_statement_sql("nation", "n_nationkey") + """
SELECT d.dialect, head || CASE d.dialect WHEN 'oracle' THEN colon WHEN 'sqlite' THEN colon WHEN 'mssql' THEN at_ ELSE form END || ')' AS statement FROM i, (VALUES ('oracle'), ('postgresql'), ('sqlite'), ('mysql'), ('mssql')) AS d(dialect)""")
def insert_statements(spark, t):
    row = t("nation").first().asDict()
    return spark.createDataFrame([(d, sqltext.insert("nation", row, d).sql) for d in sqltext.DIALECTS], "dialect string, statement string")


@query(_statement_sql("nation", "n_nationkey") + """
SELECT d.dialect, CASE d.dialect
  WHEN 'oracle' THEN 'MERGE INTO nation tgt USING (SELECT ' || dual || ' FROM DUAL) src ON (tgt.n_nationkey = src.n_nationkey) WHEN MATCHED THEN UPDATE SET ' || tgt || ' WHEN NOT MATCHED THEN INSERT (' || names || ') VALUES (' || src || ')'
  WHEN 'mssql' THEN 'MERGE nation AS tgt USING (SELECT ' || at_ || ') AS src (' || names || ') ON (tgt.n_nationkey = src.n_nationkey) WHEN MATCHED THEN UPDATE SET ' || tgt || ' WHEN NOT MATCHED THEN INSERT (' || names || ') VALUES (' || src || ');'
  WHEN 'postgresql' THEN head || form || ') ON CONFLICT (n_nationkey) DO UPDATE SET ' || up
  WHEN 'sqlite' THEN head || colon || ') ON CONFLICT (n_nationkey) DO UPDATE SET ' || low
  ELSE head || form || ') ON DUPLICATE KEY UPDATE ' || vals END AS statement FROM i, (VALUES ('oracle'), ('postgresql'), ('sqlite'), ('mysql'), ('mssql')) AS d(dialect)""")
def upsert_statements(spark, t):
    row = t("nation").first().asDict()
    return spark.createDataFrame([(d, sqltext.upsert("nation", ["n_nationkey"], row, d).sql) for d in sqltext.DIALECTS], "dialect string, statement string")


@query("""
WITH r AS (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS k FROM region), s AS (SELECT string_agg('(:r_regionkey_' || k || ', :r_name_' || k || ')', ', ' ORDER BY k) AS colon, string_agg('(%(r_regionkey_' || k || ')s, %(r_name_' || k || ')s)', ', ' ORDER BY k) AS form, string_agg('(@r_regionkey_' || k || ', @r_name_' || k || ')', ', ' ORDER BY k) AS at_, string_agg('SELECT :r_regionkey_' || k || ' AS r_regionkey, :r_name_' || k || ' AS r_name FROM DUAL', ' UNION ALL ' ORDER BY k) AS dual FROM r)
SELECT d.dialect, CASE d.dialect
  WHEN 'oracle' THEN 'MERGE INTO region tgt USING (' || dual || ') src ON (tgt.r_regionkey = src.r_regionkey) WHEN MATCHED THEN UPDATE SET tgt.r_name = src.r_name WHEN NOT MATCHED THEN INSERT (r_regionkey, r_name) VALUES (src.r_regionkey, src.r_name)'
  WHEN 'mssql' THEN 'MERGE region AS tgt USING (VALUES ' || at_ || ') AS src (r_regionkey, r_name) ON (tgt.r_regionkey = src.r_regionkey) WHEN MATCHED THEN UPDATE SET tgt.r_name = src.r_name WHEN NOT MATCHED THEN INSERT (r_regionkey, r_name) VALUES (src.r_regionkey, src.r_name);'
  WHEN 'postgresql' THEN 'INSERT INTO region (r_regionkey, r_name) VALUES ' || form || ' ON CONFLICT (r_regionkey) DO UPDATE SET r_name = EXCLUDED.r_name'
  WHEN 'sqlite' THEN 'INSERT INTO region (r_regionkey, r_name) VALUES ' || colon || ' ON CONFLICT (r_regionkey) DO UPDATE SET r_name = excluded.r_name'
  ELSE 'INSERT INTO region (r_regionkey, r_name) VALUES ' || form || ' ON DUPLICATE KEY UPDATE r_regionkey = VALUES(r_regionkey), r_name = VALUES(r_name)' END AS statement FROM s, (VALUES ('oracle'), ('postgresql'), ('sqlite'), ('mysql'), ('mssql')) AS d(dialect)""")
def bulk_statements(spark, t):
    """One statement for all rows of a table; parameters get the row's number."""
    rows = [r.asDict() for r in t("region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()]
    return spark.createDataFrame([(d, sqltext.bulk_upsert("region", ["r_regionkey"], rows, d).sql) for d in sqltext.DIALECTS], "dialect string, statement string")


@query("SELECT 'INSERT INTO orders (o_orderkey, o_custkey, o_orderstatus) VALUES (:o_orderkey, :o_custkey, :o_orderstatus)' AS statement, '{\"o_orderkey\":' || o_orderkey || ',\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":' || CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE '\"' || o_orderstatus || '\"' END || '}' AS params FROM orders")
def statement_rows(spark, t):
    """A statement for every row of a table, as a DataFrame."""
    o = t("orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    return sqltext.statement_frame(o, lambda row: sqltext.insert("orders", row, "sqlite"))


@query("""
SELECT r_name, 'SELECT r_regionkey, r_name FROM region WHERE r_regionkey >= :r_regionkey_1 AND r_name LIKE :r_name_2 ESCAPE ''\\''' AS selected, '{"r_regionkey_1": ' || r_regionkey || ', "r_name_2": "%' || replace(r_name, '_', '\\\\_') || '%"}' AS parameters,
  'UPDATE region SET r_regionkey = :u_r_regionkey, r_name = :u_r_name WHERE r_regionkey = :r_regionkey_1 OR r_name = :r_name_2' AS updated, 'INSERT INTO region (r_regionkey, r_name) VALUES (:r_regionkey, :r_name)' AS inserted FROM region""")
def row_statements(spark, t):
    """Statements with a row's own values where a condition has ?."""
    import json

    out = []
    for r in t("region").select("r_regionkey", "r_name").collect():
        row = r.asDict()
        s = sqltext.build_select(row, "region", ["r_regionkey >= ?", ("R_NAME", "LIKE", "?")], dialect="postgresql", columns=["r_regionkey", "r_name"])
        u = sqltext.build_update(row, "region", ["r_regionkey = ?", ("r_name", "=", "?")], "1 OR 2")
        out.append((r.r_name, s.sql, json.dumps(s.params), u.sql, sqltext.build_insert(row, "region").sql))
    return spark.createDataFrame(out, "r_name string, selected string, parameters string, updated string, inserted string")


@query("SELECT 'SELECT r_name FROM region WHERE r_regionkey IN (SELECT 0)' AS x, string_agg('(r_regionkey = :r_regionkey_' || k || ' AND ' || CASE WHEN k % 2 = 0 THEN 'r_name IS NULL' ELSE 'r_name = :r_name_' || k END || ')', ' OR ' ORDER BY k) AS lookup, 'r_name IN (' || string_agg(':r_name_1_' || k, ', ' ORDER BY k) || ') AND NOT (r_regionkey < :r_regionkey_2)' AS predicate FROM (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS k FROM region)")
def predicate_statements(spark, t):
    """A predicate as text, and rows looked up by null-safe keys."""
    rows = [{"r_regionkey": r.r_regionkey, "r_name": r.r_name if k % 2 else None} for k, r in enumerate(t("region").orderBy("r_regionkey").collect())]
    names = [r.r_name for r in t("region").orderBy("r_regionkey").collect()]
    text = sqltext.key_lookup("region", ["r_regionkey", "r_name"], rows).sql
    where = sqltext.where([("r_name", "IN", names), ("r_regionkey", "<", 3)], "1 AND NOT 2").sql
    return spark.createDataFrame([("SELECT r_name FROM region WHERE r_regionkey IN (SELECT 0)", text.split(" WHERE ")[1].split(" ORDER BY ")[0], where)], "x string, lookup string, predicate string")


# ---------------------------------------------------------------- predicates


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 AND l_returnflag IN ('A', 'R') AND l_discount BETWEEN 0.02 AND 0.06")
def filter_condition_forms(spark, t):
    """A text, a tuple, a mapping, and a list of them."""
    forms = ["l_quantity > 40", [("l_returnflag", "IN", ["A", "R"])], {"field": "L_Discount", "operator": "between", "value": [0.02, 0.06]}]
    return predicate.select(t("lineitem"), ["l_orderkey", "l_linenumber"], forms)


@query("SELECT r_name, 'ValueError' AS error FROM region")
def filter_unknown(spark, t):
    """An operator that isn't known, and a column that isn't there, are errors when a table is read."""
    rows = []
    for r in t("region").collect():
        try:
            predicate.select(t("region"), ["r_name"], [("r_name", "SOUNDS LIKE", r.r_name)] if r.r_regionkey % 2 else [("no_such", "=", r.r_name)])
        except ValueError:
            rows.append((r.r_name, "ValueError"))
    return spark.createDataFrame(rows, "r_name string, error string")


@query("SELECT event_id, nullif(event_type, 'click') AS kind, nullif(value, 0) AS v FROM events WHERE nullif(event_type, 'click') IS NULL OR value IS NOT NULL AND event_type = 'view' OR nullif(value, 0) IS NULL AND user_id IS NOT NULL")
def filter_nulls(spark, t):
    """IS and IS NOT, with and without a value, over all events."""
    e = t("events").select("event_id", F.nullif("event_type", F.lit("click")).alias("kind"), "event_type", "user_id", "value").withColumn("v", F.nullif("value", F.lit(0.0)))
    conditions = [("kind", "IS", None), "value IS NOT NULL", "event_type = 'view'", "v IS NULL", ("user_id", "IS NOT", None)]
    return predicate.where(e, conditions, "1 OR (2 AND 3) OR (4 AND 5)").select("event_id", "kind", "v")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'")
def select_any_case(spark, t):
    """Columns by names in any case, spelled as the table spells them."""
    return predicate.select(t("orders"), ["O_ORDERKEY", "o_TotalPrice"], ["O_OrderStatus != 'P'"])


# ---------------------------------------------------------------- names


@query("SELECT table_name, column_name, column_name AS clean, column_name AS header FROM information_schema.columns WHERE table_name IN ('orders', 'lineitem', 'customer', 'supplier')")
def names_sanitised(spark, t):
    """Names with other characters, blanks and capitals become plain ones."""
    rows = []
    for n in ("orders", "lineitem", "customer", "supplier"):
        cols = t(n).columns
        odd = [f" {c.upper().replace('_', ' - ')}?" for c in cols]
        heads = cleaning.clean_headers(t(n).limit(0).toDF(*odd)).columns
        rows += list(zip([n] * len(cols), cols, ddl.sanitize_all(odd), heads, strict=True))
    return spark.createDataFrame(rows, "table_name string, column_name string, clean string, header string")


@query(f"SELECT d.dialect, column_name, CASE d.dialect WHEN 'oracle' THEN upper(column_name) WHEN 'mssql' THEN upper(column_name) ELSE column_name END AS name, CASE d.dialect WHEN 'oracle' THEN upper(column_name) WHEN 'mssql' THEN upper(column_name) ELSE column_name END || '_1' AS again, CASE d.dialect WHEN 'oracle' THEN upper(column_name) WHEN 'mssql' THEN '[' || column_name || ']' ELSE column_name END AS bare, CASE d.dialect WHEN 'mssql' THEN '[group by]' WHEN 'mysql' THEN '`group by`' ELSE '\"group by\"' END AS quoted FROM ({_COLUMNS.format('lineitem')}), (VALUES ('oracle'), ('postgresql'), ('sqlite'), ('mysql'), ('mssql')) AS d(dialect)")
def names_by_dialect(spark, t):
    """Identifiers, a number behind a name that repeats, and quoted names."""
    rows = []
    for d in sqltext.DIALECTS:
        for c in t("lineitem").columns:
            one, two = ddl.identifiers([c, c.upper()], d)
            rows.append((d, c, one, two, sqltext.quote(c, d), sqltext.quote("group by", d)))
    return spark.createDataFrame(rows, "dialect string, column_name string, name string, again string, bare string, quoted string")


@query("SELECT word, d.dialect, CASE d.dialect WHEN 'mssql' THEN '[' || word || ']' WHEN 'mysql' THEN CASE WHEN word IN ('select', 'int', 'bigint', 'unique') THEN '`' || word || '`' ELSE word END WHEN 'oracle' THEN CASE WHEN word IN ('select', 'level', 'date') THEN '\"' || word || '\"' ELSE upper(word) END WHEN 'postgresql' THEN CASE WHEN word IN ('select', 'bigint') THEN '\"' || word || '\"' ELSE word END ELSE CASE WHEN word IN ('select', 'unique') THEN '\"' || word || '\"' ELSE word END END AS quoted FROM (SELECT unnest(['select', 'level', 'date', 'int', 'bigint', 'unique', 'n_name']) AS word), (VALUES ('oracle'), ('postgresql'), ('sqlite'), ('mysql'), ('mssql')) AS d(dialect)")
def reserved_by_dialect(spark, t):
    """Each dialect quotes its own words."""
    words = ["select", "level", "date", "int", "bigint", "unique", "n_name"]
    return spark.createDataFrame([(w, d, sqltext.quote(w, d)) for w in words for d in sqltext.DIALECTS], "word string, dialect string, quoted string")


@query(f"SELECT upper(column_name) AS asked, column_name AS found FROM ({_COLUMNS.format('part')}) UNION ALL SELECT 'missing', NULL")
def names_resolved(spark, t):
    cols = t("part").columns
    return spark.createDataFrame([(c, predicate.resolve(c, cols)) for c in [*map(str.upper, cols), "missing"]], "asked string, found string")


@query("SELECT event_id AS EVENT_ID, '{\"user_id\":' || user_id || ',\"event_type\":\"' || event_type || '\"}' AS DETAIL, '[' || event_id || ',' || user_id || ']' AS PAIR, CAST(event_id % 100000 AS DOUBLE) + 0.5 AS TOOK FROM events")
def storage_frame(spark, t):
    """Nested values as compact JSON, durations as seconds, names as the database writes them."""
    took = F.make_dt_interval(secs=(F.col("event_id") % 100000 + 0.5).cast("decimal(18,6)"))
    e = t("events").select("event_id", F.struct("user_id", "event_type").alias("detail"), F.array("event_id", "user_id").alias("pair"), took.alias("took"))
    return ddl.for_storage(e, "oracle")


# ---------------------------------------------------------------- DDL

_CREATE = """
WITH c AS (SELECT column_name, data_type, ordinal_position FROM information_schema.columns WHERE table_name = 'nation'),
w AS (SELECT max(length(n_name)) AS name FROM nation), z AS (SELECT max(abs(n_nationkey)) AS k, max(abs(n_regionkey)) AS r FROM nation),
d AS (SELECT unnest(['sqlite', 'postgresql', 'mysql', 'mssql', 'oracle']) AS dialect),
l AS (SELECT dialect, string_agg(CASE WHEN dialect IN ('oracle', 'mssql') THEN upper(column_name) ELSE column_name END || ' ' || CASE WHEN data_type = 'VARCHAR' THEN CASE dialect WHEN 'sqlite' THEN 'text' WHEN 'mssql' THEN 'nvarchar(' || name || ')' WHEN 'oracle' THEN 'VARCHAR2(' || name || ' CHAR)' ELSE 'varchar(' || name || ')' END
  ELSE CASE dialect WHEN 'sqlite' THEN 'integer' WHEN 'mysql' THEN 'tinyint' WHEN 'oracle' THEN 'NUMBER(' || length(CAST(CASE WHEN column_name = 'n_nationkey' THEN k ELSE r END AS VARCHAR)) || ',0)' ELSE 'bigint' END END
  || CASE WHEN column_name = 'n_nationkey' AND dialect IN ('mysql', 'mssql') THEN ' NOT NULL' ELSE '' END, chr(44) || chr(10) || '    ' ORDER BY ordinal_position) AS body FROM c, w, z, d GROUP BY dialect)"""


@query(_CREATE + """
SELECT dialect, 'CREATE TABLE ' || CASE WHEN dialect = 'oracle' THEN 'NATION' ELSE 'nation' END || ' (' || chr(10) || '    ' || body || CASE WHEN dialect IN ('oracle', 'postgresql') THEN '' ELSE chr(44) || chr(10) || '    PRIMARY KEY (' || CASE WHEN dialect = 'mssql' THEN 'N_NATIONKEY' ELSE 'n_nationkey' END || ')' END || chr(10) || ')' AS statement,
  CASE dialect WHEN 'oracle' THEN 'ALTER TABLE NATION ADD CONSTRAINT pk_nation PRIMARY KEY (N_NATIONKEY)' WHEN 'postgresql' THEN 'ALTER TABLE nation ADD CONSTRAINT pk_nation PRIMARY KEY (n_nationkey)' ELSE '' END AS constraints FROM l""")
def ddl_create(spark, t):
    """CREATE TABLE by dialect, sized by the data, with the primary key inside or behind."""
    rows = []
    for d in ddl.TYPES:
        made = ddl.generate(t("nation").select("n_nationkey", "n_name", "n_regionkey"), "nation", d, key=["N_NationKey"])
        rows.append((d, made.create, ";".join(made.constraints)))
    return spark.createDataFrame(rows, "dialect string, statement string, constraints string")


@query("SELECT 'o_orderkey' AS column_name, false AS nullable UNION ALL SELECT 'o_note', (SELECT count(*) FILTER (WHERE o_orderkey % 2 <> 0) > 0 FROM orders)")
def nullable_columns(spark, t):
    stats = ddl.measure(t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("o_note")))
    return spark.createDataFrame([(c, s.nullable) for c, s in stats.items()], "column_name string, nullable boolean")


@query("WITH w AS (SELECT max(length(c_name)) AS n FROM customer), k AS (SELECT count(DISTINCT c_name) = count(*) AS u FROM customer) SELECT 'CREATE TABLE customer (' || chr(10) || '    c_custkey bigint GENERATED BY DEFAULT AS IDENTITY NOT NULL,' || chr(10) || '    c_name varchar(' || n || ') NOT NULL,' || chr(10) || '    c_nationkey bigint NOT NULL' || chr(10) || ')' AS statement, 'ALTER TABLE customer ADD CONSTRAINT pk_customer PRIMARY KEY (c_custkey);ALTER TABLE customer ADD CONSTRAINT uq_customer_1 UNIQUE (c_name);ALTER TABLE customer ADD CONSTRAINT fk_customer_1 FOREIGN KEY (c_nationkey) REFERENCES nation (n_nationkey) ON DELETE CASCADE' AS constraints FROM w, k WHERE u")
def ddl_constraints(spark, t):
    """Unique sets, references, identity columns, and NOT NULL as the data have it."""
    c = t("customer").select("c_custkey", "c_name", "c_nationkey")
    unique = [["c_name"]] if profile.is_unique(c, ["c_name"]) else []
    made = ddl.generate(c, "customer", "postgresql", key=["c_custkey"], unique=unique, foreign_keys=[(["c_nationkey"], "nation", ["n_nationkey"], "cascade")], not_null=True, autoincrement="c_custkey")
    return spark.createDataFrame([(made.create, ";".join(made.constraints))], "statement string, constraints string")


@query("SELECT column_name, CASE data_type WHEN 'VARCHAR' THEN 'StringType' WHEN 'BIGINT' THEN 'LongType' WHEN 'INTEGER' THEN 'IntegerType' WHEN 'DOUBLE' THEN 'DoubleType' ELSE 'TimestampNTZType' END AS kind FROM information_schema.columns WHERE table_name = 'orders'")
def schema_as_source(spark, t):
    """A schema as Python source, which gives the same schema back."""
    space: dict = {}
    exec(ddl.schema_source(t("orders").schema), space)  # noqa: S102
    return spark.createDataFrame([(f.name, type(f.dataType).__name__) for f in space["SCHEMA"]], "column_name string, kind string")


@query("SELECT column_name || ': longer than 30 characters' AS warning FROM (SELECT column_name || '_' || repeat('x', 30) AS column_name FROM information_schema.columns WHERE table_name = 'region') UNION ALL SELECT 'flag: stored as NUMBER(1,0)'")
def dialect_warnings(spark, t):
    long = t("region").toDF(*[f"{c}_{'x' * 30}" for c in t("region").columns]).withColumn("flag", F.lit(True))
    return spark.createDataFrame([(w,) for w in ddl.dialect_warnings(long.schema, "oracle")], "warning string")


@query("SELECT column_name, CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN data_type = 'DOUBLE' THEN 'float' WHEN data_type = 'VARCHAR' THEN 'string' ELSE 'datetime' END AS kind FROM information_schema.columns WHERE table_name IN ('orders', 'lineitem')")
def target_kinds(spark, t):
    """What kind of value each database type holds."""
    names = {"bigint": "bigint", "int": "int", "double": "double precision", "string": "varchar", "timestamp": "timestamp", "timestamp_ntz": "datetime2", "date": "date"}
    return spark.createDataFrame([(f.name, target_kind(names[f.dataType.simpleString()])) for n in ("orders", "lineitem") for f in t(n).schema], "column_name string, kind string")


# ---------------------------------------------------------------- alignment


def _mangled(t):
    o = t("orders").select(F.col("o_orderkey").cast("string").alias("O_OrderKey"), F.col("o_custkey").alias("customer"), F.when(F.col("o_orderkey") % 20 == 0, "n/a").otherwise(F.format_string("%.2f", F.col("o_totalprice"))).alias("O_TOTALPRICE"), F.lit("x").alias("unknown"))
    spec = TableSpec("orders", t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").schema, ("o_orderkey",))
    return o, spec


_ALIGNED = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 20 <> 0 THEN round(o_totalprice, 2) END AS o_totalprice FROM orders"


@query(_ALIGNED)
def align_columns(spark, t):
    """Names in any case and by a map, unknown columns dropped, values converted; five in a hundred fail, which is let pass."""
    o, spec = _mangled(t)
    return Aligner(spec, AlignConfig("balanced", 0.1)).align(o, {"customer": "o_custkey"}).df


@query("SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS o_orderstatus, CASE WHEN o_orderkey % 20 <> 0 THEN round(o_totalprice, 2) END AS o_totalprice FROM orders")
def align_with_missing(spark, t):
    """The same with the columns that the rows lack, as typed nulls, by the short form."""
    o, spec = _mangled(t)
    return align.with_missing(align.safe_align(o, spec, col_map={"customer": "o_custkey"}), spec)


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 20 = 0 THEN 'n/a' ELSE printf('%.2f', o_totalprice) END AS o_totalprice FROM orders")
def align_untouched(spark, t):
    """Beyond the limit a column stays as it came."""
    o, spec = _mangled(t)
    return Aligner(spec, AlignConfig("balanced", 0.01)).align(o, {"customer": "o_custkey"}).df


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 20 = 0) AS failures, 'o_totalprice' AS columns_with_failures, round(count(*) FILTER (WHERE o_orderkey % 20 = 0) / count(*) / 3, 9) AS average_rate, true AS strict_raises, 'unknown' AS extra, 'o_orderstatus' AS missing FROM orders")
def align_report(spark, t):
    """The report: rows, failures, rates, what was dropped and what is missing; a strict alignment raises instead."""
    o, spec = _mangled(t)
    report = Aligner(spec, AlignConfig("permissive", 0.2)).align(o, {"customer": "o_custkey"}).report
    try:
        align.strict_align(o, spec, col_map={"customer": "o_custkey"})
        raised = False
    except align.AlignmentError:
        raised = True
    s = report.summary()
    row = (report.rows, s["total_failures"], ",".join(s["columns_with_failures"]), round(s["average_rate"], 9), raised, ",".join(report.extra), ",".join(report.missing))
    return spark.createDataFrame([row], "n long, failures long, columns_with_failures string, average_rate double, strict_raises boolean, extra string, missing string")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 20 <> 0) AS kept FROM orders")
def align_decorated(spark, t):
    """A function whose argument is aligned before the call."""
    o, spec = _mangled(t)

    @align.aligned_to(spec)
    def counted(df):
        return df.agg(F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("kept"))

    return counted(o.withColumnRenamed("customer", "o_custkey"))


@query("SELECT event_id, '{\"a\":' || event_id || ',\"b\":\"' || event_type || '\"}' AS props, event_type, '[' || user_id || ',' || event_id || ']' AS pair, CASE WHEN event_id % 6 <> 0 THEN CAST(user_id AS DOUBLE) END AS amount, true AS raised FROM events")
def align_routed(spark, t):
    """JSON text is made compact, nested values become JSON, other text stays; what doesn't fit is null, or an error."""
    e = t("events").select(
        "event_id", F.concat(F.lit('{ "b": "'), "event_type", F.lit('", "a": '), F.col("event_id").cast("string"), F.lit("}")).alias("Props"), "event_type",
        F.array("user_id", "event_id").alias("pair"), F.when(F.col("event_id") % 6 == 0, "?").otherwise(F.col("user_id").cast("string")).alias("amount"),
    )
    schema = T.StructType([T.StructField("event_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("props", "event_type", "pair")], T.StructField("amount", T.DoubleType())])
    spec = TableSpec("events", schema, ("event_id",))
    try:
        align.routed(e, spec, on_error="raise")
        raised = False
    except align.AlignmentError:
        raised = True
    return align.routed(e, spec).df.withColumn("raised", F.lit(raised))


@query("SELECT event_id, CAST(NULL AS BLOB) AS v FROM events")
def strict_binary(spark, t):
    """What isn't bytes is no bytes."""
    return t("events").select("event_id", align.strict(F.col("event_type"), T.BinaryType(), source=T.StringType()).alias("v"))


@query("SELECT 'o_orderkey' AS spelled, true AS key_ok, true AS partial_fails, true AS unknown_fails")
def upsert_key_rule(spark, t):
    """A key must be the primary key or a unique set, whole, in any case."""
    spec = TableSpec("orders", t("orders").schema, ("o_orderkey",), (("o_custkey", "o_orderdate"),))
    fails = []
    for key in (["o_custkey"], ["no_such"]):
        try:
            spec.check_upsert_key(key)
            fails.append(False)
        except ValueError:
            fails.append(True)
    own = spec.check_upsert_key(["O_ORDERKEY"])
    pair = spec.check_upsert_key(["o_orderdate", "O_CUSTKEY"])
    return spark.createDataFrame([(own[0], len(pair) == 2, *fails)], "spelled string, key_ok boolean, partial_fails boolean, unknown_fails boolean")


# ---------------------------------------------------------------- keys, casts, cleaning


@query("SELECT 'verify' AS asked, 'o_orderkey' AS k FROM (SELECT count(DISTINCT o_orderkey) = count(*) AS u FROM orders) WHERE u UNION ALL SELECT 'O_OrderKey', 'o_orderkey' UNION ALL SELECT 'nothing', '' UNION ALL SELECT 'o_custkey', 'ValueError' FROM (SELECT count(DISTINCT o_custkey) < count(*) AS u FROM orders) WHERE u")
def key_policy(spark, t):
    """The table's key where it is asked for, a name checked, nothing for nothing, an error where a name isn't unique."""
    o, rows = t("orders"), []
    for name, asked, table_key in (("verify", "verify", ["O_ORDERKEY"]), ("O_OrderKey", "O_OrderKey", None), ("nothing", None, None), ("o_custkey", "o_custkey", None)):
        try:
            rows.append((name, ",".join(profile.decide_key(o, asked, table_key))))
        except ValueError:
            rows.append((name, "ValueError"))
    return spark.createDataFrame(rows, "asked string, k string")


@query("SELECT stratum, count(*) AS available, 40 AS n FROM (SELECT CAST((o_totalprice > quantile_cont(o_totalprice, 0.2) OVER ()) AS INTEGER) + CAST((o_totalprice > quantile_cont(o_totalprice, 0.4) OVER ()) AS INTEGER) + CAST((o_totalprice > quantile_cont(o_totalprice, 0.6) OVER ()) AS INTEGER) + CAST((o_totalprice > quantile_cont(o_totalprice, 0.8) OVER ()) AS INTEGER) AS stratum FROM orders) GROUP BY stratum")
def sample_stratified(spark, t):
    """As many rows from each fifth of an order: how many each range has, and how many were drawn."""
    o = t("orders").select("o_orderkey", "o_totalprice")
    drawn = profile.stratified_sample(o, "o_totalprice", 200).groupBy("stratum").agg(F.count(F.lit(1)).cast("int").alias("n"))
    every = profile.stratified_sample(o, "o_totalprice", 5 * o.count()).groupBy("stratum").agg(F.count(F.lit(1)).alias("available"))
    return every.join(drawn, "stratum").select("stratum", "available", "n")


@query("WITH q AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT event_id, coalesce(value < m - 2 * s OR value > m + 2 * s, false) AS is_outlier FROM events, q")
def zscore_population(spark, t):
    e = t("events")
    return e.select("event_id", outliers.is_outlier(F.col("value"), outliers.bounds(e, ["value"], method="zscore", z=2.0, ddof=0)["value"]).alias("is_outlier"))


_FENCE = "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, quantile_cont(event_id, 0.25) AS c, quantile_cont(event_id, 0.75) AS d FROM events)"


@query(_FENCE + " SELECT event_id, value IS NOT NULL AND value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) AND event_id BETWEEN c - 1.5 * (d - c) AND d + 1.5 * (d - c) AS keep FROM events, q")
def outlier_mask(spark, t):
    """False where any column is an outlier, or null."""
    return outliers.keep_mask(t("events").select("event_id", "value"), ["value", "event_id"], drop_nulls=True).select("event_id", "keep")


@query(_FENCE + " SELECT event_id, CASE WHEN value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN round(value, 6) END AS value FROM events, q")
def outliers_to_null(spark, t):
    e = t("events").select("event_id", "value")
    b = outliers.bounds(e, ["value"])["value"]
    return e.select("event_id", F.when(~outliers.is_outlier(F.col("value"), b), F.round("value", 6)).alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN date_trunc('minute', o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER))) END AS v FROM orders")
def free_datetime(spark, t):
    """Times that no fixed format fits, in words and with am and pm, cut to minutes."""
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"), secs=(F.col("o_orderkey") % 60).cast("decimal(18,6)"))
    form = F.when(F.col("o_orderkey") % 7 == 0, "soon").when(F.col("o_orderkey") % 3 == 0, F.date_format(at, "d MMMM yyyy h:mm:ss a")).when(F.col("o_orderkey") % 3 == 1, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(at, "EEE, MMM d yyyy HH:mm"))
    return t("orders").select("o_orderkey", casting.to_time_free(form).alias("v"))


@query("SELECT event_id, strftime(ts, '%H:%M') || CASE WHEN event_id % 2 = 0 THEN ':00' ELSE strftime(ts, ':%S') END AS clock, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS bit, CAST(event_id % 86400 AS DOUBLE) AS seconds FROM events")
def clock_bits_durations(spark, t):
    """Times of day, zeros and ones, and durations from text."""
    k = F.col("event_id")
    clock = F.when(k % 4 == 0, F.date_format("ts", "h:mm a")).when(k % 2 == 0, F.date_format("ts", "HH:mm")).otherwise(F.date_format("ts", "HH:mm:ss"))
    bit = F.when(k % 3 == 0, "1").when(k % 3 == 1, " 0 ").otherwise("2")
    s = k % 86400
    took = F.format_string("%d:%02d:%02d", (s / 3600).cast("int"), (s % 3600 / 60).cast("int"), s % 60)
    return t("events").select("event_id", casting.to_clock(clock).alias("clock"), casting.to_bits(bit).alias("bit"), casting.to_seconds(took).alias("seconds"))


def _texts(t):
    o = t("orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 20 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("mostly"), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("partly"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 20 <> 0 THEN o_custkey END AS mostly, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS partly, CAST(o_orderdate AS DATE) AS day FROM orders")
def cast_by_label(spark, t):
    """A conversion is made where it makes few values null, and not where it makes many."""
    return casting.auto_cast(_texts(t))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS mostly, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS partly, CAST(o_orderdate AS DATE) AS day FROM orders")
def cast_careful(spark, t):
    """The careful preset wants nineteen values in twenty, and more than nineteen."""
    return casting.cast(_texts(t), casting.CastConfig(use_transform=False, infer_threshold=0.95, max_null_increase=0.01))


@query(CLEANED.format("conv_id, turn", "conversations"))
def clean_all_texts(spark, t):
    """All conversations, whatever their script; composed letters, as SQL has no compatibility form."""
    config = cleaning.CleaningConfig(normal_form="NFC", null_words=())
    return t("conversations").select("conv_id", "turn", cleaning.clean(F.col("text"), config).alias("text"))


@query("SELECT n_nationkey, n_name || '...' AS v, n_name AS marks, lower(n_name) AS mapped FROM nation")
def clean_characters(spark, t):
    """Marks that become others, letters that look like Latin ones, special characters taken out, an own map."""
    s = F.concat(F.lit("​"), F.col("n_name"), F.lit("…﻿"))
    alike = F.translate(F.col("n_name"), "AEOPT", "АЕОРТ")
    special = cleaning.CleaningConfig(special=True)
    swap = cleaning.CleaningConfig(replace={chr(c): chr(c + 32) for c in range(65, 91)})
    marks = F.regexp_replace(cleaning.clean(F.concat(alike, F.lit("!?")), special), "[^A-Z0-9_ ]", "")
    return t("nation").select("n_nationkey", cleaning.clean(s).alias("v"), marks.alias("marks"), cleaning.clean(F.col("n_name"), swap).alias("mapped"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_custkey END AS a, CAST(o_totalprice AS VARCHAR) IS NOT NULL AS b, CAST(o_orderdate AS TIMESTAMP) AS c, true AS raised FROM orders")
def astype_by_name(spark, t):
    """Columns as types by names of any origin; strict conversions count what doesn't fit, in an error."""
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "?").otherwise(F.col("o_custkey").cast("string")).alias("a"), F.col("o_totalprice").alias("b"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("c"))
    names = {"a": "Int64", "b": "object", "c": "datetime64[ns]"}
    try:
        casting.safe_astype(o, names, strict=True)
        raised = False
    except ValueError:
        raised = True
    return casting.safe_astype(o, names).withColumns({"b": F.col("b").isNotNull(), "raised": F.lit(raised)})


@query("WITH n AS (SELECT greatest(1, CAST(floor(count(*) * 0.03) AS BIGINT)) AS n FROM orders), r AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS a, row_number() OVER (ORDER BY o_orderkey DESC) AS b FROM orders) SELECT 'first' AS side, o_totalprice FROM r, n WHERE a <= n UNION ALL SELECT 'last', o_totalprice FROM r, n WHERE b <= n")
def series_ends(spark, t):
    """The first and the last three in a hundred of a column's values."""
    a, b = profile.series_ends(t("orders"), "o_totalprice", ["o_orderkey"], 3)
    return a.select(F.lit("first").alias("side"), "o_totalprice").unionAll(b.select(F.lit("last").alias("side"), "o_totalprice"))


# ---------------------------------------------------------------- loads


@query("SELECT o_orderkey, 'one' AS side FROM orders WHERE o_orderkey % 4 = 1 UNION ALL SELECT o_orderkey, 'two' FROM orders WHERE o_orderkey % 4 = 2")
def key_sets(spark, t):
    """Keys that stand on one side only, by side."""
    o = t("orders")
    return dml.key_difference(o.where("o_orderkey % 4 < 2"), o.where("o_orderkey % 4 in (0, 2)"), ["o_orderkey"])


@query("SELECT c_nationkey AS k, 'customer' AS source FROM customer UNION SELECT s_nationkey, 'supplier' FROM supplier UNION SELECT n_nationkey, NULL FROM nation")
def union_of_distinct(spark, t):
    """The rows of several frames, each once, null where a frame lacks a column."""
    frames = [t("customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("source")), t("supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("k")), t("nation").select(F.col("n_nationkey").alias("k"))]
    return dml.distinct_union(frames)


@query("SELECT o_orderkey FROM orders WHERE false")
def change_trial(spark, t):
    """A cycle of inserts, upserts and an update gives what it should: the keys that differ are none."""
    from tessera.operators import harness

    return harness.trial(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice"), ["o_orderkey"], "o_orderstatus", "U")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3")
def change_trial_that_fails(spark, t):
    """The same cycle with an upsert that spoils the tenth part of the rows: the trial names them."""
    from tessera.operators import harness

    def upsert(table, rows):
        return dml.upsert(table, rows, ["o_orderkey"]).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 3, -1.0).otherwise(F.col("o_totalprice")))

    return harness.trial(t("orders").select("o_orderkey", "o_totalprice", "o_custkey"), ["o_orderkey"], "o_custkey", 0, upsert=upsert)


@query("SELECT n_name, 'UPDATE nation SET n_name = :s_0 WHERE n_nationkey = :w_0' AS updated, 'INSERT INTO nation (n_nationkey, n_name) VALUES (:n_nationkey, :n_name) ON CONFLICT (n_nationkey) DO UPDATE SET n_name = excluded.n_name' AS upserted, CASE WHEN n_nationkey % 3 = 0 THEN 'table nation has no column NO_SUCH' ELSE '' END AS error FROM nation")
def checked_statements(spark, t):
    """Statements whose names are checked against the table and spelled as it does; errors for rows with others."""
    nation, out = t("nation"), []
    for r in nation.collect():
        row = {"N_NATIONKEY": r.n_nationkey, "N_NAME": r.n_name}
        u = sqltext.checked("update", "nation", nation.columns, {"N_NAME": r.n_name}, "sqlite", conditions=[("N_NATIONKEY", "=", r.n_nationkey)]).sql
        _, errors = sqltext.checked_rows("insert", "nation", nation.columns, [row | ({"NO_SUCH": 1} if r.n_nationkey % 3 == 0 else {})], "sqlite")
        out.append((r.n_name, u, sqltext.checked("upsert", "nation", nation.columns, row, "sqlite", key=["N_NationKey"]).sql, "".join(errors)))
    return spark.createDataFrame(out, "n_name string, updated string, upserted string, error string")


def _changes(t):
    """Changes to orders: new and known keys, keys that repeat, and rows without a status or a key."""
    o = t("orders").where("o_orderkey % 2 = 0").select(F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.lit("N")).alias("o_orderstatus"))
    return o.unionAll(o.where("o_orderkey % 5 = 1").withColumn("o_custkey", F.col("o_custkey") + 1000000))


_CHANGES = "SELECT CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey END AS o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 <> 0 THEN 'N' END AS o_orderstatus, o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0"
_CHANGES = f"WITH a AS ({_CHANGES}), ch AS (SELECT * FROM a UNION ALL SELECT o_orderkey, o_custkey + 1000000, o_orderstatus, k FROM a WHERE o_orderkey % 5 = 1), r AS (SELECT *, CASE WHEN o_orderstatus IS NULL THEN 'not_null:o_orderstatus' WHEN o_orderkey IS NULL THEN 'key:o_orderkey' WHEN row_number() OVER (PARTITION BY o_orderkey, o_orderstatus ORDER BY o_custkey DESC) > 1 THEN 'later:o_orderkey' END AS reason FROM ch)"


def _checked(spark, t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    spec = TableSpec("orders", o.schema, ("o_orderkey",), not_null=("o_orderkey", "o_orderstatus"))
    return dml.upsert_checked(o.where("o_orderkey % 3 <> 0"), _changes(t), spec, ["o_orderkey"])


@query(_CHANGES + " SELECT o_orderkey, o_custkey, o_orderstatus, reason AS _reason FROM r WHERE reason IS NOT NULL")
def upsert_rejects(spark, t):
    """The rows that an upsert doesn't take, and why."""
    return _checked(spark, t).rejected


@query(_CHANGES + " SELECT o.o_orderkey, coalesce(r.o_custkey, o.o_custkey) AS o_custkey, coalesce(r.o_orderstatus, o.o_orderstatus) AS o_orderstatus FROM orders o LEFT JOIN (SELECT * FROM r WHERE reason IS NULL) r USING (o_orderkey) WHERE o.o_orderkey % 3 <> 0 OR r.o_orderkey IS NOT NULL")
def upsert_checked(spark, t):
    return _checked(spark, t).table


@query(_CHANGES + " SELECT o_orderkey, o_custkey, o_orderstatus, reason AS _reason FROM r WHERE reason IS NOT NULL ORDER BY o_custkey NULLS FIRST, o_orderkey NULLS FIRST, reason LIMIT 10")
def upsert_first_errors(spark, t):
    return dml.first_errors(_checked(spark, t).rejected, ["o_custkey", "o_orderkey"])


@query(_CHANGES + " SELECT CAST(o_custkey % 8 AS BIGINT) AS chunk, count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS success, count(*) FILTER (WHERE reason IS NOT NULL) AS failed FROM r GROUP BY 1")
def load_chunks(spark, t):
    """A checked upsert into a table of the catalog, counted by chunk."""
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    etl = ETL(spark, _shared(spark))
    etl.catalog.save(o.where("o_orderkey % 3 <> 0"), TableSpec("orders", o.schema, ("o_orderkey",), not_null=("o_orderkey", "o_orderstatus")))
    return etl.execute("upsert", _changes(t), "orders", chunk=(F.col("o_custkey") % 8).cast("long"))[1]


@query(_CHANGES + " SELECT reason || ': first of ' || count(*) OVER () AS error FROM r WHERE reason IS NOT NULL ORDER BY o_custkey NULLS FIRST, o_orderkey NULLS FIRST, reason LIMIT 1")
def first_failure_raises(spark, t):
    """An operation that takes all rows or raises at the first that it can't take."""
    change = _checked(spark, t)
    try:
        return dml.taken_or_raise(change, ["o_custkey", "o_orderkey"])
    except dml.Rejected as e:
        reason = ":".join(str(e).split(":")[:2])
        return change.rejected.agg(F.concat(F.lit(f"{reason}: first of "), F.count(F.lit(1)).cast("string")).alias("error"))


def _loaded(spark, t, name: str = "orders"):
    """A facade with a table of every third order left out, from a CSV file."""
    etl = ETL(spark, _shared(spark))
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    etl.create_load(_csv(spark, o.where("o_orderkey % 3 <> 0").withColumnRenamed("o_custkey", "O Cust-Key"), name), name, "o_orderkey")
    return etl, o


@query("SELECT o_orderkey, o_custkey AS o_cust_key, o_orderstatus, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate FROM orders WHERE o_orderkey % 3 <> 0")
def etl_create_load(spark, t):
    """A file cleaned, typed and loaded into a new table."""
    etl, _ = _loaded(spark, t)
    return etl.catalog.table("orders")


@query("SELECT o_orderkey, o_custkey AS o_cust_key, CASE WHEN o_orderkey % 2 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def etl_upsert(spark, t):
    etl, o = _loaded(spark, t)
    etl.auto(_csv(spark, o.where("o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("U")).withColumnRenamed("o_custkey", "O_CUST_KEY"), "changes"), "orders")
    return etl.catalog.table("orders")


@query("SELECT o_orderkey, o_custkey AS o_cust_key, o_orderstatus, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN 'new' END AS o_note FROM orders")
def etl_append_evolving(spark, t):
    """Rows with a further column; those of known keys are rejected."""
    etl, o = _loaded(spark, t)
    etl.append(o.withColumn("o_note", F.lit("new")).withColumnRenamed("o_custkey", "o_cust_key"), "orders", add_missing=True)
    return etl.catalog.table("orders")


@query("SELECT o_orderkey, o_custkey AS o_cust_key, CASE WHEN o_custkey > 50 AND o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate FROM orders WHERE o_orderkey % 3 <> 0")
def etl_update(spark, t):
    etl, _ = _loaded(spark, t)
    etl.update({"o_orderstatus": "X"}, "orders", [("o_cust_key", ">", 50), "o_orderstatus = 'O'"], "1 AND 2")
    return etl.catalog.table("orders")


@query("SELECT 'append' AS operation, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS taken, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS rejected, 0 AS tolerated, 'DATA_LOAD_FAILED' AS status FROM orders")
def etl_rejects(spark, t):
    """Rejected rows of an append, and nothing taken where more are rejected than is tolerated."""
    etl, o = _loaded(spark, t)
    rows = o.withColumnRenamed("o_custkey", "o_cust_key")
    none = etl.append(rows, "orders", tolerance=0)
    got = etl.append(rows, "orders")
    return spark.createDataFrame([(got.operation, got.total, got.rejected.count(), none.total, none.status)], "operation string, taken long, rejected long, tolerated int, status string")


@query("SELECT n_name AS target, CASE WHEN n_nationkey = 1 THEN 'DDL_FAILED' WHEN n_nationkey = 2 THEN 'DDL_GEN_FAILED' ELSE 'COMPLETED' END AS status, CASE WHEN n_nationkey IN (1, 2) THEN 0 ELSE (SELECT count(*) FROM region) END AS n FROM nation WHERE n_regionkey = 1 OR n_nationkey <= 3")
def load_targets(spark, t):
    """One source into many targets, each with its own status."""
    root, tables = _shared(spark), {}
    taken = Catalog(spark, f"{root}/1")
    for r in t("nation").where("n_regionkey = 1 or n_nationkey <= 3").collect():
        c = taken if r.n_nationkey == 1 else Catalog(spark, f"{root}/{r.n_nationkey}")
        tables[f"{r.n_name}.{'bad name' if r.n_nationkey == 2 else 'region'}"] = c
    taken.save(t("region"), TableSpec("region", t("region").schema))
    got = ETL(spark, taken, dialect="sqlite").run_many(t("region"), tables)
    return spark.createDataFrame([(k.rsplit(".", 1)[0], v.status.split(":")[0], v.total) for k, v in got.items()], "target string, status string, n long")


@query("SELECT 'in_nation' AS table_name, 'upsert' AS operation, 'n_nationkey' AS pk, (SELECT count(*) FROM nation) AS n, 'nation_key:upsert' AS kept FROM (SELECT count(DISTINCT n_nationkey) = count(*) AS u FROM nation) WHERE u UNION ALL SELECT 'in_region', 'upsert', 'r_regionkey', (SELECT count(*) FROM region), 'region_key:upsert'")
def folder_load(spark, t):
    """A folder of files: settings proposed from their first rows and kept, then loaded by them, twice over."""
    root = f"{_shared(spark)}/in"
    for n in ("nation", "region"):
        df = t(n).select(*[c for c in t(n).columns if c.endswith(("key", "name"))])
        write_csv(df.coalesce(1), f"{root}/{n}.csv")
    first = {n: propose(spark, f"{root}/{n}.csv") for n in ("nation", "region")}
    # settings of the files in folders below, kept beside them
    below = f"{_shared(spark)}/below"
    for n in first:
        write_csv(t(n).select(t(n).columns[0]).coalesce(1), f"{below}/{n}")
    settings = generate_configs(spark, below)
    kept = {n: next(f"{n}_key:{v['operation']}" for k, v in settings.items() if f"/{n}/" in k and v["pk"] == [t(n).columns[0]]) for n in first}
    own = f"{_shared(spark)}/tables"
    run_batch(spark, root, own, first)
    again = run_batch(spark, root, own, first)
    c = Catalog(spark, own)
    return spark.createDataFrame([(first[n]["table"], again[n].operation, ",".join(first[n]["pk"]), c.row_count(first[n]["table"]), kept[n]) for n in first], "table_name string, operation string, pk string, n long, kept string")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_upsert_buckets(spark, t):
    """A stream of files into a table dealt by key, batch by batch."""
    root, e = _shared(spark), t("events").select("event_id", "user_id", "event_type")
    e.withColumn("event_type", F.lit("?")).where("event_id % 2 = 0").repartition(2).write.parquet(f"{root}/in")
    c = Catalog(spark, f"{root}/tables")
    c.save(e.where("event_id % 2 = 0").withColumn("event_type", F.lit("!")), TableSpec("events", e.schema, ("event_id",)))
    c.deal("events", ["event_id"], 8)
    upsert_stream(file_stream(spark, f"{root}/in", e.schema), c, "events", ["event_id"], f"{root}/checkpoint").awaitTermination()
    e.write.mode("append").parquet(f"{root}/in")
    upsert_stream(file_stream(spark, f"{root}/in", e.schema), c, "events", ["event_id"], f"{root}/checkpoint").awaitTermination()
    return c.table("events")
