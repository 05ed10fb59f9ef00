"""Queries over the driver's tables, one for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import casting, cleaning, outliers
from tessera.operators import align, constraints, dml, profile
from tessera.pipeline import count_check
from tessera.plans import ddl, predicate
from tessera.sources.catalog import Catalog, structure_diff
from tessera.sources.readers import flatten
from tessera.sources.spec import TableSpec
from tessera.streaming.upsert import file_stream, tumbling_counts, upsert_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None):
    """Registers a function of (spark, tables): tables gives a DataFrame by name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, lambda t: _read(spark, sf_dir, t))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- predicates and projections


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus <> 'O'")
def filter_cmp(spark, t):
    return predicate.select(t("orders"), ["o_orderkey", "o_orderstatus", "o_totalprice"], [("o_totalprice", ">=", 150000), ("o_orderstatus", "!=", "O")])


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07")
def filter_between(spark, t):
    return predicate.select(t("lineitem"), ["l_orderkey", "l_linenumber", "l_discount"], [("l_discount", "BETWEEN", [0.05, 0.07])])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in(spark, t):
    return predicate.select(t("orders"), ["o_orderkey", "o_orderpriority"], ["o_orderpriority IN ('1-URGENT', '2-HIGH')"])


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a')")
def filter_like_contains(spark, t):
    return predicate.select(t("part"), ["p_partkey", "p_name"], [("p_name", "LIKE", "a")])


@query("SELECT p_partkey, p_type FROM part WHERE contains(p_type, '_%')")
def filter_like_escaped(spark, t):
    return predicate.select(t("part"), ["p_partkey", "p_type"], [("p_type", "LIKE", "_%")])


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%E%'")
def filter_raw_like(spark, t):
    return predicate.select(t("part"), ["p_partkey", "p_type"], [("p_type", "RAW LIKE", "%E%")])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND (l_returnflag = 'R' OR l_discount >= 0.08) AND l_tax < 0.05")
def filter_index_expr(spark, t):
    conditions = [("l_quantity", ">", 10), "l_returnflag = 'R'", {"field": "L_DISCOUNT", "operator": ">=", "value": "0.08"}, ("l_tax", "<", 0.05)]
    return predicate.select(t("lineitem"), ["l_orderkey", "l_linenumber"], conditions, "1 AND (2 OR 3) AND 4")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity > 10 OR l_returnflag = 'R') AND l_tax < 0.05")
def filter_not_expr(spark, t):
    return predicate.select(t("lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity > 10", "l_returnflag = 'R'"], "NOT (1 OR 2) AND l_tax < 0.05")


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_quantity > 30 AND l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'")
def filter_string_conditions(spark, t):
    return predicate.select(t("lineitem"), ["l_orderkey", "l_linenumber", "l_shipdate"], ["l_quantity > 30", "l_shipdate BETWEEN '1995-01-01' and '1996-12-31'"])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O', 'P') AND NOT contains(o_orderpriority, 'URGENT') AND o_totalprice NOT BETWEEN 1000 AND 100000")
def filter_not_forms(spark, t):
    return predicate.select(t("orders"), ["o_orderkey"], [("o_orderstatus", "NOT IN", ["O", "P"]), ("o_orderpriority", "NOT LIKE", "URGENT"), ("o_totalprice", "NOT BETWEEN", [1000, 100000])])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE false")
def filter_empty_in(spark, t):
    return predicate.select(t("orders"), ["o_orderkey", "o_custkey"], [("o_orderkey", "IN", [])])


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def placeholder_semi(spark, t):
    nation = t("nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    customer = t("customer")
    on = predicate.compile_predicate(predicate.parse_predicate(["c_nationkey = ?", "no_such = ?"]), customer.schema, source=lambda f: nation["c_nationkey"] if f == "c_nationkey" else None, target=lambda n: customer[n], allow_missing=True)
    return customer.join(nation, on, "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (1, 2, 3) ORDER BY 1")
def key_lookup(spark, t):
    keys = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k long")
    o = t("orders")
    return o.join(keys, o["o_custkey"].eqNullSafe(keys["k"]), "left_semi").select("o_orderkey", "o_custkey", "o_orderstatus").orderBy("o_orderkey")


# ---------------------------------------------------------------- profiles and keys


def _profile_sql(table: str, columns: list[str], times: tuple[str, ...] = ()) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS null_count, CAST(count({c}) AS BIGINT) AS non_null_count, round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count, count(DISTINCT {c}) = count({c}) AND count({c}) > 0 AS all_unique, count({c}) > 0 AND count(DISTINCT {c}) <= 0.1 * count({c}) AS is_categorical, {str(c in times).lower()} AS is_datetime FROM {table}"
        for c in columns
    )


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(_profile_sql("orders", _ORDERS, ("o_orderdate",)))
def profile_orders(spark, t):
    return profile.profile(t("orders")).drop("data_type")


@query(_profile_sql("lineitem", _LINEITEM, ("l_shipdate",)))
def profile_lineitem(spark, t):
    return profile.profile(t("lineitem")).drop("data_type")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(count(DISTINCT {c}) / count({c}), 6) AS uniqueness_ratio FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def uniqueness_ratio(spark, t):
    return profile.uniqueness(profile.profile(t("customer"))).select("column_name", F.round("uniqueness_ratio", 6).alias("uniqueness_ratio"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def pk_duplicates_single(spark, t):
    return profile.duplicates(t("lineitem"), ["l_orderkey"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def pk_duplicates_composite(spark, t):
    return profile.duplicates(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT 'c_custkey' AS column_name, 1 AS position, true AS is_unique")
def pk_derive(spark, t):
    key = profile.derive_key(t("customer"))
    return spark.createDataFrame([(c, k, key.is_unique) for k, c in enumerate(key.columns, 1)], "column_name string, position int, is_unique boolean")


@query("SELECT l_orderkey, l_linenumber, replace(CAST(l_orderkey AS VARCHAR), '|', '\\|') || '|' || CAST(l_linenumber AS VARCHAR) || '|' || l_returnflag AS pk FROM lineitem")
def composite_key(spark, t):
    return t("lineitem").select("l_orderkey", "l_linenumber", profile.composite(["l_orderkey", "l_linenumber", "l_returnflag"]).alias("pk"))


@query("SELECT (SELECT count(*) FROM orders) AS table_rows, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS frame_rows, (SELECT count(*) FROM orders) = (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS equal")
def row_count_check(spark, t):
    return count_check(t("orders"), t("orders").where("o_orderstatus <> 'F'"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS a, row_number() OVER (ORDER BY o_orderkey DESC) AS b, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_custkey FROM o WHERE a <= greatest(1, floor(n * 5 / 200)) OR b <= greatest(1, floor(n * 5 / 200))""")
def head_tail_sample(spark, t):
    return profile.head_tail(t("orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 5)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def distinct_union(spark, t):
    return t("customer").select(F.col("c_nationkey").alias("k")).unionAll(t("supplier").select(F.col("s_nationkey").alias("k"))).distinct()


# ---------------------------------------------------------------- changes of tables

_BASE = "SELECT * FROM orders WHERE o_orderkey % 3 <> 0"


def _base(t):
    return t("orders").where("o_orderkey % 3 <> 0")


def _spec(df: DataFrame, *key: str) -> TableSpec:
    return TableSpec("t", df.schema, tuple(key), not_null=("o_custkey",) if "o_custkey" in df.columns else ())


@query(f"""
WITH base AS ({_BASE}),
src AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
SELECT o_orderkey, o_totalprice, CASE WHEN o_custkey IS NULL THEN 'not_null:o_custkey' WHEN o_orderkey IN (SELECT o_orderkey FROM base) THEN 'key:o_orderkey' ELSE 'accepted' END AS outcome FROM src""")
def insert_conflict_split(spark, t):
    src = t("orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("o_custkey"), "o_totalprice")
    change = dml.insert(_base(t), src, _spec(t("orders"), "o_orderkey"))
    done = change.accepted.select("o_orderkey", "o_totalprice", F.lit("accepted").alias("outcome"))
    return done.union(change.rejected.select("o_orderkey", "o_totalprice", dml.REASON))


_CHANGES = "SELECT o_orderkey, 'X' AS o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice + 1 END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0"


def _changes(t):
    return t("orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") + 1).alias("o_totalprice"))


_UPSERT = f"""
WITH b AS ({_BASE}), s AS ({_CHANGES})
SELECT coalesce(b.o_orderkey, s.o_orderkey) AS o_orderkey, b.o_custkey, CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus,
  CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_totalprice ELSE b.o_totalprice END AS o_totalprice, b.o_orderpriority
FROM b FULL OUTER JOIN s ON b.o_orderkey = s.o_orderkey"""


@query(_UPSERT)
def upsert_orders(spark, t):
    return dml.upsert(_base(t), _changes(t), ["o_orderkey"]).drop("o_orderdate")


@query(f"SELECT count(*) AS total_rows, count(o_totalprice) AS prices FROM ({_UPSERT})")
def upsert_null_overwrite(spark, t):
    return dml.upsert(_base(t), _changes(t), ["o_orderkey"]).agg(F.count(F.lit(1)).alias("total_rows"), F.count("o_totalprice").alias("prices"))


@query(f"WITH b AS ({_BASE}), s AS ({_CHANGES}) SELECT count(*) FILTER (WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)) AS inserted, count(*) FILTER (WHERE o_orderkey IN (SELECT o_orderkey FROM b)) AS updated FROM s")
def upsert_counts(spark, t):
    return dml.upsert_counts(_base(t), _changes(t), ["o_orderkey"])


@query("""
WITH s AS (SELECT l_orderkey AS o_orderkey, l_quantity AS o_totalprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC) AS r FROM lineitem),
l AS (SELECT o_orderkey, o_totalprice FROM s WHERE r = 1)
SELECT coalesce(o.o_orderkey, l.o_orderkey) AS o_orderkey, o.o_custkey, CASE WHEN l.o_orderkey IS NOT NULL THEN l.o_totalprice ELSE o.o_totalprice END AS o_totalprice FROM orders o FULL OUTER JOIN l ON o.o_orderkey = l.o_orderkey""")
def upsert_last_wins(spark, t):
    src = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("o_totalprice"), F.struct("l_linenumber", "l_partkey", "l_quantity").alias("seq"))
    return dml.upsert(t("orders"), src, ["o_orderkey"], ["seq"]).select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"WITH b AS ({_BASE}) SELECT o_orderkey, o_custkey FROM b UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def upsert_keyonly(spark, t):
    return dml.insert_if_absent(_base(t), t("orders").select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND (o_totalprice > 100000 OR o_orderpriority = '5-LOW') THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_where(spark, t):
    return dml.update(t("orders"), {"O_ORDERSTATUS": "Z"}, [("o_orderstatus", "=", "O"), "o_totalprice > 100000", ("o_orderpriority", "=", "5-LOW")], "1 AND (2 OR 3)").select("o_orderkey", "o_orderstatus")


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice > 100000) AS updated FROM orders")
def update_count(spark, t):
    return dml.updated_rows(t("orders"), [("o_orderstatus", "=", "O"), ("o_totalprice", ">", 100000)])


@query("""
WITH s AS (SELECT s_nationkey AS c_nationkey, max(s_acctbal) AS c_acctbal FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
SELECT c_custkey, c_name, c.c_nationkey, CASE WHEN m.b IS NOT NULL THEN m.b ELSE c.c_acctbal END AS c_acctbal
FROM customer c LEFT JOIN (SELECT c_custkey AS k, max(s.c_acctbal) AS b FROM customer x JOIN s ON x.c_nationkey = s.c_nationkey AND x.c_acctbal < s.c_acctbal GROUP BY 1) m ON m.k = c.c_custkey
UNION ALL SELECT NULL, NULL, s.c_nationkey, s.c_acctbal FROM s WHERE NOT EXISTS (SELECT 1 FROM customer x WHERE x.c_nationkey = s.c_nationkey AND x.c_acctbal < s.c_acctbal)""")
def merge_template(spark, t):
    src = t("supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_acctbal").alias("c_acctbal"))
    return dml.merge(t("customer"), src, ["c_nationkey = ?", "c_acctbal < ?"], set_columns=["c_acctbal"], order_by=["c_acctbal"]).select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@query("SELECT o.o_orderkey, coalesce(CASE WHEN o.o_orderkey % 2 = 0 AND o.o_orderkey % 4 <> 0 THEN o.o_totalprice + 1 END, o.o_totalprice) AS o_totalprice FROM orders o")
def overlay_changes(spark, t):
    return dml.overlay(t("orders").select("o_orderkey", "o_totalprice"), _changes(t).drop("o_orderstatus"), ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 0 OR o_orderkey % 70 = 0")
def frames_close(spark, t):
    a = t("orders").select("o_orderkey", "o_totalprice", "o_orderdate").where("o_orderkey % 70 <> 0")
    e = t("orders").select("o_orderkey", (F.col("o_totalprice") * F.when(F.col("o_orderkey") % 50 == 0, 1.1).otherwise(1 + 1e-7)).alias("o_totalprice"), (F.col("o_orderdate") + F.expr("interval 3 seconds")).alias("o_orderdate"))
    return dml.differing(a, e, ["o_orderkey"])


@query(f"WITH b AS ({_BASE}) SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def key_set_difference(spark, t):
    return t("orders").select("o_orderkey").exceptAll(_base(t).select("o_orderkey"))


@query("SELECT r_regionkey, r_name, NULL AS r_note, NULL AS r_rank FROM region UNION ALL SELECT n_nationkey, n_name, 'x', CAST(n_regionkey AS BIGINT) FROM nation")
def schema_evolution_union(spark, t):
    catalog = Catalog(spark, _shared(spark))
    region = t("region")
    catalog.save(region, TableSpec("region", region.schema))
    catalog.add_columns("region", [T.StructField("r_note", T.StringType()), T.StructField("r_rank", T.LongType())])
    new = t("nation").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name"), F.lit("x").alias("r_note"), F.col("n_regionkey").cast("long").alias("r_rank"))
    catalog.append(new, "region")
    return catalog.table("region")


@query("SELECT * FROM (VALUES ('missing_in_db', 'o_comment'), ('extra_in_db', 'o_custkey'), ('extra_in_db', 'o_orderdate'), ('extra_in_db', 'o_orderpriority'), ('type_mismatch', 'o_totalprice')) AS v(kind, column_name)")
def schema_diff(spark, t):
    d = structure_diff({"O_ORDERKEY": "bigint", "o_orderstatus": "string", "o_totalprice": "bigint", "o_comment": "string"}, t("orders").schema)
    rows = [(k, c if isinstance(c, str) else c[0]) for k, v in d.items() for c in v]
    return spark.createDataFrame(rows, "kind string, column_name string")


def _shared(spark: SparkSession) -> str:
    """A new folder that all executors reach; one of this machine's only where Spark runs in this process alone."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
    return f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- constraints


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 3 <> 0)")
def fk_violations(spark, t):
    return constraints.reference_violations(t("lineitem"), _base(t), ["l_orderkey"], ["o_orderkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT count(*) AS n FROM lineitem l WHERE l_linenumber IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem p WHERE p.l_orderkey % 2 = 0 AND p.l_orderkey = l.l_orderkey AND p.l_linenumber = l.l_linenumber)")
def fk_violations_composite(spark, t):
    key = ["l_orderkey", "l_linenumber"]
    return constraints.reference_violations(t("lineitem"), t("lineitem").where("l_orderkey % 2 = 0"), key, key).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 3 <> 0)")
def fk_present_semi(spark, t):
    return constraints.reference_found(t("lineitem"), _base(t), ["l_orderkey"], ["o_orderkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT 'o_orderstatus' AS column_name, count(*) FILTER (WHERE o_orderstatus = 'F') AS violations FROM orders UNION ALL SELECT 'o_custkey', count(*) FILTER (WHERE o_custkey IS NULL) FROM orders")
def not_null_violations(spark, t):
    o = t("orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("F")))
    return constraints.null_counts(o, ["o_orderstatus", "o_custkey"])


@query("SELECT 'p_name' AS column_name, count(*) FILTER (WHERE length(p_name) > 12) AS violations FROM part UNION ALL SELECT 'p_type', count(*) FILTER (WHERE length(p_type) > 5) FROM part")
def length_violations(spark, t):
    return constraints.length_counts(t("part"), {"p_name": 12, "p_type": 5})


@query('SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS "rows" FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)')
def duplicate_rows_all(spark, t):
    return constraints.duplicate_rows(t("lineitem"), ["l_orderkey"])


@query('SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS "rows" FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)')
def duplicate_rows_later(spark, t):
    return constraints.duplicate_rows(t("lineitem"), ["l_orderkey"], keep_first=True)


# ---------------------------------------------------------------- strict conversions

_NUM = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_NOISY = "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN 'x1' WHEN l_orderkey % 7 = 1 THEN ' ' || CAST(l_partkey AS VARCHAR) || '.0 ' WHEN l_orderkey % 7 = 2 THEN CAST(l_partkey AS VARCHAR) || '.5' WHEN l_orderkey % 7 = 3 THEN '1d' WHEN l_orderkey % 7 = 4 THEN '99999999999' WHEN l_orderkey % 7 = 5 THEN '1e3' ELSE CAST(l_partkey AS VARCHAR) END AS s FROM lineitem"


def _noisy(t):
    k, p = F.col("l_orderkey") % 7, F.col("l_partkey").cast("string")
    s = F.when(k == 0, "x1").when(k == 1, F.concat(F.lit(" "), p, F.lit(".0 "))).when(k == 2, F.concat(p, F.lit(".5"))).when(k == 3, "1d").when(k == 4, "99999999999").when(k == 5, "1e3").otherwise(p)
    return t("lineitem").select("l_orderkey", "l_linenumber", s.alias("s"))


@query(f"WITH n AS ({_NOISY}), d AS (SELECT *, CASE WHEN regexp_matches(s, '{_NUM}') THEN TRY_CAST(trim(s) AS DOUBLE) END AS d FROM n) SELECT l_orderkey, l_linenumber, CASE WHEN d = round(d) AND d BETWEEN -2147483648 AND 2147483647 THEN CAST(d AS INTEGER) END AS v FROM d")
def strict_int(spark, t):
    return _noisy(t).select("l_orderkey", "l_linenumber", align.strict(F.col("s"), T.IntegerType()).alias("v"))


@query(f"WITH n AS ({_NOISY}) SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(s, '{_NUM}') THEN TRY_CAST(trim(s) AS DOUBLE) END AS v FROM n")
def strict_float(spark, t):
    return _noisy(t).select("l_orderkey", "l_linenumber", align.strict(F.col("s"), T.DoubleType()).alias("v"))


_WORDS = "['true', 'NO', ' y ', 'on', 'Off', '1', '0', 'maybe', 'T', 'f', '2']"


@query(f"SELECT event_id, CASE WHEN lower(trim(w)) IN ('true', 'yes', 'y', 't', '1', 'on') THEN true WHEN lower(trim(w)) IN ('false', 'no', 'n', 'f', '0', 'off') THEN false END AS v FROM (SELECT event_id, {_WORDS}[event_id % 11 + 1] AS w FROM events)")
def strict_bool(spark, t):
    words = F.array(*[F.lit(w) for w in ("true", "NO", " y ", "on", "Off", "1", "0", "maybe", "T", "f", "2")])
    return t("events").select("event_id", align.strict(F.get(words, (F.col("event_id") % 11).cast("int")), T.BooleanType()).alias("v"))


SQL["bool_map"] = SQL["strict_bool"]


@query(SQL["bool_map"])
def bool_map(spark, t):
    words = F.array(*[F.lit(w) for w in ("true", "NO", " y ", "on", "Off", "1", "0", "maybe", "T", "f", "2")])
    return t("events").select("event_id", casting.to_boolean(F.get(words, (F.col("event_id") % 11).cast("int"))).alias("v"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN date_trunc('second', o_orderdate) WHEN 1 THEN date_trunc('minute', o_orderdate) WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) WHEN 3 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS v FROM orders""")
def strict_datetime(spark, t):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    s = F.when(k == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm")).when(k == 2, F.date_format(d, "dd/MM/yyyy")).when(k == 3, F.date_format(d, "yyyyMMdd")).otherwise(F.lit("31/31/2020"))
    return t("orders").select("o_orderkey", align.strict(s, T.TimestampNTZType()).alias("v"))


@query("SELECT event_id, json_valid(CASE WHEN event_id % 4 = 0 THEN props || '}' ELSE props END) AS ok FROM events WHERE props IS NOT NULL")
def strict_json(spark, t):
    s = F.when(F.col("event_id") % 4 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return t("events").where("props is not null").select("event_id", align.strict(s, T.StringType(), json=True).isNotNull().alias("ok"))


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 12 THEN p_name END AS v FROM part")
def strict_string(spark, t):
    return t("part").select("p_partkey", align.strict(F.col("p_name"), T.StringType(), max_length=12).alias("v"))


@query(f"WITH n AS ({_NOISY}), d AS (SELECT *, CASE WHEN regexp_matches(s, '{_NUM}') THEN TRY_CAST(trim(s) AS DOUBLE) END AS d FROM n) SELECT 'as_float' AS column_name, count(*) FILTER (WHERE d IS NULL) AS failures, round(count(*) FILTER (WHERE d IS NULL) / count(*), 9) AS rate FROM d UNION ALL SELECT 'as_long', count(*) FILTER (WHERE d IS NULL OR d <> round(d)), round(count(*) FILTER (WHERE d IS NULL OR d <> round(d)) / count(*), 9) FROM d")
def failure_rates(spark, t):
    n = _noisy(t).withColumns({"as_float": F.col("s"), "as_long": F.col("s")})
    return align.failure_rates(n, {"as_float": casting.to_number(F.col("s")), "as_long": casting.to_integer(F.col("s"))}).withColumn("rate", F.round("rate", 9))


_LABEL = r"""CASE WHEN regexp_full_match(v, '\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}') THEN 'timestamp' WHEN regexp_full_match(v, '\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}') THEN 'date' WHEN regexp_full_match(lower(v), 'true|false|yes|no|y|n') THEN 'boolean' WHEN regexp_full_match(v, '-?\d+') THEN 'integer' WHEN regexp_full_match(v, '-?\d*\.?\d+|-?\d*\.?\d*[eE][+-]?\d+') THEN 'float' ELSE 'string' END"""


@query(f"SELECT c AS column_name, {_LABEL} AS label, count(*) AS n FROM (SELECT 'o_orderstatus' AS c, o_orderstatus AS v FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders UNION ALL SELECT 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders) GROUP BY 1, 2")
def cast_infer_labels(spark, t):
    o = t("orders").select("o_orderstatus", F.col("o_custkey").cast("string").alias("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")
    counts = casting.measure_labels(o)
    return spark.createDataFrame([(c, k, n) for c, m in counts.items() for k, n in m.items() if n], "column_name string, label string, n long")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN round(o_totalprice, 2) END AS v FROM orders")
def currency_numeric(spark, t):
    s = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("$ "), F.format_number("o_totalprice", 2))).otherwise(F.lit("n/a"))
    return t("orders").select("o_orderkey", casting.to_currency(s).alias("v"))


@query("SELECT 'created_at' AS column_name, 'timestamp' AS kind UNION ALL SELECT 'amount', 'currency' UNION ALL SELECT 'flag', 'boolean'")
def cast_plan(spark, t):
    o = t("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.concat(F.lit("€"), F.format_number("o_totalprice", 2)).alias("amount"), F.when(F.col("o_orderstatus") == "F", "yes").otherwise("off").alias("flag"), "o_orderpriority")
    plan = casting.plan_cast(o)
    return spark.createDataFrame(list(plan.conversions.items()), "column_name string, kind string")


@query("SELECT 'props' AS column_name, 'STRUCTURED_OBJECT' AS semantic UNION ALL SELECT 'event_type', 'STRING_OBJECT'")
def semantic_object_types(spark, t):
    plan = casting.plan_cast(t("events").select("props", "event_type"))
    return spark.createDataFrame(list(plan.semantic.items()), "column_name string, semantic string")


_SHAPES = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'yes' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN '12/05:99' ELSE o_orderpriority END AS s FROM orders"


@query(f"SELECT o_orderkey, CASE WHEN s IN ('yes', '0', '1') THEN 'boolean' WHEN regexp_matches(s, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'datetime' WHEN regexp_matches(s, '^\\d+$') THEN 'float' WHEN s = '12/05:99' THEN 'datetime' ELSE 'object' END AS label FROM ({_SHAPES})")
def shape_labels(spark, t):
    k = F.col("o_orderkey") % 5
    s = F.when(k == 0, F.col("o_custkey").cast("string")).when(k == 1, "yes").when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 3, "12/05:99").otherwise(F.col("o_orderpriority"))
    return t("orders").select("o_orderkey", casting.shape_label(s).alias("label"))


@query(f"WITH n AS ({_NOISY}), d AS (SELECT *, CASE WHEN regexp_matches(s, '{_NUM}') THEN TRY_CAST(trim(s) AS DOUBLE) END AS d FROM n) SELECT 's' AS column_name, CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, s) AS INTEGER) AS position, s AS value FROM d WHERE d IS NULL ORDER BY l_orderkey, l_linenumber, s LIMIT 5")
def failing_values(spark, t):
    return align.failing_values(_noisy(t), {"s": casting.to_number(F.col("s"))}, ["l_orderkey", "l_linenumber", "s"])


# ---------------------------------------------------------------- outliers


@query("WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a) AS is_outlier FROM lineitem, q")
def iqr_outliers(spark, t):
    li = t("lineitem")
    b = outliers.bounds(li, ["l_extendedprice"])["l_extendedprice"]
    return li.select("l_orderkey", "l_linenumber", outliers.is_outlier(F.col("l_extendedprice"), b).alias("is_outlier"))


@query("WITH q AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT event_id, coalesce(value < m - 2 * s OR value > m + 2 * s, false) AS is_outlier FROM events, q")
def zscore_outliers(spark, t):
    e = t("events")
    b = outliers.bounds(e, ["value"], method="zscore", z=2.0)["value"]
    return e.select("event_id", outliers.is_outlier(F.col("value"), b).alias("is_outlier"))


@query("WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) SELECT event_id, round(CASE WHEN value IS NULL OR value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) THEN 0 ELSE value END, 6) AS value FROM events, q")
def outliers_to_zero(spark, t):
    return outliers.replace_outliers(t("events").select("event_id", "value"), ["value"]).select("event_id", F.round("value", 6).alias("value"))


# ---------------------------------------------------------------- cleaning

#: Cleaning without words for null. SQL has canonical composition only, which is the same as NFKC where no text holds a
#: compatibility character.
CLEANED = "SELECT {}, trim(regexp_replace(regexp_replace(translate(replace(nfc_normalize(text), chr(8230), '...'), chr(160) || chr(8216) || chr(8217) || chr(8211) || chr(8212), ' ''''--'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]', '', 'g'), '[\\x{{200B}}\\x{{200C}}\\x{{200D}}\\x{{2060}}\\x{{FEFF}}\\x{{180E}}]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(133) || chr(160) || chr(8195) || chr(8232) || chr(8233)) AS text FROM {}"


@query(f"SELECT doc_id, CASE WHEN text NOT IN ('nan', 'None', 'NAT', 'NAN', 'null') THEN text END AS text FROM ({CLEANED.format('doc_id', 'documents')})")
def clean_nfkc(spark, t):
    return t("documents").select("doc_id", cleaning.clean(F.col("text")).alias("text"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer")
def clean_null_words(spark, t):
    words = F.array(*[F.lit(w) for w in cleaning.NULL_WORDS])
    s = F.when(F.col("c_custkey") % 5 == 0, F.get(words, (F.col("c_custkey") % 25 / 5).cast("int"))).otherwise(F.col("c_mktsegment"))
    return t("customer").select("c_custkey", cleaning.clean(s).alias("seg"))


# ---------------------------------------------------------------- sizes for types, JSON, streams


@query("SELECT 'p_name' AS column_name, max(length(p_name)) AS longest FROM part UNION ALL SELECT 'p_brand', max(length(p_brand)) FROM part UNION ALL SELECT 'p_type', max(length(p_type)) FROM part")
def varchar_sizes(spark, t):
    stats = ddl.measure(t("part").select("p_name", "p_brand", "p_type"))
    return spark.createDataFrame([(c, s.longest) for c, s in stats.items()], "column_name string, longest long")


@query("SELECT 'l_orderkey' AS column_name, length(CAST(max(abs(l_orderkey)) AS VARCHAR)) AS digits FROM lineitem UNION ALL SELECT 'l_linenumber', length(CAST(max(abs(l_linenumber)) AS VARCHAR)) FROM lineitem")
def int_precision(spark, t):
    stats = ddl.measure(t("lineitem").select("l_orderkey", "l_linenumber"))
    return spark.createDataFrame([(c, ddl.int_precision(s.low, s.high)) for c, s in stats.items()], "column_name string, digits long")


@query()
def ddl_statements(spark, t):
    o = t("orders")
    stats = ddl.measure(o)
    rows = [(d, ddl.create_table(o.schema, stats, "orders", d, key=["o_orderkey"]).create) for d in ddl.TYPES]
    return spark.createDataFrame(rows, "dialect string, statement string")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) IS NOT NULL AS has_k, event_id AS inner_id, user_id AS inner_user FROM events")
def json_flatten(spark, t):
    e = t("events").select("event_id", F.get_json_object("props", "$.k").isNotNull().alias("has_k"), F.struct(F.col("event_id").alias("id"), F.col("user_id").alias("user")).alias("inner"))
    return flatten(e)


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_upsert_events(spark, t):
    root = _shared(spark)
    e = t("events").select("event_id", "ts", "user_id", "event_type", "value")
    e.withColumn("value", F.lit(None).cast("double")).where("event_id % 2 = 0").write.parquet(f"{root}/in")
    e.write.mode("append").parquet(f"{root}/in")
    catalog = Catalog(spark, f"{root}/tables")
    spec = TableSpec("events", e.schema, ("event_id",))
    catalog.create(spec)
    # the rows with a value come after those without
    q = upsert_stream(file_stream(spark, f"{root}/in", e.schema), catalog, "events", ["event_id"], f"{root}/checkpoint", order_by=["value"])
    q.awaitTermination()
    return catalog.table("events")


@query("SELECT date_trunc('minute', ts) - to_minutes(CAST(minute(ts) % 10 AS INTEGER)) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_tumbling_counts(spark, t):
    """An extension beside the load operators."""
    return tumbling_counts(t("events"), "ts", "event_type")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: changes aligned to orders, upserted, and counted by status."""
    orders = _read(spark, sf_dir, "orders")
    spec = TableSpec("orders", orders.schema, ("o_orderkey",))
    changes = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("O_ORDERKEY"), F.lit("X").alias("o_orderstatus"), F.format_string("%.2f", F.col("o_totalprice") + 1).alias("o_totalprice"))
    aligned = align.Aligner(spec).align(changes)
    merged = dml.upsert(orders.where("o_orderkey % 3 <> 0"), aligned.df, ["o_orderkey"])
    return merged.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# the queries of the other module register themselves here
from tessera import registry_load  # noqa: E402, F401
