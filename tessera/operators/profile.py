"""Profiles of columns, keys derived from them, and samples of the two ends."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.casting import to_time
from tessera.plans.predicate import resolve

PROFILE = "column_name string, data_type string, is_categorical boolean, all_unique boolean, is_datetime boolean, null_count long, non_null_count long, null_pct double, distinct_count long"


def _distinct_counts(df: DataFrame, columns: list[str], approximate: bool) -> dict[str, int]:
    """Distinct values of each column.

    Several exact distinct counts in one aggregation would multiply every row by the number of columns in one shuffle of
    whole values; 64-bit hashes are counted instead, column by column, after a partial distinct on the map side. That is
    exact as long as no two values of a column share a hash: beyond some 10^9 distinct values a few will, and the count
    falls short by about n^2 / 2^65.
    """
    if not columns:
        return {}
    if approximate:
        row = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(str(k)) for k, c in enumerate(columns)]).first()
        return {c: row[str(k)] for k, c in enumerate(columns)}
    hashed = [f"xxhash64({f'to_json(`{c}`)' if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) else f'`{c}`'})" for c in columns]
    pairs = ", ".join(f"{k}, case when `{c}` is not null then {h} end" for k, (c, h) in enumerate(zip(columns, hashed, strict=True)))
    rows = df.selectExpr(f"stack({len(columns)}, {pairs}) as (k, h)").where("h is not null").distinct().groupBy("k").count().collect()
    found = {r["k"]: r["count"] for r in rows}
    return {c: found.get(k, 0) for k, c in enumerate(columns)}


def profile(df: DataFrame, approximate: bool = False, detect_times: bool = True) -> DataFrame:
    """One row per column: its type, whether it is categorical (a tenth distinct or less), all unique (nulls aside) or a
    time (by type, or text that all parses), its nulls, their share in per cent, and its distinct values.

    Two aggregations over the whole frame, however many columns; an empty frame gives no rows.
    """
    spark, names = df.sparkSession, df.columns
    if not names:
        return spark.createDataFrame([], PROFILE)
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)] if detect_times else []
    exprs = [F.count(F.lit(1)).alias("n")] + [F.count(F.col(f"`{c}`")).alias(f"v{k}") for k, c in enumerate(names)]
    exprs += [F.count_if(F.col(f"`{c}`").isNotNull() & to_time(F.col(f"`{c}`")).isNull()).alias(f"t_{k}") for k, c in enumerate(names) if c in text]
    row = df.agg(*exprs).first()
    if not row["n"]:
        return spark.createDataFrame([], PROFILE)
    distinct = _distinct_counts(df, names, approximate)
    out = []
    for k, f in enumerate(df.schema):
        full, d = row[f"v{k}"], distinct[f.name]
        time = isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) or f.name in text and full > 0 and row[f"t_{k}"] == 0
        out.append((f.name, f.dataType.simpleString(), bool(full and d / full <= 0.1), bool(full and d == full), bool(time), row["n"] - full, full, round((row["n"] - full) / row["n"] * 100, 2), d))
    return spark.createDataFrame(out, PROFILE)


def uniqueness(profiled: DataFrame) -> DataFrame:
    """The profile with the share of distinct values among those that aren't null, 0 where all are."""
    return profiled.withColumn("uniqueness_ratio", F.when(F.col("non_null_count") > 0, F.col("distinct_count") / F.col("non_null_count")).otherwise(F.lit(0.0)))


@dataclass
class Key:
    columns: list[str]
    is_unique: bool
    warnings: list[str] = field(default_factory=list)


def derive_key(df: DataFrame, profiled: DataFrame | None = None, threshold: float = 0.8, most: int = 5) -> Key:
    """A key: the first column that is unique and without nulls, else the shortest prefix of candidates that is unique.

    Candidates are columns whose distinct share reaches the threshold, the largest first, then by name; the first is
    followed by the first time column. All prefixes are counted in one aggregation, of rows without nulls in them.
    """
    rows = uniqueness(profiled if profiled is not None else profile(df)).collect()
    if not rows:
        raise ValueError("an empty frame has no key")
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    order = {c: k for k, c in enumerate(df.columns)}
    rows.sort(key=lambda r: order[r["column_name"]])
    if single := next((r["column_name"] for r in rows if r["all_unique"] and not r["null_count"]), None):
        return Key([single], True)
    ranked = [r["column_name"] for r in sorted(rows, key=lambda r: (-r["uniqueness_ratio"], r["column_name"])) if r["uniqueness_ratio"] >= threshold and r["non_null_count"]]
    warnings = [] if ranked else ["no column is distinct enough; the first one begins the key"]
    chain = ranked[:1] or [rows[0]["column_name"]]
    chain += [t for t in [r["column_name"] for r in rows if r["is_datetime"]][:1] if t not in chain]
    chain += [c for c in ranked if c not in chain]
    chain = chain[:most]
    exprs = []
    for k in range(1, len(chain) + 1):
        parts = [F.col(f"`{c}`") for c in chain[:k]]
        whole = F.lit(True)
        for p in parts:
            whole = whole & p.isNotNull()
        exprs += [F.count_if(whole).alias(f"n{k}"), F.count_distinct(F.when(whole, F.struct(*parts))).alias(f"d{k}")]
    row = df.agg(*exprs).first()
    for k in range(1, len(chain) + 1):
        if row[f"n{k}"] and row[f"n{k}"] == row[f"d{k}"]:
            return Key(chain[:k], True, warnings)
    return Key(chain, False, [*warnings, "the key is not unique"])


def duplicates(df: DataFrame, key: list[str], count: str = "n") -> DataFrame:
    """Key values that stand in more than one row, with their number of rows."""
    return df.groupBy(*[F.col(f"`{c}`") for c in key]).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1)


def is_unique(df: DataFrame, key: list[str]) -> bool:
    return not duplicates(df, key).limit(1).count()


def decide_key(df: DataFrame, asked, table_key: list[str] | None = None) -> list[str]:
    """The key by policy: 'derive' or 'verify' takes the table's if all its columns are there, else derives one; names
    are checked for being there and unique; nothing asked is no key."""
    if not asked:
        return []
    if asked in ("derive", "verify"):
        own = [resolve(c, df.columns) for c in table_key or []]
        return own if own and None not in own else derive_key(df).columns
    names = [asked] if isinstance(asked, str) else list(asked)
    own = [resolve(c, df.columns) for c in names]
    if None in own:
        raise ValueError(f"there is no column {', '.join(n for n, o in zip(names, own, strict=True) if o is None)}")
    if not is_unique(df, own):
        raise ValueError(f"{', '.join(own)} is not unique")
    return own


def composite(columns: list[str], by: str = "|") -> Column:
    """A key as one text; the separator and backslashes in values are escaped. Null where a part is."""
    parts = [F.replace(F.replace(F.col(f"`{c}`").cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit(by), F.lit("\\" + by)) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit(by), p)
    return out


def head_tail(df: DataFrame, order_by: list[str], percent: float = 5, drop_nulls: bool = True) -> DataFrame:
    """The first and last percent/2 of the rows by an order (one at least on each side), without repeated rows.

    Two bounded sorts (each keeps its n rows per partition) rather than a numbering of all rows.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent lies between 0 and 100")
    own = df.dropna("any") if drop_nulls else df
    n = max(1, int(own.count() * percent / 200))
    cols = [F.col(f"`{c}`") for c in order_by]
    return own.orderBy(*[c.asc() for c in cols]).limit(n).unionAll(own.orderBy(*[c.desc() for c in cols]).limit(n)).distinct()


def series_ends(df: DataFrame, column: str, order_by: list[str], percent: float = 5) -> tuple[DataFrame, DataFrame]:
    """The first and the last percent of a column's values by an order (one at least): two bounded sorts."""
    n = max(1, int(df.count() * percent / 100))
    cols = [F.col(f"`{c}`") for c in order_by]
    return tuple(df.orderBy(*[c.asc() if up else c.desc() for c in cols]).limit(n).select(F.col(f"`{column}`")) for up in (True, False))


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows that a seeded hash of the row decides, the same in each run."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])).limit(n)


def stratified_sample(df: DataFrame, by: str, n: int, strata: int = 5, seed: int = 42) -> DataFrame:
    """n rows, as many from each of `strata` ranges of a numeric column that hold equal numbers of rows; a seeded hash of
    the row decides within a range. Bounded sorts, one for each range; rows with a null in `by` belong to the first."""
    from tessera.functions.outliers import quantiles

    cuts = [q for q in quantiles(df, [by], [k / strata for k in range(1, strata)])[by] if q is not None]
    at = F.lit(0)
    for q in cuts:
        at = at + F.coalesce((F.col(f"`{by}`") > q).cast("int"), F.lit(0))
    order, out = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]), None
    for k in range(strata):
        most = n // strata + (k < n % strata)
        one = df.withColumn("stratum", at).where(F.col("stratum") == k).orderBy(order).limit(most)
        out = one if out is None else out.unionAll(one)
    return out


def numbered_rows(df: DataFrame, order_by: list[str], name: str = "_seq", partition_by: list[str] | None = None) -> DataFrame:
    """Rows numbered from 1 by an order (within groups, if there are any)."""
    w = Window.partitionBy(*(partition_by or [])).orderBy(*[F.col(f"`{c}`") for c in order_by])
    return df.withColumn(name, F.row_number().over(w))
