"""Outliers by z-score or interquartile range: bounds from one aggregation, applied in a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_ROWS = 10


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def quantiles(df: DataFrame, columns: list[str], shares: list[float], enough: int = 20_000) -> dict[str, list[float | None]]:
    """Exact quantiles, interpolated between neighbours, of all columns at once; nulls and NaN are passed over.

    Spark's own exact percentile gathers every distinct value in one task. Here a sketch brackets each quantile, and a
    count tells how many values lie below and within; brackets shrink ten-thousandfold by pass, until the values within
    are few. Only those come together, `enough` of distinct ones at most.
    """
    v = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in columns}
    row = df.agg(*[F.count(v[c]).alias(f"n{k}") for k, c in enumerate(columns)]).first()
    n = {c: row[f"n{k}"] for k, c in enumerate(columns)}
    # (low, high, values below low, values within), all bounds included
    state = {(c, p): (float("-inf"), float("inf"), 0, n[c]) for c in columns for p in shares if n[c]}
    goal = {key: key[1] * (n[key[0]] - 1) for key in state}
    ranks = lambda key: (int(goal[key]), min(int(goal[key]) + 1, n[key[0]] - 1))
    inside = lambda key: v[key[0]].between(state[key][0], state[key][1])
    while todo := [k for k, (lo, hi, _, m) in state.items() if m > enough and lo < hi]:
        exprs = []
        for i, key in enumerate(todo):
            below, m = state[key][2:]
            at, slack = (goal[key] - below) / m, 2.0 / 10_000
            exprs.append(F.percentile_approx(F.when(inside(key), v[key[0]]), [max(0.0, at - slack), min(1.0, at + slack)], 10_000).alias(f"q{i}"))
        got = df.agg(*exprs).first()
        exprs = []
        for i, key in enumerate(todo):
            lo, hi = got[f"q{i}"]
            exprs += [F.count_if(v[key[0]] < lo).alias(f"b{i}"), F.count_if(v[key[0]].between(lo, hi)).alias(f"m{i}")]
        counted = df.agg(*exprs).first()
        for i, key in enumerate(todo):
            lo, hi = got[f"q{i}"]
            below, m = counted[f"b{i}"], counted[f"m{i}"]
            # a sketch may err; a bracket that misses its ranks, or doesn't shrink, is given up for its halves by value
            first, last = ranks(key)
            if below <= first and below + m > last and m < state[key][3]:
                state[key] = (lo, hi, below, m)
            else:
                state[key] = _halved(df, v[key[0]], state[key], first, last)
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    for key, (lo, hi, below, _) in state.items():
        values = [(lo, n[key[0]])] if lo == hi else [(r["x"], r["c"]) for r in df.where(inside(key)).groupBy(v[key[0]].alias("x")).agg(F.count(F.lit(1)).alias("c")).orderBy("x").collect()]
        at, picked = below, {}
        for x, c in values:
            for r in ranks(key):
                if at <= r < at + c or lo == hi:
                    picked[r] = x
            at += c
        a = picked[int(goal[key])]
        b = picked.get(int(goal[key]) + 1, a)
        out[key[0]][shares.index(key[1])] = a + (b - a) * (goal[key] - int(goal[key]))
    return out


def _halved(df: DataFrame, v: Column, state: tuple[float, float, int, int], first: int, last: int) -> tuple[float, float, int, int]:
    """The part of a bracket that holds the ranks first and last, cut at the middle of its values (or it whole, as one value)."""
    lo, hi, below, m = state
    r = df.where(v.between(lo, hi)).agg(F.min(v).alias("a"), F.max(v).alias("b")).first()
    if r["a"] == r["b"]:
        return r["a"], r["b"], below, m
    mid = r["a"] + (r["b"] - r["a"]) / 2
    c = df.where(v.between(lo, hi)).agg(F.count_if(v <= mid).alias("low"), F.max(F.when(v <= mid, v)).alias("x"), F.min(F.when(v > mid, v)).alias("y")).first()
    if last < below + c["low"]:
        return r["a"], c["x"], below, c["low"]
    if first >= below + c["low"]:
        return c["y"], r["b"], below + c["low"], m - c["low"]
    # the two ranks stand on either side of the cut: of all values within, these two remain, however often they stand
    left = df.where(v == c["x"]).count()
    return c["x"], c["y"], below + c["low"] - left, 0


def bounds(df: DataFrame, columns: list[str] | None = None, method: str = "iqr", factor: float = 1.5, z: float = 3.0, exact: bool = True, ddof: int = 1) -> dict[str, tuple[float, float] | None]:
    """(low, high) of each column; None where there are under ten values or no spread, so that nothing is an outlier.

    exact: interpolated quantiles, in a few passes; else one pass of percentile_approx. ddof: 1 takes the deviation of a
    sample, 0 that of a population.
    """
    columns = columns or numeric(df)
    if not columns:
        return {}
    if method not in ("iqr", "zscore"):
        raise ValueError(f"method {method!r} is neither iqr nor zscore")
    exprs = []
    for k, c in enumerate(columns):
        v = F.col(f"`{c}`").cast("double")
        v = F.when(~F.isnan(v), v)
        exprs.append(F.count(v).alias(f"n{k}"))
        if method == "zscore":
            exprs += [F.avg(v).alias(f"a{k}"), (F.stddev_samp(v) if ddof else F.stddev_pop(v)).alias(f"b{k}")]
        elif not exact:
            exprs += [F.percentile_approx(v, 0.25, 10_000).alias(f"a{k}"), F.percentile_approx(v, 0.75, 10_000).alias(f"b{k}")]
    if method == "iqr" and exact:
        found = quantiles(df, columns, [0.25, 0.75])
    row = df.agg(*exprs).first()
    out: dict[str, tuple[float, float] | None] = {}
    for k, c in enumerate(columns):
        a, b = found[c] if method == "iqr" and exact else (row[f"a{k}"], row[f"b{k}"])
        out[c] = None
        if row[f"n{k}"] >= LEAST_ROWS and a is not None and b is not None:
            if method == "iqr" and b > a:
                out[c] = a - factor * (b - a), b + factor * (b - a)
            elif method == "zscore" and b > 0:
                out[c] = a - z * b, a + z * b
    return out


def is_outlier(c: Column, bound: tuple[float, float] | None) -> Column:
    """False for nulls, and everywhere where there are no bounds."""
    if bound is None:
        return F.lit(False)
    return F.coalesce((c < bound[0]) | (c > bound[1]), F.lit(False))


def keep_mask(df: DataFrame, columns: list[str] | None = None, name: str = "keep", drop_nulls: bool = False, **how) -> DataFrame:
    """A boolean column that is false where any column is an outlier (with drop_nulls, or null)."""
    columns = columns or numeric(df)
    b = bounds(df, columns, **how)
    ok = F.lit(True)
    for c in columns:
        v = F.col(f"`{c}`")
        ok = ok & ~is_outlier(v, b[c]) & (v.isNotNull() if drop_nulls else F.lit(True))
    return df.withColumn(name, ok)


def replace_outliers(df: DataFrame, columns: list[str] | None = None, value: float | None = 0, nulls_too: bool = True, **how) -> DataFrame:
    """Outliers (and, with nulls_too, nulls) replaced by a value; None makes them null."""
    columns = columns or numeric(df)
    b = bounds(df, columns, **how)
    new = {}
    for c in columns:
        v, kind = F.col(f"`{c}`"), df.schema[c].dataType
        bad = is_outlier(v, b[c]) | (v.isNull() if nulls_too and value is not None else F.lit(False))
        new[c] = F.when(bad, F.lit(value).cast(kind)).otherwise(v)
    return df.withColumns(new)
