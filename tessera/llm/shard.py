"""Dealing records into shards in a random order: a two-pass external shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, pieces, text_bytes
from tessera.session import ship

BUCKET_BYTES = 8 << 20
#: A bucket of so many times the usual rows holds rows that repeat in all columns.
_CROWDED = 8
_GROUP = 4096


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of 0..n-1 (Fisher-Yates, as numpy's generator does it) that seed and bucket decide."""
    return np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFF, bucket])).permutation(n)


def _shuffled(seed: int, rows: int, shards: int):
    def shuffle(table: pa.Table, begin: pa.Table) -> pa.Table:
        keep = table.column_names[:-4]
        if not table.num_rows:
            empty = table.select(keep)
            return empty.append_column("shard", pa.array([], pa.int32())).append_column("slot", pa.array([], pa.int64()))
        bucket = table["_bucket"][0].as_py()
        # the order in which a shuffle brings rows isn't fixed; their two hashes' is, but for equal rows
        order = np.lexsort([np.asarray(table[c].combine_chunks()) for c in ("_tie", "_key")])
        order = np.repeat(order, np.asarray(table["_times"].combine_chunks())[order])
        at = begin["_begin"][0].as_py() + np.arange(len(order))
        out = table.select(keep).take(order[fisher_yates(len(order), seed, bucket)])
        shard = at * shards // rows
        return out.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(at - (shard * rows + shards - 1) // shards))

    return shuffle


def _begins(counts: DataFrame) -> DataFrame:
    """Where each bucket begins; added up in groups, so that no task sorts all buckets."""
    count = counts.withColumn("g", F.expr(f"_bucket div {_GROUP}"))
    groups = count.groupBy("g").agg(F.sum("n").alias("gn"))
    before = groups.select("g", (F.sum("gn").over(Window.orderBy("g")) - F.col("gn")).alias("gb"))
    return count.withColumn("b", F.sum("n").over(Window.partitionBy("g").orderBy("_bucket")) - F.col("n")).join(before, "g").select("_bucket", (F.col("b") + F.col("gb")).alias("_begin"))


def _spread(dealt: DataFrame, counts: DataFrame, usual: int, bucket) -> DataFrame:
    """Rows that repeat in all columns so often that they crowd a bucket, as rows of `usual` copies each in many buckets."""
    crowded = counts.where(F.col("n") > _CROWDED * usual).select("_bucket")
    often = cut(dealt.join(crowded, "_bucket", "left_semi").groupBy("_key", "_tie").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > usual))
    own = [c for c in dealt.columns if c not in ("_key", "_tie", "_bucket", "_times")]
    # equal rows are one row with a number; any of them stands for all
    one = dealt.join(often, ["_key", "_tie"], "left_semi").groupBy("_key", "_tie").agg(F.first(F.struct(*own)).alias("row"), F.count(F.lit(1)).alias("n"))
    part = one.select("row.*", "_key", "_tie", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {usual}"))).alias("part"))
    part = part.withColumns({"_bucket": bucket(F.col("part")), "_times": F.least(F.lit(usual), F.col("n") - F.col("part") * usual).cast("long")})
    return dealt.join(often, ["_key", "_tie"], "left_anti").unionByName(part.drop("n", "part")).select(dealt.columns)


def shuffle_shards(docs: DataFrame, shards: int = 24, seed: int = 7, bucket_bytes: int = BUCKET_BYTES, text: str = "text") -> DataFrame:
    """All columns of docs, with shard (from 0) and slot (gapless from 0 in each shard); counts differ by one at most.

    Buckets of about `bucket_bytes` are counted first, from hashes alone. Pass one scatters whole records into them by a
    seeded hash of the whole record, so no key, source or group of copies makes a bucket large; rows equal in every
    column, where they crowd a bucket, go as one row with a number to many. Pass two shuffles each bucket in memory and
    gives each row its shard and slot, as it knows where its bucket begins. The buckets in a row are the new order; it is
    cut into shards of equal counts. Input columns named shard, slot or like the inner ones (_bucket, _key, _tie, _times)
    are renamed with a leading "in_", as often as needed. Nulls in any column are values like others. No rows give no
    rows.
    """
    ship(docs.sparkSession)
    own, names = {"shard", "slot", "_bucket", "_key", "_tie", "_times"}, []
    for c in docs.columns:
        taken = own | {x.lower() for x in docs.columns if x != c} | {x.lower() for x in names}
        new = c
        while new.lower() in own or (new != c and new.lower() in taken):
            new = f"in_{new}"
        names.append(new)
    docs = docs.toDF(*names)
    rows, size = text_bytes(docs, text)
    n_buckets = pieces(size + 64 * rows, bucket_bytes)
    key = [F.coalesce(F.to_json(c), F.lit("")) if t.startswith(("map", "variant")) else F.col(c) for c, t in docs.dtypes]

    def bucket(part=None):
        return F.pmod(F.xxhash64(F.lit(seed + 2), "_key", *([] if part is None else [part])), F.lit(n_buckets))

    dealt = docs.withColumns({"_key": F.xxhash64(F.lit(seed), *key), "_tie": F.xxhash64(F.lit(seed + 1), *key), "_times": F.lit(1).cast("long")}).withColumn("_bucket", bucket())
    dealt = dealt.select(*names, "_key", "_tie", "_times", "_bucket")

    def counted(df: DataFrame) -> DataFrame:
        return cut(df.groupBy("_bucket").agg(F.sum("_times").alias("n")))

    counts, usual = counted(dealt), pieces(rows, n_buckets)
    if counts.where(F.col("n") > _CROWDED * usual).limit(1).count():
        dealt = _spread(dealt, counts, usual, bucket)
        counts = counted(dealt)
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return dealt.groupBy("_bucket").cogroup(_begins(counts).groupBy("_bucket")).applyInArrow(_shuffled(seed, max(rows, 1), shards), schema)


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = 7, text: str = "text") -> DataFrame:
    """The shards as Parquet, a folder `shard=k` for each; read back."""
    shuffle_shards(docs, shards, seed, text=text).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
