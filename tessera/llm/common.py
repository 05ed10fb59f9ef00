"""What the operators share: sizes of inputs, cut lineage, and word hashes on Arrow buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Base of the polynomial word hash (odd, so that it has an inverse modulo 2**64).
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_tables = {"n": 0}
_written: dict[str, list[str]] = {}

#: A word of the contracts: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- lineage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset and Spark runs
    in this process alone. On a cluster it must be set."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        at = sc.getCheckpointDir()
    if not at:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Materialise a small frame in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back. Results that aren't computed yet need it: clear()
    deletes it when they are."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete what stored() wrote in this application; for when all results that were built on it are written. How many
    folders went."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def text_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes of a text column), from one scan."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, label, text): at most `rows` labelled documents, those of the smallest hash of the id, one row each.

    A null id or label is passed over. A doc_id that is labelled twice has the larger label; of rows that share a doc_id
    the text of the smallest hash counts, and a null text is empty.
    """
    i = F.col("doc_id").cast("long")
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(i.alias("_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    drawn = known.withColumn("_p", F.xxhash64("_id")).orderBy("_p", "_id").limit(rows).select("_id", "label")
    d = docs.select(i.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at most `rows` of two numbers go out; copies of an id meet in partial minima
    found = d.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.max("label").alias("label"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return found.select("doc_id", "label", F.col("t.text").alias("text"))


def pieces(total: int, each: int) -> int:
    """Into how many parts of about `each` units a total goes."""
    return max(1, -(-int(total) // each))


# ---------------------------------------------------------------- memory

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not glibc
    _trim = None


def give_back() -> None:
    """Return what this process has freed to the system. Python workers live on from stage to stage, and what one has
    kept for later counts as its executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


# ---------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit numbers."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _tables["n"] < n:
        size = max(n, 1 << 20)
        for name, base in (("pow", _BASE), ("inv", _INVERSE)):
            x = np.full(size, base, U)
            x[0] = 1
            _tables[name] = np.cumprod(x, dtype=U)
        _tables["n"] = size
    return _tables["pow"], _tables["inv"]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word, and where each text's words begin (one more than texts)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first[n] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the bytes' polynomial, and the factors that move a span of it to the front."""
    powers, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers[: len(data)], out=sums[1:])
    return sums, inverse


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever it stands."""
    sums, inverse = hash_sums(data)
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def parts(offsets: np.ndarray, size: int = 1 << 20):
    """Runs of whole texts (lo, hi) of at most `size` bytes each, or one longer text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, where each text's words begin) of a string column."""
    data, offsets = utf8(column)
    hashes, begins = [np.zeros(0, U)], [np.zeros(1, np.int64)]
    total = 0
    for lo, hi in parts(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        piece = data[offsets[lo] : offsets[hi]]
        s, e, w = spans(piece, own)
        hashes.append(hash_spans(piece, s, e))
        begins.append(w[1:] + total)
        total += len(s)
    return np.concatenate(hashes), np.concatenate(begins)


def rolling(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of each k words that follow one another; ends beyond the array are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, factor, step = np.zeros(n, U), U(1), U((2 * seed + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += words[j : j + n] * factor
            factor = factor * step
    return mix(out)


def ids_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(ids as int64 with 0 for null, which are not null)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    known = np.asarray(column.is_valid())
    return np.asarray(column.fill_null(0)).astype(np.int64), known
