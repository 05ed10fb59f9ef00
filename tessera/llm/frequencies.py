"""In how many documents words stand: counters of a fixed size, added up over all documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U, give_back, hash_spans, parts, spans, utf8
from tessera.session import ship

#: Words are counted by this many leading bits of their hash.
BITS = 18
_PARTS, _MERGED = 16, 128
#: Bytes with A-Z in lower case and ASCII punctuation as spaces.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
for _c in range(128):
    if not chr(_c).isalnum():
        FOLD[_c] = 32


def fold(column) -> tuple[np.ndarray, np.ndarray]:
    """A column's bytes with A-Z in lower case and ASCII punctuation as spaces, and the offsets."""
    data, offsets = utf8(column)
    return FOLD[data], offsets


def terms_of(words: np.ndarray) -> np.ndarray:
    return (words >> U(64 - BITS)).astype(np.int64)


def _count(also):
    def count(batches):
        own = also.value if also is not None else None
        counts, rows = np.zeros(1 << BITS, np.int64), 0
        more = np.zeros(len(own.terms) if own else 0, np.int64)
        for batch in batches:
            data, offsets = fold(batch.column("text"))
            rows += batch.num_rows
            for lo, hi in parts(offsets):
                piece = data[offsets[lo] : offsets[hi]]
                s, e, begins = spans(piece, offsets[lo : hi + 1] - offsets[lo])
                if len(s):
                    code = np.repeat(np.arange(hi - lo), np.diff(begins)) << BITS | terms_of(hash_spans(piece, s, e))
                    code.sort()
                    counts += np.bincount(code[np.r_[True, code[1:] != code[:-1]]] & ((1 << BITS) - 1), minlength=1 << BITS)
                    if own:
                        more += np.bincount(own.of(piece, s, e, begins)[1], minlength=len(more))
        if rows:
            pack = zstandard.ZstdCompressor(level=1).compress
            blobs = [pack(x.tobytes()) for x in (*np.split(counts, _PARTS), more)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS + 1), pa.int32()), pa.array([rows] * (_PARTS + 1), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "docs", "counts"])
        give_back()

    return count


def _merge(table: pa.Table) -> pa.Table:
    unpack, total = zstandard.ZstdDecompressor().decompress, 0
    for x in table["counts"]:
        total = total + np.frombuffer(unpack(x.as_py()), np.int64)
    pack = zstandard.ZstdCompressor(level=1).compress
    return pa.Table.from_arrays([table["part"][:1].combine_chunks(), pa.array([sum(table["docs"].to_pylist())], pa.int64()), pa.array([pack(total.tobytes())], pa.binary())], names=["part", "docs", "counts"])


def document_frequencies(docs: DataFrame, also=None) -> tuple[int, np.ndarray, np.ndarray]:
    """(documents, in how many of them each of 2**18 hashed words stands, the same for each of the terms of `also`).

    also: a broadcast with terms and of(data, starts, ends, begins) -> (row, place, count). Each task gives its counters
    once; they are added in two steps, at most 128 tasks' at a time. A fixed 2 MB comes to the driver.
    """
    ship(docs.sparkSession)
    kind = "part int, docs long, counts binary"
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count(also), kind)
    some = rows.withColumn("some", F.floor(F.spark_partition_id() / _MERGED)).groupBy("part", "some").applyInArrow(_merge, kind)
    got = some.groupBy("part").applyInArrow(_merge, kind).orderBy("part").collect()
    if not got:
        return 0, np.zeros(1 << BITS, np.int64), np.zeros(len(also.value.terms) if also is not None else 0, np.int64)
    unpack = zstandard.ZstdDecompressor().decompress
    counts = [np.frombuffer(unpack(r["counts"]), np.int64) for r in got]
    return got[0]["docs"], np.concatenate(counts[:_PARTS]), counts[_PARTS]
