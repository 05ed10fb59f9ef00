"""Finding, for keys that stand in many chunks of documents, which of them stand in an earlier document.

Documents are dealt into memory-sized chunks. A chunk sends each of its distinct keys once, with the smallest
document that has it, to the bucket of the key; so a key that a third of all documents hold costs a row's share per
chunk and no more. A bucket answers with one bit for each key and chunk, in the order in which they were sent.

Chunks and buckets grow in number with the input, and a row for each pair of them would in the end hold a key or none.
So a chunk sends at most GROUPS rows: where there are more buckets, a row holds a run of buckets, and a step between
takes as many chunks' rows for one run and deals them to its buckets. Answers go back the same way.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U
from tessera.session import ship

#: Text bytes of a chunk, and keys of a bucket.
CHUNK_BYTES = 6 << 20
BUCKET_KEYS = 1_000_000
#: Rows that a chunk sends at most, and chunks whose rows meet in a step between.
GROUPS = 4096
_BUNDLE = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("bundle", pa.binary())])
_BETWEEN = pa.schema([("s", pa.int64()), ("part", pa.int64()), ("bucket", pa.int64()), ("bundle", pa.binary())])
_BUNDLE_KIND, _BETWEEN_KIND = "chunk long, part long, bundle binary", "s long, part long, bucket long, bundle binary"

SENT = "chunk long, bucket long, keys binary, checks binary, who binary, extra binary"
ANSWER = "chunk long, bucket long, bits binary, extra binary"
_SENT = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()), ("who", pa.binary()), ("extra", pa.binary())])
_ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary()), ("extra", pa.binary())])


def chunked(docs: DataFrame, n_chunks: int, rest: list[str] | None = None) -> DataFrame:
    """doc_id, text and the chunk that both decide: rows of one id, or of none, don't all meet in one chunk.

    rest: further columns to go along, as fields f0, f1, ... of a column named rest.
    """
    ship(docs.sparkSession)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).alias("chunk")]
    if rest:
        columns.append(F.struct(*[docs[c].alias(f"f{k}") for k, c in enumerate(rest)]).alias("rest"))
    return docs.select(*columns)


def in_order(table: pa.Table) -> pa.Table:
    """The rows of a chunk, which a shuffle brings in any order, in one that a second run repeats."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def buckets_of(bucket: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, lo, hi) of each run of a sorted array."""
    if not n:
        return []
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


class Distinct:
    """The distinct keys of a chunk with the smallest document of each, in the order bucket, document, key."""

    def __init__(self, keys: np.ndarray, checks: np.ndarray, who: np.ndarray, n_buckets: int):
        by = np.argsort(keys, kind="stable")
        k = keys[by]
        first = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        least = np.minimum.reduceat(who[by], at) if len(at) else np.zeros(0, np.int64)
        uniq, check = k[at], checks[by][at]
        bucket = (uniq % U(n_buckets)).astype(np.int64)
        order = np.lexsort((uniq, least, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        #: For every key given, its place among the distinct ones.
        self.of = np.empty(len(keys), np.int64)
        self.of[by] = place[np.cumsum(first) - 1]
        self.keys, self.checks, self.least, self.bucket = uniq[order], check[order], least[order], bucket[order]
        self.runs = buckets_of(self.bucket, len(order))

    def rows(self, chunk: int, extra: dict[int, bytes] | None = None) -> pa.Table:
        """What is sent; extra: bytes that come back with the answer, by bucket."""
        extra = dict(extra or {})
        pack = zstandard.ZstdCompressor(level=1).compress
        out: list[tuple] = []
        for b, lo, hi in self.runs:
            out.append((chunk, b, self.keys[lo:hi].tobytes(), self.checks[lo:hi].tobytes(), pack(np.diff(self.least[lo:hi], prepend=0).tobytes()), extra.pop(b, None)))
        out += [(chunk, b, b"", b"", pack(b""), x) for b, x in extra.items()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SENT.types, strict=True)], schema=_SENT) if out else _SENT.empty_table()

    def answered(self, answer: pa.Table) -> np.ndarray:
        """The bits of a chunk's distinct keys."""
        bits = np.zeros(len(self.keys), bool)
        got = {b: x for b, x in zip(answer["bucket"].to_pylist(), answer["bits"].to_pylist(), strict=True) if x}
        for b, lo, hi in self.runs:
            bits[lo:hi] = np.unpackbits(np.frombuffer(got[b], np.uint8), count=hi - lo).view(bool)
        return bits


def answers(ties: bool):
    """For a bucket: is the key's smallest document elsewhere smaller than in this chunk? ties: where documents are equal, the later chunks count too."""

    def answer(table: pa.Table) -> pa.Table:
        n = table.num_rows
        unpack = zstandard.ZstdDecompressor().decompress
        keys = [np.frombuffer(x, U) for x in table["keys"].to_pylist()]
        size = np.array([len(x) for x in keys])
        who = np.concatenate([np.cumsum(np.frombuffer(unpack(x), np.int64)) for x in table["who"].to_pylist()])
        check = np.concatenate([np.frombuffer(x, np.uint32) for x in table["checks"].to_pylist()])
        keys = np.concatenate(keys)
        chunk = np.asarray(table["chunk"].combine_chunks() if table["chunk"].num_chunks != 1 else table["chunk"].chunk(0))
        by = np.argsort(keys, kind="stable")
        k, c = keys[by], check[by]
        if np.any((k[1:] == k[:-1]) & (c[1:] != c[:-1])):
            by = np.lexsort((check, keys))
            k, c = keys[by], check[by]
        late = np.zeros(len(keys), bool)
        if len(k):
            first = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
            group = np.cumsum(first) - 1
            w = who[by]
            least = np.minimum.reduceat(w, np.flatnonzero(first))[group]
            behind = w > least
            if ties:
                own = np.repeat(chunk, size)[by]
                tied = np.where(behind, np.iinfo(np.int64).max, own)
                behind |= own > np.minimum.reduceat(tied, np.flatnonzero(first))[group]
            late[by] = behind
        ends = np.cumsum(size)
        bits = [np.packbits(late[e - s : e]).tobytes() for s, e in zip(size, ends, strict=True)]
        return pa.Table.from_arrays([table["chunk"].combine_chunks(), table["bucket"].combine_chunks(), pa.array(bits, pa.binary()), table["extra"].combine_chunks()], schema=_ANSWER) if n else _ANSWER.empty_table()

    return answer


# ---------------------------------------------------------------- the way to the buckets and back


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else schema.empty_table()


def _tuples(table: pa.Table) -> list[tuple]:
    return list(zip(*[table[c].to_pylist() for c in table.column_names], strict=True))


class Way:
    """How rows (chunk, bucket, ...) of one schema reach their buckets, and rows of another their chunks again."""

    def __init__(self, n_buckets: int, out: pa.Schema, kind: str, back: pa.Schema, back_kind: str, groups: int = GROUPS):
        self.out, self.back, self.groups = out, back, groups
        self.direct = n_buckets <= groups
        self.run = -(-n_buckets // groups)
        self.kind, self.back_kind = (kind, back_kind) if self.direct else (_BUNDLE_KIND, _BUNDLE_KIND)

    def outbound(self, f: Callable, cogrouped: bool = False) -> Callable:
        """f gives rows for buckets, bucket by bucket; of more buckets than `groups` a run goes in one row."""
        if self.direct:
            return f
        run = self.run

        def bundled(rows: pa.Table) -> pa.Table:
            bundles: dict[tuple[int, int], list] = {}
            for chunk, bucket, *rest in _tuples(rows):
                bundles.setdefault((chunk, bucket // run), []).append((bucket, *rest))
            return _table([(c, p, pickle.dumps(x)) for (c, p), x in bundles.items()], _BUNDLE)

        def send(table: pa.Table) -> pa.Table:
            return bundled(f(table))

        def send_both(table: pa.Table, other: pa.Table) -> pa.Table:
            return bundled(f(table, other))

        return send_both if cogrouped else send

    def inbound(self, f: Callable) -> Callable:
        """f takes a chunk's documents and the rows that came back for it."""
        if self.direct:
            return f
        back = self.back

        def receive(documents: pa.Table, bundles: pa.Table) -> pa.Table:
            rows = [(chunk, *x) for chunk, _, bundle in _tuples(bundles) for x in pickle.loads(bundle)]
            return f(documents, _table(rows, back))

        return receive

    def meet(self, sent: DataFrame, kernel: Callable) -> DataFrame:
        """What kernel answers to the rows of each bucket, by chunk."""
        if self.direct:
            return sent.groupBy("bucket").applyInArrow(kernel, self.back_kind)
        groups, run, out = self.groups, self.run, self.out

        def to_buckets(table: pa.Table) -> pa.Table:
            s, part = table["s"][0].as_py(), table["part"][0].as_py()
            found: dict[int, list] = {}
            for chunk, bundle in zip(table["chunk"].to_pylist(), table["bundle"].to_pylist(), strict=True):
                for bucket, *rest in pickle.loads(bundle):
                    found.setdefault(bucket, []).append((chunk, *rest))
            return _table([(s, part, b, pickle.dumps(x)) for b, x in found.items()], _BETWEEN)

        def answer(table: pa.Table) -> pa.Table:
            bucket = table["bucket"][0].as_py()
            rows = [(chunk, bucket, *rest) for bundle in table["bundle"] for chunk, *rest in pickle.loads(bundle.as_py())]
            found: dict[int, list] = {}
            for chunk, _, *rest in _tuples(kernel(_table(rows, out))):
                found.setdefault(chunk // groups, []).append((chunk, *rest))
            return _table([(s, bucket // run, bucket, pickle.dumps(x)) for s, x in found.items()], _BETWEEN)

        def to_chunks(table: pa.Table) -> pa.Table:
            part = table["part"][0].as_py()
            found: dict[int, list] = {}
            for bucket, bundle in zip(table["bucket"].to_pylist(), table["bundle"].to_pylist(), strict=True):
                for chunk, *rest in pickle.loads(bundle):
                    found.setdefault(chunk, []).append((bucket, *rest))
            return _table([(c, part, pickle.dumps(x)) for c, x in found.items()], _BUNDLE)

        some = sent.withColumn("s", F.expr(f"chunk div {groups}"))
        dealt = some.groupBy("s", "part").applyInArrow(to_buckets, _BETWEEN_KIND)
        met = dealt.groupBy("bucket").applyInArrow(answer, _BETWEEN_KIND)
        return met.groupBy("s", "part").applyInArrow(to_chunks, _BUNDLE_KIND)


def way_of_keys(n_buckets: int, groups: int = GROUPS) -> Way:
    """For the rows of Distinct and their answers."""
    return Way(n_buckets, _SENT, SENT, _ANSWER, ANSWER, groups)
