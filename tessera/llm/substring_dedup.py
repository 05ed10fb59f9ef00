"""Removing word runs that an earlier document has: fixed-block anchors, extended to exact repeats.

1. Each document is an index and a probe at once: the index has its non-overlapping blocks of 7 words (at words 0, 7,
   14, ...), the probe every rolling window of 7 words. Any run of 13 words holds a whole block of the document that it
   stands in, so two documents that share a run meet in an anchor: a block of the one that is a window of the other.
2. Anchors are extended to all runs of 13 words around them. Runs are compared by 96 bits of two hashes; one that
   starts in a document with a smaller id is covered. Overlapping covered runs merge into maximal repeats.

Anchors are sought by hashes cut to 46 bits and the bucket; that can only let more runs reach the exact step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import firsts
from tessera.llm.common import U, ids_of, pieces, rolling, text_bytes, utf8, word_hashes

WINDOW = 13
_ANCHORS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("entries", pa.binary())])
_HITS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])


class Chunk:
    """A chunk's documents: words, windows and the documents they belong to."""

    def __init__(self, table: pa.Table, window: int):
        self.table = firsts.in_order(table)
        self.words, self.begins = word_hashes(self.table["text"])
        self.n_words = np.diff(self.begins)
        self.doc, self.known = ids_of(self.table["doc_id"])
        self.window, self.block = window, (window + 1) // 2
        self.row = np.repeat(np.arange(len(self.n_words)), self.n_words)
        self.at = np.arange(len(self.words)) - np.repeat(self.begins[:-1], self.n_words)

    def runs(self, k: int) -> np.ndarray:
        """Which words begin a run of k words in a document of `window` words or more and of known id."""
        left = np.repeat(self.n_words, self.n_words) - self.at
        return np.flatnonzero((left >= k) & np.repeat((self.n_words >= self.window) & self.known, self.n_words))


def _anchors(chunk: Chunk, n_buckets: int):
    """Where windows of a block's length begin; their distinct codes (bucket, then key); which are blocks, and which in two documents."""
    where = chunk.runs(chunk.block)
    h = rolling(chunk.words, chunk.block, 1)[where]
    bits = min(46, 62 - int(n_buckets).bit_length())
    code = (h % U(n_buckets)) << U(bits) | (h // U(n_buckets)) & U((1 << bits) - 1)
    by = np.argsort(code)
    c = code[by]
    first = np.r_[True, c[1:] != c[:-1]] if len(c) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    of = np.empty(len(code), np.int64)
    of[by] = np.cumsum(first) - 1
    if not len(at):
        none = np.zeros(0, bool)
        return where, of, c, none, none, bits
    block = np.logical_or.reduceat((chunk.at[where] % chunk.block == 0)[by], at)
    doc = chunk.doc[chunk.row[where]][by]
    two = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
    return where, of, c[at], block, two, bits


def _send_anchors(window: int, n_buckets: int):
    def send(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        number = table["chunk"][0].as_py()
        _, _, code, block, two, bits = _anchors(chunk, n_buckets)
        entry = (code & U((1 << bits) - 1)) << U(2) | block.astype(U) << U(1) | two.astype(U)
        # 48 bits hold the key and both marks
        packed = entry.view(np.uint8).reshape(-1, 8)[:, :6]
        runs = firsts.buckets_of((code >> U(bits)).astype(np.int64), len(code))
        return pa.Table.from_arrays([pa.array([number] * len(runs), pa.int64()), pa.array([b for b, _, _ in runs], pa.int64()), pa.array([packed[lo:hi].tobytes() for _, lo, hi in runs], pa.binary())], schema=_ANCHORS)

    return send


def _match_anchors(table: pa.Table) -> pa.Table:
    """A bit for each entry: some other document has the window, and one has it as a block."""
    raw = [np.frombuffer(x, np.uint8).reshape(-1, 6) for x in table["entries"].to_pylist()]
    size = np.array([len(x) for x in raw])
    entry = np.zeros((int(size.sum()), 8), np.uint8)
    entry[:, :6] = np.concatenate(raw)
    entry = entry.view(U).ravel()
    key = entry >> U(2)
    by = np.argsort(key)
    k, e = key[by], entry[by]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    count = np.diff(np.r_[at, len(k)])
    marks = np.bitwise_or.reduceat(e, at)
    hit = ((count > 1) | (marks & U(1)).astype(bool)) & (marks & U(2)).astype(bool)
    bit = np.empty(len(key), bool)
    bit[by] = np.repeat(hit, count)
    ends = np.cumsum(size)
    return pa.Table.from_arrays([table["chunk"].combine_chunks(), table["bucket"].combine_chunks(), pa.array([np.packbits(bit[b - a : b]).tobytes() for a, b in zip(size, ends, strict=True)], pa.binary())], schema=_HITS)


def _candidates(chunk: Chunk, hits: dict[int, bytes], n_anchor_buckets: int, n_buckets: int):
    """Where runs of `window` words around an anchor begin, and their distinct keys."""
    where, of, code, _, _, bits = _anchors(chunk, n_anchor_buckets)
    hit = np.zeros(len(code), bool)
    for b, lo, hi in firsts.buckets_of((code >> U(bits)).astype(np.int64), len(code)):
        hit[lo:hi] = np.unpackbits(np.frombuffer(hits[b], np.uint8), count=hi - lo).view(bool)
    count = np.zeros(len(chunk.words) + 1, np.int64)
    count[where + 1] = hit[of]
    np.cumsum(count, out=count)
    starts = chunk.runs(chunk.window)
    starts = starts[count[starts + chunk.window - chunk.block + 1] > count[starts]]
    keys = rolling(chunk.words, chunk.window, 2)[starts]
    checks = (rolling(chunk.words, chunk.window, 3)[starts] >> U(32)).astype(np.uint32)
    return starts, firsts.Distinct(keys, checks, chunk.doc[chunk.row[starts]], n_buckets)


def _send_runs(window: int, n_anchor_buckets: int, n_buckets: int):
    def send(table: pa.Table, hits: pa.Table) -> pa.Table:
        if not table.num_rows:
            return firsts._SENT.empty_table()
        number = table["chunk"][0].as_py()
        bits = dict(zip(hits["bucket"].to_pylist(), hits["bits"].to_pylist(), strict=True))
        _, distinct = _candidates(Chunk(table, window), bits, n_anchor_buckets, n_buckets)
        back: dict[int, list] = {}
        for b, x in bits.items():
            back.setdefault(b % n_buckets, []).append(b.to_bytes(8, "little") + len(x).to_bytes(8, "little") + x)
        return distinct.rows(number, {b: b"".join(x) for b, x in back.items()})

    return send


def _unpacked(extra: list[bytes | None]) -> dict[int, bytes]:
    out = {}
    for x in extra:
        at = 0
        while x and at < len(x):
            b, n = int.from_bytes(x[at : at + 8], "little"), int.from_bytes(x[at + 8 : at + 16], "little")
            out[b] = x[at + 16 : at + 16 + n]
            at += 16 + n
    return out


def kept_texts(column, begins: np.ndarray, covered: np.ndarray) -> list[str]:
    """Each text's words that aren't covered, joined by one space."""
    data, offsets = utf8(column)
    whole = data.tobytes()
    out = []
    for i in range(len(offsets) - 1):
        words = whole[offsets[i] : offsets[i + 1]].split()
        gone = covered[begins[i] : begins[i + 1]]
        if gone.any():
            words = [words[j] for j in np.flatnonzero(~gone)]
        out.append(b" ".join(words).decode())
    return out


def covered_words(n: int, starts: np.ndarray, late: np.ndarray, window: int) -> np.ndarray:
    """Words under any of the runs that begin at starts[late]."""
    edge = np.zeros(n + 1, np.int64)
    gone = starts[late]
    edge[gone] += 1
    edge[gone + window] -= 1
    return np.cumsum(edge)[:n] > 0


def _finish(window: int, n_anchor_buckets: int, n_buckets: int):
    schema = pa.schema([("doc_id", pa.int64()), ("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def finish(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        chunk = Chunk(table, window)
        starts, distinct = _candidates(chunk, _unpacked(answer["extra"].to_pylist()), n_anchor_buckets, n_buckets)
        late = distinct.answered(answer)[distinct.of] | (chunk.doc[chunk.row[starts]] > distinct.least[distinct.of])
        covered = covered_words(len(chunk.words), starts, late, window)
        sums = np.r_[0, np.cumsum(covered)]
        removed = sums[chunk.begins[1:]] - sums[chunk.begins[:-1]]
        # a document's maximal runs of covered words, counted from its first word
        opens = np.flatnonzero(covered & np.r_[True, ~covered[:-1] | (chunk.row[1:] != chunk.row[:-1])]) if len(covered) else np.zeros(0, np.int64)
        closes = np.flatnonzero(covered & np.r_[~covered[1:] | (chunk.row[1:] != chunk.row[:-1]), True]) + 1 if len(covered) else opens
        of = np.searchsorted(opens, chunk.begins).astype(np.int32)
        base = chunk.begins[:-1][chunk.row[opens]] if len(opens) else opens
        spans = pa.ListArray.from_arrays(pa.array(of), pa.StructArray.from_arrays([pa.array(opens - base, pa.int64()), pa.array(closes - base, pa.int64())], ["start", "end"]))
        return pa.Table.from_arrays([chunk.table["doc_id"].combine_chunks(), pa.array(kept_texts(chunk.table["text"], chunk.begins, covered), pa.string()), pa.array(chunk.n_words, pa.int64()), pa.array(removed, pa.int64()), spans], schema=schema)

    return finish


def substring_dedup(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = firsts.CHUNK_BYTES, bucket_keys: int = firsts.BUCKET_KEYS, groups: int = firsts.GROUPS) -> DataFrame:
    """One row per document: doc_id, kept_text, n_words, n_removed, removed_spans (word positions, end excluded).

    Only doc_id and text are read; other columns, whatever their names, are passed over. A null text has no words, a
    document of fewer than `window` words no windows. A null doc_id is neither earlier nor later than any other: such
    a row stays as it is. Rows that share a doc_id don't count as earlier than one another. No rows give no rows.
    """
    _, size = text_bytes(docs)
    n_chunks = pieces(size, chunk_bytes)
    n_anchor = pieces(size // 6, 3 * bucket_keys // 2)
    n_runs = pieces(size // 6, 3 * bucket_keys)
    dealt = firsts.chunked(docs, n_chunks)
    by_anchor = firsts.Way(n_anchor, _ANCHORS, "chunk long, bucket long, entries binary", _HITS, "chunk long, bucket long, bits binary", groups)
    by_run = firsts.way_of_keys(n_runs, groups)
    anchors = dealt.groupBy("chunk").applyInArrow(by_anchor.outbound(_send_anchors(window, n_anchor)), by_anchor.kind)
    hits = by_anchor.meet(anchors, _match_anchors)
    runs = dealt.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(by_run.outbound(by_anchor.inbound(_send_runs(window, n_anchor, n_runs)), cogrouped=True), by_run.kind)
    answer = by_run.meet(runs, firsts.answers(ties=False))
    return dealt.groupBy("chunk").cogroup(answer.groupBy("chunk")).applyInArrow(by_run.inbound(_finish(window, n_anchor, n_runs)), "doc_id long, kept_text string, n_words long, n_removed long, removed_spans array<struct<start:long,end:long>>")
