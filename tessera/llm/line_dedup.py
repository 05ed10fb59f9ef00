"""Removing lines that an earlier place has: overlapping windows of three lines, found globally."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import firsts
from tessera.llm.common import U, give_back, hash_spans, ids_of, parts, pieces, rolling, text_bytes, utf8
from tessera.llm.substring_dedup import covered_words

WINDOW = 3


class Lines:
    """A chunk's documents in order, their lines, and the windows of lines with keys."""

    def __init__(self, table: pa.Table, window: int, n_buckets: int):
        self.table = firsts.in_order(table)
        self.data, offsets = utf8(self.table["text"])
        self.doc, known = ids_of(self.table["doc_id"])
        self.null = np.asarray(self.table["text"].combine_chunks().is_null()) if self.table.num_rows else np.zeros(0, bool)
        starts, ends, begins, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], [np.zeros(0, U)]
        total = 0
        for lo, hi in parts(offsets):
            piece, own = self.data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            breaks = np.flatnonzero(piece == 10)
            # each text has a line more than it has breaks; those of equal place stand in the order break, text
            start = np.sort(np.r_[own[:-1], breaks + 1], kind="stable")
            count = np.searchsorted(breaks, own[1:]) - np.searchsorted(breaks, own[:-1]) + 1
            begin = np.cumsum(count)
            end = np.empty_like(start)
            end[:-1] = start[1:] - 1
            end[begin - 1] = own[1:]
            starts.append(start + offsets[lo])
            ends.append(end + offsets[lo])
            hashes.append(hash_spans(piece, start, end))
            begins.append(begin + total)
            total += len(start)
        self.starts, self.ends, self.begins = np.concatenate(starts), np.concatenate(ends), np.concatenate(begins)
        lines = np.concatenate(hashes)
        self.n_lines = np.diff(self.begins)
        self.row = np.repeat(np.arange(len(self.n_lines)), self.n_lines)
        left = np.repeat(self.begins[1:], self.n_lines) - np.arange(len(lines))
        self.windows = np.flatnonzero((left >= window) & np.repeat(known, self.n_lines))
        keys = rolling(lines, window, 5)[self.windows]
        checks = (rolling(lines, window, 6)[self.windows] >> U(32)).astype(np.uint32)
        self.distinct = firsts.Distinct(keys, checks, self.doc[self.row[self.windows]], n_buckets)
        # rows are in the order of their ids, so that the first of a key in this chunk is its first place
        self.again = np.ones(len(keys), bool)
        if len(keys):
            self.again[np.unique(self.distinct.of, return_index=True)[1]] = False


def _send(window: int, n_buckets: int):
    def send(table: pa.Table) -> pa.Table:
        rows = Lines(table, window, n_buckets).distinct.rows(table["chunk"][0].as_py())
        give_back()
        return rows

    return send


def _finish(window: int, n_buckets: int):
    def finish(table: pa.Table, answer: pa.Table) -> pa.Table:
        names = ["doc_id", "kept_text", "n_lines", "n_removed"] + ["rest"] * ("rest" in table.column_names)
        lines = Lines(table, window, n_buckets)
        late = lines.again | lines.distinct.answered(answer)[lines.distinct.of]
        covered = covered_words(len(lines.starts), lines.windows, late, window)
        sums = np.r_[0, np.cumsum(covered)]
        removed = sums[lines.begins[1:]] - sums[lines.begins[:-1]]
        whole, kept = lines.data.tobytes(), lines.table["text"].to_pylist()
        for i in np.flatnonzero(removed):
            stay = np.flatnonzero(~covered[lines.begins[i] : lines.begins[i + 1]]) + lines.begins[i]
            kept[i] = b"\n".join(whole[a:b] for a, b in zip(lines.starts[stay].tolist(), lines.ends[stay].tolist(), strict=True)).decode()
        n = np.where(lines.null, 0, lines.n_lines)
        rest = [lines.table["rest"]] if "rest" in table.column_names else []
        give_back()
        return pa.Table.from_arrays([lines.table["doc_id"], pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), *rest], names=names)

    return finish


def line_dedup(docs: DataFrame, window: int = WINDOW, rest: list[str] | None = None, chunk_bytes: int = firsts.CHUNK_BYTES, bucket_keys: int = firsts.BUCKET_KEYS, groups: int = firsts.GROUPS) -> DataFrame:
    """One row per row of docs: doc_id, kept_text, n_lines, n_removed, and the columns of docs named in rest.

    Lines are what stands between line feeds, white space and empty lines included. A place is a document's id and the
    line's number; of equal windows of `window` consecutive lines the one at the smallest place stays, and every line
    under a later one goes. Windows are judged on the input, not on what is left. Only doc_id, text and rest are read.
    A null text has no lines and stays null; a document of fewer than `window` lines stays as it is, and so does a row
    of null doc_id, which is neither earlier nor later than any other. Of rows that share a doc_id those with the same
    text are told apart by nothing, and one of them is the first. No rows give no rows.
    """
    _, size = text_bytes(docs)
    n_chunks, n_buckets = pieces(size, chunk_bytes), pieces(size // 50, bucket_keys)
    dealt = firsts.chunked(docs, n_chunks, rest)
    way = firsts.way_of_keys(n_buckets, groups)
    sent = dealt.groupBy("chunk").applyInArrow(way.outbound(_send(window, n_buckets)), way.kind)
    answer = way.meet(sent, firsts.answers(ties=True))
    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())] + ([dealt.schema["rest"]] if rest else []))
    out = dealt.groupBy("chunk").cogroup(answer.groupBy("chunk")).applyInArrow(way.inbound(_finish(window, n_buckets)), kinds)
    return out.select("doc_id", "kept_text", "n_lines", "n_removed", *[F.col(f"rest.f{k}").alias(c) for k, c in enumerate(rest or [])])
