"""Packing token sequences of fixed length: patterns of few documents, fitted by non-negative least squares."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import U, give_back, hash_spans, parts, pieces, spans, stored, utf8
from tessera.session import ship

LENGTH, END = 2048, 0
#: Classes of lengths that patterns are made of at most, proportions for each of them, and how often they are fitted.
CLASSES, SHARES, ROUNDS = 2048, 6, 2
_CACHE_WORDS = 1_500_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_encoders: dict = {}

# ---------------------------------------------------------------- tokens


class WordEncoder:
    """Token ids of whole texts by a tokenizer that drops white space, word by word.

    The tokenizer's pieces never cross ASCII white space and its normaliser composes nothing across it, so a text's ids
    are those of its words in a row. Ids of words are kept by the hash of the word in lower case (which the normaliser
    makes of it anyway; texts that may hold a special token's string are taken as they are).
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known = [(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
        self.pool = [np.zeros(0, np.uint32)]
        self.flat, self.size = self.pool[0], 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, count, found = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for k, s, c in self.known:
            if len(k):
                at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
                hit = k[at] == keys
                start[hit], count[hit] = s[at[hit]], c[at[hit]]
                found |= hit
        return start, count, found

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        start = np.cumsum(count) - count + self.size
        self.pool.append(np.array([x for w in ids for x in w], np.uint32))
        self.size += int(count.sum())
        self.flat = np.concatenate([self.flat, self.pool.pop()])
        self.pool = [self.flat]
        old, new = self.known
        new = tuple(np.concatenate([a, b]) for a, b in zip(new, (keys, start, count), strict=True))
        if len(new[0]) * 8 > len(old[0]):
            old, new = tuple(np.concatenate([a, b]) for a, b in zip(old, new, strict=True)), (new[0][:0], new[1][:0], new[2][:0])
            by = np.argsort(old[0])
            old = tuple(x[by] for x in old)
        else:
            by = np.argsort(new[0])
            new = tuple(x[by] for x in new)
        self.known = [old, new]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin)."""
        if sum(len(k) for k, _, _ in self.known) > _CACHE_WORDS:
            self.forget()
        lower = data if b"<|" in data.tobytes() else _LOWER[data]
        starts, ends, begins = spans(lower, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        keys, first, of = np.unique(hash_spans(lower, starts, ends), return_index=True, return_inverse=True)
        start, count, found = self._find(keys)
        if not found.all():
            new = np.flatnonzero(~found)
            whole = lower.tobytes()
            for lo in range(0, len(new), 20_000):
                part = new[lo : lo + 20_000]
                self._learn(keys[part], [whole[a:b].decode() for a, b in zip(starts[first[part]].tolist(), ends[first[part]].tolist(), strict=True)])
            start, count, _ = self._find(keys)
        n = count[of]
        total = np.cumsum(n)
        ids = self.flat[np.repeat(start[of] - total + n, n) + np.arange(total[-1])]
        return ids, np.r_[0, total][begins]


def encoder(path: str | None) -> WordEncoder:
    """One for each Python worker and file; None: the public tokenizers' file word_bpe_49k.json."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("word_bpe_49k.json"))
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _pieces(length: int, path: str | None, keep_ids: bool):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("place", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * keep_ids)

    def cut(batches):
        own = encoder(path)
        task, written = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            row, piece, size, crc, raw = [], [], [], [], []
            for lo, hi in parts(offsets):
                ids, begins = own.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for i in range(hi - lo):
                    tokens = np.append(ids[begins[i] : begins[i + 1]], np.uint32(END)).astype("<u4")
                    for k, a in enumerate(range(0, len(tokens), length)):
                        x = tokens[a : a + length]
                        row.append(lo + i)
                        piece.append(k)
                        size.append(len(x))
                        crc.append(zlib.crc32(x.tobytes()))
                        if keep_ids:
                            raw.append(x.tobytes())
            sizes = np.array(size, np.int64)
            by = np.argsort(sizes, kind="stable")
            count = np.bincount(sizes, minlength=length + 1)
            place = np.empty(len(sizes), np.int64)
            place[by] = np.arange(len(sizes)) + (written - np.cumsum(count) + count)[sizes[by]]
            written += count
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(np.array(piece, np.int64) * length, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64())]
            columns += [pa.array(np.full(len(sizes), task), pa.int32()), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * keep_ids, schema=schema)
        give_back()

    return cut


def token_pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, place, ids): each row's ids, closed by id 0 and cut into pieces of
    `length`. place numbers a task's pieces of a length from 0; both stay as they are only once the rows are stored."""
    ship(docs.sparkSession)
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(length, tokenizer, keep_ids), kind)


# ---------------------------------------------------------------- plan


def patterns_of(supply: np.ndarray, most: int, shares: int = SHARES) -> np.ndarray:
    """Patterns of two to four sizes (rows of four, 0 for none) that fill `most` exactly, or as nearly as sizes allow.

    supply: how many pieces there are of each size. For each size that occurs: itself and the rest; itself twice and
    three times and the rest; and `shares` further sizes, which follow the supply, with the rest whole and parted once
    more. At most 3 + 2 x shares patterns for each size.
    """
    have = np.flatnonzero(supply[: most + 1])
    have = have[have > 0]
    floor = np.zeros(most + 1, np.int64)
    floor[have] = have
    floor = np.maximum.accumulate(floor)
    sums = np.cumsum(supply)
    first = have[have < most]
    rest, none = most - first, 0 * first

    def drawn(room: np.ndarray, quantile: np.ndarray) -> np.ndarray:
        return floor[np.minimum(np.searchsorted(sums, quantile * sums[room], "right"), room)]

    rows = [np.stack([first, floor[rest], none, none], axis=1)]
    for m in (2, 3):
        f = first[m * first <= most]
        rows.append(np.stack([f, f, f * (m > 2), floor[most - m * f]], axis=1))
    for k in range(shares):
        # steps of the golden ratio and of its square, which cover the quantiles evenly from size to size
        part, split = ((first * g + (k + 0.5) / shares) % 1 for g in (0.6180339887, 0.3819660113))
        b = drawn(rest, part)
        rows.append(np.stack([first, b, floor[rest - b], none], axis=1))
        c = drawn(rest - b, split)
        rows.append(np.stack([first, b, c, floor[rest - b - c]], axis=1))
    out = np.sort(np.concatenate(rows), axis=1)[:, ::-1]
    return np.unique(out[out[:, 1] > 0], axis=0)


def fit(patterns: np.ndarray, histogram: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 with patterns.T x near the histogram: least squares by accelerated projected gradient.

    A size's difference weighs by its tokens, so that short pieces are kept for the long ones' gaps. Each step is divided by what a pattern's sizes meet in other patterns, which bounds the curvature.
    """
    if not len(patterns):
        return np.zeros(0)
    used = patterns > 0
    n = len(histogram)

    def apply(x: np.ndarray) -> np.ndarray:
        return np.bincount(patterns[used], weights=np.repeat(x, used.sum(axis=1)), minlength=n)

    def back(r: np.ndarray) -> np.ndarray:
        return np.where(used, r[patterns], 0).sum(axis=1)

    # Gershgorin: the row sums of A'A bound its eigenvalues, scaled by each pattern
    weight = (np.arange(n) / n) ** 2
    bound = back(weight * apply(np.ones(len(patterns))))
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(weight * (apply(y) - histogram)) / bound)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / s * (new - x), s
    return x


def rounded(patterns: np.ndarray, x: np.ndarray, supply: np.ndarray) -> np.ndarray:
    """Whole repeat counts near x that the supply of each size covers.

    The whole parts come first. What is left over of each largest size then goes to its patterns in the order of what
    rounding took from them, so that a count that the fit spread over many patterns isn't lost.
    """
    left, times = supply.copy(), np.zeros(len(patterns), np.int64)

    def take(i: int, most: int) -> int:
        own = [int(v) for v in patterns[i] if v]
        n = min(most, *(int(left[v]) // own.count(v) for v in own))
        for v in own:
            left[v] -= n
        times[i] += n
        return n

    whole = np.floor(x).astype(np.int64)
    for i in np.flatnonzero(whole)[np.argsort(-x[whole > 0], kind="stable")]:
        take(i, int(whole[i]))
    part = x - times
    largest = patterns[:, 0]
    wanted = np.bincount(largest, weights=x, minlength=len(supply)) - np.bincount(largest, weights=times, minlength=len(supply))
    wanted = np.rint(wanted).astype(np.int64)
    # the largest sizes first, which fit in the fewest places
    for i in np.lexsort((-part, -largest)):
        if wanted[largest[i]] > 0 and part[i] > 0:
            wanted[largest[i]] -= take(i, 1 + int(part[i]))
    return times


def fitted(histogram: np.ndarray, length: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], int], np.ndarray]:
    """(lengths of a sequence: how often, what is left of the histogram), by patterns of classes of lengths.

    Lengths are put into at most `classes` classes of equal width, each counted as its largest length, so that patterns
    always fit. Patterns are enumerated over the classes that still have pieces, fitted, rounded, and taken from the
    supply; what rounding leaves is fitted again, at most `rounds` times. Their number depends on neither rows nor data.
    """
    width = pieces(length, classes)
    most = length // width
    left, out = histogram.astype(np.int64).copy(), {}
    left[0] = 0
    if left[length]:
        out[(length,)] = int(left[length])
        left[length] = 0
    of = np.minimum(-(-np.arange(length + 1) // width), most)
    for _ in range(rounds):
        usable = np.where(of * width >= np.arange(length + 1), left, 0)
        supply = np.bincount(of, weights=usable, minlength=most + 1).astype(np.int64)
        patterns = patterns_of(supply, most)
        # what a sequence leaves empty is lost, so only patterns that fill it to the last class take part
        patterns = patterns[patterns.sum(axis=1) >= most - 1]
        times = rounded(patterns, fit(patterns, supply.astype(float)), supply)
        if not times.any():
            break
        for i in np.flatnonzero(times):
            for own, n in _exact(patterns[i][patterns[i] > 0], int(times[i]), width, left, usable):
                out[own] = out.get(own, 0) + n
    return out, left


def _exact(classes: np.ndarray, times: int, width: int, left: np.ndarray, usable: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Takes pieces of real lengths for a pattern of classes, the longest first; (lengths, how often)."""
    runs = []
    for c in classes.tolist():
        need, own = times, []
        for x in range(c * width, max(0, (c - 1) * width), -1):
            if n := min(need, int(usable[x])):
                own.append([x, n])
                usable[x] -= n
                left[x] -= n
                need -= n
        runs.append(own)
    out = []
    while times:
        n = min(own[0][1] for own in runs)
        out.append((tuple(own[0][0] for own in runs), n))
        times -= n
        for own in runs:
            own[0][1] -= n
            if not own[0][1]:
                own.pop(0)
    return out


def plan_of(histogram: np.ndarray, length: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (piece length, first rank, ranks, first sequence, offset) that place every piece of the histogram.

    The ranks of a length are its pieces in any fixed order; slot by slot they go to sequences in a row. Fitted patterns
    are placed first; best fit then puts what they leave into their gaps and into further sequences.
    """
    patterns, left = fitted(histogram, length)
    slots, taken, sequence = [], np.zeros(len(histogram), np.int64), 0
    for pattern, times in best_fit(left, length, patterns):
        offset = 0
        for x in pattern:
            slots.append((int(x), int(taken[x]), times, sequence, offset))
            taken[x] += times
            offset += int(x)
        sequence += times
    return slots


def best_fit(histogram: np.ndarray, length: int, begun: dict[tuple[int, ...], int] | None = None) -> list[tuple[list[int], int]]:
    """(pattern, times) of best fit decreasing: the longest first, each into the fullest sequence that has room.

    begun: sequences that hold pieces already. Pieces of one length and sequences of one filling move together, so that
    the work depends on the number of lengths.
    """
    left, room = histogram.copy(), np.zeros(length + 1, np.int64)
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(gap: int, pattern: tuple[int, ...], times: int) -> None:
        groups.setdefault(gap, []).append((pattern, times))
        room[gap] += times

    for pattern, times in (begun or {}).items():
        put(length - sum(pattern), pattern, times)
    for x in np.flatnonzero(left)[::-1].tolist():
        c = int(left[x])
        while c and len(gaps := np.flatnonzero(room[x:])):
            gap = int(gaps[0]) + x
            pattern, times = groups[gap].pop()
            room[gap] -= times
            each = min(gap // x, c)
            full = min(times, c // each)
            if times > full:
                put(gap, pattern, times - full)
            put(gap - each * x, pattern + (x,) * each, full)
            c -= full * each
        each = length // x
        if c // each:
            put(length - each * x, (x,) * each, c // each)
        if c % each:
            put(length - c % each * x, (x,) * (c % each), 1)
    return [(list(p), n) for own in groups.values() for p, n in own]


# ---------------------------------------------------------------- operator


def _place(plan, names: list[str]):
    """Looks a piece's slot up by its length and rank."""

    def place(batches):
        key, first, sequence, offset = plan.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("length", "rank"))
            # ranks stay below 2**51, lengths below 2**12
            at = np.searchsorted(key, length << 51 | rank, "right") - 1
            own = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence[at] + rank - first[at], pa.int64()), pa.array(offset[at], pa.int64())], names=[*names, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, ids (with keep_ids: little-endian unsigned 32-bit),
    sequence_id (long, from 0 without gaps) and offset.

    tokenizer: a file for the tokenizers library whose pieces don't cross white space. Only a document of over `length`
    ids (at most 4,095) is cut. Only doc_id and text are read; a null or empty text is the closing id alone. Null or
    repeated ids, and whole rows that repeat, are rows like others: a piece's rank is where it was written, whatever it
    holds. Only the histogram of lengths (`length` numbers at most) comes to the driver; the plan that goes out depends
    on the number of lengths and patterns and not on the rows. No rows give none.
    """
    if not 0 < length < 4096:
        raise ValueError("length must be between 1 and 4095")
    spark = docs.sparkSession
    cut = stored(token_pieces(docs, length, tokenizer, keep_ids))
    # how many pieces of each length each task wrote; their sums over the tasks say where a task's ranks begin
    sizes = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(length + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        histogram[r["length"]] = r["n"]
    slots = np.array(sorted(plan_of(histogram, length)) or [(0, 0, 0, 0, 0)], np.int64)
    plan = spark.sparkContext.broadcast((slots[:, 0] << 51 | slots[:, 1], slots[:, 1], slots[:, 3], slots[:, 4]))
    before = sizes.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    ranked = cut.join(before, ["length", "task"]).select(*names, (F.col("before") + F.col("place")).alias("rank"))
    kinds = cut.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(_place(plan, names), kinds)
