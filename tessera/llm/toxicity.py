"""Toxicity scores: votes of the nearest labelled examples by exact TF-IDF cosine, from a block-max inverted index.

1. Every row of a bounded sample of labelled rows that has a word is an example, over all words of its whole text.
2. A term's weight is its frequency's logarithm, times its inverse document frequency, times (from 1 up) how strongly it
   goes with the label: the chi-square of its distinct contexts, the words before and after it, so that copies of one
   text count once. Beginnings of words are terms where they go with the label, for forms that the sample hasn't seen.
   Document frequencies are counted over all documents.
3. Examples stand in blocks of similar ones. Rare terms have lists of examples; the commonest have a column over all
   examples, and the index holds their largest weight in each block. A text adds up its lists, visits the blocks of the
   best bounds, and then just those whose bound may still hold a nearer example.
4. Votes become probabilities by a logistic curve, fitted on a fifth of the sample that a second index, of the rest
   alone, has voted on.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import U, give_back, hash_sums, labelled_sample, mix, parts, spans, stored, utf8
from tessera.llm.frequencies import FOLD, document_frequencies, terms_of
from tessera.session import ship

#: Labelled rows that are learned from at most; neighbours that vote; examples of a block; bytes of a word's beginnings.
TRAIN_ROWS, NEIGHBOURS, BLOCK, HEADS = 8_192, 16, 32, (4, 5, 6)
#: What makes a term's contexts count as evidence: how many have the label at least, and standard errors above the share of all.
CONTEXTS, DEVIATION = 6, 5.0
#: The prior's weight beside the votes; one row in so many is for calibration; rows of each label that it takes at least.
PRIOR_WEIGHT, CALIBRATION, ENOUGH = 0.5, 5, 5
_BUCKETS = 16
#: Terms of the most examples, which have a column each instead of a list; texts scored together; blocks that each visits first,
#: and how many more it visits by itself; entries of lists that are added up at a time (or one text's, if it has more).
_COMMON, _TEXTS, _VISIT, _MANY, _ENTRIES = 512, 64, 2, 8, 1 << 17


def _hash_heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A column of hashes for whole words, then one for each length of beginning (that of the word, if it is shorter)."""
    sums, inverse = hash_sums(data)
    out = np.empty((len(starts), 1 + len(HEADS)), U)
    for k, head in enumerate((0, *HEADS)):
        end = np.minimum(starts + head, ends) if head else ends
        out[:, k] = mix((sums[end] - sums[starts]) * inverse[starts] + U(k))
    return out


def _slices(column):
    """(lo, hi, bytes, word starts, word ends, where each row's words begin) for runs of rows."""
    data, offsets = utf8(column)
    for lo, hi in parts(offsets):
        piece = FOLD[data[offsets[lo] : offsets[hi]]]
        yield (lo, hi, piece, *spans(piece, offsets[lo : hi + 1] - offsets[lo]))


# ---------------------------------------------------------------- terms that tell the label


def _contexts(batches):
    """By bucket of the term: (term, context, label and twice whether the row is for calibration) for every word."""
    for batch in batches:
        mark = np.asarray(batch.column("label")).astype(np.uint8) | np.asarray(batch.column("apart")).astype(np.uint8) << 1
        for lo, hi, piece, s, e, begins in _slices(batch.column("text")):
            if not len(s):
                continue
            terms = _hash_heads(piece, s, e)
            word = terms[:, 0]
            first = np.zeros(len(word), bool)
            first[begins[:-1][begins[:-1] < len(word)]] = True
            last = np.r_[first[1:], True]
            before = np.where(first, U(0), np.r_[U(0), word[:-1]])
            after = np.where(last, U(0), np.r_[word[1:], U(0)])
            context = mix(before * U(0x9E3779B97F4A7C15) + after)
            m = np.repeat(mark[lo:hi], np.diff(begins))
            t, c, m = terms.ravel(), np.repeat(context, terms.shape[1]), np.repeat(m, terms.shape[1])
            for b in range(_BUCKETS):
                own = t % U(_BUCKETS) == b
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([t[own].tobytes()], pa.binary()), pa.array([c[own].tobytes()], pa.binary()), pa.array([m[own].tobytes()], pa.binary())], names=["bucket", "terms", "contexts", "marks"])
    give_back()


def _chosen(table: pa.Table) -> pa.Table:
    """For all rows (0) and those not for calibration (1): the terms of enough labelled contexts, with the number of
    contexts and how many are labelled, and both numbers for the whole bucket."""
    all_t, all_c = (np.concatenate([np.frombuffer(x, U) for x in table[k].to_pylist()]) for k in ("terms", "contexts"))
    marks = np.concatenate([np.frombuffer(x, np.uint8) for x in table["marks"].to_pylist()])
    out = []
    for part in (0, 1):
        own = marks & 2 == 0 if part else np.ones(len(marks), bool)
        t, c, y = all_t[own], all_c[own], (marks[own] & 1).astype(np.float64)
        if not len(t):
            out.append((part, b"", b"", b"", 0.0, 0.0))
            continue
        by = np.lexsort((c, t))
        t, c, y = t[by], c[by], y[by]
        at = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])])
        share, t = np.add.reduceat(y, at) / np.diff(np.r_[at, len(t)]), t[at]
        at = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        n, a, t = np.diff(np.r_[at, len(t)]), np.add.reduceat(share, at), t[at]
        keep = a >= CONTEXTS
        out.append((part, t[keep].tobytes(), n[keep].astype(np.float64).tobytes(), a[keep].tobytes(), float(n.sum()), float(a.sum())))
    return pa.Table.from_arrays([pa.array(x) for x in zip(*out, strict=True)], schema=pa.schema([("part", pa.int64()), ("terms", pa.binary()), ("n", pa.binary()), ("a", pa.binary()), ("all_n", pa.float64()), ("all_a", pa.float64())]))


def evidence_of(rows: list, part: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms that tell the label, chi-square of each) from what _chosen gave."""
    got = [r for r in rows if r["part"] == part]
    terms, n, a = (np.concatenate([np.zeros(0, t), *[np.frombuffer(r[k], t) for r in got]]) for k, t in (("terms", U), ("n", np.float64), ("a", np.float64)))
    p = min(max(sum(r["all_a"] for r in got) / max(1.0, sum(r["all_n"] for r in got)), 1e-6), 1 - 1e-6)
    z = (a - n * p) / np.sqrt(n * p * (1 - p))
    # their contexts are labelled far more often than by chance, and at least half as often as not
    keep = (z >= DEVIATION) & (a >= n / 2)
    by = np.argsort(terms[keep])
    return terms[keep][by], (z[keep] ** 2)[by]


# ---------------------------------------------------------------- vectors


class Vocabulary:
    """Terms with places. heads: those of them that beginnings of words may be (None: all)."""

    def __init__(self, terms: np.ndarray, heads: np.ndarray | None = None):
        self.terms = np.unique(terms)
        self.near = self._filter(self.terms)
        self.near_head = self.near if heads is None else self._filter(heads)

    @staticmethod
    def _filter(terms: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 22, bool)
        out[(terms >> U(42)).astype(np.int64)] = True
        return out

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, count) of the terms of texts, sorted by row and place."""
        if not len(starts) or not len(self.terms):
            return (np.zeros(0, np.int64),) * 3
        terms = _hash_heads(data, starts, ends)
        cut = (terms >> U(42)).astype(np.int64)
        word, column = np.nonzero(np.column_stack([self.near[cut[:, :1]], self.near_head[cut[:, 1:]]]))
        found = terms[word, column]
        place = np.minimum(np.searchsorted(self.terms, found), len(self.terms) - 1)
        hit = self.terms[place] == found
        row = np.searchsorted(begins, word[hit], "right") - 1
        code, count = np.unique(row.astype(np.int64) << 32 | place[hit], return_counts=True)
        return code >> 32, code & 0xFFFFFFFF, count

    def rows(self, column):
        """For each run of rows: (lo, hi, row, place in the vocabulary, count), sorted by row and place."""
        for lo, hi, piece, s, e, begins in _slices(column):
            yield lo, hi, *self.of(piece, s, e, begins)


def _vectors(heads):
    """An example's terms and how often each stands in it: all words (`words` of them), then beginnings that tell the label."""

    def hold(batches):
        own = heads.value.terms
        for batch in batches:
            terms, counts, words = [], [], []
            for lo, hi, piece, s, e, begins in _slices(batch.column("text")):
                all_ = _hash_heads(piece, s, e) if len(s) else np.zeros((0, 1 + len(HEADS)), U)
                tells = np.isin(all_[:, 1:], own)
                for a, b in zip(begins[:-1], begins[1:], strict=True):
                    (t, n), (h, m) = (np.unique(x, return_counts=True) for x in (all_[a:b, 0], all_[a:b, 1:][tells[a:b]]))
                    terms.append(np.r_[t, h].tobytes())
                    counts.append(np.r_[n, m].astype(np.uint32).tobytes())
                    words.append(len(t))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "label", "apart")), pa.array(terms, pa.binary()), pa.array(counts, pa.binary()), pa.array(words, pa.int32())], names=["doc_id", "label", "apart", "terms", "counts", "words"])
        give_back()

    return hold


def _ranges(start: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries of the lists of the given places, which place each belongs to)."""
    size = start[place + 1] - start[place]
    of = np.repeat(np.arange(len(place)), size)
    return np.arange(len(of)) + (start[place] - np.cumsum(size) + size)[of], of


@dataclass
class Examples:
    """Labelled rows' terms in a row: those of the k-th stand at begin[k]..begin[k + 1]."""

    doc: np.ndarray
    label: np.ndarray
    begin: np.ndarray
    place: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Examples:
        joined = [np.concatenate([np.zeros(0, np.int64), *[np.asarray(r[k]) for r in rows]]) for k in (2, 3)]
        return Examples(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.cumsum([0, *(len(r[2]) for r in rows)]), joined[0].astype(np.int32), joined[1].astype(np.uint32))

    def where(self, keep: np.ndarray) -> Examples:
        own = np.flatnonzero(keep)
        entry, _ = _ranges(self.begin, own)
        return Examples(self.doc[own], self.label[own], np.r_[0, np.cumsum(np.diff(self.begin)[own])], self.place[entry], self.count[entry])


class Index:
    """Examples as unit vectors, in blocks, with each term's largest weight in each block.

    weight: of each term of the vocabulary (0: no term); examples: (doc_id, label, places, counts) of each, or Examples;
    share: the prior.
    """

    def __init__(self, vocabulary: Vocabulary, weight: np.ndarray, examples, share: float, neighbours: int, curve: tuple[float, float] = (1.0, 0.0)):
        self.vocabulary, self.weight, self.share, self.neighbours, self.curve = vocabulary, weight, share, neighbours, curve
        e = examples if isinstance(examples, Examples) else Examples.of(examples)
        often = np.bincount(e.place, minlength=len(weight))
        row = np.repeat(np.arange(len(e.doc)), np.diff(e.begin))
        # single precision, which takes half the room; norms are added up in double
        value = np.log(e.count, dtype=np.float32)
        value += 1
        value *= weight.astype(np.float32)[e.place]
        norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(e.doc)))
        value /= np.maximum(norm, 1e-300)[row].astype(np.float32)
        del row
        keys = []
        for k in np.flatnonzero(norm > 0).tolist():
            p, v = e.place[e.begin[k] : e.begin[k + 1]], value[e.begin[k] : e.begin[k + 1]]
            # similar ones stand together: by the heaviest term, the commonest one (their language's), and length
            top = int(p[np.argmax(v)]) if v.max() > 0.5 else -1
            keys.append((top, int(p[np.argmax(often[p])]), len(p), int(e.doc[k]), k))
        order = np.array([k[-1] for k in sorted(keys)], np.int64)
        self.doc, self.label = e.doc[order], e.label[order]
        self.blocks = -(-len(order) // BLOCK)
        entry, example = _ranges(e.begin, order)
        place, value, example = e.place[entry], value[entry], example.astype(np.int32)
        del entry
        # the commonest terms as columns, and the largest of each block
        common = np.argsort(-often, kind="stable")[:_COMMON]
        self.column = np.full(len(weight), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((self.blocks * BLOCK, len(common)), np.float32)
        mine = self.column[place] >= 0
        self.dense[example[mine], self.column[place[mine]]] = value[mine]
        self.bound = np.ascontiguousarray(self.dense.reshape(self.blocks, BLOCK, len(common)).max(axis=1, initial=0).T)
        # the others as lists
        place, value, example = place[~mine], value[~mine], example[~mine]
        by = np.argsort(place, kind="stable")
        self.posting, self.value = example[by], value[by]
        self.start = np.searchsorted(place[by], np.arange(len(weight) + 1))

    def nearest(self, place: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the nearest, nearest first; ties in the order of the index. Only cosines over 0 count."""
        return self.nearest_of([(place, count)])[0]

    def nearest_of(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """nearest for some texts together, which read the blocks that several of them visit once."""
        n, k = len(self.doc), self.neighbours
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        size = self.blocks * BLOCK
        query = np.zeros((len(texts), self.dense.shape[1]), np.float32)
        place, count = (np.concatenate([t[i] for t in texts]) for i in (0, 1))
        text = np.repeat(np.arange(len(texts)), [len(t[0]) for t in texts])
        w = (1 + np.log(count)) * self.weight[place]
        w /= np.maximum(np.sqrt(np.bincount(text, weights=w * w, minlength=len(texts))), 1e-300)[text]
        own = self.column[place]
        query[text[own >= 0], own[own >= 0]] = w[own >= 0]
        # what the lists give
        rare = np.flatnonzero(own < 0)
        near = np.empty((len(texts), size), np.float32)
        begin = np.searchsorted(text[rare], np.arange(len(texts) + 1))
        entries = np.r_[0, np.cumsum(self.start[place[rare] + 1] - self.start[place[rare]])][begin]
        for lo, hi in parts(entries, _ENTRIES):
            some = rare[begin[lo] : begin[hi]]
            entry, of = _ranges(self.start, place[some])
            added = np.bincount(((text[some] - lo) * size)[of] + self.posting[entry], weights=w[some][of] * self.value[entry], minlength=(hi - lo) * size)
            near[lo:hi] = added.reshape(hi - lo, size)
        # what a block may hold at most; the rounding is less than the margin
        hope = query @ self.bound + near.reshape(len(texts), self.blocks, BLOCK).max(axis=2) + 1e-5
        first = np.argpartition(-hope, min(_VISIT, self.blocks) - 1, axis=1)[:, :_VISIT]
        inner, least = np.arange(BLOCK), np.zeros(len(texts))

        def cosines(i: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rows = (blocks[:, None] * BLOCK + inner).ravel()
            return rows, near[i, rows] + self.dense[rows] @ query[i]

        for i in range(len(texts)):
            got = cosines(i, first[i])[1]
            least[i] = np.partition(got, -k)[-k] if len(got) >= k else 0
        least = np.maximum(least - 1e-5, 1e-7)
        left = hope >= least[:, None]
        many = left.sum(axis=1) > _MANY + _VISIT
        out: list = [None] * len(texts)

        def best(i: int, rows: np.ndarray, cosine: np.ndarray) -> None:
            there = np.flatnonzero(cosine >= least[i])
            there = there[np.lexsort((rows[there], -cosine[there]))[:k]]
            out[i] = rows[there], np.minimum(cosine[there].astype(np.float64), 1.0)

        for i in np.flatnonzero(~many):
            best(i, *cosines(i, np.flatnonzero(left[i])))
        if many.any():
            # these read their blocks together
            some = np.flatnonzero(left[many].any(axis=0))
            rows = (some[:, None] * BLOCK + inner).ravel()
            every = len(some) == self.blocks
            both = query[many] @ (self.dense if every else self.dense[rows]).T
            both += near[many] if every else near[np.ix_(many, rows)]
            for i, cosine in zip(np.flatnonzero(many), both, strict=True):
                best(i, rows, cosine)
        return out

    def vote(self, found: np.ndarray, near: np.ndarray) -> float:
        """The neighbours' votes weighted by squared nearness, beside a prior of the share among texts without evidence."""
        weight = near * near
        return float((weight @ self.label[found] + PRIOR_WEIGHT * self.share) / (weight.sum() + PRIOR_WEIGHT))

    def score(self, vote: float) -> float:
        """The probability that a vote stands for."""
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * _logit(vote) + b))))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fitted_curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve over the votes' log odds that tells the labels best; pulled towards leaving
    votes as they are, by one row's weight. Too few rows of either label leave them so."""
    if min(labels.sum(), (1 - labels).sum()) < ENOUGH:
        return 1.0, 0.0
    x = np.column_stack([_logit(votes), np.ones(len(votes))])
    # smoothed targets, so that labels that votes tell apart cleanly don't make the slope infinite
    target = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    start = np.array([1.0, 0.0])
    at = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (p - target) + (at - start))
        at = at - step * min(1.0, 1 / np.abs(step).max()) if np.abs(step).max() else at
        if np.abs(step).max() < 1e-8:
            break
    return float(max(at[0], 0.1)), float(at[1])


def _scored(index, extra: str):
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int64())]))

    def score(batches):
        own = index.value
        memo: dict[bytes, tuple] = {}
        for batch in batches:
            out = np.full(batch.num_rows, own.score(own.share))
            evidence: list = [[] for _ in range(batch.num_rows)]
            for lo, hi, row, place, count in own.vocabulary.rows(batch.column("text")) if own.blocks else ():
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                texts = {lo + i: (place[at[i] : at[i + 1]], count[at[i] : at[i + 1]]) for i in np.flatnonzero(np.diff(at)).tolist()}
                # equal texts are scored once; 128 bits of a hash stand for what a text holds
                keys = {i: blake2b(p.tobytes() + c.tobytes(), digest_size=16).digest() for i, (p, c) in texts.items()}
                if len(memo) > 5_000:
                    memo.clear()
                new = list({key: texts[i] for i, key in keys.items() if key not in memo}.items())
                for first in range(0, len(new), _TEXTS):
                    some = new[first : first + _TEXTS]
                    for (key, _), (found, near) in zip(some, own.nearest_of([x for _, x in some]), strict=True):
                        memo[key] = own.score(own.vote(found, near)), [{"doc_id": int(own.doc[f]), "cosine": float(n), "label": int(own.label[f])} for f, n in zip(found, near, strict=True)] if not extra else []
                for i, key in keys.items():
                    out[i], evidence[i] = memo[key]
            if extra:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, extra])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64()), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])
            give_back()

    return score


def sample_of(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, label, text, apart) of a bounded labelled sample; apart marks one row in five, for calibration."""
    apart = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATION)) == 0
    return labelled_sample(docs, labels, label, rows).withColumn("apart", apart.cast("int"))


def _numbers(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of a column of packed ones in a row, where each row's begin)."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    whole = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_binary(whole.type)
    _, offsets, data = whole.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64)
    numbers = np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0] : offsets[-1]].copy().view(kind)
    return numbers, (offsets - offsets[0]) // np.dtype(kind).itemsize


def build(docs: DataFrame, labels: DataFrame, label: str, train_rows: int = TRAIN_ROWS, neighbours: int = NEIGHBOURS) -> Index:
    """The index: examples from a bounded sample of labels, document frequencies from all docs."""
    spark = docs.sparkSession
    ship(spark)
    sample = stored(sample_of(docs, labels, label, train_rows))
    got = sample.mapInArrow(_contexts, "bucket int, terms binary, contexts binary, marks binary").groupBy("bucket").applyInArrow(_chosen, "part long, terms binary, n binary, a binary, all_n double, all_a double").collect()
    tells = [evidence_of(got, part) for part in (0, 1)]
    heads = spark.sparkContext.broadcast(Vocabulary(np.concatenate([t for t, _ in tells])))
    n, by_word, by_head = document_frequencies(docs, heads)
    # bounded by the sample; as Arrow's buffers, which take no more room than the numbers
    table = sample.mapInArrow(_vectors(heads), "doc_id long, label int, apart int, terms binary, counts binary, words int").toArrow().sort_by("doc_id").combine_chunks()
    hashes, begin = _numbers(table["terms"], U)
    terms = np.unique(hashes)
    place = np.searchsorted(terms, hashes).astype(np.int32)
    del hashes
    size, words = np.diff(begin), np.asarray(table["words"]).astype(np.int64)
    is_word = np.zeros(len(terms), bool)
    is_word[place[np.arange(len(place)) - np.repeat(begin[:-1], size) < np.repeat(words, size)]] = True
    every = Examples(np.asarray(table["doc_id"]), np.asarray(table["label"]).astype(np.int64), begin, place, _numbers(table["counts"], np.uint32)[0])
    apart = np.asarray(table["apart"]) == 1
    del table
    vocabulary = Vocabulary(terms, heads.value.terms)
    df = by_word[terms_of(terms)].astype(np.float64)
    special = np.isin(terms, heads.value.terms)
    df[special] = by_head[np.searchsorted(heads.value.terms, terms[special])]
    idf = np.log((1 + n) / (1 + df)) + 0.05

    def index(part: int, curve=(1.0, 0.0)) -> Index:
        evident, chi = tells[part]
        own = np.isin(terms, evident)
        # beginnings of words that tell the label in the other part alone are no terms here
        boost = is_word.astype(np.float64)
        boost[own] = np.maximum(1, chi[np.searchsorted(evident, terms[own])])
        used = every.where(~apart) if part else every
        row = np.repeat(np.arange(len(used.doc)), np.diff(used.begin))
        without = np.bincount(row[own[used.place]], minlength=len(used.doc)) == 0
        share = float((used.label[without].sum() + 1) / (without.sum() + 2)) if len(used.doc) else 0.5
        return Index(vocabulary, idf * boost, used, share, neighbours, curve)

    curve, held = (1.0, 0.0), every.label[apart]
    if min(held.sum(), (1 - held).sum()) >= ENOUGH:
        second = index(1)
        texts = [(every.place[begin[k] : begin[k + 1]], every.count[begin[k] : begin[k + 1]]) for k in np.flatnonzero(apart)]
        votes = np.array([second.vote(*x) for lo in range(0, len(texts), _TEXTS) for x in second.nearest_of(texts[lo : lo + _TEXTS])])
        curve = fitted_curve(votes, held)
        del second, texts
    return index(0, curve)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """One row per row of docs: doc_id, score (the probability of label 1), evidence (the voting examples, nearest first).

    labels (doc_id, label) holds the rows that may be learned from, of which the `train_rows` of smallest hash of the
    id are (all, if there are fewer); the index has one row for each of them, however often the id repeats in docs. Only
    doc_id and text of docs are read. A null or empty text, or one that shares no word with any example, has no
    neighbours and gets the share of label 1 among examples without evidence. Null and repeated ids are rows like
    others; for training a null id or label is passed over and a doc_id labelled twice has the larger label. Without
    labels every score is 0.5.
    """
    index = docs.sparkSession.sparkContext.broadcast(build(docs, labels, label, train_rows, neighbours))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_scored(index, ""), "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,label:long>>")


def not_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3, train_rows: int = TRAIN_ROWS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The rows of docs, all columns, that score less than threshold."""
    index = docs.sparkSession.sparkContext.broadcast(build(docs, labels, label, train_rows, neighbours))
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_scored(index, name), schema).where(F.col(name) < threshold).drop(name)
