"""Finding benchmark passages in documents: latent semantic retrieval, then longest common subsequence and key words.

1. Document frequencies of hashed words are counted over all documents.
2. All passages' TF-IDF vectors, of length one, make a sparse matrix that stays spread over the executors. A randomised
   singular value decomposition takes only products with it, each a job that adds up what its rows give; its rank stays
   well below the passages' number.
3. Windows of several sizes run over every whole document. A window's cosine with a passage is taken in the latent
   space; a window in whose weight benchmark words have too small a part is passed over. Whatever its cosine, a window that holds three words running of a passage, one of its rarest third among them, is a candidate too:
   a space of low rank keeps what passages have in common, and the more documents hold a passage, the less its words
   weigh, so that weights alone would lose copies.
4. A candidate is kept if enough of the passage's words stand around the window in order, and enough of its key words
   (an answer's words where the benchmark has them, else the rarest words) are among them. Where the latent cosine is
   high, as with a paraphrase, fewer words in order are asked for, but all key words.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import U, cut, give_back, hash_spans, parts, pieces, rolling, spans
from tessera.llm.frequencies import BITS, document_frequencies, fold, terms_of

#: Words of a window; they double further up to the longest passage.
SIZES = (24, 48, 96)
#: Words that are added up first; it divides half of every size.
STEP = 12
#: Directions of the latent space at most, and passages of a block.
RANK, BLOCK = 128, 256
#: Blocks that are broadcast at a time: documents are read once for every 32,768 passages.
BLOCKS_AT_ONCE = 128
#: A window's latent cosine with a candidate; what part of its weight must be benchmark words'; what a candidate must hold
#: of the passage's words in order, and of its key words.
COSINE, SHARE, LCS, KEYS = 0.5, 0.15, 0.6, 0.5
#: From this cosine on, what lies outside of the space counting against, a window may be a paraphrase; this share of the
#: passage's words in order is then enough.
PARAPHRASE, LCS_PARAPHRASE = 0.5, 0.3
#: Tasks that a product is added up from at most, and terms of a block of its rows.
TASKS, TERMS = 64, 512
#: Words running of a passage that make a window a candidate (a shorter passage's words all).
GRAM = 3

def sizes_to(longest: int) -> list[int]:
    """The windows' sizes for passages of up to so many words."""
    sizes = list(SIZES)
    while sizes[-1] < longest:
        sizes.append(2 * sizes[-1])
    return sizes


def _words(text: str | None) -> np.ndarray:
    data, offsets = fold(pa.array([text or ""]))
    s, e, _ = spans(data, offsets)
    return hash_spans(data, s, e) if len(s) else np.zeros(0, U)


# ---------------------------------------------------------------- latent space


def leading_directions(sketch: np.ndarray, normal, rank: int, power: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of the leading `rank` directions of a matrix A.

    sketch: A' times random columns; normal(q): A'Aq. A random range finder with power iterations, then a small exact
    decomposition of q'A'Aq.
    """
    q = np.linalg.qr(sketch)[0]
    for _ in range(power):
        q = np.linalg.qr(normal(q))[0]
    value, vector = np.linalg.eigh(q.T @ normal(q))
    value, vector = value[::-1][:rank], vector[:, ::-1][:, :rank]
    s = np.sqrt(np.maximum(value, 0))
    keep = s > 1e-6 * (s[0] if len(s) else 1)
    return s[keep], (q @ vector)[:, keep]


def randomised_svd(a: np.ndarray, rank: int, seed: int = 11, power: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, s, v of the leading `rank` directions of a matrix in memory."""
    k = min(rank + 8, *a.shape)
    s, v = leading_directions(a.T @ np.random.default_rng(seed).standard_normal((len(a), k)), lambda q: a.T @ (a @ q), rank, power)
    return a @ v / s, s, v.T


def _vectors(texts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, value, hash of the row's words) of texts' TF-IDF vectors of length one, by row and term."""
    row, term, value, names = [], [], [], []
    for i, text in enumerate(texts):
        w = _words(text)
        t, n = np.unique(terms_of(w), return_counts=True)
        x = np.sqrt(n) * idf[t]
        row.append(np.full(len(t), i))
        term.append(t)
        value.append(x / max(float(np.linalg.norm(x)), 1e-12))
        names.append(int(rolling(w, len(w), 7)[0]) if len(w) else 0)
    return (*(np.concatenate([np.zeros(0, k), *x]) for x, k in ((row, np.int64), (term, np.int64), (value, np.float64))), np.array(names, U))


def _product(shared, k: int, seed: int):
    """A task's share of A'Aq, or of A' times random columns where there is no q, in blocks of its rows."""

    def multiply(batches):
        idf, place, q = shared.value
        total = np.zeros((int(place.max()) + 1, k))
        for batch in batches:
            row, term, value, names = _vectors(batch.column("text").to_pylist(), idf)
            if not len(row):
                continue
            at = place[term]
            if q is None:
                # a passage's random numbers go with its words, wherever it lies
                side = np.stack([np.random.default_rng([seed, int(n)]).standard_normal(k) for n in names])
            else:
                side = np.zeros((batch.num_rows, k))
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                side[row[first]] = np.add.reduceat(q[at] * value[:, None], first)
            by = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.r_[True, at[by][1:] != at[by][:-1]])
            for lo in range(0, len(first), 4096):
                own = first[lo : lo + 4096]
                end = first[lo + 4096] if lo + 4096 < len(first) else len(by)
                some = by[own[0] : end]
                total[at[by][own]] += np.add.reduceat(side[row[some]] * value[some][:, None], own - own[0])
        for b in range(0, len(total), TERMS):
            if total[b : b + TERMS].any():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([total[b : b + TERMS].tobytes()], pa.binary())], names=["first", "sums"])

    return multiply


def _added(table: pa.Table) -> pa.Table:
    total = 0
    for x in table["sums"]:
        total = total + np.frombuffer(x.as_py())
    return pa.Table.from_arrays([table["first"][:1].combine_chunks(), pa.array([total.tobytes()], pa.binary())], names=["first", "sums"])


def _present(batches):
    for batch in batches:
        for text in batch.column("text").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(terms_of(_words(text))))], names=["term"])


class Space:
    """The latent space: where each term's row of `v` is (-1: no passage has the term)."""

    def __init__(self, idf: np.ndarray, place: np.ndarray, v: np.ndarray):
        self.idf, self.place, self.v = idf, place, v.astype(np.float32)

    def directions(self, texts) -> np.ndarray:
        """Texts as rows of the space, of length one (or zero)."""
        row, term, value, _ = _vectors(texts, self.idf)
        out = np.zeros((len(texts), self.v.shape[1]), np.float32)
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[first]] = np.add.reduceat(self.v[self.place[term]] * value[:, None], first)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def latent_space(items: DataFrame, idf: np.ndarray, rank: int, seed: int = 11) -> Space:
    """The space of passages (text): a randomised singular value decomposition by products that Spark adds up.

    The driver holds rank + 8 columns over the passages' hashed words, of which there are 2**18 at most.
    """
    spark = items.sparkSession
    texts = items.select("text").coalesce(TASKS)
    n = items.count()
    terms = np.array(sorted(r["term"] for r in texts.mapInArrow(_present, "term long").distinct().collect()), np.int64)
    place = np.full(len(idf), -1, np.int64)
    place[terms] = np.arange(len(terms))
    if not len(terms):
        return Space(idf, place, np.zeros((0, 1)))
    rank = min(rank, n)
    k = min(rank + 8, n, len(terms))

    def product(q: np.ndarray | None) -> np.ndarray:
        shared = spark.sparkContext.broadcast((idf, place, q))
        got = texts.mapInArrow(_product(shared, k, seed), "first long, sums binary").groupBy("first").applyInArrow(_added, "first long, sums binary").collect()
        out = np.zeros((len(terms), k))
        for r in got:
            sums = np.frombuffer(r["sums"]).reshape(-1, k)
            out[r["first"] : r["first"] + len(sums)] = sums
        shared.unpersist()
        return out

    _, v = leading_directions(product(None), product, rank)
    return Space(idf, place, v)


class Block:
    """Passages, their places in the latent space, and their key words."""

    def __init__(self, items: list[tuple[int, str, str | None]], space: Space):
        idf = space.idf
        self.items = [i for i, _, _ in items]
        self.words = [_words(t) for _, t, _ in items]
        self.q = space.directions([t for _, t, _ in items])
        size = np.array([len(w) for w in self.words])
        #: Passages go with the smallest windows that hold them.
        self.sizes = sizes_to(int(size.max()))
        self.scale = np.searchsorted(self.sizes, size)
        self.keys = []
        #: For each number of words running: their hashes, and the passages they stand in.
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        found: dict[int, list] = {}
        for k, ((_, _, answer), w) in enumerate(zip(items, self.words, strict=True)):
            key = _words(answer)
            u = np.unique(w)
            rare = u[np.argsort(-idf[terms_of(u)], kind="stable")[: max(1, len(u) // 3)]]
            self.keys.append(set((key if len(key) else rare).tolist()))
            if n := min(GRAM, len(w)):
                holds = np.r_[0, np.cumsum(np.isin(w, rare))]
                gram = np.unique(rolling(w, n, n)[holds[n:] > holds[:-n]])
                found.setdefault(n, []).append((gram, np.full(len(gram), k)))
        for n, each in found.items():
            self.grams[n] = np.concatenate([g for g, _ in each]), np.concatenate([k for _, k in each])


def _built(space):
    def build(table: pa.Table) -> pa.Table:
        items = sorted(zip(table["item_id"].to_pylist(), table["text"].to_pylist(), table["answer"].to_pylist(), strict=True), key=lambda x: (x[0], x[1], x[2] or ""))
        return pa.Table.from_arrays([pa.array([pickle.dumps(Block(items, space.value))], pa.binary())], names=["block"])

    return build


# ---------------------------------------------------------------- search


def common(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence, a row of bits at a time."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        u = row & where.get(y, 0)
        row = (row + u) | (row - u)
        row &= full
    return len(a) - row.bit_count()


def windows(begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of windows of `size` words that overlap by half and reach every text's end."""
    n = np.diff(begins)
    count = np.where(n > size, -(-(n - size) // (size // 2)) + 1, (n > 0).astype(np.int64))
    first = np.cumsum(count) - count
    row = np.repeat(np.arange(len(n)), count)
    start = begins[:-1][row] + np.minimum((np.arange(len(row)) - first[row]) * (size // 2), np.maximum(n[row] - size, 0))
    return start, np.minimum(start + size, begins[1:][row])


class Search:
    """The passages of some blocks in a row, and what finds them in texts."""

    def __init__(self, space: Space, blocks: list[Block], cosine: float, lcs: float, keys: float):
        self.space, self.latent, self.lcs, self.key_share = space, cosine, lcs, keys
        self.idf = space.idf.astype(np.float32)
        self.inside = space.place >= 0
        #: Terms' places in the space by weight; the last, which -1 finds, is nowhere.
        self.weighed = np.zeros((len(space.v) + 1, space.v.shape[1]), np.float32)
        term = np.flatnonzero(self.inside)
        self.weighed[space.place[term]] = space.v[space.place[term]] * self.idf[term, None]
        self.sizes = max((b.sizes for b in blocks), key=len)
        self.items = [i for b in blocks for i in b.items]
        self.words = [w for b in blocks for w in b.words]
        self.keys = [k for b in blocks for k in b.keys]
        self.q = np.concatenate([b.q for b in blocks])
        self.scale = np.concatenate([b.scale for b in blocks])
        begins = np.cumsum([0, *(len(b.items) for b in blocks)])
        #: For each size of window: its passages, and their places in the space.
        self.at = {int(s): np.flatnonzero(self.scale == s) for s in np.unique(self.scale)}
        self.seen = {s: np.ascontiguousarray(self.q[own].T) for s, own in self.at.items()}
        #: For each number of words running: sorted hashes, passage of each, and which leading bits occur.
        self.grams = {}
        for n in sorted({n for b in blocks for n in b.grams}):
            own = [(b.grams[n][0], b.grams[n][1] + lo) for b, lo in zip(blocks, begins, strict=False) if n in b.grams]
            gram, k = (np.concatenate(x) for x in zip(*own, strict=True))
            order = np.argsort(gram, kind="stable")
            some = np.zeros(1 << 20, bool)
            some[(gram >> U(44)).astype(np.int64)] = True
            self.grams[n] = gram[order], k[order], some

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(row, item, cosine, latent cosine, share in common) for the texts of a slice; the best of each row and item."""
        s, e, begins = spans(data, offsets)
        if not len(s):
            return []
        words = hash_spans(data, s, e)
        terms = terms_of(words)
        weight = self.idf[terms].astype(np.float64) ** 2
        inside = self.inside[terms]
        all_, own = np.r_[0, np.cumsum(weight)], np.r_[0, np.cumsum(weight * inside)]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        sums, first = self._sums(terms, begins)
        for scale in self.at:
            size = self.sizes[scale]
            start, end = windows(begins, size)
            norm = all_[end] - all_[start]
            near = np.flatnonzero(own[end] - own[start] >= SHARE * np.maximum(norm, 1e-9))
            for lo in range(0, len(near), 4096):
                at = near[lo : lo + 4096]
                row = np.searchsorted(begins, start[at], "right") - 1
                # from the step at or after the window's start to the one at or after its end
                a, b = (first[row] + -(-(x[at] - begins[row]) // STEP) for x in (start, end))
                z = (sums[b] - sums[a]).astype(np.float32)
                z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                for w, i in zip(*np.nonzero(z @ self.seen[scale] >= self.latent), strict=True):
                    self._verify(int(self.at[scale][i]), int(start[at[w]]), int(end[at[w]]), words, terms, begins, best)
        self._running(words, terms, begins, best)
        return [(r, i, *x) for (r, i), x in best.items()]

    def _sums(self, terms: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(running sums of the words' places in the space over steps of words, the first step of each text).

        A window's place is a difference of two of them, whatever its size. A text's last step may be a shorter one.
        """
        n = np.diff(begins)
        steps = -(-n // STEP)
        first = np.cumsum(steps) - steps
        place = np.full((int(steps.sum()), STEP), -1, np.int64)
        place.ravel()[np.arange(len(terms)) + np.repeat(first * STEP - begins[:-1], n)] = self.space.place[terms]
        sums = np.zeros((len(place) + 1, self.weighed.shape[1]))
        for lo in range(0, len(place), 2048):
            part = place[lo : lo + 2048]
            own = self.weighed[part[:, 0]]
            for j in range(1, STEP):
                own += self.weighed[part[:, j]]
            np.cumsum(own, axis=0, out=sums[lo + 1 : lo + 1 + len(part)])
            sums[lo + 1 : lo + 1 + len(part)] += sums[lo]
        return sums, first

    def _running(self, words, terms, begins, best) -> None:
        """Verifies the windows that hold words running of a passage."""
        sizes = np.array(self.sizes)
        for n, (gram, of_item, some) in self.grams.items():
            there = rolling(words, n, n)
            at = np.flatnonzero(some[(there >> U(44)).astype(np.int64)])
            lo, hi = np.searchsorted(gram, there[at]), np.searchsorted(gram, there[at], "right")
            row = np.searchsorted(begins, at, "right") - 1
            count = np.where(at + n <= begins[row + 1], hi - lo, 0)
            hit = np.repeat(np.arange(len(at)), count)
            if not len(hit):
                continue
            item = of_item[np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count) + lo[hit]]
            size = sizes[self.scale[item]]
            # the first of the windows that hold the place
            begin, end = begins[row[hit]], begins[row[hit] + 1]
            start = begin + np.minimum((at[hit] - begin) // (size // 2) * (size // 2), np.maximum(end - begin - size, 0))
            end = np.minimum(start + size, end)
            for k, a, b in np.unique(np.stack([item, start, end], axis=1), axis=0).tolist():
                self._verify(k, a, b, words, terms, begins, best)

    def _latent(self, terms: np.ndarray, k: int) -> float:
        """A window's cosine with a passage as seen through the latent space; what lies outside of it counts against."""
        term, count = np.unique(terms, return_counts=True)
        value = np.sqrt(count) * self.idf[term]
        own = self.inside[term]
        z = value[own] @ self.space.v[self.space.place[term[own]]]
        return float(z @ self.q[k] / np.sqrt(value @ value))

    def _plain(self, terms: np.ndarray, k: int) -> float:
        """The cosine of a window's and a passage's TF-IDF vectors."""
        (t, n), (u, m) = (np.unique(x, return_counts=True) for x in (terms, terms_of(self.words[k])))
        x, y = np.sqrt(n) * self.idf[t], np.sqrt(m) * self.idf[u]
        _, a, b = np.intersect1d(t, u, assume_unique=True, return_indices=True)
        return float(x[a] @ y[b] / np.sqrt((x @ x) * (y @ y)))

    def _verify(self, k: int, start: int, end: int, words, terms, begins, best) -> None:
        row = int(np.searchsorted(begins, start, "right")) - 1
        old = best.get((row, self.items[k]))
        if old and old[2] >= 1:
            return
        passage = self.words[k]
        lo, hi = max(int(begins[row]), start - len(passage)), min(int(begins[row + 1]), end + len(passage))
        there = words[lo:hi].tolist()
        keys = self.keys[k]
        found = len(keys.intersection(there))
        if found < self.key_share * len(keys):
            return
        share = common(passage.tolist(), there) / len(passage)
        if old and share <= old[2]:
            return
        latent = None
        if share < self.lcs:
            # a paraphrase: near in meaning, with some words in order and all key words
            if share < LCS_PARAPHRASE or found < len(keys):
                return
            latent = self._latent(terms[start:end], k)
            if latent < PARAPHRASE:
                return
        latent = self._latent(terms[start:end], k) if latent is None else latent
        best[row, self.items[k]] = self._plain(terms[start:end], k), latent, share


def _searched(search, only_clean: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("latent_cosine", pa.float64()), ("lcs_share", pa.float64())])

    def run(batches):
        own = search.value
        for batch in batches:
            data, offsets = fold(batch.column("text"))
            hits = []
            for lo, hi in parts(offsets):
                hits += [(lo + r, *x) for r, *x in own.slice(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])]
            if only_clean:
                clean = np.ones(batch.num_rows, bool)
                clean[[h[0] for h in hits]] = False
                yield batch.filter(pa.array(clean))
            elif hits:
                row, item, *rest = zip(*hits, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(item, pa.int64()), *(pa.array(x, pa.float64()) for x in rest)], schema=schema)
        give_back()

    return run


def _dealt(items: DataFrame) -> DataFrame:
    """items with their block: the number of a passage (repeated ones have the same) div BLOCK, counted part by part."""
    spark = items.sparkSession
    dealt = cut(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(pieces(items.count(), BLOCK)))))
    each = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count_distinct("item_id", "text").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in each)]).tolist()
    first = spark.createDataFrame([(p, n) for (p, _), n in zip(each, before, strict=False)] or [(0, 0)], "part long, first long")
    number = F.dense_rank().over(Window.partitionBy("part").orderBy("item_id", "text")) - 1 + F.col("first")
    return dealt.join(F.broadcast(first), "part").withColumn("block", F.floor(number / BLOCK)).drop("part", "first")


def _searches(docs: DataFrame, benchmark: DataFrame, rank: int, cosine: float, lcs: float, keys: float):
    """Broadcasts, one for each group of blocks: up to 32,768 passages' words and places in the space, and the space."""
    spark = docs.sparkSession
    n, df, _ = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 0.05
    answer = F.col("answer").cast("string") if "answer" in {c.lower() for c in benchmark.columns} else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer")).where(F.col("text").rlike(r"[\p{L}\p{N}]") & F.col("item_id").isNotNull())
    dealt = _dealt(items)
    space = spark.sparkContext.broadcast(latent_space(dealt, idf, rank))
    built = cut(dealt.groupBy("block").applyInArrow(_built(space), "block binary").withColumn("k", F.monotonically_increasing_id()))
    names = sorted(r["k"] for r in built.select("k").collect())
    for lo in range(0, len(names), BLOCKS_AT_ONCE):
        got = built.where(F.col("k").isin(names[lo : lo + BLOCKS_AT_ONCE])).collect()
        yield spark.sparkContext.broadcast(Search(space.value, [pickle.loads(r["block"]) for r in got], cosine, lcs, keys))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, cosine: float = COSINE, lcs: float = LCS, keys: float = KEYS) -> DataFrame:
    """One row per row of docs and benchmark passage found in it: doc_id, item_id, cosine (of the TF-IDF vectors),
    latent_cosine, lcs_share.

    Only doc_id and text, item_id, text and (where there is one) answer are read. A null or empty text, or a passage
    without a letter or digit or of null item_id, matches nothing. Rows of null doc_id match with doc_id null. Repeated
    rows of docs match each; a repeated passage counts once. No documents or no passages give no rows.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, item_id long, cosine double, latent_cosine double, lcs_share double"
    out = None
    for search in _searches(docs, benchmark, rank, cosine, lcs, keys):
        found = d.mapInArrow(_searched(search, False), kind)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], kind)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, cosine: float = COSINE, lcs: float = LCS, keys: float = KEYS) -> DataFrame:
    """The rows of docs, all columns, in whose text no benchmark passage was found."""
    for search in _searches(docs, benchmark, rank, cosine, lcs, keys):
        docs = docs.mapInArrow(_searched(search, True), docs.schema)
    return docs
