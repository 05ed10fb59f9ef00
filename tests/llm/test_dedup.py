"""Substring, line, SimHash and embedding dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from tessera.llm.components import components
from tessera.llm.embedding_dedup import embedding_dedup
from tessera.llm.line_dedup import line_dedup
from tessera.llm.queries import op1_substring_dedup
from tessera.llm.simhash_dedup import one_of_each, simhash_dedup, tiles_of
from tessera.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, rest string, chunk string"


def corpus(seed=1, n=60):
    """Runs that repeat in other places, ties, empty, null and very long texts, repeated rows and null ids."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "é", "B.", "the", "of"]) + "".join(rng.choices("abcdeë", k=2))
    runs = [[word() for _ in range(rng.randint(5, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(runs) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 20))]
        rows.append((i * 3 % n, "".join(w + rng.choice([" ", "\n", "\t ", "\x0b", "  "]) for w in words), "en", None, "x"))
    hot = " ".join(runs[0] + runs[1])
    rows += [(n + k, hot, None, "r", None) for k in range(20)] + [(n + 30, "", "en", "", ""), (n + 31, None, None, None, None), (n + 32, " \n\t", "", "", ""), (n + 33, " ".join(word() for _ in range(9000)) + " " + hot, "", "", "")]
    rows += [rows[3], rows[3], (None, hot, "", "", ""), (None, hot, "", "", "")]
    return rows


def removed(rows, size=13):
    """Kept words of every row by the definition."""
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    first = {}
    for (d, *_), w in zip(rows, words):
        if d is not None:
            for s in range(len(w) - size + 1):
                k = tuple(w[s : s + size])
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, *_), w in zip(rows, words):
        gone = {s + j for s in range(len(w) - size + 1) if d is not None and first[tuple(w[s : s + size])] < d for j in range(size)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 3000, "bucket_keys": 300}, {"chunk_bytes": 2000, "bucket_keys": 100, "groups": 3}])
def test_substring_dedup_equals_brute_force(spark, sizes):
    rows = corpus()
    got = substring_dedup(spark.createDataFrame(rows, DOCS), **sizes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == removed(rows)
    for r in got:
        assert sum(s.end - s.start for s in r.removed_spans) == r.n_removed
        assert all(0 <= s.start < s.end <= r.n_words for s in r.removed_spans)
    assert sum(r.n_removed for r in got) > 300


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_op1_digest(spark, tmp_path):
    rows = corpus(2, 20)
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = op1_substring_dedup(spark, str(tmp_path)).collect()
    want = [(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in removed(rows)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def lines_kept(rows):
    """Of unique (id, text) rows, by the definition."""
    order = sorted((d, t) for d, t, *_ in rows if d is not None and t is not None)
    seen, out = set(), {}
    places = [(tuple(t.split("\n")), d, t) for d, t in order]
    for w, d, t in places:
        gone = set()
        for s in range(len(w) - 2):
            if w[s : s + 3] in seen:
                gone |= {s, s + 1, s + 2}
            seen.add(w[s : s + 3])
        out[d, t] = (len(w), len(gone), "\n".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 300, "bucket_keys": 20}, {"chunk_bytes": 200, "bucket_keys": 5, "groups": 2}])
def test_line_dedup_equals_brute_force(spark, sizes):
    rng = random.Random(5)
    line = ["", "one", "two é", "three", " four", "five"]
    rows = [(k, "\n".join(rng.choices(line, k=rng.randint(0, 12))), "en", str(k), "c") for k in range(60)] + [(99, None, None, None, None)]
    got = line_dedup(spark.createDataFrame(rows, DOCS), rest=["lang", "rest", "chunk"], **sizes).collect()
    want = lines_kept(rows)
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        if text[r.doc_id] is None:
            assert (r.kept_text, r.n_lines, r.n_removed) == (None, 0, 0)
        else:
            assert (r.n_lines, r.n_removed, r.kept_text) == want[r.doc_id, text[r.doc_id]]
            assert r.rest == str(r.doc_id) and r.chunk == "c"


def test_line_dedup_repeated_rows_and_null_ids(spark):
    rows = [(1, "a\nb\nc", None, None, None)] * 3 + [(None, "a\nb\nc", None, None, None)]
    got = line_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.kept_text) for r in got) == [("1", ""), ("1", ""), ("1", "a\nb\nc"), ("None", "a\nb\nc")]
    assert line_dedup(spark.createDataFrame([], DOCS)).collect() == []


def fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(near):
    label = np.arange(len(near))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_simhash_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        words = [rng.choice(["the", "Of"]) + str(rng.randint(0, 500)) for _ in range(rng.randint(1, 400))]
        for _ in range(rng.randint(1, 12)):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "x" + str(rng.randint(0, 9))
            rows.append((len(rows), rng.choice([" ", "\n"]).join(w), "", "", ""))
    rows += [(500, None, "", "", ""), (501, "", "", "", ""), (502, " ", "", "", "")]
    got = {r.doc_id: r for r in simhash_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    fps = np.array([fingerprint(t) for _, t, *_ in rows], np.uint64)
    label = classes(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    assert len(got) == len(rows)
    for (d, *_), f, c in zip(rows, fps, label):
        assert (got[d].fingerprint, got[d].component_id, got[d].kept) == (f"{int(f):016x}", rows[c][0], rows[c][0] == d)
    assert sorted(r.doc_id for r in one_of_each(spark.createDataFrame(rows, DOCS)).collect()) == sorted({rows[c][0] for c in label})


def test_simhash_null_ids_and_nothing(spark):
    got = simhash_dedup(spark.createDataFrame([(None, "a", "", "", ""), (4, "a", "", "", ""), (None, "b c d", "", "", "")], DOCS)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("4", "4", True), ("None", "4", False), ("None", "None", True)]
    assert simhash_dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_tiles_cover_every_population_count():
    places = tiles_of({30: 5, 31: 100, 32: 9, 33: 1}, 10)
    assert places[31][1] == 10 and len({k for f, n in places.values() for k in range(f, f + n)}) >= 11


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(4000, 4300)] + [(None, 1), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            if (x := todo.pop()) not in want:
                want[x] = start
                todo += near[x]
    assert got == want


@pytest.mark.parametrize("tile", [2048, 16])
def test_embedding_dedup_equals_brute_force(spark, tile):
    rng = np.random.default_rng(4)
    rows, base = [], rng.standard_normal((30, 16))
    for k in range(300):
        v = base[k % 30] * rng.uniform(0.5, 2) + rng.standard_normal(16) * rng.choice([0, 0.05, 0.12, 1.0])
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 3) if k % 11 else None))
    rows += [(400 + k, rows[5][1], rows[5][2]) for k in range(40)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] + [1.0] * 15, 1), (504, [float("inf")] * 16, 1), (505, [], 1), (506, [1.0, 2.0], 1), (507, [2.0, 4.0], 1)]
    kind = T.StructType().add("vec_id", "long").add(T.StructField("embedding", T.ArrayType(T.FloatType()))).add("label", "integer")
    got = {r.vec_id: r for r in embedding_dedup(spark.createDataFrame(rows, kind), tile=tile, leaf=32).collect()}

    def linked(a, b):
        if a is b or a[2] is None or a[2] != b[2] or not all(x and None not in x and np.isfinite(x).all() and np.any(x) for x in (a[1], b[1])) or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1]), np.array(b[1])
        return x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98

    near = np.array([[linked(a, b) for b in rows] for a in rows])
    label = classes(near | np.eye(len(rows), dtype=bool))
    assert len(got) == len(rows)
    for k, (r, c) in enumerate(zip(rows, label)):
        assert (got[r[0]].n_links, got[r[0]].component_id) == (near[k].sum(), rows[c][0])


def test_embedding_dedup_of_nothing(spark):
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_columns_with_the_operators_own_names(spark):
    rows = [(k, "one two three four five six" if k < 3 else f"text {k}", "i", 7, "f", 1, True, "t", "b") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _hash int, fingerprint string, component_id int, kept boolean, text_hash string, least string")
    stay = one_of_each(docs)
    assert stay.columns == docs.columns and sorted(r.doc_id for r in stay.collect()) == [0, 3, 4, 5]
    got = simhash_dedup(docs).collect()
    assert len(got) == 6 and {r.component_id for r in got if r.doc_id < 3} == {0}


def test_line_dedup_stage_with_the_operators_own_names(spark):
    import corpus_pipeline

    rows = [(k, "a\nb\nc\nd" if k < 2 else f"x{k}", "k", 5, 6, "r", 3, "c") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_text string, n_lines int, n_removed int, rest string, n_chars long, chunk string")
    out = corpus_pipeline.lines(spark, docs, "")
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == "a\nb\nc\nd" and got[1].text == "" and got[1].n_chars == 0
    assert all((r.kept_text, r.n_lines, r.n_removed, r.rest, r.chunk) == ("k", 5, 6, "r", "c") for r in got.values())


def test_embedding_dedup_of_odd_ids_and_extra_columns(spark):
    rows = [(1, [1.0, 0.0], 1, "n"), (1, [1.0, 0.0], 1, "n"), (1, [0.0, 1.0], 1, "n"), (None, [1.0, 0.0], 1, "n"), (2, [1.0, 0.01], 1, "n"), (3, [1.0, 0.0], None, "n")]
    got = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")).collect()
    assert len(got) == 6
    by = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got)
    # a null id is linked with nothing; the repeated row is a copy; the other vector of id 1 stands alone
    assert by == [("1", 0, "1"), ("1", 2, "1"), ("1", 2, "1"), ("2", 2, "1"), ("3", 0, "3"), ("None", 0, "None")]


def test_tiles_are_bounded_and_grow_in_number():
    from tessera.llm import simhash_dedup as sd

    for n in (10**4, 10**6, 10**8, 10**10):
        tile = max(sd.TILE, min(sd.MOST, -(-n // sd.TILES)))
        places = tiles_of({p: max(1, int(n * w)) for p, w in zip(range(24, 41), np.exp(-((np.arange(17) - 8) ** 2) / 32) / 10)}, tile)
        largest = max(-(-max(1, int(n * w)) // places[p][1]) for p, w in zip(range(24, 41), np.exp(-((np.arange(17) - 8) ** 2) / 32) / 10))
        assert largest <= sd.MOST and sum(k for _, k in places.values()) >= min(n // (2 * sd.MOST), 1)


def test_a_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from tessera.llm import common

    context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda *a: None), getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda p: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session)
    context.master = "local[4]"
    assert common.shared_dir(session)


def test_leaves_are_split_on_beyond_the_sample(spark):
    """A sample of 64 makes 8 leaves at most; 6,000 vectors need leaves that are split twice and more. Recall is exact here."""
    from tessera.llm import embedding_dedup as ed

    rng = np.random.default_rng(7)
    base = rng.standard_normal((2500, 24))
    x = np.concatenate([base, base[:2000] + rng.standard_normal((2000, 24)) * 0.08, rng.standard_normal((1500, 24))])
    rows = [(k, [float(np.float32(v)) for v in r], 1) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(df, sample=64, leaf=50, tile=64).collect()}
    y = np.array([r[1] for r in rows])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = y @ y.T >= 0.98
    want = classes(near)
    links = near.sum(axis=1) - 1
    linked = np.flatnonzero(links)
    assert len(linked) > 1000
    found = np.array([got[k] == (links[k], want[k]) for k in range(len(rows))])
    assert found[linked].mean() >= 0.95 and found.mean() >= 0.95
    # leaves are bounded: by splits at the medians of all rows
    vectors = df.selectExpr("label", "embedding as v", "size(embedding) as dim")
    drawn = np.array([r[1] for r in rows[:64]])
    drawn /= np.linalg.norm(drawn, axis=1, keepdims=True)
    margin = ed.SPILL * float(np.sqrt(2 - 2 * 0.98))
    forests = {24: [ed.Tree(drawn, 8, margin, t) for t in range(2)]}
    splits = ed.further_splits(vectors, forests, margin, 50)
    rows_, codes = ed._refined(y, *ed._coded(forests[24][0], y, 0), splits, margin)
    _, count = np.unique(codes, return_counts=True)
    assert count.max() <= 4 * 50 and max(c >> 20 for c in codes.tolist()) >= 4
    assert len(np.unique(rows_)) == len(y)


def test_rows_that_a_chunk_sends_stay_bounded(spark):
    """Ten times the input has ten times the chunks and buckets; a chunk still sends as many rows."""
    from pyspark.sql import functions as F

    from tessera.llm import firsts
    from tessera.llm import substring_dedup as sd

    rng = random.Random(9)
    most = {}
    for n in (60, 600):
        docs = spark.createDataFrame([(k, " ".join(str(rng.randrange(10**6)) for _ in range(200))) for k in range(n)], "doc_id long, text string")
        n_chunks, n_buckets = n // 6, n // 3
        way = firsts.Way(n_buckets, sd._ANCHORS, "chunk long, bucket long, entries binary", sd._HITS, "chunk long, bucket long, bits binary", 8)
        sent = firsts.chunked(docs, n_chunks).groupBy("chunk").applyInArrow(way.outbound(sd._send_anchors(13, n_buckets)), way.kind)
        most[n] = sent.groupBy("chunk").count().agg(F.max("count")).first()[0]
    assert most[60] <= 8 and most[600] <= 8


def test_stored_folders_are_cleared(spark):
    import os

    from tessera.llm import common

    common.clear(spark)
    df = common.stored(spark.range(10))
    (path,) = common._written[spark.sparkContext.applicationId]
    assert df.count() == 10 and os.path.isdir(path)
    assert common.clear(spark) == 1 and not os.path.exists(path) and common.clear(spark) == 0
