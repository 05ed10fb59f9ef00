"""Packing and sharding: validity, exact tokens, nearness to the least possible."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.pack import CLASSES, ROUNDS, SHARES, fitted, pack, patterns_of, plan_of, rounded, token_pieces
from tessera.llm.queries import op5_best_fit_packing, op8_sharding
from tessera.llm.shard import shuffle_shards, write_shards

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, shard int, _bucket string, length int"


def placed(slots):
    """(sequence, offset, length) of every piece that a plan places."""
    return [(seq + r, off, x) for x, _, times, seq, off in slots for r in range(times)]


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    length = 256
    sizes = rng.integers(1, 257, 3000) if seed % 2 else np.minimum(256, rng.exponential(60, 3000).astype(int) + 1)
    if seed == 4:
        sizes = np.r_[np.full(1000, 100), sizes]
    h = np.bincount(sizes, minlength=length + 1)
    slots = plan_of(h, length)
    ranks = {}
    for x, first, times, _, _ in slots:
        assert first == ranks.get(x, 0)
        ranks[x] = first + times
    assert all(ranks.get(x, 0) == h[x] for x in range(1, length + 1))
    rows = placed(slots)
    used = {}
    for s, off, x in sorted(rows):
        assert off == used.get(s, 0)
        used[s] = off + x
    assert max(used.values()) <= length and sorted(used) == list(range(len(used)))
    # best fit decreasing, one piece after another
    gaps = []
    for x in sorted(sizes, reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= x]
        if fits:
            k = min(fits, key=gaps.__getitem__)
            gaps[k] -= x
        else:
            gaps.append(length - x)
    assert len(used) <= len(gaps) * 1.01 + 1
    assert plan_of(np.zeros(length + 1, np.int64), length) == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_fitted_patterns_place_most_pieces(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    h = np.zeros(2049, np.int64)
    for r in token_pieces(docs, keep_ids=False).groupBy("length").count().collect():
        h[r["length"]] = r["count"]
    plans = {}
    for times in (1, 10, 1000):
        patterns, left = fitted(h * times, 2048)
        placed_by = sum(n * len(p) for p, n in patterns.items() if len(p) > 1)
        assert placed_by + left.sum() + h[2048] * times == h.sum() * times
        assert placed_by > 0.8 * (placed_by + left.sum()), (sf, times)
        slots = plan_of(h * times, 2048)
        least = -(-int((h * np.arange(2049)).sum()) * times // 2048)
        assert least <= max(s[3] + s[2] for s in slots) <= 1.01 * least
        plans[times] = len(slots)
    # the plan goes with lengths and patterns, not with rows
    assert plans[1000] < 4 * (3 + 2 * SHARES) * CLASSES * ROUNDS and plans[1000] < 4 * plans[10]


def test_patterns_and_rounding():
    have = np.array([1, 5, 30, 64, 90, 100])
    patterns = patterns_of(np.bincount(have, minlength=129) * 7, 128)
    assert len(patterns) <= len(have) * (3 + 2 * SHARES) and (patterns.sum(axis=1) <= 128).all()
    assert set(patterns.ravel().tolist()) <= {0, *have.tolist()} and (patterns[:, 1] > 0).all()
    # a count spread over many patterns isn't rounded away, and no size is taken more often than it occurs
    patterns = np.array([[100, 28 - k, k, 0] for k in range(1, 11)])
    supply = np.full(129, 2)
    supply[100] = 3
    times = rounded(patterns, np.full(10, 0.3), supply)
    assert times.sum() == 3
    assert rounded(patterns, np.full(10, 0.3), np.zeros(129, np.int64)).sum() == 0


def test_repeated_rows_are_told_apart_by_place(spark):
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same row").alias("text"))
    got = pack(docs.repartition(7), keep_ids=False)
    row = got.agg(F.count("*").alias("n"), F.count_distinct("sequence_id", "offset").alias("places"), F.max("sequence_id").alias("last"), F.max("length").alias("size")).first()
    assert row.n == row.places == 100_000 and row.last + 1 == -(-100_000 // (2048 // row.size))


def texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("aeioubcdÄéßñ", k=rng.randint(1, 12)))
    out = [" ".join(word() for _ in range(rng.randint(0, 300))) for _ in range(40)]
    out += [None, "", " \n", "It's  THE\tend's'll", "e\u0301 \u0301x \u212b", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "日本語　テキスト x", "ΣΑΣ İı ǅ", "12 3.4%%", "x" * 5000, "🙂👍🏽 a\u200bb", "a\u2028b\x85c\x1cd", " ".join(word() for _ in range(9000))]
    return out


def test_tokens_equal_the_tokenizers(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    rows = [(k, t, 1, "b", 2) for k, t in enumerate(texts())] + [(None, "null id", 1, "", 0), (3, texts()[3], 1, "", 0)]
    got = pack(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    want = []
    for d, t, *_ in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(str(d), k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), ids[a : a + 2048].tobytes()) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == sorted(want)
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 1


def test_packing_of_nothing(spark):
    assert pack(spark.createDataFrame([], DOCS)).collect() == []


def test_a_length_that_all_rows_share(spark, tmp_path):
    spark.createDataFrame([(k, "same words in all rows") for k in range(5000)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op5_best_fit_packing(spark, str(tmp_path)).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 5000
    each = 2048 // got[0].length
    assert len({r.sequence_id for r in got}) == -(-5000 // each)


@pytest.mark.parametrize(("n", "bucket"), [(1000, 2000), (1000, 1 << 23), (23, 100), (0, 100)])
def test_shards(spark, n, bucket):
    rng = random.Random(n)
    rows = [(k if k % 9 else None, None if k % 7 == 0 else "t" * rng.randint(0, 30), k, "b", 3) for k in range(n)]
    rows = rows[: n // 2] * 2 if n == 1000 else rows
    df = spark.createDataFrame(rows, DOCS)
    out = shuffle_shards(df, 24, bucket_bytes=bucket)
    assert out.columns == ["doc_id", "text", "in_shard", "in__bucket", "length", "shard", "slot"]
    got = out.collect()
    assert sorted(map(str, [tuple(r)[:5] for r in got])) == sorted(map(str, rows))
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(k, ())) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1
    again = shuffle_shards(df.repartition(5), 24, bucket_bytes=bucket).collect()
    assert sorted(map(str, map(tuple, again))) == sorted(map(str, map(tuple, got)))


def test_order_is_mixed(spark):
    df = spark.createDataFrame([(k, "x", 0, "", 0) for k in range(2000)], DOCS)
    got = sorted(shuffle_shards(df, 2, bucket_bytes=4000).collect(), key=lambda r: (r.shard, r.slot))
    ids = np.array([r.doc_id for r in got])
    assert abs(np.corrcoef(ids, np.arange(2000))[0, 1]) < 0.1
    other = sorted(shuffle_shards(df, 2, seed=8, bucket_bytes=4000).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in other] != ids.tolist()


def test_op8_digest(spark, tmp_path):
    rows = [(1, "é"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in op8_sharding(spark, str(tmp_path)).collect()}
    assert got == {d: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "rows", None) for d, t in rows}


def test_rows_that_repeat_in_all_columns_go_to_many_buckets(spark):
    same = spark.range(200_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("copy").alias("text"))
    docs = same.union(spark.range(5_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text")))
    out = shuffle_shards(docs, 24, bucket_bytes=100_000)
    got = out.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last"), F.count("doc_id").alias("others")).collect()
    assert sum(r.n for r in got) == 205_000 and len(got) == 24
    assert all(r.n == r.slots == r.last + 1 for r in got) and max(r.n for r in got) - min(r.n for r in got) <= 1
    # both kinds are mixed
    assert min(r.others for r in got) > 0
    assert out.where("doc_id is not null").select("doc_id").distinct().count() == 5_000


def test_clashing_names_and_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, "t", 1, 2, "x") for k in range(50)], "doc_id long, text string, shard int, in_shard int, _Key string")
    out = shuffle_shards(docs, 4)
    assert out.columns == ["doc_id", "text", "in_in_shard", "in_shard", "in__Key", "shard", "slot"]
    assert {(r.in_in_shard, r.in_shard) for r in out.collect()} == {(1, 2)}
    back = write_shards(docs.select("doc_id", "text"), str(tmp_path / "out"), 4)
    assert sorted(r.doc_id for r in back.collect()) == list(range(50)) and back.select("shard").distinct().count() == 4


def test_the_records_are_exchanged_once(spark):
    docs = spark.createDataFrame([(k, "t" * 50) for k in range(500)], "doc_id long, text string")
    plan = shuffle_shards(docs, 24, bucket_bytes=4000)._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(_bucket" in line]
    assert len(wide) <= 3 and "RoundRobin" not in plan
