"""The pipeline against brute force, stage by stage and as a whole."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from test_dedup import classes, fingerprint, lines_kept

public_tokenizers = pytest.importorskip("public_tokenizers")


def corpus():
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choices("abcdefgh", k=3)) + rng.choice(["on", "er", "ly"])
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(12) for _ in range(4)]
    bench = [(k, line(25)) for k in range(5)]
    rows, toxic, leaks = [], set(), set()
    for k in range(160):
        lines = [line(rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
        if k % 4 == 0:
            # up to three insults, each between any two words of a line
            for _ in range(rng.randint(1, 3)):
                j = rng.randrange(len(lines))
                w = lines[j].split()
                w.insert(rng.randint(0, len(w)), rng.choice(["grumpf", "zlobo", "vexiform"]))
                lines[j] = " ".join(w)
            toxic.add(k)
        elif k % 7 == 0:
            lines[rng.randrange(len(lines)) : 0] = shared
        elif k % 11 == 0:
            lines.append(rng.choice(bench)[1])
            leaks.add(k)
        rows.append((k, "\n".join(lines)))
    rows += [(200 + k, rows[1][1] + " x" * (k % 2)) for k in range(10)] + [(300, ""), (301, None), (302, "one")]
    return rows, toxic, leaks, bench


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, toxic, leaks, bench = corpus()
    sf = str(tmp_path)
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d in toxic)) for d, _ in rows[:160]], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    want = {d: t for d, t in rows if d not in toxic}
    states = [dict(want)]
    kept = lines_kept(list(want.items()))
    want = {d: t if t is None else kept[d, t][2] for d, t in want.items()}
    states.append(dict(want))
    ids = sorted(want)
    fps = np.array([fingerprint(want[d]) for d in ids], np.uint64)
    label = classes(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    want = {ids[c]: want[ids[c]] for c in label}
    states.append(dict(want))
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    want = {d: t for d, t in want.items() if not any(plain(b) in plain(t) for _, b in bench)}
    states.append(dict(want))

    now = spark.read.parquet(f"{sf}/documents.parquet")
    for (name, stage), state in zip(corpus_pipeline.STAGES[:-1], states, strict=True):
        now = stage(spark, now, sf)
        now.write.parquet(f"{sf}/out-{name}")
        now = spark.read.parquet(f"{sf}/out-{name}")
        assert now.columns == docs.columns, name
        got = now.collect()
        assert {r.doc_id: r.text for r in got} == state and len(got) == len(state), name
        assert all(r.source == f"s{r.doc_id % 3}" and (r.text is None or r.n_chars == len(r.text)) for r in got), name
    assert leaks & set(states[2]) and not leaks & set(states[3])

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    packed = corpus_pipeline.run(spark, sf).collect()
    ids = {d: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for d, t in want.items()}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in packed} == {(d, a // 2048): zlib.crc32(x[a : a + 2048].tobytes()) for d, x in ids.items() for a in range(0, len(x), 2048)}
    used = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048


def test_pipeline_of_nothing(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).collect() == []
