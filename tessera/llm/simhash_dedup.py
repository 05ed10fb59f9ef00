"""SimHash fingerprints and exact near-duplicates among them, tile by tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U, cut, give_back, pieces, utf8
from tessera.llm.components import Forest, components
from tessera.session import ship

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a tile at least and at most (16 MB), and tiles at most before tiles grow.
TILE, MOST, TILES = 4_096, 1 << 21, 48
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """The fingerprint of one text: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - k + 1)
    if n == 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], U)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size + 1) - size - 1
        end = (start + size)[k - 1 :]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start[:n].tolist(), end.tolist(), strict=True)), U, n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("text_hash", pa.int64())])
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        whole = data.tobytes()
        fps = np.array([fingerprint(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], U)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64), pa.int64()), batch.column("text_hash")], schema=schema)
    give_back()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash): the fingerprint of every row's whole text, as a signed 64-bit number."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash")).mapInArrow(_fingerprints, "doc_id long, fp long, text_hash long")


def _compare(a: np.ndarray, b: np.ndarray, radius: int, same: bool, found) -> None:
    """Calls found(i, j) with the positions of close pairs; a and b are sorted by population count."""
    pa_, pb = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    rows, cols = 32, 4096
    for i in range(0, len(a), rows):
        x = a[i : i + rows, None]
        lo = int(np.searchsorted(pb, pa_[i] - radius))
        hi = int(np.searchsorted(pb, pa_[min(i + rows, len(a)) - 1] + radius, "right"))
        for j in range(max(lo, i if same else 0), hi, cols):
            near = np.bitwise_count(x ^ b[None, j : min(j + cols, hi)]) <= radius
            if near.any():
                r, c = np.nonzero(near)
                found(r + i, c + j)


def _tile(table: pa.Table) -> pa.Table:
    fps = np.asarray(table["fp"].combine_chunks())
    return pa.Table.from_arrays([pa.array([table["tile"][0].as_py()], pa.int32()), pa.array([np.sort(fps).tobytes()], pa.binary())], names=["tile", "fps"])


def _tile_pair(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        sides = []
        for x in table.sort_by("tile")["fps"].to_pylist():
            fp = np.frombuffer(x, U)
            sides.append(fp[np.argsort(np.bitwise_count(fp), kind="stable")])
        node = np.concatenate(sides)
        forest = Forest(len(node))
        if len(sides) == 1:
            _compare(node, node, radius, True, forest.add)
        else:
            _compare(*sides, radius, False, lambda r, c: forest.add(r, c + len(sides[0])))
        links = np.array(forest.links, np.int64).reshape(-1, 2)
        node = node.view(np.int64)
        return pa.Table.from_arrays([pa.array(node[links[:, 0]], pa.int64()), pa.array(node[links[:, 1]], pa.int64())], schema=schema)

    return compare


def tiles_of(counts: dict[int, int], tile: int) -> dict[int, tuple[int, int]]:
    """For each population count its first tile and into how many tiles it is dealt."""
    out, number, room = {}, -1, 0
    for p in sorted(counts):
        if counts[p] <= room:
            room -= counts[p]
            out[p] = (number, 1)
            continue
        n = pieces(counts[p], tile)
        out[p] = (number + 1, n)
        number, room = number + n, max(0, tile - counts[p])
    return out


def near_fingerprints(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, tiles: int = TILES) -> DataFrame:
    """(node, component) of the distinct fingerprints fps(fp) that have another within `radius` bits; nodes are fingerprints.

    A tile is one row that holds its fingerprints, 16 MB at most; up to that size there are about `tiles` of them, so that
    each is sent to few tasks, and beyond it their number grows. Every pair of tiles whose population counts may lie
    within the radius is compared in full, in a task of its own; within it, rows are sorted by population count and
    stretches out of reach are skipped. A task gives a spanning forest of its links, not the links. Only the histogram of
    65 population counts comes to the driver.
    """
    spark = fps.sparkSession
    counts = {r["p"]: r["n"] for r in fps.groupBy(F.bit_count("fp").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    tile = max(tile, min(MOST, pieces(sum(counts.values()), tiles)))
    places = tiles_of(counts, tile)
    reach: dict[int, list[int]] = {}
    for p, (first, n) in places.items():
        for k in range(first, first + n):
            reach[k] = [min(p, reach.get(k, [p, p])[0]), max(p, reach.get(k, [p, p])[1])]
    # tiles stand in the order of their population counts, so that those in reach of one follow it in a row
    lowest = np.array([reach[k][0] for k in sorted(reach)])
    ends = [(k, int(np.searchsorted(lowest, reach[k][1] + radius, "right")) - 1) for k in sorted(reach)]
    # 65 population counts, and one row for each tile
    place = spark.createDataFrame([(p, f, n) for p, (f, n) in places.items()] or [(0, 0, 1)], "p int, first int, parts int")
    pairs = spark.createDataFrame(ends or [(0, 0)], "i int, last int").select("i", F.explode(F.sequence("i", "last")).alias("j"))
    meet = pairs.select(F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"), "i", "j")
    dealt = fps.withColumn("p", F.bit_count("fp")).join(F.broadcast(place), "p").select("fp", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).cast("int").alias("tile"))
    rows = dealt.groupBy("tile").applyInArrow(_tile, "tile int, fps binary")
    links = rows.join(meet, "tile").groupBy("i", "j").applyInArrow(_tile_pair(radius), "a long, b long")
    return components(links)


def simhash_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable), kept
    and text_hash.

    Only doc_id and text are read. A null or empty text has fingerprint zero and is linked like any other; equal
    fingerprints are compared once. kept marks the document that stays of each component, the one of the smallest
    doc_id (of rows that share it, the one of the smallest text_hash, the text's XXH64; rows that repeat both are one
    document). A null doc_id comes after all others: its component_id is null only where no row has an id. No rows give
    no rows.
    """
    fps = cut(fingerprints(docs))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
    distinct = cut(fps.groupBy("fp").agg(F.min(key).alias("least")))
    near = near_fingerprints(distinct.select("fp"), radius)
    named = distinct.join(near, distinct["fp"] == near["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("first"))
    of = named.join(least, "component").select("fp", "first")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("text_hash").eqNullSafe(F.col("first.text_hash"))
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"), kept.alias("kept"), "text_hash")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, that are kept of their components."""
    stay = simhash_dedup(docs, radius).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(stay, docs["doc_id"].cast("long").eqNullSafe(stay["_id"]) & (F.xxhash64(docs["text"].cast("string")) == stay["_hash"]), "left_semi")
