"""Near-duplicate documents by fast similarity sketching.

Every document's set of distinct five-word shingles is sketched in rounds: in round i < t each
element falls into one of t bins by that round's hash with value i + h; in round t + j every element
falls into bin j. A bin keeps its least value, and the rounds of a set end when all its bins are
filled, so every coordinate fills. Coordinates are banded, bands that collide are compared by whole
sketches, and links are confirmed on the full sets.

No step emits all pairs of a group. Equal sets collapse to one class first. A bucket emits a spanning
forest of its sketch-similar members; the components of those forests hold every true link (up to the
miss rate below), and each component then emits a spanning forest of links confirmed on full sets.
Groups beyond a tile's size are compared tile against tile, so no task holds a whole group, and
buckets beyond `refine_over` members are split by the other bands that their members share.

Chances: `bands` is chosen so that a pair exactly at the threshold shares fewer than two bands with
probability at most 1e-6, as members of a bucket beyond `refine_over` meet only where they share a second
one; in smaller buckets one is enough, and the chance of none is below 1e-7. The sketch comparison rejects it beyond 5.5 standard deviations. Shingles are 64-bit
hashes of their words.

Defined results: null or wordless texts have no shingles and link with nothing; fewer words than a
shingle make one shingle of the whole sequence; repeated doc_ids are one node and keep one output row
per input row; a null doc_id takes no part, has a null component_id and is kept; columns other than
id and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import MULTIPLIER, WordHashes, grouped_runs, mixed, per_batch, stored, texts
from arborlake.llm.components import components

ROWS_PER_BAND = 5
#: Members and bytes of sets that one tile takes from each of its two blocks.
TILE_ROWS, TILE_BYTES = 1024, 16 << 20


def shingle_set(text: bytes | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    h = hashes.of(text.lower().split()) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    n = min(width, len(h))
    total = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        total *= np.uint64(MULTIPLIER)
        total += h[j : len(h) - n + 1 + j]
    return np.unique(mixed(total + np.uint64(n)))


def sketches(elements: np.ndarray, owner: np.ndarray, n_sets: int, t: int) -> np.ndarray:
    """(n_sets, t) coordinates; `owner` gives each element's set. Sets must not be empty."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    table = np.full(n_sets * t, empty)
    base = owner.astype(np.int64) * t
    for i in range(2 * t):
        x = mixed(elements + np.uint64((i + 1) * MULTIPLIER & 0xFFFFFFFFFFFFFFFF))
        where = (((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(table, base + where, (x & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32))
        open_sets = (table.reshape(n_sets, t) == empty).any(axis=1)
        if not open_sets.any():
            break
        if i < t:
            keep = open_sets[base // t]
            if not keep.all():
                elements, base = elements[keep], base[keep]
    return table.reshape(n_sets, t)


def band_keys(table: np.ndarray, rows: int = ROWS_PER_BAND) -> np.ndarray:
    bands = table.shape[1] // rows
    cut = table.reshape(len(table), bands, rows)
    key = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(table), 1), np.uint64)
    for j in range(rows):
        key = mixed(key * np.uint64(MULTIPLIER) + cut[:, :, j])
    return key.view(np.int64)


def bands_for(threshold: float, rows: int = ROWS_PER_BAND, miss: float = 1e-6) -> int:
    """The least number of bands of which a pair at the threshold shares fewer than two with probability at most `miss`."""
    p, n = threshold**rows, 2
    while (1 - p) ** n + n * p * (1 - p) ** (n - 1) > miss:
        n += 1
    return n


def near_duplicates(docs: DataFrame, numerator: int = 80, denominator: int = 100, width: int = 5, refine_over: int = 4096, tile_rows: int = TILE_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links are denominator * |A & B| >= numerator * |A | B|."""
    threshold = numerator / denominator
    bands = bands_for(threshold)
    t = bands * ROWS_PER_BAND
    cut = max(1, math.floor(t * threshold - 5.5 * math.sqrt(t * threshold * (1 - threshold))))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = sketch.__dict__.setdefault("hashes", WordHashes())
        sets = [shingle_set(x, hashes, width) for x in texts(batch.column("text"))]
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        digest = np.array([[xxhash.xxh3_64_intdigest(s.tobytes(), seed) for seed in (1, 2)] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
        keys, low = [None] * len(sets), [None] * len(sets)
        if len(full):
            table = sketches(np.concatenate([sets[i] for i in full]), np.repeat(np.arange(len(full)), sizes[full]), len(full), t)
            k, b = band_keys(table), mixed(table).astype(np.uint8)
            for j, i in enumerate(full):
                keys[i], low[i] = k[j], b[j].tobytes()
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "keys", "sketch"])

    rows = stored(docs.mapInArrow(per_batch(sketch, size_of="text"), "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, sketch binary"))
    able = rows.where("n_shingles > 0 and doc_id is not null")
    # One class for each set; hot classes are pre-aggregated on the map side.
    classes = stored(able.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")))
    copies = able.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = able.select(F.col("doc_id").alias("rep"), "d1", "d2", "keys", "sketch", "n_shingles").join(classes, ["rep", "d1", "d2"]).drop("d1", "d2")
    reps = stored(reps)

    member = reps.select("rep", F.explode("keys").alias("key"))
    shared = member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    member = stored(member.join(shared, "key"))
    large = member.where(F.col("size") > refine_over).join(reps.select("rep", "keys"), "rep")
    large = large.select("rep", "key", F.explode("keys").alias("other")).where("key <> other").select("rep", F.xxhash64("key", "other").alias("key"))
    large = large.join(large.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key")
    member = member.where(F.col("size") <= refine_over).unionByName(large)

    tiles = in_tiles(member.withColumn("blocks", F.ceil(F.col("size") / tile_rows)), "key").join(reps.select("rep", "sketch"), "rep")
    similar = by_tile(tiles.select("tile", "rep", "sketch"), lambda table: sketch_forest(table, cut), "a long, b long")
    groups = components(similar)

    # Full sets, of members of groups only; Spark broadcasts the members where their measured size allows.
    sized = groups.withColumnRenamed("id", "doc_id").join(reps.select(F.col("rep").alias("doc_id"), "n_shingles").groupBy("doc_id").agg(F.max("n_shingles").alias("n")), "doc_id")
    blocks = sized.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / tile_rows), F.ceil(F.sum("n") * 8 / TILE_BYTES)).alias("blocks"))
    members = stored(sized.join(blocks, "component").select("doc_id", "component", "blocks"))

    def full_set(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = full_set.__dict__.setdefault("hashes", WordHashes())
        sets = [shingle_set(x, hashes, width) for x in texts(batch.column("text"))]
        sizes = np.array([len(s) for s in sets], np.int64)
        low: list[bytes | None] = [None] * len(sets)
        if len(full := np.flatnonzero(sizes)):
            table = sketches(np.concatenate([sets[i] for i in full]), np.repeat(np.arange(len(full)), sizes[full]), len(full), t)
            for i, b in zip(full, mixed(table).astype(np.uint8)):
                low[i] = b.tobytes()
        return pa.RecordBatch.from_arrays([batch.column("component"), batch.column("blocks"), batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(low, pa.binary())], names=["component", "blocks", "rep", "elements", "sketch"])

    full = docs.join(members, "doc_id").mapInArrow(per_batch(full_set, size_of="text"), "component long, blocks long, rep long, elements binary, sketch binary").where("length(elements) > 0")
    tiles = in_tiles(full, "component").select("tile", "rep", "elements", "sketch")
    links = by_tile(tiles, lambda table: link_forest(table, cut, numerator, denominator), "a long, b long")
    linked = components(links.unionByName(copies))
    out = rows.select("doc_id", "n_shingles").join(linked.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), (F.col("component").isNull() | (F.col("component") == F.col("doc_id"))).alias("kept"))


def in_tiles(rows: DataFrame, group: str) -> DataFrame:
    """Adds `tile`: for each pair of a group's `blocks` a tile, which gets the rows of both. A group of one block is one tile."""
    block = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks"))
    rows = rows.withColumn("_block", block).withColumn("_other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return rows.withColumn("tile", F.xxhash64(group, F.least("_block", "_other"), F.greatest("_block", "_other"))).drop("_block", "_other")


def by_tile(rows: DataFrame, forest, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_runs(batches, "tile"):
            table = table.combine_chunks()
            tile = table.column("tile").to_numpy()
            edges = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
            found = [e for a, b in zip(edges, edges[1:]) if b - a > 1 for e in forest(table.slice(a, b - a))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, schema)


def forest_of(ids: np.ndarray, partners) -> Iterator[tuple[int, int]]:
    """Breadth-first spanning forest; partners(i, open) gives the open indices linked with i."""
    open_ = np.arange(len(ids))
    while len(open_) > 1:
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            i = queue.pop()
            hit = partners(i, open_)
            if hit.any():
                found = open_[hit]
                open_ = open_[~hit]
                queue.extend(found)
                yield from ((int(ids[i]), int(ids[j])) for j in found)


def sketch_matrix(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, -1)


def sketch_forest(table: pa.Table, cut: int) -> Iterator[tuple[int, int]]:
    low = sketch_matrix(table)
    return forest_of(table.column("rep").to_numpy(), lambda i, open_: (low[open_] == low[i]).sum(axis=1) >= cut)


def link_forest(table: pa.Table, cut: int, numerator: int, denominator: int) -> Iterator[tuple[int, int]]:
    low = sketch_matrix(table)
    sets = [np.frombuffer(x, np.uint64) for x in table.column("elements").to_pylist()]
    sizes = np.array([len(s) for s in sets], np.int64)
    _, index = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(index, np.cumsum(sizes)[:-1])
    flag = np.zeros(int(index.max()) + 1, bool)

    def partners(i: int, open_: np.ndarray) -> np.ndarray:
        hit = (low[open_] == low[i]).sum(axis=1) >= cut
        hit &= denominator * np.minimum(sizes[open_], sizes[i]) >= numerator * np.maximum(sizes[open_], sizes[i])
        flag[parts[i]] = True
        for k in np.flatnonzero(hit):
            j = open_[k]
            inter = int(np.count_nonzero(flag[parts[j]]))
            hit[k] = denominator * inter >= numerator * (int(sizes[i]) + int(sizes[j]) - inter)
        flag[parts[i]] = False
        return hit

    return forest_of(table.column("rep").to_numpy(), partners)
