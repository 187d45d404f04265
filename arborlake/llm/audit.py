"""How filters interact: what each removes in every order of the five, from one look at each document.

A document's failures are a mask of five bits. A table of 32 masks by 120 orders, built once, says at which
step of each order a document goes; a task looks its rows up and counts, by part and label, the removals of
each order and step (np.bincount), and hands on one array for each part. The arrays are added up, and the
report follows from them: what fails a filter is what goes in an order that has it first, what fails it
alone goes where it is last.

Duplicates are found over the whole table by 128-bit digests of the texts, counted on the map side first. A
task holds up to `PARTS` arrays at a time; more parts are handed on early.

Defined results: null texts are empty, null parts the empty string; a row without or with null doc_id is
no duplicate and has no labels; rows of equal doc_id are documents each, and duplicates of smaller ids only;
a label counts if any row of `labels` has it; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import per_batch, stored, texts

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: The step (from 0) at which a document of a mask goes in an order; after the last step, it stays.
FIRST = np.array([[next((s for s, f in enumerate(o) if mask >> FILTERS.index(f) & 1), len(FILTERS)) for o in ORDERS] for mask in range(2 ** len(FILTERS))])
CELLS = len(ORDERS) * (len(FILTERS) + 1)
#: Arrays that a task holds at a time.
PARTS = 1024

_CAPITALS, _SIGNS, _FOLLOWING = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))


def failed(text: bytes) -> int:
    """The mask of A to D: few words, few distinct words, many capitals, signs."""
    words = text.split()
    capitals, points = len(text) - len(text.translate(None, _CAPITALS)), len(text.translate(None, _FOLLOWING))
    signs = len(text.translate(None, _SIGNS)) < len(text)
    return (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1 | (100 * capitals > 10 * points) << 2 | signs << 3


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, mask: a row for each document, with all five filters decided."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(failed(t), hashlib.blake2b(t, digest_size=16).digest()) for t in (t or b"" for t in texts(batch.column("text")))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array([m for m, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["doc_id", "part", "mask", "digest"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    rows = stored(chosen.mapInArrow(per_batch(step, size_of="text"), "doc_id long, part string, mask int, digest binary"))
    firsts = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(firsts, "digest", "left").select("doc_id", "part", (F.col("mask") + again.cast("int") * 16).alias("mask"))


def removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (part, mask, good, toxic): for each part how many of all, good and toxic go in each order at each step."""
    held: dict[str, np.ndarray] = {}

    def handed_on() -> pa.RecordBatch:
        columns = [pa.array([list(a[k]) for a in held.values()], pa.list_(pa.int64())) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *columns], names=["part", "removed", "good", "toxic"])

    at = np.arange(len(ORDERS)) * (len(FILTERS) + 1)
    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        code, names = parts.indices.to_numpy(), parts.dictionary.to_pylist()
        cells = FIRST[batch.column("mask").to_numpy()] + at + (code * CELLS)[:, None]
        chosen = [np.ones(batch.num_rows, bool), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic"))]
        counts = np.stack([np.bincount(cells[c].ravel(), minlength=len(names) * CELLS).reshape(len(names), CELLS) for c in chosen], axis=1)
        for name, found in zip(names, counts):
            held[name] = held[name] + found if name in held else found
            if len(held) >= PARTS:
                yield handed_on()
                held.clear()
    if held:
        yield handed_on()


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def reported(removed: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple]:
    """The rows of one part's report, from its summed arrays (orders by steps, and those that stay)."""
    steps = len(FILTERS)
    of_filter = {f: (sum(int(removed[k, o.index(f)]) for k, o in enumerate(ORDERS)), next(int(removed[k, 0]) for k, o in enumerate(ORDERS) if o[0] == f), next(int(removed[k, steps - 1]) for k, o in enumerate(ORDERS) if o[-1] == f)) for f in FILTERS}
    kept = removed.sum(axis=1, keepdims=True) - removed[:, :steps].cumsum(axis=1)
    for k, order in enumerate(ORDERS):
        for s, f in enumerate(order):
            total, fails, alone = of_filter[f]
            yield order, s + 1, int(kept[k, s]), int(removed[k, s]), fails - int(removed[k, s]), alone, int(good[k, s]), int(toxic[k, s]), total


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    has = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(has("quality").alias("good"), has("toxic").alias("toxic")).where("good or toxic")
    rows = failures(docs, part).join(known, "doc_id", "left").select("part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    partial = rows.mapInArrow(removals, "part string, removed array<long>, good array<long>, toxic array<long>")
    names = ("removed", "good", "toxic")
    cells = partial.select("part", F.posexplode(F.arrays_zip(*names)).alias("cell", "x")).groupBy("part", "cell").agg(*(F.sum(f"x.{c}").alias(c) for c in names))
    whole = cells.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("cell", *names))).alias("x"))  # as many cells for every part
    whole = whole.select("part", *(F.col(f"x.{c}").alias(c) for c in names))

    def report(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for name, *arrays in zip(*(batch.column(c).to_pylist() for c in ("part", *names))):
            out += [(name, *row) for row in reported(*(np.array(a).reshape(len(ORDERS), -1) for a in arrays))]
        types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=[c.split()[0] for c in REPORT.split(", ")])

    return whole.mapInArrow(per_batch(report), REPORT)
