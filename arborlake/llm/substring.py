"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after . ! ? or a line break, with the white space that follows), and a sentence of
over `min_words` words further, after one word in SPACING, by its hash with the next word's, and between equal
words: cuts that depend on nothing but the words around them, so that two copies of a passage
are cut alike within, whatever it is glued to. These pieces count as sentences below. A run is the
least number of consecutive sentences that hold `min_words` words, forward from a sentence or back from one;
so runs cover every sentence of any repeated sequence of whole sentences with that many words together, be
they many short ones or a single long one. Runs are hashed (128 bits) over their lower-cased words and meet by hash over
all documents, and sentences covered by any run that is not the first of its hash, by (doc_id, position), are
removed. Sequences of fewer words stay, and so do the parts of sentences at a repeated passage's ends.

The table of runs goes once what is to be removed is known, and each join's shuffle files before the next.

The first of each hash is a minimum, aggregated on the map side, so a passage that many documents share
is never gathered; the join back brings one row for each hash and is left to AQE where a hash is hot.
Defined results: null and empty texts have no sentences and stay; a null doc_id takes no part; rows that
share a doc_id are taken as one document's copies and lose the same sentences; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import MULTIPLIER, WordHashes, dropped, mixed, per_batch, stored

#: Words between two cuts within a long sentence, on average.
SPACING = 6
#: Odd multipliers of the two polynomial hashes of a run.
MULTIPLIERS = (MULTIPLIER, 0xC2B2AE3D27D4EB4F)

_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?\n]+\s*|\Z)")
_WORD = re.compile(r"\s*\S+\s*")


def content_cuts(h: np.ndarray) -> np.ndarray:
    """For each word but the first, whether a cut by content stands before it."""
    return (h[:-1] == h[1:]) | (mixed(h[:-1] * np.uint64(MULTIPLIER) + h[1:]) % np.uint64(SPACING) == 0)


def sentences(text: str, min_words: int, hashes: WordHashes) -> list[str]:
    """Pieces that together are the text."""
    out = []
    for x in _SENTENCE.findall(text):
        if len(keys := x.lower().split()) > min_words:
            words, cuts = _WORD.findall(x), (np.flatnonzero(content_cuts(hashes.of(keys))) + 1).tolist()
            out += ["".join(words[a:b]) for a, b in zip([0, *cuts], [*cuts, len(words)])]
        elif x:
            out.append(x)
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def runs(texts: list[str | None], min_words: int, hashes: WordHashes) -> tuple[np.ndarray, ...]:
    """Text, first sentence, sentences and two hashes of every run of the texts; pieces without words belong to no run."""
    flat, sizes, owners = [], [], []
    for i, text in enumerate(texts):
        for x in _SENTENCE.findall(text or ""):
            if words := x.lower().split():
                flat += words
                sizes.append(len(words))
                owners.append(i)
    h, size, n = hashes.of(flat), np.array(sizes, np.int64), len(flat)
    long = np.repeat(size > min_words, size)
    cut = np.zeros(n, bool)
    if n:
        cut[1:] = long[1:] & content_cuts(h)
    cut[[0, *accumulate(sizes)][:-1]] = True
    at = np.append(np.flatnonzero(cut), n)
    owner = np.repeat(np.array(owners, np.int64), size)[at[:-1]]
    low, high = np.searchsorted(owner, owner, "left"), np.searchsorted(owner, owner, "right")
    piece = np.arange(len(owner))
    end, start = np.searchsorted(at, at[:-1] + min_words, "left"), np.searchsorted(at, at[1:] - min_words, "right") - 1
    pairs = np.concatenate([(piece * (len(at) + 1) + end)[end <= high], (start * (len(at) + 1) + piece + 1)[start >= low]])
    a, b = np.divmod(np.unique(pairs), len(at) + 1)
    found = []
    for m, values in zip(MULTIPLIERS, (h, mixed(h))):
        sums = np.append(np.uint64(0), np.cumsum(values * powers(m, n), dtype=np.uint64))
        found.append(mixed((sums[at[b]] - sums[at[a]]) * powers(pow(m, -1, 1 << 64), n + 1)[at[a]]).view(np.int64))
    return owner[a], a - low[a], b - a, *found


def without(text: str, later: list[tuple[int, int]], min_words: int, hashes: WordHashes) -> tuple[str, int]:
    """The text without the sentences of the runs (first sentence, sentences), and how many are removed."""
    pieces = sentences(text, min_words, hashes)
    real = [i for i, x in enumerate(pieces) if not x.isspace()]
    gone = {real[i] for a, n in later for i in range(a, a + n)}
    return "".join(x for i, x in enumerate(pieces) if i not in gone), len(gone)


def dedup(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """doc_id, text, n_removed: a row for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = step.__dict__.setdefault("hashes", WordHashes())
        owner, start, length, *h = runs(batch.column("text").to_pylist(), min_words, hashes)
        columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), *map(pa.array, h)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "hash", "hash2"])

    named = docs.where("doc_id IS NOT NULL")
    found = stored(named.mapInArrow(per_batch(step, size_of="text"), "doc_id long, start int, length int, hash long, hash2 long"))
    first = stored(found.groupBy("hash", "hash2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first")).where("n > 1").drop("n"))
    later = found.join(first, ["hash", "hash2"]).where(F.struct("doc_id", "start") > F.col("first"))
    gone = stored(later.groupBy("doc_id").agg(F.collect_set(F.struct("start", "length")).alias("later")))
    dropped(found)
    dropped(first)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = cut.__dict__.setdefault("hashes", WordHashes())
        rows = zip(batch.column("text").to_pylist(), batch.column("later").to_pylist())
        new = [without(t, [(x["start"], x["length"]) for x in s], min_words, hashes) if t and s else (t, 0) for t, s in rows]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t for t, _ in new], pa.string()), pa.array([n for _, n in new], pa.int64())], names=["doc_id", "text", "n_removed"])

    joined = docs.join(gone, "doc_id", "left").select("doc_id", "text", "later")
    return joined.mapInArrow(per_batch(cut, size_of="text"), "doc_id long, text string, n_removed long")
