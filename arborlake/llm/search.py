"""Ranked lexical search by a threshold-seeded join: each item's k best documents, exactly.

A document's score for an item sums, over the item's terms with repeats, weight * impact, where the impact
grows with the term's count in the document and falls with the document's length. Of every term the k largest
impacts are stored. An item's kth score is at least the kth impact of any of its terms (times weight and
repeats): that is its threshold. Its terms are put in order of their largest possible share; a suffix whose
shares together stay below the threshold can not lift a document among the best, so only documents with a
term ahead of the suffix are candidates, and these alone are rescored in full, in 64-bit integers. A task
raises the thresholds by the kth scores that it has found itself, which are bounds as well.

Documents stay where they are: their terms' counts are written once, one row for each document, and meet the
items in tasks, so a frequent term is no hot key. Items come in blocks of up to `ENTRIES` terms (with repeats
as one), one pass over the counts for each block; only a block is broadcast. While items have up to
`VOCABULARY` terms, other terms of the documents are not written; beyond that all are. Terms are told apart
by 64-bit hashes.

Defined results: terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; null
and empty texts have none; rows of equal doc_id are documents each; a null doc_id comes after others of equal
score; rows of equal item_id (null too) are one item, with the least text; an item without terms, or whose
terms no document has, has no rows; other columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.llm.common import MEMO_ENTRIES, dropped, per_batch, stored, texts

VOCABULARY, ENTRIES = 1 << 22, 1 << 17
#: Cells of the tables of impacts that a task fills at a time.
TILE = 1 << 23

_TERMS = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


class TermHashes(dict):
    """Term to signed 64-bit hash, as far as `known` (sorted; none: all) has it, else None."""

    def __init__(self, known: np.ndarray | None = None) -> None:
        self.known = known

    def __missing__(self, term: bytes) -> int | None:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        value = int(np.uint64(xxhash.xxh64_intdigest(term)).astype(np.int64))
        if self.known is not None:
            at = int(np.searchsorted(self.known, value))
            value = value if at < len(self.known) and self.known[at] == value else None
        self[term] = value
        return value


def counted(rows: DataFrame, key: str, known: np.ndarray | None = None) -> DataFrame:
    """key, n (terms with repeats), terms (hashes), tfs, from rows (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TermHashes(known)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, terms, tfs, sizes = [], [], [], [0]
            for text in texts(batch.column("text")):
                found = (text or b"").translate(_TERMS).split()
                n.append(len(found))
                for term, tf in Counter(found).items():
                    if (h := hashes[term]) is not None:
                        terms.append(h)
                        tfs.append(tf)
                sizes.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int64())) for x in (terms, tfs)]
            return pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64()), *lists], names=[key, "n", "terms", "tfs"])

        yield from per_batch(step, size_of="text")(batches)

    return rows.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).mapInArrow(run, f"{key} long, n long, terms array<long>, tfs array<long>")


class Block:
    """The items of a block: entries (term, item, repeats), each term's weight and largest share, each item's threshold."""

    def __init__(self, items: list, entries: np.ndarray, threshold: np.ndarray) -> None:
        """entries: columns item (its place in `items`), term, repeats, weight, largest impact."""
        self.items = items
        item, term, q, weight, largest = entries
        self.terms, self.at = np.unique(term, return_inverse=True)
        self.weight = np.zeros(len(self.terms), np.int64)
        self.weight[self.at] = weight
        order = np.lexsort((q * weight * largest, item))
        self.item, self.at, self.q, share = item[order], self.at[order], q[order], (q * weight * largest)[order]
        self.begin = np.searchsorted(self.item, np.arange(len(items) + 1))
        # For each entry what it and the smaller ones of its item can add up to.
        total = np.concatenate([[0], np.cumsum(share)])
        self.reach = total[1:] - total[self.begin[self.item]]
        self.threshold = threshold.copy()
        self.by_term = np.argsort(self.at, kind="stable")

    def ahead(self) -> tuple[np.ndarray, np.ndarray]:
        """For each term where its entries ahead of the suffixes begin, and these entries' items."""
        chosen = self.by_term[(self.reach >= self.threshold[self.item])[self.by_term]]
        return np.searchsorted(self.at[chosen], np.arange(len(self.terms) + 1)), self.item[chosen]


def best_of(block: Block, batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    """item_id, doc_id, score: the k best of a task's documents for each item."""
    best: list[list[tuple[int, float, int | None]]] = [[] for _ in block.items]
    width = max(1, len(block.terms))
    for whole in batches:
        for start in range(0, whole.num_rows, max(1, TILE // width)):
            batch = whole.slice(start, max(1, TILE // width))
            doc, lists = batch.column("doc_id").to_pylist(), batch.column("terms")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            term, tf = lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
            at = np.minimum(np.searchsorted(block.terms, term), width - 1)
            known = block.terms[at] == term
            row, at, tf = row[known], at[known], tf[known]
            norm = 25 + (75 * batch.column("n").to_numpy() * n_docs) // n_terms
            table = np.zeros((batch.num_rows, width), np.int64)
            table[row, at] = block.weight[at] * ((10**9 * tf) // (1000 * tf + 8 * norm[row]))
            begin, items = block.ahead()
            times = np.diff(begin)[at]
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[at], times)
            candidate = np.zeros((len(block.items), batch.num_rows), bool)
            candidate[items[place], np.repeat(row, times)] = True
            for i in np.flatnonzero(candidate.any(axis=1)).tolist():
                chosen, own = np.flatnonzero(candidate[i]), slice(block.begin[i], block.begin[i + 1])
                score = (table[np.ix_(chosen, block.at[own])] * block.q[own]).sum(axis=1)
                good = np.flatnonzero(score >= max(1, block.threshold[i]))
                if len(good) > k:
                    good = good[score[good] >= np.partition(score[good], len(good) - k)[len(good) - k]]
                if len(good):
                    found = [(-int(score[j]), float("inf") if doc[chosen[j]] is None else doc[chosen[j]], doc[chosen[j]]) for j in good]
                    best[i] = sorted(best[i] + found, key=lambda x: x[:2])[:k]
                    if len(best[i]) == k:
                        block.threshold[i] = max(block.threshold[i], -best[i][-1][0])
    rows = [(block.items[i], d, -s) for i, found in enumerate(best) for s, _, d in found]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=["item_id", "doc_id", "score"])


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, vocabulary: int = VOCABULARY, entries: int = ENTRIES) -> DataFrame:
    """item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    asked = stored(counted(items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min(F.col("text").cast("string")).alias("text")), "item_id"))
    wanted = asked.select("item_id", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("item_id", F.col("x.terms").alias("term"), F.col("x.tfs").alias("q"))
    size, distinct = wanted.agg(F.count("*"), F.count_distinct("term")).first()
    known = None
    if distinct <= vocabulary:
        known = np.sort(np.array([r.term for r in wanted.select("term").distinct().collect()], np.int64))
    rows = stored(counted(docs, "doc_id", known))
    n_docs, n_terms = (int(x or 0) for x in rows.where("n > 0").agg(F.count("*"), F.sum("n")).first())
    if not n_terms or not size:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    # Of each term the documents that have it, and its k largest impacts; Spark keeps k of a term in each task.
    tf = F.col("x.tfs")
    norm = 25 + F.expr(f"(75 * n * {n_docs}L) div {n_terms}L")
    postings = rows.select(norm.alias("norm"), F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    impacts = postings.select(F.col("x.terms").alias("term"), F.expr("(1000000000L * x.tfs) div (1000L * x.tfs + 8L * norm)").alias("impact"))
    df = impacts.groupBy("term").agg(F.count("*").alias("df"))
    top = impacts.withColumn("rank", F.row_number().over(W.partitionBy("term").orderBy(F.desc("impact")))).where(F.col("rank") <= k)
    top = top.groupBy("term").agg(F.max("impact").alias("largest"), F.max(F.when(F.col("rank") == k, F.col("impact"))).alias("kth"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    terms = stored(df.join(top, "term").select("term", weight.alias("weight"), "largest", F.coalesce("kth", F.lit(0)).alias("kth")))
    blocks = -(-size // entries)
    wanted = stored(wanted.join(terms, "term").withColumn("block", F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(-1))), F.lit(blocks)).cast("int")))

    found = []
    for b in range(blocks):
        mine = wanted.where(F.col("block") == b).toPandas()
        if mine.empty:
            continue
        ids = [None if i is None or i != i else int(i) for i in mine.item_id.drop_duplicates().tolist()]
        place = {i: p for p, i in enumerate(ids)}
        item = np.array([place[None if i is None or i != i else int(i)] for i in mine.item_id.tolist()])
        columns = np.stack([item, *(mine[c].to_numpy(np.int64) for c in ("term", "q", "weight", "largest"))])
        threshold = np.zeros(len(ids), np.int64)
        np.maximum.at(threshold, item, (mine.q * mine.weight * mine.kth).to_numpy(np.int64))
        sent = spark.sparkContext.broadcast((ids, columns, threshold))
        found.append(rows.mapInArrow(lambda batches, sent=sent: best_of(Block(*sent.value), batches, n_docs, n_terms, k), "item_id long, doc_id long, score long"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    dropped(asked)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    every = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return every.select("item_id", "rank", "doc_id", "score")
