"""Nearest neighbours by largest inner product, by collision-counting hashing.

Vectors are dealt to blocks of similar norm. Within a block they are extended by one component to equal norm,
which turns inner products into distances, and each of `projections` directions (random orthonormal bases, as
many as needed) keeps one sorted array of them. A query's windows, centred on its own projections, grow ring by
ring (virtual rehashing: only the new rings are counted) until at least `verify` of the block, or 3 k, collide
with it in `share` of the directions; these, and no others, are verified by their exact inner product on the
original vectors. The blocks' best k meet in one ranking.

A stretch of a sorted array is the difference of two of its prefixes. Prefixes are kept as sets of bits at
`MARKS` ranks of each array, so that a ring of one direction is counted for 64 vectors at a time, and for all
queries of a chunk together: bits are added up by carry-save adders, and the count is compared with the
threshold in place. The first width is where a few queries of the block come to their number.

Blocks hold up to `block` vectors and queries come in blocks too, so no task holds all of either; a candidate
is copied once for each `query_block` queries. Each query meets every block, so work grows as queries times
vectors, with a small constant.

Defined results: null, zero or non-finite vectors and null ids take no part; a query's candidates are the
vectors of its own length; rows that share a vec_id are candidates each, but never of their own id; an id given
twice is asked once (its least vector); ties go to the smaller vec_id; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.llm.common import stored

BLOCK, QUERY_BLOCK, PROJECTIONS = 8192, 16384, 160
#: Growth of the windows from ring to ring, queries whose windows are counted together, marks of a sorted array, queries that find the first width.
GROWTH, CHUNK, MARKS, TRIED = 1.06, 256, 128, 16


def directions(d: int, n: int, seed: int) -> np.ndarray:
    """n directions in d dimensions: whole orthonormal bases, as their projections add up to the distance."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.normal(size=(d, d)))[0].T for _ in range(-(-n // d))])[: max(n, d)]


def prefixes(order: np.ndarray, step: int) -> np.ndarray:
    """For each direction and mark the set of the vectors ahead of it in the direction's array, as bits."""
    m, n = order.shape
    words = -(-n // 64)
    marks = -(-n // step)
    out = np.zeros((m, marks + 1, words), np.uint64)
    at, bit = (np.arange(n) // step) * (words * 8), (1 << (order & 7)).astype(np.float64)
    for j in range(m):
        new = np.bincount(at + (order[j] >> 3), bit[j], marks * words * 8).astype(np.uint8).view(np.uint64).reshape(marks, words)
        np.bitwise_or.accumulate(new, axis=0, out=out[j, 1:])
    return out


class Counters:
    """Counts of bits, one counter for each bit place: plane k holds bit k of all counters, with at most two addends pending on each."""

    def __init__(self) -> None:
        self.planes: list[list[np.ndarray]] = []

    def add(self, bits: np.ndarray) -> None:
        level = 0
        while True:
            if level == len(self.planes):
                self.planes.append([])
            pending = self.planes[level]
            if len(pending) < 2:
                pending.append(bits)
                return
            a, b = pending
            half = a ^ b
            carry = (a & b) | (half & bits)
            self.planes[level] = [half ^ bits]
            bits, level = carry, level + 1

    def rows(self, chosen: np.ndarray) -> Counters:
        out = Counters()
        out.planes = [[x[chosen] for x in p] for p in self.planes]
        return out

    def at_least(self, limit: int) -> np.ndarray:
        """The places whose count is `limit` or more. What is pending is added up first."""
        carry, bits, level = None, [], 0
        while level < len(self.planes) or carry is not None:
            x = [*(self.planes[level] if level < len(self.planes) else ()), *(() if carry is None else (carry,))]
            carry = None
            if len(x) == 3:
                half = x[0] ^ x[1]
                bits.append(half ^ x[2])
                carry = (x[0] & x[1]) | (half & x[2])
            elif len(x) == 2:
                bits.append(x[0] ^ x[1])
                carry = x[0] & x[1]
            else:
                bits.append(x[0] if x else None)
            level += 1
        shape = next(b for b in bits if b is not None)
        more, equal = np.zeros_like(shape), ~np.zeros_like(shape)
        for level in range(max(len(bits), int(limit).bit_length()) - 1, -1, -1):
            b = bits[level] if level < len(bits) and bits[level] is not None else np.zeros_like(shape)
            if limit >> level & 1:
                equal &= b
            else:
                more |= equal & b
                equal &= ~b
        return more | equal


class Index:
    """The sorted arrays of one block."""

    def __init__(self, x: np.ndarray, projections: int, seed: int) -> None:
        n, d = x.shape
        square = np.einsum("ij,ij->i", x, x)
        self.top = np.sqrt(square.max())
        self.axes = directions(d + 1, projections, seed)
        hx = np.einsum("ij,kj->ki", x, self.axes[:, :d]) + self.axes[:, d:] * np.sqrt(np.maximum(self.top**2 - square, 0))
        self.sound = bool(np.isfinite(hx).all() and self.top > 0)
        order = hx.argsort(axis=1, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(hx, order, axis=1)
        self.n, self.step = n, max(1, n // MARKS)
        #: What lies ahead of each of these is nearer to the mark below than to the next one.
        self.between = np.ascontiguousarray(self.keys[:, self.step // 2 :: self.step])
        self.prefix = prefixes(order, self.step) if self.sound else None
        # Bits beyond n are in no prefix, so they collide with nothing.

    def projected(self, q: np.ndarray) -> np.ndarray:
        """Scaling a query changes no ranking; at the common norm its distances are the smallest."""
        return np.einsum("ij,kj->ki", q * (self.top / np.sqrt(np.einsum("ij,ij->i", q, q)))[:, None], self.axes[:, : q.shape[1]])

    def marks(self, hq: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """The marks nearest to the ends of the windows."""
        last = self.prefix.shape[1] - 1
        ends = np.concatenate([hq - width, hq + width], axis=1)
        ranks = np.stack([np.searchsorted(k, v) for k, v in zip(self.between, ends)])
        return np.minimum(ranks[:, : hq.shape[1]], last), np.minimum(ranks[:, hq.shape[1] :], last)

    def colliding(self, hq: np.ndarray, width: float, need: int, limit: int, once: bool = False) -> tuple[np.ndarray, float]:
        """For each query the vectors (bits) that collide with it in `limit` directions, at the first width that has `need` of them; the last width."""
        found = np.zeros((hq.shape[1], self.prefix.shape[2]), np.uint64)
        left, counts, lo, hi = np.arange(hq.shape[1]), Counters(), None, None
        while len(left):
            a, b = self.marks(hq[:, left], width)
            for j, bits in enumerate(self.prefix):
                if lo is None:
                    counts.add(bits[b[j]] ^ bits[a[j]])
                else:
                    counts.add((bits[lo[j]] ^ bits[a[j]]) | (bits[b[j]] ^ bits[hi[j]]))
            reached = counts.at_least(limit)
            done = np.bitwise_count(reached).sum(axis=1) >= need
            found[left[done]] = reached[done]
            if done.any() and once:
                break
            open_ = ~done
            left, counts, lo, hi, width = left[open_], counts.rows(open_), a[:, open_], b[:, open_], width * GROWTH
        return found, width


def search_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, verify: float, share: float, projections: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(queries, ids, inner products) of the best k of one block for each query, and how many products were computed."""
    n = len(x)
    need = min(n, k + 1 + max(2 * k, int(verify * n)))
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        index = Index(x, projections, seed) if need < n else None
        hq = index.projected(q) if index is not None and index.sound else None
    known = hq is not None and bool(np.isfinite(hq).all())
    limit = int(np.ceil(share * projections))
    width = 0.0
    if known:
        # The first of a few queries to come to its number tells where the windows begin.
        _, width = index.colliding(hq[:, :TRIED], 0.5 * float(np.median(np.abs(index.keys))), need, limit, once=True)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    products = 0
    for start in range(0, len(q), CHUNK):
        stop = min(len(q), start + CHUNK)
        if known:
            sets, _ = index.colliding(hq[:, start:stop], width, need, limit)
            chosen = np.unpackbits(sets.view(np.uint8), axis=1, bitorder="little", count=n).view(bool)
        for i in range(start, stop):
            at = np.flatnonzero(chosen[i - start]) if known else np.arange(n)
            at = at[ids[at] != qids[i]]
            score = np.einsum("ij,j->i", x[at], q[i])
            products += len(at)
            if len(at) > k:
                close = score >= np.partition(score, len(at) - k)[len(at) - k]
                at, score = at[close], score[close]
            best = np.lexsort((ids[at], -score))[:k]
            found.append((np.full(len(best), qids[i]), ids[at[best]], score[best]))
    return *(tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))), products


def nearest(vectors: DataFrame, asked, k: int = 20, verify: float = 0.03, share: float = 0.9, projections: int = PROJECTIONS, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. `asked` is a condition on vec_id that tells the queries."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    # Norms differ by at most a fifth within a class; a double's exponents bound the classes.
    norm = F.coalesce(F.floor(2 * F.log2(F.least(square, F.lit(1e308)))), F.lit(-9999)).cast("int")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0))
    # Rows of one id, or equal ones, go to all blocks: the deal is by row, and the written table keeps it.
    rows = stored(rows.withColumns({"d": F.size("v"), "norm": norm, "deal": F.xxhash64(F.monotonically_increasing_id())}))
    classes = [(r["d"], r["norm"], -(-r["count"] // block)) for r in rows.groupBy("d", "norm").count().orderBy("d", "norm").collect()]
    first = np.cumsum([0, *(n for _, _, n in classes)]).tolist()
    dealt = vectors.sparkSession.createDataFrame([(d, c, n, f) for (d, c, n), f in zip(classes, first)], "d int, norm int, n int, f int")  # a row for each class
    asking = rows.where(asked).groupBy("vec_id").agg(F.min(F.struct("v", "d")).alias("q")).select(F.col("vec_id").alias("id"), "q.*")
    query_blocks = max(1, -(-asking.count() // query_block))
    left = rows.join(F.broadcast(dealt), ["d", "norm"]).select((F.col("f") + F.pmod("deal", "n")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "vec_id", "v")
    of_length = dealt.groupBy("d").agg(F.min("f").alias("low"), F.max(F.col("f") + F.col("n")).alias("high"))
    right = asking.join(F.broadcast(of_length), "d").select(F.explode(F.expr("sequence(low, high - 1)")).alias("b"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(query_blocks)).cast("int").alias("qb"), "id", "v")

    def tile(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        q, i, s = (), (), ()
        if candidates.num_rows and queries.num_rows:
            plain = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            q, i, s, _ = search_block(candidates.column("vec_id").to_numpy(), plain(candidates), queries.column("id").to_numpy(), plain(queries), k, verify, share, projections)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    near = left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInArrow(tile, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
