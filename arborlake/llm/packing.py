"""Packing documents into fixed-length sequences by cutting-stock column generation.

Each document's ids (and one closing id) are cut into whole sequences and one remainder. Remainders
are counted by length class; a linear program over patterns of classes is solved by column
generation, where a knapsack by dynamic programming prices new patterns. Patterns are used as often
as their rounded-down value says, a first-fit pass fills what rounding leaves (at most one basic
pattern's pieces for each class, whatever the input's size), and the patterns' places go to the
documents by their rank within the class.

The driver sees the histogram alone: one count for each class. Ranks are taken within (class, salt)
and shifted by the salts' counts, so a class that holds most documents is not one task.

Defined results: null text is empty, and an empty document is its closing id alone; every input row
is packed, repeated rows and null doc_ids too; columns other than id and text are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.llm.common import per_batch, stored

SEQUENCE, CLASS_WIDTH, CLOSING_ID = 1024, 4, 0

_encoders: dict[str, Encoder] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts by the tokenizer of a file.

    Where the file is a byte-level BPE with the plain pre-tokens, no normaliser and ids in the order of its
    merges, tiktoken gives the same ids from its vocabulary in a quarter of the time. Texts that hold an added
    token, and all texts of other files, go to the tokenizer itself.
    """

    #: Fixed value: the pre-tokens of byte-level tokenizers.
    pre_tokens = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and forked workers must not share a thread pool
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.apart = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.fast = self.twin(json.loads(self.tokenizer.to_str()))

    def twin(self, form: dict):
        """A tiktoken encoding with the same ids, or None."""
        model, cut = form["model"], form.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        if not plain or form.get("normalizer") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        vocab = model["vocab"]
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if len(vocab) != 256 + len(merged) or merged != list(range(256, len(vocab))):
            return None
        import tiktoken

        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in vocab.items()}
        return tiktoken.Encoding("byte_level", pat_str=self.pre_tokens, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        return [np.array(self.ids(t), "<u4").tobytes() for t in texts]

    def ids(self, text: str) -> list[int]:
        if self.fast is None or self.apart.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)}
    return [chr(b) if b in own else chr(256 + b - sum(o < b for o in own)) for b in range(256)]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: whole sequences, then the remainder, of each row."""

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoder(path).encode([x or "" for x in batch.column("text").to_pylist()])
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        row, start, length, crc, total = [], [], [], [], []
        for i, x in enumerate(ids):
            x += closing
            n = len(x) // 4
            for a in range(0, n, sequence):
                b = min(n, a + sequence)
                row.append(i)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(x[4 * a : 4 * b]))
                total.append(n)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(per_batch(pieces, size_of="text"), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(sizes: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: most dual value within the capacity. sizes ascend."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        value[room], choice[room] = value[room - 1], -1
        if k := fits[room]:
            gain = value[room - sizes[:k]] + duals[:k]
            best = int(gain.argmax())
            if gain[best] > value[room] + 1e-12:
                value[room], choice[room] = gain[best], best
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(value[capacity]), pattern


def inverse_of(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with partial pivoting, without a threaded library: those can hang in a driver that has forked."""
    m = len(matrix)
    work = np.concatenate([matrix.astype(float), np.eye(m)], axis=1)
    for k in range(m):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        if pivot != k:
            work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        used = np.flatnonzero(factor)
        work[used] -= factor[used, None] * work[k]
    return work[:, m:]


def times_vector(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def pattern_plan(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that cover the demand of each size exactly. The program, whose size does not follow the
    input, is solved until its value is within `gap` of the best lower bound that pricing has shown (the value over
    the best pattern's). Demands are shifted by less than one piece in all, so that no two bases tie and none recurs."""
    m = len(sizes)
    if not m:
        return []
    columns = np.diag(capacity // sizes).astype(float)  # each size alone, and above half the capacity with its best complement
    open_demand = demand.astype(float).copy()
    for k in range(m - 1, -1, -1):  # largest first, and only while the complement's demand lasts, so the basis is feasible
        times = open_demand[k] / columns[k, k]
        other = int(np.searchsorted(sizes, capacity - sizes[k] * (capacity // sizes[k]), "right")) - 1
        if 0 <= other < k and open_demand[other] >= times:
            columns[other, k] += 1
            open_demand[other] -= times
    inverse = inverse_of(columns)
    shifted = demand + np.random.default_rng(1).random(m) / m
    use, bound = np.maximum(times_vector(inverse, shifted), 0), 0.0
    for step in itertools.count():
        value, pattern = best_pattern(sizes, inverse.sum(axis=0), capacity)
        bound = max(bound, use.sum() / value)
        if use.sum() <= bound * (1 + gap):
            break
        direction = times_vector(inverse, pattern)
        able = direction > 1e-9
        ratio = np.where(able, use / np.where(able, direction, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = pattern
        if step % 64 == 63:
            inverse = inverse_of(columns)
        else:
            row = inverse[out] / direction[out]
            inverse -= np.outer(direction, row)
            inverse[out] = row
        use = np.maximum(times_vector(inverse, shifted), 0)
    use = np.maximum(times_vector(inverse, demand), 0)
    plan: list[tuple[np.ndarray, int]] = []
    left = demand.astype(np.int64).copy()
    for k in np.argsort(-use, kind="stable"):
        pattern = columns[:, k].astype(np.int64)
        had = pattern > 0
        times = min(int(use[k] + 1e-6), int((left[had] // pattern[had]).min()))
        if times > 0:
            plan.append((pattern, times))
            left -= times * pattern
    while left.any():  # fill one sequence after another, largest pieces first, as often as the rest allows
        pattern, room = np.zeros(m, np.int64), capacity
        for k in range(m - 1, -1, -1):
            if take := min(int(left[k]), room // int(sizes[k])):
                pattern[k] = take
                room -= take * int(sizes[k])
        had = pattern > 0
        times = int((left[had] // pattern[had]).min())
        plan.append((pattern, times))
        left -= times * pattern
    return plan


def places(sizes: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> dict[str, np.ndarray]:
    """For each (class, pattern) the first rank it serves, how many in each sequence, and where they stand."""
    found, base = [], 0
    served = np.zeros(len(sizes), np.int64)
    for pattern, times in plan:
        slot = 0
        for k in np.flatnonzero(pattern)[::-1]:
            found.append((int(sizes[k]), int(served[k]), int(pattern[k]), base, slot))
            served[k] += pattern[k] * times
            slot += int(pattern[k])
        base += times
    found.sort()
    table = np.array(found, np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 44) + table[:, 1], "first": table[:, 1], "each": table[:, 2], "base": table[:, 3], "slot": table[:, 4], "sequences": base}


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, width: int = CLASS_WIDTH, salts: int = 64) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece."""
    pieces = token_pieces(docs, path or tokenizer_path(), sequence)
    pieces = stored(pieces.withColumn("piece", F.monotonically_increasing_id()))
    rest = pieces.where(F.col("length") < sequence).withColumn("class", F.ceil(F.col("length") / width))
    histogram = sorted((r["class"], r["count"]) for r in rest.groupBy("class").count().collect())
    sizes, demand = np.array([c for c, _ in histogram], np.int64), np.array([n for _, n in histogram], np.float64)
    place = places(sizes, pattern_plan(sizes, demand, sequence // width))

    key = ("class", "salt")
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("piece"), F.lit(salts)))
    before = W.partitionBy("class").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    shift = rest.groupBy(*key).count().select(*key, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    ranked = rest.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy("piece")) - 1).join(shift, list(key))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("rank") + F.col("shift")).alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("rank").to_numpy()
            at = np.searchsorted(place["key"], (b.column("class").to_numpy() << 44) + rank, "right") - 1
            nth = rank - place["first"][at]
            each = place["each"][at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(place["base"][at] + nth // each), pa.array(place["slot"][at] + nth % each)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    placed = ranked.mapInArrow(assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    ahead = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0).cast("long")))
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    full = pieces.where(F.col("length") == sequence).withColumn("sequence_id", F.col("piece") + place["sequences"]).withColumn("offset", F.lit(0).cast("long"))
    return placed.select(*columns).unionByName(full.select(*columns))
