"""Language-model scores by a hidden Markov model over words.

Tokens are lower-cased (A-Z) words, then one end for each text. Training counts every word; Baum-Welch
then splits each word's count among latent states: in each of `ROUNDS` rounds every block runs `INNER` rounds
of its own from the common model, and the last one's expected counts are summed over all partitions, so that
few exchanges train as far as many rounds. A state's emission is (g * N / G + 1) / (N + V + 1), where g is the word's
count in the state, G the state's, N all tokens and V the vocabulary: it sums to one with the unknown
words, and with one state it is the add-one base. The scaled forward recursion gives exact likelihoods.

A block is a run of documents of up to `BLOCK_BYTES` of text (or one document) with its own dictionary,
frequent words first, so that its token numbers compress; a word meets its counts once for each block,
so frequent words are no hot keys, and no task or driver holds the whole vocabulary, which grows with
the input. Only the states' transitions (fixed size) are on the driver.

Defined results: null and empty texts are one end; rows with equal doc_id are scored alike, and each
counts; a null doc_id is held out of training and has null held_out; without training rows every word
is unknown; other columns are ignored; an empty table gives an empty table. Words are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import dropped, mixed, stored, texts

STATES, ROUNDS, INNER, BLOCK_BYTES, PIECE = 4, 2, 4, 32 << 20, 4096
END = 0x454E44

def state_shares(words: np.ndarray, states: int) -> np.ndarray:
    """A seeded split of each word's count among the states, to begin with."""
    x = np.stack([mixed(words + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for k in range(states)], axis=1)
    x = 0.5 + (x >> np.uint64(11)).astype(np.float64) / 2**53
    return x / x.sum(axis=1, keepdims=True)


def _layout(lengths: np.ndarray, piece: int) -> tuple[np.ndarray, ...]:
    """Texts are cut into pieces of up to `piece` tokens, which are stepped together, longest first.

    Returns each piece's text and number there, its row, and for each step how many pieces are that long and
    where its cells begin; then each cell's place among the tokens.
    """
    count = -(-lengths // piece)
    text = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(lengths[text] - nth * piece, piece)
    order = np.argsort(-size, kind="stable")
    row = np.empty(len(order), np.int64)
    row[order] = np.arange(len(order))
    active = np.searchsorted(-size[order], -np.arange(int(size[order[0]])), "left")
    offset = np.concatenate([[0], np.cumsum(active)])
    begin = ((np.cumsum(lengths) - lengths)[text] + nth * piece)[order]
    cell_row = np.arange(offset[-1]) - np.repeat(offset[:-1], active)
    return text, nth, row, active, offset, cell_row, begin[cell_row] + np.repeat(np.arange(len(active)), active)


def _across(cells: np.ndarray, move: np.ndarray, active: np.ndarray, offset: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For the pieces at `rows` (ascending) the matrix from the states ahead of the piece to its last state, up to a factor."""
    states = len(move)
    found = np.repeat(np.eye(states, dtype=cells.dtype)[:, :, None], len(rows), axis=2)
    for t in range(len(active)):
        a = int(np.searchsorted(rows, active[t]))
        if not a:
            break
        x = found[:, :, :a] if t == 0 else np.einsum("ijp,jk->ikp", found[:, :, :a], move)
        x = x * cells[None, :, offset[t] + rows[:a]]
        found[:, :, :a] = x / x.max(axis=(0, 1))
    return found


def forward(tokens: np.ndarray, lengths: np.ndarray, emission: np.ndarray, start: np.ndarray, move: np.ndarray, counts: bool, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray | None]:
    """log10 likelihood of each text; with `counts`, also expected emissions, starts and transitions.

    `tokens` holds the texts one after another; none is empty. The recursion is exact for texts of several
    pieces too: their pieces' matrices give the states at the pieces' ends first.
    """
    states = len(start)
    text, nth, row, active, offset, cell_row, at_token = _layout(lengths, piece)
    token = tokens[at_token]
    cells = np.ascontiguousarray(emission[token].T)
    ahead = np.repeat(start[:, None], len(row), axis=1)
    after = np.ones_like(ahead)
    follows = np.flatnonzero(nth > 0)
    before = np.zeros_like(ahead)
    if len(follows):
        long = np.unique(np.concatenate([follows, follows - 1]))
        rows = np.sort(row[long])
        across = _across(cells, move, active, offset, rows)
        matrix = {int(p): across[:, :, i] for p, i in zip(long, np.searchsorted(rows, row[long]))}
        for p in long.tolist():
            if nth[p]:
                before[:, row[p]] = end
                ahead[:, row[p]] = end @ move
            end = ahead[:, row[p]] @ matrix[p]
            end /= end.sum()
        for p in long[::-1].tolist():
            if p + 1 in matrix and nth[p + 1]:
                x = move @ (matrix[p + 1] @ after[:, row[p + 1]])
                after[:, row[p]] = x / x.max()
    scale = np.empty(len(token), cells.dtype)
    alpha = np.empty((states, len(token)), cells.dtype) if counts else None
    for t in range(len(active)):
        a, at = active[t], slice(offset[t], offset[t + 1])
        state = (ahead[:, :a] if t == 0 else move.T @ state[:, :a]) * cells[:, at]
        scale[at] = state.sum(axis=0)
        state /= scale[at]
        if counts:
            alpha[:, at] = state
    score = np.bincount(text, np.bincount(cell_row, np.log10(scale), len(row))[row], len(lengths))
    if not counts:
        return score, None, None, None
    moves, beta = np.zeros((states, states)), np.zeros((states, 0), cells.dtype)
    for t in range(len(active) - 1, -1, -1):
        a, at = active[t], slice(offset[t], offset[t + 1])
        full = after[:, :a].copy()
        full[:, : beta.shape[1]] = beta
        ending = slice(beta.shape[1], a)
        full[:, ending] /= (full[:, ending] * alpha[:, at][:, ending]).sum(axis=0)
        here = full * cells[:, at]
        here /= scale[at]
        moves += (alpha[:, offset[t - 1] : offset[t - 1] + a] if t else before[:, :a]) @ here.T
        alpha[:, at] *= full
        beta = move @ here
    emitted = np.stack([np.bincount(token, alpha[k], len(emission)) for k in range(states)], axis=1)
    return score, emitted, alpha[:, row[nth == 0]].sum(axis=1, dtype=float), moves * move


def squeezed(index: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte plane by byte plane."""
    return pa.compress(index.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


class Numbers(dict):
    """Word to its number, in order of first occurrence."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def blocks_of(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int | None, bool | None, np.ndarray]] = []
    numbers, held, number = Numbers(), 0, 0
    numbers[None]  # the end

    def block() -> pa.RecordBatch:
        index = np.concatenate([r[2] for r in rows])
        lengths = [len(r[2]) for r in rows]
        words = np.fromiter((END if w is None else xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
        order = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")
        place = np.empty(len(order), "<u4")
        place[order] = np.arange(len(order))
        words, index = words[order], place[index]
        learned = np.repeat([r[1] is False for r in rows], lengths)
        c = np.bincount(index[learned], minlength=len(words)).astype("<i8")
        cell = lambda v, t: pa.array([v], t)
        return pa.RecordBatch.from_arrays([cell((part << 32) + number, pa.int64()), cell([r[0] for r in rows], pa.list_(pa.int64())), cell([r[1] for r in rows], pa.list_(pa.bool_())), cell(lengths, pa.list_(pa.int64())), cell(squeezed(index), pa.binary()), cell(words.view(np.int64), pa.list_(pa.int64())), cell(c, pa.list_(pa.int64()))], names=["block", "ids", "held", "lengths", "tokens", "words", "counts"])

    for batch in batches:
        for doc_id, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), texts(batch.column("text"))):
            words = (text or b"").lower().split()
            rows.append((doc_id, out, np.fromiter(map(numbers.__getitem__, (*words, None)), np.int32, len(words) + 1)))
            held += len(text or b"") + 64
            if held >= BLOCK_BYTES:
                yield block()
                rows, held, number = [], 0, number + 1
                numbers.clear()
                numbers[None]
    if rows:
        yield block()


def emissions(g: np.ndarray, mass: np.ndarray, n: int, v: int) -> np.ndarray:
    """Each word's probability in each state, from its counts there and the states' totals."""
    return (g * (n / np.maximum(mass, 1e-300)) + 1) / (n + v + 1)


def smoothed(counts: np.ndarray) -> np.ndarray:
    return (counts + 1) / (counts.sum(axis=-1, keepdims=True) + counts.shape[-1])


def learned(tokens: np.ndarray, lengths: np.ndarray, c: np.ndarray, g: np.ndarray, mass: np.ndarray, start: np.ndarray, move: np.ndarray, n: int, v: int, inner: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts (words, starts, transitions) of a block after `inner` rounds on it.

    Between the rounds each word's count in the whole corpus, c, is split as the block's expectations split it.
    """
    for left in range(inner, 0, -1):
        single = (x.astype(np.float32) for x in (emissions(g, mass, n, v), start, move))
        _, emitted, starts, moves = forward(tokens, lengths, *single, True)
        if left > 1:
            of_word = emitted.sum(axis=1)
            g = np.where(of_word[:, None] > 0, emitted * (c / np.maximum(of_word, 1e-300))[:, None], g)
            mass, start, move = emitted.sum(axis=0) * (n / emitted.sum()), smoothed(starts), smoothed(moves)
    return emitted, starts, moves


def score(docs: DataFrame, held_out, states: int = STATES, rounds: int = ROUNDS, inner: int = INNER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. `held_out` is a condition on doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return blocks_of(batches, TaskContext.get().partitionId())

    # Block numbers are of partitions; the table is written, so a rerun reads the same blocks.
    blocks = stored(docs.mapInArrow(cut, "block long, ids array<long>, held array<boolean>, lengths array<long>, tokens binary, words array<long>, counts array<long>"))
    local = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select(F.col("block").alias("of_block"), "at", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    vocabulary = stored(local.groupBy("word").agg(F.sum("c").alias("c")).where("c > 0"))
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"]), int(total["v"])
    names = [f"g{k}" for k in range(states - 1)]  # the last state's counts are what is left of c
    body = blocks.select("block", "ids", "held", "lengths", "tokens")

    def run(model: DataFrame, mass: np.ndarray | None, start: np.ndarray, move: np.ndarray, learn: bool, schema: str) -> DataFrame:
        """One pass over the blocks with the words' state counts (none: the seeded split). A word's state counts add up to its count."""
        columns = ["c"] if mass is None else ["c", *names]
        rows = local.select("of_block", "at", "word").join(model.select("word", *columns), "word").select("of_block", "at", *(["word"] if learn or mass is None else []), *columns)

        def step(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            lengths = np.array(row["lengths"])
            tokens = unsqueezed(row["tokens"], int(lengths.sum()))
            at = right.column("at").to_numpy()
            g, c = np.zeros((int(tokens.max()) + 1, states)), np.zeros(int(tokens.max()) + 1)
            c[at] = right.column("c").to_numpy()
            if mass is None:
                whole = np.full(states, n / states)
                g[at] = state_shares(right.column("word").to_numpy().view(np.uint64), states) * c[at][:, None]
            else:
                whole = mass
                for k, name in enumerate(names):
                    g[at, k] = right.column(name).to_numpy()
                g[:, -1] = np.maximum(c - g[:, :-1].sum(axis=1), 0)
            if not learn:
                size = len(lengths)
                scores, _, _, _ = forward(tokens, lengths, emissions(g, whole, n, v), start, move, False)
                text = np.repeat(np.arange(size), lengths)
                base = np.bincount(text, np.log10((c + 1) / (n + v + 1))[tokens], size)
                known = np.bincount(text, c[tokens] > 0, size).astype(np.int64)
                return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(lengths, pa.int64()), "n_known": pa.array(known), "train_tokens": pa.array([n] * size, pa.int64()), "base_score": pa.array(base), "score": pa.array(scores)})
            chosen = np.array([h is False for h in row["held"]])
            keys, few, values, own = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, states - 1)), np.zeros(0, np.int64)
            if chosen.any():
                mine = tokens[np.repeat(chosen, lengths)]
                emitted, starts, moves = learned(mine, lengths[chosen], c, g, whole, start, move, n, v, inner)
                own = np.bincount(mine, minlength=len(c))[at]
                keys, values, own = right.column("word").to_numpy()[own > 0], emitted[at[own > 0], :-1], own[own > 0]
                few = np.concatenate([starts, moves.ravel()])  # they travel as rows without a word, in g0
            of_word = np.arange(len(keys) + len(few)) < len(keys)
            padded = np.zeros((len(of_word), states - 1), np.float32)
            padded[: len(keys)], padded[len(keys) :, 0] = values, few
            keys, kinds = np.concatenate([keys, np.zeros(len(few), np.int64)]), np.arange(len(of_word)) - len(keys)
            return pa.table({"word": pa.array(keys, mask=~of_word), "kind": pa.array(kinds.astype(np.int32), mask=of_word), "c": pa.array(np.concatenate([own, np.zeros(len(few), np.int64)])), **{m: pa.array(padded[:, k]) for k, m in enumerate(names)}})

        return body.groupBy("block").cogroup(rows.groupBy("of_block")).applyInArrow(step, schema)

    model, mass = vocabulary, None
    start = np.full(states, 1 / states)
    move = np.full((states, states), 0.5 / states) + np.eye(states) * 0.5
    sums = [F.sum(F.col(m).cast("double")).alias(m) for m in names]
    for _ in range(rounds if n else 0):
        # Few kinds, a row of each for each block, are no hot keys: they are added up on the map side first.
        found = run(model, mass, start, move, True, "word long, kind int, c long, " + ", ".join(f"{m} float" for m in names))
        found = stored(found.groupBy("word", "kind").agg(F.sum("c").alias("c"), *(s.cast("float").alias(m) for s, m in zip(sums, names))))
        few = np.array([r["g0"] for r in found.where("word is null").orderBy("kind").select("g0").collect()])
        dropped(model)
        model = found
        whole = model.where("word is not null").agg(*sums).first()
        mass = np.array([whole[m] for m in names])
        mass = np.append(mass, n - mass.sum())
        start, move = smoothed(few[:states]), smoothed(few[states:].reshape(states, states))
    return run(model, mass, start, move, False, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
