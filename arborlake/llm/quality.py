"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct words hashed into buckets (weight 1/sqrt of how many there
are), binned structure statistics of the text, and its binned n_chars column (the metadata). The
score is sigmoid(w0 + w.x + (|V'x|^2 - sum of |v_i|^2 x_i^2) / 2): all pairwise interactions of rank
`RANK`, in time linear in the features.

The model is fitted on the driver by Adagrad, on at most `FIT_ROWS` labelled rows (those of least
doc_id hash), a documented bound; scoring covers every row. labels, lang, source and doc_id are never
features.

Defined results: null and empty texts have structure features only and get a score; repeated labels
each count; null labels are left out; without any label every score is 0.5; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import WordHashes, per_batch, texts

BUCKETS, RANK, FIT_ROWS, EPOCHS, BATCH = 1 << 14, 8, 6000, 12, 64
BINS, STATISTICS = 16, 11
SIZE = BUCKETS + BINS * (STATISTICS + 1)
KEEP = 0.3

_hashes = WordHashes()


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray


def _log_bin(x: float) -> int:
    return min(BINS - 1, int(np.log2(x + 1)))


def _share_bin(x: float) -> int:
    return min(BINS - 1, int(x * BINS))


def features(text: bytes | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one document."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    lower = text.lower()
    n = max(1, len(text))
    h = np.unique(_hashes.of(lower.split())) if words else np.zeros(0, np.uint64)
    raw = np.frombuffer(text, np.uint8)
    digits = int(((raw >= 48) & (raw <= 57)).sum())
    capital = int(((raw >= 65) & (raw <= 90)).sum())
    marks = int((((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 126))).sum())
    statistics = [
        _log_bin(len(words)),
        _log_bin(len(lines)),
        _share_bin(len(h) / max(1, len(words))),
        _share_bin(len(set(lines)) / max(1, len(lines))),
        _share_bin(4 * digits / n),
        _share_bin(4 * capital / n),
        _share_bin(4 * marks / n),
        min(BINS - 1, int(len(text) / max(1, len(words)))),
        _share_bin(sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines))),
        _share_bin(min(1.0, max(map(len, words), default=0) / 128)),
        _log_bin(len(text) / max(1, len(lines))),
        0 if n_chars is None or n_chars < 0 else _log_bin(n_chars),
    ]
    buckets, counts = np.unique(h % np.uint64(BUCKETS), return_counts=True)
    index = np.concatenate([buckets.astype(np.int64), BUCKETS + BINS * np.arange(STATISTICS + 1) + np.array(statistics)])
    value = np.concatenate([counts / np.sqrt(max(1, len(h))), np.ones(STATISTICS + 1)])
    return index, value.astype(np.float64)


def margins(model: Model, index: np.ndarray, value: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """w0 + w.x + pairs for rows that start at `start` (no row is empty), and the rows' V'x."""
    xv = model.v[index] * value[:, None]
    s = np.add.reduceat(xv, start, axis=0)
    pairs = 0.5 * ((s**2).sum(axis=1) - np.add.reduceat((xv**2).sum(axis=1), start))
    return model.w0 + np.add.reduceat(model.w[index] * value, start) + pairs, s


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7, rate: float = 0.1, decay: float = 1e-4) -> Model:
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK)))
    if not rows:
        return Model(0.0, model.w, np.zeros((SIZE, RANK)))
    g0, gw, gv = 1e-8, np.full(SIZE, 1e-8), np.full((SIZE, RANK), 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            index = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            sizes = np.array([len(rows[i][0]) for i in part])
            margin, s = margins(model, index, value, np.cumsum(sizes) - sizes)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) / len(part)
            e = np.repeat(error, sizes) * value
            used, at = np.unique(index, return_inverse=True)
            dw = np.bincount(at, e, len(used)) + decay * model.w[used]
            each = e[:, None] * (np.repeat(s, sizes, axis=0) - model.v[index] * value[:, None])
            dv = np.stack([np.bincount(at, each[:, k], len(used)) for k in range(RANK)], axis=1) + decay * model.v[used]
            g0 += error.sum() ** 2
            gw[used] += dw**2
            gv[used] += dv**2
            model.w0 -= rate * error.sum() / np.sqrt(g0)
            model.w[used] -= rate * dw / np.sqrt(gw[used])
            model.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
    return model


def _inputs(docs: DataFrame) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), n_chars.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model of labels.quality; `rows` bounds the labelled rows that are used, and so the driver's share."""
    chosen = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t, n) for t, n in zip(texts(batch.column("text")), batch.column("n_chars").to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], names=["doc_id", "quality", "i", "v"])

    rows_ = _inputs(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text", "n_chars")  # at most `rows` rows
    table = rows_.mapInArrow(per_batch(step, size_of="text"), "doc_id long, quality int, i binary, v binary").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    pairs = [(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64)) for i, v in zip(table.column("i").to_pylist(), table.column("v").to_pylist())]
    return train(pairs, np.array(table.column("quality").to_pylist(), np.float64))


def _scorer(docs: DataFrame, model: Model):
    """A function from texts and n_chars to scores; the model sent is of fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast((model.w0, model.w.astype(np.float32), model.v.astype(np.float32)))

    def scores(text: pa.Array, n_chars: list[int | None]) -> np.ndarray:
        if not len(text):
            return np.zeros(0)
        found = [features(t, n) for t, n in zip(texts(text), n_chars)]
        sizes = np.array([len(i) for i, _ in found])
        margin, _ = margins(Model(*sent.value), np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]), np.cumsum(sizes) - sizes)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    return scores


def score(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """doc_id, score, predicted: a row for each row of docs."""
    scores = _scorer(docs, model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = scores(batch.column("text"), batch.column("n_chars").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64()), pa.array((values >= keep).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return _inputs(docs).mapInArrow(per_batch(step, size_of="text"), "doc_id long, score double, predicted int")


def kept(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """The rows of docs that score at least `keep`, with all their columns; each row decides for itself, so nothing is shuffled."""
    scores = _scorer(docs, model)
    i, j = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_chars = [None] * batch.num_rows if j is None else batch.column(j).cast(pa.int64()).to_pylist()
        return batch.filter(pa.array(scores(batch.column(i).cast(pa.string()), n_chars) >= keep, pa.bool_()))

    return docs.mapInArrow(per_batch(step, size_of="text"), docs.schema)
