"""Two versions of the same documents, met in one exchange: whole documents of both sides, many at a time, as Arrow columns.

Before the exchange, a batch's sentences of one document become one row: their cells column by column, compressed, so
what travels is a fraction of the text. Behind it, rows come in order of documents and sides; some SLICE bytes of
whole documents are laid out at a time, and what the sides have in common is found by numbers. Nothing larger than
a document of both sides and such a slice is held.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, ByteType, IntegerType, LongType, StringType, StructField, StructType, _parse_datatype_string

from arborlake.sources.cells import SLICE, Nodes, lists

_NUMBER = re.compile(r"\s*[+-]?[0-9]+\s*")


def number(text: str, other: int = 0) -> int:
    """A text as a 32-bit number, else `other`."""
    return value if _NUMBER.fullmatch(text) and abs(value := int(text)) < 1 << 31 else other


def numbers(texts: pa.Array) -> np.ndarray:
    """number() of each text; each different one is read once."""
    known = texts.dictionary_encode()
    return np.array([number(x) for x in known.dictionary.to_pylist()], np.int64)[np.asarray(known.indices, dtype=np.int64)] if len(texts) else np.zeros(0, np.int64)


def coded(a: pa.Array, b: pa.Array, change: Callable[[str], str] | None = None) -> tuple[np.ndarray, np.ndarray, list[str] | None]:
    """Both columns as numbers that are equal where the texts are; with `change`, where what it makes of them is, and what that is."""
    both = pa.concat_arrays([a, b]).dictionary_encode()
    code, values = np.asarray(both.indices, dtype=np.int64), None
    if change:
        place: dict[str, int] = {}
        code = np.array([place.setdefault(change(x), len(place)) for x in both.dictionary.to_pylist()], np.int64)[code] if len(code) else code
        values = list(place)
    return code[: len(a)], code[len(a) :], values


def _begins(rows: pa.Table | pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    """Where rows of another document than the row's before begin; nulls are alike."""
    out = np.zeros(rows.num_rows, bool)
    out[:1] = True
    for k in keys:
        values = rows.column(k)
        values = (values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values).dictionary_encode(null_encoding="encode")
        code = np.asarray(values.indices, dtype=np.int64)
        out[1:] |= code[1:] != code[:-1]
    return out


def packed(sentences: DataFrame, doc: tuple[str, ...], order: str, side: int, columns: tuple[str, ...], deps: Callable[[pa.Array, Nodes], pa.Array] | None = None, named: bool = False) -> DataFrame:
    """doc, side, orders, counts, names, size, cells: a row for the sentences of a document that stand together in a batch.

    `cells` are the chosen columns of all nodes but empty ones, compressed; `counts` how many nodes each sentence has. `deps`
    makes the column of that name of the texts and their nodes; `named`: with the sentences' names.
    """
    schema = StructType([
        *(sentences.schema[k] for k in doc), StructField("side", ByteType()), StructField("orders", ArrayType(sentences.schema[order].dataType)), StructField("counts", ArrayType(IntegerType())),
        StructField("names", ArrayType(StringType())), StructField("size", LongType()), StructField("cells", BinaryType()),
    ])

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column("raw").cast(pa.string())
        nodes = Nodes(raw)
        kept = ~nodes.empty
        begin = np.flatnonzero(_begins(batch, doc))
        bounds = np.append(begin, batch.num_rows)
        counts = np.bincount(nodes.of[kept], minlength=batch.num_rows)
        of_row = np.concatenate([[0], np.cumsum(counts)])[bounds]
        mask = pa.array(kept)
        made = {"deps": deps(raw, nodes)} if deps else {}
        texts = pc.binary_join_element_wise(*(pc.binary_join(lists(of_row, made.get(c, nodes[c]).filter(mask)), "\t") for c in columns), "\n")
        data = [x.encode() for x in texts.to_pylist()]
        names = pa.nulls(len(begin), pa.list_(pa.string()))
        if named:
            names = lists(bounds, names_of(nodes))
        first = pa.array(begin)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(k).take(first) for k in doc), pa.array(np.full(len(begin), side, np.int8)), lists(bounds, batch.column(order)), lists(bounds, pa.array(counts.astype(np.int32))), names,
             pa.array([len(x) for x in data], pa.int64()), pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in data], pa.binary())], names=schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            share = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole.column("raw")), 0), dtype=np.int64)) // SLICE
            cuts = [0, *(np.flatnonzero(np.diff(share)) + 1), whole.num_rows]
            yield from (pack(whole.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if a < b)

    return sentences.select(*doc, order, "raw").mapInArrow(run, schema)


def names_of(nodes: Nodes) -> pa.Array:
    """conllu.comment() of `sent_id` of each sentence."""
    pattern = r"\A#[\s\x0B]*sent_id[\s\x0B]*=[\s\x0B]*"
    comments, of = nodes.lines.filter(pa.array(nodes.comment)), nodes.all_of[nodes.comment]
    there = pc.match_substring_regex(comments, pattern)
    comments, of = comments.filter(there), of[np.asarray(there)]
    having, first = np.unique(of, return_index=True)
    at = np.full(nodes.sentences, -1)
    at[having] = first
    return pc.replace_substring_regex(comments, pattern, "").take(pa.array(at, mask=at < 0))


class Side:
    """One version's nodes (but empty ones) of some documents, in order of documents, sentences and lines.

    `doc` and `sent` number a node's document and sentence; `order` and `names` are the sentences'. `start` and `end` are places in
    the characters of the version's document, `ranged` tells words inside a range, `text` is what a node adds.
    """

    def __init__(self, rows: pa.Table, doc: np.ndarray, columns: tuple[str, ...]) -> None:
        of_row = np.asarray(pc.list_value_length(rows.column("counts").combine_chunks()), dtype=np.int64)
        counts = np.asarray(rows.column("counts").combine_chunks().flatten(), dtype=np.int64)
        self.order, names = rows.column("orders").combine_chunks().flatten(), rows.column("names").combine_chunks().flatten()
        self.sent_doc = np.repeat(doc, of_row)
        data = [pa.decompress(x, n, codec="zstd", asbytes=True) for x, n in zip(rows.column("cells").to_pylist(), rows.column("size").to_pylist())]
        total = np.bincount(np.repeat(np.arange(len(of_row)), of_row), counts, len(of_row)).astype(np.int64) if len(of_row) else np.zeros(0, np.int64)
        texts = pa.array([x for x, n in zip(data, total) if n], pa.binary()).cast(pa.string())
        flat = pc.split_pattern(texts, "\n").flatten()
        self.cells = {c: pc.split_pattern(flat.take(pa.array(np.arange(len(texts)) * len(columns) + i)), "\t").flatten() for i, c in enumerate(columns)}
        self.names = names if len(names) else pa.nulls(len(counts), pa.string())
        rank = np.asarray(pc.rank(self.order, tiebreaker="dense"), dtype=np.int64) if len(self.order) else np.zeros(0, np.int64)
        # A document's sentences may come in several rows, in any order.
        ahead = (self.sent_doc[1:] < self.sent_doc[:-1]) | ((self.sent_doc[1:] == self.sent_doc[:-1]) & (rank[1:] < rank[:-1]))
        if ahead.any():
            by = np.lexsort((rank, self.sent_doc))
            begin = np.cumsum(counts) - counts
            at = np.repeat(begin[by] - (np.cumsum(counts[by]) - counts[by]), counts[by]) + np.arange(counts.sum())
            self.cells = {c: x.take(pa.array(at)) for c, x in self.cells.items()}
            self.order, self.names, self.sent_doc, counts = self.order.take(pa.array(by)), self.names.take(pa.array(by)), self.sent_doc[by], counts[by]
        self.sent = np.repeat(np.arange(len(counts)), counts)
        self.doc = self.sent_doc[self.sent]
        self._lay_out()

    def __getitem__(self, column: str) -> pa.Array:
        return self.cells[column]

    def _lay_out(self) -> None:
        known = self["id"].dictionary_encode()
        parts = [x.partition("-") for x in known.dictionary.to_pylist()]
        of = np.array([(bool(dash), number(a), number(b.rpartition("-")[2]) if dash else 0) for a, dash, b in parts], np.int64).reshape(-1, 3)[np.asarray(known.indices, dtype=np.int64)]
        self.word, self.major, self.last = of[:, 0] == 0, of[:, 1], of[:, 2]
        at = np.arange(len(of))
        r = np.maximum.accumulate(np.where(self.word, -1, at)) if len(of) else at
        self.ranged = self.word & (r >= 0) & (self.sent[r] == self.sent) & (self.major >= self.major[r]) & (self.major <= self.last[r])
        text = self["form"]
        if pc.any(pc.match_substring_regex(text, r"\p{Zs}")).as_py():
            text = pc.replace_substring_regex(text, r"\p{Zs}", "")
        self.text = pc.if_else(pa.array(self.ranged), "", text) if self.ranged.any() else text
        self.length = np.asarray(pc.utf8_length(self.text), dtype=np.int64)
        before = np.cumsum(self.length) - self.length
        self.token = np.cumsum(~self.ranged) - 1
        self.first = np.flatnonzero(~self.ranged)  # the first node of each token
        _, begin, back = np.unique(self.doc, return_index=True, return_inverse=True)
        place = before - before[begin][back] if len(of) else before
        surface = self.first[self.token] if len(of) else at
        self.start, self.end = place[surface], place[surface] + self.length[surface]


def apart(a: Side, b: Side, docs: int) -> None:
    """Moves the places of both sides so that no two documents share one."""
    size = np.zeros(docs, np.int64)
    for side in (a, b):
        np.maximum.at(size, side.doc, side.end)
    base = np.cumsum(size + 1) - size - 1
    for side in (a, b):
        side.start, side.end = side.start + base[side.doc], side.end + base[side.doc]


def differing(a: Side, b: Side, docs: int) -> np.ndarray:
    """Which documents have other characters on the other side."""
    whole = [pc.binary_join(lists(np.concatenate([[0], np.cumsum(np.bincount(x.doc, minlength=docs))]), x.text), "") for x in (a, b)]
    return np.asarray(pc.not_equal(*whole))


def together(first: DataFrame, second: DataFrame, doc: tuple[str, ...], columns: tuple[tuple[str, ...], tuple[str, ...]], step: Callable[[pa.Table, Side, Side], pa.Table], schema: StructType) -> DataFrame:
    """What `step` makes of the documents (a table of doc) and both sides of packed()."""

    def laid(rows: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        of, side = np.cumsum(begins) - 1, np.asarray(rows.column("side"))
        sides = [Side(rows.filter(pa.array(side == k)), of[side == k], columns[k]) for k in (0, 1)]
        apart(*sides, int(begins.sum()))
        yield from step(rows.select(doc).take(pa.array(np.flatnonzero(begins))), *sides).select(schema.names).cast(arrow).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            begins = _begins(rows, doc)
            starts = np.flatnonzero(begins)
            if not len(starts):
                continue
            size = np.cumsum(np.asarray(rows.column("size"), dtype=np.int64))
            share = (size[starts] - np.asarray(rows.column("size"))[starts]) // SLICE
            cuts = [0, *starts[1:][np.diff(share) > 0], int(starts[-1])]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    yield from laid(rows.slice(a, b - a), begins[a:b])
            held = rows.slice(int(starts[-1]))
        if held is not None:
            yield from laid(held, _begins(held, doc))

    arrow = to_arrow_schema(schema)
    return first.unionByName(second).repartition(*doc).sortWithinPartitions(*doc, "side").mapInArrow(run, schema)


def schema_of(df: DataFrame, keys: tuple[str, ...], more: str) -> StructType:
    return StructType([*(df.schema[k] for k in keys), *_parse_datatype_string(more).fields])
