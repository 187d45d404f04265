"""Nodes of many sentences as Arrow columns: what a node's line decides alone is decided for a whole batch at once.

The rules are those of the expressions in `conllu` and `rewrites`, which stay for single columns; rows that a step
makes of a sentence keep its keys, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

from arborlake.sources.conllu import COLUMNS

#: Bytes of text that are worked on at a time.
SLICE = 8 << 20
_AT = {c: i for i, c in enumerate(COLUMNS)}


def lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def split(texts: pa.Array, by: str) -> tuple[np.ndarray, pa.Array]:
    """(number of the text, piece) of all pieces; a null has none."""
    pieces = pc.split_pattern(texts, by)
    return np.repeat(np.arange(len(texts)), np.asarray(pc.fill_null(pc.list_value_length(pieces), 0))), pieces.flatten()


def like(texts: pa.Array, pattern: str) -> np.ndarray:
    """Which texts match; each different one is tried once."""
    known = texts.dictionary_encode()
    return np.asarray(pc.match_substring_regex(known.dictionary, pattern))[np.asarray(known.indices, dtype=np.int64)]


def firsts(texts: pa.Array) -> np.ndarray:
    """The first byte of each text, 0 where it is empty; texts have no nulls."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    there = at[1:] > at[:-1]
    out = np.zeros(len(texts), np.uint8)
    out[there] = data[at[:-1][there]]
    return out


class Nodes:
    """The node lines of a batch of texts: `of` (the number of each one's sentence), `line`, cells by column (`_` where a line is short)."""

    def __init__(self, raw: pa.Array) -> None:
        self.sentences = len(raw)
        self.all_of, self.lines = split(raw, "\n")
        first = firsts(self.lines)
        self.comment, self.node = first == ord("#"), (first >= ord("0")) & (first <= ord("9"))
        self.foreign = np.unique(self.all_of[first >= 0x80])  # sentences with lines that begin beyond ASCII
        self.of = self.all_of[self.node]
        self.line = self.lines.filter(pa.array(self.node))
        cells = pc.split_pattern(self.line, "\t")
        self.many = np.asarray(pc.list_value_length(cells), dtype=np.int64)
        self._starts, self._flat = np.cumsum(self.many) - self.many, cells.flatten()
        self._kept: dict[str, pa.Array] = {}

    def __getitem__(self, column: str) -> pa.Array:
        if column not in self._kept:
            i = _AT[column]
            short = self.many <= i
            found = self._flat.take(pa.array(self._starts + i, mask=short if short.any() else None))
            self._kept[column] = pc.fill_null(found, "_") if short.any() else found
        return self._kept[column]

    @cached_property
    def ranged(self) -> np.ndarray:
        return np.asarray(pc.match_substring(self["id"], "-"))

    @cached_property
    def empty(self) -> np.ndarray:
        return np.asarray(pc.match_substring(self["id"], ".")) & ~self.ranged

    @cached_property
    def word(self) -> np.ndarray:
        return ~self.ranged & ~np.asarray(pc.match_substring(self["id"], "."))

    def rendered(self, changed: dict[str, pa.Array], kept: np.ndarray | None = None) -> pa.Array:
        """The texts again, comments before nodes (or those `kept`), with other cells in the columns of `changed`."""
        other = self.many != len(COLUMNS)
        for c, values in changed.items():
            other |= np.asarray(pc.not_equal(values, self[c]))
        line = self.line
        if other.any():
            at = pa.array(np.flatnonzero(other))
            line = pc.replace_with_mask(line, pa.array(other), pc.binary_join_element_wise(*(changed.get(c, self[c]).take(at) for c in COLUMNS), "\t"))
        own = self.of
        if kept is not None:
            own, line = own[kept], line.filter(pa.array(kept))
        of = np.concatenate([self.all_of[self.comment], own])
        order = np.argsort(of, kind="stable")
        text = pa.concat_arrays([self.lines.filter(pa.array(self.comment)), line]).take(pa.array(order))
        return pc.binary_join(lists(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=self.sentences))]), text), "\n")


def per_batch(df: DataFrame, keys: tuple[str, ...], step: Callable[[pa.Array], tuple[np.ndarray, list[pa.Array]]], schema: str) -> DataFrame:
    """Rows of `keys` and of what `step` makes of the texts of a batch of sentences (keys, raw): the number of each row's sentence, and the columns."""
    out_type = StructType([*(df.schema[k] for k in keys), *_parse_datatype_string(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            share = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole.column("raw")), 0), dtype=np.int64)) // SLICE
            cuts = [0, *(np.flatnonzero(np.diff(share)) + 1), whole.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    batch = whole.slice(a, b - a)
                    of, columns = step(batch.column("raw").cast(pa.string()))
                    at = pa.array(of)
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *columns], names=out_type.names)

    return df.select(*keys, "raw").mapInArrow(run, out_type)


def parted(edges: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Head and label of each edge; without a colon, both are the whole of it."""
    pieces = pc.split_pattern(edges, ":", max_splits=1)
    many = np.asarray(pc.list_value_length(pieces), dtype=np.int64)
    starts, flat = np.cumsum(many) - many, pieces.flatten()
    return flat.take(pa.array(starts)), flat.take(pa.array(starts + many - 1))


def sorted_edges(deps: pa.Array) -> pa.Array:
    """conllu.sorted_edges() of a column."""
    several = pc.match_substring(deps, "|")
    if not pc.any(several).as_py():
        return deps
    of, edges = split(deps.filter(several), "|")
    head, label = parted(edges)
    dotted = np.asarray(pc.match_substring(head, "."))
    a, b = head, np.zeros(len(edges), np.int64)
    if dotted.any():
        numbers = pc.split_pattern(head.filter(pa.array(dotted)), ".")
        a = pc.replace_with_mask(head, pa.array(dotted), pc.list_element(numbers, 0))
        b[dotted] = np.asarray(pc.list_element(pc.split_pattern(head.filter(pa.array(dotted)), ".", max_splits=1, reverse=True), 1).cast(pa.int64()))
    order = pc.sort_indices(pa.table({"of": of, "a": a.cast(pa.int64()), "b": b, "c": label, "v": edges}), sort_keys=[(k, "ascending") for k in ("of", "a", "b", "c", "v")])
    of, edges = of[np.asarray(order)], edges.take(order)
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | np.asarray(pc.not_equal(edges[1:], edges[:-1]))
    counts = np.bincount(of[new])
    return pc.replace_with_mask(deps, several, pc.binary_join(lists(np.concatenate([[0], np.cumsum(counts)]), edges.filter(pa.array(new))), "|"))


def table(df: DataFrame, keys: tuple[str, ...], *columns: str) -> DataFrame:
    """A row for each word of sentences (keys, raw): conllu.nodes_table() of these columns where kind is `word`."""

    def step(raw: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        nodes = Nodes(raw)
        word = nodes.word
        return nodes.of[word], [nodes[c].filter(pa.array(word)) for c in columns]

    return per_batch(df, keys, step, ", ".join(f"{c} string" for c in columns))
