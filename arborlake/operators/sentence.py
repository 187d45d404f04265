"""Sentences as Python objects, for operators that walk trees and graphs: one row of text in, rows out, no shuffle.

What arrays and higher-order functions express stays in the JVM; searches over paths, bracket machines,
alignments and the ordered chain of checks run here, Arrow batch by Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

WORD, RANGE, EMPTY = re.compile(r"[1-9][0-9]*"), re.compile(r"([1-9][0-9]*)-([1-9][0-9]*)"), re.compile(r"([0-9]+)\.([1-9][0-9]*)")
Id = tuple[int, int]


def id_of(cell: str) -> Id:
    """An id or head as (word, empty)."""
    a, _, b = cell.partition(".")
    return int(a), int(b or 0)


def id_text(i: Id) -> str:
    return f"{i[0]}.{i[1]}" if i[1] else str(i[0])


def universal(deprel: str) -> str:
    return deprel.partition(":")[0]


def attributes(cell: str) -> list[tuple[str, str | None]]:
    """FEATS or MISC in order, repeated names kept; a flag has no value."""
    if cell == "_":
        return []
    out = []
    for part in cell.split("|"):
        name, equals, value = part.partition("=")
        out.append((name, value if equals else None))
    return out


def edge_list(cell: str) -> list[tuple[Id, str]]:
    """DEPS as (head, relation); raises ValueError where a part has no colon or its head no number."""
    if cell == "_":
        return []
    out = []
    for part in cell.split("|"):
        head, colon, deprel = part.partition(":")
        if not colon:
            raise ValueError(part)
        out.append((id_of(head), deprel))
    return out


class Node:
    """A line of ten cells. Words know their parent and children once a Tree holds them."""

    __slots__ = ("cells", "line", "kind", "id", "last", "parent", "children", "_feats", "_misc")

    def __init__(self, cells: list[str], line: int) -> None:
        self.cells, self.line = cells, line
        self.kind = "range" if "-" in cells[0] else "empty" if "." in cells[0] else "word"
        if self.kind == "range":
            a, b = cells[0].split("-")
            self.id, self.last = (int(a), 0), int(b)
        else:
            self.id = id_of(cells[0])
            self.last = self.id[0]
        self.parent: Node | None = None
        self.children: list[Node] = []
        self._feats: dict[str, str] | None = None
        self._misc: dict[str, str] | None = None

    def __getattr__(self, name: str) -> str:
        try:
            return self.cells[_AT[name]]
        except KeyError:
            raise AttributeError(name) from None

    @property
    def universal(self) -> str:
        return universal(self.cells[7])

    @property
    def features(self) -> dict[str, str]:
        if self._feats is None:
            self._feats = {k: v or "" for k, v in attributes(self.cells[5])}
        return self._feats

    @property
    def attributes(self) -> dict[str, str]:
        if self._misc is None:
            self._misc = {k: v or "" for k, v in attributes(self.cells[9])}
        return self._misc

    @property
    def edges(self) -> list[tuple[Id, str]]:
        return edge_list(self.cells[8])


_AT = {name: i for i, name in enumerate(("raw_id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"))}


class Tree:
    """A sentence's comments and nodes; `words` from 1, with `root` at 0. Heads must exist."""

    def __init__(self, raw: str) -> None:
        self.comments: list[str] = []
        self.nodes: list[Node] = []
        for line, text in enumerate(raw.split("\n"), 1):
            if text.startswith("#"):
                self.comments.append(text)
            elif text[:1].isdigit():
                self.nodes.append(Node(text.split("\t"), line))
        self.root = Node(["0", "", "", "", "", "_", "_", "", "_", "_"], 0)
        self.words = [self.root, *(n for n in self.nodes if n.kind == "word")]
        for n in self.words[1:]:
            if n.head.isdigit() and int(n.head) < len(self.words):
                n.parent = self.words[int(n.head)]
                n.parent.children.append(n)

    @property
    def enhanced(self) -> list[Node]:
        return [n for n in self.nodes if n.kind != "range"]

    def rendered(self) -> str:
        return "\n".join([*self.comments, *("\t".join(n.cells) for n in self.nodes)])


def per_sentence(df: DataFrame, keys: tuple[str, ...], step: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of `keys` and of what `step` yields for each sentence; `step` gets the columns of df that are not keys, in order."""
    others = [c for c in df.columns if c not in keys]
    key_types = StructType([df.schema[k] for k in keys])
    out_type = StructType([*key_types.fields, *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(out_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in (*keys, *others)]
            for values in zip(*columns):
                rows += [(*values[: len(keys)], *x) for x in step(*values[len(keys) :])]
            cells = list(zip(*rows)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(cells, arrow)], schema=arrow)

    return df.select(*keys, *others).mapInArrow(run, out_type)
