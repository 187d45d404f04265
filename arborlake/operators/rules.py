"""Rules of levels 2 and 3 as filters over rows of words: cells, and what a word, its parent and its children may be.

What needs no walk is decided by column expressions, or on Arrow columns of the words of many sentences. A word meets
its parent and its children within the sentence's row, so the rules take one scan and no shuffle; words that come as
rows are gathered by sentence first. Left to `checks`
are brackets, crossing edges, spans without gaps, text against forms, and the order in which a broken sentence stops
its later checks: the caller passes sentences that are sound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from arborlake.operators import columns
from arborlake.operators import lines as of_lines
from arborlake.operators.checks import CONTENT, DEPREL, ENHANCED_DEPREL, FEATURE, MISC_NAMES, ORPHAN_PARENTS
from arborlake.operators.sentence import universal
from arborlake.sources.cells import SLICE
from arborlake.sources.registry import RELATIONS, UPOS

#: What `content` reads of a word.
FIELDS = ("id", "head", "lemma", "upos", "feats", "deprel", "deps", "misc")


def lines(sentences: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Level 1 on sentences as text (raw, with the line that ends it): lines, columns, white space, ids. The node is the number of the line.

    Sentences are judged by batches, on columns of their lines, so this is one scan. Sentences of null text have no
    findings. Every rule is told, also where an earlier one would stop `checks`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_ in batches:
            for a, b in columns.batches(all_.column("raw"), SLICE):
                batch = all_.slice(a, b - a)
                for test, of, at in of_lines.found(batch.column("raw").cast(pa.string())):
                    if len(of):
                        same = lambda x, n=len(of): pa.repeat(pa.scalar(x), n)
                        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(of)) for k in keys), pa.array(at).cast(pa.string()), pa.repeat(pa.scalar(1, pa.int32()), len(of)), same("ERROR"), same(test)], names=[*keys, "node", "level", "type", "testid"])

    return sentences.select(*keys, "raw").mapInArrow(run, StructType([*(sentences.schema[k] for k in keys), *_parse_datatype_string(FOUND).fields]))


def depths(heads: Column) -> Column:
    """For the heads of the words 1, 2, ... each word's depth (1 below the root), null where the root does not reach it.

    Pointers are doubled: a step replaces each word's ancestor by that one's ancestor, so a tree of n words takes
    log2(n) + 1 steps, whatever its shape; what has not met the root by then is on a cycle, or hangs on one.
    """
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(heads), F.lit(2)))).cast("int"))
    begin = F.transform(heads, lambda h: F.struct(h.cast("int").alias("up"), F.lit(1).alias("far")))

    def step(s: Column, _: Column) -> Column:
        def jump(x: Column) -> Column:
            there = F.get(s, x["up"] - 1)
            return F.struct(F.when(x["up"] == 0, F.lit(0)).otherwise(there["up"]).alias("up"), F.when(x["up"] == 0, x["far"]).otherwise(x["far"] + there["far"]).alias("far"))

        return F.transform(s, jump)

    return F.transform(F.aggregate(steps, begin, step), lambda x: F.when(x["up"] == 0, x["far"]))


def trees(sentences: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """depth, n_unreached, n_roots, n_loops, max_children, verdict of sentences whose `words` are in order: what the tree rules of level 2 ask.

    verdict is the first of head-self-loop, multiple-roots, non-tree that fires, else null. A null head, or one that
    is no word, does not reach the root.
    """
    heads = F.transform("words", lambda w: w["head"])
    rows = sentences.select(*keys, heads.alias("_heads"), depths(heads).alias("_depths"))
    sorted_ = F.array_sort("_heads")  # children of one word are a run of equal heads
    at_end = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda i: ~F.get("_sorted", i).eqNullSafe(F.get("_sorted", i + 1)) & F.get("_sorted", i).isNotNull())
    rows = rows.withColumn("_sorted", sorted_).withColumn("_ends", F.when(F.size("_sorted") > 0, at_end).otherwise(F.array().cast("array<int>")))
    runs = F.transform("_ends", lambda x, k: x - F.coalesce(F.when(k > 0, F.get("_ends", k - 1)), F.lit(-1)))
    loops = F.size(F.filter(F.transform("_heads", lambda h, i: h == i + 1), lambda x: x))
    rows = rows.select(*keys, F.coalesce(F.array_max("_depths"), F.lit(0)).alias("depth"), F.size(F.filter("_depths", lambda d: d.isNull())).alias("n_unreached"), F.size(F.filter("_heads", lambda h: h == 0)).alias("n_roots"), loops.alias("n_loops"), F.coalesce(F.array_max(runs), F.lit(0)).alias("max_children"))
    return rows.withColumn("verdict", F.when(F.col("n_loops") > 0, "head-self-loop").when(F.col("n_roots") > 1, "multiple-roots").when(F.col("n_unreached") > 0, "non-tree"))


def _unsorted(values: list) -> bool:
    return values != sorted(values)


def _twice(values: list) -> bool:
    return len(set(values)) < len(values)


def _of_feats(cell: str) -> Iterator[str]:
    parts = [] if cell == "_" else cell.split("|")
    sound = [f for f in parts if FEATURE.fullmatch(f)]
    values = [f.rpartition("=")[2].split(",") for f in sound]
    lower = lambda a: [x.lower() for x in a]
    yield from _told({
        "unsorted-features": _unsorted(lower(parts)), "invalid-feature": len(sound) < len(parts), "repeated-feature-value": any(map(_twice, values)),
        "unsorted-feature-values": any(_unsorted(lower(v)) for v in values), "repeated-feature": _twice([f.partition("=")[0] for f in parts]),
    })


def _edges(cell: str) -> list[tuple[str, str]]:
    return [] if cell == "_" else [(head, deprel if colon else head) for head, colon, deprel in (x.partition(":") for x in cell.split("|"))]


def _of_deps(cell: str) -> Iterator[str]:
    listed = _edges(cell)
    key = [(of_lines.number(h.partition(".")[0]), of_lines.number(h.rpartition(".")[2]) if "." in h else 0, d) for h, d in listed]
    heads = [k[:2] for k in key]
    sound = [bool(ENHANCED_DEPREL.fullmatch(d)) for _, d in listed]
    yield from _told({
        "unsorted-deps": _unsorted(heads), "unsorted-deps-2": not _unsorted(heads) and _unsorted(key), "repeated-deps": not _unsorted(heads) and _twice(key),
        "invalid-edeprel": not all(sound), "unknown-eudeprel": any(ok and universal(d) not in RELATIONS and universal(d) != "ref" for ok, (_, d) in zip(sound, listed)),
    })


def _of_misc(cell: str) -> Iterator[str]:
    listed = [] if cell == "_" else [x.partition("=") for x in cell.split("|") if x]
    names = [n for n, _, _ in listed]
    yield from _told({
        "misc-attr-typo": any(n not in MISC_NAMES and n.strip(" ").lower() in _MISC_LOWER for n in names), "repeated-misc": _twice([n for n in names if n in MISC_NAMES]),
        "misc-extra-space": any(x != x.strip(" ") for n, _, v in listed for x in (n, v)),
    })


def _told(tests: dict[str, bool]) -> Iterator[str]:
    return (t for t, broken in tests.items() if broken)


_MISC_LOWER = {x.lower() for x in MISC_NAMES}
#: What a cell breaks, by its column; a missing one breaks nothing.
CELLS: dict[str, Callable[[str], Iterator[str]]] = {
    "upos": lambda v: _told({"unknown-upos": v not in UPOS}), "xpos": lambda v: _told({"empty-string-in-xpos": v == ""}), "feats": _of_feats,
    "deprel": lambda v: _told({"invalid-deprel": not DEPREL.fullmatch(v), "unknown-udeprel": bool(DEPREL.fullmatch(v)) and universal(v) not in RELATIONS}), "deps": _of_deps, "misc": _of_misc,
}
_WARNINGS = {"misc-attr-typo", "misc-extra-space"}


def cells(words: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Level 2 on single words (id, upos, xpos, feats, deprel, deps, misc), by Arrow batches: each different cell is judged once."""
    names = [*keys, "node", "level", "type", "testid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("_node").cast(pa.string())
            found: list[tuple[str, np.ndarray]] = []
            for column, judge in CELLS.items():
                cell = columns.Coded(batch.column(f"_{column}").cast(pa.string()))
                told = [list(judge(v)) if v is not None else [] for v in cell.values]
                for test in dict.fromkeys(t for x in told for t in x):
                    found.append((test, np.flatnonzero(np.array([test in x for x in told], bool)[cell.codes])))
                if column == "deps":
                    likely = np.flatnonzero(cell.test(lambda v: v != "_"))
                    ids = node.take(pa.array(likely)).to_pylist()
                    heads = [{h for h, _ in _edges(v)} if v is not None else set() for v in cell.values]
                    found.append(("deps-self-loop", np.array([i for i, own in zip(likely.tolist(), ids) if own in heads[cell.codes[i]]], np.int64)))
            of, many = pa.array(np.concatenate([at for _, at in found])), [len(at) for _, at in found]
            named = lambda values, many=many: pa.array(values, pa.string()).take(pa.array(np.repeat(np.arange(len(values)), many)))
            kinds = ["WARNING" if t in _WARNINGS else "ERROR" for t, _ in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in keys), node.take(of), pa.repeat(pa.scalar(2, pa.int32()), len(of)), named(kinds), named([t for t, _ in found])], names=names)

    rows = words.select(*keys, F.col("id").cast("string").alias("_node"), *(F.col(c).cast("string").alias(f"_{c}") for c in CELLS))
    return rows.mapInArrow(run, StructType([*(words.schema[k] for k in keys), *_parse_datatype_string(FOUND).fields]))


#: What `content` tells, behind the keys.
FOUND = "node string, level int, type string, testid string"


def content(words: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Level 3 on words (FIELDS, as rows or as an array `words` in the sentence's row), their parents and children.

    Sentences are judged by batches, on columns of their words. Punctuation under goeswith is left to `checks`, as it
    depends on crossing edges.
    """
    if "words" not in words.columns:
        words = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("words"))
    cell = lambda w, c: w[c].cast("long" if c in ("id", "head") else "string").alias(c)
    rows = words.select(*keys, F.transform("words", lambda w: F.struct(*(cell(w, c) for c in FIELDS))).alias("words"))
    return rows.mapInArrow(content_step(keys), StructType([*(words.schema[k] for k in keys), *_parse_datatype_string(FOUND).fields]))


def content_step(keys: tuple[str, ...], sound: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rules of content() on batches of sentences (keys, words: FIELDS with id and head as longs): for a task that makes the words itself.

    With `sound`, sentences in which a word is its own head are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            of = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            flat = lists.flatten()
            number = lambda c, missing, flat=flat: np.asarray(pc.fill_null(flat.field(c), missing), dtype=np.int64)
            words = columns.Words(of, number("id", columns.NO_ID), number("head", columns.NO_HEAD), lambda c, flat=flat: flat.field(c))
            yield _judged(batch, words, keys, sound)

    return run


def _judged(batch: pa.RecordBatch, words: columns.Words, keys: tuple[str, ...], sound: bool) -> pa.RecordBatch:
    if sound:
        loops = np.bincount(words.of[words.id == words.head], minlength=batch.num_rows)
        if loops.any():
            words = words.where(loops[words.of] == 0)
    node, above = (pa.array(x, mask=x <= columns.NO_ID) for x in (words.id, words.head))
    found = [(test, kind, (at := broken(words)), node.take(pa.array(at))) for test, (kind, _, broken) in CONTENT.items()]
    orphans = columns.orphans(words, ORPHAN_PARENTS)
    of_orphans = pc.if_else(pa.array(words.head[orphans] > 0), above.take(pa.array(orphans)), node.take(pa.array(orphans)))
    found.append(("orphan-parent", "WARNING", orphans, of_orphans))
    own, parents = columns.foreign(words)
    found += [("flat-foreign-upos-feats", "WARNING", own, node.take(pa.array(own))), ("flat-foreign-upos-feats", "WARNING", parents, above.take(pa.array(parents)))]
    found += [(test, "ERROR", at, node.take(pa.array(at))) for test, at in zip(("enhanced-0-is-not-root", "enhanced-root-is-not-0"), columns.edges(words.cells("deps")))]
    of, many = pa.array(words.of[np.concatenate([at for _, _, at, _ in found])]), [len(at) for _, _, at, _ in found]
    named = lambda values: pa.array(values, pa.string()).take(pa.array(np.repeat(np.arange(len(values)), many)))
    node = pa.concat_arrays([n.cast(pa.string()) for *_, n in found])
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in keys), node, pa.repeat(pa.scalar(3, pa.int32()), len(of)), named([k for _, k, _, _ in found]), named([t for t, *_ in found])], names=[*keys, "node", "level", "type", "testid"])
