"""Places of nodes in the characters of their documents, and what follows from them between two versions of a text.

Nodes are rows; prefix sums over a document's rows give each surface token its place, and a word inside a range
has the range's. Versions then meet by places: tokens that begin and end together, sentence ends, islands of
ranges that overlap. Here no document is gathered; lemmas and sentence ends are carried over by `versions`, which meets whole
documents in one exchange. Characters are those that are no separators (Zs).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from arborlake.operators import versions
from arborlake.sources import cells, conllu

#: Characters that are compared at a time.
GRID = 512


def characters(form: Column) -> Column:
    return F.regexp_replace(form, r"\p{Zs}", "")


def laid_out(sentences: DataFrame, doc: tuple[str, ...], order: str) -> DataFrame:
    """A row for each node but empty ones: doc, order, at (its line), the ten columns, kind, major, last, start, end, ranged (a word inside a range), token (its number in the document), text (what it adds)."""
    lines = sentences.select(*doc, order, F.posexplode(F.split("raw", "\n")).alias("at", "line")).where(F.col("line").rlike(r"\A[0-9]")).select(*doc, order, "at", F.split("line", "\t").alias("cells"))
    nodes = lines.select(*doc, order, "at", *(c.alias(k) for k, c in conllu.node_fields(F.col("cells")).items())).where("kind <> 'empty'")
    so_far = W.partitionBy(*doc).orderBy(order, "at")
    before = so_far.rowsBetween(W.unboundedPreceding, -1)
    ahead = F.last(F.when(F.col("kind") == "mwt", F.struct(F.col(order).alias("sent"), "major", "last")), ignorenulls=True).over(so_far)
    rows = nodes.withColumn("_range", ahead)
    ranged = (F.col("kind") == "word") & (F.col("_range.sent") == F.col(order)) & F.col("major").between(F.col("_range.major"), F.col("_range.last"))
    rows = rows.withColumn("ranged", F.coalesce(ranged, F.lit(False))).withColumn("text", F.when(F.col("ranged"), F.lit("")).otherwise(characters(F.col("form"))))
    rows = rows.withColumns({"start": F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0)), "token": F.sum(F.when(F.col("ranged"), 0).otherwise(1)).over(so_far)})
    rows = rows.withColumn("_place", F.last(F.when(~F.col("ranged"), F.struct("start", (F.col("start") + F.length("text")).alias("end"))), ignorenulls=True).over(so_far))
    return rows.withColumns({"start": F.col("_place.start"), "end": F.col("_place.end")}).drop("_range", "_place")


def sentence_spans(laid: DataFrame, doc: tuple[str, ...], order: str) -> DataFrame:
    return laid.groupBy(*doc, order).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def different(a: DataFrame, b: DataFrame, doc: tuple[str, ...]) -> DataFrame:
    """Documents (doc) whose characters differ, from both sides' laid_out(): compared in cells of GRID characters."""

    def cells(laid: DataFrame, name: str) -> DataFrame:
        rows = laid.where("text <> ''").select(*doc, "start", "end", "text", F.explode(F.expr(f"sequence(start div {GRID}, (end - 1) div {GRID})")).alias("cell"))
        low, high = F.greatest(F.col("cell") * GRID, F.col("start")), F.least((F.col("cell") + 1) * GRID, F.col("end"))
        rows = rows.select(*doc, "cell", F.struct(low.alias("low"), F.substring("text", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("piece")).alias("x"))
        return rows.groupBy(*doc, "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["piece"]), "").alias(name))

    both = cells(a, "left").join(cells(b, "right"), [*doc, "cell"], "full")
    return both.where(~F.col("left").eqNullSafe(F.col("right"))).select(*doc).distinct()


def islands(a: DataFrame, b: DataFrame, doc: tuple[str, ...]) -> DataFrame:
    """doc, low, high: stretches of characters in which ranges of either side overlap in a chain; from rows (doc, start, end) of ranges."""
    order = W.partitionBy(*doc).orderBy("start", "end")
    rows = a.unionByName(b).distinct().withColumn("until", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("number", F.sum(F.when(F.col("until") > F.col("start"), 0).otherwise(1)).over(order))
    return rows.groupBy(*doc, "number").agg(F.min("start").alias("low"), F.max("end").alias("high")).drop("number")


def longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common sequence as pairs of places: equal items pair at once; else the first side is skipped unless that costs a pair."""
    tails: list[list[int]] = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        row, below = tails[i], tails[i + 1]
        for j in reversed(range(len(b))):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    pairs, i, j = [], 0, 0
    while tails[i][j]:
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        else:
            i, j = (i + 1, j) if tails[i + 1][j] == tails[i][j] else (i, j + 1)
    return pairs


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def common(a: pd.Series, b: pd.Series) -> pd.Series:
    """longest() of two arrays."""
    return pd.Series([[list(p) for p in longest(list(x), list(y))] for x, y in zip(a, b)], dtype=object)


def aligned(gold: DataFrame, system: DataFrame, doc: tuple[str, ...]) -> DataFrame:
    """doc, g, s: places (sent, id) of words that belong together, from words (doc, place, start, end, ranged, lower).

    Words outside the islands pair by equal places; those of an island by a longest common sequence of their
    lower-cased forms. An island's words are few: a chain of ranges that overlap.
    """
    spans = lambda df: df.where("ranged").select(*doc, "start", "end")
    land = islands(spans(gold), spans(system), doc)

    def placed(words: DataFrame) -> DataFrame:
        """With `island`: the begin of the one that holds the word."""
        marks = land.select(*doc, F.col("low").alias("start"), F.lit(0).alias("kind"), F.struct("low", "high").alias("mark"))
        rows = words.select(*doc, "place", "start", "end", "ranged", "lower", F.lit(1).alias("kind"), F.lit(None).cast("struct<low: bigint, high: bigint>").alias("mark"))
        last = F.last("mark", ignorenulls=True).over(W.partitionBy(*doc).orderBy("start", "kind"))
        rows = rows.unionByName(marks, allowMissingColumns=True).withColumn("last", last).where("kind = 1")
        return rows.withColumn("island", F.when(F.col("end") <= F.col("last.high"), F.col("last.low"))).drop("kind", "mark", "last")

    g, s = placed(gold), placed(system)
    # Words without characters share a place; they pair in order.
    nth = F.row_number().over(W.partitionBy(*doc, "start", "end").orderBy("place"))
    alone = lambda df, name: df.where("island is null").withColumn("nth", nth).select(*doc, "start", "end", "nth", F.col("place").alias(name))
    outside = alone(g, "g").join(alone(s, "s"), [*doc, "start", "end", "nth"]).select(*doc, "g", "s")
    inside = lambda df, name: df.where("island is not null").groupBy(*doc, "island").agg(F.array_sort(F.collect_list(F.struct("place", "lower"))).alias(name))
    both = inside(g, "gs").join(inside(s, "ss"), [*doc, "island"])
    forms = lambda c: F.transform(c, lambda x: x["lower"])
    paired = both.select(*doc, "gs", "ss", F.explode(common(forms("gs"), forms("ss"))).alias("p"))
    return outside.unionByName(paired.select(*doc, F.get("gs", F.col("p")[0])["place"].alias("g"), F.get("ss", F.col("p")[1])["place"].alias("s")))


def lemmas(gold: DataFrame, system: DataFrame, doc: tuple[str, ...], order: str) -> DataFrame:
    """doc, order, id, form, lemma: the gold nodes; where tokens of both begin and end together and have as many lines, with the system's lemmas."""
    columns = ("id", "form", "lemma")

    def step(docs: pa.Table, g: versions.Side, s: versions.Side) -> pa.Table:
        token, other = ({"start": x.start[x.first], "end": x.end[x.first], "many": np.bincount(x.token, minlength=len(x.first))} for x in (g, s))
        # Tokens with characters begin at places of their own.
        long = np.flatnonzero(other["end"] > other["start"])
        at = long[np.minimum(np.searchsorted(other["start"][long], token["start"]), max(len(long) - 1, 0))] if len(long) else np.zeros(len(g.first), np.int64)
        met = np.zeros(len(g.first), bool)
        if len(long):
            met = np.logical_and.reduce([token[k] == other[k][at] for k in token])
        there = met[g.token]
        line = np.where(there, s.first[at][g.token] + np.arange(len(g.token)) - g.first[g.token], 0) if len(long) else np.zeros(len(g.token), np.int64)
        lemma = s["lemma"].take(pa.array(line, mask=~there))
        lemma = pc.coalesce(pc.if_else(pc.equal(lemma, ""), pa.scalar(None, pa.string()), lemma), g["lemma"])
        return pa.table({**{k: docs.column(k).take(pa.array(g.doc)) for k in doc}, order: g.order.take(pa.array(g.sent)), "id": g["id"], "form": g["form"], "lemma": lemma})

    sides = [versions.packed(x, doc, order, k, columns) for k, x in enumerate((gold, system))]
    return versions.together(*sides, doc, (columns, columns), step, versions.schema_of(gold, (*doc, order), "id string, form string, lemma string"))


def resegmented(source: DataFrame, target: DataFrame, doc: tuple[str, ...], order: str) -> DataFrame:
    """doc, number (from 1), raw: the target's tokens in sentences that end where the source's do.

    Ids are made anew and heads left out, as a tree need not survive; the name is the target's of the first
    token, with a letter from B on where that name has been given already in the document. Source ends inside
    a token of the target end no sentence.
    """
    columns = (("id", "form"), ("id", "form", "lemma", "upos", "xpos", "feats", "misc"))

    def step(docs: pa.Table, s: versions.Side, t: versions.Side) -> pa.Table:
        n = len(t.doc)
        ends = np.full(len(s.order), -1)
        np.maximum.at(ends, s.sent, s.end)
        # A sentence ends with the last line of a token that ends where a source sentence does.
        closes = np.isin(t.end, ends[ends >= 0])
        closes[:-1] &= (t.token[1:] != t.token[:-1]) | (t.doc[1:] != t.doc[:-1])
        new = np.ones(n, bool)
        new[1:] = closes[:-1] | (t.doc[1:] != t.doc[:-1])
        begin = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        words = np.cumsum(t.word)
        word = words - (words - t.word)[begin][of]
        text = lambda x: pa.array(x).cast(pa.string())
        ids = pc.if_else(pa.array(t.word), text(word), pc.binary_join_element_wise(text(word + 1), text(word + 1 + t.last - t.major), "-"))
        line = pc.binary_join_element_wise(ids, *(t[c] for c in columns[1][1:6]), "_", "_", "_", t["misc"], "\t")
        glued = cells.like(t["misc"], r"(\A|\|)SpaceAfter=No(\||\z)")
        shown = pc.if_else(pa.array(t.ranged), "", pc.if_else(pa.array(glued), t["form"], pc.binary_join_element_wise(t["form"], " ", "")))
        bounds = np.append(begin, n)
        joined = lambda x, by: pc.binary_join(cells.lists(bounds, x), by)
        first = pc.fill_null(t.names.take(pa.array(t.sent[begin])), "s")
        of_doc = t.doc[begin]
        code = np.asarray(first.dictionary_encode().indices, dtype=np.int64)
        number = np.arange(len(begin)) - np.searchsorted(of_doc, of_doc) + 1
        by = np.lexsort((number, code, of_doc))
        fresh = np.ones(len(by), bool)
        fresh[1:] = (code[by][1:] != code[by][:-1]) | (of_doc[by][1:] != of_doc[by][:-1])
        again = np.empty(len(by), np.int64)
        again[by] = np.arange(len(by)) - np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0)) if len(by) else 0
        letter = pa.array(["", *map(chr, range(65, 91))]).take(pa.array(np.where(again > 0, (again - 1) % 25 + 2, 0)))
        raw = pc.binary_join_element_wise("# sent_id = ", first, letter, "\n# text = ", pc.utf8_rtrim(joined(shown, ""), " "), "\n", joined(line, "\n"), "")
        return pa.table({**{k: docs.column(k).take(pa.array(of_doc)) for k in doc}, "number": pa.array(number), "raw": raw})

    sides = [versions.packed(x, doc, order, k, columns[k], named=k == 1) for k, x in enumerate((source, target))]
    return versions.together(*sides, doc, columns, step, versions.schema_of(target, doc, "number long, raw string"))
