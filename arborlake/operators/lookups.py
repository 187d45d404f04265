"""Levels 4 and 5 as joins: features, relations, enhanced relations, spaces and lemmas against registry tables.

A word's own language is that of its MISC, else the treebank's. All that words ask of the registry is one list, which
meets the registry's entries in two joins: words are scanned once. The entries are written, so Spark knows their size
and broadcasts them while it is small, else shuffles both sides. A word's parents come from its sentence's array,
without a join.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions import edges, pairs, universal, value_of
from arborlake.operators.columns import Coded
from arborlake.operators.sentence import attributes
from arborlake.sources.cells import parted, split
from arborlake.sources.registry import Tables
from arborlake.sources.scratch import written


def own_language(misc: Column, treebank: Column) -> Column:
    return F.coalesce(F.nullif(value_of(misc, "Lang"), F.lit("")), treebank)


def words(sentences: DataFrame, keys: tuple[str, ...], lang: str) -> DataFrame:
    """keys, main, own (languages), and each word with its parent's language; from sentences with an array `words` in order of ids.

    Heads of the enhanced graph that are no words (empty nodes, the root) have no language.
    """
    main = F.col(lang)
    of = lambda i: F.when(i > 0, F.get("words", i - 1))
    language = lambda w: F.when(w.isNotNull(), own_language(w["misc"], main))
    row = F.transform("words", lambda w: F.struct(
        *(w[c].alias(c) for c in ("id", "form", "lemma", "upos", "feats", "deprel")), own_language(w["misc"], main).alias("own"), language(of(w["head"])).alias("above"),
        F.transform(edges(w["deps"]), lambda e: F.struct(e["deprel"].alias("deprel"), language(of(F.coalesce(e["head"].try_cast("int"), F.lit(0)))).alias("above"))).alias("edges"),
    ))
    return sentences.select(*keys, main.alias("main"), F.explode(row).alias("w")).select(*keys, "main", "w.*")


#: A row of asked(), behind the keys: what a word asks of the registry. `kind` and `name` are looked up in `first` and, where that has no entry, in `second`; `text` is what is told.
ASKED = "id long, upos string, kind string, first string, second string, name string, value string, text string"
#: What asked_step() reads of a word.
FIELDS = ("id", "form", "lemma", "upos", "feats", "head", "deprel", "deps", "misc")


def incidents(found: DataFrame, registry: Tables, keys: tuple[str, ...], level: int = 5) -> DataFrame:
    """keys, id, upos, level, testid, message, of rows of words()."""
    return judged(asked(found, keys), registry, keys, level)


def asked(found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of ASKED, of rows of words(): one scan, whatever is asked."""

    def ask(kind: str, first: Column, name: Column, text: Column, second: Column | None = None, value: Column | None = None) -> Column:
        columns = {"kind": F.lit(kind), "first": first, "second": first if second is None else second, "name": name, "value": F.lit("") if value is None else value, "text": text}
        return F.struct(*(c.cast("string").alias(k) for k, c in columns.items()))

    main, own = F.col("main"), F.col("own")
    other = lambda above: F.when((own != main) & own.eqNullSafe(above), own).otherwise(main)
    of_value = lambda f, v: ask("feature", F.when(f["name"] == "Foreign", main).otherwise(own), f["name"], F.concat_ws("=", f["name"], v), value=v)
    features = F.flatten(F.transform(pairs(F.col("feats")), lambda f: F.coalesce(F.transform(F.split(f["value"], ","), lambda v: of_value(f, v)), F.array().cast(_ASKS))))
    enhanced = F.transform("edges", lambda e: ask("enhanced", main, e["deprel"], e["deprel"], other(e["above"])))
    spaced = F.transform(F.filter(F.array("form", "lemma"), lambda w: w.rlike(r"(?U)\s")), lambda w: ask("space", own, F.lit(""), w, value=F.replace(w, F.lit("\u00a0"), F.lit(" "))))
    lemma = lambda kind: ask(kind, own, F.col("lemma"), F.col("lemma"))
    singles = F.array(ask("relation", main, F.col("deprel"), F.col("deprel"), other(F.col("above"))), F.when(F.col("upos") == "AUX", lemma("auxiliary")), F.when(universal(F.col("deprel")) == "cop", lemma("copula")))
    every = F.concat(F.filter(singles, lambda x: x.isNotNull()), *(F.coalesce(x, F.array().cast(_ASKS)) for x in (features, enhanced, spaced)))
    return found.select(*keys, F.col("id").cast("long").alias("id"), "upos", F.explode(every).alias("x")).select(*keys, "id", "upos", "x.*")


_ASKS = "array<struct<kind:string,first:string,second:string,name:string,value:string,text:string>>"


def _entries(registry: Tables) -> DataFrame:
    """kind, lang, name, known, permitted, values, by_upos, pattern: the registry as one table, a row for each entry."""
    empty = {"permitted": "boolean", "values": "array<string>", "by_upos": "map<string, array<string>>", "pattern": "string"}

    def of(kind: str, df: DataFrame, name: Column) -> DataFrame:
        more = (F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items())
        return df.select(F.lit(kind).alias("kind"), "lang", name.alias("name"), F.lit(True).alias("known"), *more)

    out = of("feature", registry.features, F.col("feature"))
    listed = (("relation", registry.relations, "deprel"), ("enhanced", registry.enhanced, "deprel"), *((k, registry.lemmas.where(k), "lemma") for k in ("auxiliary", "copula")))
    for kind, df, name in listed:
        out = out.unionByName(of(kind, df.select("lang", name).distinct(), F.col(name)))
    return out.unionByName(of("space", registry.spaces, F.lit("")))


def judged(asked: DataFrame, registry: Tables, keys: tuple[str, ...], level: int = 5) -> DataFrame:
    """keys, id, upos, level, testid, message, of rows of ASKED: two joins with the registry's entries, in one scan."""
    entries = written(_entries(registry), "entries")
    first = entries.select("kind", F.col("lang").alias("first"), "name", F.col("known").alias("_first"), "permitted", "values", "by_upos", "pattern")
    second = entries.where("kind in ('relation', 'enhanced')").select("kind", F.col("lang").alias("second"), "name", F.col("known").alias("_second"))
    rows = asked if level >= 5 else asked.where("kind not in ('auxiliary', 'copula')")
    rows = rows.join(first, ["kind", "first", "name"], "left").join(second, ["kind", "second", "name"], "left")
    value, of_tag = F.col("value"), F.try_element_at("by_upos", F.col("upos"))
    of_feature = F.when(F.col("permitted").isNull(), "feature-unknown").when(~F.col("permitted"), "feature-not-permitted").when(~F.array_contains("values", value), "feature-value-unknown")
    of_feature = of_feature.when(of_tag.isNull(), "feature-upos-not-permitted").when(~F.array_contains(of_tag, value), "feature-value-upos-not-permitted")
    testid = F.when(F.col("kind") == "feature", of_feature).when(F.col("kind") == "space", F.when(~F.coalesce(F.rlike(value, F.col("pattern")), F.lit(False)), "invalid-word-with-space"))
    for kind, test in (("relation", "unknown-deprel"), ("enhanced", "unknown-edeprel"), ("auxiliary", "aux-lemma"), ("copula", "cop-lemma")):
        testid = testid.when((F.col("kind") == kind) & F.col("_first").isNull() & F.col("_second").isNull(), test)
    at = F.when(F.col("kind").isin("auxiliary", "copula"), 5).otherwise(4)
    return rows.select(*keys, "id", "upos", at.alias("level"), testid.alias("testid"), F.col("text").alias("message")).where("testid is not null")


def asked_step(keys: tuple[str, ...], lang: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ASKED of batches of sentences (keys, words: FIELDS in order of ids): for a task that makes the words itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _asked(batch, keys, lang)

    return run


def _asked(batch: pa.RecordBatch, keys: tuple[str, ...], lang: str) -> pa.RecordBatch:
    lists = batch.column("words")
    flat, counts = lists.flatten(), np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    of, begins = np.repeat(np.arange(len(lists)), counts), np.cumsum(counts) - counts
    take = lambda column, at: column.take(pa.array(at))
    # Languages and other names as numbers; what a cell of few values asks is found once for each different one.
    names = Names()
    unknown = names.number(None)
    main = names.of(Coded(batch.column(lang)))[of]
    misc, feats, deprel, upos = (Coded(flat.field(c)) for c in ("misc", "feats", "deprel", "upos"))
    said = misc.mapped(lambda v: names.number(_first(v, "Lang") or None))
    own = np.where(said == unknown, main, said)
    found: list[tuple] = []  # places, kind, first, second, name, value, text: numbers of names

    def above(at: np.ndarray, head: np.ndarray) -> np.ndarray:
        """The second language of a relation: that of the word, where its parent shares it."""
        there = (head > 0) & (head <= counts[of[at]])
        parent = np.where(there, begins[of[at]] + head - 1, at)
        other = (own[at] != main[at]) & (main[at] != unknown)
        return np.where(there & other & (own[parent] == own[at]), own[at], main[at])

    every = np.arange(len(of))
    rel, none = names.of(deprel), names.number("")
    heads = np.asarray(pc.fill_null(flat.field("head"), 0), dtype=np.int64)
    found.append((every, "relation", main, above(every, heads), rel, np.full(len(of), none), rel))
    for k, cell in enumerate(feats.values):
        at = None
        for name, value in attributes(cell or "_"):
            for v in () if value is None else value.split(","):
                at = np.flatnonzero(feats.codes == k) if at is None else at
                of_lang, number = (main if name == "Foreign" else own)[at], lambda x, n=len(at): np.full(n, names.number(x))
                found.append((at, "feature", of_lang, of_lang, number(name), number(v), number(f"{name}={v}")))
    deps = flat.field("deps")
    at = np.flatnonzero(np.asarray(pc.fill_null(pc.not_equal(deps, "_"), False), dtype=bool))
    nth, listed = split(take(deps, at), "|")
    at, (head, label) = at[nth], parted(listed)
    kinds = names.of(Coded(label))
    found.append((at, "enhanced", main[at], above(at, Coded(head).mapped(_number)), kinds, np.full(len(at), none), kinds))
    for column in ("form", "lemma"):
        text = flat.field(column)
        at = np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(text, r"[\s\v\x{85}]|\p{Z}"), False), dtype=bool))
        at = np.array([i for i, x in zip(at.tolist(), take(text, at).to_pylist()) if _SPACE.search(x)], np.int64)
        words = names.of(Coded(take(text, at)))
        found.append((at, "space", own[at], own[at], np.full(len(at), none), names.of(Coded(pc.replace_substring(take(text, at), "\u00a0", " "))), words))
    for kind, chosen in (("auxiliary", upos.test(lambda v: v == "AUX")), ("copula", deprel.test(lambda v: v.partition(":")[0] == "cop"))):
        at = np.flatnonzero(chosen)
        lemmas = names.of(Coded(take(flat.field("lemma"), at)))
        found.append((at, kind, own[at], own[at], lemmas, np.full(len(at), none), lemmas))
    at = np.concatenate([f[0] for f in found])
    texts = pa.array(names.texts, pa.string())
    kind = pa.array([f[1] for f in found], pa.string()).take(pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found])))
    columns = [texts.take(pa.array(np.concatenate([f[i] for f in found]))) for i in range(2, 7)]
    row = pa.array(of[at])
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in keys), take(flat.field("id"), at), take(flat.field("upos"), at), kind, *columns], names=[*keys, *(f.split()[0] for f in ASKED.split(", "))])


class Names:
    """Texts as numbers."""

    def __init__(self) -> None:
        self.texts: list[str | None] = []
        self._numbers: dict[str | None, int] = {}

    def number(self, text: str | None) -> int:
        if text not in self._numbers:
            self._numbers[text] = len(self.texts)
            self.texts.append(text)
        return self._numbers[text]

    def of(self, column: Coded) -> np.ndarray:
        return column.mapped(self.number)


#: White space as Java's expressions know it with (?U).
_SPACE = re.compile(r"[\t-\r\x85\u0020\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _first(cell: str | None, name: str) -> str:
    return next((v or "" for k, v in attributes(cell or "_") if k == name), "")


def _number(text: str | None) -> int:
    """A head as Spark casts it; 0 where it is no number."""
    found = re.fullmatch(r"\s*(\+?[0-9]+)\s*", text or "", re.ASCII)
    return min(int(found[1][:20]), 1 << 40) if found else 0
