"""Reference data of the validator, as values that the caller supplies; a small synthetic registry stands in for published ones."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.sources.scratch import written

# The universal part-of-speech tags and relations of the annotation scheme.
UPOS = ["ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X"]
RELATIONS = [
    "acl", "advcl", "advmod", "amod", "appos", "aux", "case", "cc", "ccomp", "clf", "compound", "conj",
    "cop", "csubj", "dep", "det", "discourse", "dislocated", "expl", "fixed", "flat", "goeswith", "iobj", "list",
    "mark", "nmod", "nsubj", "nummod", "obj", "obl", "orphan", "parataxis", "punct", "reparandum", "root", "vocative", "xcomp",
]


@dataclass(frozen=True)
class Language:
    #: feature -> permitted, and by tag the permitted values
    features: dict[str, dict[str, set[str]]] = field(default_factory=dict)
    banned: frozenset[str] = frozenset()
    relations: frozenset[str] = frozenset(RELATIONS)
    #: case marker -> relations that it may extend
    markers: dict[str, set[str]] = field(default_factory=dict)
    auxiliaries: frozenset[str] = frozenset()
    copulas: frozenset[str] = frozenset()
    #: expressions of words that may hold spaces
    spaces: tuple[str, ...] = ()

    def values(self, feature: str) -> set[str]:
        return set().union(*self.features[feature].values())

    def enhanced(self, deprel: str) -> bool:
        """Basic relations and `ref`; subjects of controlled clauses; relations extended by a case marker that may do so."""
        if deprel in self.relations or deprel == "ref" or re.fullmatch(r"[nc]subj(:.+)?:xsubj", deprel):
            return True
        basic, _, marker = deprel.partition(":")
        while marker:
            if basic in self.relations and any(basic == x or basic.partition(":")[0] == x for x in self.markers.get(marker, ())):
                return True
            more, _, marker = marker.partition(":")
            basic = f"{basic}:{more}"
        return False

    def with_space(self, word: str) -> bool:
        return bool(self.spaces) and re.fullmatch("|".join(sorted(self.spaces)), word.replace("\u00a0", " ")) is not None


_NOMINAL = {"NOUN", "PROPN", "ADJ", "PRON", "DET"}
#: A registry of a few features for tests and synthetic treebanks; an unknown language has an empty one.
SAMPLE: dict[str, Language] = {
    lang: Language(
        features={
            "Number": {u: {"Sing", "Plur"} for u in (*_NOMINAL, "VERB", "AUX")}, "Case": {u: {"Nom", "Acc"} for u in _NOMINAL}, "Mood": {u: {"Ind"} for u in ("VERB", "AUX")},
            "VerbForm": {u: {"Fin", "Inf"} for u in ("VERB", "AUX")}, "PronType": {u: {"Prs", "Art"} for u in ("PRON", "DET")}, "Typo": {u: {"Yes"} for u in UPOS},
            "Foreign": {"X": {"Yes"}, "PROPN": {"Yes"}}, "ExtPos": {u: {"ADV", "ADP"} for u in UPOS}, "Poss": {"PRON": {"Yes"}, "DET": {"Yes"}}, "Polarity": {"PART": {"Neg"}, "ADV": {"Neg"}},
        },
        banned=frozenset({"Degree"}), relations=frozenset([*RELATIONS, "flat:foreign", "nsubj:outer", "nsubj:pass", "acl:relcl"]), markers={"in": {"obl", "nmod"}, "and": {"conj"}},
        auxiliaries=frozenset({"be", "have"}), copulas=frozenset({"be"}), spaces=(r"[0-9]+( [0-9]{3})+", r"a lot"),
    )
    for lang in ("en", "de", "es", "fr")
}


# Registries in JSON files: objects whose keys (languages, features, tags, lemmas) are data, read by map schemas into narrow tables.

_BY_UPOS = "MAP<STRING, MAP<STRING, INT>>"
#: File, its outermost key, and the type of what is below.
FILES = {
    "upos": ("upos.json", "upos", "ARRAY<STRING>"),
    "udeprels": ("udeprels.json", "udeprels", "ARRAY<STRING>"),
    "feats": ("feats.json", "features", f"MAP<STRING, MAP<STRING, STRUCT<permitted: INT, uvalues: ARRAY<STRING>, lvalues: ARRAY<STRING>, byupos: {_BY_UPOS}, errors: ARRAY<STRING>>>>"),
    "deprels": ("deprels.json", "deprels", "MAP<STRING, MAP<STRING, STRUCT<permitted: INT, errors: ARRAY<STRING>>>>"),
    "edeprels": ("edeprels.json", "edeprels", "MAP<STRING, MAP<STRING, STRUCT<extends: ARRAY<STRING>>>>"),
    "auxiliaries": ("data.json", "auxiliaries", "MAP<STRING, MAP<STRING, STRUCT<functions: ARRAY<STRUCT<function: STRING>>>>>"),
    "spaces": ("tospace.json", "expressions", "MAP<STRING, ARRAY<STRING>>"),
}


@dataclass
class Tables:
    """Narrow tables, a row for each entry; `ud` stands for all languages together."""

    upos: DataFrame  # upos
    features: DataFrame  # lang, feature, permitted, values, by_upos (tag to values)
    relations: DataFrame  # lang, deprel
    enhanced: DataFrame  # lang, deprel
    markers: DataFrame  # lang, marker, extends
    lemmas: DataFrame  # lang, lemma, auxiliary, copula
    spaces: DataFrame  # lang, pattern: a whole word


def load(spark: SparkSession, folder: str) -> Tables:
    """The tables of a folder's files; a missing file is an error, a language or list that a file leaves out is empty."""

    def entries(name: str) -> DataFrame:
        file, key, kind = FILES[name]
        read = spark.read.text(f"{folder}/{file}", wholetext=True)
        return read.select(F.explode(F.from_json("value", f"{key} {kind}", {"mode": "FAILFAST"})[key]).alias(*(("key", "value") if kind.startswith("MAP") else ("value",))))

    def below(name: str, inner: str) -> DataFrame:
        return entries(name).select(F.col("key").alias("lang"), F.explode("value").alias(inner, "x"))

    none = F.array().cast("array<string>")
    values = F.array_distinct(F.concat(F.coalesce("x.uvalues", none), F.coalesce("x.lvalues", none)))
    by_upos = F.transform_values(F.coalesce("x.byupos", F.create_map().cast("map<string, map<string, int>>")), lambda _, v: F.map_keys(F.map_filter(v, lambda _, n: n > 0)))
    features = below("feats", "feature").select("lang", "feature", (F.col("x.permitted") > 0).alias("permitted"), values.alias("values"), by_upos.alias("by_upos"))
    own = below("deprels", "deprel").where("x.permitted > 0").select("lang", "deprel")
    relations = written(own.where("lang <> 'ud'").unionByName(entries("udeprels").select(F.lit("ud").alias("lang"), F.col("value").alias("deprel"))), "relations")
    markers = below("edeprels", "marker").select("lang", "marker", F.explode("x.extends").alias("extends"))
    # A marker extends a relation and its subtypes; subjects may be those of a controlled clause.
    extended = relations.join(markers, "lang").where((F.col("deprel") == F.col("extends")) | F.col("deprel").startswith(F.concat("extends", F.lit(":")))).select("lang", F.concat_ws(":", "deprel", "marker").alias("deprel"))
    subjects = relations.where(F.col("deprel").rlike(r"\A[nc]subj(:|\z)")).select("lang", F.concat("deprel", F.lit(":xsubj")).alias("deprel"))
    enhanced = relations.unionByName(extended).unionByName(subjects).unionByName(relations.select("lang", F.lit("ref").alias("deprel"))).distinct()
    functions = F.col("x.functions.function")
    lemmas = below("auxiliaries", "lemma").select("lang", "lemma", F.exists(functions, lambda f: f != "cop.PRON").alias("auxiliary"), F.exists(functions, lambda f: f.startswith("cop.")).alias("copula"))
    spaces = entries("spaces").select(F.col("key").alias("lang"), F.concat(F.lit(r"\A(?:"), F.array_join(F.array_sort("value"), "|"), F.lit(r")\z")).alias("pattern"))
    keep = lambda df, name: written(df, name)
    return Tables(entries("upos").select(F.col("value").alias("upos")), keep(features, "features"), relations, keep(enhanced, "enhanced"), markers, keep(lemmas, "lemmas"), keep(spaces, "spaces"))


def languages(tables: Tables) -> dict[str, Language]:
    """The registry for checks that walk a sentence: a few hundred languages, on the driver."""
    out: dict[str, dict] = {}
    of = lambda lang: out.setdefault(lang, {"features": {}, "banned": set(), "relations": set(), "markers": {}, "auxiliaries": set(), "copulas": set(), "spaces": ()})
    for r in tables.features.collect():
        if r.permitted:
            of(r.lang)["features"][r.feature] = {u: set(v) for u, v in r.by_upos.items()}
        else:
            of(r.lang)["banned"].add(r.feature)
    for r in tables.relations.collect():
        of(r.lang)["relations"].add(r.deprel)
    for r in tables.markers.collect():
        of(r.lang)["markers"].setdefault(r.marker, set()).add(r.extends)
    for r in tables.lemmas.collect():
        for kind in ("auxiliary", "copula"):
            if r[kind]:
                of(r.lang)["auxiliaries" if kind == "auxiliary" else "copulas"].add(r.lemma)
    for r in tables.spaces.collect():
        of(r.lang)["spaces"] = (r.pattern[len(r"\A(?:") : -len(r")\z")],)
    return {lang: Language(**{k: frozenset(v) if isinstance(v, set) else v for k, v in x.items()}) for lang, x in out.items()}


def explained(tables: Tables) -> DataFrame:
    """lang, what, text: what is permitted in each language, for a reader."""
    listed = lambda df, what, entry: df.select("lang", F.lit(what).alias("what"), entry.alias("entry"))
    pairs = tables.features.where("permitted").select("lang", "feature", F.explode("values").alias("value"))
    rows = listed(pairs, "features", F.concat_ws("=", "feature", "value"))
    for df, what, column in ((tables.relations, "relations", "deprel"), (tables.enhanced, "enhanced relations", "deprel"), (tables.lemmas.where("auxiliary"), "auxiliaries", "lemma"), (tables.lemmas.where("copula"), "copulas", "lemma"), (tables.spaces, "words with spaces", "pattern")):
        rows = rows.unionByName(listed(df, what, F.col(column)))
    return rows.groupBy("lang", "what").agg(F.concat(F.lit("Permitted "), F.first("what"), F.lit(": "), F.array_join(F.array_sort(F.collect_set("entry")), ", ")).alias("text"))


def as_json(registry: dict[str, Language]) -> dict[str, str]:
    """The files' texts of a registry."""
    flag = lambda x: {v: 1 for v in sorted(x)}
    feats = {
        lang: {**{f: {"permitted": 1, "uvalues": sorted(set().union(*by.values())), "lvalues": [], "byupos": {u: flag(v) for u, v in by.items()}, "errors": []} for f, by in x.features.items()}, **{f: {"permitted": 0, "uvalues": [], "lvalues": [], "byupos": {}, "errors": []} for f in x.banned}}
        for lang, x in registry.items()
    }
    kinds = lambda x, lemma: [*([{"function": "aux"}] if lemma in x.auxiliaries else []), *([{"function": "cop.PRON"}] if lemma in x.copulas else [])]
    below = {
        "upos": UPOS, "udeprels": RELATIONS, "feats": feats, "deprels": {lang: {r: {"permitted": 1, "errors": []} for r in sorted(x.relations)} for lang, x in registry.items()},
        "edeprels": {lang: {m: {"extends": sorted(e)} for m, e in x.markers.items()} for lang, x in registry.items()},
        "auxiliaries": {lang: {w: {"functions": kinds(x, w)} for w in sorted(x.auxiliaries | x.copulas)} for lang, x in registry.items()}, "spaces": {lang: list(x.spaces) for lang, x in registry.items()},
    }
    return {file: json.dumps({key: below[name]}, ensure_ascii=False) for name, (file, key, _) in FILES.items()}
