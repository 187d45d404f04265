"""Paradigms: the forms of a lemma under a tag, with their features; case folded, filtered, ordered, listed.

Words are counted once by (keys, lemma, upos, form, feats); everything else reads these counts. Lemmas are no hot
keys then: a group holds the distinct forms of one lemma and tag.

Defined results: null features count as `_`, null forms and lemmas as empty; without words there is no paradigm;
ties of size go by lemma, then tag; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.functions import pairs, transliterated
from arborlake.operators.statistics import each

CELL = ("lemma", "upos", "form", "feats")


def forms(sentences: DataFrame, *keys: str, translit: str = "none") -> DataFrame:
    """keys, lemma, upos, form, feats, n. Transliterations may `replace` forms and lemmas, be added to them (`add`), or be left (`none`).

    A form not in lower case counts as its lower-case form where that occurs with the same lemma and tag, else as its
    capitalised form where that one does.
    """
    rows = each(sentences, *keys)
    written = {c: F.coalesce(F.col(c), F.lit("")) for c in ("form", "lemma")} if translit == "none" else {c: F.coalesce(transliterated(F.col(c), F.col("misc"), a, translit == "replace"), F.lit("")) for c, a in (("form", "Translit"), ("lemma", "LTranslit"))}
    counts = rows.select(*keys, written["lemma"].alias("lemma"), "upos", written["form"].alias("form"), F.coalesce("feats", F.lit("_")).alias("feats")).groupBy(*keys, *CELL).agg(F.count("*").alias("n"))
    lower = F.lower("form")
    capital = F.concat(F.upper(F.substring("form", 1, 1)), F.lower(F.substring("form", 2, 1 << 30)))
    # Counts are dealt by paradigm once; the window, the sums and the sizes of paradigms find them where they are.
    counts = counts.repartition(*keys, "lemma", "upos")
    # A form and what it may be folded to have one lower-case form: they are in one small group.
    group = W.partitionBy(*keys, "lemma", "upos", lower)
    occurs = lambda c: F.max((F.col("form") == c).cast("int")).over(group) == 1
    folded = F.when(occurs(lower), lower).when(occurs(capital), capital).otherwise(F.col("form"))
    return counts.withColumn("_to", folded).groupBy(*keys, "lemma", "upos", F.col("_to").alias("form"), "feats").agg(F.sum("n").alias("n"))


def sized(counts: DataFrame, *keys: str, min_forms: int = 1, lemma: str = "", tags: tuple[str, ...] = (), feats: tuple[str, ...] = (), shapes: tuple[str, ...] = ()) -> DataFrame:
    """keys, lemma, upos, n_forms, n_slots (form and features), n, values (of its features): paradigms that hold each of `feats` in some annotation and each of `shapes` as some whole form.

    `lemma` (whole), `feats` and `shapes` are expressions, case left aside; `tags` are given as they are.
    """
    rows = counts.where(F.col("lemma").rlike(rf"(?i)\A(?:{lemma})\z")) if lemma else counts
    rows = rows.where(F.col("upos").isin(*tags)) if tags else rows
    asked = [F.col("feats").rlike(f"(?i){x}") for x in feats] + [F.col("form").rlike(rf"(?i)\A(?:{x})\z") for x in shapes]
    found = rows.groupBy(*keys, "lemma", "upos").agg(F.countDistinct("form").alias("n_forms"), F.count("*").alias("n_slots"), F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_set(F.split("feats", r"\|")))).alias("values"), *(F.max(c).alias(f"_{i}") for i, c in enumerate(asked)))
    kept = F.col("n_forms") >= min_forms
    for i in range(len(asked)):
        kept = kept & F.col(f"_{i}")
    return found.where(kept).select(*keys, "lemma", "upos", "n_forms", "n_slots", "n", F.filter("values", lambda x: x != "_").alias("values"))


def _first(size: tuple[str, ...] = ("n_forms", "n_slots", "n")) -> Column:
    """Orders paradigms: most forms, most slots, most occurrences, then lemma and tag."""
    return F.struct(*((-F.col(c)).alias(c) for c in size), F.col("lemma"), F.col("upos"))


def telling(chosen: DataFrame, *keys: str) -> DataFrame:
    """Of the chosen paradigms, largest first, those that show a feature's value that no larger one has shown; `new` has these values.

    Each value names the largest paradigm that has it, so there is no walk along the order and no join: its place in
    the order is the paradigm itself.
    """
    values = chosen.select(*keys, _first().alias("p"), F.explode("values").alias("value"))
    first = values.groupBy(*keys, "value").agg(F.min("p").alias("p"))
    shown = first.groupBy(*keys, "p").agg(F.array_sort(F.collect_list("value")).alias("new"))  # as many as the scheme has values
    return shown.select(*keys, "p.lemma", "p.upos", *((-F.col(f"p.{c}")).alias(c) for c in ("n_forms", "n_slots", "n")), "new")


def largest(chosen: DataFrame, *keys: str) -> DataFrame:
    """The one largest paradigm of each of `keys`."""
    columns = [c for c in chosen.columns if c not in keys]
    best = chosen.groupBy(*keys).agg(F.min_by(F.struct(*columns), _first()).alias("p"))
    return best.select(*keys, *(F.col(f"p.{c}").alias(c) for c in columns))


def ranked_annotation(feats: Column, features: tuple[str, ...], values: dict[str, tuple[str, ...]]) -> Column:
    """Sort key of a cell of features by the caller's order of features and of values; others follow, by name."""

    def place(x: Column, order: tuple[str, ...]) -> Column:
        return F.when(x.isin(*order), F.array_position(F.array(*map(F.lit, order)), x)).otherwise(F.lit(len(order) + 1)) if order else F.lit(1).cast("long")

    def key(p: Column) -> Column:
        by_value = F.lit(1).cast("long")
        for feature, order in values.items():
            by_value = F.when(p["name"] == feature, place(p["value"], order).cast("long")).otherwise(by_value)
        return F.struct(place(p["name"], features).cast("long").alias("a"), p["name"].alias("b"), by_value.alias("c"), p["value"].alias("d"))

    return F.array_sort(F.transform(pairs(feats), key))


def table(counts: DataFrame, chosen: DataFrame, *keys: str, features: tuple[str, ...] = (), values: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """keys, lemma, upos, place, form, feats, n: the rows of each chosen paradigm in the caller's order of annotations."""
    rows = counts.join(chosen.select(*keys, "lemma", "upos"), [*keys, "lemma", "upos"])
    order = W.partitionBy(*keys, "lemma", "upos").orderBy(ranked_annotation(F.col("feats"), features, values or {}), "feats", "form")
    return rows.select(*keys, "lemma", "upos", F.row_number().over(order).alias("place"), "form", "feats", "n")
