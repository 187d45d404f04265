"""Surveys across treebanks: features, attributes, relations, scripts, enhanced edges, sizes by language family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.functions import edges, pairs, universal
from arborlake.operators.statistics import counted, each, top


def features(sentences: DataFrame, by: str = "lang") -> DataFrame:
    """feature, value, treebank, n; treebank TOTAL is their sum. Multiple values count each."""
    rows = each(sentences, by).select(by, F.explode(pairs(F.col("feats"))).alias("f")).select(by, F.col("f.name").alias("feature"), F.explode(F.split("f.value", ",")).alias("value"))
    sums = rows.groupBy("feature", "value", by).agg(F.count("*").alias("n"))  # the cube's finest level, aggregated once
    return sums.unionByName(sums.groupBy("feature", "value").agg(F.sum("n").alias("n")).withColumn(by, F.lit("TOTAL")))


def feature_by_tag(sentences: DataFrame, feature: str, by: str = "lang") -> DataFrame:
    """For one feature its values by tag and treebank; EMPTY is the tag's words without it."""
    value = F.coalesce(F.get(F.transform(F.filter(pairs(F.col("feats")), lambda p: p["name"] == feature), lambda p: p["value"]), F.lit(0)), F.lit("EMPTY"))
    return counted(each(sentences, by).select(by, "upos", value.alias("value")), by, "upos", "value")


def feature_pivot(sentences: DataFrame, feature: str, by: str, values: list[str]) -> DataFrame:
    """Values in rows, treebanks in columns."""
    rows = feature_by_tag(sentences, feature, by)
    return rows.groupBy("value").pivot(by, values).agg(F.sum("n")).na.fill(0)


def cooccurring(sentences: DataFrame) -> DataFrame:
    """Pairs of feature-value pairs on one word, by tag."""
    both = lambda p: F.filter(F.flatten(F.transform(p, lambda a: F.transform(p, lambda b: F.struct(a.alias("a"), b.alias("b"))))), lambda x: x["a"] < x["b"])
    parts = F.when(F.col("feats") == "_", F.array().cast("array<string>")).otherwise(F.split("feats", r"\|"))
    rows = each(sentences).select("upos", F.explode(both(parts)).alias("p")).select("upos", F.col("p.a").alias("first"), F.col("p.b").alias("second"))
    return counted(rows, "upos", "first", "second")


def attributes(sentences: DataFrame, by: str = "lang", k: int = 50) -> DataFrame:
    """MISC keys and values by treebank, the k most frequent of each key; a flag has key `_`."""
    rows = each(sentences, by).select(by, F.explode(pairs(F.col("misc"))).alias("a"))
    keyed = rows.select(by, F.when(F.col("a.value").isNull(), "_").otherwise(F.col("a.name")).alias("key"), F.coalesce("a.value", "a.name").alias("value"))
    return top(counted(keyed, by, "key", "value"), (by, "key"), "value", k)


def subtypes(sentences: DataFrame, by: str = "lang") -> DataFrame:
    """Relations of the enhanced graph with their universal part, by treebank."""
    rows = each(sentences, by).select(by, F.explode(edges(F.col("deps"))).alias("e"))
    return counted(rows.select(by, universal(F.col("e.deprel")).alias("udeprel"), F.col("e.deprel").alias("deprel")), by, "udeprel", "deprel")


#: Scripts by their property name.
SCRIPTS = ["Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai"]


def scripts(lines: DataFrame, by: str = "lang") -> DataFrame:
    """Letters of the text by script and treebank, with the most frequent letter."""
    letters = lines.select(by, F.explode(F.split(F.regexp_replace("line", r"\P{L}", ""), "")).alias("letter")).where("letter <> ''")
    counts = counted(letters, by, "letter")
    script = F.lit(None).cast("string")
    for name in reversed(SCRIPTS):
        script = F.when(F.col("letter").rlike(rf"\p{{Is{name}}}"), F.lit(name)).otherwise(script)
    rows = counts.withColumn("script", F.coalesce(script, F.lit("Other")))
    sums = rows.groupBy(by, "script").agg(F.sum("n").alias("n"), F.max_by("letter", F.struct("n", F.col("letter"))).alias("letter"))
    return sums.withColumn("percent", F.floor(F.lit(100) * F.col("n") / F.sum("n").over(W.partitionBy(by)) + F.lit(0.5)))


#: Codes (ISO 15924) of SCRIPTS, and of scripts that mix several of them.
CODES = {"Latin": "Latn", "Greek": "Grek", "Cyrillic": "Cyrl", "Hebrew": "Hebr", "Arabic": "Arab", "Devanagari": "Deva", "Han": "Hani", "Hiragana": "Hira", "Katakana": "Kana", "Hangul": "Hang", "Thai": "Thai"}
MIXED = {"Jpan": ("Hani", "Hira", "Kana"), "Kore": ("Hang", "Hani"), "Hans": ("Hani",), "Hant": ("Hani",)}


def main_scripts(found: DataFrame, expected: DataFrame, by: str = "lang") -> DataFrame:
    """Each treebank's commonest script (of `scripts`) by its code, whether it is expected, and what else is written in it.

    expected is (by, script): codes, a row for each that a language uses. A mixed code stands for its parts. A
    treebank of which nothing is known has null in `expected`, and is not told to be wrong.
    """
    code = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv)), "script"), "script")
    parts = F.try_element_at(F.create_map(*(x for k, v in MIXED.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), "script")
    known = expected.select(by, F.explode(F.coalesce(parts, F.array("script"))).alias("code")).groupBy(by).agg(F.array_sort(F.collect_set("code")).alias("expected"))  # a row for each language
    rows = found.withColumn("code", code).groupBy(by).agg(F.min_by(F.struct("code", "percent"), F.struct((-F.col("n")).alias("n"), F.col("script"))).alias("main"), F.array_sort(F.collect_set("code")).alias("codes"))
    rows = rows.join(known, by, "left")
    return rows.select(by, F.col("main.code").alias("main"), F.col("main.percent").alias("percent"), F.array_join("expected", ",").alias("expected"), F.array_contains("expected", F.col("main.code")).alias("as_expected"), F.array_join(F.array_except("codes", F.coalesce("expected", F.array().cast("array<string>"))), ",").alias("others"))


def features_json(sentences: DataFrame, by: str = "lang") -> DataFrame:
    """One JSON object for each treebank: tag, feature and value to the number of words, keys in order. Multiple values count each.

    What is nested are counts, as many as the scheme has values: they are built level by level, one group at a time.
    """
    rows = each(sentences, by).select(by, "upos", F.explode(pairs(F.col("feats"))).alias("f")).select(by, "upos", F.col("f.name").alias("feature"), F.explode(F.split("f.value", ",")).alias("value"))
    by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)  # noqa: E731  (maps have no order of their own)
    level = counted(rows, by, "upos", "feature", "value").withColumnRenamed("n", "inside")
    for keys, name in (((by, "upos", "feature"), "value"), ((by, "upos"), "feature"), ((by,), "upos")):
        entries = F.collect_list(F.struct(F.col(name).alias("k"), F.col("inside").alias("v")))
        level = level.groupBy(*keys).agg(F.map_from_entries(F.array_sort(entries, by_key)).alias("inside"))
    return level.select(by, F.to_json("inside").alias("json"))


def parallel(trees: DataFrame, by: str = "source") -> DataFrame:
    """Parallel collections: distinct core sentences of each treebank, and how many are alternatives or parts."""
    names = F.transform(F.filter("comments", lambda c: c.rlike(r"\A#\s*parallel_id\s*=\s*\S")), lambda c: F.regexp_extract(c, r"=\s*(\S+)", 1))
    rows = trees.select(by, F.explode(names).alias("id")).select(by, F.substring_index("id", "/", 1).alias("collection"), F.regexp_extract("id", r"\A[^/]+/[^/]+", 0).alias("core"), "id")
    return rows.groupBy("collection", by).agg(F.countDistinct("core").alias("n_core"), (F.count("*") - F.countDistinct("core")).alias("n_extra"))


def families(sizes: DataFrame, registry: DataFrame) -> DataFrame:
    """Languages and words by family and genus, with totals. `registry` is language, family, genus."""
    return sizes.join(F.broadcast(registry), "lang").rollup("family", "genus").agg(F.countDistinct("lang").alias("n_languages"), F.sum("n_words").alias("n_words"))  # a row for each language


#: Words that full size takes, and the weights of the score's parts.
FULL_SIZE, WEIGHTS = 1_000_000, {"size": 10, "split": 2, "lemmas": 3, "tags": 3, "features": 3, "relations": 3, "genres": 3}


def stars(treebanks: DataFrame) -> DataFrame:
    """A treebank's score and half-stars from n_words, n_train, n_dev, n_test, lemmas, tags, features, relations (0 to 1), n_genres, available, valid."""
    thousands = F.least("n_words", F.lit(FULL_SIZE)) / 1000
    of_size = F.greatest(F.coalesce(F.ln(F.nullif(thousands * thousands, F.lit(0.0))), F.lit(0.0)), F.lit(0.0)) / F.ln(F.lit(float(FULL_SIZE)))
    split = F.lit(0.01) + F.when(F.col("n_train") > 10000, 0.33).otherwise(0) + F.when(F.col("n_dev") >= 10000, 0.33).otherwise(0) + F.when(F.col("n_test") >= 10000, 0.33).otherwise(0)
    parts: dict[str, Column] = {"size": of_size, "split": split, **{c: F.col(c) for c in ("lemmas", "tags", "features", "relations")}, "genres": F.least(F.col("n_genres") / 18, F.lit(1.0))}
    score = sum((w * parts[c] for c, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    score = score * F.when(F.col("available"), 1.0).otherwise(0.1) * F.when(F.col("valid"), 1.0).otherwise(0.01)
    return treebanks.withColumn("score", F.round(score, 6)).withColumn("stars", F.floor(F.lit(10) * score + F.lit(0.5)) / 2)


def sized_splits(treebanks: DataFrame) -> DataFrame:
    """Findings on how a treebank's words (n_words, n_sentences) are split into train, dev and test."""
    rule = lambda name, c: F.when(c, F.lit(name))
    n, test = F.col("n_words"), F.col("n_test")
    hits = F.array(
        rule("test-missing", test == 0), rule("test-too-small", (n > 10000) & (test < 10000)), rule("train-too-small", (n > 20000) & (F.col("n_train") < 10000)),
        rule("dev-too-small", (n > 30000) & (F.col("n_dev") < F.least(F.lit(9000), F.floor((n - test) / 10)))), rule("treebank-too-small", (F.col("n_sentences") < 20) | (n < 100)),
    )
    return treebanks.select("lang", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("finding"))


def similar_names(names: DataFrame, threshold: float = 0.83) -> DataFrame:
    """Pairs of names (column name) whose letters differ little: one minus half the differences of letter counts over the mean length.

    Names that are similar enough have lengths within a factor, and meet by length, each with the lengths it may match.
    """
    lower = F.lower("name")
    rows = names.select("name", F.length("name").alias("n"), F.array_sort(F.split(lower, "")).alias("letters")).distinct()
    widest = F.floor(F.col("n") * (1 + 2 * (1 - threshold)) / threshold).cast("int")
    near = rows.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("letters").alias("la"), F.explode(F.sequence(F.col("n"), F.greatest("n", widest))).alias("nb"))
    other = rows.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("letters").alias("lb"))
    both = near.join(other, "nb").where((F.col("a") < F.col("b")) | (F.col("na") < F.col("nb")))
    times = lambda letters, x: F.size(F.filter(letters, lambda y: y == x))
    differ = F.aggregate(F.array_distinct(F.concat("la", "lb")), F.lit(0), lambda s, x: s + F.abs(times(F.col("la"), x) - times(F.col("lb"), x)))
    score = F.round(1 - (differ / 2) / ((F.col("na") + F.col("nb")) / 2), 6)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), score.alias("score")).where(F.col("score") >= threshold)


def release_changes(before: DataFrame, after: DataFrame, share: float = 0.1) -> DataFrame:
    """Treebanks (name, n_words) that are new, gone, or changed by more than `share` of their size."""
    both = before.select("name", F.col("n_words").alias("n_before")).join(after.select("name", F.col("n_words").alias("n_after")), "name", "full")
    change = F.when(F.col("n_before").isNull(), "new").when(F.col("n_after").isNull(), "gone").when(F.abs(F.col("n_after") - F.col("n_before")) > share * F.col("n_before"), "changed")
    return both.withColumn("change", change).where("change is not null")


def side_by_side(words: DataFrame, by: str, values: tuple[str, ...]) -> DataFrame:
    """section, name, and for each of `values` the share of its words in percent: tags, relations and feature sets, counted in one pass."""
    facts = words.select(by, F.explode(F.array(*(F.struct(F.lit(s).alias("section"), c.alias("name")) for s, c in (("tag", F.col("upos")), ("relation", F.col("deprel")), ("features", F.col("feats")), ("all", F.lit(None).cast("string")))))).alias("x")).select(by, "x.*")
    counts = facts.groupBy(by, "section", "name").agg(F.count("*").alias("n"))
    # The totals come with the counts; a row for each value.
    wide = counts.groupBy("section", "name").pivot(by, list(values)).agg(F.sum("n"))
    totals = wide.where("section = 'all'").select(*(F.col(v).alias(f"_{v}") for v in values))
    share = lambda v: F.coalesce(F.floor(100 * F.col(v) / F.col(f"_{v}") + 0.5), F.lit(0)).alias(v)
    return wide.where("section <> 'all'").crossJoin(F.broadcast(totals)).select("section", "name", *map(share, values))  # one row


def companions(words: DataFrame, often: float = 0.1, share: float = 0.5) -> DataFrame:
    """upos, feature, other, n, percent: values that more than `share` of a tag's words with a value have too, among features that more than `often` of the tag's words have."""
    parts = F.when(F.col("feats") == "_", F.array().cast("array<string>")).otherwise(F.split("feats", r"\|"))
    rows = words.select("upos", parts.alias("f"))
    name = lambda c: F.substring_index(c, "=", 1)
    # Per tag: words (no feature), words with a feature, words with a value, by one pass with grouping sets.
    marks = rows.select("upos", F.explode(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("feature"), F.lit(None).cast("string").alias("value"))), F.transform("f", lambda x: F.struct(name(x).alias("feature"), x.alias("value"))))).alias("x")).select("upos", "x.*")
    sets = marks.groupingSets([[F.col("upos"), F.col("feature")], [F.col("upos"), F.col("value")]], F.col("upos"), F.col("feature"), F.col("value")).agg(F.count("*").alias("n"), F.grouping_id().alias("set"))
    total = sets.where("set = 1 and feature is null").select("upos", F.col("n").alias("total"))
    used = sets.where("set = 1 and feature is not null").join(total, "upos").where(F.col("n") > often * F.col("total")).select("upos", "feature")
    values = sets.where("set = 2 and value is not null").select("upos", F.col("value").alias("feature"), F.col("n").alias("of"))
    pairs = rows.select("upos", F.explode("f").alias("feature"), "f").select("upos", "feature", F.explode("f").alias("other")).where("feature <> other").groupBy("upos", "feature", "other").agg(F.count("*").alias("n"))
    keep = lambda df, c: df.withColumn("_used", name(F.col(c))).join(used.withColumnRenamed("feature", "_used"), ["upos", "_used"], "left_semi").drop("_used")
    return keep(keep(pairs, "feature"), "other").join(values, ["upos", "feature"]).where(F.col("n") > share * F.col("of")).select("upos", "feature", "other", "n", F.floor(100 * F.col("n") / F.col("of") + 0.5).alias("percent"))
