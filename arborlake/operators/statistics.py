"""Corpus statistics over words (a row each) or sentences that hold their words as an array (see sources.synthetic).

What a sentence can count by itself (parents, neighbours, degrees, sizes) is counted in its row; single words
are only grouped, with partial aggregates before the exchange. No word is joined with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.functions import pairs, universal, value_of

SENTENCE = ("doc_id", "sent_no")


def each(rows: DataFrame, *keys: str, array: str = "words") -> DataFrame:
    """One row for each word, of sentences with an array or of words as they are."""
    if array not in rows.columns:
        return rows
    return rows.select(*keys, F.explode(array).alias("w")).select(*keys, "w.*")


def size(sentences: DataFrame, *keys: str) -> DataFrame:
    """Sentences, surface tokens, ranges, words, empty nodes, distinct forms and lemmas of sentences as text (raw), in one pass.

    Each sentence gives a row for itself and one for each node line; a line is cut behind its lemma at most.
    """
    lines = F.concat(F.array(F.lit("")), F.filter(F.split("raw", "\n"), lambda x: x.rlike(r"\A[0-9]")))
    rows = sentences.select(*keys, F.explode(lines).alias("line"))
    name = F.substring_index("line", "\t", 1)
    kind = F.when(F.col("line") == "", "sentence").when(name.contains("-"), "mwt").when(name.contains("."), "empty").otherwise("word")
    rows = rows.select(*keys, kind.alias("kind"), F.when(kind == "word", F.split("line", "\t", 4)).alias("cells"), F.when(kind == "mwt", name).alias("name"))
    # Words are counted by form and lemma first, the rest in one group each, so the distinct counts see few rows.
    covered = F.substring_index("name", "-", -1).try_cast("int") - F.substring_index("name", "-", 1).try_cast("int")
    kinds = rows.groupBy(*keys, "kind", F.get("cells", F.lit(1)).alias("form"), F.get("cells", F.lit(2)).alias("lemma")).agg(F.count("*").alias("n"), F.coalesce(F.sum(covered), F.lit(0)).alias("covered"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    return kinds.groupBy(*keys).agg(of("sentence").alias("n_sentences"), (of("word") - F.sum("covered")).alias("n_tokens"), of("mwt").alias("n_ranges"), of("word").alias("n_words"), of("empty").alias("n_empty"), F.countDistinct("form").alias("n_forms"), F.countDistinct(F.nullif("lemma", F.lit("_"))).alias("n_lemmas"))


def size_rollup(sentences: DataFrame) -> DataFrame:
    """Totals by language and source, by language, and over all."""
    return sentences.select("lang", "source", F.size("words").alias("n")).rollup("lang", "source").agg(F.count("*").alias("n_sentences"), F.sum("n").alias("n_words"))


def top(counted: DataFrame, keys: tuple[str, ...], value: str, k: int) -> DataFrame:
    """The k most frequent values of each key, ties by value; Spark prunes each map task to k rows a group."""
    order = W.partitionBy(*keys).orderBy(F.desc("n"), value)
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def counted(rows: DataFrame, *keys: str | Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def top_lemmas(sentences: DataFrame, k: int = 15) -> DataFrame:
    return top(counted(each(sentences, "lang").where("lemma <> '_'"), "lang", "lemma"), ("lang",), "lemma", k)


def top_forms_of_tags(sentences: DataFrame, k: int = 10) -> DataFrame:
    return top(counted(each(sentences), "upos", "form"), ("upos",), "form", k)


def tag_ranks(sentences: DataFrame) -> DataFrame:
    """Each tag's tokens, types and lemmas in a language, with its rank by each, its share, and forms for each lemma."""
    kinds = counted(each(sentences, "lang"), "lang", "upos", "form", "lemma")
    sums = kinds.groupBy("lang", "upos").agg(F.sum("n").alias("tokens"), F.countDistinct("form").alias("types"), F.countDistinct(F.nullif("lemma", F.lit("_"))).alias("lemmas"))
    rank = lambda c: F.row_number().over(W.partitionBy("lang").orderBy(F.desc(c), "upos")).alias(f"rank_{c}")
    share = F.floor(F.lit(100) * F.col("tokens") / F.sum("tokens").over(W.partitionBy("lang")) + F.lit(0.5)).alias("percent")
    return sums.select("*", rank("tokens"), rank("types"), rank("lemmas"), share, F.round(F.col("types") / F.nullif("lemmas", F.lit(0)), 6).alias("forms_per_lemma"))


def direction_length(words: DataFrame) -> DataFrame:
    """Words of each relation before their heads, their summed distance, and the share before; the root stands at 0."""
    rows = words.groupBy("lang", "deprel").agg(F.count("*").alias("n"), F.count_if(F.col("id") < F.col("head")).alias("n_before"), F.sum(F.abs(F.col("id") - F.col("head"))).alias("distance"))
    return rows.withColumn("percent_before", F.floor(F.lit(100) * F.col("n_before") / F.col("n") + F.lit(0.5)))


def _parent(words: Column, w: Column, field: str) -> Column:
    """A field of the parent, within the sentence's row; null for the root."""
    return F.get(words, (w["head"] - 1).cast("int"))[field]


def tag_pairs(sentences: DataFrame) -> DataFrame:
    """Counts of (parent tag, relation, child tag). The parent is an element of the same array: no join."""
    made = F.transform("words", lambda w: F.struct(_parent(F.col("words"), w, "upos").alias("parent_upos"), w["deprel"].alias("deprel"), w["upos"].alias("upos")))
    return counted(sentences.select(F.explode(made).alias("p")).select("p.*").where("parent_upos is not null"), "parent_upos", "deprel", "upos")


def detailed_pairs(sentences: DataFrame) -> DataFrame:
    """Counts of (relation, parent's tag with its VerbForm, child's tag with its Case), within the sentence's row."""
    marked = lambda tag, feats, name: F.concat(tag, F.when(value_of(feats, name) == "", "").otherwise(F.concat(F.lit("-"), value_of(feats, name))))
    made = F.transform("words", lambda w: F.struct(w["deprel"].alias("deprel"), marked(_parent(F.col("words"), w, "upos"), _parent(F.col("words"), w, "feats"), "VerbForm").alias("parent"), marked(w["upos"], w["feats"], "Case").alias("child")))
    return counted(sentences.select("lang", F.explode(made).alias("p")).select("lang", "p.*").where("parent is not null"), "lang", "deprel", "parent", "child")


def child_degrees(sentences: DataFrame) -> DataFrame:
    """How many words have how many children: runs of equal heads in the sentence's sorted heads."""
    rows = sentences.select(F.size("words").alias("n"), F.array_sort(F.filter(F.transform("words", lambda w: w["head"]), lambda h: h > 0)).alias("heads"))
    last = F.filter(F.sequence(F.lit(0), F.size("heads") - 1), lambda i: ~F.get("heads", i).eqNullSafe(F.get("heads", i + 1)))
    rows = rows.select("n", F.when(F.size("heads") > 0, last).otherwise(F.array().cast("array<int>")).alias("ends"))
    runs = F.transform("ends", lambda x, k: x - F.coalesce(F.when(k > 0, F.get("ends", k - 1)), F.lit(-1)))
    return counted(rows.select(F.explode(F.concat(runs, F.array_repeat(F.lit(0), F.col("n") - F.size("ends")))).alias("degree")).withColumn("degree", F.col("degree").cast("long")), "degree")


def ambiguous_forms(sentences: DataFrame) -> DataFrame:
    """Forms that occur with several tags."""
    kinds = counted(each(sentences, "lang"), "lang", "form", "upos")
    return kinds.groupBy("lang", "form").agg(F.count("*").alias("n_tags"), F.sum("n").alias("n")).where("n_tags > 1")


def paradigm_sizes(sentences: DataFrame) -> DataFrame:
    """How many lemmas have how many forms."""
    sizes = each(sentences, "lang").where("lemma <> '_'").select("lang", "lemma", "form").distinct().groupBy("lang", "lemma").agg(F.count("*").alias("n_forms"))
    return sizes.groupBy("lang", "n_forms").agg(F.count("*").alias("n_lemmas"))


def paradigms(sentences: DataFrame, min_forms: int = 2, upos: str = "", lemma: str = "", k: int = 3) -> DataFrame:
    """The richest paradigms of each tag: distinct forms of a lemma, filtered by lemma expression and tag, largest first."""
    rows = each(sentences).where("lemma <> '_'")
    rows = rows.where(F.col("upos") == upos) if upos else rows
    rows = rows.where(F.col("lemma").rlike(lemma)) if lemma else rows
    sizes = rows.select("upos", "lemma", "form", "feats").distinct().groupBy("upos", "lemma").agg(F.countDistinct("form").alias("n"), F.countDistinct("feats").alias("n_feats")).where(F.col("n") >= min_forms)
    return top(sizes, ("upos",), "lemma", k)


def tag_trigrams(sentences: DataFrame) -> DataFrame:
    """Counts of three tags in a row, with sentence bounds, for each language; neighbours are elements of the same array."""
    at = lambda i: F.coalesce(F.when(i >= 0, F.get("words", i)["upos"]), F.lit("#"))
    made = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.struct(at(i - 1).alias("t1"), at(i).alias("t2"), at(i + 1).alias("t3")))
    return counted(sentences.where("size(words) > 0").select("lang", F.explode(made).alias("t")).select("lang", "t.*"), "lang", "t1", "t2", "t3")


def divergence(trigrams: DataFrame) -> DataFrame:
    """For each pair of languages the Kullback-Leibler divergence of the target's tag trigrams from the source's (add one for the unseen)."""
    sums = trigrams.groupBy("lang").agg(F.sum("n").alias("total"))
    target = trigrams.join(F.broadcast(sums), "lang").select(F.col("lang").alias("target"), "t1", "t2", "t3", (F.col("n") / F.col("total")).alias("t"))
    # A few languages, each with at most 18 cubed trigrams: the pairs are bounded by the tag set.
    pair = target.join(F.broadcast(sums.select(F.col("lang").alias("source"), "total")), F.col("source") != F.col("target"))
    source = trigrams.select(F.col("lang").alias("source"), "t1", "t2", "t3", "n")
    seen = pair.join(source, ["source", "t1", "t2", "t3"], "left").withColumn("s", F.coalesce("n", F.lit(1)) / F.col("total"))
    return seen.groupBy("target", "source").agg(F.round(F.sum(F.col("t") * F.ln(F.col("t") / F.col("s"))), 6).alias("divergence"))


def agreement(sentences: DataFrame) -> DataFrame:
    """How often child and parent agree in the value of each feature that both have, by relation."""
    made = F.transform("words", lambda w: F.struct(universal(w["deprel"]).alias("udeprel"), pairs(w["feats"]).alias("mine"), F.map_from_entries(pairs(_parent(F.col("words"), w, "feats"))).alias("theirs")))
    rows = sentences.select(F.explode(made).alias("p")).select("p.udeprel", F.explode("p.mine").alias("f"), "p.theirs").select("udeprel", F.col("f.name").alias("feature"), (F.col("f.value") == F.col("theirs")[F.col("f.name")]).alias("same"))
    return rows.where("same is not null").groupBy("udeprel", "feature").agg(F.count_if("same").alias("agree"), F.count_if(~F.col("same")).alias("disagree"))


def folded_case(sentences: DataFrame) -> DataFrame:
    """Counts of forms by tag, `Foo` counted as `foo` where `foo` occurs with the tag too."""
    kinds = counted(each(sentences), "upos", "form")
    # The lower-cased form's own row is in the same group, so one pass tells whether it occurs.
    group = W.partitionBy("upos", F.lower("form"))
    folded = kinds.withColumn("key", F.when(F.max((F.col("form") == F.lower("form")).cast("int")).over(group) == 1, F.lower("form")).otherwise(F.col("form")))
    return folded.groupBy("upos", F.col("key").alias("form")).agg(F.sum("n").alias("n"))


def duplicate_sentences(sentences: DataFrame) -> DataFrame:
    """Sentences that occur more than once, with their first place."""
    place = F.struct("doc_id", "sent_no")
    found = sentences.groupBy("line").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    return found.select("line", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.sent_no").alias("first_sent"))


def dedup_first(sentences: DataFrame) -> DataFrame:
    """The first of each sentence, by document and number: an aggregate, so copies meet pre-aggregated."""
    found = sentences.groupBy("line").agg(F.min(F.struct("doc_id", "sent_no")).alias("first"))
    return found.select(F.col("first.doc_id").alias("doc_id"), F.col("first.sent_no").alias("sent_no"), "line")


def dedup_against(sentences: DataFrame, train: DataFrame) -> DataFrame:
    """Sentences whose text the training portion does not have."""
    return sentences.join(train.select("line").distinct(), "line", "left_anti")


def overlap(sentences: DataFrame, portion: Column) -> DataFrame:
    """How many distinct texts two portions have in common. Texts meet by their set of portions, not pair by pair."""
    sets = sentences.groupBy("line").agg(F.array_sort(F.collect_set(portion)).alias("in")).where("size(in) > 1")
    both = F.filter(F.flatten(F.transform("in", lambda a: F.transform("in", lambda b: F.struct(a.alias("a"), b.alias("b"))))), lambda p: p["a"] < p["b"])
    return counted(sets.select(F.explode(both).alias("p")).select(F.col("p.a").alias("first"), F.col("p.b").alias("second")), "first", "second")


def detokenize(sentences: DataFrame) -> DataFrame:
    """Each sentence's text: words joined by spaces, none after SpaceAfter=No."""
    pieces = F.transform("words", lambda w: F.concat(w["form"], F.when(F.array_contains(F.split(w["misc"], r"\|"), "SpaceAfter=No"), "").otherwise(" ")))
    return sentences.select(*SENTENCE, F.rtrim(F.array_join(pieces, "")).alias("text"))


def ranges(trees: DataFrame, stem: str = "") -> DataFrame:
    """Lower-cased range forms with the words they cover, counted; both are in the sentence's row.

    With `stem`, a verb or auxiliary at the head of a range of two words, whose form begins the range's, is written
    so in both: what is left are the endings that verbs take.
    """
    rows = trees.withColumn("_words", F.transform(F.filter("nodes", lambda w: w["kind"] == "word"), lambda w: F.struct(F.lower(w["form"]).alias("form"), w["upos"].alias("upos"))))

    def made(n: Column) -> Column:
        covered = F.transform(F.slice("_words", n["major"], n["last"] - n["major"] + 1), lambda w: w["form"])
        form, first = F.lower(n["form"]), F.get("_words", n["major"] - 1)
        if not stem:
            return F.struct(form.alias("form"), F.array_join(covered, " ").alias("words"))
        verb = (n["last"] - n["major"] == 1) & first["upos"].isin("VERB", "AUX") & F.startswith(form, first["form"])
        rest = F.concat(F.lit(stem), F.substring(form, F.length(first["form"]) + 1, F.length(form)))
        return F.struct(F.when(verb, rest).otherwise(form).alias("form"), F.when(verb, F.concat(F.lit(stem + " "), F.get("_words", n["major"])["form"])).otherwise(F.array_join(covered, " ")).alias("words"))

    return counted(rows.select("lang", F.explode(F.transform(F.filter("nodes", lambda n: n["kind"] == "mwt"), made)).alias("r")).select("lang", "r.*"), "lang", "form", "words")


def tag_runs(sentences: DataFrame, upos: str = "PROPN") -> DataFrame:
    """Maximal runs of words with the tag, as text: a fold over the sentence's words, joined by SpaceAfter."""
    glued = lambda w: F.array_contains(F.split(w["misc"], r"\|"), "SpaceAfter=No")
    mark, space = "\u0001", " "
    marked = F.transform("words", lambda w: F.when(w["upos"] == upos, F.concat(w["form"], F.when(glued(w), "").otherwise(space))).otherwise(mark))
    runs = F.filter(F.transform(F.split(F.array_join(marked, ""), mark), lambda x: F.rtrim(x)), lambda x: x != "")
    return counted(sentences.select("lang", F.explode(runs).alias("run")), "lang", "run")


def shared_lemmas(sentences: DataFrame, first: str, second: str) -> DataFrame:
    """Lemmas that occur with both tags in a language."""
    of = lambda tag: each(sentences, "lang").where((F.col("upos") == tag) & (F.col("lemma") != "_")).select("lang", "lemma")
    return of(first).intersect(of(second))


def unused_tags(sentences: DataFrame, tags: list[str]) -> DataFrame:
    """Tags of the scheme that a language does not use."""
    used = each(sentences, "lang").select("lang", "upos").distinct()
    every = used.select("lang").distinct().select("lang", F.explode(F.array(*map(F.lit, tags))).alias("upos"))
    return every.join(used, ["lang", "upos"], "left_anti")


def examples(sentences: DataFrame) -> DataFrame:
    """For each relation an example: the first sentence of at most 80 characters, or else the shortest, by place.

    Two scans: least numbers by relation, which tasks keep in a table of a row each, then the sentences that have them.
    Texts are neither sorted nor moved before they are among the few.
    """
    whole = sentences.select("doc_id", "sent_no", F.array_distinct(F.transform("words", lambda w: w["deprel"])).alias("rels"), F.array_join(F.transform("words", lambda w: w["form"]), " ").alias("text"))
    # Text and length are made before the relations are exploded, else once for each of them.
    rows = whole.withColumn("n", F.length("text")).select("doc_id", "sent_no", "n", "text", F.explode("rels").alias("deprel"))
    long, short = F.col("n") > 80, F.col("n") <= 80
    least = rows.groupBy("deprel").agg(F.count_if(short).alias("n_short"), F.count_if(short & F.col("doc_id").isNull()).alias("n_null"), F.min(F.when(short, F.col("doc_id"))).alias("doc"), F.min(F.when(long, F.col("n"))).alias("size"))
    least = least.select(F.col("deprel").alias("_deprel"), "n_short", F.when(F.col("n_null") == 0, F.col("doc")).alias("doc"), "size")
    chosen = F.when(F.col("n_short") > 0, short & F.col("doc_id").eqNullSafe(F.col("doc"))).otherwise(long & (F.col("n") == F.col("size")))
    few = rows.join(F.broadcast(least), (F.col("deprel") == F.col("_deprel")) & chosen)
    return few.groupBy("deprel").agg(F.min_by("text", F.struct("doc_id", "sent_no")).alias("example"))


def tenfold(sentences: DataFrame, *keys: str) -> DataFrame:
    """Each sentence's fold: cumulative words, at the sentence's end, in tenths of the treebank's.

    Sums by document come first, so the running sum over a treebank runs over documents; sentences run within theirs.
    """
    rows = sentences.select(*keys, *SENTENCE, F.size("words").cast("long").alias("n"))
    docs = rows.groupBy(*keys, "doc_id").agg(F.sum("n").alias("m"))
    ahead = W.partitionBy(*keys).orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    docs = docs.select(*keys, "doc_id", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("before"), F.sum("m").over(W.partitionBy(*keys)).alias("total"))
    within = W.partitionBy(*keys, "doc_id").orderBy("sent_no").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(docs, [*keys, "doc_id"])
    return rows.select(*keys, *SENTENCE, F.least(F.floor((F.col("before") + F.col("inside")) * 10 / F.col("total")), F.lit(9)).alias("fold"))


def cut(sentences: DataFrame, first: str, last: str) -> DataFrame:
    """Sentences from the one named first to the one named last, in order of place: two places, then a filter."""
    name = F.concat("doc_id", F.lit("-"), "sent_no")
    place = F.struct("doc_id", "sent_no")
    bounds = sentences.agg(F.min(F.when(name == first, place)).alias("a"), F.max(F.when(name == last, place)).alias("b"))
    return sentences.join(F.broadcast(bounds), (place >= F.col("a")) & (place <= F.col("b"))).drop("a", "b")  # one row


def by_id(names: Column) -> list[Column]:
    """Sort keys of sentence ids: the number in front, then the text."""
    return [F.coalesce(F.nullif(F.regexp_extract(names, r"\A([0-9]{1,18})", 1), F.lit("")).cast("long"), F.lit(0)).asc(), names.asc()]
