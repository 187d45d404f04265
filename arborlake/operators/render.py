"""Reports as tables of lines: a treebank's statistics in one long table, XML, Markdown; order by a locale's alphabet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.operators.statistics import each, top

SECTIONS = ("tag", "feat", "dep")


def report(sentences: DataFrame, *keys: str, k: int = 10, relative: bool = False) -> DataFrame:
    """section (tag, feat, dep), name, n, upos (of features), examples: k lemmas of tags, k forms of features; share of all words if relative.

    Numbers and tags are counted over sections and names alone, examples without tags: each word's form or lemma is
    exchanged once, and not for relations.
    """
    words = each(sentences, *keys)
    feats = F.filter(F.split("feats", r"\|"), lambda x: x != "_")
    fact = lambda section, name, other: F.struct(F.lit(section).alias("section"), name.alias("name"), other.alias("other"))
    group = (*keys, "section", "name")

    def facts(fixed: list[Column], of_feature: str) -> DataFrame:
        every = F.concat(F.array(*fixed), F.transform(feats, lambda x: fact("feat", x, F.col(of_feature))))
        return words.select(*keys, F.explode(every).alias("f")).select(*keys, "f.*").groupBy(*group, "other").agg(F.count("*").alias("n"))

    best = top(facts([fact("tag", F.col("upos"), F.col("lemma"))], "form").withColumnRenamed("other", "example"), group, "example", k)
    shown = best.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "example"))), lambda x: x["example"]), ", ").alias("examples"))
    totals = facts([fact("tag", F.col("upos"), F.lit("")), fact("dep", F.col("deprel"), F.lit(""))], "upos").groupBy(*group).agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("other")), ",").alias("upos"))
    out = totals.join(shown, list(group), "left").withColumn("examples", F.coalesce("examples", F.lit("")))
    if relative:
        whole = F.sum(F.when(F.col("section") == "tag", F.col("n"))).over(W.partitionBy(*keys))  # over the report's few rows
        out = out.withColumn("n", F.col("n") / whole)
    return out


def escaped(value):
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(mark), F.lit(entity))
    return value


def xml(report: DataFrame) -> DataFrame:
    """A line for each row of a report; `--` in a comment becomes a dash, which XML demands."""
    name, n = escaped(F.col("name")), F.col("n").cast("string")
    remark = F.when(F.col("examples") == "", "").otherwise(F.concat(F.lit("<!-- "), F.replace("examples", F.lit("--"), F.lit("–")), F.lit(" -->")))
    feat = F.format_string('<feat name="%s" value="%s" upos="%s">%s</feat>', F.substring_index(name, "=", 1), F.regexp_replace(name, r"\A[^=]*=", ""), F.col("upos"), n)
    plain = F.format_string('<%s name="%s">%s</%s>', F.col("section"), name, n, F.col("section"))
    return report.withColumn("line", F.concat(F.when(F.col("section") == "feat", feat).otherwise(plain), remark))


def markdown(rows: DataFrame, *columns: str) -> DataFrame:
    """place (0 header, 1 rule, 2 rows), line; null cells are empty, bars and line breaks within cells are made safe."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|"), r"\s*[\r\n]+\s*", "<br>")
    body = rows.select(F.lit(2).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))
    head = [(0, "| " + " | ".join(columns) + " |"), (1, "|" + " --- |" * len(columns))]
    return rows.sparkSession.createDataFrame(head, "place int, line string").unionByName(body)


def collated(rows: DataFrame, column: str, locale: str, *keys: str) -> DataFrame:
    """rank by the locale's alphabet (so that in `cs` ch follows h), accents and case after letters, ties by code points."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.collate(column, locale), column)))
