"""Reader, parser and writer of CoNLL-U.

A sentence is a block of lines that a blank or white-space-only line ends; `sources.files` reads them by byte
ranges, so one large file is read by many tasks. Parsing is a projection: comments and nodes become arrays of the sentence's row, and nothing is
exploded or shuffled until an operator asks for single nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.sources import files

#: The ten columns of a node line.
COLUMNS = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """file, portion, sent_no (from 1 in each file), raw: the block's lines without the blank line that ends it, but with one of white space.

    What checks need of how a block ended, and lines within the file, `sources.files.read` has.
    """
    rows = files.read(spark, path, suffix="")
    return rows.select("file", "portion", "sent_no", F.regexp_replace("raw", r"\n\z", "").alias("raw")).where("raw <> ''")


def parsed(sentences: DataFrame) -> DataFrame:
    """sentences (raw) with `comments` and `nodes`; lines that are neither are left to the checks."""
    lines = F.split("raw", "\n")
    return sentences.withColumn("comments", F.filter(lines, lambda x: x.startswith("#"))).withColumn("nodes", F.transform(F.transform(F.filter(lines, lambda x: x.rlike(r"\A[0-9]")), lambda x: F.split(x, "\t")), node_of))


def node_fields(cells: Column) -> dict[str, Column]:
    """The ten columns of a line's cells, kind (word, mwt, empty), and ids as numbers; 1.1 and 1.10 stay apart."""
    cell = lambda i: F.coalesce(F.get(cells, F.lit(i)), F.lit("_"))
    first = cell(0)
    kind = F.when(first.contains("-"), "mwt").when(first.contains("."), "empty").otherwise("word")
    number = lambda text: F.coalesce(text.try_cast("int"), F.lit(0))
    major = number(F.substring_index(F.substring_index(first, "-", 1), ".", 1))
    minor, last = F.when(first.contains("."), number(F.substring_index(first, ".", -1))).otherwise(0), F.when(first.contains("-"), number(F.substring_index(first, "-", -1))).otherwise(0)
    return {**{c: cell(i) for i, c in enumerate(COLUMNS)}, "kind": kind, "major": major, "minor": minor, "last": last}


def node_of(cells: Column) -> Column:
    return F.struct(*(c.alias(k) for k, c in node_fields(cells).items()))


def comment(comments: Column, key: str) -> Column:
    """The value of the first `# key = value` comment, or null."""
    found = F.filter(comments, lambda c: c.rlike(rf"\A#\s*{key}\s*=\s*"))
    return F.regexp_replace(F.get(found, F.lit(0)), rf"\A#\s*{key}\s*=\s*", "")


def line_of(node: Column) -> Column:
    return F.concat_ws("\t", *(node[c] for c in COLUMNS))


def rendered(comments: Column, nodes: Column) -> Column:
    """The block of a sentence, without the blank line after it."""
    return F.array_join(F.concat(comments, F.transform(nodes, line_of)), "\n")


def ordered(nodes: Column) -> Column:
    """Nodes by id, a range before its first word, with features in order of their lower-cased names and edges by head and label."""
    key = lambda n: F.struct(n["major"].alias("a"), n["minor"].alias("b"), (-n["last"]).alias("c"))
    tidy = F.transform(nodes, lambda n: n.withField("feats", sorted_features(n["feats"])).withField("deps", sorted_edges(n["deps"])))
    return F.transform(F.array_sort(F.transform(tidy, lambda n: F.struct(key(n).alias("key"), n.alias("node")))), lambda x: x["node"])


def sorted_features(feats: Column) -> Column:
    parts = F.array_sort(F.transform(F.split(feats, r"\|"), lambda x: F.struct(F.lower(F.substring_index(x, "=", 1)).alias("k"), x.alias("v"))))
    return F.when(feats == "_", feats).otherwise(F.array_join(F.transform(parts, lambda x: x["v"]), "|"))


def sorted_edges(deps: Column) -> Column:
    """Also drops repeated edges."""
    head = lambda x: F.substring_index(x, ":", 1)
    key = lambda x: F.struct(F.substring_index(head(x), ".", 1).cast("int").alias("a"), F.when(head(x).contains("."), F.substring_index(head(x), ".", -1).cast("int")).otherwise(0).alias("b"), F.regexp_replace(x, r"\A[^:]*:", "").alias("c"), x.alias("v"))
    parts = F.array_sort(F.transform(F.array_distinct(F.split(deps, r"\|")), key))
    return F.when(deps == "_", deps).otherwise(F.array_join(F.transform(parts, lambda x: x["v"]), "|"))


def write(sentences: DataFrame, path: str) -> None:
    """Writes raw blocks as text, each with its blank line, a file for each partition in the rows' order."""
    sentences.select(F.concat("raw", F.lit("\n")).alias("value")).write.option("lineSep", "\n").text(path)


def nodes_table(sentences: DataFrame, *keys: str) -> DataFrame:
    """One row for each node of sentences (keys, raw): lines are exploded before they are parsed, so columns nobody reads are not."""
    rows = sentences.select(*keys, F.explode(F.filter(F.split("raw", "\n"), lambda x: x.rlike(r"\A[0-9]"))).alias("line")).select(*keys, F.split("line", "\t").alias("cells"))
    return rows.select(*keys, *(c.alias(k) for k, c in node_fields(F.col("cells")).items()))


def exploded(trees: DataFrame, *keys: str) -> DataFrame:
    """One row for each node of sentences whose nodes have been rewritten."""
    return nodes_table(trees.select(*keys, rendered(F.array().cast("array<string>"), F.col("nodes")).alias("raw")), *keys)
