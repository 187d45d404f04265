"""Exact duplicates by progressive refinement, in DataFrame functions alone.

Texts are equal when identical after every run of white space (0x20, 0x09-0x0D) has become one space. A first
scan writes each row's normalised length and the hash of its first `prefix` characters, 12 bytes a row. Rows
are then grouped by length; those whose length others share, by length and prefix hash; a second scan takes
the full SHA-256 of the rows whose (length, prefix) others share, and only these are grouped by it. Groups are
counted on the map side first, so thousands of copies of one text are a row for each task; what joins them
back has one row for each key and is written, so that Spark can split a hot key's rows.

Defined results: null counts as empty, and empty texts are equal; of equal texts the row of least doc_id stays,
null after all others, and of rows with that doc_id exactly one; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import dropped, stored

PREFIX = 256


def normalised(text: Column) -> Column:
    """text with one space for each run of white space; null is empty. Single spaces, the most, are not touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r][ \t-\r]*| [ \t-\r]+", " ")


def refined(docs: DataFrame, prefix: int = PREFIX, every_digest: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, a row for each of docs (doc_id, text).

    text_sha256 is null for rows that no other shares length and prefix with; `every_digest` fills it in the
    second scan, for callers that report it. Groups are the same.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text").cast("string")).alias("text"))
    text = text.select("doc_id", "text", F.octet_length("text").alias("length"), F.xxhash64(F.substring("text", 1, prefix)).alias("head"))
    narrow = stored(text.select("length", "head"))
    shared = stored(narrow.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length"))  # its size is known then
    heads = stored(narrow.join(shared, "length", "left_semi").groupBy("length", "head").agg(F.count("*").alias("n")).where("n > 1").select("length", "head", F.lit(True).alias("survives")))
    dropped(narrow)
    dropped(shared)

    digest = F.sha2(F.col("text"), 256)
    if every_digest:  # the text ends here: what the join may move are narrow rows
        rows = text.select("doc_id", "length", "head", digest.alias("digest")).join(heads, ["length", "head"], "left")
    else:
        rows = text.join(heads, ["length", "head"], "left").select("doc_id", "survives", F.when(F.col("survives"), digest).alias("digest"))
    rows = stored(rows.select("doc_id", "digest", F.col("survives").isNotNull().alias("survives"), F.monotonically_increasing_id().alias("row")))
    dropped(heads)

    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = stored(rows.where("survives").groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")))
    some = rows.where("survives").join(groups, "digest")
    alone = rows.where("not survives")
    return some.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), F.col("digest").alias("text_sha256")).unionByName(
        alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    )
