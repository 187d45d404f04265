"""Column functions of the annotation format: features, relations, versions, shares. All but composed() stay inside the JVM."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def pairs(cell: Column) -> Column:
    """`A=x|B=y|Flag` as an array of struct(name, value), in order, repeated names kept; `_` is empty."""
    parts = F.filter(F.split(cell, r"\|"), lambda x: x != "")
    made = F.transform(parts, lambda x: F.struct(F.substring_index(x, "=", 1).alias("name"), F.when(x.contains("="), F.regexp_replace(x, r"\A[^=]*=", "")).alias("value")))
    return F.when((cell == "_") | cell.isNull(), F.array().cast("array<struct<name:string,value:string>>")).otherwise(made)


def value_of(cell: Column, name: str) -> Column:
    """The value of a feature or attribute; "" where it is missing."""
    found = F.filter(pairs(cell), lambda p: p["name"] == name)
    return F.when(F.size(found) > 0, F.coalesce(F.get(found, F.lit(0))["value"], F.lit(""))).otherwise("")


def edges(cell: Column) -> Column:
    """`2:nsubj|5.1:conj:and` as an array of struct(head, deprel); a relation may hold colons."""
    parts = F.split(cell, r"\|")
    made = F.transform(parts, lambda x: F.struct(F.substring_index(x, ":", 1).alias("head"), F.regexp_replace(x, r"\A[^:]*:", "").alias("deprel")))
    return F.when((cell == "_") | cell.isNull(), F.array().cast("array<struct<head:string,deprel:string>>")).otherwise(made)


def universal(deprel: Column) -> Column:
    """The relation without its subtype."""
    return F.substring_index(deprel, ":", 1)


def transliterated(cell: Column, misc: Column, attribute: str, replaced: bool = False) -> Column:
    """A form or lemma with its transliteration (Translit or LTranslit in MISC) behind it, or in its place; alone where there is none."""
    other = value_of(misc, attribute)
    return F.when(other == "", cell).otherwise(other if replaced else F.concat_ws(" ", cell, other))


def shorten(text: Column) -> Column:
    """At most 24 characters, or 20 and a mark."""
    return F.when(F.length(text) < 25, text).otherwise(F.concat(F.substring(text, 1, 20), F.lit("[...]")))


def percent(part: Column, whole: Column) -> Column:
    """Whole percents, halves rounded up."""
    return F.floor(F.lit(100) * part / F.nullif(whole, F.lit(0)) + F.lit(0.5))


def version(release: Column) -> Column:
    """Sorts 2.10 after 2.9."""
    return F.struct(F.substring_index(release, ".", 1).cast("int").alias("major"), F.coalesce(F.nullif(F.regexp_extract(release, r"\.([0-9]+)", 1), F.lit("")), F.lit("0")).cast("int").alias("minor"))


def repository(name: Column) -> dict[str, Column]:
    """Language and treebank of a folder name such as `UD_Old_Irish-Bank`."""
    return {"language": F.regexp_replace(F.regexp_extract(name, r"\A(?:Non)?UD_([^-]+)", 1), "_", " "), "treebank": F.regexp_extract(name, r"-(.+)\z", 1)}


def portion(path: Column) -> Column:
    """train, dev or test by the file's name, else other."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"ud-(train|dev|test)", 1), F.lit("")), F.lit("other"))


def without_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s", "")


@F.arrow_udf(StringType())
def _composed(text: pa.Array) -> pa.Array:
    # Arrow's own kernel leaves the text decomposed when asked for NFC.
    return pa.array([x if x is None else unicodedata.normalize("NFC", x) for x in text.to_pylist()], pa.string())


def composed(text: Column) -> Column:
    """Unicode's composed form (NFC), whole columns at a time. Text of ASCII alone is composed, and goes as null."""
    other = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_composed(other), text)
