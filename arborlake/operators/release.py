"""Checks of a treebank's repository: files, metadata of its README, names, releases."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arborlake.functions import repository, version

# Genres, annotation sources and the fields of a README.
GENRES = {"academic", "bible", "blog", "email", "fiction", "government", "grammar-examples", "learner-essays", "legal", "medical", "news", "nonfiction", "poetry", "reviews", "social", "spoken", "web", "wiki"}
SOURCES = {"manual native", "converted with corrections", "converted from manual", "automatic with corrections", "automatic", "not available"}
FIELDS = ("Data available since", "License", "Includes text", "Parallel", "Genre", "Lemmas", "UPOS", "XPOS", "Features", "Relations", "Contributors", "Contributing", "Contact")
DATA = r"\A[a-z]{2,3}_[a-z0-9]+-ud-(train|dev|test)(-[a-z0-9-]+)?\.(conllu|txt)\z"


def readme(text: str) -> dict[str, str]:
    """Fields of the machine-readable part, and `summary`: the section of that name without markup; `changelog`: yes or no."""
    out = {k: "" for k in FIELDS}
    for line in text.split("\n"):
        key, colon, value = line.strip().partition(":")
        if colon and key in out:
            out[key] = value.strip()
    sections = re.split(r"(?m)^#+\s*", text)
    body = next((s.partition("\n")[2] for s in sections if s.lower().startswith("summary")), "")
    out["summary"] = " ".join(re.sub(r"\[([^\]]*)\]\([^)]*\)|[*_`]", lambda m: m[1] or "", body).split())
    out["changelog"] = "yes" if any(s.lower().startswith("changelog") for s in sections) else "no"
    return out


def metadata_findings(meta: dict[str, str], first_release: str = "", collections: set[str] = frozenset()) -> list[str]:
    out = []
    if not re.fullmatch(r"UD v[0-9]+\.[0-9]+", meta["Data available since"]) or (first_release and meta["Data available since"] != f"UD v{first_release}"):
        out.append("available-since")
    if meta["Parallel"] not in ("", "no") and set(meta["Parallel"].split()) - set(collections):
        out.append("parallel-unknown")
    genres = meta["Genre"].split()
    if not genres or set(genres) - GENRES:
        out.append("genre-unknown")
    if not re.match(r"(LGPL|GPL|CC|GNU|ODC|Public)", meta["License"]):
        out.append("license-unknown")
    if meta["Includes text"] not in ("yes", "no"):
        out.append("includes-text")
    out += [f"source-{k.lower()}" for k in ("Lemmas", "UPOS", "XPOS", "Features", "Relations") if meta[k] not in SOURCES]
    out += [f"missing-{k.lower()}" for k in ("Contributors", "Contributing", "Contact") if not meta[k]]
    if not 40 <= len(meta["summary"]) <= 500:
        out.append("summary-length")
    if meta["changelog"] == "no":
        out.append("missing-changelog")
    return out


def repositories(spark: SparkSession, path: str) -> DataFrame:
    """folder, name, language, treebank, file, length of every file below folders `UD_*` of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.regexp_extract("path", r"/((?:Non)?UD_[^/]+)/[^/]+\z", 1)
    return files.select(name.alias("name"), *(c.alias(k) for k, c in repository(name).items()), F.regexp_extract("path", r"([^/]+)\z", 1).alias("file"), "length").where("name <> ''")


def file_findings(files: DataFrame) -> DataFrame:
    """Missing README, LICENSE, CONTRIBUTING or test data, and files that do not belong, by repository."""
    has = lambda pattern: F.max(F.col("file").rlike(pattern).cast("int")) == 1
    known = F.col("file").rlike(DATA) | F.col("file").isin("README.md", "README.txt", "LICENSE.txt", "CONTRIBUTING.md", ".gitignore", "eval.log", "stats.xml")
    rows = files.groupBy("name").agg(has(r"\AREADME\.(md|txt)\z").alias("readme"), has(r"\ALICENSE\.txt\z").alias("license"), has(r"\ACONTRIBUTING\.md\z").alias("contributing"), has(r"-ud-test\.conllu\z").alias("test"), F.array_sort(F.collect_set(F.when(~known, F.col("file")))).alias("extra"))
    rule = lambda c, t: F.when(~F.col(c), F.array(F.lit(t))).otherwise(F.array().cast("array<string>"))
    hits = F.concat(rule("readme", "missing-readme"), rule("license", "missing-license"), rule("contributing", "missing-contributing"), rule("test", "missing-test"), F.transform("extra", lambda x: F.concat(F.lit("extra "), x)))
    return rows.select("name", F.explode(hits).alias("finding"))


def history(releases: DataFrame, renamed: DataFrame) -> DataFrame:
    """name, first, last, n: releases of each treebank, by version, under the name that it has in the end.

    releases (release, name), renamed (old, new, after: the last release under the old name; null: any). A recursive
    query follows each name through one renaming after another; a name may be given again later. Releases and
    renamings are few; Spark stops a recursion beyond 100 steps.
    """
    number = lambda c: (version(c)["major"] * 100_000 + version(c)["minor"]).cast("long")
    spark = releases.sparkSession
    has = "after" in renamed.columns
    after = F.coalesce(number(F.col("after")), F.lit(1 << 40)) if has else F.lit(1 << 40)
    steps = renamed.select("old", "new", after.alias("until")).distinct()
    since = F.coalesce(F.lag("until").over(W.partitionBy("old").orderBy("until")), F.lit(-1))
    names = (releases.select("release", "name", number(F.col("release")).alias("place")).distinct(), steps.withColumn("since", since))
    newest = spark.sql(
        """WITH RECURSIVE chain(release, place, name, now, at) AS (
          SELECT release, place, name, name, place FROM {releases}
          UNION ALL SELECT c.release, c.place, c.name, r.new, r.until + 1 FROM chain c JOIN {renamed} r ON r.old = c.now AND c.at <= r.until AND c.at > r.since)
        SELECT release, place, max_by(now, at) AS name FROM chain GROUP BY release, place, name""",
        releases=names[0], renamed=names[1],
    )
    return newest.groupBy("name").agg(F.min_by("release", "place").alias("first"), F.max_by("release", "place").alias("last"), F.countDistinct("release").alias("n"))


def repeated_ids(sentences: DataFrame) -> DataFrame:
    """Sentences (comments) without an id, with several, and ids given twice."""
    names = F.transform(F.filter("comments", lambda c: c.rlike(r"\A#\s*sent_id\s*=\s*\S")), lambda c: F.regexp_extract(c, r"=\s*(\S+)", 1))
    rows = sentences.select(names.alias("names"))
    few = rows.select(F.when(F.size("names") == 0, "missing").when(F.size("names") > 1, "several").alias("finding"), F.get("names", F.lit(0)).alias("sent_id")).where("finding is not null")
    twice = rows.where("size(names) > 0").groupBy(F.get("names", F.lit(0)).alias("sent_id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("finding"), "sent_id")
    return few.unionByName(twice)


def column_of(field: str) -> str:
    return field.lower().replace(" ", "_")


def metadata(readmes: DataFrame) -> DataFrame:
    """READMEs (name, text) with a column for each of FIELDS, `summary` and `changelog`: readme() as column expressions.

    A field that is given twice has its last value; a missing one, and every field of a null text, is empty.
    """
    trim = lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    text = F.coalesce("text", F.lit(""))
    lines = F.transform(F.split(text, "\n"), trim)

    def value(field: str) -> Column:
        said = F.filter("_lines", lambda x: F.startswith(x, F.lit(f"{field}:")))
        return F.coalesce(trim(F.substring(F.try_element_at(said, F.lit(-1)), len(field) + 2, 1 << 30)), F.lit(""))

    sections = F.split(text, r"(?m)^#+\s*")
    begins = lambda word: F.filter("_sections", lambda x: F.startswith(F.lower(x), F.lit(word)))
    first = F.coalesce(F.get(begins("summary"), F.lit(0)), F.lit(""))
    body = F.regexp_replace(first, r"\A[^\n]*\n?", "")
    plain = F.regexp_replace(body, r"\[([^\]]*)\]\([^)]*\)|[*_`]", "$1")  # no group, no text
    rows = readmes.select("name", lines.alias("_lines"), sections.alias("_sections"))
    return rows.select("name", *(value(f).alias(column_of(f)) for f in FIELDS), trim(F.regexp_replace(plain, r"(?U)\s+", " ")).alias("summary"), F.when(F.size(begins("changelog")) > 0, "yes").otherwise("no").alias("changelog"))


def metadata_table(meta: DataFrame, first: DataFrame | None = None, collections: tuple[str, ...] = ()) -> DataFrame:
    """name, finding of metadata(): metadata_findings() as column expressions. `first` (name, first) tells a treebank's first release."""
    rows = meta.withColumn("_first", F.lit("")) if first is None else meta.join(first.select("name", F.col("first").alias("_first")), "name", "left")
    since, genres = F.col("data_available_since"), F.filter(F.split("genre", r"\s+"), lambda x: x != "")
    words = F.filter(F.split("parallel", r"\s+"), lambda x: x != "")
    given = F.coalesce("_first", F.lit(""))
    among = lambda a, allowed: F.size(F.filter(a, lambda x: ~x.isin(*allowed))) == 0
    rules: dict[str, Column] = {
        "available-since": ~since.rlike(r"\AUD v[0-9]+\.[0-9]+\z") | ((given != "") & (since != F.concat(F.lit("UD v"), given))),
        "parallel-unknown": ~F.col("parallel").isin("", "no") & ~among(words, collections or ("",)),
        "genre-unknown": (F.size(genres) == 0) | ~among(genres, sorted(GENRES)),
        "license-unknown": ~F.col("license").rlike(r"\A(LGPL|GPL|CC|GNU|ODC|Public)"),
        "includes-text": ~F.col("includes_text").isin("yes", "no"),
        **{f"source-{k.lower()}": ~F.col(column_of(k)).isin(*sorted(SOURCES)) for k in ("Lemmas", "UPOS", "XPOS", "Features", "Relations")},
        **{f"missing-{k.lower()}": F.col(column_of(k)) == "" for k in ("Contributors", "Contributing", "Contact")},
        "summary-length": ~F.length("summary").between(40, 500), "missing-changelog": F.col("changelog") == "no",
    }
    return rows.select("name", F.explode(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())).alias("finding"))


def report(files: DataFrame, readmes: DataFrame, releases: DataFrame, renamed: DataFrame, collections: tuple[str, ...] = ()) -> DataFrame:
    """name, kind (files, metadata, release), finding: what stands against a release.

    files (name, file), readmes (name, text), releases and renamed as in history(). A treebank is known by its files;
    one without a README has a finding of its files and none of its metadata; one that was released under its newest
    name and has no files any more is `gone`, one with files and no release is `new`.
    """
    known = history(releases, renamed)
    present = files.select("name").distinct()
    state = present.withColumn("_here", F.lit(True)).join(known.select("name", F.lit(True).alias("_before")), "name", "full")
    moved = state.select("name", F.when(F.col("_here").isNull(), "gone").when(F.col("_before").isNull(), "new").alias("finding")).where("finding is not null")
    parts = {"files": file_findings(files), "metadata": metadata_table(metadata(readmes), known.select("name", "first"), collections), "release": moved}
    tables = [df.select("name", F.lit(kind).alias("kind"), "finding") for kind, df in parts.items()]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def by_treebank(found: DataFrame) -> DataFrame:
    """name, n_findings, and all findings in order: one row for each treebank that has any."""
    return found.groupBy("name").agg(F.count("*").alias("n_findings"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "kind", "finding"))), "; ").alias("findings"))  # as many as there are rules
