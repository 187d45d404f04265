"""The whole validation of files: reader, checks of each sentence, checks between sentences, filters, cap, verdict.

Files are read by ranges. One pass runs the chain on each sentence and hands out its findings and, where it
passed, its facts; the result is written, as it is narrow and several checks read it, so texts are read once (and once
more by ranges, for the numbers). Lines are numbered within the file. A treebank's language is the beginning of its files' names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from arborlake.operators import checks, coreference, plain
from arborlake.operators import columns as by_columns
from arborlake.sources import files
from arborlake.sources.cells import SLICE, Nodes
from arborlake.sources.registry import SAMPLE, Language
from arborlake.sources.scratch import written

KEYS = ("treebank", "file", "sent_no")
NO_FACTS = ("", "", False, False, False, False, [], [])
#: What a reader of the report may want to know of a test, shown once.
EXPLANATIONS = {
    "missing-empty-line": "Every sentence, the last one too, ends with an empty line.",
    "empty-sentence": "Exactly one empty line follows a sentence.",
    "pseudo-empty-line": "A line of white space looks empty and is not.",
    "non-unix-newline": "Lines end in a line feed alone.",
    "text-form-mismatch": "The forms and their spaces, one after another, are the text of the sentence.",
    "pron-det-without-prontype": "Expected where the treebank has features at all.",
    "edeps-only-sometimes": "A treebank has enhanced graphs for all of its sentences or for none.",
}


@dataclass
class Report:
    """incidents: all that pass the filters; shown: what a reader sees; verdicts: a row for each treebank; counts: by class and test."""

    incidents: DataFrame
    shown: DataFrame
    verdicts: DataFrame
    counts: DataFrame


def of_sentences(rows: DataFrame, level: int, registry: dict[str, Language], kept: Callable[[str, str], bool] = lambda kind, testid: True, asked: set[str] | None = None) -> DataFrame:
    """Findings that are `kept` (by type and test; `asked` by name, or all) and facts (type FACT) of sentences (KEYS, lang, line, cr, raw with the line that ends it).

    Besides, a row of type CR for each sentence with such a line end, and one of type TREEBANK for each treebank of a
    batch; its test says whether a node there has features. Up to level 3, only sentences in odd spelling, or with what is
    rare, are walked.
    """
    extra = list(checks.EXTRA.values())
    columns = 2 <= level <= 3 and not extra
    out_type = StructType([*(rows.schema[k] for k in KEYS), *_parse_datatype_string(f"{checks.INCIDENT}, {checks.FACTS}").fields])
    types = [to_arrow_schema(out_type)[k].type for k in range(len(KEYS), len(out_type))]

    def walk(raw: str, lang: str) -> Iterator[tuple]:
        for f in checks.chain(raw, lang, level, registry, extra):
            if kept(f.type, f.testid):
                yield (*f, *(checks.facts_of(raw) if f.type == "FACT" and level >= 2 else NO_FACTS))

    def judged(raw: pa.Array, lang: pa.Array) -> tuple[list[plain.Told], list[tuple]]:
        if not columns:
            return [], [(i, *f) for i, (r, x) in enumerate(zip(raw.to_pylist(), lang.to_pylist())) for f in walk(r, x)]
        found = plain.Plain(raw, False, asked)
        told, each = found.found(level)
        passed, facts = found.facts(found.sound)
        told = [(*t, *(facts if isinstance(t[2], str) and t[2] == "FACT" else NO_FACTS)) for t in plain.filtered(told, kept)]
        langs = lang.to_pylist()
        return told, [(*f, *NO_FACTS) for f in each if kept(f[2], f[4])] + [(i, *f) for i, r in found.texts(found.walked, False) for f in walk(r, langs[i])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_ in batches:
            for a, b in by_columns.batches(all_.column("raw"), SLICE):
                batch = all_.slice(a, b - a)
                raw = batch.column("raw").cast(pa.string())
                of, made = plain.arrays(*judged(raw, batch.column("lang")), types)
                begin = np.asarray(batch.column("line"), dtype=np.int64)
                made[4] = pa.array(np.asarray(made[4], dtype=np.int64) + begin[np.asarray(of)] - 1).cast(types[4])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in KEYS), *made], names=out_type.names)
                at = np.flatnonzero(np.asarray(batch.column("cr")))
                marks = [(i, 0, "CR", "", "", int(begin[i]), "", "", *NO_FACTS) for i in at.tolist()]
                nodes = Nodes(raw)
                featured = set(nodes.of[np.asarray(pc.not_equal(nodes["feats"], "_"))].tolist())
                names = batch.column("treebank").to_pylist()
                known = {names[i] for i in featured}
                marks += [(names.index(t), 0, "TREEBANK", "", "featured" if t in known else "", 0, "", "", *NO_FACTS) for t in dict.fromkeys(names)]
                of, made = plain.arrays([], marks, types)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in KEYS), *made], names=out_type.names)

    return rows.select(*KEYS, "raw", "lang", "line", "cr").mapInArrow(run, out_type)


def validate_files(
    spark: SparkSession, path: str, level: int = 5, registry: dict[str, Language] = SAMPLE, *, language: str | None = None, coref: bool = False, warnings: bool = True,
    include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), max_err: int = 20, range_bytes: int = files.RANGE_BYTES,
) -> Report:
    """Validates all .conllu files below the path; `include` and `exclude` name tests."""
    rows = files.read(spark, path, range_bytes).withColumn("lang", F.lit(language) if language else F.regexp_extract("treebank", r"\A([a-z]{2,3})_", 1))

    def kept(kind: str, testid: str) -> bool:
        return kind == "FACT" or not ((kind == "WARNING" and not warnings) or testid in exclude or (include and testid not in include))

    whole = written(of_sentences(rows, level, registry, kept, set(include) - set(exclude) if include else None), "checked")
    names = checks.INCIDENT.replace(" int", "").replace(" string", "").split(", ")
    found = whole.where("type IN ('ERROR', 'WARNING')").select(*KEYS, *names)
    passed = whole.where("type = 'FACT'")
    if level >= 2:
        between = checks.across(passed.select(*KEYS, *(c.split()[0] for c in checks.FACTS.split(", "))), KEYS, "treebank", "file").where(F.col("level") <= level)
        lines = passed.select(*KEYS, F.col("line").alias("_line"))
        between = between.join(lines, list(KEYS)).withColumn("line", F.col("_line").cast("int")).drop("_line")
        found = found.unionByName(between.select(*KEYS, *names))
    featured = whole.where("type = 'TREEBANK'").groupBy("treebank").agg(F.max((F.col("testid") == "featured").cast("int")).alias("_featured"))
    found = checks.featured(found, featured, "treebank")
    ends = whole.where("type = 'CR'").groupBy("treebank", "file").agg(F.min(F.struct("sent_no", "line")).alias("at"))
    found = found.unionByName(ends.select("treebank", "file", F.col("at.sent_no").alias("sent_no"), F.lit(1).alias("level"), F.lit("ERROR").alias("type"), F.lit("FORMAT").alias("testclass"), F.lit("non-unix-newline").alias("testid"), F.col("at.line").cast("int").alias("line"), F.lit("").alias("node"), F.lit("").alias("message")))
    if coref:
        sound = rows.join(passed.select(*KEYS, F.col("line").alias("_at")), list(KEYS)).withColumn("raw", F.regexp_replace("raw", r"\n\z", ""))
        entities = written(coreference.found(sound.select(*KEYS, "raw"), KEYS, "treebank"), "entities")
        begin = rows.select(*KEYS, (F.col("line") - 1).cast("int").alias("_before"))
        own = entities.where("type <> 'MENTION'").select(*KEYS, *names).join(begin, list(KEYS)).withColumn("line", F.col("line") + F.col("_before"))
        agreed = coreference.across(entities, KEYS, "treebank", "file").join(begin, list(KEYS))
        apart = agreed.select(*KEYS, F.lit(6).alias("level"), F.lit("ERROR").alias("type"), F.lit("COREF").alias("testclass"), "testid", (F.col("_before") + 1).alias("line"), F.lit("").alias("node"), F.col("eid").alias("message"))
        found = found.unionByName(own.select(*KEYS, *names)).unionByName(apart)
    if not warnings:
        found = found.where("type <> 'WARNING'")
    if include:
        found = found.where(F.col("testid").isin(*include))
    if exclude:
        found = found.where(~F.col("testid").isin(*exclude))
    treebanks = whole.where("type = 'TREEBANK'").select("treebank").distinct()
    return Report(found, shown(found, max_err, KEYS), checks.passed(found, treebanks, "treebank"), checks.summary(found, "treebank"))


def shown(found: DataFrame, k: int, order: tuple[str, ...]) -> DataFrame:
    """treebank, type, testclass, rank, text: the first k incidents of each type and class of a treebank, then one row that tells how many more.

    Spark keeps k rows of a group in each task before they meet; the counts are summed in tasks first. A test's
    explanation goes with its first incident that is shown.
    """
    group = ("treebank", "type", "testclass")
    place = F.struct(*order, "line", "node", "testid")
    first = checks.capped(found, k, order, by=group)
    told = F.row_number().over(W.partitionBy("treebank", "testid").orderBy(place)) == 1
    why = F.try_element_at(F.create_map(*(F.lit(x) for pair in EXPLANATIONS.items() for x in pair)), F.col("testid"))
    text = F.format_string("[Line %d Sent %d%s]: [L%d %s %s] %s", "line", "sent_no", F.when(F.col("node") != "", F.concat(F.lit(" Node "), "node")).otherwise(""), "level", "testclass", "testid", "message")
    listed = first.withColumn("why", F.when(told, why)).select(*group, "rank", F.rtrim(F.concat_ws(" ", text, "why")).alias("text"))
    more = found.groupBy(*group).agg((F.count("*") - k).alias("more")).where("more > 0")
    rest = more.select(*group, F.lit(k + 1).alias("rank"), F.format_string("...suppressing %d more of %s", "more", "testclass").alias("text"))
    return listed.unionByName(rest)
