"""A deterministic treebank derived from the `documents` table, in operations that DuckDB has too.

A document is a doc_id, a sentence a non-blank line, a word a non-empty piece between spaces. The basic tree
is the heap tree (head = id div 2); one residue class of words is given itself as head, so that checks have
something to find. Other residues give ranges, empty nodes, features, enhanced edges and attributes. Null and
empty texts have no sentences. Nodes are built as an array in the sentence's row, or as its text by Arrow batches:
nothing is exploded here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType, _parse_datatype_string

from arborlake.sources import conllu, spread
from arborlake.sources.cases import CASES, WARNINGS
from arborlake.sources.registry import RELATIONS, UPOS

DEPREL = [x for x in RELATIONS if x != "root"]
FEATS = ["_", "Number=Sing", "Number=Plur", "Case=Nom|Number=Sing", "Case=Acc|Number=Plur", "Mood=Ind|VerbForm=Fin", "VerbForm=Inf", "_", "Case=Nom,Acc", "PronType=Prs", "ExtPos=ADV", "Foreign=Yes"]
MISC = ["_", "_", "_", "SpaceAfter=No", "Gloss=g1", "Gloss=g2|SpaceAfter=No", "Lang=en", "Ref=MATT_1.2", "Flag", "Translit=x"]
SENTENCE = ("doc_id", "lang", "source", "sent_no")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, sent_no, line."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text"))
    lines = docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "lang", "source", (F.col("pos") + 1).cast("long").alias("sent_no"), "line").where(F.trim("line") != "")


def _word(form: Column, n: Column) -> dict[str, Column]:
    """The columns of the n-th word."""
    doc, sent, length = F.col("doc_id"), F.col("sent_no"), F.length(form).cast("long")
    upos = _pick(UPOS, length * 5 + n)
    head = F.when((doc * 31 + sent * 7 + n) % 97 == 0, n).otherwise(F.floor(n / 2))
    deprel = F.when(n == 1, F.lit("root")).otherwise(_pick(DEPREL, length * 7 + n))
    basic = F.concat(head.cast("string"), F.lit(":"), deprel)
    deps = F.when(doc % 2 == 1, F.lit("_")).when((n % 11 == 0), F.concat((n - 1).cast("string"), F.lit(":ref")))
    deps = deps.when((n % 5 == 0), F.concat(basic, F.lit("|"), (n - 1).cast("string"), F.lit(":conj:and"))).when((n > 1) & (n % 7 == 0), F.concat(basic, F.lit(":in"))).otherwise(basic)
    lemma = F.when((doc + n) % 41 == 0, F.lit("_")).otherwise(F.lower(form))
    xpos = F.when(length % 4 == 0, F.lit("_")).otherwise(F.concat(upos, F.lit("-"), (length % 3).cast("string")))
    return {"id": n, "form": form, "lemma": lemma, "upos": upos, "xpos": xpos, "feats": _pick(FEATS, length * 3 + n + sent), "head": head, "deprel": deprel, "deps": deps, "misc": _pick(MISC, length + n * 3)}


def _pieces() -> Column:
    return F.filter(F.split("line", " "), lambda x: x != "")


def nested(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """doc_id, lang, source, sent_no, words: an array in each sentence's row, of the fields asked for (else all)."""

    def word(form: Column, i: Column) -> Column:
        made = _word(form, (i + 1).cast("long"))
        return F.struct(*(made[k].alias(k) for k in fields or made))

    return sentences(spark, sf_dir).select(*SENTENCE, F.transform(_pieces(), word).alias("words"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each word; columns that nobody reads are not computed."""
    rows = sentences(spark, sf_dir).select(*SENTENCE, F.posexplode(_pieces()).alias("pos", "form"))
    made = _word(F.col("form"), (F.col("pos") + 1).cast("long"))
    return rows.select(*SENTENCE, *(c.alias(k) for k, c in made.items()))


#: Bytes of lines that are rendered at a time: what an array of strings can hold, whatever a batch brings.
RENDERED = 2 << 20


def _joined(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "")


def _raws(doc: pa.Array, sent: pa.Array, lines: pa.Array, lowered: pa.Array, fields: tuple[str, ...] = ()) -> pa.Array:
    """The text of each sentence, or the fields of its words, by Arrow's kernels over all words at once; the columns are those of _word()."""
    numbered = np.array(doc.is_valid())
    doc_text, doc, sent = doc.cast(pa.string()), np.asarray(doc.fill_null(0), dtype=np.int64), np.asarray(sent, dtype=np.int64)
    pieces = pc.split_pattern(lines, " ")
    of = np.repeat(np.arange(len(lines)), np.asarray(pc.list_value_length(pieces)))
    form, lemma = pieces.flatten(), pc.split_pattern(lowered, " ").flatten()
    there = pc.not_equal(form, "")
    form, lemma, of = form.filter(there), lemma.filter(there), of[np.asarray(there)]
    counts = np.bincount(of, minlength=len(lines))
    ends = np.cumsum(counts)
    n = np.arange(1, len(of) + 1) - (ends - counts)[of]
    length, d, s, known = np.asarray(pc.utf8_length(form), dtype=np.int64), doc[of], sent[of], numbered[of]
    number = pa.array(map(str, range(int(n.max(initial=0)) + 2)), pa.string())
    pick = lambda values, index: pa.array(values).take(pa.array(index))
    text = lambda index: number.take(pa.array(index))

    head = np.where(known & ((d * 31 + s * 7 + n) % 97 == 0), n, n // 2)
    tag = (length * 5 + n) % len(UPOS)
    deprel = pick([*DEPREL, "root"], np.where(n == 1, len(DEPREL), (length * 7 + n) % len(DEPREL)))
    heads, before = text(head), text(n - 1)
    more = pc.if_else(pa.array(n % 5 == 0), _joined("|", before, ":conj:and"), pick(["", ":in"], ((n > 1) & (n % 7 == 0)).astype(int)))
    deps = pc.if_else(pa.array(n % 11 == 0), _joined(before, ":ref"), _joined(heads, ":", deprel, more))
    deps = pc.if_else(pa.array(known & (np.fmod(d, 2) == 1)), "_", deps)
    lemma = pc.if_else(pa.array(known & ((d + n) % 41 == 0)), "_", lemma)
    xpos = pick([*(f"{u}-{k}" for u in UPOS for k in range(3)), "_"], np.where(length % 4 == 0, 3 * len(UPOS), tag * 3 + length % 3))
    ids = text(n)
    upos, feats, misc = pick(UPOS, tag), pick(FEATS, (length * 3 + n + s) % len(FEATS)), pick(MISC, (length + n * 3) % len(MISC))
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    if fields:
        made = {"id": pa.array(n), "form": form, "lemma": lemma, "upos": upos, "xpos": xpos, "feats": feats, "head": pa.array(head), "deprel": deprel, "deps": deps, "misc": misc}
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([made[k] for k in fields], names=fields))
    word = pc.binary_join_element_wise(ids, form, lemma, upos, xpos, feats, heads, deprel, deps, misc, "\t")

    begins = np.flatnonzero(known & (counts[of] > n) & ((d + n) % 29 == 0))
    if len(begins):
        at, following = pa.array(begins), pa.array(begins + 1)
        ranges = _joined(ids.take(at), "-", ids.take(following), "\t", form.take(at), form.take(following), "\t_" * 8 + "\n", word.take(at))
        word = pc.replace_with_mask(word, pa.array(np.isin(np.arange(len(of)), begins)), ranges)
    empty = np.flatnonzero(known & ((d + s + n) % 31 == 0))
    if len(empty):
        at = pa.array(empty)
        nodes = _joined(word.take(at), "\n", ids.take(at), ".1\t_\t_\tVERB\t_\t_\t_\t_\t", ids.take(at), ":conj\t_")
        word = pc.replace_with_mask(word, pa.array(np.isin(np.arange(len(of)), empty)), nodes)

    sents = pa.array(sent).cast(pa.string())
    name = pc.fill_null(_joined("# sent_id = ", doc_text, "-", sents, "\n"), "")
    parallel = pc.if_else(pa.array(numbered & (doc % 10 == 0)), _joined("# parallel_id = up/", sents, "\n"), "")
    newdoc = pick(["", "# newdoc\n"], (sent == 1).astype(int))
    newpar = pick(["", "# newpar\n"], (sent % 5 == 1).astype(int))
    body = pc.binary_join(pa.ListArray.from_arrays(offsets, word), "\n")
    return _joined(newdoc, newpar, name, parallel, body)


def _rendered(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        share = np.cumsum(np.asarray(pc.binary_length(whole.column("line")), dtype=np.int64)) // RENDERED
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1), whole.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                batch = whole.slice(a, b - a)
                line, lowered = (batch.column(c).cast(pa.string()) for c in ("line", "lowered"))
                raw = _raws(batch.column("doc_id"), batch.column("sent_no"), line, lowered, fields)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in SENTENCE), raw], names=[*SENTENCE, "words" if fields else "raw"])


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, sent_no, raw: the treebank as text, with ranges, empty nodes and comments."""
    rows = sentences(spark, sf_dir).select(*SENTENCE, "line", F.lower("line").alias("lowered"))
    return rows.mapInArrow(_rendered, StructType([*(rows.schema[c] for c in SENTENCE), StructField("raw", StringType(), False)]))


def gathered(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """The rows of nested(), made by Arrow batches: for queries that read all words of all sentences."""
    rows = sentences(spark, sf_dir).select(*SENTENCE, "line", F.lower("line").alias("lowered"))
    of = ArrayType(StructType([StructField(k, LongType() if k in ("id", "head") else StringType()) for k in fields]))
    return rows.mapInArrow(lambda batches: _rendered(batches, fields), StructType([*(rows.schema[c] for c in SENTENCE), StructField("words", of)]))


def worked(spark: SparkSession, sf_dir: str, fields: tuple[str, ...], step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keys: tuple[str, ...], schema: str) -> DataFrame:
    """Rows (keys and `schema`) of a step on the batches of gathered(), in the task that makes them: words do not pass from task to JVM and back."""
    rows = sentences(spark, sf_dir).select(*SENTENCE, "line", F.lower("line").alias("lowered"))
    return rows.mapInArrow(lambda batches: step(_rendered(batches, fields)), StructType([*(rows.schema[c] for c in keys), *_parse_datatype_string(schema).fields]))


def treebank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The treebank as text, parsed again: sentence keys, raw, comments, nodes."""
    return conllu.parsed(blocks(spark, sf_dir))


def _case(sf: DataFrame, chosen: list[int]) -> DataFrame:
    """Sentences whose text is one of the planted cases."""
    raws = F.array(*(F.lit(CASES[k].raw) for k in chosen))
    k = (F.col("doc_id") * 31 + F.col("sent_no") * 7) % len(chosen)
    return sf.select(*SENTENCE, F.replace(F.element_at(raws, (k + 1).cast("int")), F.lit("{id}"), F.concat("doc_id", F.lit("-"), "sent_no")).alias("raw"))


UNIVERSAL = [k for k, c in enumerate(CASES) if c.level <= 3]
PARTICULAR = [k for k, c in enumerate(CASES) if c.level == 0 or c.level > 3]


def planted(spark: SparkSession, sf_dir: str, chosen: list[int]) -> DataFrame:
    return _case(sentences(spark, sf_dir), chosen)


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


#: The same relations in DuckDB.
SENTENCES_SQL = """sentences AS (
  SELECT doc_id, lang, source, CAST(i AS BIGINT) AS sent_no, lines[i] AS line
  FROM (SELECT doc_id, lang, source, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS lines FROM documents))
  WHERE trim(lines[i]) <> '')"""
WORDS_SQL = f"""{SENTENCES_SQL}, pieces AS (
  SELECT doc_id, lang, source, sent_no, CAST(i AS BIGINT) AS id, parts[i] AS form, len(parts) AS n_words, CASE WHEN i < len(parts) THEN parts[i + 1] END AS next_form
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, lang, source, sent_no, list_filter(string_split(line, ' '), lambda x: x <> '') AS parts FROM sentences))),
bare AS (
  SELECT *, ({_sql_list(UPOS)})[(length(form) * 5 + id) % {len(UPOS)} + 1] AS upos,
         CASE WHEN (doc_id * 31 + sent_no * 7 + id) % 97 = 0 THEN id ELSE id // 2 END AS head,
         CASE WHEN id = 1 THEN 'root' ELSE ({_sql_list(DEPREL)})[(length(form) * 7 + id) % {len(DEPREL)} + 1] END AS deprel
  FROM pieces),
words AS (
  SELECT *, CASE WHEN (doc_id + id) % 41 = 0 THEN '_' ELSE lower(form) END AS lemma,
         CASE WHEN length(form) % 4 = 0 THEN '_' ELSE upos || '-' || length(form) % 3 END AS xpos,
         ({_sql_list(FEATS)})[(length(form) * 3 + id + sent_no) % {len(FEATS)} + 1] AS feats,
         CASE WHEN doc_id % 2 = 1 THEN '_' WHEN id % 11 = 0 THEN (id - 1) || ':ref' WHEN id % 5 = 0 THEN head || ':' || deprel || '|' || (id - 1) || ':conj:and'
              WHEN id > 1 AND id % 7 = 0 THEN head || ':' || deprel || ':in' ELSE head || ':' || deprel END AS deps,
         ({_sql_list(MISC)})[(length(form) + id * 3) % {len(MISC)} + 1] AS misc,
         n_words > id AND (doc_id + id) % 29 = 0 AS starts_range, (doc_id + sent_no + id) % 31 = 0 AS has_empty
  FROM bare)"""


def planted_sql(chosen: list[int]) -> str:
    """The findings that each planted sentence must have, counted."""
    rows = ", ".join(f"({i}, '{t}', '{'WARNING' if t in WARNINGS else 'ERROR'}')" for i, k in enumerate(chosen) for t in CASES[k].found)
    return f"WITH {SENTENCES_SQL}, truth(k, testid, type) AS (VALUES {rows}) SELECT doc_id, sent_no, testid, type, count(*) AS n FROM sentences JOIN truth ON (doc_id * 31 + sent_no * 7) % {len(chosen)} = k GROUP BY ALL"
