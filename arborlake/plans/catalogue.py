"""Registered treebank queries: each with its DuckDB twin, or none where tests hold it against brute force."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import composed, transliterated, universal, without_spaces
from arborlake.operators import checks, coreference, graphs, lookups, offsets, paradigms, release, render, rewrites, rules, scorer, statistics, surveys, validator, verses
from arborlake.sources import cells, files, registry
from arborlake.sources.conllu import COLUMNS, exploded, nodes_table, rendered
from arborlake.sources.registry import UPOS
from arborlake.sources.scratch import new_folder
from arborlake.sources.synthetic import PARTICULAR, SENTENCES_SQL, UNIVERSAL, WORDS_SQL, blocks, gathered, nested, planted, planted_sql, sentences, treebank, words, worked

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ("doc_id", "lang", "sent_no")

CATALOGUE: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    CATALOGUE[name] = (query, sql)


def _words(step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: step(words(spark, sf_dir))


def _nested(step: Callable[[DataFrame], DataFrame], *fields: str) -> Query:
    return lambda spark, sf_dir: step(nested(spark, sf_dir, *fields))


def _trees(step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: step(treebank(spark, sf_dir))


def _sentences(step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: step(sentences(spark, sf_dir))


def _top_sql(keys: str, value: str, k: int, where: str = "true") -> str:
    return f"""WITH {WORDS_SQL}, counted AS (SELECT {keys}, {value}, count(*) AS n FROM words WHERE {where} GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, {value}) AS INTEGER) AS rank FROM counted) WHERE rank <= {k}"""


# Sizes, tops and ranks.

_add(
    "tb_size", lambda spark, sf_dir: statistics.size(blocks(spark, sf_dir), "lang"),
    f"""WITH {WORDS_SQL} SELECT lang, count(DISTINCT (doc_id, sent_no)) AS n_sentences, CAST(count(*) - count_if(starts_range) AS BIGINT) AS n_tokens, CAST(count_if(starts_range) AS BIGINT) AS n_ranges,
count(*) AS n_words, CAST(count_if(has_empty) AS BIGINT) AS n_empty, count(DISTINCT form) AS n_forms, count(DISTINCT nullif(lemma, '_')) AS n_lemmas FROM words GROUP BY lang""",
)
_add("tb_size_rollup", _nested(statistics.size_rollup, "id"), f"WITH {WORDS_SQL} SELECT lang, source, CAST(count_if(id = 1) AS BIGINT) AS n_sentences, count(*) AS n_words FROM words GROUP BY ROLLUP (lang, source)")
_add("lemma_form_top15", _words(statistics.top_lemmas), _top_sql("lang", "lemma", 15, "lemma <> '_'"))
_add("tag_top10_examples", _words(statistics.top_forms_of_tags), _top_sql("upos", "form", 10))
_add(
    "tag_ranks", _words(statistics.tag_ranks),
    f"""WITH {WORDS_SQL}, s AS (SELECT lang, upos, count(*) AS tokens, count(DISTINCT form) AS types, count(DISTINCT nullif(lemma, '_')) AS lemmas FROM words GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY tokens DESC, upos) AS INTEGER) AS rank_tokens, CAST(row_number() OVER (PARTITION BY lang ORDER BY types DESC, upos) AS INTEGER) AS rank_types,
CAST(row_number() OVER (PARTITION BY lang ORDER BY lemmas DESC, upos) AS INTEGER) AS rank_lemmas, CAST(floor(100 * tokens / sum(tokens) OVER (PARTITION BY lang) + 0.5) AS BIGINT) AS percent,
round(types / nullif(lemmas, 0), 6) AS forms_per_lemma FROM s""",
)
_add("ambiguous_forms", _words(statistics.ambiguous_forms), f"WITH {WORDS_SQL} SELECT lang, form, count(DISTINCT upos) AS n_tags, count(*) AS n FROM words GROUP BY lang, form HAVING count(DISTINCT upos) > 1")
_add(
    "paradigm_size", _words(statistics.paradigm_sizes),
    f"WITH {WORDS_SQL}, s AS (SELECT lang, lemma, count(DISTINCT form) AS n_forms FROM words WHERE lemma <> '_' GROUP BY ALL) SELECT lang, n_forms, count(*) AS n_lemmas FROM s GROUP BY ALL",
)
_add(
    "paradigms_top3", _words(statistics.paradigms),
    f"""WITH {WORDS_SQL}, s AS (SELECT upos, lemma, count(DISTINCT form) AS n, count(DISTINCT feats) AS n_feats FROM words WHERE lemma <> '_' GROUP BY ALL HAVING count(DISTINCT form) >= 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY upos ORDER BY n DESC, lemma) AS INTEGER) AS rank FROM s) WHERE rank <= 3""",
)
_add(
    "folded_case", _words(statistics.folded_case),
    f"""WITH {WORDS_SQL}, k AS (SELECT upos, form, count(*) AS n FROM words GROUP BY ALL)
SELECT a.upos, CASE WHEN EXISTS (SELECT 1 FROM k b WHERE b.upos = a.upos AND b.form = lower(a.form)) THEN lower(a.form) ELSE a.form END AS form, CAST(sum(n) AS BIGINT) AS n FROM k a GROUP BY ALL""",
)
_add("unused_tags", _words(lambda w: statistics.unused_tags(w, UPOS)), f"WITH {WORDS_SQL}, l AS (SELECT DISTINCT lang FROM words) SELECT lang, t.upos FROM l, (SELECT unnest({[*UPOS]}) AS upos) t WHERE (lang, t.upos) NOT IN (SELECT (lang, upos) FROM words)")
for _a, _b in (("PRON", "DET"), ("AUX", "VERB")):
    _add(
        f"lemmas_{_a.lower()}_{_b.lower()}", _words(lambda w, a=_a, b=_b: statistics.shared_lemmas(w, a, b)),
        f"WITH {WORDS_SQL} SELECT lang, lemma FROM words WHERE lemma <> '_' AND upos = '{_a}' INTERSECT SELECT lang, lemma FROM words WHERE lemma <> '_' AND upos = '{_b}'",
    )

# Relations, parents, neighbours.

_add(
    "dep_direction_length", _words(statistics.direction_length),
    f"""WITH {WORDS_SQL} SELECT lang, deprel, count(*) AS n, CAST(count_if(id < head) AS BIGINT) AS n_before, CAST(sum(abs(id - head)) AS BIGINT) AS distance,
CAST(floor(100 * count_if(id < head) / count(*) + 0.5) AS BIGINT) AS percent_before FROM words GROUP BY ALL""",
)
_add(
    "tagpair_by_rel", _nested(statistics.tag_pairs, "upos", "head", "deprel"),
    f"WITH {WORDS_SQL} SELECT p.upos AS parent_upos, c.deprel, c.upos, count(*) AS n FROM words c JOIN words p ON p.doc_id = c.doc_id AND p.sent_no = c.sent_no AND p.id = c.head GROUP BY ALL",
)
_add(
    "child_degree_hist", _nested(statistics.child_degrees, "head"),
    f"""WITH {WORDS_SQL}, d AS (SELECT doc_id, sent_no, head, count(*) AS degree FROM words WHERE head > 0 GROUP BY ALL)
SELECT coalesce(degree, 0) AS degree, count(*) AS n FROM words w LEFT JOIN d ON d.doc_id = w.doc_id AND d.sent_no = w.sent_no AND d.head = w.id GROUP BY 1""",
)
_add(
    "agreement_rate", _nested(statistics.agreement, "feats", "head", "deprel"),
    f"""WITH {WORDS_SQL}, f AS (SELECT doc_id, sent_no, id, head, deprel, split_part(x, '=', 1) AS feature, split_part(x, '=', 2) AS value FROM (SELECT *, unnest(string_split(feats, '|')) AS x FROM words WHERE feats <> '_'))
SELECT c.deprel AS udeprel, c.feature, CAST(count_if(c.value = p.value) AS BIGINT) AS agree, CAST(count_if(c.value <> p.value) AS BIGINT) AS disagree
FROM f c JOIN f p ON p.doc_id = c.doc_id AND p.sent_no = c.sent_no AND p.id = c.head AND p.feature = c.feature GROUP BY ALL""",
)
_TRIGRAMS = """t AS (SELECT lang, coalesce(lag(upos) OVER o, '#') AS t1, upos AS t2, coalesce(lead(upos) OVER o, '#') AS t3
FROM words WINDOW o AS (PARTITION BY doc_id, sent_no ORDER BY id)), trigrams AS (SELECT *, count(*) AS n FROM t GROUP BY ALL)"""
_add("pos_trigrams", _nested(statistics.tag_trigrams, "upos"), f"WITH {WORDS_SQL}, {_TRIGRAMS} SELECT * FROM trigrams")
_add(
    "trigram_divergence", _nested(lambda s: statistics.divergence(statistics.tag_trigrams(s)), "upos"),
    f"""WITH {WORDS_SQL}, {_TRIGRAMS}, sums AS (SELECT lang, sum(n) AS total FROM trigrams GROUP BY lang)
SELECT a.lang AS target, b.lang AS source, round(sum(a.n / sa.total * ln((a.n / sa.total) / (coalesce(s.n, 1) / b.total))), 6) AS divergence
FROM trigrams a JOIN sums sa ON sa.lang = a.lang JOIN sums b ON b.lang <> a.lang LEFT JOIN trigrams s ON s.lang = b.lang AND s.t1 = a.t1 AND s.t2 = a.t2 AND s.t3 = a.t3 GROUP BY ALL""",
)
_add(
    "relation_examples", lambda spark, sf_dir: statistics.examples(gathered(spark, sf_dir, "form", "deprel")),
    f"""WITH {WORDS_SQL}, s AS (SELECT doc_id, sent_no, string_agg(form, ' ' ORDER BY id) AS text, list(DISTINCT deprel) AS rels FROM words GROUP BY ALL), r AS (SELECT *, unnest(rels) AS deprel FROM s)
SELECT deprel, first(text ORDER BY length(text) > 80, CASE WHEN length(text) > 80 THEN length(text) ELSE 0 END, doc_id, sent_no) AS example FROM r GROUP BY deprel""",
)

# Order-dependent operators.

_add(
    "duplicate_sentences", _sentences(statistics.duplicate_sentences),
    f"WITH {SENTENCES_SQL} SELECT line, count(*) AS n, min((doc_id, sent_no))[1] AS first_doc, min((doc_id, sent_no))[2] AS first_sent FROM sentences GROUP BY line HAVING count(*) > 1",
)
_add("dedup_first", _sentences(statistics.dedup_first), f"WITH {SENTENCES_SQL} SELECT min((doc_id, sent_no))[1] AS doc_id, min((doc_id, sent_no))[2] AS sent_no, line FROM sentences GROUP BY line")
def _portion() -> Column:
    return F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "dev").otherwise("train")


_PORTION_SQL = "CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END"
_add(
    "dedup_vs_train", _sentences(lambda s: statistics.dedup_against(s.where(_portion() != "train"), s.where(_portion() == "train")).select("doc_id", "sent_no", "line")),
    f"WITH {SENTENCES_SQL} SELECT doc_id, sent_no, line FROM sentences WHERE {_PORTION_SQL} <> 'train' AND line NOT IN (SELECT line FROM sentences WHERE {_PORTION_SQL} = 'train')",
)
_add(
    "overlap_portions", _sentences(lambda s: statistics.overlap(s, _portion())),
    f"""WITH {SENTENCES_SQL}, p AS (SELECT DISTINCT line, {_PORTION_SQL} AS portion FROM sentences)
SELECT a.portion AS first, b.portion AS second, count(*) AS n FROM p a JOIN p b ON a.line = b.line AND a.portion < b.portion GROUP BY ALL""",
)
_add(
    "detokenize", _nested(statistics.detokenize, "form", "misc"),
    f"WITH {WORDS_SQL} SELECT doc_id, sent_no, rtrim(string_agg(form || CASE WHEN list_contains(string_split(misc, '|'), 'SpaceAfter=No') THEN '' ELSE ' ' END, '' ORDER BY id)) AS text FROM words GROUP BY ALL",
)
_add(
    "mwt_sequences", _trees(statistics.ranges),
    f"WITH {WORDS_SQL} SELECT lang, lower(form || next_form) AS form, lower(form) || ' ' || lower(next_form) AS words, count(*) AS n FROM words WHERE starts_range GROUP BY ALL",
)
_add(
    "propn_runs", _nested(statistics.tag_runs, "form", "upos", "misc"),
    f"""WITH {WORDS_SQL}, r AS (SELECT *, id - row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY id) AS island FROM words WHERE upos = 'PROPN'),
g AS (SELECT lang, rtrim(string_agg(form || CASE WHEN misc LIKE '%SpaceAfter=No%' THEN '' ELSE ' ' END, '' ORDER BY id)) AS run FROM r GROUP BY lang, doc_id, sent_no, island) SELECT lang, run, count(*) AS n FROM g GROUP BY ALL""",
)
_add(
    "tenfold", _nested(lambda s: statistics.tenfold(s, "lang"), "id"),
    f"""WITH {WORDS_SQL}, s AS (SELECT lang, doc_id, sent_no, count(*) AS n FROM words GROUP BY ALL)
SELECT lang, doc_id, sent_no, CAST(least(floor((sum(n) OVER (PARTITION BY lang ORDER BY doc_id, sent_no) - n) * 10 / sum(n) OVER (PARTITION BY lang)), 9) AS BIGINT) AS fold FROM s""",
)
_add("cut_by_id", _sentences(lambda s: statistics.cut(s, "10-1", "20-1").select("doc_id", "sent_no", "line")), f"WITH {SENTENCES_SQL} SELECT doc_id, sent_no, line FROM sentences WHERE doc_id BETWEEN 10 AND 19 OR (doc_id = 20 AND sent_no <= 1)")
_add("sort_by_id", _sentences(lambda s: s.select(F.concat("doc_id", F.lit("-"), "sent_no").alias("sent_id"), "line").orderBy(*statistics.by_id(F.col("sent_id")))), f"WITH {SENTENCES_SQL} SELECT doc_id || '-' || sent_no AS sent_id, line FROM sentences")

# Surveys.

_F = "(SELECT lang, upos, split_part(x, '=', 1) AS feature, unnest(string_split(split_part(x, '=', 2), ',')) AS value FROM (SELECT lang, upos, unnest(string_split(feats, '|')) AS x FROM words WHERE feats <> '_'))"
_add("feature_values", _words(surveys.features), f"WITH {WORDS_SQL}, c AS (SELECT feature, value, lang, count(*) AS n FROM {_F} GROUP BY ALL) SELECT * FROM c UNION ALL SELECT feature, value, 'TOTAL', CAST(sum(n) AS BIGINT) FROM c GROUP BY ALL")
_NUMBER = "CASE WHEN list_contains(string_split(feats, '|'), 'Number=Sing') THEN 'Sing' WHEN list_contains(string_split(feats, '|'), 'Number=Plur') THEN 'Plur' ELSE 'EMPTY' END"
_add("feature_by_tag", _words(lambda w: surveys.feature_by_tag(w, "Number")), f"WITH {WORDS_SQL} SELECT lang, upos, {_NUMBER} AS value, count(*) AS n FROM words GROUP BY ALL")
_add(
    "feature_pivot", _words(lambda w: surveys.feature_pivot(w, "Number", "lang", ["de", "en", "es", "fr"])),
    f"WITH {WORDS_SQL} SELECT {_NUMBER} AS value, " + ", ".join(f"CAST(count_if(lang = '{x}') AS BIGINT) AS {x}" for x in ("de", "en", "es", "fr")) + " FROM words GROUP BY 1",
)
_add(
    "feature_cooccurrence", _words(surveys.cooccurring),
    f"""WITH {WORDS_SQL}, x AS (SELECT doc_id, sent_no, id, upos, unnest(string_split(feats, '|')) AS f FROM words WHERE feats <> '_')
SELECT a.upos, a.f AS first, b.f AS second, count(*) AS n FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.sent_no = b.sent_no AND a.id = b.id AND a.f < b.f GROUP BY ALL""",
)
_add(
    "misc_top50", _words(surveys.attributes),
    f"""WITH {WORDS_SQL}, x AS (SELECT lang, unnest(string_split(misc, '|')) AS x FROM words WHERE misc <> '_'),
c AS (SELECT lang, CASE WHEN x LIKE '%=%' THEN split_part(x, '=', 1) ELSE '_' END AS key, CASE WHEN x LIKE '%=%' THEN split_part(x, '=', 2) ELSE x END AS value, count(*) AS n FROM x GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, key ORDER BY n DESC, value) AS INTEGER) AS rank FROM c) WHERE rank <= 50""",
)
_E = "(SELECT *, split_part(e, ':', 1) AS parent, substr(e, strpos(e, ':') + 1) AS rel FROM (SELECT *, unnest(string_split(deps, '|')) AS e FROM words WHERE deps <> '_'))"
_add("relation_subtypes", _words(surveys.subtypes), f"WITH {WORDS_SQL} SELECT lang, split_part(rel, ':', 1) AS udeprel, rel AS deprel, count(*) AS n FROM {_E} GROUP BY ALL")
_SCRIPT = "CASE " + " ".join(f"WHEN regexp_matches(letter, '\\p{{{x}}}') THEN '{x}'" for x in surveys.SCRIPTS) + " ELSE 'Other' END"
_add(
    "scripts", _sentences(surveys.scripts),
    f"""WITH {SENTENCES_SQL}, l AS (SELECT lang, unnest(regexp_extract_all(line, '\\p{{L}}')) AS letter FROM sentences), c AS (SELECT lang, letter, count(*) AS n, {_SCRIPT} AS script FROM l GROUP BY ALL),
s AS (SELECT lang, script, CAST(sum(n) AS BIGINT) AS total, max((n, letter))[2] AS letter FROM c GROUP BY ALL)
SELECT lang, script, total AS n, letter, CAST(floor(100 * total / sum(total) OVER (PARTITION BY lang) + 0.5) AS BIGINT) AS percent FROM s""",
)
_add(
    "parallel_treebanks", _trees(surveys.parallel),
    f"""WITH {SENTENCES_SQL} SELECT 'up' AS collection, source, count(DISTINCT sent_no) AS n_core, count(*) - count(DISTINCT sent_no) AS n_extra FROM sentences WHERE doc_id % 10 = 0 GROUP BY source""",
)


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = nested(spark, sf_dir, "id").select("lang", F.size("words").alias("n")).groupBy("lang").agg(F.sum("n").alias("n_words"))
    registry = spark.createDataFrame([("en", "IE", "Germanic"), ("de", "IE", "Germanic"), ("es", "IE", "Romance"), ("fr", "IE", "Romance")], "lang string, family string, genus string")
    return surveys.families(sizes, registry)


_add(
    "language_families", _families,
    f"""WITH {WORDS_SQL}, r(lang, family, genus) AS (VALUES ('en', 'IE', 'Germanic'), ('de', 'IE', 'Germanic'), ('es', 'IE', 'Romance'), ('fr', 'IE', 'Romance'))
SELECT family, genus, count(DISTINCT lang) AS n_languages, count(*) AS n_words FROM words JOIN r USING (lang) GROUP BY ROLLUP (family, genus)""",
)


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's measures for the score, from its words."""
    w = words(spark, sf_dir)
    n = lambda p: F.count_if(_portion() == p).alias(f"n_{p}")
    share = lambda c: F.round(F.avg((F.col(c) != "_").cast("double")), 6)
    rows = w.groupBy("lang").agg(F.count("*").alias("n_words"), F.count_if(F.col("id") == 1).alias("n_sentences"), n("train"), n("dev"), n("test"), share("lemma").alias("lemmas"), share("xpos").alias("tags"), share("feats").alias("features"))
    return rows.withColumns({"relations": F.lit(1.0), "n_genres": F.lit(4), "available": F.lit(True), "valid": F.col("lang") != "fr"})


_MEASURED = f"""WITH {WORDS_SQL}, m AS (SELECT lang, count(*) AS n_words, CAST(count_if(id = 1) AS BIGINT) AS n_sentences, CAST(count_if({_PORTION_SQL} = 'train') AS BIGINT) AS n_train, CAST(count_if({_PORTION_SQL} = 'dev') AS BIGINT) AS n_dev,
CAST(count_if({_PORTION_SQL} = 'test') AS BIGINT) AS n_test, round(count_if(lemma <> '_') / count(*), 6) AS lemmas, round(count_if(xpos <> '_') / count(*), 6) AS tags, round(count_if(feats <> '_') / count(*), 6) AS features FROM words GROUP BY lang)"""
_add(
    "star_score", lambda spark, sf_dir: surveys.stars(_measured(spark, sf_dir)).select("lang", "score", "stars"),
    f"""{_MEASURED}, s AS (SELECT lang, (10 * greatest(ln((least(n_words, 1000000) / 1000) ** 2), 0) / ln(1000000) + 2 * (0.01 + 0.33 * (n_train > 10000)::INT + 0.33 * (n_dev >= 10000)::INT + 0.33 * (n_test >= 10000)::INT)
+ 3 * (lemmas + tags + features + 1.0 + 4 / 18)) / 27 * CASE WHEN lang = 'fr' THEN 0.01 ELSE 1 END AS score FROM m) SELECT lang, round(score, 6) AS score, floor(10 * score + 0.5) / 2 AS stars FROM s""",
)
_add(
    "split_sizes", lambda spark, sf_dir: surveys.sized_splits(_measured(spark, sf_dir)),
    f"""{_MEASURED} SELECT lang, 'test-missing' AS finding FROM m WHERE n_test = 0 UNION ALL SELECT lang, 'test-too-small' FROM m WHERE n_words > 10000 AND n_test < 10000 UNION ALL SELECT lang, 'train-too-small' FROM m WHERE n_words > 20000 AND n_train < 10000
UNION ALL SELECT lang, 'dev-too-small' FROM m WHERE n_words > 30000 AND n_dev < least(9000, (n_words - n_test) // 10) UNION ALL SELECT lang, 'treebank-too-small' FROM m WHERE n_sentences < 20 OR n_words < 100""",
)
_add(
    "similar_names", lambda spark, sf_dir: surveys.similar_names(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"))),
    """WITH n AS (SELECT DISTINCT n_name AS name, string_split(lower(n_name), '') AS l FROM nation), p AS (SELECT a.name AS a, b.name AS b, a.l AS la, b.l AS lb FROM n a JOIN n b ON a.name < b.name),
s AS (SELECT a, b, round(1 - (list_sum([abs(len(list_filter(la, lambda y: y = x)) - len(list_filter(lb, lambda y: y = x))) for x in list_distinct(la || lb)]) / 2) / ((len(la) + len(lb)) / 2), 6) AS score FROM p) SELECT * FROM s WHERE score >= 0.83""",
)


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = lambda w: w.groupBy(F.concat_ws("_", "lang", "source").alias("name")).agg(F.count("*").alias("n_words"))
    w = words(spark, sf_dir)
    return surveys.release_changes(sizes(w.where("doc_id % 7 <> 0 and source <> 'src3'")), sizes(w.where("source <> 'src4'")))


_add(
    "release_changes", _changes,
    f"""WITH {WORDS_SQL}, b AS (SELECT lang || '_' || source AS name, count(*) AS n_before FROM words WHERE doc_id % 7 <> 0 AND source <> 'src3' GROUP BY ALL), a AS (SELECT lang || '_' || source AS name, count(*) AS n_after FROM words WHERE source <> 'src4' GROUP BY ALL),
j AS (SELECT *, CASE WHEN n_before IS NULL THEN 'new' WHEN n_after IS NULL THEN 'gone' WHEN abs(n_after - n_before) > 0.1 * n_before THEN 'changed' END AS change FROM b FULL JOIN a USING (name)) SELECT * FROM j WHERE change IS NOT NULL""",
)

# The parser's path: text out, text in.

_NODE = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")
_add(
    "parsed_nodes", _trees(lambda t: nodes_table(t, "doc_id", "sent_no").where("kind = 'word'").select("doc_id", "sent_no", *_NODE)),
    f"WITH {WORDS_SQL} SELECT doc_id, sent_no, CAST(id AS VARCHAR) AS id, form, lemma, upos, xpos, feats, CAST(head AS VARCHAR) AS head, deprel, deps, misc FROM words",
)
_add(
    "round_trip", _trees(lambda t: t.select("doc_id", "sent_no", (rendered(F.col("comments"), F.col("nodes")) == F.col("raw")).alias("same"))),
    f"WITH {SENTENCES_SQL} SELECT doc_id, sent_no, true AS same FROM sentences",
)
_add(
    "enhanced_edges", _words(lambda w: w.select("doc_id", "sent_no", "id", F.explode(F.expr("transform(split(nullif(deps, '_'), '[|]'), x -> struct(substring_index(x, ':', 1) as parent, regexp_replace(x, '^[^:]*:', '') as rel))")).alias("e")).select("doc_id", "sent_no", "id", "e.*")),
    f"WITH {WORDS_SQL} SELECT doc_id, sent_no, id, parent, rel FROM {_E}",
)
_KIND = "CASE WHEN CAST(parent AS BIGINT) <> head THEN 'enhanced only' WHEN rel = deprel THEN 'same' WHEN split_part(rel, ':', 1) = split_part(deprel, ':', 1) THEN 'subtype' ELSE 'incompatible' END"
_add(
    "edge_compare", lambda spark, sf_dir: graphs.counts(blocks(spark, sf_dir), KEYS).groupBy("lang").agg(*(F.sum(c).alias(c) for c in ("edge_same", "edge_subtype", "edge_incompatible", "edge_enhanced_only", "nodes_empty", "relcl"))),
    f"""WITH {WORDS_SQL}, e AS (SELECT lang, doc_id, sent_no, id, rel, {_KIND} AS kind FROM {_E}), w AS (SELECT lang, CAST(count_if(has_empty) AS BIGINT) AS n FROM words GROUP BY lang)
SELECT lang, CAST(count_if(kind = 'same') AS BIGINT) AS edge_same, CAST(count_if(kind = 'subtype') AS BIGINT) AS edge_subtype, CAST(count_if(kind = 'incompatible') AS BIGINT) AS edge_incompatible,
CAST(count_if(kind = 'enhanced only') AS BIGINT) + any_value(w.n) AS edge_enhanced_only, any_value(w.n) AS nodes_empty, CAST(count(DISTINCT CASE WHEN rel = 'ref' THEN (doc_id, sent_no, id) END) AS BIGINT) AS relcl FROM e JOIN w USING (lang) GROUP BY lang""",
)
_add("graph_properties", lambda spark, sf_dir: graphs.survey(graphs.properties(blocks(spark, sf_dir), KEYS), "lang"))
_add("edge_types", lambda spark, sf_dir: graphs.type_totals(graphs.classified(blocks(spark, sf_dir), KEYS), "lang"))
_add("collapsed_edges", lambda spark, sf_dir: graphs.direct_edges(blocks(spark, sf_dir), KEYS))
_add("collapsed_sentences", lambda spark, sf_dir: graphs.collapsed_sentences(blocks(spark, sf_dir), KEYS))
_add("reachable_sentences", lambda spark, sf_dir: graphs.reachable_sentences(blocks(spark, sf_dir), KEYS))
_add("acyclic_trees", lambda spark, sf_dir: graphs.rewritten(blocks(spark, sf_dir), KEYS, graphs.acyclic))
_add(
    "tree_shapes", lambda spark, sf_dir: graphs.shapes(blocks(spark, sf_dir), KEYS).select("doc_id", "sent_no", "depth", "n_unreached", "max_children"),
    f"""WITH RECURSIVE {WORDS_SQL}, walk AS (SELECT doc_id, sent_no, id, 1 AS depth FROM words WHERE head = 0 UNION ALL SELECT w.doc_id, w.sent_no, w.id, walk.depth + 1 FROM walk JOIN words w ON w.doc_id = walk.doc_id AND w.sent_no = walk.sent_no AND w.head = walk.id),
d AS (SELECT doc_id, sent_no, max(depth) AS depth, count(*) AS reached FROM walk GROUP BY ALL), n AS (SELECT doc_id, sent_no, count(*) AS n FROM words GROUP BY ALL), c AS (SELECT doc_id, sent_no, max(k) AS k FROM (SELECT doc_id, sent_no, head, count(*) AS k FROM words GROUP BY ALL) GROUP BY ALL)
SELECT n.doc_id, n.sent_no, CAST(coalesce(d.depth, 0) AS INTEGER) AS depth, CAST(n.n - coalesce(d.reached, 0) AS INTEGER) AS n_unreached, CAST(c.k AS INTEGER) AS max_children FROM n LEFT JOIN d USING (doc_id, sent_no) JOIN c USING (doc_id, sent_no)""",
)

# Rewrites.


def _without_second(raw: str) -> str:
    return rewrites.renumbered("\n".join(x for x in raw.split("\n") if not x.startswith("2\t")))


_add(
    "basic_to_enhanced", lambda spark, sf_dir: rewrites.enhanced_words(blocks(spark, sf_dir), ("doc_id", "sent_no")).withColumn("id", F.col("id").cast("long")),
    f"""WITH {WORDS_SQL}, e AS (SELECT DISTINCT doc_id, sent_no, id, CAST(parent AS BIGINT) AS parent, rel FROM {_E} UNION SELECT doc_id, sent_no, id, head, deprel FROM words) SELECT doc_id, sent_no, id, string_agg(parent || ':' || rel, '|' ORDER BY parent, rel) AS deps FROM e GROUP BY ALL""",
)
_add("without_enhanced", _trees(lambda t: rewrites.applied(t, rewrites.without_enhanced).select("doc_id", "sent_no", F.exists("nodes", lambda n: n["deps"] != "_").alias("left"))), f"WITH {SENTENCES_SQL} SELECT doc_id, sent_no, false AS left FROM sentences")
_add("fixed_deps", lambda spark, sf_dir: rewrites.fixed_deps(blocks(spark, sf_dir), KEYS))
_add(
    "conllx_lines", lambda spark, sf_dir: rewrites.conllx_lines(blocks(spark, sf_dir), ("doc_id", "sent_no")),
    f"WITH {WORDS_SQL} SELECT doc_id, sent_no, concat_ws(chr(9), id, form, lemma, upos, CASE WHEN xpos = '_' THEN upos ELSE upos || '_' || xpos END, feats, head, deprel, '_', '_') AS line FROM words",
)
_add(
    "renumbered", lambda spark, sf_dir: nodes_table(graphs.rewritten(blocks(spark, sf_dir), KEYS, _without_second), "doc_id", "sent_no").where("kind = 'word'").select("doc_id", "sent_no", "id", "form", "head"),
    f"""WITH {WORDS_SQL} SELECT doc_id, sent_no, CAST(CASE WHEN id > 2 THEN id - 1 ELSE id END AS VARCHAR) AS id, form, CAST(CASE WHEN head = 2 THEN 0 WHEN head > 2 THEN head - 1 ELSE head END AS VARCHAR) AS head FROM words WHERE id <> 2""",
)
_add(
    "plain_lemmas", _trees(lambda t: exploded(t.withColumn("nodes", rewrites.plain_lemmas(F.transform("nodes", lambda n: n.withField("lemma", F.concat(n["lemma"], F.lit("-1")))))), "doc_id", "sent_no").where("kind = 'word'").select("doc_id", "sent_no", "id", "lemma", "misc")),
    f"""WITH {WORDS_SQL}, l AS (SELECT *, lemma || '-1' AS l FROM words), s AS (SELECT *, upos <> 'PUNCT' AND NOT regexp_matches(form, '[0-9]') AND regexp_matches(l, '[^0-9-]-?[0-9]+$') AS strip FROM l)
SELECT doc_id, sent_no, CAST(id AS VARCHAR) AS id, CASE WHEN upos = 'PUNCT' THEN form WHEN strip THEN regexp_replace(l, '-?[0-9]+$', '') ELSE l END AS lemma, CASE WHEN strip THEN CASE WHEN misc = '_' THEN '' ELSE misc || '|' END || 'LId=' || l ELSE misc END AS misc FROM s""",
)
_add("quick_fix", lambda spark, sf_dir: rewrites.quick_fix(planted(spark, sf_dir, UNIVERSAL), (*KEYS, "source"), "sent_no", connect=True))
_add("document_text", lambda spark, sf_dir: rewrites.document_text(blocks(spark, sf_dir), ("doc_id",), "sent_no"))
_add(
    "text_without_spaces", _sentences(lambda s: s.select("doc_id", "sent_no", without_spaces(F.col("line")).alias("text"))),
    f"WITH {SENTENCES_SQL} SELECT doc_id, sent_no, regexp_replace(line, '\\s', '', 'g') AS text FROM sentences",
)
_COPIED = ("lemma", "upos", "xpos", "feats")
_add("copied_annotation", lambda spark, sf_dir: rewrites.together(blocks(spark, sf_dir), _system(blocks(spark, sf_dir)), KEYS, lambda s, t: rewrites.copied(s, t, _COPIED), (("id", "form", *_COPIED), ("id", "form", "head", "deprel", "deps", "misc"))))
_add("merged_tags", lambda spark, sf_dir: rewrites.together(blocks(spark, sf_dir), _system(blocks(spark, sf_dir)), KEYS, rewrites.merged_tags, (("id", "form", "xpos"), COLUMNS)))
_add("retokenized", lambda spark, sf_dir: rewrites.together(blocks(spark, sf_dir), _unranged(blocks(spark, sf_dir)), KEYS, rewrites.retokenized, (("id", "form", "misc"), COLUMNS)))

# Scores.


def _system(gold: DataFrame) -> DataFrame:
    """A parser's output: every seventh word (by its line) has another tag, every eleventh another head, every fifth another relation."""

    def step(raw: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        nodes = cells.Nodes(raw)
        known = nodes["id"].dictionary_encode()
        number = np.array([int(x) if x.isdigit() else 1 for x in known.dictionary.to_pylist()], np.int64)[np.asarray(known.indices, dtype=np.int64)]
        other = lambda column, value, k: pc.if_else(pa.array(nodes.word & (number % k == 0)), value, nodes[column])
        return np.arange(len(raw)), [nodes.rendered({"upos": other("upos", "X", 7), "head": other("head", "0", 11), "deprel": other("deprel", "dep", 5)})]

    return cells.per_batch(gold, KEYS, step, "raw string")


def _unranged(gold: DataFrame) -> DataFrame:
    """The same words without ranges and empty nodes."""

    def step(raw: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        nodes = cells.Nodes(raw)
        return np.arange(len(raw)), [nodes.rendered({}, nodes.word)]

    return cells.per_batch(gold, KEYS, step, "raw string")


_add("score_all", lambda spark, sf_dir: scorer.scores(blocks(spark, sf_dir), _system(blocks(spark, sf_dir)), ("doc_id", "lang"), by=("lang",)))
_add(
    "score_tags_trees", lambda spark, sf_dir: scorer.scores(blocks(spark, sf_dir), _system(blocks(spark, sf_dir)), ("doc_id", "lang"), by=("lang",)).where("metric in ('Words', 'UPOS', 'UAS', 'LAS')").select("lang", "metric", "n_gold", "n_correct", "f1"),
    f"""WITH {WORDS_SQL}, s AS (SELECT *, CASE WHEN id % 7 = 0 THEN 'X' ELSE upos END AS u, CASE WHEN id % 11 = 0 THEN 0 ELSE head END AS h, CASE WHEN id % 5 = 0 THEN 'dep' ELSE deprel END AS d FROM words),
m AS (SELECT lang, unnest(['Words', 'UPOS', 'UAS', 'LAS']) AS metric, count(*) AS n_gold, unnest([CAST(count(*) AS BIGINT), CAST(count_if(u = upos) AS BIGINT), CAST(count_if(h = head) AS BIGINT), CAST(count_if(h = head AND d = deprel) AS BIGINT)]) AS n_correct FROM s GROUP BY lang)
SELECT *, round(n_correct / n_gold, 6) AS f1 FROM m""",
)
_add("score_retokenized", lambda spark, sf_dir: scorer.scores(blocks(spark, sf_dir), _unranged(blocks(spark, sf_dir)), ("doc_id", "lang"), by=("lang",)))

# Validation.


def _validated(chosen: list[int], level: int) -> Query:
    """Findings in planted sentences, each sentence alone, counted."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = checks.incidents(checks.validate(planted(spark, sf_dir, chosen), KEYS, level=level))
        return found.groupBy("doc_id", "sent_no", "testid", "type").agg(F.count("*").alias("n"))

    return query


_add("validate_universal", _validated(UNIVERSAL, 3), planted_sql(UNIVERSAL))
_add("validate_particular", _validated(PARTICULAR, 5), planted_sql(PARTICULAR))


def _found(spark: SparkSession, sf_dir: str, level: int = 3, **options) -> DataFrame:
    return checks.validate(blocks(spark, sf_dir), (*KEYS, "source"), level=level, **options)


def _across(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.across(checks.facts(blocks(spark, sf_dir), KEYS), KEYS, "lang", "lang").select("lang", "doc_id", "sent_no", "level", "testid")


#: Sentences that pass the chain: no word is its own head.
_PASSED = "ok AS (SELECT doc_id, sent_no, lang FROM words GROUP BY ALL HAVING count_if(head = id) = 0)"
_add(
    "incidents_across", _across,
    f"""WITH {WORDS_SQL}, {_PASSED}, f AS (SELECT w.lang, w.doc_id, w.sent_no, bool_or(deps <> '_' OR has_empty) AS enhanced, bool_or(list_contains(string_split(misc, '|'), 'SpaceAfter=No') AND id = n_words AND NOT coalesce(prev, false)) AS glued
  FROM (SELECT *, lag(starts_range) OVER (PARTITION BY doc_id, sent_no ORDER BY id) AS prev FROM words) w JOIN ok USING (doc_id, sent_no) GROUP BY ALL),
g AS (SELECT *, lag(glued) OVER (PARTITION BY lang ORDER BY doc_id, sent_no) AS before FROM f), kinds AS (SELECT lang, enhanced, min((doc_id, sent_no)) AS place FROM f GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY lang, sent_no ORDER BY doc_id) AS nth FROM f WHERE doc_id % 10 = 0),
o AS (SELECT lang, doc_id, sent_no FROM words JOIN ok USING (lang, doc_id, sent_no) WHERE regexp_matches(deps, '(^|[|])[0-9]+:orphan(:|[|]|$)')),
e AS (SELECT lang, min((doc_id, sent_no)) AS empty FROM words JOIN ok USING (lang, doc_id, sent_no) WHERE has_empty GROUP BY lang), fo AS (SELECT lang, min((doc_id, sent_no)) AS orphan FROM o GROUP BY lang)
SELECT lang, empty[1] AS doc_id, empty[2] AS sent_no, 3 AS level, 'empty-node-after-eorphan' AS testid FROM e JOIN fo USING (lang) WHERE orphan < empty
UNION ALL SELECT lang, doc_id, sent_no, 3, 'eorphan-after-empty-node' FROM o JOIN e USING (lang) WHERE (doc_id, sent_no) > empty
UNION ALL SELECT lang, doc_id, sent_no, 2, 'spaceafter-newdocpar' FROM g WHERE before AND sent_no % 5 = 1
UNION ALL SELECT lang, max(place)[1], max(place)[2], 2, 'edeps-only-sometimes' FROM kinds GROUP BY lang HAVING count(*) > 1
UNION ALL SELECT lang, doc_id, sent_no, 2, 'non-unique-parallel-id' FROM p WHERE nth > 1""",
)
_CONTENT = ("rel-upos-punct", "upos-rel-punct", "rel-upos-nummod", "right-to-left-conj", "0-is-not-root", "root-is-not-0", "head-self-loop", "too-many-objects", "verbform-fin-without-mood", "missing-text")
_CONTENT_SQL = f"""{WORDS_SQL}, {_PASSED}, x AS (SELECT words.*, CASE WHEN feats = 'ExtPos=ADV' THEN 'ADV' ELSE upos END AS tag FROM words JOIN ok USING (doc_id, sent_no)), i(doc_id, sent_no, level, testid, id) AS (
SELECT doc_id, sent_no, 3, 'rel-upos-punct', id FROM x WHERE deprel = 'punct' AND tag <> 'PUNCT'
UNION ALL SELECT doc_id, sent_no, 3, 'upos-rel-punct', id FROM x WHERE tag = 'PUNCT' AND deprel NOT IN ('punct', 'root')
UNION ALL SELECT doc_id, sent_no, 3, 'rel-upos-nummod', id FROM x WHERE deprel = 'nummod' AND tag NOT IN ('NUM', 'NOUN', 'SYM')
UNION ALL SELECT doc_id, sent_no, 3, 'right-to-left-conj', id FROM x WHERE deprel = 'conj' AND id < head
UNION ALL SELECT doc_id, sent_no, 3, '0-is-not-root', id FROM x WHERE head = 0 AND deprel <> 'root'
UNION ALL SELECT doc_id, sent_no, 3, 'root-is-not-0', id FROM x WHERE head <> 0 AND deprel = 'root'
UNION ALL SELECT doc_id, sent_no, 3, 'too-many-objects', head FROM x WHERE deprel = 'obj' AND head > 0 GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT doc_id, sent_no, 2, 'head-self-loop', min(id) FROM words WHERE head = id GROUP BY ALL),
content AS (SELECT doc_id, sent_no, level, testid, CAST(id AS VARCHAR) AS node FROM i UNION ALL SELECT doc_id, sent_no, 2, 'missing-text', '' FROM ok)"""
_add(
    "incidents_content", lambda spark, sf_dir: checks.incidents(_found(spark, sf_dir, include=_CONTENT)).select("doc_id", "sent_no", "level", "testid", "node"),
    f"WITH {_CONTENT_SQL} SELECT * FROM content",
)
#: Comment lines of a sentence, and the line of each word.
_COMMENTS_SQL = "(1 + (sent_no = 1)::INT + (sent_no % 5 = 1)::INT + (doc_id % 10 = 0)::INT)"
_LINES_SQL = f"""places AS (SELECT doc_id, sent_no, CAST(id AS VARCHAR) AS node, {_COMMENTS_SQL} + sum(1 + starts_range::INT + has_empty::INT) OVER (PARTITION BY doc_id, sent_no ORDER BY id) - has_empty::INT AS line FROM words
  UNION ALL SELECT DISTINCT doc_id, sent_no, '', {_COMMENTS_SQL} + 1 FROM words)"""
_add(
    "incidents_top20_per_class", lambda spark, sf_dir: checks.capped(checks.incidents(_found(spark, sf_dir, include=_CONTENT)), 20, KEYS).select("doc_id", "sent_no", "testclass", "testid", "line", "node", "rank"),
    f"""WITH {_CONTENT_SQL}, {_LINES_SQL}, c AS (SELECT doc_id, sent_no, CASE WHEN testid = 'missing-text' THEN 'METADATA' ELSE 'SYNTAX' END AS testclass, testid, CAST(line AS INTEGER) AS line, node FROM content JOIN places USING (doc_id, sent_no, node))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY testclass ORDER BY doc_id, sent_no, line, node, testid) AS INTEGER) AS rank FROM c) WHERE rank <= 20""",
)
_add("incident_summary", lambda spark, sf_dir: checks.summary(checks.incidents(_found(spark, sf_dir)), "lang"))
_add(
    "validation_verdict", lambda spark, sf_dir: checks.passed(checks.incidents(_found(spark, sf_dir, 2, include=("head-self-loop",))), blocks(spark, sf_dir), "lang"),
    f"WITH {WORDS_SQL} SELECT lang, count(DISTINCT CASE WHEN head = id THEN (doc_id, sent_no) END) AS n_errors, CASE WHEN count_if(head = id) > 0 THEN 'FAILED' ELSE 'PASSED' END AS verdict FROM words GROUP BY lang",
)
_add("incidents_json", lambda spark, sf_dir: checks.as_json(checks.incidents(_found(spark, sf_dir, 2))))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences in which each noun is an entity named by its lemma, of a type that varies."""
    rows = nested(spark, sf_dir, "id", "form", "lemma", "upos")
    misc = lambda w: F.when(w["upos"] == "NOUN", F.concat(F.lit("Entity=("), F.regexp_replace(w["lemma"], "[^a-z]", "x"), F.lit("-"), F.when((w["id"] + F.col("doc_id")) % 19 == 0, "place").otherwise("person"), F.lit("-1)"))).otherwise("_")
    line = lambda w: F.concat_ws("\t", w["id"].cast("string"), w["form"], w["lemma"], w["upos"], *[F.lit("_")] * 5, misc(w))
    raw = F.concat(F.lit("# global.Entity = eid-etype-head\n"), F.array_join(F.transform("words", line), "\n"))
    return coreference.found(rows.select(*KEYS, raw.alias("raw")), KEYS, "lang")


_add(
    "entity_conflicts", lambda spark, sf_dir: coreference.across(_entities(spark, sf_dir), KEYS, "lang", "lang").groupBy("lang", "testid").agg(F.count("*").alias("n")),
    f"""WITH {WORDS_SQL}, m AS (SELECT lang, doc_id, sent_no, regexp_replace(lemma, '[^a-z]', 'x', 'g') AS eid, CASE WHEN (id + doc_id) % 19 = 0 THEN 'place' ELSE 'person' END AS etype, id FROM words WHERE upos = 'NOUN'),
f AS (SELECT lang, eid, min((doc_id, lang, sent_no, etype))[4] AS etype FROM m GROUP BY ALL) SELECT m.lang, 'entity-type-mismatch' AS testid, count(*) AS n FROM m JOIN f ON f.lang = m.lang AND f.eid = m.eid WHERE m.etype <> f.etype GROUP BY ALL""",
)
_add(
    "entity_clusters", lambda spark, sf_dir: coreference.clusters(_entities(spark, sf_dir), "lang"),
    f"""WITH {WORDS_SQL}, m AS (SELECT lang, regexp_replace(lemma, '[^a-z]', 'x', 'g') AS eid, CASE WHEN (id + doc_id) % 19 = 0 THEN 'place' ELSE 'person' END AS etype FROM words WHERE upos = 'NOUN'),
c AS (SELECT lang, eid, count(*) AS n_mentions, min(etype) AS etype FROM m GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_mentions DESC, eid) AS INTEGER) AS rank FROM c""",
)
_add("registry_relations", _words(lambda w: w.select("lang", universal(F.col("deprel")).alias("udeprel")).distinct()), f"WITH {WORDS_SQL} SELECT DISTINCT lang, deprel AS udeprel FROM words")

# Verse references, tags by table, reports.

_VERSE_ID = """CASE doc_id % 3 WHEN 0 THEN concat('LUKE_', doc_id % 30 + 1, '.', sent_no, 'b') WHEN 1 THEN concat('Septuagint-Exodus-', doc_id % 30 + 1, ':', sent_no, '-grc') ELSE 's1' END"""
_add(
    "verse_sentences", _nested(lambda s: verses.referenced(s, F.expr(_VERSE_ID)).select("doc_id", "sent_no", "refs", "book", "chapter", "verse").orderBy(*verses.canonical(), "doc_id", "sent_no"), "misc"),
    f"""WITH {WORDS_SQL}, s AS (SELECT doc_id, sent_no, bool_or(misc LIKE '%Ref=MATT_1.2%') AS given FROM words GROUP BY ALL),
b AS (SELECT doc_id, sent_no, given, CASE WHEN given THEN 'MATT' WHEN doc_id % 3 = 0 THEN 'LUKE' ELSE 'EXOD' END AS book, CASE WHEN given THEN 1 ELSE CAST(doc_id % 30 + 1 AS INTEGER) END AS chapter,
  CASE WHEN given THEN '2' ELSE CAST(sent_no AS VARCHAR) END AS verse FROM s WHERE given OR doc_id % 3 < 2)
SELECT doc_id, sent_no, book || '_' || chapter || '.' || verse AS refs, book, chapter, verse FROM b""",
)
_TO_UNIVERSAL = {(u, f"{u}-{k}", "_"): ("X", f"Typo={u}") for u in UPOS for k in (1, 2)}
_add(
    "converted_tags", _trees(lambda t: exploded(t.withColumn("nodes", rewrites.converted_tags(F.col("nodes"), _TO_UNIVERSAL)), "doc_id", "sent_no").where("kind = 'word'").select("doc_id", "sent_no", "id", "upos", "feats")),
    f"""WITH {WORDS_SQL}, w AS (SELECT *, feats = '_' AND (xpos LIKE '%-1' OR xpos LIKE '%-2') AS new FROM words)
SELECT doc_id, sent_no, CAST(id AS VARCHAR) AS id, CASE WHEN new THEN 'X' ELSE upos END AS upos, CASE WHEN new THEN 'Typo=' || upos ELSE feats END AS feats FROM w""",
)
_add(
    "tags_to_xpos", lambda spark, sf_dir: rewrites.xpos_of_words(blocks(spark, sf_dir), ("doc_id", "sent_no"), {(u, "_"): f" {u[0]}  {u[1:]} " for u in UPOS}),
    f"WITH {WORDS_SQL} SELECT doc_id, sent_no, CAST(id AS VARCHAR) AS id, CASE WHEN feats = '_' THEN trim(upos[1] || ' ' || upos[2:]) ELSE '_' END AS xpos FROM words",
)
_add(
    "parallel_inserted", _trees(lambda t: t.select("doc_id", "sent_no", F.explode(rewrites.with_parallel(F.col("comments"), "[0-9]+-1", "px")).alias("comment")).where("comment LIKE '# parallel_id%'")),
    f"""WITH {SENTENCES_SQL} SELECT doc_id, sent_no, '# parallel_id = px/' || doc_id || '-1' AS comment FROM sentences WHERE sent_no = 1
UNION ALL SELECT doc_id, sent_no, '# parallel_id = up/' || sent_no FROM sentences WHERE doc_id % 10 = 0""",
)
_REPORT_SQL = f"""{WORDS_SQL}, f AS (SELECT lang, 'tag' AS section, upos AS name, lemma AS example, '' AS upos FROM words UNION ALL SELECT lang, 'dep', deprel, '', '' FROM words
  UNION ALL SELECT lang, 'feat', unnest(string_split(feats, '|')), form, upos FROM words WHERE feats <> '_'),
c AS (SELECT lang, section, name, example, count(*) AS n FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang, section, name ORDER BY n DESC, example) AS rank FROM c),
report AS (SELECT f.lang, f.section, f.name, count(*) AS n, string_agg(DISTINCT f.upos, ',' ORDER BY f.upos) AS upos,
  CASE WHEN f.section = 'dep' THEN '' ELSE any_value(x.examples) END AS examples FROM f
  LEFT JOIN (SELECT lang, section, name, string_agg(example, ', ' ORDER BY rank) AS examples FROM r WHERE rank <= 10 GROUP BY ALL) x USING (lang, section, name) GROUP BY f.lang, f.section, f.name)"""


def _report(step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: step(render.report(gathered(spark, sf_dir, "form", "lemma", "upos", "feats", "deprel"), "lang"))


_add("statistics_report", _report(lambda r: r), f"WITH {_REPORT_SQL} SELECT * FROM report")
_add(
    "statistics_xml", _report(lambda r: render.xml(r.where("section <> 'feat'")).select("lang", "line")),
    f"""WITH {_REPORT_SQL} SELECT lang, '<' || section || ' name="' || name || '">' || n || '</' || section || '>' || CASE WHEN examples = '' THEN '' ELSE '<!-- ' || replace(examples, '--', '–') || ' -->' END AS line FROM report WHERE section <> 'feat'""",
)
_add(
    "statistics_markdown", _report(lambda r: render.markdown(r.where("section = 'dep'"), "lang", "name", "n")),
    f"""WITH {_REPORT_SQL} SELECT 2 AS place, '| ' || lang || ' | ' || name || ' | ' || n || ' |' AS line FROM report WHERE section = 'dep'
UNION ALL SELECT 0, '| lang | name | n |' UNION ALL SELECT 1, '| --- | --- | --- |'""",
)
_add("collated_lemmas", _words(lambda w: render.collated(w.select("lang", "lemma").distinct(), "lemma", "cs", "lang")))

# Files: the treebank written in order, read again by ranges, and validated as files.


def _in_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder into which the treebank has been written: a file (or pieces) for each language and portion."""
    folder = new_folder(spark, "treebank")
    files.write(blocks(spark, sf_dir).withColumn("portion", _portion()), folder, "lang", "portion", "doc_id", "sent_no")
    return folder


_FILES_SQL = f"f AS (SELECT lang, {_PORTION_SQL} AS portion, doc_id, sent_no, {_COMMENTS_SQL} + CAST(sum(1 + starts_range::INT + has_empty::INT) AS BIGINT) + 1 AS n FROM words GROUP BY lang, doc_id, sent_no)"
_add(
    "files_read_back", lambda spark, sf_dir: files.read(spark, _in_files(spark, sf_dir), 1 << 20).select("treebank", "portion", "sent_no", "line", F.regexp_extract("raw", r"# sent_id = (\S+)", 1).alias("sent_id"), F.endswith("raw", F.lit("\n")).alias("ended"), "cr"),
    f"""WITH {WORDS_SQL}, {_FILES_SQL} SELECT lang AS treebank, portion, row_number() OVER o AS sent_no, CAST(1 + sum(n) OVER o - n AS BIGINT) AS line, doc_id || '-' || sent_no AS sent_id, true AS ended, false AS cr
FROM f WINDOW o AS (PARTITION BY lang, portion ORDER BY doc_id, sent_no ROWS UNBOUNDED PRECEDING)""",
)
_WHOLE = ("head-self-loop", "missing-text", "non-unique-parallel-id", "edeps-only-sometimes", "spaceafter-newdocpar", "non-unique-sent-id", "missing-empty-line", "non-unix-newline")
_add(
    "files_validated", lambda spark, sf_dir: validator.validate_files(spark, _in_files(spark, sf_dir), level=2, include=_WHOLE, range_bytes=1 << 20).counts,
    f"""WITH {WORDS_SQL}, {_PASSED}, g AS (SELECT w.lang, {_PORTION_SQL} AS portion, w.doc_id, w.sent_no, bool_or(deps <> '_' OR has_empty) AS enhanced, bool_or(list_contains(string_split(misc, '|'), 'SpaceAfter=No') AND id = n_words AND NOT coalesce(prev, false)) AS glued
  FROM (SELECT *, lag(starts_range) OVER (PARTITION BY doc_id, sent_no ORDER BY id) AS prev FROM words) w JOIN ok USING (doc_id, sent_no) GROUP BY ALL),
i AS (SELECT lang, 'SYNTAX' AS testclass, 'head-self-loop' AS testid FROM words WHERE head = id GROUP BY doc_id, sent_no, lang UNION ALL SELECT lang, 'METADATA', 'missing-text' FROM g
  UNION ALL SELECT lang, 'METADATA', 'non-unique-parallel-id' FROM (SELECT lang, row_number() OVER (PARTITION BY lang, sent_no) AS nth FROM g WHERE doc_id % 10 = 0) WHERE nth > 1
  UNION ALL SELECT lang, 'ENHANCED', 'edeps-only-sometimes' FROM g GROUP BY lang HAVING count(DISTINCT enhanced) > 1
  UNION ALL SELECT lang, 'METADATA', 'spaceafter-newdocpar' FROM (SELECT lang, sent_no, lag(glued) OVER (PARTITION BY lang, portion ORDER BY doc_id, sent_no) AS before FROM g) WHERE before AND sent_no % 5 = 1)
SELECT lang AS treebank, 'ERROR' AS type, testclass, testid, count(*) AS n FROM i GROUP BY ALL""",
)

# The registry's files against the treebank: French is not registered, German bans Mood and lacks `dep`, Spanish lacks an accusative and plural verbs.


def _registry(spark: SparkSession) -> registry.Tables:
    """Written as JSON files and loaded from them."""
    en = registry.SAMPLE["en"]
    de = replace(en, features={f: v for f, v in en.features.items() if f != "Mood"}, banned=en.banned | {"Mood"}, relations=en.relations - {"dep"})
    es = replace(en, features={**en.features, "Case": {u: {"Nom"} for u in en.features["Case"]}, "Number": {**en.features["Number"], "VERB": {"Sing"}}})
    folder = new_folder(spark, "registry")
    for name, text in registry.as_json({"en": en, "de": de, "es": es}).items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    return registry.load(spark, folder)


_add(
    "incidents_registry", lambda spark, sf_dir: lookups.judged(worked(spark, sf_dir, lookups.FIELDS, lookups.asked_step(KEYS, "lang"), KEYS, lookups.ASKED), _registry(spark), KEYS).groupBy("lang", "upos", "level", "testid").agg(F.count("*").alias("n")),
    f"""WITH {WORDS_SQL}, x AS (SELECT *, CASE WHEN list_contains(string_split(misc, '|'), 'Lang=en') THEN 'en' ELSE lang END AS own FROM words),
t AS (SELECT x.*, p.own AS above FROM x LEFT JOIN x p ON p.doc_id = x.doc_id AND p.sent_no = x.sent_no AND p.lang = x.lang AND p.id = x.head),
f AS (SELECT lang, upos, feature, CASE WHEN feature = 'Foreign' THEN lang ELSE own END AS l, unnest(string_split(v, ',')) AS v FROM (SELECT lang, upos, own, split_part(x, '=', 1) AS feature, split_part(x, '=', 2) AS v FROM (SELECT *, unnest(string_split(feats, '|')) AS x FROM t WHERE feats <> '_'))),
tags(feature, tags) AS (VALUES ('Number', ['NOUN', 'PROPN', 'ADJ', 'PRON', 'DET', 'VERB', 'AUX']), ('Case', ['NOUN', 'PROPN', 'ADJ', 'PRON', 'DET']), ('Mood', ['VERB', 'AUX']), ('VerbForm', ['VERB', 'AUX']), ('PronType', ['PRON', 'DET']), ('Foreign', ['X', 'PROPN'])),
e AS (SELECT t.*, split_part(e, ':', 1) AS h, substr(e, strpos(e, ':') + 1) AS rel FROM (SELECT *, unnest(string_split(deps, '|')) AS e FROM t WHERE deps <> '_') t),
g AS (SELECT e.lang, e.upos, e.rel, e.own, p.own AS above FROM e LEFT JOIN x p ON p.doc_id = e.doc_id AND p.sent_no = e.sent_no AND p.lang = e.lang AND p.id = CAST(e.h AS BIGINT)),
i(lang, upos, level, testid) AS (
SELECT lang, upos, 4, CASE WHEN l = 'fr' THEN 'feature-unknown' WHEN l = 'de' AND feature = 'Mood' THEN 'feature-not-permitted' WHEN l = 'es' AND v = 'Acc' THEN 'feature-value-unknown' WHEN feature <> 'ExtPos' AND NOT list_contains(tags, upos) THEN 'feature-upos-not-permitted'
  WHEN l = 'es' AND upos = 'VERB' AND v = 'Plur' THEN 'feature-value-upos-not-permitted' END FROM f LEFT JOIN tags USING (feature)
UNION ALL SELECT lang, upos, 4, 'unknown-deprel' FROM t WHERE (lang = 'fr' OR (lang = 'de' AND deprel = 'dep')) AND NOT (own <> lang AND own IS NOT DISTINCT FROM above)
UNION ALL SELECT lang, upos, 4, 'unknown-edeprel' FROM g WHERE NOT (rel = 'ref' OR rel = 'conj:and' OR rel IN ('obl:in', 'nmod:in') OR (rel NOT LIKE '%:%' AND NOT (lang = 'de' AND rel = 'dep'))) AND NOT (own <> lang AND own IS NOT DISTINCT FROM above AND rel = 'dep')
UNION ALL SELECT lang, upos, 4, 'unknown-edeprel' FROM g WHERE lang = 'fr' AND (rel = 'ref' OR rel = 'conj:and' OR rel IN ('obl:in', 'nmod:in') OR rel NOT LIKE '%:%') AND NOT (own <> lang AND own IS NOT DISTINCT FROM above)
UNION ALL SELECT lang, upos, 5, 'aux-lemma' FROM t WHERE upos = 'AUX' AND (own = 'fr' OR lemma NOT IN ('be', 'have'))
UNION ALL SELECT lang, upos, 5, 'cop-lemma' FROM t WHERE deprel = 'cop' AND (own = 'fr' OR lemma <> 'be'))
SELECT lang, upos, level, testid, count(*) AS n FROM i WHERE testid IS NOT NULL GROUP BY ALL""",
)
_add(
    "registry_explained", lambda spark, sf_dir: registry.explained(_registry(spark)).join(words(spark, sf_dir).select("lang").distinct(), "lang").where("what in ('auxiliaries', 'copulas', 'words with spaces')"),
    f"""WITH {WORDS_SQL}, l AS (SELECT DISTINCT lang FROM words WHERE lang <> 'fr'), t(what, text) AS (VALUES ('auxiliaries', 'Permitted auxiliaries: be, have'), ('copulas', 'Permitted copulas: be'), ('words with spaces', 'Permitted words with spaces: \\A(?:[0-9]+( [0-9]{{3}})+|a lot)\\z')) SELECT lang, what, text FROM l, t""",
)

# Versions of a text that meet by the places of their characters.


def _lines(spark: SparkSession, sf_dir: str, lemma: str = "w.lemma", split: int = 0) -> DataFrame:
    """The treebank's words without ranges and empty nodes; with `split`, in two sentences each, cut behind that word."""
    cells = ", ".join("w.id" if c == "id" else lemma if c == "lemma" else f"w.{c}" for c in _NODE)
    rows = nested(spark, sf_dir).withColumn("lines", F.expr(f"transform(words, w -> concat_ws('\t', {cells}))"))
    if split:
        parts = F.array(F.struct(F.lit(0).alias("part"), F.slice("lines", 1, split).alias("lines")), F.struct(F.lit(1).alias("part"), F.slice("lines", split + 1, 1 << 30).alias("lines")))
        rows = rows.select("doc_id", "lang", F.col("sent_no"), F.explode(parts).alias("p")).where("size(p.lines) > 0").select("doc_id", "lang", (2 * F.col("sent_no") + F.col("p.part")).alias("sent_no"), "p.lines")
    return rows.select("doc_id", "lang", "sent_no", F.array_join("lines", "\n").alias("raw"))


_add(
    "resegmented", lambda spark, sf_dir: offsets.resegmented(_lines(spark, sf_dir, split=5), blocks(spark, sf_dir), ("doc_id",), "sent_no").select("doc_id", F.col("number").cast("long").alias("number"), F.regexp_extract("raw", r"\A# sent_id = (\S+)", 1).alias("name"), F.regexp_count("raw", F.lit("(?m)^[0-9]+\t")).cast("long").alias("n_words")),
    f"""WITH {WORDS_SQL}, c AS (SELECT *, id = n_words OR (id = 5 AND (doc_id + 5) % 29 <> 0) AS cut FROM words), n AS (SELECT *, 1 + coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY sent_no, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS number FROM c),
g AS (SELECT doc_id, number, sent_no, count(*) AS n_words FROM n GROUP BY ALL)
SELECT doc_id, CAST(number AS BIGINT) AS number, doc_id || '-' || sent_no || CASE WHEN row_number() OVER (PARTITION BY doc_id, sent_no ORDER BY number) = 2 THEN 'B' ELSE '' END AS name, n_words FROM g""",
)
_add(
    "lemmas_aligned", lambda spark, sf_dir: offsets.lemmas(blocks(spark, sf_dir), _lines(spark, sf_dir, "concat('L-', w.lemma)"), ("doc_id",), "sent_no").where("id not like '%-%'").select("doc_id", "sent_no", "id", "lemma"),
    f"""WITH {WORDS_SQL}, r AS (SELECT *, starts_range OR coalesce(lag(starts_range) OVER (PARTITION BY doc_id, sent_no ORDER BY id), false) AS inside FROM words) SELECT doc_id, sent_no, CAST(id AS VARCHAR) AS id, CASE WHEN inside THEN lemma ELSE 'L-' || lemma END AS lemma FROM r""",
)

# Histories, composed characters, paragraphs, side by side.


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is a treebank that takes the next source's name after a release; the last of a chain takes the first one's again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("source").rlike("^src[0-9]+$"))
    releases = docs.select(F.concat(F.lit("2."), F.col("doc_id") % 12).alias("release"), F.col("source").alias("name")).distinct()
    number = F.regexp_extract("name", "[0-9]+", 0).cast("int")
    renamed = releases.select("name").distinct().where(number < 4).select(F.col("name").alias("old"), F.concat(F.lit("src"), (number + 1) % 4).alias("new"), F.concat(F.lit("2."), 2 * number + 3).alias("after"))
    return release.history(releases, renamed)


_add(
    "release_history", _history,
    """WITH RECURSIVE r AS (SELECT DISTINCT CAST(doc_id % 12 AS INTEGER) AS minor, source AS name FROM documents WHERE regexp_matches(source, '^src[0-9]+$')),
n AS (SELECT DISTINCT name AS old, 'src' || ((CAST(substr(name, 4) AS INTEGER) + 1) % 4) AS new, 2 * CAST(substr(name, 4) AS INTEGER) + 3 AS after FROM r WHERE CAST(substr(name, 4) AS INTEGER) < 4),
c AS (SELECT minor, name, minor AS place, name AS called FROM r UNION ALL SELECT c.minor, c.name, n.after + 1, n.new FROM c JOIN n ON n.old = c.called AND n.after >= c.place),
l AS (SELECT minor, name, max_by(called, place) AS newest FROM c GROUP BY ALL)
SELECT newest AS name, '2.' || min(minor) AS first, '2.' || max(minor) AS last, count(DISTINCT minor) AS n FROM l GROUP BY newest""",
)
_add(
    "composed_lines", _sentences(lambda s: s.select("doc_id", "sent_no", composed(F.replace(F.col("line"), F.lit("e"), F.when(F.col("sent_no") % 2 == 0, "e\u0301").otherwise("e"))).alias("line"))),
    f"WITH {SENTENCES_SQL} SELECT doc_id, sent_no, nfc_normalize(CASE WHEN sent_no % 2 = 0 THEN replace(line, 'e', 'e' || chr(769)) ELSE line END) AS line FROM sentences",
)
_add(
    "spaced_paragraphs", lambda spark, sf_dir: cells.table(rewrites.spaced_before_paragraphs(blocks(spark, sf_dir), KEYS, "doc_id").where("changed"), ("doc_id", "sent_no"), "id", "misc"),
    f"""WITH {WORDS_SQL}, s AS (SELECT doc_id, lang, sent_no, bool_or(list_contains(string_split(misc, '|'), 'SpaceAfter=No') AND id = n_words AND NOT coalesce(prev, false)) AS glued FROM (SELECT *, lag(starts_range) OVER (PARTITION BY doc_id, sent_no ORDER BY id) AS prev FROM words) GROUP BY ALL),
n AS (SELECT *, lead(sent_no) OVER (PARTITION BY doc_id ORDER BY lang, sent_no) AS next FROM s)
SELECT w.doc_id, w.sent_no, CAST(id AS VARCHAR) AS id, CASE WHEN id = n_words THEN coalesce(nullif(array_to_string(list_filter(string_split(misc, '|'), lambda x: x <> 'SpaceAfter=No'), '|'), ''), '_') ELSE misc END AS misc FROM words w JOIN n USING (doc_id, sent_no) WHERE glued AND next % 5 = 1""",
)
_SIDES = ("de", "en", "es", "fr")
_add(
    "side_by_side", _words(lambda w: surveys.side_by_side(w, "lang", _SIDES)),
    f"""WITH {WORDS_SQL}, f AS (SELECT lang, 'tag' AS section, upos AS name FROM words UNION ALL SELECT lang, 'relation', deprel FROM words UNION ALL SELECT lang, 'features', feats FROM words),
c AS (SELECT section, name, lang, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT lang, count(*) AS total FROM words GROUP BY lang)
SELECT section, name, {", ".join(f"coalesce(sum(CAST(floor(100 * n / total + 0.5) AS BIGINT)) FILTER (lang = '{x}'), 0)::BIGINT AS {x}" for x in _SIDES)} FROM c JOIN t USING (lang) GROUP BY section, name""",
)
_add(
    "feature_companions", _words(surveys.companions),
    f"""WITH {WORDS_SQL}, x AS (SELECT doc_id, sent_no, id, upos, f, split_part(f, '=', 1) AS feature FROM (SELECT doc_id, sent_no, id, upos, unnest(string_split(feats, '|')) AS f FROM words WHERE feats <> '_')), t AS (SELECT upos, count(*) AS total FROM words GROUP BY upos),
v AS (SELECT upos, f, count(*) AS n FROM x GROUP BY ALL), u AS (SELECT upos, feature FROM x JOIN t USING (upos) GROUP BY upos, feature HAVING count(*) > 0.1 * any_value(total)),
p AS (SELECT a.upos, a.f AS feature, b.f AS other, count(*) AS n FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.sent_no = b.sent_no AND a.id = b.id AND a.upos = b.upos AND a.f <> b.f WHERE (a.upos, a.feature) IN (SELECT (upos, feature) FROM u) AND (b.upos, b.feature) IN (SELECT (upos, feature) FROM u) GROUP BY ALL)
SELECT p.upos, p.feature, p.other, p.n, CAST(floor(100 * p.n / v.n + 0.5) AS BIGINT) AS percent FROM p JOIN v ON v.upos = p.upos AND v.f = p.feature WHERE p.n > 0.5 * v.n""",
)

# Rules as filters: on the treebank as it is, and on cells broken by residue classes of the words.


_ASKED_SQL = " ".join(f"UNION ALL SELECT lang, '{r}', 'ERROR' FROM x WHERE deprel = '{d}' AND tag NOT IN ({tags})" for r, d, tags in (
    ("rel-upos-det", "det", "'DET', 'PRON'"), ("rel-upos-nummod", "nummod", "'NUM', 'NOUN', 'SYM'"), ("rel-upos-expl", "expl", "'PRON', 'DET', 'PART'"), ("rel-upos-aux", "aux", "'AUX'"), ("rel-upos-cop", "cop", "'AUX', 'PRON', 'DET', 'SYM'"),
    ("rel-upos-punct", "punct", "'PUNCT'"), ("rel-upos-case", "case", "'ADP', 'ADV', 'CCONJ', 'INTJ', 'NOUN', 'PART', 'PUNCT', 'SCONJ', 'SYM', 'VERB', 'X'"), ("rel-upos-mark", "mark", "'ADP', 'ADV', 'CCONJ', 'PART', 'PUNCT', 'SCONJ', 'SYM', 'VERB', 'X'"),
    ("rel-upos-cc", "cc", "'ADP', 'ADV', 'CCONJ', 'PART', 'PUNCT', 'SCONJ', 'SYM', 'X'"),
))
_LEAF_SQL = " ".join(f"UNION ALL SELECT lang, '{t}', 'ERROR' FROM x WHERE p_rel IN ({p}) AND deprel NOT IN ({a})" for t, p, a in (
    ("leaf-mark-case", "'mark', 'case'", "'advmod', 'obl', 'goeswith', 'fixed', 'reparandum', 'conj', 'cc', 'punct'"), ("leaf-aux-cop", "'aux', 'cop'", "'goeswith', 'fixed', 'reparandum', 'conj', 'cc', 'punct'"),
    ("leaf-det", "'det'", "'det', 'case', 'advmod', 'obl', 'clf', 'goeswith', 'fixed', 'flat', 'compound', 'reparandum', 'discourse', 'parataxis', 'conj', 'cc', 'punct'"), ("leaf-clf", "'clf'", "'advmod', 'obl', 'goeswith', 'fixed', 'reparandum', 'conj', 'cc', 'punct'"),
    ("leaf-cc", "'cc'", "'goeswith', 'fixed', 'reparandum', 'conj', 'punct'"), ("leaf-fixed", "'fixed'", "'goeswith', 'reparandum', 'conj', 'punct'"), ("leaf-punct", "'punct'", "'punct'"),
))
_add(
    "rules_content", lambda spark, sf_dir: worked(spark, sf_dir, rules.FIELDS, rules.content_step(KEYS, sound=True), KEYS, rules.FOUND).where("testid <> 'leaf-goeswith'").groupBy("lang", "testid", "type").agg(F.count("*").alias("n")),
    f"""WITH {WORDS_SQL}, {_PASSED}, w AS (SELECT words.*, CASE WHEN feats = 'ExtPos=ADV' THEN 'ADV' ELSE upos END AS tag FROM words JOIN ok USING (doc_id, sent_no)),
k AS (SELECT doc_id, sent_no, head AS id, list(DISTINCT deprel) AS below, count_if(deprel IN ('nsubj', 'csubj')) AS subjects, count_if(deprel = 'obj') AS objects FROM w GROUP BY ALL),
y AS (SELECT w.*, coalesce(k.below, []) AS below, coalesce(subjects, 0) AS subjects, coalesce(objects, 0) AS objects FROM w LEFT JOIN k USING (doc_id, sent_no, id)),
x AS (SELECT y.*, p.upos AS p_upos, p.deprel AS p_rel, p.below AS p_below FROM y LEFT JOIN y p ON p.doc_id = y.doc_id AND p.sent_no = y.sent_no AND p.id = y.head),
e AS (SELECT lang, split_part(e, ':', 1) AS h, split_part(substr(e, strpos(e, ':') + 1), ':', 1) AS r FROM (SELECT lang, unnest(string_split(deps, '|')) AS e FROM w WHERE deps <> '_')),
f(lang, testid, type) AS (SELECT lang, 'pron-det-without-prontype', 'WARNING' FROM x WHERE upos IN ('PRON', 'DET') AND feats NOT LIKE '%PronType=%'
UNION ALL SELECT lang, '0-is-not-root', 'ERROR' FROM x WHERE head = 0 AND deprel <> 'root' UNION ALL SELECT lang, 'root-is-not-0', 'ERROR' FROM x WHERE head <> 0 AND deprel = 'root'
UNION ALL SELECT lang, 'fixed-without-extpos', 'WARNING' FROM x WHERE list_contains(below, 'fixed') AND feats NOT LIKE '%ExtPos=%' UNION ALL SELECT lang, 'upos-rel-punct', 'ERROR' FROM x WHERE tag = 'PUNCT' AND deprel NOT IN ('punct', 'root')
UNION ALL SELECT lang, 'rel-upos-fixed', 'ERROR' FROM x WHERE tag = 'PROPN' AND (deprel = 'fixed' OR list_contains(below, 'fixed')) UNION ALL SELECT lang, 'too-many-subjects', 'ERROR' FROM x WHERE subjects > 1 UNION ALL SELECT lang, 'too-many-objects', 'ERROR' FROM x WHERE objects > 1
UNION ALL SELECT lang, 'obl-should-be-nmod', 'ERROR' FROM x WHERE deprel = 'obl' AND p_upos IN ('NOUN', 'PROPN', 'PRON') AND p_rel IN ('nsubj', 'obj', 'iobj', 'obl', 'vocative', 'dislocated', 'expl', 'nmod') AND NOT list_has_any(p_below, ['cop', 'nsubj', 'csubj'])
UNION ALL SELECT lang, 'goeswith-missing-typo', 'ERROR' FROM x WHERE list_contains(below, 'goeswith') UNION ALL SELECT lang, 'goeswith-lemma', 'ERROR' FROM x WHERE deprel = 'goeswith' AND lemma <> '_' UNION ALL SELECT lang, 'goeswith-upos', 'ERROR' FROM x WHERE deprel = 'goeswith' AND upos <> 'X'
UNION ALL SELECT lang, 'goeswith-feats', 'ERROR' FROM x WHERE deprel = 'goeswith' AND feats <> '_' UNION ALL SELECT lang, 'goeswith-edeps', 'ERROR' FROM x WHERE deprel = 'goeswith' AND deps NOT IN ('_', head || ':goeswith')
UNION ALL SELECT lang, 'rel-upos-advmod', 'ERROR' FROM x WHERE deprel = 'advmod' AND tag NOT IN ('ADV', 'ADJ', 'CCONJ', 'DET', 'PART', 'SYM') AND NOT list_contains(below, 'goeswith')
UNION ALL SELECT lang, 'right-to-left-' || deprel, 'ERROR' FROM x WHERE deprel IN ('conj', 'fixed', 'flat', 'goeswith', 'appos') AND id < head
UNION ALL SELECT lang, 'orphan-parent', 'WARNING' FROM x WHERE deprel = 'orphan' AND coalesce(p_rel, '') NOT IN ('conj', 'parataxis', 'root', 'csubj', 'ccomp', 'advcl', 'acl', 'reparandum')
UNION ALL SELECT lang, 'enhanced-0-is-not-root', 'ERROR' FROM e WHERE h = '0' AND r <> 'root' UNION ALL SELECT lang, 'enhanced-root-is-not-0', 'ERROR' FROM e WHERE h <> '0' AND r = 'root' {_ASKED_SQL} {_LEAF_SQL})
SELECT lang, testid, type, count(*) AS n FROM f GROUP BY ALL""",
)
#: By the residue of id + doc_id: column, what it becomes, the findings.
_BROKEN = [
    ("upos", "NOU", ["unknown-upos"]), ("feats", "Number=Sing|Case=Nom", ["unsorted-features"]), ("feats", "case=Nom", ["invalid-feature"]), ("feats", "Case=Acc,Acc", ["repeated-feature-value"]), ("feats", "Case=Nom,Acc", ["unsorted-feature-values"]),
    ("feats", "Case=Acc|Case=Nom", ["repeated-feature"]), ("deprel", "Obj", ["invalid-deprel"]), ("deprel", "object", ["unknown-udeprel"]), ("deps", "7:obj|3:conj", ["unsorted-deps"]), ("deps", "3:obj|3:conj", ["unsorted-deps-2"]), ("deps", "3:conj|3:conj", ["repeated-deps"]),
    ("deps", "3:Conj", ["invalid-edeprel"]), ("deps", "3:ref:x", []), ("deps", "3.1:object:von_der", ["unknown-eudeprel"]), ("misc", "gloss=x", ["misc-attr-typo"]), ("misc", "Gloss=a|Gloss=b", ["repeated-misc"]), ("misc", "Gloss= a", ["misc-extra-space"]), ("xpos", "", ["empty-string-in-xpos"]),
]


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir).withColumns({"feats": F.lit("_"), "deps": F.lit("_"), "misc": F.lit("_")})
    k = (F.col("id") + F.col("doc_id")) % (2 * len(_BROKEN))
    for i, (column, value, _) in enumerate(_BROKEN):
        w = w.withColumn(column, F.when(k == i, value).otherwise(F.col(column)))
    return w


_add(
    "rules_cells", lambda spark, sf_dir: rules.cells(_broken(spark, sf_dir), KEYS).where("testid <> 'deps-self-loop'").select("doc_id", "sent_no", "node", "testid"),
    f"WITH {WORDS_SQL}, t(k, testid) AS (VALUES {', '.join(f"({i}, '{t}')" for i, (*_, found) in enumerate(_BROKEN) for t in found)}) SELECT doc_id, sent_no, CAST(id AS VARCHAR) AS node, testid FROM words JOIN t ON (id + doc_id) % {2 * len(_BROKEN)} = t.k",
)

# Twins of queries whose whole result has none: the part that SQL can tell, by words.


def _by_word(query: Query, *columns: str) -> Query:
    return lambda spark, sf_dir: cells.table(query(spark, sf_dir), ("doc_id", "sent_no"), "id", *columns)


_add(
    "fixed_deps_by_word", lambda spark, sf_dir: rewrites.fixed_deps_of_words(blocks(spark, sf_dir), ("doc_id", "sent_no")),
    f"""WITH {WORDS_SQL}, e AS (SELECT doc_id, sent_no, id, string_agg(e, '|' ORDER BY CAST(parent AS BIGINT), rel) AS deps FROM {_E} GROUP BY ALL)
SELECT doc_id, sent_no, CAST(id AS VARCHAR) AS id, coalesce(e.deps, '_') AS deps FROM words w LEFT JOIN e USING (doc_id, sent_no, id)""",
)
_SYSTEM_SQL = "CASE WHEN id % 7 = 0 THEN 'X' ELSE upos END AS u, CASE WHEN id % 11 = 0 THEN 0 ELSE head END AS h, CASE WHEN id % 5 = 0 THEN 'dep' ELSE deprel END AS d"
_add(
    "copied_annotation_by_word", _by_word(CATALOGUE["copied_annotation"][0], "lemma", "upos", "xpos", "feats", "head", "deprel"),
    f"WITH {WORDS_SQL} SELECT doc_id, sent_no, CAST(id AS VARCHAR) AS id, lemma, upos, xpos, feats, CAST(h AS VARCHAR) AS head, d AS deprel FROM (SELECT *, {_SYSTEM_SQL} FROM words)",
)
_add(
    "merged_tags_by_word", _by_word(CATALOGUE["merged_tags"][0], "upos", "xpos", "deprel"),
    f"WITH {WORDS_SQL} SELECT doc_id, sent_no, CAST(id AS VARCHAR) AS id, u AS upos, xpos, d AS deprel FROM (SELECT *, {_SYSTEM_SQL} FROM words)",
)
_add(
    "incident_summary_known", lambda spark, sf_dir: checks.summary(checks.incidents(_found(spark, sf_dir, include=_CONTENT)), "lang"),
    f"WITH {_CONTENT_SQL}, l AS (SELECT DISTINCT doc_id, lang FROM words) SELECT lang, 'ERROR' AS type, CASE WHEN testid = 'missing-text' THEN 'METADATA' ELSE 'SYNTAX' END AS testclass, testid, count(*) AS n FROM content JOIN l USING (doc_id) GROUP BY ALL",
)
_add(
    "incidents_json_known", lambda spark, sf_dir: checks.as_json(checks.incidents(_found(spark, sf_dir, 2, include=("head-self-loop", "missing-text"))).drop("source", "message")),
    f"""WITH {_CONTENT_SQL}, {_LINES_SQL}, l AS (SELECT DISTINCT doc_id, lang FROM words)
SELECT '{{"doc_id":"' || doc_id || '","lang":"' || lang || '","sent_no":"' || sent_no || '","level":"2","type":"ERROR","testclass":"' || CASE WHEN testid = 'missing-text' THEN 'METADATA' ELSE 'SYNTAX' END || '","testid":"' || testid || '","line":"' || line || '","node":"' || node || '"}}' AS json
FROM content JOIN places USING (doc_id, sent_no, node) JOIN l USING (doc_id) WHERE testid IN ('head-self-loop', 'missing-text')""",
)

# Paradigms with case folded, stems of verbs in ranges, relations in detail, scripts as expected, features as JSON.

_CELLS_SQL = "k AS (SELECT lang, lemma, upos, form, feats, count(*) AS n, lower(form) AS low, upper(substr(form, 1, 1)) || lower(substr(form, 2)) AS cap FROM words GROUP BY ALL)"
_FORMS_SQL = f"""{WORDS_SQL}, {_CELLS_SQL}, l AS (SELECT DISTINCT lang, lemma, upos, form FROM k),
fo AS (SELECT k.lang, k.lemma, k.upos, CASE WHEN a.form IS NOT NULL THEN k.low WHEN b.form IS NOT NULL THEN k.cap ELSE k.form END AS form, k.feats, CAST(sum(k.n) AS BIGINT) AS n
  FROM k LEFT JOIN l a ON (a.lang, a.lemma, a.upos, a.form) = (k.lang, k.lemma, k.upos, k.low) LEFT JOIN l b ON (b.lang, b.lemma, b.upos, b.form) = (k.lang, k.lemma, k.upos, k.cap) GROUP BY ALL)"""
_add("folded_forms", _words(lambda w: paradigms.forms(w, "lang")), f"WITH {_FORMS_SQL} SELECT * FROM fo")


def _paradigms(step: Callable[[DataFrame, DataFrame], DataFrame], **asked) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        counts = paradigms.forms(words(spark, sf_dir), "lang")
        return step(counts, paradigms.sized(counts, "lang", **asked))

    return query


_SIZED_SQL = f"{_FORMS_SQL}, p AS (SELECT lang, lemma, upos, count(DISTINCT form) AS n_forms, count(*) AS n_slots, CAST(sum(n) AS BIGINT) AS n, bool_or(feats LIKE '%Case=%') AS cased FROM fo GROUP BY ALL)"
_ORDER_SQL = "n_forms DESC, n_slots DESC, n DESC, lemma, upos"
_add(
    "paradigms_telling", _paradigms(lambda counts, chosen: paradigms.telling(chosen, "lang").withColumn("new", F.array_join("new", " "))),
    f"""WITH {_SIZED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_ORDER_SQL}) AS place FROM p), v AS (SELECT r.*, unnest(string_split(fo.feats, '|')) AS value FROM r JOIN fo USING (lang, lemma, upos)),
m AS (SELECT lang, value, min(place) AS place FROM v WHERE value <> '_' GROUP BY ALL)
SELECT lang, lemma, upos, n_forms, n_slots, r.n, string_agg(value, ' ' ORDER BY value) AS new FROM m JOIN r USING (lang, place) GROUP BY ALL""",
)
_add(
    "paradigm_tables", _paradigms(lambda counts, chosen: paradigms.table(counts, paradigms.largest(chosen, "lang"), "lang", features=("Number", "Case"), values={"Number": ("Sing", "Plur"), "Case": ("Nom", "Acc")}), tags=("NOUN", "VERB", "ADJ"), feats=("case=",)),
    f"""WITH {_SIZED_SQL}, b AS (SELECT * FROM p WHERE upos IN ('NOUN', 'VERB', 'ADJ') AND cased QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_ORDER_SQL}) = 1),
o(feats, nth) AS (VALUES ('_', 0), ('Number=Sing', 1), ('Case=Nom|Number=Sing', 2), ('Number=Plur', 3), ('Case=Acc|Number=Plur', 4), ('Case=Nom,Acc', 5), ('ExtPos=ADV', 6), ('Foreign=Yes', 7), ('Mood=Ind|VerbForm=Fin', 8), ('PronType=Prs', 9), ('VerbForm=Inf', 10))
SELECT fo.lang, fo.lemma, fo.upos, CAST(row_number() OVER (PARTITION BY fo.lang ORDER BY nth, form) AS INTEGER) AS place, form, feats, fo.n FROM fo JOIN b USING (lang, lemma, upos) JOIN o USING (feats)""",
)
_add(
    "verb_ranges", _trees(lambda t: statistics.ranges(t, "VERB")),
    f"WITH {WORDS_SQL}, r AS (SELECT lang, lower(form) AS a, lower(next_form) AS b, lower(form || next_form) AS whole, upos IN ('VERB', 'AUX') AS verb FROM words WHERE starts_range) SELECT lang, CASE WHEN verb THEN 'VERB' || b ELSE whole END AS form, CASE WHEN verb THEN 'VERB' ELSE a END || ' ' || b AS words, count(*) AS n FROM r GROUP BY ALL",
)
_add(
    "detailed_relations", _nested(statistics.detailed_pairs, "upos", "head", "deprel", "feats"),
    f"""WITH {WORDS_SQL}, m AS (SELECT *, upos || coalesce('-' || nullif(regexp_extract(feats, 'VerbForm=([^|]+)', 1), ''), '') AS as_parent, upos || coalesce('-' || nullif(regexp_extract(feats, 'Case=([^|]+)', 1), ''), '') AS as_child FROM words)
SELECT c.lang, c.deprel, p.as_parent AS parent, c.as_child AS child, count(*) AS n FROM m c JOIN m p ON (p.doc_id, p.sent_no, p.id) = (c.doc_id, c.sent_no, c.head) GROUP BY ALL""",
)


def _main_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([("en", "Latn"), ("de", "Latn"), ("es", "Grek"), ("fr", "Jpan")], "lang string, script string")
    return surveys.main_scripts(surveys.scripts(sentences(spark, sf_dir)), expected)


_CODES_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in surveys.CODES.items()) + ") t(script, code)"
_add(
    "main_scripts", _main_scripts,
    f"""WITH {SENTENCES_SQL}, l AS (SELECT lang, unnest(regexp_extract_all(line, '\\p{{L}}')) AS letter FROM sentences), s AS (SELECT lang, {_SCRIPT} AS script, count(*) AS n FROM l GROUP BY ALL),
c AS (SELECT lang, script, n, coalesce(code, script) AS code, CAST(floor(100 * n / sum(n) OVER (PARTITION BY lang) + 0.5) AS BIGINT) AS percent FROM s LEFT JOIN {_CODES_SQL} USING (script)),
e(lang, expected) AS (VALUES ('en', ['Latn']), ('de', ['Latn']), ('es', ['Grek']), ('fr', ['Hani', 'Hira', 'Kana'])),
m AS (SELECT lang, arg_min((code, percent), (-n, script)) AS main, list_sort(list(code)) AS codes FROM c GROUP BY lang)
SELECT lang, main[1] AS main, main[2] AS percent, array_to_string(expected, ',') AS expected, list_contains(expected, main[1]) AS as_expected, array_to_string(list_filter(codes, lambda x: NOT coalesce(list_contains(expected, x), false)), ',') AS others FROM m LEFT JOIN e USING (lang)""",
)
_add(
    "features_json", _words(surveys.features_json),
    f"""WITH {WORDS_SQL}, c AS (SELECT lang, upos, feature, value, count(*) AS n FROM {_F} GROUP BY ALL),
v AS (SELECT lang, upos, feature, string_agg('"' || value || '":' || n, ',' ORDER BY value) AS t FROM c GROUP BY ALL), f AS (SELECT lang, upos, string_agg('"' || feature || '":{{' || t || '}}', ',' ORDER BY feature) AS t FROM v GROUP BY ALL)
SELECT lang, '{{' || string_agg('"' || upos || '":{{' || t || '}}', ',' ORDER BY upos) || '}}' AS json FROM f GROUP BY lang""",
)
_add(
    "forms_transliterated", _words(lambda w: w.select("doc_id", "sent_no", "id", transliterated(F.col("form"), F.col("misc"), "Translit").alias("form"))),
    f"WITH {WORDS_SQL} SELECT doc_id, sent_no, id, CASE WHEN misc = 'Translit=x' THEN form || ' x' ELSE form END AS form FROM words",
)

# A release's report: a repository for each language and source, its files and README made of its number of documents.


def _repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    repo = F.concat(F.lit("UD_"), F.coalesce("lang", F.lit("none")), F.lit("-"), F.regexp_replace(F.coalesce("source", F.lit("none")), r"[^A-Za-z0-9]", ""))
    return docs.groupBy(repo.alias("name")).agg(F.count("*").alias("n"))


def _release_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    repos, n = _repositories(spark, sf_dir), F.col("n")
    unless = lambda c, x, other: F.when(c, F.lit(other)).otherwise(F.lit(x))
    listed = F.array(unless(n % 13 == 0, "README.md", "stats.xml"), unless(n % 5 == 1, "LICENSE.txt", ".gitignore"), F.lit("CONTRIBUTING.md"), unless(n % 7 == 0, "xx_y-ud-test.conllu", "xx_y-ud-train.conllu"), unless(n % 6 == 2, "eval.log", "notes.docx"))
    fields = F.concat_ws("\n", F.concat(F.lit("Data available since: UD v2."), n % 12), F.concat(F.lit("License: "), unless(n % 5 == 0, "CC BY-SA 4.0", "ask us")), F.concat(F.lit("Includes text:"), unless(n % 4 == 0, " yes", "perhaps")), F.concat(F.lit("Parallel: "), unless(n % 10 == 0, "up", "up xx")), F.concat(F.lit("Genre: "), F.when(n % 7 == 1, "").when(n % 6 == 0, "news gossip").otherwise("news  wiki")), F.concat(F.lit("Lemmas: "), unless(n % 9 == 0, "manual native", "by hand")), F.lit("UPOS: automatic\nXPOS: nothing\nXPOS: not available\nFeatures: automatic\nRelations: automatic"), F.concat(F.lit("Contributors: "), unless(n % 8 == 0, "A, B", " ")), F.lit("Contributing: elsewhere\nContact: a@b.c"))
    text = F.concat(F.lit("# Summary\n\n*"), F.expr("repeat('abcd ', cast(n % 120 as int))"), F.lit("[x](y)*\n\n"), unless(n % 3 == 0, "# Changelog\n\n* first", "# Other\n\n* first"), F.lit("\n\n"), fields, F.lit("\n"))
    released = repos.where("n % 16 <> 3").select(F.concat(F.lit("2."), F.when(n % 11 == 0, n % 12 + 1).otherwise(n % 12)).alias("release"), F.when(n % 2 == 0, F.concat("name", F.lit("Old"))).otherwise(F.col("name")).alias("name"))
    renamed = repos.where("n % 16 <> 3 and n % 2 = 0 and n % 14 <> 0").select(F.concat("name", F.lit("Old")).alias("old"), F.col("name").alias("new"))
    return release.by_treebank(release.report(repos.select("name", F.explode(F.array_distinct(listed)).alias("file")), repos.select("name", text.alias("text")), released, renamed, ("up",)))


_add(
    "release_report", _release_report,
    """WITH r AS (SELECT 'UD_' || coalesce(lang, 'none') || '-' || regexp_replace(coalesce(source, 'none'), '[^A-Za-z0-9]', '', 'g') AS name, count(*) AS n FROM documents GROUP BY ALL),
k AS (SELECT name, n, n % 16 <> 3 AS released, n % 16 <> 3 AND n % 2 = 0 AND n % 14 = 0 AS lost FROM r),
f AS (SELECT name, 'files: missing-readme' AS x FROM k WHERE n % 13 = 0 UNION ALL SELECT name, 'files: missing-license' FROM k WHERE n % 5 = 1 UNION ALL SELECT name, 'files: missing-test' FROM k WHERE n % 7 = 0 UNION ALL SELECT name, 'files: extra notes.docx' FROM k WHERE n % 6 = 2
UNION ALL SELECT name, 'metadata: available-since' FROM k WHERE n % 11 = 0 AND released AND NOT lost UNION ALL SELECT name, 'metadata: license-unknown' FROM k WHERE n % 5 = 0 UNION ALL SELECT name, 'metadata: includes-text' FROM k WHERE n % 4 = 0
UNION ALL SELECT name, 'metadata: parallel-unknown' FROM k WHERE n % 10 = 0 UNION ALL SELECT name, 'metadata: genre-unknown' FROM k WHERE n % 7 = 1 OR n % 6 = 0 UNION ALL SELECT name, 'metadata: source-lemmas' FROM k WHERE n % 9 = 0
UNION ALL SELECT name, 'metadata: missing-contributors' FROM k WHERE n % 8 = 0 UNION ALL SELECT name, 'metadata: missing-changelog' FROM k WHERE n % 3 = 0 UNION ALL SELECT name, 'metadata: summary-length' FROM k WHERE 5 * (n % 120) + 1 NOT BETWEEN 40 AND 500
UNION ALL SELECT name, 'release: new' FROM k WHERE NOT released OR lost UNION ALL SELECT name || 'Old', 'release: gone' FROM k WHERE lost)
SELECT name, count(*) AS n_findings, string_agg(x, '; ' ORDER BY x) AS findings FROM f GROUP BY name""",
)

# Level 1 on lines and the tree rules of level 2, within the sentence's row.

_HEADS = "CASE WHEN (doc_id + sent_no) % 7 = 0 AND id = 2 THEN 0 WHEN (doc_id + sent_no) % 7 = 1 AND id = 1 THEN n_words WHEN (doc_id + sent_no) % 7 = 2 AND id = 3 THEN n_words + 5 ELSE head END"


def _bent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of which some have two roots, a cycle through the first word, or a head that is no word."""
    doc = (F.col("doc_id") + F.col("sent_no")) % 7
    head = lambda w: F.when((doc == 0) & (w["id"] == 2), F.lit(0)).when((doc == 1) & (w["id"] == 1), F.size("words")).when((doc == 2) & (w["id"] == 3), F.size("words") + 5).otherwise(w["head"])
    return nested(spark, sf_dir, "id", "head").withColumn("words", F.transform("words", lambda w: F.struct(w["id"].alias("id"), head(w).cast("long").alias("head"))))


_add(
    "tree_rules", lambda spark, sf_dir: rules.trees(_bent(spark, sf_dir), ("doc_id", "sent_no")),
    f"""WITH RECURSIVE {WORDS_SQL}, b AS (SELECT doc_id, sent_no, id, {_HEADS} AS h FROM words), walk AS (SELECT doc_id, sent_no, id, 1 AS depth FROM b WHERE h = 0 UNION ALL SELECT b.doc_id, b.sent_no, b.id, walk.depth + 1 FROM walk JOIN b ON b.doc_id = walk.doc_id AND b.sent_no = walk.sent_no AND b.h = walk.id),
d AS (SELECT doc_id, sent_no, max(depth) AS depth, count(*) AS reached FROM walk GROUP BY ALL), n AS (SELECT doc_id, sent_no, count(*) AS n, count_if(h = 0) AS n_roots, count_if(h = id) AS n_loops FROM b GROUP BY ALL), c AS (SELECT doc_id, sent_no, max(k) AS k FROM (SELECT doc_id, sent_no, h, count(*) AS k FROM b GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, sent_no, CAST(coalesce(depth, 0) AS INTEGER) AS depth, CAST(n - coalesce(reached, 0) AS INTEGER) AS n_unreached, CAST(n_roots AS INTEGER) AS n_roots, CAST(n_loops AS INTEGER) AS n_loops, CAST(k AS INTEGER) AS max_children,
CASE WHEN n_loops > 0 THEN 'head-self-loop' WHEN n_roots > 1 THEN 'multiple-roots' WHEN n > coalesce(reached, 0) THEN 'non-tree' END AS verdict FROM n LEFT JOIN d USING (doc_id, sent_no) JOIN c USING (doc_id, sent_no)""",
)


def _frayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The treebank as text with a fault of the line of the third word, by the residue of the document."""
    word, k = "(\\n)(3\t[^\\n]*)", F.col("doc_id") % 8
    edited = lambda to: F.regexp_replace("raw", word, to)
    raw = F.when(k == 0, edited("$1$2\tx")).when(k == 1, edited("$1\n$2")).when(k == 2, edited("$1# late\n$2")).when(k == 3, edited("$1\u00a0\n$2")).when(k == 4, edited("$1x$2")).when(k == 5, edited("$1")).when(k == 6, F.regexp_replace("raw", "(\\n3\t)([^\t\\n]*)", "$1 $2  ")).otherwise(F.col("raw"))
    return blocks(spark, sf_dir).withColumn("raw", F.when(k == 7, raw).otherwise(F.concat(raw, F.lit("\n"))))


_LINE_FAULTS = ((0, "number-of-columns"), (1, "extra-empty-line"), (2, "misplaced-comment"), (3, "pseudo-empty-line"), (3, "extra-empty-line"), (4, "invalid-line"), (6, "leading-whitespace"), (6, "trailing-whitespace"), (6, "repeated-whitespace"))
_add(
    "rules_lines", lambda spark, sf_dir: rules.lines(_frayed(spark, sf_dir), ("doc_id", "sent_no")).where("testid in ('missing-empty-line', " + ", ".join(f"'{t}'" for _, t in _LINE_FAULTS) + ")").select("doc_id", "sent_no", "testid"),
    f"""WITH {WORDS_SQL}, t(k, testid) AS (VALUES {", ".join(f"({k}, '{t}')" for k, t in _LINE_FAULTS)}) SELECT doc_id, sent_no, testid FROM words JOIN t ON doc_id % 8 = t.k WHERE id = 3
UNION ALL SELECT doc_id, sent_no, 'extra-empty-line' FROM words WHERE doc_id % 8 = 5 AND id = 3 UNION ALL SELECT DISTINCT doc_id, sent_no, 'missing-empty-line' FROM words WHERE doc_id % 8 = 7""",
)

# A document's text, by paragraph and by line.

_SPOKEN_SQL = f"""{WORDS_SQL}, t AS (SELECT *, lag(starts_range) OVER (PARTITION BY doc_id, sent_no ORDER BY id) AS prev FROM words),
s AS (SELECT doc_id, sent_no, string_agg(CASE WHEN starts_range THEN form || next_form || ' ' WHEN list_contains(string_split(misc, '|'), 'SpaceAfter=No') THEN form ELSE form || ' ' END, '' ORDER BY id) FILTER (WHERE NOT coalesce(prev, false)) AS text FROM t GROUP BY ALL),
n AS (SELECT *, sum(CASE WHEN sent_no % 5 = 1 OR nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY sent_no) AS paragraph FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_no) AS nth FROM s)),
p AS (SELECT doc_id, CAST(paragraph AS INTEGER) AS paragraph, trim(string_agg(text, '' ORDER BY sent_no)) AS text FROM n GROUP BY ALL)"""
_add("document_paragraphs", lambda spark, sf_dir: rewrites.paragraphs(blocks(spark, sf_dir), ("doc_id",), "sent_no"), f"WITH {_SPOKEN_SQL} SELECT * FROM p")


def _filled_sql(width: int) -> str:
    """Lines of the paragraphs, one cut after another."""
    return f"""l AS (SELECT doc_id, paragraph, 0 AS line, '' AS text, text AS rest FROM p UNION ALL
  SELECT doc_id, paragraph, line + 1, rtrim(substr(rest, 1, n)), ltrim(substr(rest, n + 1)) FROM (SELECT *, CASE WHEN length(rest) <= {width} THEN length(rest)
    WHEN strpos(reverse(substr(rest, 1, {width + 1})), ' ') > 0 THEN {width + 1} - strpos(reverse(substr(rest, 1, {width + 1})), ' ') WHEN strpos(rest, ' ') > 0 THEN strpos(rest, ' ') - 1 ELSE length(rest) END AS n FROM l WHERE rest <> ''))"""


_add(
    "document_line_ends", lambda spark, sf_dir: rewrites.document_lines(blocks(spark, sf_dir), ("doc_id",), "sent_no", 40),
    f"WITH RECURSIVE {_SPOKEN_SQL}, {_filled_sql(40)} SELECT doc_id, paragraph, CAST(line AS INTEGER) AS line, text FROM l WHERE line > 0",
)
_add(
    "document_text", CATALOGUE["document_text"][0],
    f"""WITH RECURSIVE {_SPOKEN_SQL}, {_filled_sql(80)}, j AS (SELECT doc_id, paragraph, coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (WHERE line > 0), '') AS text FROM l GROUP BY ALL)
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY paragraph) AS text FROM j GROUP BY doc_id""",
)
