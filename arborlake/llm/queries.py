"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from arborlake.llm import ann, audit, exact, hmm, jpeg, minhash, mixing, packing, pii, quality, search, substring, urls
from arborlake.llm.common import documents, remainder


#: Fixed values of op6: verdict, host, path start.
RULES: list[urls.Rule] = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]


#: Target weights of op3 by path: domains, languages of a domain, and sources that differ from their siblings.
WEIGHTS: dict[mixing.Path, float] = {
    ("web",): 3.0, ("books",): 4.0, ("code",): 1.0, ("talk",): 2.0,
    **{(d, "en"): 4.0 for d in mixing.DOMAINS}, **{(d, "de"): 2.0 for d in mixing.DOMAINS},
    ("web", "en", "src0"): 3.0, ("books", "de", "src1"): 0.5, ("talk", "fr", "src3"): 0.0,
}


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), numerator=85)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(5) != 0))
    return quality.score(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), WEIGHTS).select("doc_id", "domain", "lang", "source", "epoch", "tokens", "taken")


def op4_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_features(documents(spark, sf_dir))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(documents(spark, sf_dir), remainder(7) == 2)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.refined(documents(spark, sf_dir), every_digest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_substring": op2_substring,
    "op3_mixing": op3_mixing,
    "op4_jpeg": op4_jpeg,
    "op5_ann": op5_ann,
    "op6_urls": op6_urls,
    "op7_packing": op7_packing,
    "op8_hmm": op8_hmm,
    "op9_pii": op9_pii,
    "pipeline": corpus_pipeline.run,
    "op10_minhash": op10_minhash,
    "op11_audit": op11_audit,
    "op12_search": op12_search,
    "op13_exact": op13_exact,
}


def _weights_sql(depth: int) -> str:
    rows = [(*(f"'{n}'" for n in path), str(w)) for path, w in WEIGHTS.items() if len(path) == depth]
    return "(VALUES " + ", ".join(f"({', '.join(r)})" for r in rows) + ") AS g(" + ", ".join([*("abc"[:depth]), "w"]) + ")"


def _filled_sql(table: str, parents: str, name: str) -> str:
    """A level of the tree: children in order of offer by weight are full while an equal level for the rest fits."""
    by = f"PARTITION BY {parents}" if parents else ""
    return f"""(SELECT * REPLACE (CASE WHEN sated THEN offer ELSE least(offer, w * (amount - sum(CASE WHEN sated THEN offer ELSE 0.0 END) OVER ({by}))
  / nullif(sum(CASE WHEN sated THEN 0.0 ELSE w END) OVER ({by}), 0)) END AS amount) FROM (
  SELECT *, sum(offer) OVER o + ratio * (sum(w) OVER ({by}) - sum(w) OVER o) <= amount AS sated FROM (
    SELECT * REPLACE (CASE WHEN w > 0 THEN offer ELSE 0.0 END AS offer), CASE WHEN w > 0 THEN offer / w ELSE 0.0 END AS ratio FROM {table})
  WINDOW o AS ({by} ORDER BY ratio, offer, {name} ROWS UNBOUNDED PRECEDING)))"""


_OP3 = f"""WITH d AS (SELECT doc_id, lang, source, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')) AS tokens,
  CASE WHEN regexp_matches(source, '[0-9]$') THEN (['web', 'books', 'code', 'talk'])[CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER) % 4 + 1] ELSE 'other' END AS domain,
  md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), 'null'), coalesce(text, ''))) AS document FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS DOUBLE) AS whole, CAST(sum(tokens) * 2 AS DOUBLE) AS offer FROM d GROUP BY ALL),
top AS (SELECT domain, sum(leaves.offer) AS offer, coalesce(any_value(g.w), 1.0)::DOUBLE AS w, (SELECT sum(whole) FROM leaves) AS amount FROM leaves LEFT JOIN {_weights_sql(1)} ON domain = g.a GROUP BY domain),
top_filled AS {_filled_sql("top", "", "domain")},
middle AS (SELECT l.domain, l.lang, sum(l.offer) AS offer, coalesce(any_value(g.w), 1.0)::DOUBLE AS w, any_value(t.amount) AS amount
  FROM leaves l JOIN top_filled t ON l.domain = t.domain LEFT JOIN {_weights_sql(2)} ON l.domain = g.a AND l.lang IS NOT DISTINCT FROM g.b GROUP BY l.domain, l.lang),
middle_filled AS {_filled_sql("middle", "domain", "lang")},
low AS (SELECT l.domain, l.lang, l.source, l.whole, l.offer, coalesce(g.w, 1.0)::DOUBLE AS w, m.amount
  FROM leaves l JOIN middle_filled m ON l.domain = m.domain AND l.lang IS NOT DISTINCT FROM m.lang
  LEFT JOIN {_weights_sql(3)} ON l.domain = g.a AND l.lang IS NOT DISTINCT FROM g.b AND l.source IS NOT DISTINCT FROM g.c),
plan AS (SELECT *, CAST(floor(amount / greatest(whole, 1) + 1e-9) AS INTEGER) AS epochs FROM {_filled_sql("low", "domain, lang", "source")}),
keyed AS (SELECT d.*, p.epochs, p.amount - p.epochs * p.whole AS rest, CAST('0x' || substr(md5(concat_ws('|', '11', CAST(p.epochs + 1 AS VARCHAR), document)), 1, 15) AS BIGINT) AS key
  FROM d JOIN plan p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source),
ahead AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed),
taken AS (SELECT *, epochs + CASE WHEN rest > 1e-6 AND before < rest THEN 1 ELSE 0 END AS n FROM ahead)
SELECT doc_id, domain, lang, source, CAST(e AS INTEGER) AS epoch, CAST(tokens AS BIGINT) AS tokens, n > 0 AS taken FROM (SELECT *, unnest(range(1, greatest(n, 1) + 1)) AS e FROM taken)"""

_OP10 = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS shingle FROM w),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(size.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN least USING (doc_id)"""

_FAILS = "concat(CASE WHEN len(w) < 100 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END, CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > first THEN 'E' ELSE '' END)"
_OP11 = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, {_FAILS} AS failed, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, left(filter_order, step - 1) AS before FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, s.f, contains(failed, s.f) AS fails, translate(before, failed, '') <> before AS earlier, translate(s.f || before, failed, '') = s.f || before AS stays, failed = s.f AS alone, n, good, toxic FROM m, s),
t AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (stays), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT earlier), 0) AS removed, coalesce(sum(n) FILTER (fails AND earlier), 0) AS redundant,
  coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT earlier), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT earlier), 0) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM t"""

_OP12 = """WITH term(kind, id, row, term) AS (SELECT kind, id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))
  FROM (SELECT 'doc' AS kind, doc_id AS id, row_number() OVER () AS row, text FROM documents UNION ALL SELECT 'item', item_id, 0, min(text) FROM benchmark GROUP BY item_id)),
tf AS (SELECT id AS doc_id, row, term, count(*) AS tf FROM term WHERE kind = 'doc' GROUP BY ALL), n AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY row),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n), w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY term, docs),
q AS (SELECT id AS item_id, term, count(*) AS q FROM term WHERE kind = 'item' GROUP BY ALL),
s AS (SELECT item_id, doc_id, tf.row, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n ON n.row = tf.row, g GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""

_OP13 = """WITH t AS (SELECT doc_id, row_number() OVER () AS row, regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY doc_id NULLS LAST, row) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST, row) = 1 AS kept, sha256(t) AS text_sha256 FROM t"""

#: Tests hold the others against brute force: hashes, models and closures that SQL cannot express or not within reason.
ORACLE: dict[str, str] = {"op3_mixing": _OP3, "op10_minhash": _OP10, "op11_audit": _OP11, "op12_search": _OP12, "op13_exact": _OP13}
