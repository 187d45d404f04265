"""Findings of the third review: each of these failed before."""

import random
from collections import Counter

from pyspark.sql import functions as F

from arborlake.operators import checks, coreference, rewrites, statistics
from arborlake.sources import conllu, synthetic


def test_first_mention_of_a_sentence_is_that_of_least_type(spark):
    rows = [("en", 1, "MENTION", "e", t, "") for t in ("place", "person", "place")] + [("en", 2, "MENTION", "e", "person", "")]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        df = spark.createDataFrame(order, "lang string, n int, type string, eid string, etype string, identity string").coalesce(1)
        found = coreference.across(df, ("n",), "lang", "lang").groupBy("n", "testid").count().collect()
        assert {tuple(r) for r in found} == {(1, "entity-type-mismatch", 2)}


def test_a_file_s_documents_follow_each_other(spark):
    rng, conf = random.Random(5), "spark.sql.adaptive.coalescePartitions.enabled"
    rows = [(f, d, s, rng.random() < 0.5, rng.random() < 0.5) for f in ("a", "b", None) for d in range(40) for s in (1, 2, 3)]
    expected = {(f, *x[1:3]) for f in ("a", "b", None) for own in [[r for r in rows if r[0] == f]] for before, x in zip(own, own[1:]) if before[4] and x[3]}
    facts = spark.createDataFrame(rng.sample(rows, len(rows)), "file string, doc int, sent int, begins boolean, ends_glued boolean").withColumn("place", F.struct("doc", "sent"))
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")  # so that a file lies in several tasks
    try:
        found = {tuple(r) for r in checks._after_glued(facts, ("file", "doc", "sent"), "file").where("begins").select("file", "doc", "sent").collect()}
    finally:
        spark.conf.set(conf, before)
    assert found == expected


def test_examples_sort_no_texts(spark):
    rng = random.Random(6)
    texts = [(rng.choice([None, *range(9)]), i, [("w" * rng.choice([2, 30, 90]), rng.choice("abc")) for _ in range(rng.randrange(1, 4))]) for i in range(200)]
    texts += [(4, 900, [("x" * 95, "d")]), (5, 901, [("y" * 85, "d")]), (3, 902, [("z" * 85, "d")])]
    df = spark.createDataFrame([(d, "en", "s", n, w) for d, n, w in texts], "doc_id long, lang string, source string, sent_no long, words array<struct<form: string, deprel: string>>")
    out = statistics.examples(df)
    best = {}
    for d, n, w in texts:
        text = " ".join(f for f, _ in w)
        key = (len(text) > 80, len(text) if len(text) > 80 else 0, d is not None, d or 0, n)
        for rel in {r for _, r in w}:
            best[rel] = min(best.get(rel, (key, text)), (key, text))
    assert {r.deprel: r.example for r in out.collect()} == {k: v[1] for k, v in best.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan  # the numbers; only the few texts are sorted


def test_blocks_are_the_words_rendered_by_batches(spark, tmp_path, monkeypatch):
    """Against the rows of words(), with odd ids and spaces, and cuts between sentences."""
    rows = [(None, "en", "s", "a b c\n d  e İx ΣΑΣ. ΣΑΣ b"), (-3, "en", None, "Q w x" * 60), (-4, None, "s", " \n\n x " + "é " * 300), (5, "de", "s", None), (6, "de", "s", ""), (2**40, "fr", "s", "ab\rcd  Ǆ 😀😀 x y z\n" * 9), (10, "es", "s", "one")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(synthetic, "RENDERED", 64)
    made = synthetic.blocks(spark, str(tmp_path))
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    found = {(r.doc_id, r.sent_no): r.raw for r in made.collect()}
    expected: dict = {}
    given = synthetic.words(spark, str(tmp_path)).collect()
    sizes = Counter((w.doc_id, w.sent_no) for w in given)
    forms = {(w.doc_id, w.sent_no, w.id): w.form for w in given}
    for w in sorted(given, key=lambda w: w.id):
        d, s, n = w.doc_id, w.sent_no, w.id
        out = expected.setdefault((d, s), ["# newdoc"] * (s == 1) + ["# newpar"] * (s % 5 == 1) + [f"# sent_id = {d}-{s}"] * (d is not None) + [f"# parallel_id = up/{s}"] * (d is not None and d % 10 == 0))
        if d is not None and sizes[d, s] > n and (d + n) % 29 == 0:
            out.append(f"{n}-{n + 1}\t{w.form}{forms[d, s, n + 1]}" + "\t_" * 8)
        out.append("\t".join(str(w[c]) for c in conllu.COLUMNS))
        if d is not None and (d + s + n) % 31 == 0:
            out.append(f"{n}.1\t_\t_\tVERB\t_\t_\t_\t_\t{n}:conj\t_")
    assert found == {k: "\n".join(v) for k, v in expected.items()}


def test_text_of_a_sentence_is_found_in_one_pass():
    rng = random.Random(8)
    for _ in range(300):
        ids = [f"{n}-{n + rng.randrange(-1, 3)}" if rng.random() < 0.3 else f"{n}.1" if rng.random() < 0.2 else str(n) for n in range(1, 9)]
        ids += [str(rng.randrange(1, 9))]
        rows = [(i, f"f{k}", rng.choice(["_", "SpaceAfter=No", "A=b|SpaceAfter=No", "SpaceAfter=Not"])) for k, i in enumerate(ids)]
        spans = [tuple(map(int, i.split("-"))) for i in ids if "-" in i]
        text = "".join(f + " " * ("SpaceAfter=No" not in m.split("|")) for i, f, m in rows if "-" in i or "." not in i and not any(a <= int(i) <= b for a, b in spans))
        head = rng.choice(["# newpar", "#newdoc id = x", "# newparx", "# text = newpar"])
        raw = "\n".join([head, *("\t".join([i, f, *"_______", m]) for i, f, m in rows)])
        assert list(rewrites.spoken(raw)) == [(head in ("# newpar", "#newdoc id = x"), text)]
    # 200,000 words and as many ranges in one sentence: what went through all ranges for each word never ended here.
    long = "\n".join(f"{n}-{n + 1}\tab" + "\t_" * 8 + f"\n{n}\ta" + "\t_" * 8 + f"\n{n + 1}\tb" + "\t_" * 8 for n in range(1, 200_001, 2))
    assert list(rewrites.spoken(long)) == [(False, "ab " * 100_000)]


def test_words_gathered_by_batches_are_those_of_the_expressions(spark):
    fields = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")
    rows = lambda make: {(r.doc_id, r.lang, r.source, r.sent_no): [tuple(w) for w in r.words] for r in make(spark, "/root/testdata/sf0.001", *fields).collect()}
    assert rows(synthetic.gathered) == rows(synthetic.nested)
