"""Versions that meet packed, by document, against a plain join of the sentences (findings F7, F9 and F13 of the fourth review)."""

import random
from collections import Counter

import __spark_entry__
from arborlake.operators import rewrites
from arborlake.plans import catalogue
from arborlake.sources import synthetic
from tests.test_columns import odd_sentences

SF = "/root/testdata/sf0.001"


def test_all_pairs_meet_once(spark):
    """Sentences given twice, of one side alone, of missing keys; odd texts arrive as they are."""
    rng = random.Random(2)
    raws = odd_sentences(300)
    rows = lambda: [(rng.choice([None, 1, 2, 3]), rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), rng.choice([*raws, None])) for _ in range(900)]
    source, target = rows(), rows()
    df = lambda rows: spark.createDataFrame(rows, "d int, x string, n long, raw string").repartition(3)
    text = lambda raw: "\n".join(c for c in raw.split("\n") if not c.startswith("#")) if raw is not None else ""
    step = lambda s, t: f"{text(s)}+{t}"
    source, target = ([r for r in x if r[3] is not None] for x in (source, target))
    due = Counter((*t[:3], step(s[3], t[3])) for s in source for t in target if s[:3] == t[:3] and None not in s[:3])
    found = Counter(map(tuple, rewrites.together(df(source), df(target), ("d", "x", "n"), step).collect()))
    assert found == due and len(due) > 500
    alone = rewrites.together(df(source), df(target), ("n",), step)
    assert sum(due.values()) < alone.count() == sum(s[2] == t[2] is not None and s[2] is not None for s in source for t in target)


def test_what_a_step_reads_is_what_travels(spark):
    keys = catalogue.KEYS
    gold = synthetic.blocks(spark, SF).where("doc_id < 40")
    of = lambda df: {(r.doc_id, r.sent_no): r.raw for r in df.collect()}
    raws, system, unranged = of(gold), of(catalogue._system(gold)), of(catalogue._unranged(gold))
    for name, other, step in (("copied_annotation", system, lambda s, t: rewrites.copied(s, t, catalogue._COPIED)), ("merged_tags", system, rewrites.merged_tags), ("retokenized", unranged, rewrites.retokenized)):
        query = __spark_entry__.queries()[name](spark, SF)
        assert of(query.where("doc_id < 40")) == {k: step(raws[k], other[k]) for k in raws} and keys == tuple(query.columns[:3])
        plan = query._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "_texts" in plan
