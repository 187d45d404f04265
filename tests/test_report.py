"""The statistics report's exchanges."""

import re

from arborlake.operators import render


def test_report_exchanges_no_tags_with_examples(spark):
    """features' forms are not exchanged with the tags of their words, nor twice."""
    rows = [("en", "a", "A", "X", "F=1|G=2", "dep"), ("en", "a", "A", "Y", "F=1", "dep"), ("en", "b", "_", "X", "_", "root")]
    found = render.report(spark.createDataFrame(rows, "lang string, form string, lemma string, upos string, feats string, deprel string"), "lang")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*example[^)]*upos", plan)
    assert {(r.section, r["name"]): (r.n, r.upos, r.examples) for r in found.collect()} == {
        ("tag", "X"): (2, "", "A, _"), ("tag", "Y"): (1, "", "A"), ("dep", "dep"): (2, "", ""), ("dep", "root"): (1, "", ""), ("feat", "F=1"): (2, "X,Y", "a"), ("feat", "G=2"): (1, "X", "a"),
    }
