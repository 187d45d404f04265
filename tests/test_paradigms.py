"""Paradigms, ranges with stems, scripts and feature objects on planted words and against plain loops."""

import json
import random
from collections import Counter, defaultdict

import pytest

from arborlake.operators import paradigms, rules, statistics, surveys
from arborlake.sources import conllu, synthetic

SCHEMA = "lang string, lemma string, upos string, form string, feats string, misc string"


def words(spark, rows):
    return spark.createDataFrame([("x", *r, *("_",) * (5 - len(r))) for r in rows], SCHEMA)


def test_forms_fold_to_lower_case_then_to_capitals(spark):
    rows = [("run", "VERB", "run"), ("run", "VERB", "Run"), ("run", "VERB", "RUN"), ("rome", "PROPN", "Rome"), ("rome", "PROPN", "ROME"), ("rome", "NOUN", "ROME"), ("nato", "PROPN", "NATO"), ("nato", "PROPN", "nAto"), (None, "X", None), ("run", "VERB", "Run", "Mood=Ind"), ("run", "VERB", "run", None)]
    found = {(r.lemma, r.upos, r.form, r.feats): r.n for r in paradigms.forms(words(spark, rows), "lang").collect()}
    assert found == {("run", "VERB", "run", "_"): 4, ("run", "VERB", "run", "Mood=Ind"): 1, ("rome", "PROPN", "Rome", "_"): 2, ("rome", "NOUN", "ROME", "_"): 1, ("nato", "PROPN", "NATO", "_"): 1, ("nato", "PROPN", "nAto", "_"): 1, ("", "X", "", "_"): 1}
    assert paradigms.forms(words(spark, []), "lang").collect() == []


@pytest.mark.parametrize("mode, form, lemma", [("none", "ab", "c"), ("add", "ab AB", "c C"), ("replace", "AB", "C")])
def test_transliterations(spark, mode, form, lemma):
    rows = [("c", "X", "ab", "_", "Translit=AB|LTranslit=C"), ("c", "X", "zz", "_", "Gloss=1"), ("c", "X", "yy", "_", None)]
    assert {(r.form, r.lemma) for r in paradigms.forms(words(spark, rows), "lang", translit=mode).collect()} == {(form, lemma), ("zz", "c"), ("yy", "c")}


def test_chosen_paradigms_equal_a_walk_along_their_order(spark):
    rng = random.Random(5)
    feats = ["_", "Case=Nom", "Case=Acc|Number=Plur", "Number=Sing", "Case=Nom|Number=Plur", "Mood=Ind"]
    rows = [(f"l{rng.randrange(6)}", rng.choice(["NOUN", "VERB"]), f"f{rng.randrange(5)}", rng.choice(feats)) for _ in range(160)]
    counts = paradigms.forms(words(spark, rows), "lang")
    cells = defaultdict(Counter)
    for lemma, upos, form, f in rows:
        cells[lemma, upos][form, f] += 1
    sizes = {k: (len({f for f, _ in v}), len(v), sum(v.values())) for k, v in cells.items()}
    order = sorted(sizes, key=lambda k: (*(-x for x in sizes[k]), k))
    found = {(r.lemma, r.upos): (r.n_forms, r.n_slots, r.n) for r in paradigms.sized(counts, "lang").collect()}
    assert found == sizes
    seen, due = set(), {}
    for key in order:
        new = {x for _, f in cells[key] for x in f.split("|") if x != "_"} - seen
        if new:
            due[key] = sorted(new)
        seen |= new
    assert {(r.lemma, r.upos): r.new for r in paradigms.telling(paradigms.sized(counts, "lang"), "lang").collect()} == due
    best = paradigms.largest(paradigms.sized(counts, "lang"), "lang").first()
    assert (best.lemma, best.upos) == order[0]
    asked = paradigms.sized(counts, "lang", lemma="L[0-3]", tags=("NOUN",), feats=("mood=", "case=nom"), shapes=("F1",), min_forms=2)
    fits = {k for k, v in cells.items() if k[0] < "l4" and k[1] == "NOUN" and any("Mood" in f for _, f in v) and any("Case=Nom" in f for _, f in v) and any(x == "f1" for x, _ in v) and sizes[k][0] > 1}
    assert {(r.lemma, r.upos) for r in asked.collect()} == fits and fits


def test_table_follows_the_order_of_features_and_values(spark):
    rows = [("a", "NOUN", x, f) for x, f in (("p", "Number=Plur"), ("s", "Number=Sing"), ("g", "Case=Gen"), ("n", "Case=Nom|Number=Sing"), ("o", "_"), ("z", "Zeal=Yes"), ("s2", "Number=Sing"))]
    counts = paradigms.forms(words(spark, rows), "lang")
    listed = paradigms.table(counts, paradigms.sized(counts, "lang"), "lang", features=("Number", "Case"), values={"Number": ("Sing", "Plur")}).orderBy("place").collect()
    assert [r.form for r in listed] == ["o", "s", "s2", "n", "p", "g", "z"]


def test_verbs_in_ranges_are_stems(spark):
    line = lambda i, form, upos: "\t".join((str(i), form, form, upos, *"______"))
    span = lambda i, form: "\t".join((i, form, *"________"))
    raw = "\n".join((span("1-2", "Darlo"), line(1, "dar", "VERB"), line(2, "lo", "PRON"), span("3-4", "del"), line(3, "de", "ADP"), line(4, "el", "DET"), span("5-7", "dármelo"), line(5, "dar", "VERB"), line(6, "me", "PRON"), line(7, "lo", "PRON"), span("8-9", "vámonos"), line(8, "vamos", "VERB"), line(9, "nos", "PRON")))
    trees = conllu.parsed(spark.createDataFrame([("es", raw)], "lang string, raw string"))
    stems = {(r.form, r.words): r.n for r in statistics.ranges(trees, "VERB").collect()}
    assert stems == {("VERBlo", "VERB lo"): 1, ("del", "de el"): 1, ("dármelo", "dar me lo"): 1, ("vámonos", "vamos nos"): 1}


def test_main_scripts_and_what_else_is_written(spark):
    lines = spark.createDataFrame([("ja", "漢字かなカナab"), ("sr", "абвг xyz"), ("el", "abc α"), ("zz", "abc")], "lang string, line string")
    expected = spark.createDataFrame([("ja", "Jpan"), ("sr", "Cyrl"), ("sr", "Latn"), ("el", "Grek")], "lang string, script string")
    found = {r.lang: (r.main, r.expected, r.as_expected, r.others) for r in surveys.main_scripts(surveys.scripts(lines), expected).collect()}
    assert found == {"ja": ("Hani", "Hani,Hira,Kana", True, "Latn"), "sr": ("Cyrl", "Cyrl,Latn", True, ""), "el": ("Latn", "Grek", False, "Latn"), "zz": ("Latn", None, None, "Latn")}


def test_features_as_nested_objects(spark):
    rows = [("a", "NOUN", "b", "Case=Nom,Acc|Number=Sing"), ("a", "NOUN", "b", "Case=Nom"), ("a", "ADJ", "b", 'Odd="q"'), ("a", "X", "b")]
    found = surveys.features_json(words(spark, rows)).collect()
    assert [json.loads(r.json) for r in found] == [{"ADJ": {"Odd": {'"q"': 1}}, "NOUN": {"Case": {"Acc": 1, "Nom": 2}, "Number": {"Sing": 1}}}]
    assert found[0].json.index("ADJ") < found[0].json.index("NOUN")


def test_rules_on_rows_and_on_arrays_agree(spark):
    keys = ("doc_id", "sent_no")
    of = lambda df: Counter(map(tuple, rules.content(df.where("doc_id < 25"), keys).collect()))
    rows, arrays = of(synthetic.words(spark, "/root/testdata/sf0.001")), of(synthetic.nested(spark, "/root/testdata/sf0.001"))
    assert rows == arrays and len(rows) > 100


def test_rules_take_heads_that_are_no_words(spark):
    row = lambda i, head, rel: (1, i, head, "w", "NOUN", "_", rel, "_", "_")
    df = spark.createDataFrame([row(2, 0, "root"), row(3, 2, "obj"), row(7, 2, "obj"), row(9, 50, "obl"), row(10, None, "dep")], "s int, id int, head int, lemma string, upos string, feats string, deprel string, deps string, misc string")
    found = {(r.node, r.testid) for r in rules.content(df, ("s",)).collect()}
    assert ("2", "too-many-objects") in found and not any(n in ("9", "10") for n, _ in found)
