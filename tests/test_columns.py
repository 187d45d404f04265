"""Validation and rules on columns of many sentences against the walk over each one (findings F3, F5 and F22)."""

import random
from collections import Counter

import pyarrow as pa

import __spark_entry__
from arborlake.operators import checks, columns, rules
from arborlake.sources import synthetic
from arborlake.sources.cases import CASES

SF = "/root/testdata/sf0.001"


def odd_sentences(many: int) -> list[str]:
    """Sentences that are sound, broken, or sound in odd spelling, at every gate."""
    rng = random.Random(11)
    pick = rng.choice
    rare = lambda usual, *others: pick(others) if rng.random() < 0.03 else usual
    out = []
    for k in range(many):
        n, lines = rng.randrange(1, 9), []
        for i in range(1, n + 1):
            if i < n and rng.random() < 0.1:
                lines.append(rare(f"{i}-{i + 1}", f"{i}-{i}", f"{i + 1}-{i}", f"0{i}-{n}", f"{i}-{n + 1}") + "\tab\t_\t_\t_\t" + rare("_", "Typo=Yes", "typo=no") + "\t_\t_\t_\t_")
            head = rare(str(i // 2), str(i), "0", str(n + 1), "01", "", "x", str(pick(range(n + 1))))
            rel = pick(["root" if i == 1 else "dep", "obj", "obj", "nsubj", "nsubj:outer", "conj", "punct", "nummod", "goeswith", "fixed", "obl", "advmod", "det", "case", "flat:foreign", "root", "advcl:x"])
            deps = rare("_", f"{head}:{rel}", f"0:root|{n}:conj", f"{n + 3}:obj", "0", f"{n}.1:obj", "1.1:obj", "00:obj", "1:a:b|")
            feats = rare("_", "VerbForm=Fin", "ExtPos=PROPN", "ExtPos=ADV|ExtPos=PUNCT", "Mood", "a=b", "PronType=Prs", "Typo=Yes", "VerbForm=Fin|VerbForm=Inf", "Number=Plur,Sing")
            cells = [rare(str(i), f"0{i}", str(i + 1), "٣"), pick(["w", "é", "a b"]), pick(["l", "_"]), pick(["NOUN", "PUNCT", "VERB", "PROPN", "PRON", "X", "NUM", "Noun"]), "_", feats, head, rel, deps, rare("_", "Subject=Outer", "Subject=Outer|Subject=x")]
            lines.append("\t".join(cells[: rare(10, 9)] + rare([], ["more"])))
            if rng.random() < 0.1:
                lines += [f"{rare(str(i), '0', str(i + 1))}.{e}\t_\t_\tVERB\t_\t{rare('_', 'A=b=')}\t_\t_\t{rare(f'{i}:conj', '_', '9:x', '0:root')}\t_" for e in range(1, rare(2, 3))]
        comments = pick([[], ["# text = a"], ["# text=", "#text = b"], ["# texts = a", "# x text = y"], ["# text = c"]])
        lines = [*comments, *lines]
        if rng.random() < 0.05:
            lines.insert(rng.randrange(len(lines) + 1), pick(["# late", "", " ", "x", " ", "é"]))
        out.append("\n".join(lines))
    return [*out, "", "# only", "# text = x\n", *(c.raw.replace("{id}", "s") for c in CASES)]


def test_columns_find_what_the_walk_finds(spark):
    raws = odd_sentences(6000)
    df = spark.createDataFrame(list(enumerate(raws)), "n int, raw string").selectExpr("n", "raw", "'en' AS lang").repartition(4)
    seen = Counter()
    for whole, level, options in ((True, 3, {}), (False, 5, {"warnings": False}), (True, 2, {"exclude": ("head-self-loop",)})):
        rows = df if whole else df.selectExpr("n", "CASE WHEN n % 50 = 0 THEN raw ELSE raw || '\n' END AS raw", "lang")
        asked = tuple(sorted(checks.COLUMNAR))
        found = Counter(map(tuple, checks.validate(rows, ("n",), level=level, include=asked, whole=whole, **options).collect()))
        texts = {r.n: r.raw for r in rows.collect()}
        walked = [(n, *f) for n, raw in texts.items() for f in checks.chain(raw + "\n" if whole else raw, "en", level, checks.SAMPLE)]
        kept = lambda f: f[2] == "FACT" or (f[4] in asked and f[4] not in options.get("exclude", ()) and (f[2] != "WARNING" or options.get("warnings", True)))
        due = Counter(f for f in walked if kept(f))
        assert found == due, (list((found - due).items())[:3], list((due - found).items())[:3])
        seen.update(f[4] for f in due)
    assert len(seen) > 20 and seen["head-self-loop"] > 50, seen


def test_plain_sentences_are_not_walked(spark):
    raws = pa.array([r.raw for r in synthetic.blocks(spark, SF).select("raw").collect()])
    gates = columns.Gates(raw=raws, ended=True, feature=lambda v: True)
    assert not gates.odd.any() and 0 < (gates.looped >= 0).sum() < len(raws) and gates.sound.sum() + (gates.looped >= 0).sum() == len(raws)


def test_content_in_the_task_that_makes_the_words(spark):
    keys = ("doc_id", "sent_no")
    of = lambda df: Counter(map(tuple, df.where("doc_id < 40").collect()))
    made = lambda sound: of(synthetic.worked(spark, SF, rules.FIELDS, rules.content_step(keys, sound), keys, rules.FOUND))
    nested = synthetic.nested(spark, SF)
    every, sound = of(rules.content(nested, keys)), of(rules.content(nested.where("not exists(words, w -> w.head = w.id)"), keys))
    assert made(False) == every != sound == made(True) and len(sound) > 1000
    plan = __spark_entry__.queries()["rules_content"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "named_struct" not in plan and "transform(" not in plan


def test_content_takes_missing_and_repeated_cells(spark):
    row = lambda i, head, rel, upos="NOUN", feats="_", deps="_", misc="_": (1, i, head, "_", upos, feats, rel, deps, misc)
    rows = [row(1, 0, "root"), row(2, 1, "orphan"), row(2, 1, "obj"), row(3, 2, "obj"), row(4, 2, "obj", None), row(5, None, "conj"), row(7, 1, "nsubj", misc="Subject=Outer"), row(8, 1, "nsubj", feats=None), row(9, 1, None, deps="0:obj|1:root|3:root:x"), row(None, 1, "punct")]
    df = spark.createDataFrame(rows, "s int, id int, head int, lemma string, upos string, feats string, deprel string, deps string, misc string")
    found = Counter((r.node, r.testid) for r in rules.content(df, ("s",)).collect())
    assert found == Counter({("2", "too-many-objects"): 2, (None, "rel-upos-punct"): 1, ("9", "enhanced-0-is-not-root"): 1, ("9", "enhanced-root-is-not-0"): 2}), found
