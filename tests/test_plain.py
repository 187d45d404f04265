"""All findings and facts of sentences on columns against the walk over each one (findings F1 to F4 of the fourth review)."""

import json
import random
from collections import Counter

import pyarrow as pa

import __spark_entry__
from arborlake.operators import checks, plain
from arborlake.sources import synthetic
from arborlake.sources.cases import CASES
from tests.test_columns import odd_sentences

SF = "/root/testdata/sf0.001"
RELS = ["punct", "punct", "goeswith", "fixed", "flat:foreign", "nsubj", "nsubj:outer", "obj", "conj", "orphan", "det", "advmod", "obl", "nmod", "cop", "case", "dep"]


def sound_sentences(many: int) -> list[str]:
    """Sentences whose backbone and tree are sound, of any shape, with texts, ranges, empty nodes and enhanced graphs that mostly fit."""
    rng = random.Random(5)
    pick, rare = rng.choice, lambda usual, *others: rng.choice(others) if rng.random() < 0.04 else usual
    out = []
    for k in range(many):
        n = pick([1, 2, 3, 5, 8, 13, 30])
        order = rng.sample(range(1, n + 1), n)
        heads = {w: 0 if i == 0 else pick(order[max(0, i - 3) : i]) for i, w in enumerate(order)}
        lines, text, until, graph = [], "", 0, rng.random() < 0.7
        for i in range(1, n + 1):
            rel = rare("root" if heads[i] == 0 else pick(RELS), "root", "Obj", "object")
            form, misc = pick(["w", "élan", "a b", ",", "字"]), pick(["_", "_", "SpaceAfter=No", "Gloss=x|SpaceAfter=No", rare("Ref=a_1.2", "SpaceAfter=Yes", "NoSpaceAfter=Yes", "XSpaceAfter=No", "gloss=x", "=x", "Gloss= a", "Gloss=a|Gloss=b", "Subject=Outer")])
            feats = rare(pick(["_", "Case=Nom", "Foreign=Yes", "ExtPos=ADV", "Poss=Yes", "Typo=Yes", "Polarity=Neg"]), "Case=Nom,Acc", "Number=Sing|Case=Nom", "Case=Nom|Case=Nom", "Case=Nom,Nom", "case=Nom")
            if i > until and i + 1 < n and rng.random() < 0.15:
                until, joint, glued = i + 1, form + "x", rng.random() < 0.4
                lines.append("\t".join([f"{i}-{until}", joint, "_", "_", "_", rare("_", "Typo=Yes", "Case=Nom"), "_", "_", "_", "SpaceAfter=No" if glued else "_"]))
                text += joint + ("" if glued else " ")
            if i <= until:
                misc = rare("_", "SpaceAfter=No")
            else:
                text += form + ("" if "SpaceAfter=No" in misc.split("|") else " ")
            edges = [(heads[i], rel)] + [(pick([h for h in range(n + 1) if h != i]), pick(["conj:and", "ref", rare("obj", "Obj", "none", "root")])) for _ in range(rare(0, 1, 2))]
            deps = "|".join(f"{h}:{d}" for h, d in rare(sorted(edges), edges, edges * 2, [(i, "dep")], [(n // 2 or 1, "orphan")])) if graph and rng.random() < 0.97 else "_"
            lines.append("\t".join([str(i), form, pick(["_", "l"]), rare(pick(["NOUN", "PUNCT", "ADV", "DET", "X", "VERB"]), "Noun"), "_", feats, str(heads[i]), rel, deps, misc]))
            if graph and rng.random() < 0.05:
                lines.append(f"{i}.1\t_\t_\t{rare('VERB', '_', 'V')}\t_\t_\t{rare('_', '1')}\t_\t{rare(f'{i}:conj', f'{i}.1:conj', '0:root', '_', '0:obj')}\t{rare('_', 'SpaceAfter=No')}")
        text = rare(text.rstrip(), text + "x", text + " ", "")
        sent_id = rare(f"# sent_id = s{k}", f"#sent_id=s{k}", "# sent_id = a b", f"# sent_id = ü{k}", "# sent_id = a/b", "# sent_id = a/b/c", "#  sent_id = x\n# sent_id = y", "# note")
        more = [rare("# newpar", "# newdoc id = d", "# newpar id = p é", "# newdoc\n# newdoc", "#newpar"), rare("# text_en = x", "# parallel_id = a/b/alt1", "# parallel_id = A", "#parallel_id = a/b", "# parallel_id = a/b\n# parallel_id = a/c", "# text=x")]
        out.append("\n".join([sent_id, *(x for x in more if rng.random() < 0.5), rare(f"# text = {text}", f"#text = {text}", "# nothing"), *lines]))
    return out


def same(raws: list[str], ended: bool, level: int) -> tuple[Counter, int]:
    """Findings and facts of columns are those of the walk."""
    whole = lambda raw: raw + "\n" if ended else raw
    judged = plain.Plain(pa.array(raws, pa.string()), ended)
    of, made = plain.arrays(*judged.found(level), [pa.int32(), *[pa.string()] * 3, pa.int32(), *[pa.string()] * 2])
    found = Counter(zip(of.to_pylist(), *(m.to_pylist() for m in made)))
    walks = [list(checks.chain(whole(r), "en", level, checks.SAMPLE)) for r in raws]
    due = Counter((i, *f) for i, w in enumerate(walks) if not judged.walked[i] for f in w)
    assert found == due, (list((found - due).items())[:3], list((due - found).items())[:3])
    at, columns = plain.Plain(pa.array(raws, pa.string()), ended, set()).facts()
    facts = dict(zip(at.tolist(), zip(*(c.to_pylist() for c in columns))))
    assert facts == {i: checks.facts_of(whole(r)) for i, r in enumerate(raws) if not judged.odd[i] and any(f.type == "FACT" for f in walks[i])}
    return Counter(f[4] for f in due), int(judged.walked.sum())


def test_columns_find_all_that_the_walk_finds():
    raws = sound_sentences(3000)
    seen, walked = same(raws, True, 3)
    assert walked < 0.3 * len(raws) and min(seen[t] for t in ("text-form-mismatch", "unconnected-egraph", "punct-causes-nonproj", "punct-is-nonproj", "fixed-gap", "goeswith-gap", "goeswith-nospace", "leaf-goeswith", "unsorted-deps", "repeated-misc", "orphan-parent")) > 5, seen
    seen += same([*odd_sentences(2000), *(c.raw.replace("{id}", "s") for c in CASES)], True, 3)[0]
    seen += same([r + "\n" * (k % 9 > 0) for k, r in enumerate(raws[:500])], False, 2)[0]
    assert len(seen) > 70, len(seen)
    same([], True, 3)


def test_long_sentences_and_cut_pairs(monkeypatch):
    monkeypatch.setattr(plain, "PAIRS", 7)
    same(sound_sentences(150), True, 3)
    line = lambda i, head: f"{i}\tw\tw\tNOUN\t_\t_\t{head}\t{'root' if not head else 'punct' if i % 7 else 'goeswith'}\t{head}:{'dep' if head else 'root'}\t_"
    chain = ["# sent_id = a", *(line(i, i - 1) for i in range(1, 200))]
    back = ["# sent_id = b", *(line(i, (i + 1) % 201) for i in range(1, 201))]
    same(["\n".join(chain), "\n".join(back)], True, 3)


def test_sentences_of_the_treebank_are_not_walked(spark):
    raws = [r.raw for r in synthetic.blocks(spark, SF).select("raw").collect()]
    judged = plain.Plain(pa.array(raws), True)
    assert judged.walked.sum() < 0.01 * len(raws) and judged.sound.sum() > 0.5 * len(raws)
    same(raws[:400], True, 3)


def test_summary_of_all_incidents_is_that_of_the_walk(spark, monkeypatch):
    rows = synthetic.blocks(spark, SF).select("lang", "raw").collect()
    due = Counter((r.lang, f.type, f.testclass, f.testid) for r in rows for f in checks.chain(r.raw + "\n", r.lang, 3, checks.SAMPLE) if f.type != "FACT")
    many = []
    monkeypatch.setattr(checks, "per_sentence", lambda *a: many.append(a))
    found = {tuple(r)[:4]: r.n for r in __spark_entry__.queries()["incident_summary"](spark, SF).collect()}
    assert found == due and not many


def test_facts_of_the_treebank_are_not_walked(spark, monkeypatch):
    keys = ("doc_id", "sent_no")
    rows = synthetic.blocks(spark, SF).where("doc_id < 60")
    due = {(r.doc_id, r.sent_no): checks.facts_of(r.raw) for r in rows.collect() if any(f.type == "FACT" for f in checks.chain(r.raw + "\n", "ud", 2, {}))}
    many = []
    monkeypatch.setattr(checks, "per_sentence", lambda *a: many.append(a))
    found = {tuple(r)[:2]: tuple(r)[2:] for r in checks.passing(rows, keys).collect()}
    assert found == due and len(due) > 100 and not many


def test_json_of_all_incidents_is_that_of_the_walk(spark, monkeypatch):
    rows = synthetic.blocks(spark, SF).collect()
    due = Counter((r.doc_id, r.sent_no, *map(str, f)) for r in rows for f in checks.chain(r.raw + "\n", r.lang, 2, checks.SAMPLE) if f.type != "FACT")
    many = []
    monkeypatch.setattr(checks, "per_sentence", lambda *a: many.append(a))
    names = ("level", "type", "testclass", "testid", "line", "node", "message")
    found = Counter((int(x["doc_id"]), int(x["sent_no"]), *(x[c] for c in names)) for r in __spark_entry__.queries()["incidents_json"](spark, SF).collect() for x in [json.loads(r.json)])
    assert found == due and not many
