"""Versions of documents that meet in one exchange."""

import random

from arborlake.operators import offsets, scorer

DOC = ("doc_id",)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark, raws, seed):
    """Sentences of many documents, in any order over several partitions."""
    rows = [(d, i, raw) for d in range(9) for i, raw in enumerate(raws, 1)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id int, sent_no int, raw string").repartition(3)


def _sides(spark):
    rest = "\t_\tX\t_\t_\t0\troot\t_\t_"
    gold = [f"# sent_id = {k}\n1-2\t{k}b c" + "\t_" * 8 + f"\n1\t{k}b\tl{rest[2:]}\n1.1\te{rest}\n2\tc{rest}\n3\tda{rest}" for k in "xyz"]
    other = [f"1\t{k}bc\tL{rest[2:]}\n2\td{rest}\n3\ta\tA{rest[2:]}" for k in "xyz"]
    return _rows(spark, gold, 1), _rows(spark, other, 2)


def test_lemmas_travel_packed(spark):
    """no window over the cells of all nodes; sentences in any order, ranges, empty nodes and spaces within a token."""
    gold, other = _sides(spark)
    found = offsets.lemmas(gold, other, DOC, "sent_no")
    assert "Window" not in _plan(found) and "Join" not in _plan(found)
    rows = sorted((r.doc_id, r.sent_no, r.id, r.form, r.lemma) for r in found.collect())
    assert rows == sorted((d, i, *x) for d in range(9) for i, k in enumerate("xyz", 1) for x in (("1", f"{k}b", "l"), ("1-2", f"{k}b c", "_"), ("2", "c", "_"), ("3", "da", "_")))
    same = {(r.id, r.lemma) for r in offsets.lemmas(other, other.selectExpr("doc_id", "sent_no", "replace(raw, '\tL\t', '\tM\t') raw"), DOC, "sent_no").collect()}
    assert same == {("1", "M"), ("2", "_"), ("3", "A")}


def test_resegmented_travels_packed(spark):
    """no window over the cells of all nodes; a document whose sides share but some ends, and one that only the target has."""
    gold, other = _sides(spark)
    found = offsets.resegmented(other.where("doc_id < 8"), gold, DOC, "sent_no")
    assert "Window" not in _plan(found) and "Join" not in _plan(found)
    rows = {(r.doc_id, r.number): r.raw for r in found.collect()}
    assert [rows[0, n].split("\n")[:2] for n in (1, 2, 3)] == [[f"# sent_id = {k}", f"# text = {k}b c da"] for k in "xyz"]
    assert [x.split("\t")[0] for x in rows[0, 1].split("\n")[2:]] == ["1-2", "1", "2", "3"] and len(rows) == 8 * 3 + 1
    assert rows[8, 1].split("\n")[1] == "# text = xb c da yb c da zb c da" and rows[8, 1].split("\n")[-1].split("\t")[0] == "9"


def test_scores_travel_packed(spark):
    """F8, F9, F10: no join or window over words; random versions align as offsets.aligned() has it, sentences in any order."""
    rng = random.Random(5)

    def version(text):
        rows, i, at = [], 1, 0
        while at < len(text):
            n = min(rng.randrange(1, 4), len(text) - at)
            form = text[at : at + n]
            words = [rng.choice("abAB") for _ in range(2)] if rng.random() < 0.4 else [form]
            if len(words) > 1:
                rows.append(f"{i}-{i + 1}\t{form}" + "\t_" * 8)
            rows += [f"{i + k}\t{w}\t_\tX\t_\t_\t{0 if i + k == 1 else 1}\tdep\t_\t_" for k, w in enumerate(words)]
            i, at = i + len(words), at + n
        return "\n".join(rows)

    rows = []
    for d in range(25):
        for s in range(3):
            text = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))
            rows.append((d, s, version(text), version(text)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id int, sent_no int, gold string, system string").repartition(3)
    sides = [df.selectExpr("doc_id", "sent_no", f"{x} AS raw") for x in ("gold", "system")]
    scored = scorer.scores(*sides, DOC)
    assert "Window" not in _plan(scored) and "Join" not in _plan(scored)
    words = [scorer.words(offsets.laid_out(x, DOC, "sent_no"), DOC, "sent_no") for x in sides]
    found = {r.metric: r for r in scored.collect()}
    assert found["Words"][1:5] == (words[0].count(), words[1].count(), *[offsets.aligned(*words, DOC).count()] * 2) and "Mismatch" not in found
    assert found["Sentences"].n_correct == 75
