"""Rewritten graphs by batches against the walk over each sentence (findings F6 and F14 of the fourth review)."""

import random

import __spark_entry__
from arborlake.operators import graphs
from arborlake.sources import synthetic
from tests.test_columns import odd_sentences
from tests.test_plain import sound_sentences

SF = "/root/testdata/sf0.001"


def tangled(many: int) -> list[str]:
    """Sentences with random edges, so that many nodes are unreached, in cycles and chains, below empty nodes too."""
    rng = random.Random(4)
    out = []
    for _ in range(many):
        n = rng.choice([1, 2, 5, 12, 25])
        ids = [x for i in range(1, n + 1) for x in (str(i), *([f"{i}.1"] if rng.random() < 0.15 else []))]
        heads = rng.choice([["0", *ids], ids, [x for x in ids if "." not in x]])
        edges = lambda: "|".join(f"{rng.choice(heads)}:{rng.choice(['conj', 'a', 'b:c'])}" for _ in range(rng.choice([1, 1, 2, 3]))) if rng.random() < 0.7 and heads else "_"
        out.append("\n".join(["# c", *("\t".join([i, "w", "w", "X", "_", "_", "_" if "." in i else "0", "_", edges(), "_"]) for i in ids)]))
    chain = lambda ids: "\n".join("\t".join([str(i), *"wwX__0_", f"{h}:a", "_"]) for i, h in ids)
    return [*out, chain([(i, i + 1) for i in range(1, 120)]), chain([(i, i % 90 + 1) for i in range(1, 91)]), "", "# only"]


def test_texts_are_those_of_the_walk(spark):
    raws = [*tangled(3000), *sound_sentences(500), *odd_sentences(1500)]
    ours = []
    for raw in raws:  # what the walk cannot read stops it, as before
        try:
            ours.append((len(ours), raw, graphs.collapsed(raw), graphs.reachable(raw)))
        except (ValueError, IndexError):
            pass
    assert len(ours) > 4500
    df = spark.createDataFrame([(k, raw) for k, raw, *_ in ours], "k int, raw string").repartition(3)
    for step, place in ((graphs.collapsed_sentences, 2), (graphs.reachable_sentences, 3)):
        found = {r.k: r.raw for r in step(df, ("k",)).collect()}
        assert len(found) == len(ours) and not [(x[1], found[x[0]], x[place]) for x in ours if found[x[0]] != x[place]][:1]


def test_graphs_of_the_treebank_are_not_walked(spark, monkeypatch):
    walked = []
    monkeypatch.setattr(graphs, "per_sentence", lambda *a: walked.append(a))
    rows = {(r.doc_id, r.sent_no): r.raw for r in synthetic.blocks(spark, SF).where("doc_id < 40").collect()}
    for name, walk in (("collapsed_sentences", graphs.collapsed), ("reachable_sentences", graphs.reachable)):
        found = {(r.doc_id, r.sent_no): r.raw for r in __spark_entry__.queries()[name](spark, SF).where("doc_id < 40").collect()}
        assert found == {k: walk(raw) for k, raw in rows.items()} and not walked
