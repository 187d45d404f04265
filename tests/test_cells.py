"""Rules over batches against the expressions on one sentence's nodes."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__
from arborlake.operators import graphs, rewrites
from arborlake.sources import cells, conllu

TAGS = {("A", "_"): " a  b ", ("B", "x=y"): " "}


def odd(spark):
    """Sentences with short and long lines, ranges, empty nodes, comments in between, odd edges and spaces."""
    rng = random.Random(26)
    edge = lambda: f"{rng.choice(['0', '1', '2', '10', '2.1', '2.10', '03'])}:{rng.choice(['root', 'obj', 'conj:and', 'Ä', 'a:b:c'])}"
    rows = []
    for i in range(400):
        lines = []
        for n in range(1, rng.randrange(2, 9)):
            deps = rng.choice(["_", edge(), "|".join(edge() for _ in range(rng.randrange(1, 6)))])
            cell = [rng.choice([str(n), f"{n}-{n + 1}", f"{n}.1"]), rng.choice(["a b", "c \u0085d", "é", ""]), "l", rng.choice("AB"), rng.choice(["_", "x"]), rng.choice(["_", "x=y"]), rng.choice(["0", "1", "2"]), rng.choice(["root", "obj"]), deps, "_"]
            lines.append("\t".join(cell[: rng.choice([10, 10, 10, 10, 4])] + ["more"] * (rng.random() < 0.1)))
            lines += rng.choice([[], [], ["# late"], ["", "x"], ["٣\tno digit here"]])
        rows.append((i, rng.choice(["# c\n", ""]) + "\n".join(lines)))
    return spark.createDataFrame([*rows, (900, ""), (901, None), (902, "# only")], "k long, raw string").repartition(3)


def same(found, expected):
    key = lambda r: [(x is not None, x) for x in r]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, expected.collect()), key=key)


def fast(spark, query):
    """The query's own plan reads lines by batches, not as arrays of structs."""
    plan = __spark_entry__.queries()[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "named_struct" not in plan and "lambda" not in plan.lower().split("mapinarrow")[0]


def test_lines_of_the_older_format(spark):
    t = odd(spark)
    same(rewrites.conllx_lines(t, ("k",)), conllu.parsed(t).select("k", F.explode(rewrites.conllx(F.col("nodes"))).alias("line")))
    fast(spark, "conllx_lines")


def test_basic_edges_among_the_enhanced(spark):
    t = odd(spark)
    same(rewrites.enhanced_words(t, ("k",)), conllu.parsed(t).select("k", F.explode(rewrites.basic_to_enhanced(F.col("nodes"))).alias("n")).where("n.kind = 'word'").select("k", "n.id", "n.deps"))
    fast(spark, "basic_to_enhanced")


def test_edges_in_order(spark):
    t = odd(spark).where("raw is not null")
    same(rewrites.fixed_deps(t, ("k",)), rewrites.applied(conllu.parsed(t), rewrites.sorted_deps).select("k", "raw"))
    same(rewrites.fixed_deps_of_words(t, ("k",)), cells.table(rewrites.fixed_deps(t, ("k",)), ("k",), "id", "deps"))
    fast(spark, "fixed_deps")


def test_cells_of_words(spark):
    t = odd(spark)
    same(cells.table(t, ("k",), "id", "deps"), conllu.nodes_table(t, "k").where("kind = 'word'").select("k", "id", "deps"))
    fast(spark, "fixed_deps_by_word")


def test_tags_by_table(spark):
    t = odd(spark)
    same(rewrites.xpos_of_words(t, ("k",), TAGS), conllu.parsed(t).select("k", F.explode(rewrites.tags_to_xpos(F.col("nodes"), TAGS)).alias("n")).where("n.kind = 'word'").select("k", "n.id", "n.xpos"))
    fast(spark, "tags_to_xpos")


def graphs_of(spark):
    """Enhanced graphs with relations that give reasons, empty nodes, and some odd sentences."""
    rng = random.Random(15)
    rels = ["conj", "conj:and", "ref", "acl", "acl:relcl", "nsubj", "obj", "xcomp", "csubj:x", "orphan", "a>b", "root"]
    rows = []
    for i in range(600):
        n, strange = rng.randrange(1, 8), rng.random() < 0.2
        ids = [x for k in range(1, n + 1) for x in ([f"{k}-{k + 1}"] if rng.random() < 0.1 else []) + [str(k)] + ([f"{k}.1"] if rng.random() < 0.2 else [])]
        heads = ["0", *(x for x in ids if "-" not in x)]
        lines = []
        for x in ids:
            head, rel = rng.choice(["_", *map(str, range(n + 1))]), rng.choice(rels)
            edges = list(dict.fromkeys(rng.choice([f"{head if head != '_' else 0}:{rel}", f"{rng.choice(heads)}:{rng.choice(rels)}"]) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))))
            if strange:
                edges += rng.choice([[], edges[:1], [f"0{rng.randrange(1, n + 1)}:obj"]])
                x = rng.choice([x, x, ids[0]])
            lines.append("\t".join([x, "f", "l", "U", "_", "_", head, rel, "|".join(edges) or "_", "_"]))
        rows.append((i, "\n".join(["# c", *lines, *rng.choice([[], [], [], ["٣" + lines[-1][1:]]])])))
    return spark.createDataFrame([*rows, (900, "# only")], "k long, raw string").repartition(3)


def walked(t, step):
    return [(r.k, *x) for r in t.collect() for x in step(r.raw)]


def test_edges_counted_by_batches_are_those_of_the_walk(spark):
    t = graphs_of(spark)
    found = sorted(map(tuple, graphs.counts(t, ("k",)).collect()))
    assert found == sorted(walked(t, lambda raw: [tuple(graphs.properties_of(raw)[c] for c in graphs.COUNTS)]))
    fast(spark, "edge_compare")


def test_types_by_batches_are_those_of_the_walk(spark):
    t = graphs_of(spark)
    assert sorted(map(tuple, graphs.classified(t, ("k",)).collect())) == sorted(walked(t, graphs.edge_types))


def test_edges_past_empty_nodes_are_those_of_the_walk(spark):
    t = graphs_of(spark)
    assert sorted(map(tuple, graphs.direct_edges(t, ("k",)).collect())) == sorted(walked(t, lambda raw: [(str(c[0]), str(p[0]), d) for p, c, d in graphs.collapsed_edges(raw)]))


def test_graphs_that_batches_read_are_not_walked(spark, monkeypatch):
    """Where each sentence was walked before, one of a tree with plain edges is not."""
    monkeypatch.setattr(graphs, "Graph", None)
    raw = pa.array(["\n".join("\t".join([str(n), *"fluxy", str(n // 2), "obj", f"{n // 2}:obj", "_"]) for n in range(1, 9))])
    e = graphs.Edges(raw)
    assert not e.odd.any() and e.of_basic()[0].all() and len(e.node) == 8


def test_only_texts_without_a_space_at_their_end_meet_the_paragraphs(spark):
    rng = random.Random(20)
    rows = []
    for i in range(500):
        ids = [x for k in range(1, rng.randrange(1, 6)) for x in ([f"{k}-{k + rng.randrange(2)}"] if rng.random() < 0.3 else []) + [str(k)] + ([f"{k}.1"] if rng.random() < 0.3 else [])]
        lines = ["\t".join([x, *"fluxfh_d", rng.choice(["_", "SpaceAfter=No", "A=b|SpaceAfter=No", "SpaceAfter=Not"])][: rng.choice([10, 10, 10, 9])]) for x in ids]
        rows.append((i % 3, i, "\n".join([rng.choice(["# newpar", "#newdoc id = x", "# newparx", "# text = newpar", "# c"]), *lines, *rng.choice([[], ["# late", ""]])])))
    expected = []
    for d, i, raw in rows:
        lines = raw.split("\n")
        surface = [x for x in lines if re.match(r"[0-9]+(-[0-9]+)?\t", x)]
        number = lambda x: int(x.split("\t")[0].split("-")[-1])
        token = next((x for x in reversed(surface) if "-" in x.split("\t")[0] and number(x) >= number(surface[-1])), surface[-1] if surface else "")
        c, after = token.split("\t"), next((r for e, n, r in rows if e == d and n > i), "")
        change = len(c) == 10 and "SpaceAfter=No" in c[9].split("|") and re.search(r"(?m)^#\s*new(doc|par)(\s|$)", after) is not None
        new = "\t".join([*c[:9], "|".join(x for x in c[9].split("|") if x != "SpaceAfter=No") or "_"]) if change else ""
        expected.append((d, i, "\n".join(new if change and x == token else x for x in lines), change))
    made = rewrites.spaced_before_paragraphs(spark.createDataFrame(rows, "d long, i long, raw string").repartition(4), ("d", "i"), "d")
    assert sorted(map(tuple, made.collect())) == sorted(expected)
    assert any(x[3] for x in expected)
    changed = made.where("changed")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in changed and "LeftOuter" not in changed  # the other texts do not move


def test_tags_are_merged_without_a_tree(monkeypatch):
    monkeypatch.setattr(rewrites, "Tree", None)
    line = lambda i, form, xpos: "\t".join([i, form, "l", "U", xpos, *"_____"])
    source = "\n".join([line("1-2", "ab", "R"), line("1", "a", "A"), line("2", "b", "B"), line("2.1", "e", "E"), line("3", "c", "C")])
    target = "\n".join([line("1-2", "ab", "x"), "# late", line("1", "a", "x"), "dropped", line("2", "bc", "x"), line("2.1", "e", "x")])
    assert rewrites.merged_tags(source, target) == "\n".join(["# late", line("1-2", "ab", "R"), line("1", "a", "A"), line("2", "bc", "x"), line("2.1", "e", "E")])
    assert rewrites.merged_tags(source, target + "\n" + line("3", "d", "x")) == target + "\n" + line("3", "d", "x")
