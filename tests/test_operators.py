"""Checks on planted sentences, and walks over graphs and alignments against brute force."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arborlake.functions import pairs, shorten, version
from arborlake.operators import checks, coreference, graphs, offsets, release, render, rewrites, scorer, verses
from arborlake.operators.sentence import Tree
from arborlake.sources import conllu
from arborlake.sources.cases import BASE, CASES, WARNINGS
from arborlake.sources.registry import SAMPLE


@pytest.mark.parametrize("case", CASES, ids=lambda c: " ".join(c.found) or "valid")
def test_planted_defect_is_found_and_nothing_else(case):
    level = 5 if case.level > 3 else 3
    found = [f for f in checks.chain(case.raw.replace("{id}", "s1") + "\n", "en" if level > 3 else "ud", level, SAMPLE) if f.type != "FACT"]
    assert Counter(f.testid for f in found) == Counter(case.found)
    assert all((f.type == "WARNING") == (f.testid in WARNINGS) for f in found)


def test_missing_last_line_and_filters(spark):
    assert [f.testid for f in checks.chain("\n".join(BASE), "ud", 1, {})] == ["missing-empty-line"]
    rows = spark.createDataFrame([(1, "en", CASES[0].raw.replace("{id}", "a")), (2, "en", "\n".join(BASE))], "n int, lang string, raw string")
    found = lambda **o: sorted(r.testid for r in checks.incidents(checks.validate(rows, ("n", "lang"), **o)).collect())
    assert found() == ["missing-sent-id", "missing-text"] and found(include=("missing-text",)) == ["missing-text"] and found(exclude=("missing-text",)) == ["missing-sent-id"]


def test_user_check_runs():
    checks.register("no-book", 3, lambda s: [checks.error(3, "SYNTAX", "no-book", n) for n in s.nodes if n.form == "book"])
    try:
        assert "no-book" in [f.testid for f in checks.chain("\n".join(BASE) + "\n", "ud", 3, {}, checks.EXTRA.values())]
    finally:
        checks.EXTRA.clear()


def test_findings_between_sentences(spark):
    def block(n, *comments, misc="_", deps="_"):
        return (n, "en", "f", "\n".join([f"# sent_id = {'a' if n in (1, 3) else n}", *comments, f"1\tx\tx\tNOUN\t_\t_\t0\troot\t{deps}\t{misc}"]))

    rows = [block(1, "# parallel_id = up/1/alt1", misc="SpaceAfter=No"), block(2, "# newpar", "# parallel_id = up/1/alt3"), block(3, deps="0:root"), block(4, "# parallel_id = up/1/alt3")]
    df = spark.createDataFrame(rows, "n int, lang string, file string, raw string")
    keys = ("n", "lang", "file")
    found = {(r.n, r.testid) for r in checks.across(checks.facts(df, keys), keys, "lang", "file").collect()}
    assert found == {(3, "non-unique-sent-id"), (2, "spaceafter-newdocpar"), (3, "edeps-only-sometimes"), (2, "parallel-id-alt"), (4, "non-unique-parallel-id"), (4, "edeps-identical-to-basic-trees")}


def test_reader_splits_at_blank_and_white_lines(spark, tmp_path):
    valid = CASES[0].raw.replace("{id}", "a")
    (tmp_path / "xx_y-ud-dev.conllu").write_text(f"{valid}\n\n{valid}\n  \n{valid}\n\n")
    rows = conllu.blocks(spark, str(tmp_path)).orderBy("sent_no").collect()
    assert [r.raw.split("\n")[0] for r in rows] == ["# sent_id = a"] * 3 and {r.portion for r in rows} == {"dev"}
    assert rows[1].raw.endswith("\n  ")
    trees = conllu.parsed(spark.createDataFrame([(valid,)], "raw string"))
    assert trees.select(conllu.rendered(F.col("comments"), F.col("nodes"))).first()[0] == valid
    tidy = trees.select(conllu.rendered(F.col("comments"), conllu.ordered(F.reverse("nodes")))).first()[0]
    assert tidy == valid
    conllu.write(trees.coalesce(1), str(tmp_path / "out"))
    assert conllu.blocks(spark, str(tmp_path / "out")).first().raw == valid


def test_functions(spark):
    row = spark.range(1).select(pairs(F.lit("A=b|C|D=e=f")).alias("p"), shorten(F.lit("x" * 30)).alias("s"), (version(F.lit("2.10")) > version(F.lit("2.9"))).alias("v")).first()
    assert [tuple(x) for x in row.p] == [("A", "b"), ("C", None), ("D", "e=f")] and row.s == "x" * 20 + "[...]" and row.v


def random_graph(rng, n=6):
    lines = []
    for i in range(1, n + 1):
        deps = sorted({(rng.randrange(0, n + 1), rng.choice(["nsubj", "conj", "obj", "ref", "acl:relcl", "xcomp"])) for _ in range(rng.randrange(0, 3))})
        lines.append(f"{i}\tw\tw\tX\t_\t_\t{rng.randrange(0, n + 1)}\tdep\t{'|'.join(f'{h}:{d}' for h, d in deps if h != i) or '_'}\t_")
    return "\n".join(lines)


def test_walks_equal_closures():
    rng = random.Random(3)
    for _ in range(200):
        raw = random_graph(rng)
        g = graphs.Graph(raw)
        edges = {(h[0], c[0]) for c in g.nodes for h, _ in g.into[c]}
        closure = set(edges)
        for k, a, b in itertools.product(range(7), repeat=3):
            if (a, k) in closure and (k, b) in closure:
                closure.add((a, b))
        closure = {(a, b) for a, b in closure} | set()
        while True:
            more = {(a, d) for a, b in closure for c, d in edges if b == c} - closure
            if not more:
                break
            closure |= more
        assert g.cyclic() == any(a == b for a, b in closure)
        assert all(g.path((a, 0), (b, 0)) == ((a, b) in closure or a == b) for a in range(1, 7) for b in range(1, 7))
        reach = graphs.Graph(graphs.reachable(raw))
        assert checks.reached((0, 0), lambda i: [c for c, _ in reach.out[i]]) >= set(reach.nodes)
        tree = Tree(graphs.acyclic(raw))
        assert checks.reached(tree.root, lambda n: n.children) == set(tree.words)


def test_projectivity_equals_definition():
    rng = random.Random(5)
    for _ in range(100):
        n = 7
        heads = [0] + [rng.randrange(0, i) for i in range(1, n + 1)]
        order = list(range(1, n + 1))
        rng.shuffle(order)
        name = {old: new for new, old in enumerate(order, 1)} | {0: 0}
        rows = sorted((name[i], name[heads[i]]) for i in range(1, n + 1))
        raw = "\n".join(f"{i}\tw\tw\tX\t_\t_\t{h}\tdep\t_\t_" for i, h in rows)
        parent = dict(rows)

        def above(i, parent=parent):
            return {i, *above(parent[i])} if i else {0}

        expected = sum(any(h not in above(k) for k in range(min(i, h) + 1, max(i, h))) for i, h in rows)
        assert graphs.shape_of(raw)[2] == expected


def test_edge_types_and_collapsing():
    raw = "\n".join([
        "1\tA\ta\tNOUN\t_\t_\t2\tnsubj\t2:nsubj|3:nsubj:xsubj\t_", "2\twants\twant\tVERB\t_\t_\t0\troot\t0:root\t_", "3\tgo\tgo\tVERB\t_\t_\t2\txcomp\t2:xcomp\t_",
        "3.1\tgo\tgo\tVERB\t_\t_\t_\t_\t3:conj\t_", "4\tB\tb\tNOUN\t_\t_\t3\torphan\t3.1:obj\t_", "5\tin\tin\tADP\t_\t_\t4\tcase\t4:case:in\t_",
    ])
    found = {(c, p): t for c, p, _, t in graphs.edge_types(raw)}
    assert found == {("1", "2"): "B", ("1", "3"): "X", ("2", "0"): "B", ("3", "2"): "B", ("3.1", "3"): "G", ("4", "3.1"): "G", ("4", "3"): "O", ("5", "4"): "C"}
    assert ((3, 0), (4, 0), "conj>obj") in graphs.collapsed_edges(raw) and "3.1" not in graphs.collapsed(raw)
    assert "Edep=O:3:orphan|Edep=G:3.1:obj" in graphs.annotated(raw)


def test_common_sequence_is_longest():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(0, 7))] for _ in range(2))
        found = offsets.longest(a, b)
        best = max(k for k in range(len(a) + 1) for x in itertools.combinations(a, k) if x in set(itertools.combinations(b, k)))
        assert len(found) == best and all(a[i] == b[j] for i, j in found) and found == sorted(found) and len({i for i, _ in found}) == len({j for _, j in found}) == best


def test_scores_by_hand(spark):
    gold = "1-2\tdel\t_\t_\t_\t_\t_\t_\t_\t_\n1\tde\tde\tADP\t_\t_\t3\tcase\t3:case\t_\n2\tel\tel\tDET\t_\t_\t3\tdet\t3:det\t_\n3\trio\trio\tNOUN\t_\tNumber=Sing\t0\troot\t0:root\t_"
    other = "1\tdel\tdel\tADP\t_\t_\t2\tcase\t2:case\t_\n2\trio\trio\tNOUN\t_\tNumber=Sing\t0\troot\t0:root\t_"
    df = lambda *raws: spark.createDataFrame([(d, 1, raw) for d, raw in enumerate(raws)], "doc_id int, sent_no int, raw string")
    scored = lambda a, b, **o: {r.metric: r for r in scorer.scores(a, b, ("doc_id",), **o).collect()}
    same = scored(df(gold), df(gold))
    assert set(same) == set(scorer.METRICS) and all(same[m].n_gold == same[m].n_system == same[m].n_correct > 0 for m in scorer.METRICS)
    rows = scored(df(gold), df(other))
    found = {m: (r.n_gold, r.n_system, r.n_correct, r.n_aligned) for m, r in rows.items()}
    assert found["Tokens"] == (2, 2, 2, 0) and found["Words"] == (3, 2, 1, 1) and found["LAS"] == (3, 2, 1, 1) and found["MLAS"] == (1, 1, 0, 1) and found["ELAS"][:3] == (3, 2, 1)
    assert (rows["Words"].precision, rows["Words"].recall, rows["Words"].f1) == (0.5, 0.333333, 0.4)
    apart = scored(df(gold, gold), df(other.replace("rio", "mar"), gold))
    assert apart["Mismatch"].n_gold == 1 and apart["Words"].n_gold == 3
    once = spark.createDataFrame(list(rows.values()))
    table = lambda **o: [r.line for r in scorer.table(once, **o).orderBy("place").collect()]
    assert len(table()) == 15 and len(table(enhanced=True)) == 17 and table()[4].split() == ["Words", "|", "50.00", "|", "33.33", "|", "40.00", "|", "100.00"]
    assert table(counts=True)[4].split() == ["Words", "|", "1", "|", "3", "|", "2", "|", "1"] and len(table(verbose=False)) == 3
    empty = gold + "\n3.1\te\te\tVERB\t_\t_\t_\t_\t3:conj\t_\n4\tx\tx\tX\t_\t_\t3\tdep\t3.1:obj\t_"
    assert (4, 3, "conj>obj") in scorer.paths(empty) and (4, 3, "dep") in scorer.paths(empty, True)


def test_alignment_equals_its_definition(spark):
    """Random versions of a text: islands of ranges that overlap, a longest common sequence in each, equal places elsewhere."""
    rng = random.Random(2)

    def version(text):
        """A sentence's tokens: (start, end, words, in a range)."""
        out, at = [], 0
        while at < len(text):
            n = min(rng.randrange(1, 4), len(text) - at)
            kind = rng.random() < 0.4
            out.append((at, at + n, [rng.choice("abAB") for _ in range(rng.randrange(2, 4))] if kind else [text[at : at + n]], kind))
            at += n
        return out

    def raw(tokens):
        rows, i = [], 1
        for a, b, ws, kind in tokens:
            if kind:
                rows.append(f"{i}-{i + len(ws) - 1}\t{'x' * (b - a)}" + "\t_" * 8)
            rows += [f"{i + k}\t{w}\t_\tX\t_\t_\t{0 if i + k == 1 else 1}\tdep\t_\t_" for k, w in enumerate(ws)]
            i += len(ws)
        return "\n".join(rows)

    def plain(g, s):
        spread = lambda side: [(a, b, w.lower(), kind) for a, b, ws, kind in side for w in ws]
        gw, sw = spread(g), spread(s)
        spans = sorted({x[:2] for x in gw + sw if x[3]})
        land = []
        for a, b in spans:
            if land and a < land[-1][1]:
                land[-1][1] = max(land[-1][1], b)
            else:
                land.append([a, b])
        island = lambda x: next((tuple(i) for i in land if i[0] <= x[0] and x[1] <= i[1]), None)
        pairs = {(i, j) for i, x in enumerate(gw) for j, y in enumerate(sw) if island(x) is None and island(y) is None and x[:2] == y[:2]}
        for i in {tuple(x) for x in land}:
            a, b = ([k for k, x in enumerate(side) if island(x) == i] for side in (gw, sw))
            pairs |= {(a[p], b[q]) for p, q in offsets.longest([gw[k][2] for k in a], [sw[k][2] for k in b])}
        return {(i + 1, j + 1) for i, j in pairs}

    cases = []
    for _ in range(60):
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))
        cases.append((version(text), version(text)))
    df = lambda side: spark.createDataFrame([(d, 1, raw(c[side])) for d, c in enumerate(cases)], "doc_id int, sent_no int, raw string")
    sides = [scorer.words(offsets.laid_out(df(k), ("doc_id",), "sent_no"), ("doc_id",), "sent_no") for k in (0, 1)]
    found = {}
    for r in offsets.aligned(*sides, ("doc_id",)).collect():
        found.setdefault(r.doc_id, set()).add((r.g["id"], r.s["id"]))
    assert found == {d: p for d, c in enumerate(cases) if (p := plain(*c))}


def test_versions_meet_by_offsets(spark):
    doc = ("doc_id",)
    df = lambda *raws: spark.createDataFrame([(1, i, raw) for i, raw in enumerate(raws, 1)], "doc_id int, sent_no int, raw string")
    gold = "# sent_id = s\n1-2\tdel\t_\t_\t_\t_\t_\t_\t_\t_\n1\tde\tde\tADP\t_\t_\t3\tcase\t_\t_\n2\tel\tel\tDET\t_\t_\t3\tdet\t_\t_\n3\trio\trio\tNOUN\tn\t_\t0\troot\t_\t_"
    other = "1\tdel\tDEL\tADP\tp\t_\t2\tcase\t_\t_\n2\trio\tRIO\tNOUN\tN\t_\t0\troot\t_\t_"
    assert sorted((r.id, r.lemma) for r in offsets.lemmas(df(gold), df(other), doc, "sent_no").collect()) == [("1", "de"), ("1-2", "_"), ("2", "el"), ("3", "RIO")]
    first, second = "# sent_id = a\n1\tdel\t_\tX\t_\t_\t0\troot\t_\t_", "# sent_id = b\n1-2\trio\t_\t_\t_\t_\t_\t_\t_\tSpaceAfter=No\n1\tri\t_\tX\t_\t_\t0\troot\t_\t_\n2\to\t_\tX\t_\t_\t1\tdep\t_\t_\n3\t.\t_\tPUNCT\t_\t_\t1\tpunct\t_\t_"
    whole = offsets.resegmented(df("1\tdelrio\t_\tX\t_\t_\t0\troot\t_\t_", "1\t.\t_\tX\t_\t_\t0\troot\t_\t_"), df(first, second), doc, "sent_no").orderBy("number").collect()
    assert [r.raw.split("\n")[:2] for r in whole] == [["# sent_id = a", "# text = del rio"], ["# sent_id = b", "# text = ."]] and [x.split("\t")[0] for x in whole[0].raw.split("\n")[2:]] == ["1", "2-3", "2", "3"]
    again = offsets.resegmented(df("1\tdel\t_\tX\t_\t_\t0\troot\t_\t_", "1\trio.\t_\tX\t_\t_\t0\troot\t_\t_"), df(whole[0].raw, whole[1].raw), doc, "sent_no").orderBy("number").collect()
    assert [r.raw.split("\n")[0] for r in again] == ["# sent_id = a", "# sent_id = aB"]
    assert [r.doc_id for r in offsets.different(*(offsets.laid_out(df(x), doc, "sent_no") for x in (gold, other.replace("rio", "mar"))), doc).collect()] == [1]


def test_rewrites_of_versions():
    gold = "# sent_id = s\n1-2\tdel\t_\t_\t_\t_\t_\t_\t_\t_\n1\tde\tde\tADP\t_\t_\t3\tcase\t_\t_\n2\tel\tel\tDET\t_\t_\t3\tdet\t_\t_\n3\trio\trio\tNOUN\tn\t_\t0\troot\t_\t_"
    other = "1\tdel\tDEL\tADP\tp\t_\t2\tcase\t_\t_\n2\trio\tRIO\tNOUN\tN\t_\t0\troot\t_\t_"
    again = rewrites.retokenized(gold, other).split("\n")
    assert [x.split("\t")[0] for x in again] == ["1-2", "1", "2", "3"] and again[1].split("\t")[2:5] == ["DEL", "ADP", "p"]
    assert rewrites.copied(other, other.replace("RIO", "x"), ("lemma",)) == other
    assert rewrites.merged_tags(other, other.replace("\tN\t", "\t_\t")) == other
    assert rewrites.restored("1\tD\td\tX\tX\t_\t0\troot\t_\t_\n2\tE\te\tX\tX\t_\t1\tdep\t_\t_\n3\tF\tf\tX\tX\t_\t1\tdep\t_\t_", gold).split("\n")[2].startswith("1\tde\td\tX")
    assert rewrites.wrapped(["aa bb cc"], 5) == "aa bb\ncc" and rewrites.wrapped(["中文abc字"], 3, True) == "中文\nabc\n字"


def test_document_text_by_expressions_equals_the_walk(spark):
    rng = random.Random(4)
    line = lambda i, form, misc: "\t".join((str(i), form, *"_______", misc))
    rows, due = [], {}
    for doc in range(25):
        texts = [""]
        for sent in range(rng.randrange(1, 9)):
            mark = rng.choice(["# newpar", "# newdoc id = a", "# text = x", "# newparty = 1", "#newpar"])
            made, n = [mark], rng.randrange(0, 20)
            if sent and mark in ("# newpar", "# newdoc id = a", "#newpar"):
                texts.append("")
            i = 1
            while i <= n:
                form, misc = rng.choice(["a", "word", "ünï", "x" * 90, "𝒳𝒴", "to be"]), rng.choice(["_", "_", "SpaceAfter=No", "Gloss=1|SpaceAfter=No"])
                wide = rng.random() < 0.2 and i < n
                made += [line(f"{i}-{i + 1}", form, misc), line(i, "p", "_"), line(i + 1, "q", "_")] if wide else [line(i, form, misc)]
                made += [line(f"{i}.1", "hidden", "_")] if rng.random() < 0.1 and not wide else []
                texts[-1] += form + ("" if "SpaceAfter=No" in misc else " ")
                i += 2 if wide else 1
            rows.append((doc, sent, "\n".join(made)))
        due[doc] = texts
    df = spark.createDataFrame(rows, "doc int, sent int, raw string").repartition(3)
    assert {r.doc: r.text for r in rewrites.document_text(df, ("doc",), "sent").collect()} == {k: rewrites.wrapped([p.strip() for p in v]) for k, v in due.items()}
    parts = sorted((r.doc, r.paragraph, r.line, r.text) for r in rewrites.document_lines(df, ("doc",), "sent", 30).collect())
    assert parts == [(k, n, m, x) for k, v in sorted(due.items()) for n, p in enumerate(v, 1) for m, x in enumerate(filter(None, rewrites.wrapped([p.strip()], 30).split("\n")), 1)]
    assert rewrites.document_text(df, ("doc",), "sent", "zh").count() == 25


@pytest.mark.parametrize("case", [c for c in CASES if 2 <= c.level <= 2], ids=lambda c: " ".join(c.found))
def test_quick_fix_leaves_no_format_error(case):
    raw = rewrites.quick_fixed(case.raw.replace("{id}", "s1"), connect=True)
    left = {f.testid for f in checks.chain(raw + "\n", "ud", 2, {}) if f.type == "ERROR" and f.testclass != "METADATA"}
    assert left <= {"unknown-head", "unknown-ehead", "head-self-loop", "non-tree", "repeated-feature", "repeated-feature-value", "repeated-misc", "unsorted-deps", "invalid-edeprel", "invalid-deps", "invalid-ehead"}


def test_entities(spark):
    head = "# global.Entity = eid-etype-head"
    line = lambda i, misc: f"{i}\tw\tw\tX\t_\t_\t0\troot\t_\t{misc}"
    found = lambda *lines: [f.testid for f, _ in coreference.brackets("\n".join(lines), "eid-etype-head") if f]
    assert found(head, line(1, "Entity=(e1-person-1"), line(2, "Entity=(e2-place-1)e1)")) == []
    assert found(head, line(1, "Entity=(e1-person-1)")) == []
    assert found(head, line(1, "Entity=(e1-person-1")) == ["cross-sentence-mention"]
    assert found(head, line(1, "Entity=e1)")) == ["ill-nested-entities"]
    assert found(head, line(1, "Entity=(e1-robot-1)")) == ["spurious-entity-type"]
    assert found(head, line(1, "Entity=(e1-person-3)")) == ["mention-head-out-of-range"]
    assert found(head, line(1, "Bridge=e1<e2")) == ["bridge-without-entity"]
    assert found(head, line(1, "Entity=(e1-person-1)|SplitAnte=e2<e1")) == ["only-one-split-antecedent"]
    assert found(head, line(1, "Entity=(e1[1/2]-person-1)"), line(2, "_"), line(3, "Entity=(e1[2/2]-person-1)")) == []
    assert found(head, line(1, "Entity=(e1[2/2]-person-1)")) == ["misplaced-mention-part"]
    rows = [(1, "t", "d1", f"{head}\n{line(1, 'Entity=(e1-person-1)')}"), (2, "t", "d2", line(1, "Entity=(e1-place-1)"))]
    df = spark.createDataFrame(rows, "n int, tb string, doc string, raw string")
    keys = ("n", "tb", "doc")
    assert {(r.n, r.testid) for r in coreference.across(coreference.found(df, keys, "tb"), keys, "tb", "doc").collect()} == {(2, "entity-type-mismatch"), (2, "entity-across-newdoc")}


def test_release_checks(spark):
    text = "# Summary\n\nA treebank of *invented* prose for tests of all kinds, [linked](x).\n\n# Changelog\n\nData available since: UD v2.1\nLicense: CC BY 4.0\nIncludes text: yes\nGenre: news\nLemmas: automatic\nUPOS: automatic\nXPOS: automatic\nFeatures: automatic\nRelations: manual native\nContributors: A\nContributing: here\nContact: a@b\n"
    meta = release.readme(text)
    assert release.metadata_findings(meta) == [] and release.metadata_findings({**meta, "Genre": "prose", "License": ""}) == ["genre-unknown", "license-unknown"]
    files = spark.createDataFrame([("UD_A-B", "README.md"), ("UD_A-B", "notes.doc")], "name string, file string")
    assert {r.finding for r in release.file_findings(files).collect()} == {"missing-license", "missing-contributing", "missing-test", "extra notes.doc"}
    releases = spark.createDataFrame([("2.9", "UD_A-B"), ("2.10", "UD_A-C")], "release string, name string")
    row = release.history(releases, spark.createDataFrame([("UD_A-B", "UD_A-C")], "old string, new string")).first()
    assert tuple(row) == ("UD_A-C", "2.9", "2.10", 2)


@pytest.mark.parametrize(
    ("reference", "found"),
    [
        ("MATT_1.2", ("MATT", "1.2", 1, "2")), ("PSALM.22.4", ("PS", "22.4", 22, "4")), ("PAVEL_TIM.1_2:3a", ("1TIM", "2:3a", 2, "3a")), ("PAVEL_1.CORINT_13.1", ("1COR", "13.1", 13, "1")),
        ("IOAN_APOC_1.8", ("REV", "1.8", 1, "8")), ("IOAN.2_7", ("2JOHN", "7", 7, None)), ("1KGDMS_3.4-5", ("1SAM", "3.4-5", 3, "4-5")), ("none", (None, None, None, None)), ("", (None, None, None, None)),
    ],
)
def test_verse_references(spark, reference, found):
    row = spark.createDataFrame([(reference,)], "r string").select(*(c.alias(k) for k, c in verses.parts(F.col("r")).items())).first()
    assert (row["book"], row["index"], row["chapter"], row["verse"]) == found


def test_verses_in_sentence_ids_and_their_order(spark):
    ids = ["REV_1.1", "Masoretic-Ruth-1:2-3-hbo", "sahidica_mark-1Cor_02_s003", "12.NTJOHN.REL-BIB,.40", "MATT_10.2a-3b", "MATT_9.11", "MATT_9.2", "XYZ_1.1", "w01-7"]
    rows = spark.createDataFrame([(x, [("_",)]) for x in ids], "sent_id string, words array<struct<misc: string>>")
    found = [r.refs for r in verses.referenced(rows, F.col("sent_id")).orderBy(*verses.canonical()).collect()]
    assert found == ["RUTH_1.2", "MATT_9.2", "MATT_9.11", "MATT_10.2", "JOHN_1.40", "1COR_2.3", "REV_1.1", "XYZ_1.1"]
    several = spark.createDataFrame([([("REF=PSALM.2.1|X=1",), ("ref=EXO_3.4",), ("ref=EXO_3.4",), (None,)],)], "words array<struct<misc: string>>")
    assert [(r.refs, r.book) for r in verses.referenced(several, F.lit("LUKE_1.1")).collect()] == [("EXOD_3.4,PSALM.2.1", "EXOD")]


def test_rendered_lines_are_safe(spark):
    rows = spark.createDataFrame([("a|b\nc", None)], "x string, y long")
    assert [r.line for r in render.markdown(rows, "x", "y").orderBy("place").collect()] == ["| x | y |", "| --- | --- |", "| a\\|b<br>c |  |"]
    report = spark.createDataFrame([("tag", "<&", 3, "", "a--b"), ("feat", "A=x=y", 1, "NOUN,VERB", ""), ("dep", "obj", 2, "", "")], "section string, name string, n long, upos string, examples string")
    assert [r.line for r in render.xml(report).collect()] == ['<tag name="&lt;&amp;">3</tag><!-- a–b -->', '<feat name="A" value="x=y" upos="NOUN,VERB">1</feat>', '<dep name="obj">2</dep>']


def test_shares_of_a_report(spark):
    words = spark.createDataFrame([("A", "a", "NOUN", "_", "obj"), ("B", "b", "NOUN", "N=1|M=2", "root"), ("b", "b", "VERB", "N=1", "obj"), ("c", "c", "VERB", "_", "obj")], "form string, lemma string, upos string, feats string, deprel string")
    found = {(r.section, r["name"]): (r.n, r.upos, r.examples) for r in render.report(words, relative=True).collect()}
    assert found == {("tag", "NOUN"): (0.5, "", "a, b"), ("tag", "VERB"): (0.5, "", "b, c"), ("feat", "N=1"): (0.5, "NOUN,VERB", "B, b"), ("feat", "M=2"): (0.25, "NOUN", "B"), ("dep", "obj"): (0.75, "", ""), ("dep", "root"): (0.25, "", "")}


def test_collation_of_digraphs(spark):
    rows = spark.createDataFrame([(x,) for x in ("i", "hora", "chata", "čas", "cena", "Cena", "daň")], "x string")
    assert [r.x for r in render.collated(rows, "x", "cs").orderBy("rank").collect()] == ["cena", "Cena", "čas", "daň", "hora", "chata", "i"]
