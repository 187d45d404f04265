"""READMEs by column expressions against the function that reads one text, and the report on planted repositories."""

import random

from arborlake.operators import release


def readmes(seed, n):
    rng = random.Random(seed)
    some = lambda *x: rng.choice(x)
    for k in range(n):
        lines = [some("# Summary", "## summary of this", "#Summary", "# Intro"), "", some("Plain text of forty characters and a bit more, yes.", "*Short*", "See [the `site`](http://x.y) and  more\n of it, which is long enough for the rule.", ""), "", some("# Changelog", "## CHANGELOG", "# History"), "* 2.1", ""]
        for f in release.FIELDS:
            for _ in range(some(0, 1, 1, 1, 2)):
                value = some("", "yes", "no", "manual native", "automatic", "UD v2.5", "UD v2.x", "CC BY", "GPL", "news wiki", "news gossip", "up", "up xx", " spaced\t")
                lines.append(some("", "  ") + f + some(":", ": ", " :") + value)
        rng.shuffle(lines) if k % 7 == 0 else None
        yield f"r{k}", "\n".join(lines)
    yield "empty", ""


def test_metadata_columns_equal_the_reader_of_one_text(spark):
    texts = list(readmes(3, 60))
    rows = spark.createDataFrame([*texts, ("null", None)], "name string, text string")
    table = release.metadata(rows)
    found = {r.name: r.asDict() for r in table.collect()}
    for name, text in (*texts, ("null", "")):
        due = release.readme(text)
        assert {k: found[name][release.column_of(k)] for k in (*release.FIELDS, "summary", "changelog")} == due, name
    first = spark.createDataFrame([("r1", "2.5"), ("r2", "2.7"), ("other", "1.0")], "name string, first string")
    known = {"r1": "2.5", "r2": "2.7"}
    got = {}
    for r in release.metadata_table(table, first, ("up",)).collect():
        got.setdefault(r.name, []).append(r.finding)
    due = {name: sorted(release.metadata_findings(release.readme(text), known.get(name, ""), {"up"})) for name, text in (*texts, ("null", ""))}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in due.items() if v} and len({x for v in due.values() for x in v}) >= 12


def test_report_of_planted_repositories(spark):
    files = [("UD_A-X", f) for f in ("README.md", "LICENSE.txt", "CONTRIBUTING.md", "aa_x-ud-test.conllu")] + [("UD_B-Y", "LICENSE.txt"), ("UD_B-Y", "CONTRIBUTING.md"), ("UD_B-Y", "bb_y-ud-test.conllu"), ("UD_B-Y", "a b.zip")]
    good = "# Summary\n\nA summary which is long enough, as it has over forty characters.\n\n# Changelog\n\n* 2.1\n\n" + "\n".join(f"{k}: {v}" for k, v in {"Data available since": "UD v2.1", "License": "CC BY", "Includes text": "yes", "Parallel": "no", "Genre": "news", "Contributors": "A", "Contributing": "here", "Contact": "a@b.c", **{k: "automatic" for k in ("Lemmas", "UPOS", "XPOS", "Features", "Relations")}}.items())
    releases = [("2.1", "UD_Old-X"), ("2.2", "UD_A-X"), ("2.2", "UD_C-Z")]
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = release.by_treebank(release.report(of(files, "name string, file string"), of([("UD_A-X", good)], "name string, text string"), of(releases, "release string, name string"), of([("UD_Old-X", "UD_A-X")], "old string, new string")))
    assert {r.name: r.findings for r in found.collect()} == {"UD_B-Y": "files: extra a b.zip; files: missing-readme; release: new", "UD_C-Z": "release: gone"}
    none = release.report(of([], "name string, file string"), of([], "name string, text string"), of([], "release string, name string"), of([], "old string, new string"))
    assert none.collect() == []
