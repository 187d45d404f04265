"""The CoNLL-U data source: ranges against a plain loop over lines, the sink against what went in."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborlake.operators import checks, validator
from arborlake.sources import files
from arborlake.sources.cases import BASE


def plain(data):
    """Blocks by a loop over the whole text's lines."""
    text, out, held = data.decode(errors="replace").replace("\r\n", "\n").replace("\r", "\n"), [], []
    rows = text.split("\n")
    for i, line in enumerate(rows):
        if i == len(rows) - 1 and not line:
            break
        held.append(line)
        if not line.strip():
            out.append("\n".join(held))
            held = []
    return out + (["\n".join(held)] if held else [])


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\r"])
def test_ranges_of_any_size_give_every_block_once(newline, monkeypatch):
    rng = random.Random(newline)
    monkeypatch.setattr(files, "BUFFER", 7)
    for _ in range(60):
        text = "".join(rng.choice(["1\ta", "# c", "", " \t", " ", "x é中", ""]) + rng.choice([newline, newline, "\n"]) for _ in range(rng.randrange(0, 14)))
        data = (text + rng.choice(["", "2\tb"])).encode()
        for size in (1, 2, 3, 5, 8, 1000):
            source = pa.BufferReader(data)
            found = [b for k in range(-(-len(data) // size)) for b in files.blocks_in(source, k * size, min((k + 1) * size, len(data)))]
            assert ["\n".join(b) for b, _ in found] == plain(data), (data, size)
            assert any(cr for _, cr in found) == (b"\r" in data)


def test_numbers_run_through_ranges_and_pieces(spark, tmp_path):
    sentences = [f"# sent_id = {i}\n" + "\n".join(f"{j}\tw{i}" for j in range(1, i % 7 + 2)) for i in range(300)]
    (tmp_path / "xx_a-ud-train-00000.conllu").write_text("\n\n".join(sentences[:200]) + "\n\n")
    (tmp_path / "xx_a-ud-train-00001.conllu").write_text("\n\n".join(sentences[200:]) + "\n\n")
    (tmp_path / "xx_a-ud-dev.conllu").write_text(sentences[0])
    (tmp_path / "notes.txt").write_text("no treebank")
    rows = files.read(spark, str(tmp_path), range_bytes=500).orderBy("portion", "sent_no").collect()
    assert [(r.treebank, r.portion, r.sent_no, r.line) for r in rows[:2]] == [("xx_a", "dev", 1, 1), ("xx_a", "train", 1, 1)] and rows[0].raw == sentences[0]
    line = 1
    for r, s in zip(rows[1:], sentences, strict=True):
        assert (r.raw, r.line) == (s + "\n", line)
        line += s.count("\n") + 2


def test_sink_keeps_order_and_splits_by_size(spark, tmp_path):
    rows = spark.createDataFrame([(i, "en" if i % 3 else "de", f"# sent_id = {i}\n1\tw") for i in range(500)], "n int, lang string, raw string").repartition(7)
    files.write(rows.withColumn("part", F.lit("test")), str(tmp_path / "out"), "lang", "part", "n", pieces=3, piece_bytes=2000)
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert "de-ud-test-00000.conllu" in names and "en-ud-test-00001.conllu" in names and not [x for x in names if x.startswith("_")]
    assert all((tmp_path / "out" / x).stat().st_size < 2100 for x in names)
    found = files.read(spark, str(tmp_path / "out")).orderBy("treebank", "sent_no").collect()
    assert [r.raw for r in found] == [f"# sent_id = {i}\n1\tw\n" for lang in (0, 1) for i in range(500) if bool(i % 3) == bool(lang)]
    with pytest.raises(Exception, match="files already"):
        files.write(rows.withColumn("part", F.lit("test")), str(tmp_path / "out"), "lang", "part", "n")


def test_a_failed_attempt_leaves_no_piece(tmp_path, monkeypatch):
    """The first attempt of a task dies in the middle; only the second one's pieces are committed."""

    class Task:
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr("pyspark.TaskContext.get", staticmethod(Task))
    batch = pa.RecordBatch.from_pydict({"name": ["a", "a", "b"], "raw": ["1\tx", "1\ty", "1\tz"]})
    writer = files.Writer({"path": str(tmp_path)})

    def dying():
        yield batch
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        writer.write(dying())
    done = writer.write(iter([batch]))
    writer.commit([done])
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"a-00000.conllu": "1\tx\n\n1\ty\n\n", "b-00000.conllu": "1\tz\n\n"}
    other = files.Writer({"path": str(tmp_path)})
    other.abort([other.write(iter([batch]))])
    assert len(list(tmp_path.iterdir())) == 2


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("{b}\n\n", []), ("{b}\n\n\n", ["empty-sentence"]), ("{b}", ["missing-empty-line"]), ("{b}\n", ["missing-empty-line"]), ("{b}\n \t\n", ["pseudo-empty-line"]), ("{b}\n \n{b}\n\n", ["pseudo-empty-line", "non-unique-sent-id"]),
        ("{b}\r\n\r\n{c}\r\n\r\n", ["non-unix-newline"]), ("\n{b}\n\n", ["empty-sentence"]), ("# only\n\n", ["empty-sentence"]), ("{b}\n# end\n\n", ["misplaced-comment"]),
    ],
)
def test_how_a_file_ends_its_blocks_is_found(spark, tmp_path, text, found):
    block = "\n".join(["# sent_id = a", "# text = She reads the book.", *BASE])
    (tmp_path / "en_x-ud-test.conllu").write_bytes(text.replace("{b}", block).replace("{c}", block.replace("= a", "= b")).replace("\r\n", "\n").replace("\n", "\r\n" if "\r" in text else "\n").encode())
    report = validator.validate_files(spark, str(tmp_path), level=3, exclude=("edeps-identical-to-basic-trees",))
    assert sorted(r.testid for r in report.incidents.collect()) == sorted(found)
    assert [r.verdict for r in report.verdicts.collect()] == ["FAILED" if found else "PASSED"]


def test_report_of_several_treebanks(spark, tmp_path):
    """Lines within the file, filters, cap with the number of the rest, explanations once, coreference, verdicts."""
    good = "\n".join(["# sent_id = {i}", "# text = She reads the book.", *BASE]).replace("2:nsubj", "_").replace("0:root", "_").replace("4:det", "_").replace("2:obj", "_").replace("2:punct", "_")
    bad = good.replace("\tPRON\t", "\tPRO\t")
    (tmp_path / "en_a-ud-train.conllu").write_text("\n\n".join(good.replace("{i}", f"a{i}") for i in range(3)) + "\n\n")
    (tmp_path / "en_b-ud-test-00000.conllu").write_text("\n\n".join((bad if i else good).replace("{i}", f"b{i}") for i in range(25)) + "\n\n")
    (tmp_path / "en_b-ud-test-00001.conllu").write_text(good.replace("{i}", "b3").replace("\tSpaceAfter=No", "\tEntity=(e1-robot-1|SpaceAfter=No").replace("# text", "# global.Entity = eid-etype-head\n# text") + "\n\n")
    report = validator.validate_files(spark, str(tmp_path), level=3, coref=True, max_err=20, range_bytes=700)
    found = {(r.testid, r.treebank, r.line) for r in report.incidents.collect()}
    assert {x for x in found if x[0] != "unknown-upos"} == {("non-unique-sent-id", "en_b", 204), ("spurious-entity-type", "en_b", 207), ("cross-sentence-mention", "en_b", 207)}
    assert {x[2] for x in found if x[0] == "unknown-upos"} == {8 * i + 3 for i in range(1, 25)}
    assert {(r.treebank, r.verdict) for r in report.verdicts.collect()} == {("en_a", "PASSED"), ("en_b", "FAILED")}
    shown = report.shown.where("testclass = 'MORPHO' and type = 'ERROR'").orderBy("rank").collect()
    assert len(shown) == 21 and shown[-1].text == "...suppressing 4 more of MORPHO" and shown[0].text.startswith("[Line 11 Sent 2 Node 1]: [L2 MORPHO unknown-upos]")
    plan = report.shown._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    only = validator.validate_files(spark, str(tmp_path), level=3, include=("unknown-upos",), warnings=False)
    assert {r.testid for r in only.incidents.collect()} == {"unknown-upos"} and only.counts.first()["n"] == 24


def test_what_a_report_tells_comes_of_one_reading(spark, tmp_path):
    """Treebanks, their features and line ends too (finding F1 of the fourth review)."""
    block = "\n".join(["# sent_id = {i}", "# text = She reads the book.", *BASE])
    for name, text in (("en_a", block + "\n\n" + block), ("en_b", block.replace("Number", "number")), ("de_c", re.sub(r"\t[A-Z][A-Za-z]*=[^\t]*\t([0-9])", r"\t_\t\1", block))):
        (tmp_path / f"{name}-ud-test.conllu").write_text(text.replace("{i}", "s") + "\n\n")
    report = validator.validate_files(spark, str(tmp_path), level=3, include=("non-unique-sent-id", "invalid-feature", "pron-det-without-prontype"))
    found = Counter((r.treebank, r.testid) for r in report.incidents.collect())
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (report.incidents, report.counts, report.verdicts, report.shown)]
    assert "BatchScan conllu" in files.read(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString() and not any("BatchScan conllu" in p for p in plans)
    due = Counter()
    for name in ("en_a", "en_b", "de_c"):
        text = (tmp_path / f"{name}-ud-test.conllu").read_text()
        featured = any(x.split("\t")[5] != "_" for x in text.split("\n") if x[:1].isdigit())
        for raw in text.split("\n\n")[:-1]:
            due.update((name, f.testid) for f in checks.chain(raw + "\n", name[:2], 3, checks.SAMPLE) if f.testid == "invalid-feature" or (featured and f.testid == "pron-det-without-prontype"))
    due["en_a", "non-unique-sent-id"] = 1
    assert found == due
