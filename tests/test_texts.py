"""Blocks cut out of what was read, against the loop over lines."""

import random

import pyarrow as pa
import pytest

from arborlake.sources import files


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_texts_are_the_blocks_of_the_loop(newline, monkeypatch):
    rng = random.Random(newline)
    monkeypatch.setattr(files, "BUFFER", 16)
    for _ in range(150):
        text = "".join(rng.choice(["1\ta", "# c", "", " \t", " ", "\u3000", "é b", "x é中", ""]) + rng.choice([newline, "\n"]) for _ in range(rng.randrange(0, 14)))
        data = (text + rng.choice(["", "2\tb", " "])).encode() + rng.choice([b"", b"\xe4\xb8"])
        for size in (1, 2, 3, 5, 8, 40, 1000):
            source = pa.BufferReader(data)
            for k in range(-(-len(data) // size)):
                at = (k * size, min((k + 1) * size, len(data)))
                assert list(files.texts_in(source, *at)) == [("\n".join(b), len(b), cr) for b, cr in files.blocks_in(source, *at)], (data, at)


def test_numbering_reads_no_text_and_shuffles_none(spark, tmp_path):
    (tmp_path / "xx_a-ud-train.conllu").write_text("1\ta\n\n" * 5000)
    reader = files.Reader({"path": str(tmp_path), "rangeBytes": "500", "tasks": "4", "counting": "true"})
    tasks = reader.partitions()
    assert len(tasks) <= 5 and sum(len(t.parts) for t in tasks) == 50
    rows = [r for t in tasks for b in reader.read(t) for r in b.to_pylist()]
    assert sum(r["nth"] for r in rows) == 5000 and sum(r["n_lines"] for r in rows) == 10000 and not any(r["raw"] for r in rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = files.read(spark, str(tmp_path), 500)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan
