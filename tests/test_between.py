"""Findings between sentences of arriving files against `checks.across` on all of them."""

import os
import random
from collections import Counter

from pyspark.sql import functions as F

from arborlake.operators import checks
from arborlake.sources import files
from arborlake.streaming import between


def sentence(rng, i, copies):
    comments = [f"# sent_id = s{rng.randrange(0, 60)}", *rng.choice([["# newpar"], ["# newdoc"], [], [], []])]
    if rng.random() < 0.3:
        comments.append(f"# parallel_id = up/{rng.randrange(0, 5)}{rng.choice(['', '/alt1', '/alt2', '/part1', '/part2', '/alt1part2', '/alt2part1'])}")
    rows = [f"1\tx\tx\tNOUN\t_\t_\t0\troot\t{'0:root' if copies or rng.random() < 0.6 else '_'}\t_"]
    if not copies and rng.random() < 0.1:
        rows.append("1.1\ty\ty\tNOUN\t_\t_\t_\t_\t1:dep\t_")
    rows.append(f"2\ty\ty\tNOUN\t_\t_\t1\tdep\t{'1:dep' if copies else rng.choice(['1:dep', '1:orphan', '_', '_'])}\t{rng.choice(['_', 'SpaceAfter=No'])}")
    return "\n".join([*comments, *rows]) + "\n\n"


def test_three_batches_and_a_restart_find_what_all_files_at_once_give(spark, tmp_path):
    rng = random.Random(11)
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    os.mkdir(folder)
    for batch in range(3):
        for k in range(2):
            for bank in ("xx_a", "xx_b", "xx_c"):
                path = f"{folder}/{bank}-ud-train-{batch}{k}.conllu"
                with open(path + ".part", "w") as f:
                    f.write("".join(sentence(rng, i, bank == "xx_c") for i in range(40)))
                os.utime(path + ".part", (1_000_000 + batch, 1_000_000 + batch))
                os.rename(path + ".part", path)
        # A new query each time: it goes on from the checkpoint.
        query = between.findings(spark, folder, range_bytes=700).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    found = spark.read.parquet(out).unionByName(between.at_end(spark, checkpoint))
    rows = spark.read.format("conllu").option("rangeBytes", 700).load(folder)
    keys = ("treebank", "file", "range", "nth")
    rows = rows.withColumn("treebank", F.regexp_extract("file", r"(xx_.)", 1))
    facts = checks.facts(rows.select(*keys, "raw"), keys, whole=False)
    expected = checks.across(facts, keys, "treebank", "file")
    columns = [*keys, "level", "testclass", "testid", "node"]
    got, due = (Counter(map(tuple, x.select(*columns).collect())) for x in (found, expected))
    assert got == due
    assert {r.testid for r in expected.collect()} == {
        "non-unique-sent-id", "spaceafter-newdocpar", "edeps-only-sometimes", "edeps-identical-to-basic-trees", "empty-node-after-eorphan", "eorphan-after-empty-node", "non-unique-parallel-id", "parallel-id-alt", "parallel-id-part",
    }
    assert files.RANGE_BYTES > 700
