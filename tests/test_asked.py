"""What words ask of the registry: by batches in the task that makes them, and of rows of words() (finding F4)."""

import random
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__
from arborlake.operators import lookups
from arborlake.sources import synthetic

SF = "/root/testdata/sf0.001"


def test_batches_ask_what_rows_ask(spark):
    r = random.Random(9)
    pick = r.choice
    rare = lambda usual, *others: pick(others) if r.random() < 0.1 else usual
    word = lambda i: (i, rare("w", "a b", "a b", "a b", "a\x1cb", "", None), rare("be", "x y", None), pick(["AUX", "NOUN", None]), rare("_", "A=b|C=d,e", "A|B=", "=x", "Foreign=Yes|Foreign=No", "A=b||C=d", None), rare(i // 2, i, 99, None), pick(["cop", "cop:x", "dep", None]), rare("_", "1:obj|2.1:conj:and", "02:x", "+1:y", "obj", "0:root|99:z", "1:", None), rare("_", "Lang=en", "Lang=", "Lang=fr|Lang=de", None))
    rows = [(k, pick(["en", "de", None]), [word(i) for i in range(1, r.randrange(1, 9))]) for k in range(800)] + [(900, "en", []), (901, "en", None)]
    kinds = ["long" if c in ("id", "head") else "string" for c in lookups.FIELDS]
    df = spark.createDataFrame(rows, f"n long, lang string, words array<struct<{', '.join(f'{c}:{k}' for c, k in zip(lookups.FIELDS, kinds))}>>").repartition(3)
    keys = ("n", "lang")
    due = Counter(map(tuple, lookups.asked(lookups.words(df, keys, "lang"), keys).collect()))
    found = Counter(map(tuple, df.mapInArrow(lookups.asked_step(keys, "lang"), f"n long, lang string, {lookups.ASKED}").collect()))
    assert found == due and {k[4] for k in due} == {"relation", "feature", "enhanced", "space", "auxiliary", "copula"}, (list((found - due).items())[:4], list((due - found).items())[:4])


def test_the_registry_is_met_in_one_scan_of_words(spark):
    plan = __spark_entry__.queries()["incidents_registry"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("documents.parquet") == 1 and plan.count("Join") == 2
    made = synthetic.worked(spark, SF, lookups.FIELDS, lookups.asked_step(("doc_id", "lang"), "lang"), ("doc_id", "lang"), lookups.ASKED)
    assert made.where(F.col("kind") == "relation").count() == synthetic.words(spark, SF).count()
