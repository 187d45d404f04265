"""Filter audit, ranked search and exact duplicates: against their SQL on given and odd tables, and against plain loops."""

import zlib
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from arborlake.llm import audit, exact, queries, search

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, n long, row long, digest string, length int, mask int, term long, part string"


def odd(spark):
    """Nulls, empty and repeated rows, equal texts in other white space, ties, a very long text, columns with clashing names."""
    long = " ".join(f"w{i % 97}" for i in range(200_000))
    rows = [
        (1, None, "en"), (2, "", None), (3, "one two", "en"), (3, "one two", "en"), (None, "three", "de"), (4, long, "en"), (5, "one\t\n two", "fr"), (6, " one two", "fr"), (7, "one two ", ""),
        (None, "one two", "en"), (8, "ONE $ two", "en"), (9, long + " ", "en"), (10, long.replace(" ", "\n"), "en"), (11, " \n", "en"), (12, " ", "en"), (13, "é中  x", "de"), (None, "three", "de"), (14, "one two", None),
    ]
    return spark.createDataFrame([(i, t, x, "s", 1, 2, 3, "d", 4, 5, 6, "p") for i, t, x in rows], ODD)


@pytest.fixture
def folder(spark, tmp_path):
    odd(spark).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (3, 0, 1), (8, None, 1), (None, 1, 1), (99, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two two"), (2, None), (3, ""), (4, "unseen words"), (None, "Three w1"), (5, "w1 w2 w3 x"), (5, "w1"), (6, "é中 X")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def by_sql(folder, name, files=""):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{files}')")
    found = con.sql(queries.ORACLE[name])
    return sorted(found.columns), found


def same(spark, name, folder, files=""):
    columns, expected = by_sql(folder, name, files)
    found = queries.QUERIES[name](spark, folder)
    assert sorted(found.columns) == columns
    assert Counter(tuple(r) for r in found.select(*columns).collect()) == Counter(expected.select(", ".join(columns)).fetchall())


@pytest.mark.parametrize("name", ["op11_audit", "op12_search", "op13_exact"])
def test_queries_equal_their_sql(spark, name, folder):
    same(spark, name, SF)
    same(spark, name, folder, "/*.parquet")


def test_empty_tables_give_empty_tables(spark, folder):
    docs, labels, items = (spark.read.parquet(f"{folder}/{t}.parquet").limit(0) for t in ("documents", "labels", "benchmark"))
    assert audit.audit(docs, labels).isEmpty() and exact.refined(docs).isEmpty() and search.ranked(docs, items).isEmpty()
    assert search.ranked(odd(spark), items).isEmpty() and search.ranked(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).isEmpty()
    assert audit.audit(odd(spark), labels).agg(F.max("good_lost")).first()[0] == 0


def test_the_same_groups_with_and_without_every_digest_and_by_any_prefix(spark):
    some = exact.refined(odd(spark), prefix=3).drop("text_sha256").collect()
    for found in (exact.refined(odd(spark)), exact.refined(odd(spark), every_digest=True)):
        assert Counter(some) == Counter(found.drop("text_sha256").collect())
    found = exact.refined(odd(spark))
    assert found.where("group_size > 1 and text_sha256 is null").isEmpty() and not found.where("text_sha256 is null").isEmpty()


def test_exact_keeps_one_row_of_each_text(spark):
    found = {(r.keep_id, r.group_size): r.n for r in exact.refined(odd(spark)).where("kept").groupBy("keep_id", "group_size").agg(F.count("*").alias("n")).collect()}
    assert found == {(1, 2): 1, (3, 5): 1, (None, 2): 1, (4, 2): 1, (6, 1): 1, (7, 1): 1, (8, 1): 1, (9, 1): 1, (11, 2): 1, (13, 1): 1}


def test_audit_equals_applying_the_filters_in_turn(spark):
    docs = [(r.doc_id, r.text or "", r.lang or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    least = {}
    for d, t, _ in docs:
        least[t] = min(d, least.get(t, d))
    words = {d: t.encode().split() for d, t, _ in docs}
    tests = {
        "A": lambda d, t: len(words[d]) < 100, "B": lambda d, t: 100 * len(set(words[d])) < 80 * len(words[d]), "C": lambda d, t: 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
        "D": lambda d, t: any(c in "#$%&*|" for c in t), "E": lambda d, t: d > least[t],
    }
    fails = {f: {d for d, t, _ in docs if test(d, t)} for f, test in tests.items()}
    expected, shapley = {}, Counter()
    for part in {x for *_, x in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = {d for d, _, x in docs if x == part}
            whole = set(left)
            for step, f in enumerate(order, 1):
                gone = left & fails[f]
                left = left - gone
                alone = (whole & fails[f]) - set().union(*(fails[g] for g in "ABCDE" if g != f))
                lost = [sum(d in labels and labels[d][c] == 1 for d in gone) for c in ("quality", "toxic")]
                expected[part, order, step] = (len(left), len(gone), len(whole & fails[f]) - len(gone), len(alone), *lost)
                shapley[part, f] += len(gone)
    found = audit.audit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:9] for r in found} == expected
    assert all(r.shapley == shapley[r.part, r.filter_order[r.step - 1]] for r in found)


def test_search_is_the_same_in_blocks_and_without_a_vocabulary(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    expected = Counter(search.ranked(docs, items).collect())
    assert Counter(search.ranked(docs, items, entries=50, vocabulary=10).collect()) == expected
    few = Counter(r for r in search.ranked(docs, items, k=3).collect())
    assert few == Counter({r: 1 for r in expected if r["rank"] <= 3})


def test_search_prunes_and_loses_nothing(spark):
    """Items with terms too frequent to matter: some documents are no candidates, and ties at the threshold stay."""
    import numpy as np

    docs = spark.createDataFrame([(i, "the the of " + ("rare " * (i % 5 == 0)) + f"u{i}") for i in range(200)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the of rare"), (2, "the of"), (3, "u7 the")], "item_id long, text string")
    found = {i: [r.doc_id for r in sorted(search.ranked(docs, items).where(F.col("item_id") == i).collect(), key=lambda r: r["rank"])] for i in (1, 2, 3)}
    assert found[1] == list(range(0, 50, 5)) and found[2][0] == 1 and found[3][0] == 7 and len(found[3]) == 10
    entries = np.array([[0, 0], [10, 20], [1, 1], [5, 100], [10, 10]])
    assert search.Block([1], entries, np.array([60])).ahead()[1].tolist() == [0] and len(search.Block([1], entries, np.array([50])).ahead()[1]) == 2


def test_terms(spark):
    rows = spark.createDataFrame([(1, "A-b_c9é É x\u0000y~z"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: (r.n, len(r.terms)) for r in search.counted(rows, "doc_id").collect()}
    assert found == {1: (6, 6), 2: (0, 0)} and zlib.crc32(b"") == 0
