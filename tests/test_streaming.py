from arborlake import streaming
from arborlake.sources.cases import BASE, CASES


def test_arriving_files_are_validated(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.conllu").write_text(CASES[0].raw.replace("{id}", "a") + "\n\n" + "\n".join(BASE) + "\n\n")
    query = streaming.incidents(spark, str(folder), "en").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.testid for r in spark.table("arrived").collect()) == ["missing-sent-id", "missing-text"]
