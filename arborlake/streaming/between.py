"""Checks between sentences over arriving files, with state: what `checks.across` finds on all of them at once.

A task turns the facts of its sentences into messages for keys: each sentence id for a bucket of ids, each
parallel id for its core, and of each stretch of a file and of a treebank's graphs only what others must know:
first and last sentences, the first of each kind. So the state of a treebank's graphs meets a few rows from each
task, not every sentence. State is kept by Spark (transformWithState, RocksDB), so a stopped stream goes on from
its checkpoint with what it knew.

The order of sentences is (file, range, nth) within a batch, and batches follow each other: files must arrive
in the order that counts. Whether all graphs are copies of the trees is known at the end alone; `at_end` reads
it from the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from arborlake.operators import checks
from arborlake.sources import files

PLACE = ("file", "range", "nth")
#: Buckets of sentence ids of a treebank.
BUCKETS = 1024
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
MESSAGE = "treebank string, topic string, name string, file string, range int, nth long, kind string, text string, flag boolean"
FINDING = "treebank string, file string, range int, nth long, level int, testclass string, testid string, node string"


def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts (treebank, PLACE, FACTS) to messages."""
    names = [c.split()[0] for c in MESSAGE.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    for batch in batches:
        out: list[tuple] = []
        graphs: dict[tuple[str, str], tuple] = {}
        before = None
        rows = batch.to_pylist()
        for i, r in enumerate(rows):
            bank, place = r["treebank"], tuple(r[c] for c in PLACE)
            if r["sent_id"]:
                out.append((bank, "id", str(xxhash.xxh64_intdigest(r["sent_id"].encode()) % BUCKETS), *place, "", r["sent_id"], None))
            if r["parallel_id"]:
                out.append((bank, "parallel", "/".join(r["parallel_id"].split("/")[:2]), *place, "", r["parallel_id"], None))
            # Glue within the stretch is decided here; its ends are for the file's other stretches.
            same = before is not None and before["file"] == r["file"]
            if same and before["ends_glued"] and r["begins"]:
                out.append((bank, "found", "", *place, "spaceafter-newdocpar", "", None))
            if not same:
                out.append((bank, "file", r["file"], *place, "first", "", r["begins"]))
            if i + 1 == len(rows) or rows[i + 1]["file"] != r["file"]:
                out.append((bank, "file", r["file"], *place, "last", "", r["ends_glued"]))
            before = r
            kinds = [("enhanced" if r["enhanced"] else "basic", ""), *([("differs", "")] if r["differs"] else []), *([("empty", r["empties"][0])] if r["empties"] else [])]
            for kind, text in kinds:
                graphs[bank, kind] = min(graphs.get((bank, kind), (place, text)), (place, text))
            graphs[bank, "end"] = max(graphs.get((bank, "end"), (place, "")), (place, ""))
            out += [(bank, "graph", "", *place, "orphan", node, None) for node in r["orphans"]]
        out += [(bank, "graph", "", *place, kind, text, None) for (bank, kind), (place, text) in graphs.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)


class Memory(StatefulProcessor):
    """The state of one key (treebank, topic, name)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "text string", "n int")
        self.last = handle.getValueState("last", "alt int, part int")
        self.graph = handle.getValueState("graph", "enhanced boolean, basic boolean, differs boolean, empty boolean, orphan boolean, file string, range int, nth long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        bank, topic, _ = key
        of_topic = {"id": self.ids, "parallel": self.parallels, "file": self.stretches, "graph": self.graphs, "found": self.decided}[topic]
        for place, level, testclass, testid, node in of_topic(rows):
            yield Row(treebank=bank, file=place[0], range=place[1], nth=place[2], level=level, testclass=testclass, testid=testid, node=node)

    @staticmethod
    def ordered(rows: Iterator[Row]) -> list[tuple]:
        return sorted(((r["file"], r["range"], r["nth"]), r["kind"], r["text"], r["flag"]) for r in rows)

    def decided(self, rows: Iterator[Row]) -> Iterator[tuple]:
        for r in rows:
            yield (r["file"], r["range"], r["nth"]), 2, "METADATA", r["kind"], ""

    def ids(self, rows: Iterator[Row]) -> Iterator[tuple]:
        for place, _, text, _ in self.ordered(rows):
            if self.seen.containsKey((text,)):
                yield place, 2, "METADATA", "non-unique-sent-id", ""
            else:
                self.seen.updateValue((text,), (1,))

    def parallels(self, rows: Iterator[Row]) -> Iterator[tuple]:
        """Whole ids once; numbers of alternatives and parts one more than the last one's, or absent as there; the first is 1 or absent."""
        for place, _, text, _ in self.ordered(rows):
            if self.seen.containsKey((text,)):
                yield place, 2, "METADATA", "non-unique-parallel-id", ""
                continue
            self.seen.updateValue((text,), (1,))
            m = checks.re.search(r"/(?:alt([0-9]+))?(?:part([0-9]+))?\Z", text)
            now = tuple(int(x) if x else None for x in m.groups()) if m and text.count("/") > 1 else (None, None)
            last = self.last.get() if self.last.exists() else None
            for kind, number, old in zip(("alt", "part"), now, last or (None, None)):
                due = number in (None, 1) if last is None else number == (None if old is None else old + 1)
                if not due:
                    yield place, 2, "METADATA", f"parallel-id-{kind}", ""
            self.last.update(now)

    def stretches(self, rows: Iterator[Row]) -> Iterator[tuple]:
        """A file arrives whole, so its stretches meet in one batch."""
        glued = False
        for place, kind, _, flag in self.ordered(rows):
            if kind == "first" and flag and glued:
                yield place, 2, "METADATA", "spaceafter-newdocpar", ""
            glued = bool(flag) if kind == "last" else False

    def graphs(self, rows: Iterator[Row]) -> Iterator[tuple]:
        known = dict(zip(("enhanced", "basic", "differs", "empty", "orphan"), self.graph.get()[:5])) if self.graph.exists() else dict.fromkeys(("enhanced", "basic", "differs", "empty", "orphan"), False)
        firsts: dict[str, tuple] = {}
        orphans, end = [], None
        for r in rows:
            at = ((r["file"], r["range"], r["nth"]), r["text"])
            if r["kind"] == "end":
                end = max(end or at, at)
            elif r["kind"] == "orphan":
                orphans.append(at)
                firsts["orphan"] = min(firsts.get("orphan", at), at)
            else:
                firsts[r["kind"]] = min(firsts.get(r["kind"], at), at)
        if not (known["enhanced"] and known["basic"]) and all(known[k] or k in firsts for k in ("enhanced", "basic")):
            yield max(firsts[k][0] for k in ("enhanced", "basic") if not known[k]), 2, "ENHANCED", "edeps-only-sometimes", ""
        if "empty" in firsts and not known["empty"] and (known["orphan"] or "orphan" in firsts and firsts["orphan"][0] < firsts["empty"][0]):
            yield firsts["empty"][0], 3, "ENHANCED", "empty-node-after-eorphan", firsts["empty"][1]
        for place, node in orphans:
            if known["empty"] or "empty" in firsts and place > firsts["empty"][0]:
                yield place, 3, "ENHANCED", "eorphan-after-empty-node", node
        self.graph.update((*(known[k] or k in firsts for k in known), *end[0]))


def findings(spark: SparkSession, folder: str, range_bytes: int = files.RANGE_BYTES) -> DataFrame:
    """A stream of FINDING rows on the files that arrive in the folder. The session needs the state store PROVIDER."""
    spark.conf.set(*PROVIDER)
    rows = files.arriving(spark, folder, range_bytes)
    facts = checks.passing(rows.select("treebank", *PLACE, "raw"), ("treebank", *PLACE), whole=False)
    sent = facts.mapInArrow(messages, MESSAGE)
    return sent.groupBy("treebank", "topic", "name").transformWithState(Memory(), FINDING, "Append", "None")


def at_end(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What only the end of a treebank decides, from the state of the last batch: graphs that never differ from the trees."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "graph").load()
    rows = state.select("key.*", "value.*").where("enhanced and not differs")
    return rows.select("treebank", *PLACE, F.lit(3).alias("level"), F.lit("ENHANCED").alias("testclass"), F.lit("edeps-identical-to-basic-trees").alias("testid"), F.lit("").alias("node"))
