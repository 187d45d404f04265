"""CoNLL-U files as a Spark data source: blocks of lines read by byte ranges, and an ordered sink.

A block is what one sentence's checks see: lines up to the blank or white-space-only line that ends it, that
line included; what a file's end cuts off is a block without it. Lines end in LF, CR LF or CR; `cr` tells
that one did not end in LF.

Reading: files are cut into ranges of `rangeBytes`. A range has the blocks that begin in it, whole: it looks
for the first line end of a block at or behind its first byte and reads on to its last block's end. So no task
needs more than its range, and no window gathers a file's texts; the numbers of lines and sentences come from
sums of counts over the ranges, a row each.

Writing: each task writes the sentences of its partition in order, a piece of up to `pieceBytes` for each
treebank and portion, into a staging folder; only the pieces of tasks that Spark reports as done are moved to
their names, once all are there. A killed task or job leaves nothing but its staging folder.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from arborlake.functions import portion
from arborlake.sources.scratch import written

RANGE_BYTES, PIECE_BYTES, BUFFER, BATCH_ROWS = 64 << 20, 1 << 30, 1 << 20, 4096
BLOCKS = "file string, range int, nth long, line long, n_lines long, raw string, cr boolean"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def is_blank(line: bytes) -> bool:
    """Nothing but white space, of any script."""
    return not line.strip() or (line[0] >= 0x80 or line[0] <= 0x20) and not line.decode(errors="replace").strip()


def lines(source, at: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(position behind the line's end, line, its end) from position `at`, which begins a line; the last line may have no end."""
    source.seek(at)
    rest = b""
    while True:
        data = source.read(BUFFER)
        pieces = (rest + data).splitlines(keepends=True)
        # The last piece may go on, and a CR at the end of what is read may be half of CR LF.
        rest = pieces.pop() if data and pieces else b""
        for piece in pieces:
            at += len(piece)
            line = piece.rstrip(b"\r\n")
            yield at, line, piece[len(line) :]
        if not data:
            return


def line_start(source, at: int) -> int:
    """The beginning of the line that holds the byte ahead of `at`."""
    low, tail = at - 1, b""
    while low > 0:
        step = min(low, BUFFER)
        source.seek(low - step)
        tail = source.read(step)
        # A CR just ahead of the byte `low` ends a line unless that byte is the LF after it.
        source.seek(low)
        end = len(tail) - 1 if low == at - 1 and tail.endswith(b"\r") and source.read(1) == b"\n" else len(tail)
        found = max(tail.rfind(b"\n", 0, end), tail.rfind(b"\r", 0, end))
        if found >= 0:
            return low - step + found + 1
        low -= step
    return 0


def first_block(source, at: int) -> int | None:
    """Where the first block at or behind `at` begins; None if there is none."""
    if at == 0:
        return 0
    for end, line, newline in lines(source, line_start(source, at)):
        if end >= at and newline and is_blank(line):
            return end
    return None


def blocks_in(source, begin: int, end: int) -> Iterator[tuple[list[str], bool]]:
    """The blocks that begin in [begin, end): their lines, and whether a line ended in other than LF."""
    start = first_block(source, begin)
    if start is None or start >= end:
        return
    held: list[str] = []
    cr = False
    for at, line, newline in lines(source, start):
        held.append(line.decode(errors="replace"))
        cr |= b"\r" in newline
        if is_blank(line):
            yield held, cr
            held, cr = [], False
            if at >= end:
                return
    if held:
        yield held, cr


#: What the first byte of a line of white space can be.
_SUSPECT = re.compile(rb"\n(?=[\x00-\x20\x80-\xff])")


def texts_in(source, begin: int, end: int) -> Iterator[tuple[str, int, bool]]:
    """blocks_in() as (text, number of lines, CR or not): a block is cut out of what was read as a whole, where no line ends in CR."""
    at = line_start(source, begin) if begin else 0
    source.seek(at)
    asked = end - at + (BUFFER >> 4)
    data = source.read(asked)
    done = len(data) < asked
    cuts: list[int] = []  # behind the blank lines
    seen = 0
    while True:
        if b"\r" in data[seen:] if seen else b"\r" in data:
            for held, cr in blocks_in(source, begin, end):
                yield "\n".join(held), len(held), cr
            return
        first = [0] if not seen and data else []
        for line in (*first, *(m.end() for m in _SUSPECT.finditer(data, max(seen - 1, 0)))):
            stop = data.find(b"\n", line)
            if stop < 0:
                break
            if is_blank(data[line:stop]):
                cuts.append(stop + 1)
        if done or cuts and at + cuts[-1] >= end:
            break
        # On from the last line, which may have been cut.
        seen = data.rfind(b"\n") + 1
        more = source.read(max(BUFFER, len(data)))
        done = not more
        data += more
    starts = [0, *cuts] if begin == 0 else [c for c in cuts if at + c >= begin]
    for k, start in enumerate(starts):
        if at + start >= end or start == len(data):
            return
        closed = k + 1 < len(starts)
        stop = starts[k + 1] if closed else len(data)
        ended = data[stop - 1] == 10
        yield data[start : stop - ended].decode(errors="replace"), data.count(b"\n", start, stop) + (not ended), False


@dataclass
class Range:
    path: str
    number: int
    begin: int
    end: int


@dataclass
class Ranges(InputPartition):
    """Neighbouring ranges, read one after another by one task."""

    parts: list[Range]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size, self.suffix = options["path"], int(options.get("rangeBytes", RANGE_BYTES)), options.get("suffix", ".conllu")
        self.tasks, self.counting = int(options.get("tasks", 0)), options.get("counting") == "true"

    def files(self) -> list[fs.FileInfo]:
        """All files below the path whose names end in the suffix, by name; hidden ones are left out."""
        system, root = opened(self.path)
        found = system.get_file_info(root)
        infos = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((i for i in infos if i.type == fs.FileType.File and (i.path == root or i.path.endswith(self.suffix) and not re.search(r"/[._]", i.path[len(root) :]))), key=lambda i: i.path)

    def ranges(self, infos: list[fs.FileInfo]) -> list[Ranges]:
        """Small ranges are read by one task up to RANGE_BYTES, as far as there are `tasks` tasks."""
        found = [Range(i.path, k, k * self.size, min((k + 1) * self.size, i.size)) for i in infos for k in range(-(-i.size // self.size))]
        n = max(1, min(RANGE_BYTES // self.size, len(found) // self.tasks)) if self.tasks else 1
        return [Ranges(found[k : k + n]) for k in range(0, len(found), n)]

    def partitions(self) -> list[Ranges]:
        return self.ranges(self.files())

    def read(self, several: Ranges | None) -> Iterator[pa.RecordBatch]:
        for part in several.parts if several is not None else ():  # None: no files
            yield from self.counted(part) if self.counting else self.blocks(part)

    def counted(self, part: Range) -> Iterator[pa.RecordBatch]:
        """One row: the numbers of blocks and lines, no text."""
        system, _ = opened(self.path)
        with system.open_input_file(part.path) as source:
            sizes = [n for _, n, _ in texts_in(source, part.begin, part.end)]
        if sizes:
            yield batch_of([(part.path, part.number, len(sizes), 0, sum(sizes), "", False)])

    def blocks(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        with system.open_input_file(part.path) as source:
            rows, line, nth = [], 0, 0
            for raw, n, cr in texts_in(source, part.begin, part.end):
                rows.append((part.path, part.number, nth, line, n, raw, cr))
                line, nth = line + n, nth + 1
                if len(rows) == BATCH_ROWS:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)


class Arrivals(Reader, DataSourceStreamReader):
    """Files that arrive whole, by renaming, in the order of their times (of equal times, by name). The offset is the last one's."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        return max((self.arrived(i) for i in self.files()), key=lambda o: (o["time"], o["path"]), default=self.initialOffset())

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        place = lambda o: (o["time"], o["path"])
        return self.ranges([i for i in self.files() if place(start) < place(self.arrived(i)) <= place(end)])

    def commit(self, end: dict) -> None:
        pass

    @staticmethod
    def arrived(info: fs.FileInfo) -> dict:
        return {"time": info.mtime_ns, "path": info.path}


_ARROW = pa.schema([("file", pa.string()), ("range", pa.int32()), ("nth", pa.int64()), ("line", pa.int64()), ("n_lines", pa.int64()), ("raw", pa.string()), ("cr", pa.bool_())])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


@dataclass
class Pieces(WriterCommitMessage):
    partition: int
    staged: list[tuple[str, int]]


class Writer(DataSourceArrowWriter):
    """Rows (name, raw), already in order within partitions; `name` is the file's without its number."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size, self.staging = options["path"], int(options.get("pieceBytes", PIECE_BYTES)), f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Pieces:
        from pyspark import TaskContext

        system, root = opened(self.path)
        partition = TaskContext.get().partitionId()
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"  # an attempt's own
        system.create_dir(folder, recursive=True)
        staged: list[tuple[str, int]] = []
        name = out = None
        written_bytes = 0
        try:
            for batch in iterator:
                for own, raw in zip(batch.column("name").to_pylist(), batch.column("raw").to_pylist()):
                    if own != name or written_bytes >= self.size:
                        if out is not None:
                            out.close()
                        name, written_bytes = own, 0
                        staged.append((name, 0))
                        out = system.open_output_stream(f"{folder}/{len(staged)}")
                    data = (raw.rstrip("\n") + "\n\n").encode()
                    out.write(data)
                    written_bytes += len(data)
                    staged[-1] = (name, written_bytes)
        finally:
            if out is not None:
                out.close()
        return Pieces(partition, [(f"{folder}/{k}", n) for k, (n, _) in enumerate(staged, 1)])

    def commit(self, messages: list[Pieces | None]) -> None:
        """Moves the pieces to name-00000.conllu and so on, in the order of the partitions."""
        system, root = opened(self.path)
        numbers: dict[str, int] = {}
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for staged, name in message.staged:
                number = numbers[name] = numbers.get(name, -1) + 1
                system.move(staged, f"{root}/{name}-{number:05d}.conllu")
        self.abort(messages)

    def abort(self, messages: list[Pieces | None]) -> None:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")


class ConlluSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "conllu"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema: StructType) -> Arrivals:
        return Arrivals(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        system, root = opened(self.options["path"])
        if not overwrite and any(i.path.endswith(".conllu") for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True))):
            raise ValueError(f"{root} has files already")
        return Writer(self.options)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, suffix: str = ".conllu") -> DataFrame:
    """file, treebank, portion, sent_no (from 1), line (of the block's first line, from 1), raw, cr.

    Sentences and lines are numbered within a file; pieces `name-00000`, `name-00001` of one name are one file.
    """
    spark.dataSource.register(ConlluSource)
    reader = lambda counting: spark.read.format("conllu").option("rangeBytes", range_bytes).option("suffix", suffix).option("tasks", 8 * spark.sparkContext.defaultParallelism).option("counting", counting).load(path)
    name = F.concat(F.regexp_extract("file", r"\A(.*/)?[^/]*\z", 1), F.regexp_extract("file", r"([^/]+?)(?:-[0-9]{5})?\.conllu\z", 1))
    rows = reader("false").withColumn("name", name)
    counts = reader("true").select(name.alias("name"), "file", "range", F.col("nth").alias("blocks"), F.col("n_lines").alias("lines"))
    before = W.partitionBy("name").orderBy("file", "range").rowsBetween(W.unboundedPreceding, -1)  # a narrow row for each range
    sums = written(counts.select("file", "range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("blocks", "lines"))), "ranges")
    numbered = rows.join(F.broadcast(sums), ["file", "range"])  # else every text would be shuffled
    treebank = F.regexp_replace(F.regexp_extract("name", r"([^/]+)\z", 1), r"-ud-(train|dev|test)\z", "")
    return numbered.select(F.col("name").alias("file"), treebank.alias("treebank"), portion(F.col("name")).alias("portion"), (F.col("nth") + F.col("blocks_before") + 1).alias("sent_no"), (F.col("line") + F.col("lines_before") + 1).alias("line"), "raw", "cr")


def arriving(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of the blocks of files that arrive below the path: treebank, file, range, nth, raw, cr. Their order is (file, range, nth)."""
    spark.dataSource.register(ConlluSource)
    rows = spark.readStream.format("conllu").option("rangeBytes", range_bytes).load(path)
    return rows.select(F.regexp_extract("file", r"([^/]+?)(?:-ud-(?:train|dev|test))?(?:-[0-9]+)?\.conllu\z", 1).alias("treebank"), "file", "range", "nth", "raw", "cr")


def write(sentences: DataFrame, path: str, treebank: str, portion: str, *order: str, pieces: int | None = None, piece_bytes: int = PIECE_BYTES) -> None:
    """Writes raw blocks as `treebank-ud-portion-00000.conllu` and so on, in the order of `order` within each.

    Rows are dealt by ranges of (file, order) to `pieces` partitions (Spark's own number if none), each written in order.
    """
    sentences.sparkSession.dataSource.register(ConlluSource)
    name = F.concat_ws("-ud-", F.col(treebank).cast("string"), F.col(portion).cast("string"))
    keys = ["name", *(f"_order{i}" for i in range(len(order)))]
    rows = sentences.select(name.alias("name"), *(F.col(c).alias(k) for c, k in zip(order, keys[1:])), "raw")
    rows = rows.repartitionByRange(pieces, *keys) if pieces else rows.repartitionByRange(*keys)
    rows.sortWithinPartitions(*keys).select("name", "raw").write.format("conllu").option("pieceBytes", piece_bytes).mode("append").save(path)
