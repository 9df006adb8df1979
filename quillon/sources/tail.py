"""A stream over append-only logs of lines, by byte offsets: what is appended comes once, and a line that is not yet whole waits."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads of a file, and that are looked through at once for a file's last line break.
PART, BLOCK = 32 << 20, 64 << 10
LINES = "path string, offset long, line string"


@dataclass
class Piece(InputPartition):
    """The lines that begin in [begin, end) of a file whose whole lines end at `whole`."""

    path: str
    begin: int
    end: int
    whole: int
    first: bool  # a line begins at begin


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def _open(self):
        return fs.FileSystem.from_uri(re.sub("^file:/+", "/", self.options["path"]))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """For each file the place after its last line break. Files are found anew each time; names that start with . or _ are no logs."""
        system, root = self._open()
        out = {}
        for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if x.type == fs.FileType.File and x.base_name[0] not in "._":
                out[x.path] = self._whole(system, x.path, x.size)
        return out

    def _whole(self, system, path: str, size: int) -> int:
        with system.open_input_file(path) as f:
            at = size
            while at > 0:
                lo = max(0, at - BLOCK)
                cut = f.read_at(at - lo, lo).rfind(b"\n")
                if cut >= 0:
                    return lo + cut + 1
                at = lo
        return 0

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, whole in sorted(end.items()):
            begin = start.get(path, 0)
            if whole < begin:
                raise ValueError(f"{path} became shorter: a log may only grow")
            out += [Piece(path, a, min(a + PART, whole), whole, a == begin) for a in range(begin, whole, PART)]
        return out

    def read(self, part: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = self._open()
        with system.open_input_file(part.path) as f:
            at = part.begin if part.first else self._after_break(f, part.begin - 1, part.whole)
            while at < part.end:
                # whole lines from at on: as far as the piece goes, and then to the end of the line that begins in it
                stop = self._after_break(f, part.end - 1, part.whole) if part.end - at <= 4 * BLOCK else self._after_break(f, at + 4 * BLOCK - 1, part.whole)
                lines, places, here = [], [], at
                for line in f.read_at(stop - at, at).split(b"\n")[:-1]:
                    if line.strip():
                        lines.append(line.decode("utf-8", "replace"))
                        places.append(here)
                    here += len(line) + 1
                yield pa.RecordBatch.from_pydict({"path": pa.array([part.path] * len(lines), pa.string()), "offset": pa.array(places, pa.int64()), "line": pa.array(lines, pa.string())})
                at = stop

    def _after_break(self, f, at: int, whole: int) -> int:
        """The place after the first line break at or after `at`."""
        while at < whole:
            cut = f.read_at(min(BLOCK, whole - at), at).find(b"\n")
            if cut >= 0:
                return at + cut + 1
            at += BLOCK
        return whole

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """Format "log_tail", option path: a folder of append-only files, local, or of any file system that pyarrow reads. Each row is a line that is whole: path, offset, line.

    Offsets are bytes by file, kept in the query's checkpoint, so a restart goes on where it was. A last line without its line break is left for the batch that
    finds it whole; blank lines are none; large files are read in pieces side by side, cut between lines. A file that became shorter stops the query.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Reader(self.options)


def tail_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of path, offset and line of the logs in a folder."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("log_tail").option("path", path).load()


def tail_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """S2 as streams: the rows of whole JSON lines, and the lines (path, offset, line) that are broken."""
    kind = spark.createDataFrame([], schema).schema.add("_broken", T.StringType())
    lines = tail_lines(spark, path).withColumn("r", F.from_json("line", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    return lines.filter(F.col("r._broken").isNull()).select("r.*").drop("_broken"), lines.filter(F.col("r._broken").isNotNull()).select("path", "offset", "line")
