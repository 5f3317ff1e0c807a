"""Lines of files that go on growing, as a streaming source with offsets of its own.

Spark's text source takes a file once, when it first sees it. This one remembers how far
it has read each file, in bytes, so lines appended later are read later, and a restart
goes on in the middle of a file. Only lines that have ended are read. A line has
the byte at which it begins, which with the file orders all lines of a folder. Large
pieces are parted, and a line belongs to the part that it begins in. The driver looks at
names and sizes, and at the end of each grown file; files that are gone leave the offset.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, file_path string, file_block_start long"
#: Bytes of a part, and bytes read at a time.
PART, PIECE = 64 << 20, 1 << 20


@dataclass
class Part(InputPartition):
    """Lines of a file that begin from ``begin`` on and before ``end``; ``first``: a line is known to begin at ``begin``."""

    path: str
    begin: int
    end: int
    first: bool


def lines_of(file: pa.NativeFile, begin: int, end: int, first: bool) -> Iterator[tuple[int, bytes]]:
    """(byte, line) of the lines that begin in a range; the last one may end behind it."""
    place = begin if first else begin - 1
    file.seek(place)
    rest, skip = b"", not first
    while piece := file.read(PIECE):
        rows = (rest + piece).split(b"\n")
        rest = rows.pop()
        for row in rows:
            if skip:  # what belongs to the part before; empty if that ends with a line
                skip = False
            elif place >= end:
                return
            else:
                yield place, row[:-1] if row.endswith(b"\r") else row
            place += len(row) + 1
        if place >= end and not skip:
            return


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, part: int):
        self.store, self.folder = fs.FileSystem.from_uri(path)
        self.part = part
        #: Ends of lines found before, by file: size then, end.
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def ended(self, path: str, size: int) -> int:
        """Where the last ended line of a file's first ``size`` bytes ends."""
        if self.known.get(path, (-1, 0))[0] != size:
            low, place = self.known.get(path, (0, 0))[1], size
            with self.store.open_input_file(path) as file:
                end = low
                while place > low:
                    begin = max(low, place - PIECE)
                    file.seek(begin)
                    if (found := file.read(place - begin).rfind(b"\n")) >= 0:
                        end = begin + found + 1
                        break
                    place = begin
            self.known[path] = size, end
        return self.known[path][1]

    def latestOffset(self) -> dict:
        found = self.store.get_file_info(fs.FileSelector(self.folder, allow_not_found=True, recursive=True))
        files = {f.path: f.size for f in found if f.type == fs.FileType.File and not any(p[:1] in "._" for p in f.path.removeprefix(self.folder).split("/") if p)}
        self.known = {p: k for p, k in self.known.items() if p in files and k[0] <= files[p]}
        return {path: end for path, size in sorted(files.items()) if (end := self.ended(path, size))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        spans = [(path, start.get(path, 0), stop) for path, stop in end.items() if stop > start.get(path, 0)]
        return [Part(path, at, min(at + self.part, stop), at == begin) for path, begin, stop in spans for at in range(begin, stop, self.part)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        with self.store.open_input_file(partition.path) as file:
            rows: list[tuple[int, bytes]] = []
            for row in lines_of(file, partition.begin, partition.end, partition.first):
                rows.append(row)
                if len(rows) == 10_000:
                    yield self.batch(partition, rows)
                    rows = []
            if rows:
                yield self.batch(partition, rows)

    def batch(self, partition: Part, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        # broken UTF-8 is shown, not refused
        values = pa.array([line.decode("utf-8", "replace") for _, line in rows], pa.string())
        return pa.RecordBatch.from_arrays([values, pa.array([partition.path] * len(rows), pa.string()), pa.array([at for at, _ in rows], pa.int64())], names=["value", "file_path", "file_block_start"])


class TailSource(DataSource):
    """Options: path (a folder of text files, as a URI or an absolute path), part (bytes of a part)."""

    @classmethod
    def name(cls) -> str:
        return "plantlens_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("part", PART)))
