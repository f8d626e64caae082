"""A streaming source for one log file that still grows.

    register_jsonl_tail(spark)
    spark.readStream.format("jsonl_tail").option("path", "/shared/telemetry.jsonl").load()

Offsets are byte positions just past a newline, so a line still being written waits
for the next batch. With each position goes a fingerprint of the first bytes of the
file and of the last bytes before the position: a file that was truncated, or replaced
by a smaller or a larger one, no longer matches and is read from its start, which adds
nothing twice since records are stored by key. The bytes of a batch are cut into ranges that
many tasks read; each range begins with the first line that starts inside it.

Both ends may be equal although the log is another one. With the option `marks`, a folder on shared storage, each task
also leaves the digests of the blocks that it reads, block by block as they pass. Every look for new lines then holds a few
earlier blocks against their digests, going round all of them, so a change anywhere before the position is found
after at most (blocks / CHECKED_BLOCKS) looks. It begins a new generation, whose number is part of the offset, and the log
is read from its start.

As a batch source with the option `ranges` it reads given byte ranges only (see `log_tail_file`).

The log must lie on storage that the driver and every executor can read.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Bytes at the start of a file, and before the position, that tell it from its successor.
FINGERPRINT_BYTES = 4096
DEFAULT_SPLIT_BYTES = 64 * 1024 * 1024
READ_BYTES = 4 * 1024 * 1024
BATCH_LINES = 20_000
# Bytes of the log that one digest stands for, and how many of them are looked at again each time.
BLOCK_BYTES = 1024 * 1024
CHECKED_BLOCKS = 4

START = {"position": 0, "mark_bytes": 0, "mark": "", "generation": 0}  # nothing read yet


def _system(path: str):
    """The file system of a path or URI, and the path on it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _open(path: str):
    """A random-access reader for a path or URI, or None if there is no such file."""
    from pyarrow import fs

    system, inner = _system(path)
    if system.get_file_info(inner).type != fs.FileType.File:
        return None
    return system.open_input_file(inner)


def _mark(f, size: int, position: int) -> str:
    """Digest of the first `size` bytes and of the `size` bytes before `position`."""
    if not size:
        return ""
    f.seek(0)
    digest = hashlib.sha256(f.read(size))
    f.seek(position - size)
    digest.update(f.read(size))
    return digest.hexdigest()


def _past_last_newline(f, end: int) -> int:
    """The position just past the last newline before `end`."""
    while end > 0:
        start = max(0, end - READ_BYTES)
        f.seek(start)
        at = f.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


class Marks:
    """Digests of the blocks read so far: one small file for each range, below a folder for each generation of the log."""

    def __init__(self, folder: str):
        self.folder = folder

    def _names(self, *parts: str) -> list[str]:
        from pyarrow import fs

        system, inner = _system(self.folder)
        found = system.get_file_info(fs.FileSelector("/".join([inner, *parts]), allow_not_found=True))
        return [x.base_name for x in found if not x.base_name.startswith(".")]

    def generation(self) -> int:
        return max((int(n) for n in self._names() if n.isdigit()), default=0)

    def renew(self) -> int:
        """Begin the next generation: the log is another one."""
        system, inner = _system(self.folder)
        new = self.generation() + 1
        system.create_dir(f"{inner}/{new}", recursive=True)
        return new

    def blocks(self, generation: int) -> list[tuple[int, int, str]]:
        """(start, end, digest) of all marked blocks."""
        system, inner = _system(self.folder)
        out = []
        for name in self._names(str(generation)):
            with system.open_input_file(f"{inner}/{generation}/{name}") as f:
                out += [tuple(x) for x in json.loads(f.read())]
        return sorted(out)

    def leave(self, generation: int, blocks: list[tuple[int, int, str]]) -> None:
        """Written aside and renamed, so that a file is whole; a repeated task writes the same again."""
        system, inner = _system(self.folder)
        folder, name = f"{inner}/{generation}", f"{blocks[0][0]}-{blocks[-1][1]}"
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/.{name}") as f:
            f.write(json.dumps(blocks).encode())
        system.move(f"{folder}/.{name}", f"{folder}/{name}")


class ByteRange(InputPartition):
    def __init__(self, path: str, first: int, start: int, end: int, marks: str | None = None, generation: int = 0):
        self.path, self.first, self.start, self.end = path, first, start, end
        self.marks, self.generation = marks, generation


def read_range(p: ByteRange) -> Iterator:
    """The lines that start inside a range, as Arrow batches; leaves the digests of its blocks."""
    import pyarrow as pa

    lines, places, digests = [], [], []

    def batch():
        blocks = pa.array([p.start] * len(lines), pa.int64())
        pos = pa.StructArray.from_arrays([blocks, pa.array(places, pa.int64())], ["block", "row"])
        return pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([p.path] * len(lines), pa.string()), pos], ["value", "src_file", "src_pos"])

    with _open(p.path) as f:
        # The line running into the range belongs to the range before. One
        # byte earlier, so that a line starting exactly here is not lost.
        skipping = False
        if p.start > p.first:
            f.seek(p.start - 1)
            skipping = f.read(1) != b"\n"
        f.seek(p.start)
        at = line_at = p.start
        begun = []  # parts of a line of this range that has no end yet
        # past the range, only the rest of the line that began in it is read
        while at < p.end or begun:
            data = f.read(min(BLOCK_BYTES, p.end - at) if at < p.end else READ_BYTES)
            if not data:
                break
            if at < p.end:
                digests.append((at, at + len(data), hashlib.sha256(data).hexdigest()))
            base, pos = at, 0
            at += len(data)
            while line_at < p.end and (stop := data.find(b"\n", pos)) >= 0:
                if not skipping:
                    whole = b"".join([*begun, data[pos:stop]])
                    lines.append(whole.rstrip(b"\r").decode("utf-8", "replace"))
                    places.append(line_at - p.start)
                skipping, begun, pos = False, [], stop + 1
                line_at = base + pos
                if len(lines) >= BATCH_LINES:
                    yield batch()
                    lines, places = [], []
            if not skipping and line_at < p.end and pos < len(data):
                begun.append(data[pos:])
        if begun and not skipping:  # the file's last line, without an end
            lines.append(b"".join(begun).rstrip(b"\r").decode("utf-8", "replace"))
            places.append(line_at - p.start)
    if lines:
        yield batch()
    if p.marks and digests:
        Marks(p.marks).leave(p.generation, digests)


class JsonlTailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split_bytes = int(options.get("splitBytes", DEFAULT_SPLIT_BYTES))
        self.max_bytes = int(options.get("maxBytesPerTrigger", 0))
        self.done = dict(START)  # last position handed out; a restart sets it in `partitions`
        self.marks = options.get("marks")
        self.blocks, self.next, self.number = None, 0, 0  # marked blocks, which to look at next, the log's generation

    def initialOffset(self) -> dict:
        return dict(START)

    def latestOffset(self) -> dict:
        f = _open(self.path)
        if f is None:
            return dict(START)
        with f:
            self._look_back(f)
            size = f.size()
            if self.max_bytes:
                begin = self.done["position"] if self._same(f, self.done) else 0
                size = self._limited(f, begin, size)
            position = _past_last_newline(f, size)
            mark_bytes = min(position, FINGERPRINT_BYTES)
            latest = {
                "position": position, "mark_bytes": mark_bytes, "mark": _mark(f, mark_bytes, position),
                "generation": self.number,
            }
        if self.max_bytes:
            self.done = latest
        return latest

    def _limited(self, f, start: int, size: int) -> int:
        """End of a batch of about `max_bytes`: never inside a line, never empty."""
        end = start + self.max_bytes
        while end < size:
            if _past_last_newline(f, end) > start:
                return end
            end += self.max_bytes  # one line longer than the limit
        return size

    def _look_back(self, f) -> None:
        """Hold a few earlier blocks against their digests; a new generation if one has changed."""
        if not self.marks:
            return
        marks = Marks(self.marks)
        if self.blocks is None:
            self.number = marks.generation()
            self.blocks = marks.blocks(self.number)
        for _ in range(min(CHECKED_BLOCKS, len(self.blocks))):
            start, end, digest = self.blocks[self.next % len(self.blocks)]
            self.next += 1
            f.seek(start)
            if hashlib.sha256(f.read(end - start)).hexdigest() != digest:
                self.number, self.blocks, self.next = marks.renew(), [], 0
                return

    def commit(self, end: dict) -> None:
        """The batch is done: its blocks have been marked."""
        if self.marks and self.blocks is not None:
            self.blocks = Marks(self.marks).blocks(self.number)

    def _same(self, f, offset: dict) -> bool:
        """True if the file still is the one the offset was taken from."""
        if offset.get("generation", 0) != self.number:
            return offset["position"] == 0
        size = offset["mark_bytes"]
        return f.size() >= offset["position"] and _mark(f, size, offset["position"]) == offset["mark"]

    def partitions(self, start: dict, end: dict):
        f = _open(self.path)
        if f is None:
            return []
        with f:
            if self.marks and self.blocks is None:
                self.number = Marks(self.marks).generation()
            if not self._same(f, end):
                return []  # replaced since: what this batch was to read is gone
            grown = end["position"] >= start["position"] and self._same(f, start)
        first = start["position"] if grown else 0
        if self.max_bytes:
            self.done = end
        return [
            ByteRange(self.path, first, at, min(at + self.split_bytes, end["position"]), self.marks, self.number)
            for at in range(first, end["position"], self.split_bytes)
        ]

    def read(self, partition: ByteRange):
        """The lines that start inside the range, as Arrow batches."""
        return read_range(partition)


class JsonlRangesReader(DataSourceReader):
    def __init__(self, options):
        self.ranges = json.loads(options["ranges"])
        self.split_bytes = int(options.get("splitBytes", DEFAULT_SPLIT_BYTES))

    def partitions(self):
        # a range that starts inside a file begins with the first line that starts in it
        return [
            ByteRange(path, 0, at, min(at + self.split_bytes, end))
            for path, start, end in self.ranges
            for at in range(start, end, self.split_bytes)
        ]

    def read(self, partition: ByteRange):
        return read_range(partition)


class JsonlTailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "value string, src_file string, src_pos struct<block: bigint, row: bigint>"

    def streamReader(self, schema) -> JsonlTailReader:
        return JsonlTailReader(self.options)

    def reader(self, schema) -> JsonlRangesReader:
        return JsonlRangesReader(self.options)


def register_jsonl_tail(spark: SparkSession) -> None:
    """Make the source known to the session; its code travels with the tasks."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(JsonlTailSource)
