"""Files of runs, written and read by tasks themselves: a file format's commit moves and lists every folder from the driver, one by one."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark import TaskContext

#: Bytes of lines held before they are written, or sent on.
HELD = 1 << 22
#: What the name of a partition's folder can't hold, and the folder of rows without a value, as Spark has them.
_UNSAFE = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def file_name(run: str | None, part: int) -> str:
    """A run's file below the root. An empty id shares its folder with none, as a folder has no name for it."""
    folder = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", run) if run else NO_VALUE
    return f"run_id={folder}/part-{part:05d}{'-empty' * (run == '')}.json"


class _File:
    """A file that is there when it is whole: it is written under another name, which readers skip."""

    def __init__(self, fs: FileSystem, path: str, attempt: int):
        self.fs, self.path, self.stream, self.held, self.size, self.rows = fs, path, None, [], 0, 0
        folder, _, name = path.rpartition("/")
        self.folder, self.own = folder, f"{folder}/.{name}-{attempt}"

    def add(self, lines: list[bytes]) -> None:
        self.held += lines
        self.rows += len(lines)
        self.size += sum(map(len, lines))
        if self.size > HELD:
            self._write()

    def _write(self) -> None:
        if not self.stream:
            self.fs.create_dir(self.folder)
            self.stream = self.fs.open_output_stream(self.own)
        self.stream.write(b"\n".join(self.held) + b"\n")
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._write()
        self.stream.close()
        self.fs.move(self.own, self.path)


def writer(root: str) -> Callable:
    """Of (run_id, line), with a run's rows one after another, to files; (run_id, file, rows) of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root)
        task, now, run, done = TaskContext.get(), None, None, []

        def close() -> None:
            now.close()
            done.append((run, file_name(run, task.partitionId()), now.rows))

        def told() -> pa.RecordBatch:
            some, done[:] = list(zip(*done)), []
            return pa.RecordBatch.from_arrays([pa.array(some[0], pa.string()), pa.array(some[1], pa.string()), pa.array(some[2], pa.int64())], ["run_id", "file", "rows"])

        for batch in batches:
            runs, lines, start = pc.run_end_encode(batch.column(0).cast(pa.string())), batch.column(1).cast(pa.binary()).to_pylist(), 0
            for end, value in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                if now is None or value != run:
                    if now:
                        close()
                    now, run = _File(fs, f"{base}/{file_name(value, task.partitionId())}", task.taskAttemptId()), value
                now.add(lines[start:end])
                start = end
            if done:
                yield told()
        if now:
            close()
            yield told()

    return write


def _lines(fs: FileSystem, path: str) -> Iterator[list[bytes]]:
    rest = b""
    with fs.open_input_stream(path) as f:
        while chunk := f.read(HELD):
            *whole, rest = (rest + chunk).split(b"\n")
            yield whole
    if rest:
        yield [rest]


def reader(root: str) -> Callable:
    """Of (run_id, file, rows) to (run_id, line); a file with other than its rows is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(root)
        told = lambda: pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(lines, pa.binary()).cast(pa.string())], ["run_id", "line"])
        for batch in batches:
            runs, lines, size = [], [], 0
            for run, file, rows in zip(*[c.to_pylist() for c in batch.columns]):
                n = 0
                for some in _lines(fs, f"{base}/{file}"):
                    runs += [run] * len(some)
                    lines += some
                    n += len(some)
                    size += sum(map(len, some))
                    if size > HELD:
                        yield told()
                        runs, lines, size = [], [], 0
                if n != rows:
                    raise ValueError(f"{file} has {n} lines where {rows} were written")
            if lines:
                yield told()

    return read
