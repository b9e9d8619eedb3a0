"""A stream source for log files that grow, are cut short and are rotated.

An offset is a snapshot of the folder: for every file the mark of its generation (hash of its
first line) and the byte up to which its lines are whole. A micro-batch reads what lies between
two snapshots, in ranges of bytes. A file is known again by its mark, also under another name,
so a rotated file is read on from where it was left; a file whose mark is new, or that became
shorter than what was read of it, is a new generation and read from its beginning.
"""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, path string"
#: Bytes of a first line that tell generations apart, of a task's range, and of one read.
MARK_BYTES, SPLIT_BYTES, READ_BYTES = 1 << 16, 64 << 20, 4 << 20
#: Seconds after which a last line without an end counts as whole.
IDLE_SECONDS = 300.0
_SKIPPED = (".gz", ".bz2", ".zst", ".xz", ".zip", ".crc")


@dataclass
class ByteRange(InputPartition):
    """Lines that begin from ``begin`` to before ``stop``; lines are whole from ``first`` on and
    end at ``last`` at most. ``head`` bytes hash to ``mark``."""
    path: str
    mark: str
    head: int
    first: int
    begin: int
    stop: int
    last: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _mark(head: bytes) -> str:
    return hashlib.sha1(head).hexdigest()


class GrowingTextReader(DataSourceStreamReader):
    """Snapshots of the files below a folder, or of one file and what it is rotated to."""

    def __init__(self, options: dict):
        options = {name.lower(): value for name, value in options.items()}
        self.path = options["path"]
        self.from_latest = str(options.get("fromlatest", "false")).lower() == "true"
        self.idle = float(options.get("idleseconds", IDLE_SECONDS))
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self._seen: dict[str, tuple[tuple, dict]] = {}

    # --- what is there ---------------------------------------------------------------

    def _files(self) -> list[tuple[fs.FileInfo, bool]]:
        """Files, and whether all their generations are followed or only those already known."""
        system, inner = _open(self.path)
        info = system.get_file_info(inner)
        one = info.type != fs.FileType.Directory
        folder = os.path.dirname(inner) if one else inner
        name = os.path.basename(inner)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=not one))
        return [(f, not one or f.base_name == name) for f in found
                if f.type == fs.FileType.File and not f.base_name.endswith(_SKIPPED)
                and not any(p.startswith((".", "_")) for p in f.path[len(folder):].split("/"))
                and (not one or f.base_name.startswith(name))]

    @staticmethod
    def _head(system: fs.FileSystem, path: str, length: int = MARK_BYTES) -> bytes:
        with system.open_input_file(path) as file:
            return file.read(length)

    def _entry(self, system: fs.FileSystem, info: fs.FileInfo) -> dict | None:
        """Mark and end of the whole lines of a file; none if it has no line yet."""
        size, modified = info.size, info.mtime.timestamp() if info.mtime else 0.0
        idle = time.time() - modified >= self.idle
        known = self._seen.get(info.path)
        if known and known[0] == (size, modified, idle):
            return known[1]
        with system.open_input_file(info.path) as file:
            size = file.size()
            head = file.read(min(size, MARK_BYTES))
            end, at = 0, size
            while at > 0 and not end:  # from the end back to the last line end
                lo = max(0, at - MARK_BYTES)
                file.seek(lo)
                cut = file.read(at - lo).rfind(b"\n")
                end, at = lo + cut + 1 if cut >= 0 else 0, lo
        if idle:
            end = size
        line = head[:head.find(b"\n") + 1] or head
        entry = {"mark": _mark(line), "head": len(line), "end": end} if end else None
        self._seen[info.path] = ((info.size, modified, idle), entry)
        return entry

    def _snapshot(self) -> dict:
        system, _ = _open(self.path)
        out = {}
        for info, followed in sorted(self._files(), key=lambda f: f[0].path):
            entry = self._entry(system, info)
            if entry:
                out[info.path] = {**entry, "all": followed}
        self._seen = {p: v for p, v in self._seen.items() if p in out}
        return out

    # --- what Spark asks -------------------------------------------------------------

    def initialOffset(self) -> dict:
        return self._snapshot() if self.from_latest else {}

    def latestOffset(self) -> dict:
        return self._snapshot()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        system, _ = _open(self.path)
        out: list[InputPartition] = []
        for path, entry, done in _pending(start, end, lambda p, n: _mark(self._head(system, p, n))):
            first, last = done, entry["end"]
            for begin in range(first, last, self.split):
                out.append(ByteRange(path, entry["mark"], entry["head"], first, begin,
                                     min(begin + self.split, last), last))
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        path = self._current(system, partition)
        with system.open_input_file(path) as file:
            for lines in _lines(file, partition):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.decode("utf-8", "ignore") for x in lines], pa.string()),
                     pa.array([partition.path] * len(lines), pa.string())], names=["value", "path"])

    def _current(self, system: fs.FileSystem, part: ByteRange) -> str:
        """Where the generation is now: it may have been rotated since it was planned."""
        candidates = [part.path, *[f.path for f, _ in self._files() if f.path != part.path
                                   and f.size >= part.last]]
        for path in candidates:
            try:
                if _mark(self._head(system, path, part.head)) == part.mark:
                    return path
            except FileNotFoundError:
                continue
        raise FileNotFoundError(f"{part.path} was removed before its bytes {part.begin} to "
                                f"{part.stop} were read")


def _pending(start: dict, end: dict, mark_of) -> Iterator[tuple[str, dict, int]]:
    """(path, entry, first byte) of what ``end`` has beyond ``start``.

    Files are known by path and mark, else by mark alone (renamed), of several by the longest.
    """
    claimed, kept = set(), {}
    for path, entry in end.items():
        before = start.get(path)
        if before and before["end"] <= entry["end"] and (
                before["mark"] == entry["mark"] or mark_of(path, before["head"]) == before["mark"]):
            claimed.add(path)
            kept[path] = before["end"]
    for path in sorted(end.keys() - kept.keys(), key=lambda p: -end[p]["end"]):
        entry = end[path]
        same = [p for p, e in start.items() if p not in claimed and e["mark"] == entry["mark"]
                and e["end"] <= entry["end"]]
        if same:
            old = max(same, key=lambda p: (start[p]["end"], p))
            claimed.add(old)
            kept[path] = start[old]["end"]
    for path, entry in end.items():
        done = kept.get(path, 0 if entry["all"] else entry["end"])
        if done < entry["end"]:
            yield path, entry, done


def _lines(file, part: ByteRange) -> Iterator[list[bytes]]:
    """Lines that begin in the range, some at a time."""
    at = part.begin
    if part.begin > part.first:  # what began before belongs to the range before
        file.seek(part.begin - 1)
        at, skipping = part.begin - 1, True
    else:
        file.seek(at)
        skipping = False
    carried: list[bytes] = []
    begins = at  # where the line in ``carried`` begins
    while at < part.last:
        data = file.read(min(READ_BYTES, part.last - at))
        if not data:
            break
        at += len(data)
        if skipping:
            cut = data.find(b"\n") + 1
            if not cut:
                if at >= part.stop:
                    return
                continue
            begins, data, skipping = at - len(data) + cut, data[cut:], False
            if begins >= part.stop:
                return
        cut = data.rfind(b"\n") + 1
        if not cut:
            carried.append(data)
            continue
        whole = b"".join([*carried, data[:cut]])
        lines = whole.split(b"\n")[:-1]
        if begins + len(whole) > part.stop:  # only those that begin in the range
            own = []
            for line in lines:
                if begins >= part.stop:
                    break
                own.append(line)
                begins += len(line) + 1
            yield own
            if begins >= part.stop:
                return
        else:
            begins += len(whole)
            yield lines
            if begins >= part.stop:
                return
        carried = [data[cut:]] if cut < len(data) else []
    if carried and not skipping and begins < part.stop:
        yield [b"".join(carried)]


class GrowingText(DataSource):
    """``spark.readStream.format("growing_text").option("path", ...)``.

    Options: ``fromLatest`` starts behind what is there, ``idleSeconds`` after which a last line
    without an end is read, ``splitBytes`` for one task.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_text"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingTextReader:
        return GrowingTextReader(dict(self.options))
