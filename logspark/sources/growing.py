"""Lines of files that keep growing, as a stream: a data source with a byte offset for each file.

An offset names every followed file with the bytes taken of it, its first bytes and the time
it changed. A batch reads, of each file, the bytes between two offsets, in pieces that are
tasks of their own. A line belongs to the piece that holds its line feed, whose reader looks back
for where the line began; so offsets may fall anywhere, a half line waits for its end, and
each line comes once, in whatever pieces and batches its bytes arrived.

A file is known by its first bytes besides its path. One that became shorter or begins
otherwise was replaced and is read from its start; a new path that begins as a file that was
replaced or went away, in the same folder, is that file under a new name and goes on where it was.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logspark.sources.lines import clean_lines, container_columns, trim_lines

NAME = "growing_lines"
_SCHEMA = "value string, path string, modified timestamp"
# First bytes that tell a file from another, bytes of a task, of a read, and of a look back.
_HEAD, PIECE_BYTES, _READ_BYTES, _LOOK_BYTES = 64, 64 << 20, 4 << 20, 1 << 16
_CALLS = 32


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and plain path of a folder, given as a path or a URI."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


class Piece(InputPartition):
    """Bytes of a file; ``last`` asks for the half line at the end as well."""

    def __init__(self, path: str, modified: int, start: int, stop: int, last: bool):
        self.path, self.modified, self.start, self.stop, self.last = path, modified, start, stop, last


def moved_from(path: str, entry: dict, start: dict, end: dict) -> dict | None:
    """What was known of a new path under the one name it had before."""
    folder = path.rpartition("/")[0]
    found = [
        known
        for name, known in start.items()
        if name.rpartition("/")[0] == folder
        and not (name in end and continues(known, end[name]))
        and len(known["head"]) == 2 * _HEAD
        and continues(known, entry)
    ]
    return found[0] if len(found) == 1 else None


def continues(known: dict, entry: dict) -> bool:
    """Whether a file may be the known one, grown."""
    return entry["bytes"] >= known["bytes"] and entry["head"].startswith(known["head"])


def pieces_between(start: dict, end: dict, most: int = PIECE_BYTES) -> list[Piece]:
    """What was added to each file between two offsets."""
    found = []
    for path, entry in end.items():
        known = start.get(path)
        if known is not None and not continues(known, entry):
            known = None
        elif known is None:
            known = moved_from(path, entry, start, end)
        at = known["bytes"] if known else 0
        closing = entry["closed"] and not (known and known["closed"] and at == entry["bytes"])
        while at < entry["bytes"] or closing:
            stop = min(at + most, entry["bytes"])
            last = closing and stop == entry["bytes"]
            found.append(Piece(path, entry["modified"], at, stop, last))
            at = stop
            if last:
                break
    return found


def _line_start(file, at: int) -> bytes:
    """The bytes before ``at`` that belong to the line running there."""
    parts = []
    while at > 0:
        begin = max(0, at - _LOOK_BYTES)
        file.seek(begin)
        part = file.read(at - begin)
        cut = part.rfind(b"\n")
        if cut >= 0:
            parts.append(part[cut + 1 :])
            break
        parts.append(part)
        at = begin
    return b"".join(reversed(parts))


def lines_of(file, piece: Piece) -> Iterator[list[str]]:
    """The lines whose line feed lies in a piece of an open file, in lists of bounded bytes."""
    begun, at, open_ = False, piece.start, []
    while at < piece.stop:
        file.seek(at)
        data = file.read(min(_READ_BYTES, piece.stop - at))
        if not data:
            break
        at += len(data)
        cut = data.rfind(b"\n")
        if cut < 0:
            open_.append(data)
            continue
        if not begun:
            open_.insert(0, _line_start(file, piece.start))
            begun = True
        whole = b"".join([*open_, data[:cut]])
        open_ = [data[cut + 1 :]]
        yield whole.decode("utf-8", "replace").split("\n")
    if piece.last:
        if not begun:
            open_.insert(0, _line_start(file, piece.start))
        rest = b"".join(open_)
        if rest:
            yield [rest.decode("utf-8", "replace")]


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.files, self.root = open_folder(options["path"])
        self.root = self.root.rstrip("/")
        self.pattern = options.get("pattern", "*")
        self.settle = float(options.get("settleSeconds", 60))
        self.most = int(options.get("maxBytesPerTrigger", 1 << 62))
        self.heads: dict[str, tuple[int, int, str]] = {}
        self.taken: dict[str, dict] | None = None

    def initialOffset(self) -> dict:
        self.taken = {}
        return {}

    def _head(self, info: fs.FileInfo) -> str:
        """The first bytes in hex; read again only when the file has changed."""
        known = self.heads.get(info.path)
        if known and known[:2] == (info.size, info.mtime_ns):
            return known[2]
        with self.files.open_input_file(info.path) as file:
            head = file.read(_HEAD).hex()
        self.heads[info.path] = (info.size, info.mtime_ns, head)
        return head

    def latestOffset(self) -> dict:
        listed = self.files.get_file_info(fs.FileSelector(self.root, allow_not_found=True, recursive=True))
        infos = sorted(
            (x for x in listed if x.is_file and fnmatch.fnmatch(x.path[len(self.root) + 1 :], self.pattern)),
            key=lambda info: info.path,
        )
        with ThreadPoolExecutor(_CALLS) as pool:
            heads = list(pool.map(self._head, infos))
        self.heads = {info.path: self.heads[info.path] for info in infos}
        now = dt.datetime.now(dt.timezone.utc).timestamp()
        end = {
            info.path: {
                "bytes": info.size,
                "head": head,
                "modified": info.mtime_ns // 1000,
                "closed": now - info.mtime_ns / 1e9 >= self.settle,
            }
            for info, head in zip(infos, heads)
        }
        if self.taken is not None:
            self._limit(end)
        self.taken = end
        return end

    def _limit(self, end: dict) -> None:
        """Take no more bytes than a batch may have; a file may be left in the middle."""
        room = self.most
        for path, entry in end.items():
            known = self.taken.get(path)
            if known is None or not continues(known, entry):
                known = moved_from(path, entry, self.taken, end) or {"bytes": 0}
            stop = min(entry["bytes"], known["bytes"] + room)
            if stop < entry["bytes"]:
                entry |= {"bytes": stop, "head": entry["head"][: 2 * stop], "closed": False}
            room -= stop - known["bytes"]

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.taken = end
        return pieces_between(start, end)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        with self.files.open_input_file(partition.path) as file:
            for lines in lines_of(file, partition):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(lines, pa.string()),
                        pa.array([partition.path] * len(lines), pa.string()),
                        pa.array([partition.modified] * len(lines), pa.timestamp("us", "UTC")),
                    ],
                    names=["value", "path", "modified"],
                )

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """``spark.readStream.format("growing_lines").load(folder)``; see ``follow_lines`` for the options."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def follow(
    spark: SparkSession,
    path: str,
    pattern: str = "*",
    settle_seconds: float = 60,
    max_bytes_per_trigger: int = 1 << 40,
) -> DataFrame:
    """(value, path, modified): every line of the files below a folder, and those appended later.

    ``pattern`` is a glob on the path below the folder. A half line at the end of a
    file that has not changed for ``settle_seconds`` is taken as a line; if more is written
    to it after all, it comes again, whole. The bytes of a batch are bounded but for the
    first one after a restart. Folders are seen through Arrow's file systems (local paths, and
    URIs it knows), by the driver and by all executors.
    """
    spark.dataSource.register(GrowingLines)
    return (
        spark.readStream.format(NAME)
        .option("pattern", pattern)
        .option("settleSeconds", settle_seconds)
        .option("maxBytesPerTrigger", max_bytes_per_trigger)
        .load(path)
    )


def follow_lines(spark: SparkSession, path: str, pattern: str = "*", **options) -> DataFrame:
    """(value, ingest_ts): as ``stream_lines``, of files that grow; options as in ``follow``."""
    lines = follow(spark, path, pattern, **options)
    return clean_lines(lines.select("value", F.col("modified").alias("ingest_ts")))


def follow_container_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """As ``stream_container_lines``, of ``<container>/<stdout|stderr>*`` files that grow."""
    lines = follow(spark, path, **options)
    place = container_columns(F.col("path"))
    return trim_lines(lines.select("value", F.col("modified").alias("ingest_ts"), *place))
