"""Log files that grow and are rotated, as a streaming source of finished lines.

An offset names each file with a hash of its first line and how many of its bytes
were there. An epoch reads the bytes between two offsets in pieces, one task
each. A line belongs to the piece its line end is in; the reader looks back to
where the line starts, so the unfinished last line of an epoch is read with the
next one and nothing is carried along. A file that was renamed goes on where it
was; a name that has got another first line, or has become shorter, is a new file.
What is left of a file deleted between two epochs is not read.
"""

import fnmatch
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, log string, at long, file_ms long, line string"
# Bytes of a piece, of one look back for a line's start, and lines of one Arrow batch.
PIECE = 32 << 20
LOOK_BACK = 64 << 10
BATCH_LINES = 8192


class Piece(InputPartition):
    def __init__(self, path, first, start, end, file_ms):
        self.path, self.first, self.start, self.end, self.file_ms = path, first, start, end, file_ms


def folder_of(path):
    return path.rpartition("/")[0]


def first_line(system, path):
    """Hash of the finished first line of a file, None while there is none."""
    text = b""
    with system.open_input_file(path) as source:
        while b"\n" not in text:
            more = source.read(LOOK_BACK)
            if not more:
                return None
            text += more
    return zlib.crc32(text[: text.index(b"\n")])


def resumed(path, first, size, start, end):
    """The byte from which a file is read on: what an earlier offset says of it, under this or its former name."""
    known = start.get(path)
    if known is None or known[0] != first:
        moved = [
            (seen, name) for name, (mark, seen, _) in start.items()
            if mark == first and folder_of(name) == folder_of(path) and end.get(name, [None])[0] != first
        ]
        known = [first, max(moved)[0]] if moved else [first, 0]
    return known[1] if known[1] <= size else 0


def line_start(source, at):
    """Start of the line that the byte before ``at`` is in or ends: just after the last line end before ``at``."""
    while at > 0:
        begin = max(0, at - LOOK_BACK)
        source.seek(begin)
        found = source.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


def lines_ending_in(source, start, end):
    """Lines with their end's offset, of those whose line end is in ``[start, end)``."""
    begin = line_start(source, start)
    source.seek(begin)
    text = source.read(end - begin)
    place = 0
    while (stop := text.find(b"\n", place)) >= 0:
        yield begin + stop, text[place:stop].removesuffix(b"\r").decode("utf-8", "replace")
        place = stop + 1


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.system, self.folder = fs.FileSystem.from_uri(options["path"])
        self.glob = options.get("glob", "*")
        self.max_bytes = int(options["maxbytes"]) if "maxbytes" in options else None
        self._marks = {}

    def _mark(self, info):
        """First-line hash of a file, read again only if the file has changed."""
        state = (info.size, info.mtime_ns)
        if self._marks.get(info.path, (None,))[0] != state:
            self._marks[info.path] = (state, first_line(self.system, info.path))
        return self._marks[info.path][1]

    def initialOffset(self):
        return {}

    def latestOffset(self):
        files = self.system.get_file_info(fs.FileSelector(self.folder, recursive=True))
        offset = {}
        for info in files:
            if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, self.glob) and not info.base_name.startswith((".", "_")):
                mark = self._mark(info)
                if mark is not None:
                    size = info.size if self.max_bytes is None else min(info.size, self.max_bytes)
                    offset[info.path] = [mark, size, info.mtime_ns // 1_000_000]
        return offset

    def partitions(self, start, end):
        pieces = []
        for path, (first, size, file_ms) in end.items():
            begin = resumed(path, first, size, start, end)
            pieces += [Piece(path, first, at, min(at + PIECE, size), file_ms) for at in range(begin, size, PIECE)]
        return pieces or [None]

    def _named_now(self, piece):
        """The file of a piece, which may have been renamed since."""
        names = [piece.path]
        names += [i.path for i in self.system.get_file_info(fs.FileSelector(folder_of(piece.path))) if i.type == fs.FileType.File]
        for name in names:
            if self.system.get_file_info(name).type == fs.FileType.File and first_line(self.system, name) == piece.first:
                return name
        raise FileNotFoundError(f"{piece.path} was deleted or replaced before it was read")

    def read(self, piece):
        if piece is None:
            return
        log = f"{folder_of(piece.path)}#{piece.first}"
        names = ["file", "log", "at", "file_ms", "line"]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

        def batch(rows):
            columns = [[piece.path] * len(rows), [log] * len(rows), [at for at, _ in rows], [piece.file_ms] * len(rows), [t for _, t in rows]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        rows = []
        with self.system.open_input_file(self._named_now(piece)) as source:
            for row in lines_ending_in(source, piece.start, piece.end):
                rows.append(row)
                if len(rows) == BATCH_LINES:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class GrowingLogs(DataSource):
    @classmethod
    def name(cls):
        return "growing_logs"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return GrowingReader(self.options)


def stream_growing_logs(spark, path, glob="*", max_bytes=None):
    """Finished lines of the log files below a folder as a stream: ``file, log, at, file_ms, line``.

    ``log`` stays the same when a file is renamed, ``at`` is where the line ends
    in it. With ``max_bytes`` only so much of the start of each file is read yet.
    """
    spark.dataSource.register(GrowingLogs)
    reader = spark.readStream.format("growing_logs").option("path", path).option("glob", glob)
    return (reader if max_bytes is None else reader.option("maxbytes", str(max_bytes))).load()
