"""A stream of the complete lines that files gain: the file source alone does not read a file it has seen again.

Offsets are, by path: bytes taken, inode, and length and hash of the file's first bytes; they hold all that is needed to go
on after a restart. A file that shrank, was replaced or rewritten starts anew. The driver lists files and looks at the ends of
those that changed; the bytes are read in tasks."""

from __future__ import annotations

import glob
import hashlib
import json
import os

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PREFIX = 4096
PIECE = 64 << 20  # bytes of a file that one task reads


def _prefix(path: str, n: int) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read(n)).hexdigest()


def _last_line_end(path: str, start: int, stop: int) -> int:
    """End of the last complete line in [start, stop); ``start`` if there is none. Read backwards in blocks."""
    with open(path, "rb") as f:
        end = stop
        while end > start:
            at = max(start, end - PREFIX)
            f.seek(at)
            found = f.read(end - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            end = at
    return start


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str):
        self.pattern = pattern
        self.known: dict[str, tuple] = {}  # by path: size, time and inode when it was last opened, and its entry

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        known = {}
        for path in sorted(glob.glob(self.pattern, recursive=True)):
            st = os.stat(path)
            seen = (st.st_size, st.st_mtime_ns, st.st_ino)
            if path in self.known and self.known[path][0] == seen:  # only files that changed are opened
                known[path] = self.known[path][1]
                continue
            n = min(st.st_size, PREFIX)
            known[path] = {"at": _last_line_end(path, 0, st.st_size), "inode": st.st_ino, "n": n, "hash": _prefix(path, n)}
            self.known[path] = (seen, known[path])
        return {"files": json.dumps(known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        a, b = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, k in b.items():
            had, at = a.get(path), 0
            if had and had["inode"] == k["inode"] and had["at"] <= k["at"] and _prefix(path, had["n"]) == had["hash"]:
                at = had["at"]
            while at < k["at"]:
                stop = min(at + PIECE, k["at"])
                if stop < k["at"]:
                    stop = _last_line_end(path, at, stop)
                    stop = stop if stop > at else k["at"]  # a line longer than a piece
                out.append(Piece(path, at, stop))
                at = stop
        return out

    def read(self, partition: Piece):
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                yield partition.path, at, line.rstrip(b"\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """``spark.dataSource.register(TailSource)``; ``readStream.format("tail").option("path", "/in/**/*.jsonl").load()``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, at long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])
