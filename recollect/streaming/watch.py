"""H8: a streaming source of changed files.

The built-in file stream emits each path once; this one emits a path again whenever it was
modified.  The offset is a time, so a restart goes on where it ended and the state doesn't
grow with the number of files.  Paths that vanish are no rows.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

PATTERNS = "*.md,*.txt,*.json,*.yaml"
#: Larger files are not read (H7).
MAX_BYTES = 1 << 20


class WatchedFiles(DataSource):
    """``spark.readStream.format("watched_files").option("path", ...)``.

    Options: ``path``, ``patterns`` (comma-separated globs), ``existing`` ("true" also emits the
    files that are there at the start).
    """

    @classmethod
    def name(cls) -> str:
        return "watched_files"

    def schema(self) -> str:
        return "path string, mtime double, size bigint, content string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.root = options["path"]
        self.patterns = options.get("patterns", PATTERNS).split(",")
        self.existing = options.get("existing", "false") == "true"

    def initialOffset(self) -> dict:
        return {"until": 0.0 if self.existing else max((s for _, s, _ in self._stamps()), default=0.0)}

    def _stamps(self) -> Iterator[tuple[str, float, os.stat_result]]:
        for folder, _, names in os.walk(self.root):
            for name in names:
                if any(fnmatch.fnmatch(name, p) for p in self.patterns):
                    path = os.path.join(folder, name)
                    try:
                        st = os.stat(path)
                    except OSError:
                        continue
                    # a file that is moved in keeps its time of modification, not of change
                    yield path, max(st.st_mtime, st.st_ctime), st

    def _between(self, start: float, end: float) -> Iterator[tuple]:
        for path, stamp, st in sorted(self._stamps(), key=lambda x: (x[1], x[0])):
            if start < stamp <= end and st.st_size <= MAX_BYTES:
                try:
                    content = open(path, encoding="utf-8").read()
                except (OSError, UnicodeDecodeError):
                    continue
                yield path, st.st_mtime, st.st_size, content

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = max((s for _, s, _ in self._stamps()), default=start["until"])
        end = max(end, start["until"])
        return iter(list(self._between(start["until"], end))), {"until": end}  # the source keeps and copies it

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(list(self._between(start["until"], end["until"])))


