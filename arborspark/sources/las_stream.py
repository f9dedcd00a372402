"""LAS folders as streams: `spark.readStream.format("las")` and `df.writeStream.format("las")`.

Reading: files are taken once each, in the order in which a listing first shows
them, so they must appear whole (moved or committed, not written in place).  What
belongs to a batch is written to the log in the folder `logPath` (option,
shared, one a query) before the batch starts: entry n names the files of offset n.
A restarted query therefore reads the same files for the same offsets, however
the folder, its listing order and the files' times have changed since.
`maxFilesPerTrigger` bounds an entry.  The trigger availableNow does one batch a start, as for
every source in Python; after a failure that is the batch which was planned.  `records`, `minBytes` and
`recordsPerTask` are as in the batch reader.

Writing: every task writes files of its own names; the commit of batch n names
them in `_batches/<queryName>-n.json`.  A batch that comes again after a failure
finds its entry there, and its new files go.  `queryName` (option, "stream") tells
queries apart that write to one folder.

Defined cases: an empty folder gives no batch; files without points and files of
at most `minBytes` are taken and give no rows; a file that is gone when its batch
is read is an error; a batch without rows writes an entry without files.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition

from .las import BATCHES, LasReader, LasWriter, Records, Written, files_of, read_json, write_json


class LasStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        if not options.get("logPath"):
            raise ValueError("a LAS stream needs the option logPath: a shared folder that names the files of each batch")
        self.batch, self.log = LasReader(options), options["logPath"].rstrip("/")
        self.most = int(options.get("maxFilesPerTrigger", 0))
        self.seen: set[str] | None = None  # files of all entries
        self.last = 0

    def _entry(self, n: int) -> str:
        return f"{n:09d}.json"

    def _recall(self) -> None:
        """The entries that earlier runs of this query have written."""
        store, base = fs.FileSystem.from_uri(self.log)
        store.create_dir(base, recursive=True)
        names = sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".json"))
        self.seen, self.last = {path for name in names for path in read_json(store, name)["files"]}, len(names)

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        if self.seen is None:
            self._recall()
        store, base = fs.FileSystem.from_uri(self.batch.path)
        new = [f for f in files_of(store, base) if f.path not in self.seen]
        new.sort(key=lambda f: (f.mtime_ns or 0, f.path))
        new = [f.path for f in new[: self.most or None]]
        if new:
            log, folder = fs.FileSystem.from_uri(self.log)
            write_json(log, f"{folder}/{self._entry(self.last + 1)}", {"first": len(self.seen), "files": new})
            self.seen.update(new)
            self.last += 1
        return {"entry": self.last}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        log, folder = fs.FileSystem.from_uri(self.log)
        store, _ = fs.FileSystem.from_uri(self.batch.path)
        parts: list[Records] = []
        for n in range(start["entry"] + 1, end["entry"] + 1):
            entry = read_json(log, f"{folder}/{self._entry(n)}")
            sizes = store.get_file_info(entry["files"])
            for i, f in enumerate(sizes):
                if f.type != fs.FileType.File:
                    raise FileNotFoundError(f"{f.path}, a file of entry {n} of {self.log}")
                if not self.batch.least or f.size > self.batch.least:
                    parts += self.batch.parts_of(store, f.path, entry["first"] + i)
        return parts or [Records("", 0, 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        return self.batch.read(partition)


class LasStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.path, self.query = options["path"], options.get("queryName", "stream")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return LasWriter.write(self, iterator)

    def commit(self, messages, batchId: int) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(f"{base}/{BATCHES}", recursive=True)
        entry = f"{base}/{BATCHES}/{self.query}-{batchId:09d}.json"
        if store.get_file_info(entry).type == fs.FileType.File:
            self.abort(messages, batchId)
            return
        write_json(store, entry, sorted(p.removeprefix(f"{base}/") for m in messages if m for p in m.paths))

    def abort(self, messages, batchId: int) -> None:
        LasWriter.abort(self, messages)
