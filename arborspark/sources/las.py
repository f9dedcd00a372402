"""LAS point files as a Spark data source: `spark.read.format("las")` and `df.write.format("las")`.

The public ASPRS layout, uncompressed.  Reading: LAS 1.0 to 1.4 with point formats
0 to 10, other files are an error; one task for each range of records, only the
needed bytes of a record are decoded, and filters on cls and on x and y reach the
reader.  Where a folder has `_files.json` or `_batches` (see las_stream), the files named
there are read and no others, so that those of failed attempts never count; else all .las files under it.  Files of
at most `minBytes` bytes (option, 0) are skipped.  Writing (LAS 1.2): one file a
scene and task, point format 3, scale 0.001, offsets at the scene's minimum, so
coordinates are whole millimetres.  Paths are URIs that pyarrow's file systems open.

With the option `records` rows also hold their file and the bytes of their record.
Rows with these two columns are written as they were read: one file a source and
task, with the source's header and variable-length records, new counts and bounds.
Extended records at a file's end (LAS 1.4) are left out.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..operators.points import polygon_crop

SCHEMA = "scene_id int, pid long, x double, y double, z double, cls int"
WITH_RECORDS = SCHEMA + ", source string, record binary"

#: The public header block of LAS 1.2.
HEADER = np.dtype(
    [
        ("signature", "S4"), ("source_id", "<u2"), ("encoding", "<u2"), ("guid", "V16"), ("major", "u1"), ("minor", "u1"), ("system", "S32"), ("software", "S32"),
        ("day", "<u2"), ("year", "<u2"), ("header_size", "<u2"), ("offset_to_points", "<u4"), ("vlrs", "<u4"), ("format", "u1"), ("record_length", "<u2"), ("points", "<u4"),
        ("by_return", "<u4", 5), ("scale", "<f8", 3), ("offset", "<f8", 3), ("max_x", "<f8"), ("min_x", "<f8"), ("max_y", "<f8"), ("min_y", "<f8"), ("max_z", "<f8"), ("min_z", "<f8"),
    ]
)
MANIFEST = "_files.json"
#: Folder of the manifests that a stream writes, one a batch.
BATCHES = "_batches"
#: Bytes of a record by point format, and where LAS 1.4 has its 64-bit point count.
LENGTHS = (20, 28, 26, 34, 57, 63, 30, 36, 38, 59, 67)
POINTS_AT = 247
#: The fields that follow the header of LAS 1.2 in LAS 1.4, at byte 227.
HEADER_14 = np.dtype([("waveforms_at", "<u8"), ("extended_at", "<u8"), ("extended", "<u4"), ("points", "<u8"), ("by_return", "<u8", 15)])
#: The byte of a record that holds its return number.
RETURN_AT = 14
#: Point data record format 3.
RECORD = np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("flags", "u1"), ("cls", "u1"), ("angle", "i1"), ("user", "u1"), ("point_source", "<u2"), ("time", "<f8"), ("red", "<u2"), ("green", "<u2"), ("blue", "<u2")])


def header_of(file) -> np.void:
    head = np.frombuffer(file.read(HEADER.itemsize), HEADER)[0]
    if head["signature"] != b"LASF":
        raise ValueError("not a LAS file")
    if head["format"] & 0x80:
        raise ValueError("compressed LAZ needs a codec that is not here; decompress it first")
    if head["major"] != 1 or head["minor"] > 4 or head["format"] >= len(LENGTHS) or head["record_length"] < LENGTHS[head["format"]]:
        raise ValueError(f"LAS {head['major']}.{head['minor']}, point format {head['format']} of {head['record_length']} bytes is not supported")
    return head


def points_of(file, head: np.void) -> int:
    """The point count; that of LAS 1.4 stands in a field of its own."""
    if head["minor"] < 4:
        return int(head["points"])
    file.seek(POINTS_AT)
    return int(np.frombuffer(file.read(8), "<u8")[0])


def head_of_part(prefix: bytes, records: np.ndarray) -> bytes:
    """The bytes before a file's records, with the counts and bounds of these records (rows of bytes) instead of all."""
    out = bytearray(prefix)
    head = np.frombuffer(out, HEADER, 1)
    wide, n = head["format"][0] >= 6, len(records)
    for i, c in enumerate("xyz"):
        v = np.ascontiguousarray(records[:, 4 * i : 4 * i + 4]).view("<i4") * head["scale"][0, i] + head["offset"][0, i]
        head[f"min_{c}"], head[f"max_{c}"] = v.min(), v.max()
    returns = np.bincount(records[:, RETURN_AT] & (15 if wide else 7), minlength=16)[1:]
    old = not wide and n < 1 << 32
    head["points"], head["by_return"] = (n, returns[:5]) if old else (0, 0)
    if head["minor"][0] >= 4:
        more = np.frombuffer(out, HEADER_14, 1, HEADER.itemsize)
        more["points"], more["by_return"] = n, returns
        more["waveforms_at"] = more["extended_at"] = more["extended"] = 0
    return bytes(out)


def read_json(store, path: str):
    with store.open_input_stream(path) as file:
        return json.loads(file.read())


def write_json(store, path: str, value) -> None:
    """The whole file or none: it is written under another name first."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(json.dumps(value).encode())
    store.move(part, path)


def files_of(store, base: str) -> list:
    """The .las and .laz files of a path: those its manifests name, or all under it."""
    info = store.get_file_info(base)
    if info.type == fs.FileType.File:
        return [info]
    batches = store.get_file_info(fs.FileSelector(f"{base}/{BATCHES}", allow_not_found=True))
    manifests = [f.path for f in batches if f.path.endswith(".json")]
    if store.get_file_info(f"{base}/{MANIFEST}").type == fs.FileType.File:
        manifests.append(f"{base}/{MANIFEST}")
    if manifests:
        found = store.get_file_info([f"{base}/{name}" for path in manifests for name in read_json(store, path)])
        if lost := [f.path for f in found if f.type != fs.FileType.File]:
            raise FileNotFoundError(f"named in a manifest of {base}: {lost}")
    else:
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((f for f in found if f.path.lower().endswith((".las", ".laz"))), key=lambda f: f.path)


@dataclass
class Records(InputPartition):
    path: str
    first: int
    count: int
    scene: int


def with_records(options: dict) -> bool:
    return str(options.get("records", "false")).lower() == "true"


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step, self.filters = options["path"], int(options.get("recordsPerTask", 4_000_000)), []
        self.least, self.records = int(options.get("minBytes", 0)), with_records(options)

    def pushFilters(self, filters):
        """Comparisons of cls, x, y and z with literals are applied to the record arrays."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) else None
            if name in ("cls", "x", "y", "z"):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        store, base = fs.FileSystem.from_uri(self.path)
        parts = [part for i, f in enumerate(files_of(store, base)) if not self.least or f.size > self.least for part in self.parts_of(store, f.path, i)]
        return parts or [Records("", 0, 0, 0)]

    def parts_of(self, store, path: str, number: int) -> list[Records]:
        """Ranges of a file's records; its scene is in its name, else its number."""
        with store.open_input_file(path) as file:
            n = points_of(file, header_of(file))
        named = re.match(r"scene-(\d+)-", path.rsplit("/", 1)[-1])
        scene = int(named[1]) if named else number
        return [Records(path, at, min(self.step, n - at), scene) for at in range(0, n, self.step)]

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(part.path) as file:
            head = header_of(file)
            length = int(head["record_length"])
            wide = head["format"] >= 6  # a whole byte for the class
            names = ["x", "y", "z", "cls"]
            layout = np.dtype({"names": names, "formats": [RECORD[n].str for n in names], "offsets": [RECORD.fields[n][1] for n in names[:3]] + [16 if wide else RECORD.fields["cls"][1]], "itemsize": length})
            for at in range(part.first, part.first + part.count, 1 << 18):
                n = min(1 << 18, part.first + part.count - at)
                file.seek(int(head["offset_to_points"]) + at * length)
                data = file.read(n * length)
                r = np.frombuffer(data, layout)
                v = {c: r[c] * head["scale"][i] + head["offset"][i] for i, c in enumerate("xyz")} | {"cls": (r["cls"] & (255 if wide else 31)).astype(np.int32)}
                keep = np.ones(n, bool)
                for f in self.filters:
                    keep &= self._holds(f, v[f.attribute[0]])
                out = {"scene_id": np.full(n, part.scene, np.int32), "pid": np.arange(at, at + n), **{c: v[c] for c in "xyz"}, "cls": v["cls"]}
                columns = {name: pa.array(c[keep]) for name, c in out.items()}
                if self.records:
                    rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), n, [None, pa.py_buffer(data)]).filter(pa.array(keep))
                    columns |= {"source": pa.repeat(part.path, len(rows)), "record": rows.cast(pa.binary())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    @staticmethod
    def _holds(f, column: np.ndarray) -> np.ndarray:
        match f:
            case EqualTo():
                return column == f.value
            case In():
                return np.isin(column, list(f.value))
            case GreaterThan():
                return column > f.value
            case GreaterThanOrEqual():
                return column >= f.value
            case LessThan():
                return column < f.value
            case _:
                return column <= f.value


@dataclass
class Written(WriterCommitMessage):
    paths: list


class LasWriter(DataSourceArrowWriter):
    """A file's scene is in its name.  Every task writes its scenes to names of its own; commit names the files of successful tasks in the manifest, with those that were there."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path = options["path"]
        store, base = fs.FileSystem.from_uri(self.path)
        found = [] if overwrite else [f.path.removeprefix(f"{base}/") for f in files_of(store, base)]
        streamed = {name for f in store.get_file_info(fs.FileSelector(f"{base}/{BATCHES}", allow_not_found=True)) if f.path.endswith(".json") for name in read_json(store, f.path)}
        if overwrite and streamed:
            raise ValueError("a folder that a stream writes to cannot be overwritten by a batch")
        self.before = [name for name in found if name not in streamed]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        held: dict[int, list[pa.RecordBatch]] = {}
        whole: dict[tuple[int, str], list[pa.RecordBatch]] = {}
        for b in batches:
            if "record" in b.schema.names:
                named = b.select(["scene_id", "source"])
                for key in pa.Table.from_batches([named]).group_by(["scene_id", "source"]).aggregate([]).to_pylist():
                    same = pc.and_(pc.equal(named.column(0), key["scene_id"]), pc.equal(named.column(1), key["source"]))
                    whole.setdefault((key["scene_id"], key["source"]), []).append(b.select(["record"]).filter(same))
                continue
            scenes = b.column("scene_id").to_numpy()
            for s in np.unique(scenes):
                held.setdefault(int(s), []).append(b.filter(pa.array(scenes == s)))
        paths = []
        for scene, parts in held.items():
            t = pa.Table.from_batches(parts)
            xyz = np.stack([t.column(c).to_numpy() for c in "xyz"], axis=1)
            head, records = np.zeros(1, HEADER), np.zeros(len(xyz), RECORD)
            low, high = xyz.min(axis=0), xyz.max(axis=0)
            for i, c in enumerate("xyz"):
                records[c] = np.rint((xyz[:, i] - low[i]) / 0.001)
                head[f"min_{c}"], head[f"max_{c}"] = low[i], high[i]
            records["cls"] = t.column("cls").to_numpy()
            head["signature"], head["major"], head["minor"], head["format"] = b"LASF", 1, 2, 3
            head["header_size"] = head["offset_to_points"] = HEADER.itemsize
            head["record_length"], head["points"], head["scale"], head["offset"] = RECORD.itemsize, len(xyz), 0.001, low
            paths.append(f"{base}/scene-{scene:06d}-{uuid.uuid4().hex}.las")
            with store.open_output_stream(paths[-1]) as out:
                out.write(head.tobytes())
                out.write(records.tobytes())
        for (scene, source), parts in whole.items():
            with store.open_input_file(source) as file:
                head = header_of(file)
                file.seek(0)
                prefix = file.read(int(head["offset_to_points"]))
            data = b"".join(r for b in parts for r in b.column(0).to_pylist())
            paths.append(f"{base}/scene-{scene:06d}-{uuid.uuid4().hex}.las")
            with store.open_output_stream(paths[-1]) as out:
                out.write(head_of_part(prefix, np.frombuffer(data, np.uint8).reshape(-1, int(head["record_length"]))))
                out.write(data)
        return Written(paths)

    def commit(self, messages) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        names = [p.removeprefix(f"{base}/") for m in messages if m for p in m.paths]
        write_json(store, f"{base}/{MANIFEST}", sorted(self.before + names))

    def abort(self, messages) -> None:
        store, _ = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for p in m.paths if m else ():
                store.delete_file(p)


class LasDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return WITH_RECORDS if with_records(self.options) else SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(self.options)

    def writer(self, schema, overwrite: bool) -> LasWriter:
        return LasWriter(self.options, overwrite)

    def streamReader(self, schema):
        from .las_stream import LasStreamReader

        return LasStreamReader(self.options)

    def streamWriter(self, schema, overwrite: bool):
        from .las_stream import LasStreamWriter

        return LasStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasDataSource)


def crop(spark: SparkSession, path: str, target: str, polygon: list[tuple[float, float]], **options) -> DataFrame:
    """Write the records of all files under path inside the polygon to target, whole, and return the points written.

    Every task writes what it reads, so nothing is shuffled; a file of more than
    recordsPerTask records becomes several.  Of files without points inside, and
    for polygons of fewer than three vertices, nothing is written.
    """
    found = spark.read.format("las").options(records="true", **options).load(path)
    polygon_crop(found, polygon).write.format("las").mode("append").save(target)
    return spark.read.format("las").load(target)
