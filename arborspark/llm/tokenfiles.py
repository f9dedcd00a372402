"""Token-id files: concatenated ids with Elias-Fano encoded document boundaries.

A file holds one range of doc_id.  Layout, little-endian:

    the ids, u * width bytes
    boundaries: Elias-Fano of the n ends (non-decreasing, at most u)
    doc_ids: Elias-Fano of doc_id - least of the documents that have one
    the foot: magic "AEF2"; id width in bytes (2 or 4) u32; documents n u64; ids u u64;
    least doc_id i64; documents without an id u64; span of the ids u64

Elias-Fano of n values up to u keeps l = floor(log2(u / n)) low bits of each
packed, and the high parts in unary in a bit vector of n + (u >> l) + 1 bits:
about 2 + l bits a value instead of 64.  select(i) is the position of the i-th
set bit; a directory of every 256th set bit bounds the scan.  Readers find a run
of documents by select and decode no boundary outside it.

Texts are encoded where they are read, and only their ids are shuffled, to
ranges found from a bounded sample of (doc_id, text hash, size).  Rows equal to
a bound of several ranges (one id or one row many times) are dealt over them.

Defined cases: a null or empty text is its end id alone; null doc_ids come
first; equal doc_ids are ordered by a hash of the text; an empty table writes no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .encoding import encoder

_FOOT = np.dtype([("magic", "S4"), ("width", "<u4"), ("docs", "<u8"), ("ids", "<u8"), ("least", "<i8"), ("nulls", "<u8"), ("span", "<u8")])
_EVERY = 256
_CHUNK = 1 << 16

MANIFEST = "part long, place long, path string, docs long, ids long"
ROWS = "doc_id long, start long, n_tokens long, ids binary"


def low_bits(n: int, top: int) -> int:
    return max(0, (top // max(n, 1)).bit_length() - 1)


def ef_bytes(n: int, top: int) -> tuple[int, int, int]:
    """Bytes of the low part, the high part and the select directory."""
    low = low_bits(n, top)
    return -(-n * low // 8), -(-(n + (top >> low) + 1) // 8), 8 * -(-n // _EVERY)


def ef_encode(values: np.ndarray, top: int) -> bytes:
    """Elias-Fano code of non-decreasing unsigned values, none above top; low bits are packed a chunk at a time."""
    n, v = len(values), values.astype("<u8")
    low = low_bits(n, top)
    a, b, _ = ef_bytes(n, top)
    lows = []
    for at in range(0, n if low else 0, _CHUNK):  # a multiple of 8 values fills whole bytes
        bits = ((v[at : at + _CHUNK, None] >> np.arange(low, dtype="<u8")) & 1).astype(np.uint8)
        lows.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    ones = (v >> np.uint64(low)).astype("<i8") + np.arange(n)
    high = np.zeros(8 * b, np.uint8)
    high[ones] = 1
    return b"".join(lows).ljust(a, b"\0") + np.packbits(high, bitorder="little").tobytes() + ones[::_EVERY].astype("<u8").tobytes()


class EliasFano:
    """Read side of ef_encode: select(i), and runs of values."""

    def __init__(self, data: bytes, n: int, top: int):
        a, b, _ = ef_bytes(n, top)
        self.n, self.low = n, low_bits(n, top)
        self.lows = np.frombuffer(data[:a], np.uint8)
        self.high = np.frombuffer(data[a : a + b], np.uint8)
        self.at = np.frombuffer(data[a + b :], "<u8")

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), "<u8")
        for k in range(self.low):
            bit = i * self.low + k
            out |= ((self.lows[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype("<u8") << np.uint64(k)
        return out

    def run(self, first: int, stop: int) -> np.ndarray:
        """The values first to stop - 1, from the directory entries around them and the bits between."""
        if stop <= first:
            return np.zeros(0, "<u8")
        from_, last = int(self.at[first // _EVERY]), -(-stop // _EVERY)
        to = int(self.at[last]) if last < len(self.at) else 8 * len(self.high)
        bits = np.unpackbits(self.high[from_ >> 3 : (to + 7) >> 3], bitorder="little")[from_ & 7 :]
        skip = first % _EVERY
        ones = from_ + np.flatnonzero(bits)[skip : skip + stop - first]
        i = np.arange(first, stop)
        return ((ones - i).astype("<u8") << np.uint64(self.low)) | self._low(i)

    def select(self, i: int) -> int:
        """The i-th value."""
        return int(self.run(i, i + 1)[0])

    def above(self, x: int, first: int) -> int:
        """The first position from `first` on whose value is over x, by halving."""
        low, high = first, self.n
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.select(middle) > x else (middle + 1, high)
        return low


class _File:
    """One file in the making: ids are written as they come, boundaries and doc_ids stay in memory until the end."""

    def __init__(self, store: fs.FileSystem, path: str, width: int):
        self.path, self.width, self.total, self.nulls = path, width, 0, 0
        self.out = store.open_output_stream(path)
        self.ends: list[np.ndarray] = []
        self.names: list[np.ndarray] = []

    def add(self, doc_ids: pa.Array, ids: pa.Array) -> None:
        sizes = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64) // self.width
        for some in ids:
            self.out.write(some.as_buffer())
        self.ends.append(self.total + np.cumsum(sizes))
        self.total = int(self.ends[-1][-1])
        self.nulls += doc_ids.null_count
        self.names.append(doc_ids.drop_null().to_numpy())

    def finish(self, part: int, place: int) -> pa.RecordBatch:
        doc_ids, bounds = np.concatenate(self.names).astype("<i8"), np.concatenate(self.ends)
        least = int(doc_ids[0]) if len(doc_ids) else 0
        span = int(doc_ids[-1]) - least if len(doc_ids) else 0
        self.out.write(ef_encode(bounds, self.total))
        self.out.write(ef_encode((doc_ids - least).view("<u8"), span))
        foot = np.zeros(1, _FOOT)
        foot[0] = (b"AEF2", self.width, len(bounds), self.total, least, self.nulls, span)
        self.out.write(foot.tobytes())
        self.out.close()
        row = {"part": [part], "place": [place], "path": [self.path], "docs": [len(bounds)], "ids": [self.total]}
        return pa.RecordBatch.from_pydict(row)


def range_bounds(sample: np.ndarray, sizes: np.ndarray, parts: int) -> np.ndarray:
    """parts - 1 bounds, in order, that cut sorted keys into ranges of about equal size."""
    if not len(sample):
        return sample[:0]
    until = np.cumsum(sizes, dtype=np.float64)
    return sample[np.minimum(np.searchsorted(until, until[-1] * np.arange(1, parts) / parts), len(sample) - 1)]


def place_in(bounds: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The range of every key; keys equal to bounds are dealt over all ranges that they may stand in."""
    left, right = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
    return left + np.arange(len(keys)) % (right - left + 1)


_KEY = np.dtype([("named", "?"), ("doc_id", "<i8"), ("tie", "<i8")])


def _keys(doc_ids: pa.Array, ties: pa.Array) -> np.ndarray:
    out = np.zeros(len(doc_ids), _KEY)
    out["named"] = doc_ids.is_valid().to_numpy(zero_copy_only=False)
    out["doc_id"] = doc_ids.fill_null(0).to_numpy()
    out["tie"] = ties.to_numpy()
    return out


def write_files(docs: DataFrame, vocabulary: str, folder: str, *, kind: str = "bytes", end_id: int = 2, file_ids: int = 1 << 26, part_mb: int = 128, sample: int = 1 << 20) -> DataFrame:
    """Write docs(doc_id, text) as token-id files under folder (any URI that pyarrow opens); returns the manifest, one row per file.

    Rows are dealt by ranges of doc_id, of about part_mb of text at most, so files
    follow each other in ascending doc_id; the ranges are found from at most about
    `sample` rows.  A task writes to a name of its own and the manifest lists only
    the files of tasks that ended well, so a task that runs twice does no harm.  A
    task begins a new file after file_ids ids, so its memory does not grow.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tie"), F.col("text").cast("string").alias("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, min(n, max(min(4 * cores, size >> 22), -(-size // (part_mb << 20)))))
    some = rows.select("doc_id", "tie", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"))
    share = min(256 * parts, sample) / max(1, n)
    some = (some.sample(share, seed=1) if share < 1 else some).toArrow().combine_chunks()
    keys = _keys(some["doc_id"].combine_chunks(), some["tie"].combine_chunks())
    order = np.argsort(keys, kind="stable")
    bounds = spark.sparkContext.broadcast(range_bounds(keys[order], some["size"].to_numpy()[order], parts))  # parts - 1 keys

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, kind)
        width = _width(enc.size, end_id)
        for batch in batches:
            doc_ids, ties = batch.column(0), batch.column(1)
            lengths, ids = enc.encode(batch.column(2), end_id)
            ends = width * np.concatenate([[0], np.cumsum(lengths)])
            data = memoryview(ids.astype(f"<u{width}")).cast("B")
            to = pa.array(place_in(bounds.value, _keys(doc_ids, ties)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([to, doc_ids, ties, pa.array([bytes(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["to", "doc_id", "tie", "ids"])
        enc.forget()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, width = TaskContext.get().partitionId(), _width(encoder(vocabulary, kind).size, end_id)
        store, base = fs.FileSystem.from_uri(folder)
        file, place = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if file is None:
                store.create_dir(base, recursive=True)
                file = _File(store, f"{base}/part-{part:06d}-{uuid.uuid4().hex}.aef", width)
            file.add(batch.column(0), batch.column(1))
            if file.total >= file_ids:
                yield file.finish(part, place)
                file, place = None, place + 1
        if file is not None:
            yield file.finish(part, place)

    encoded = rows.mapInArrow(encode, "to int, doc_id long, tie long, ids binary")
    dealt = encoded.repartitionById(parts, F.col("to")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "ids")
    return dealt.select("doc_id", "ids").mapInArrow(write, MANIFEST)


def _width(vocabulary: int, end_id: int) -> int:
    return 2 if max(vocabulary, end_id + 1) <= 65536 else 4


def read_files(manifest: DataFrame, folder: str, *, run_ids: int = 1 << 20) -> DataFrame:
    """The documents of files(path, base): doc_id, start (ids before it in all files), n_tokens, ids (32-bit).

    A task holds the compressed boundaries of one file, and the documents of about run_ids ids at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_file(path) as file:
                    yield from _read(file, base)

    def _read(file, base: int) -> Iterator[pa.RecordBatch]:
        file.seek(file.size() - _FOOT.itemsize)
        foot = np.frombuffer(file.read(_FOOT.itemsize), _FOOT)[0]
        if foot["magic"] != b"AEF2":
            raise ValueError("not a token-id file")
        n, total, width, nulls, span = (int(foot[k]) for k in ("docs", "ids", "width", "nulls", "span"))
        file.seek(total * width)
        bounds = EliasFano(file.read(sum(ef_bytes(n, total))), n, total)
        names = EliasFano(file.read(sum(ef_bytes(n - nulls, span))), n - nulls, span)
        at = begin = 0
        while at < n:
            stop = max(at + 1, bounds.above(begin + run_ids, at))
            ends = bounds.run(at, stop).astype("<i8")
            starts = np.concatenate([[begin], ends[:-1]])
            file.seek(begin * width)
            ids = np.frombuffer(file.read(int(ends[-1] - begin) * width), f"<u{width}").astype("<u4").tobytes()
            cut = (4 * (np.append(starts, ends[-1]) - begin)).tolist()
            named = names.run(max(0, at - nulls), max(0, stop - nulls)).astype("<i8") + foot["least"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None] * (stop - at - len(named)) + named.tolist(), pa.int64()),
                    pa.array(starts + base, pa.int64()),
                    pa.array(ends - starts, pa.int64()),
                    pa.array([ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                ],
                names=["doc_id", "start", "n_tokens", "ids"],
            )
            at, begin = stop, int(ends[-1])

    return manifest.mapInArrow(run, ROWS)


def encode_and_read(docs: DataFrame, vocabulary: str, folder: str, *, kind: str = "bytes", end_id: int = 2, file_ids: int = 1 << 26) -> DataFrame:
    """Write the files and read all documents back.  The driver sees one manifest row per file."""
    spark = docs.sparkSession
    files = sorted(write_files(docs, vocabulary, folder, kind=kind, end_id=end_id, file_ids=file_ids).collect(), key=lambda r: (r.part, r.place))
    base, placed = 0, []
    for f in files:
        placed.append((f.path, base))
        base += f.ids
    listed = spark.createDataFrame(placed, "path string, base long")
    return read_files(listed.repartition(max(1, len(placed))), folder)
