"""Cost-balanced packing of documents into training sequences.

Each task encodes its own rows in a stream and packs them in groups of about
`group_tokens` tokens, so nothing is shuffled and memory does not grow with the
input.  A group of t tokens gets floor(t / length) full sequences; documents, in
descending order of their cost (linear in the tokens plus quadratic attention),
go to the lowest-cost sequence that has room for them whole; when none has, a
document is cut over the lowest-cost sequences with any room.  What the full
sequences cannot hold fills sequences whose lengths are powers of two, which
need no padding.

Defined cases: a null or empty text is one piece of the end id alone; a document
longer than a sequence is cut into whole sequences first; repeated rows are
separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .encoding import encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def assign(lengths: list[int], sequence: int, linear: float = 1.0, quadratic: float = 1.0 / 4096) -> list[list[tuple[int, int, int]]]:
    """Place documents of these lengths: per sequence its pieces (document, start, length), in order."""
    total = sum(lengths)
    full = total // sequence
    bins: list[list[tuple[int, int, int]]] = []
    short: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        whole = n - n % sequence
        bins += [[(doc, start, sequence)] for start in range(0, whole, sequence)]
        if n > whole:
            short.append((n - whole, doc, whole))

    first, room = len(bins), np.full(full - len(bins), sequence)
    cost = np.zeros(len(room))
    bins += [[] for _ in room]
    rest: list[tuple[int, int, int]] = []
    for n, doc, start in sorted(short, key=lambda x: (-x[0], x[1])):
        need = n
        while n:
            open_ = np.flatnonzero(room >= need)
            if not len(open_):
                if need > 1 and room.any():
                    need = 1  # no sequence has room for it whole: cut it
                    continue
                rest.append((n, doc, start))
                break
            k = open_[cost[open_].argmin()]
            m = int(min(n, room[k]))
            bins[first + k].append((doc, start, m))
            room[k] -= m
            cost[k] += linear * m + quadratic * m * m
            n, start = n - m, start + m

    left, size = 0, sum(n for n, _, _ in rest)
    for n, doc, start in rest:
        while n:
            if not left:
                left = 1 << (size.bit_length() - 1)
                size -= left
                bins.append([])
            m = min(n, left)
            bins[-1].append((doc, start, m))
            n, start, left = n - m, start + m, left - m
    return bins


def pack(docs: DataFrame, vocabulary: str, *, kind: str = "words", sequence: int = 4096, end_id: int = 2, group_tokens: int = 1 << 20, slice_bytes: int | None = None, memo: int | None = None, keep: bool = True) -> DataFrame:
    """Pieces of docs(doc_id, text): see PIECES.  ids are little-endian unsigned 32-bit; a sequence's pieces, by offset, are its tokens.

    slice_bytes and memo bound what the encoder holds at once, where memory is short; without `keep` a worker's tokenizer ends with
    the task (reading it again takes 0.2 s).  The pieces do not depend on them.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(vocabulary, kind, keep)
        enc.slice_bytes, enc.most = slice_bytes or enc.slice_bytes, memo or enc.most
        next_id = TaskContext.get().partitionId() << 33
        held: list[tuple[int | None, memoryview]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, held, size
            bins = assign([len(ids) // 4 for _, ids in held], sequence, 1.0, 1.0 / sequence)
            out: list[list] = [[] for _ in range(7)]
            for pieces in bins:
                offset = 0
                for doc, start, n in pieces:
                    doc_id, ids = held[doc]
                    for column, value in zip(out, (doc_id, start, n, len(ids) // 4, next_id, offset, bytes(ids[4 * start : 4 * (start + n)])), strict=True):
                        column.append(value)
                    offset += n
                next_id += 1
            held, size = [], 0
            types = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            lengths, ids = enc.encode(batch.column(1), end_id)
            data, ends = memoryview(ids.astype("<u4", copy=False)).cast("B"), np.cumsum(lengths).tolist()
            for doc_id, n, stop in zip(batch.column(0).to_pylist(), lengths.tolist(), ends, strict=True):
                held.append((doc_id, data[4 * (stop - n) : 4 * stop]))
                size += n
                if size >= group_tokens:
                    yield from flush()
        if held:
            yield from flush()
        enc.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)
