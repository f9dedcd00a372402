"""Tables, shared scratch space and small column helpers for the operators."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, new_path, shared_dir
from ..scratch import written as staged
from ..session import table

__all__ = ["WORD", "bounded_batches", "discard", "held_out", "new_path", "release_memory", "shared_dir", "staged", "table"]

#: A word is a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession, mb: int = 8) -> None:
    """Bound the bytes of an Arrow batch, so that long texts do not fill a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("bB")) > mb << 20:
        spark.conf.set(key, str(mb << 20))


def release_memory() -> None:
    """Give free memory back to the system at the end of a task, for Python workers live on beside the next stage's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the documents that no model learns from; null ids are held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(True))
