"""What several operators share: Arrow slices, the shared folder, hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.plans.storage import checkpointed, discard, materialise, new_path, shared_dir

# Text bytes and rows that are worked on at once inside a Python worker.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 4096
_LIBC = ctypes.CDLL(None)


def small_batches(spark: SparkSession) -> SparkSession:
    """Have this session's queries hand whole texts to Python 2,000 rows at a time: an Arrow batch exists some four times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


# How each operator empties the caches that its Python workers keep from task to task.
CACHES: dict[str, Callable[[], None]] = {}


def sole(name: str | None = None) -> None:
    """Empty other operators' caches: a Python worker serves one operator after the other."""
    emptied = [clear for other, clear in CACHES.items() if other != name]
    for clear in emptied:
        clear()
    if emptied:
        release()


def release() -> None:
    """Give freed memory back to the system: Python workers are used again, by other operators too."""
    gc.collect()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each part holds about `limit` bytes of `column` and at most `rows` rows.

    A text longer than that stands alone, whole.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes.tolist()):
            if (held and held + size > limit) or i - start >= rows:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
    release()


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def crc32_mod(column: str, n: int):
    """crc32 of a column's text, modulo n (null for null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


# A bitmap has so many bits for each value, a power of two in all, and at most 2 ** BITMAP_BITS: 4 MB.
BITS_EACH, BITMAP_BITS = 32, 25


class Bitmap:
    """A hash bitmap of values, written: `words` has a row for each 64 bits that aren't all 0."""

    def __init__(self, df: DataFrame, *cols: Column):
        n = df.count()
        self.bits = min(BITMAP_BITS, max(6, (BITS_EACH * n).bit_length()))
        h = F.pmod(F.xxhash64(*cols), F.lit(1 << self.bits)).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63))
        words = df.select(F.shiftright(h, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        self.words = materialise(words, "bitmap")

    def split(self, df: DataFrame, *cols: Column) -> tuple[DataFrame, DataFrame]:
        """The rows whose values in `cols` may be in the bitmap, and those whose values surely aren't.

        The bitmap is broadcast, as its size is bounded; a full one only sends more rows to the first part.
        """
        word, bits, h = fresh(df, "word", "bits", "h")
        marked = df.withColumn(h, F.pmod(F.xxhash64(*cols), F.lit(1 << self.bits)).cast("int"))
        marked = marked.join(F.broadcast(self.words.toDF(word, bits)), F.shiftright(h, 6) == F.col(word), "left")
        hit = F.coalesce(F.call_function("shiftrightunsigned", F.col(bits), F.col(h).bitwiseAND(63)).bitwiseAND(1) == 1, F.lit(False))
        return marked.where(hit).select(*df.columns), marked.where(~hit).select(*df.columns)

    def pick(self, df: DataFrame, values: DataFrame, col: str) -> DataFrame:
        """The rows whose `col` is in the one column of `values`: the bitmap leaves nearly all others where they are, a semi-join the rest."""
        (key,) = fresh(df, "key")
        return self.split(df, F.col(col))[0].join(values.toDF(key), F.col(col).eqNullSafe(F.col(key)), "left_semi")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that no column of `df` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
