"""Exact deduplication by content-defined chunk recipes.

A text, its blanks made even, is cut where a rolling hash of its last bytes has
a given pattern; so equal stretches are cut alike.  Its recipe is the ordered
list of its chunks' hashes.  Recipes are short: only they are grouped.  Chunks
of documents whose recipe occurs twice are moved once, deduplicated by
their bytes, and each hash with more than one content gets a number for each
content; a hash with that number is a verified identifier, and documents are
equal if their lists of identifiers are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import Bitmap, fresh, materialise, slices, sole, texts

BLANKS = b" \t\n\r\x0b\x0c"
LEAST, MEAN_BITS, MOST = 256, 10, 8192


def normalised(text: str) -> bytes:
    """UTF-8 with each run of [\\x20\\x09-\\x0D]+ as one space."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at just these six characters
    if not words:
        return b" " if raw else b""
    return b" " * (raw[0] in BLANKS) + b" ".join(words) + b" " * (raw[-1] in BLANKS)


def _gear() -> np.ndarray:
    """256 fixed pseudo-random numbers, from a rule."""
    return np.array([xxhash.xxh3_64_intdigest(bytes([i]), seed=7) & 0xFFFFFFFF for i in range(256)], np.uint32)


def cut_points(data: bytes, least: int = LEAST, bits: int = MEAN_BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks of `data`: the last is its length; none if it is empty.

    Position i may end a chunk if the gear hash of the 16 bytes up to it has
    zeros in its top `bits` bits; chunks have `least` to `most` bytes but for the last.
    """
    if len(data) <= least:
        return [len(data)] * bool(data)
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):  # h[i] = sum of gear[byte i-j] << j over the window, doubled each time
        h[k:] += h[:-k] << np.uint32(k)  # the right side is made before it is added
    maybe = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    out, last = [], 0
    for end in [*maybe.tolist(), len(data)]:
        while end - last > most:
            last += most
            out.append(last)
        if end - last >= least or (end == len(data) and end > last):
            out.append(end)
            last = end
    return out


_GEAR = _gear()


def chunks(data: bytes) -> Iterator[bytes]:
    last = 0
    for end in cut_points(data):
        yield data[last:end]
        last = end


def chunk_hash(chunk: bytes, bits: int = 64) -> int:
    return (xxhash.xxh3_64_intdigest(chunk) & ((1 << bits) - 1)) - (1 << 63) * (bits == 64)


def _recipes(df: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("row", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("recipe", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole()
        row = TaskContext.get().partitionId() << 33
        for part in slices(batches, text_col):
            data = [normalised(x) for x in texts(part, text_col)]
            recipes = [[chunk_hash(c, bits) for c in chunks(d)] for d in data]
            shas = [hashlib.sha256(d).hexdigest() for d in data]
            rows = range(row, row := row + len(data))
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(rows, pa.int64()), pa.array(shas, pa.string()), pa.array(recipes, pa.list_(pa.int64()))], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def _contents(df: DataFrame, text_col: str, bits: int) -> DataFrame:
    """The chunks of each text: sha of the text, position, hash and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            cols: list[list] = [[], [], [], []]
            for text in texts(part, text_col):
                data = normalised(text)
                sha = hashlib.sha256(data).hexdigest()
                for k, c in enumerate(chunks(data)):
                    for col, v in zip(cols, (sha, k, chunk_hash(c, bits), c)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=["sha", "pos", "hash", "bytes"])

    return df.select(text_col).mapInArrow(run, "sha string, pos int, hash long, bytes binary")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """Group documents whose texts are equal but for the kind and length of their blanks.

    Returns a row per input row: the id, keep_id (the smallest id of the
    group), group_size, kept and text_sha256 (lower-case hex, of the
    normalised text).  Null texts count as empty; empty texts are equal.  Of
    repeated rows (equal ids and texts) the first read stays alone; a null id is larger
    than any other.  Further columns are ignored, whatever their names.
    An empty table gives an empty result.
    """
    r = materialise(_recipes(df, id_col, text_col, hash_bits), "recipes")
    # chunks of documents that aren't suspects don't move, however many there are: bitmaps of the suspects' recipes and ids
    # leave nearly all of them out, and semi-joins the rest
    twice = materialise(r.groupBy("recipe").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("recipe").alias("h")), "twice")
    marked = r.select("id", F.xxhash64("recipe").alias("h"))
    suspects = materialise(Bitmap(twice, F.col("h")).pick(marked, twice, "h").select("id").distinct(), "suspects")
    looked_at = Bitmap(suspects, F.col("id")).pick(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), suspects, "id")
    moved = _contents(looked_at, "text", hash_bits)
    distinct = moved.groupBy("hash", "bytes").agg(F.count("*").alias("n"))
    unlike = materialise(distinct.groupBy("hash").agg(F.count("*").alias("contents")).where("contents > 1").select("hash"), "unlike")
    r = r.withColumn("variants", F.lit(None).cast("array<int>"))
    if not unlike.isEmpty():
        numbered = distinct.join(unlike, "hash", "left_semi").withColumn("variant", F.row_number().over(Window.partitionBy("hash").orderBy("bytes"))).select("hash", "bytes", "variant")
        lists = moved.join(numbered, ["hash", "bytes"]).groupBy("sha").agg(F.array_sort(F.collect_set(F.struct("pos", "variant"))).alias("v"))
        r = materialise(r.drop("variants").join(lists, "sha", "left").withColumn("variants", F.col("v.variant")).drop("v"), "identifiers")
    first = F.struct(F.col("id").isNull().alias("null"), "id", "row")
    groups = r.groupBy("recipe", "variants").agg(F.min(first).alias("first"), F.count("*").alias("group_size")).where("group_size > 1").select(F.col("recipe").alias("g_recipe"), F.col("variants").alias("g_variants"), "first", "group_size")
    out = r.join(groups, (F.col("recipe") == F.col("g_recipe")) & F.col("variants").eqNullSafe(F.col("g_variants")), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def with_sha(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """All columns and, under a name given, the sha256 of the normalised text."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            shas = pa.array([hashlib.sha256(normalised(x)).hexdigest() for x in texts(part, text_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, shas], names=schema.names)

    return df.mapInArrow(run, schema)


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns, that `exact_dedup` keeps; of repeated rows one."""
    sha, k_id, k_sha, n = fresh(df, "sha", "k_id", "k_sha", "n")
    decided = materialise(exact_dedup(df, id_col, text_col).select(F.col(id_col).alias(k_id), F.col("text_sha256").alias(k_sha), "kept"), "decided")
    # only rows whose id may be one of a dropped row are looked up: the others stay where they are
    doubtful, sure = Bitmap(decided.where("NOT kept"), F.col(k_id)).split(df, F.col(id_col))
    rows = with_sha(doubtful, text_col, sha).join(decided.where("kept"), F.col(id_col).eqNullSafe(F.col(k_id)) & (F.col(sha) == F.col(k_sha)), "left_semi")
    one = Window.partitionBy(id_col, sha).orderBy(F.lit(0))
    return sure.unionByName(rows.withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).select(*df.columns))
