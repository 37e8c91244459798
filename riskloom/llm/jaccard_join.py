"""Join of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Documents with the same set are one class, of which one goes on.  MinHash bands
give buckets of candidates.  Within a bucket further MinHash values of each
pair are compared a few at a time; a pair is dropped when the posterior
probability that its similarity reaches the threshold is below a tolerance.
The rest is verified on the sets themselves.

No pair is a row, nor written in any other form.  A bucket's members are dealt into parts of bounded size and
each two parts meet in a tile of their own, so a bucket of any size is whole
and no task holds it all; where sets are large, parts have fewer members.  A pair counts in the first band in which it
collides, and in no other.  A first round of tiles returns the members that are in a pair which stays; their sets
are fetched, and in a second round a tile of such members compares and verifies in one go.  It returns for each member its number of links
and one edge towards its component, from which the components of the corpus
are made by alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import CACHES, Bitmap, discard, fresh, materialise, slices, sole, texts

WORDS, THRESHOLD = 5, 0.8
# A pair at the threshold shares no band with probability (1 - 0.8**4)**24, about 3e-6.
BANDS, ROWS = 24, 4
CHECKS, STEP, TOLERANCE = 64, 16, 1e-6
# Members of a bucket that one part of a tile holds at most, on average, and bytes of their sets.
PART, PART_BYTES = 1024, 32 << 20
PAIRS_AT_ONCE = 1 << 18


def _constants(n: int, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(i.to_bytes(4, "little"), seed=seed) & 0xFFFFFFFF | (seed == 1) for i in range(n)], np.uint32)


MULTIPLY, FLIP = _constants(BANDS * ROWS + CHECKS, 1), _constants(BANDS * ROWS + CHECKS, 2)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Hashes()
CACHES["jaccard_join"] = _WORDS.clear


def shingles(data: list[str], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all shingles, text by text, and how many each text has.

    Words are [^\\x20\\x09-\\x0D]+; a text of fewer than `width` words has one shingle of all of them.
    """
    words = [x.encode("utf-8", "surrogatepass").split() for x in data]
    n = np.fromiter(map(len, words), np.int64, len(words))
    pads = np.where((n > 0) & (n < width), width - n, 0)
    h = np.fromiter((h for x, pad in zip(words, pads.tolist()) for h in [*map(_WORDS.__getitem__, x), *[pad] * pad]), np.uint64, int((n + pads).sum()))
    full = n + pads
    if len(h) < width:
        return np.zeros(0, np.uint64), np.zeros(len(data), np.int64)
    m = len(h) - width + 1
    out = np.zeros(m, np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= h[k : m + k]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(30)
    doc = np.repeat(np.arange(len(data)), full)
    return out[doc[:m] == doc[width - 1 :]], np.maximum(full - width + 1, 0)


def distinct_sets(data: list[str], width: int = WORDS) -> list[np.ndarray]:
    flat, sizes = shingles(data, width)
    return [np.unique(x) for x in np.split(flat, np.cumsum(sizes)[:-1])] if data else []


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    signed = lambda x: x - (1 << 64) * (x >> 63)
    return signed(h >> 64), signed(h & (1 << 64) - 1)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row for each (non-empty) set: BANDS * ROWS values for the bands, then CHECKS for the comparison."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(MULTIPLY), len(sets)), np.uint32)
    for k, (a, b) in enumerate(zip(MULTIPLY, FLIP)):
        out[k] = np.minimum.reduceat((x ^ b) * a, starts)
    return out.T


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, different from band to band."""
    v = values[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F), v.shape[:2]).copy()
    for k in range(ROWS):
        h ^= v[:, :, k]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def short_values(values: np.ndarray) -> np.ndarray:
    """8 bits of a mixed hash of each of the CHECKS values: a minimum's own top bits tend to zero as its set grows."""
    v = values[:, BANDS * ROWS :] * np.uint32(0x9E3779B1)
    v ^= v >> np.uint32(15)
    v *= np.uint32(0x85EBCA77)
    return (v >> np.uint32(24)).astype(np.uint8)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After STEP, 2 * STEP, ... values: the fewest matches at which the posterior still is `tolerance`.

    The prior is uniform; values are compared by 8 bits, so they match with probability j + (1 - j) / 256.
    """
    j = (np.arange(4000) + 0.5) / 4000
    q = j + (1 - j) / 256
    out = []
    for n in range(STEP, CHECKS + 1, STEP):
        logs = np.arange(n + 1)[:, None] * np.log(q) + (n - np.arange(n + 1))[:, None] * np.log1p(-q)
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        p = p[:, j >= threshold].sum(axis=1) / p.sum(axis=1)
        out.append(int(np.flatnonzero(p >= tolerance)[0]))
    return out


def survivors(sig: np.ndarray, keys: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, band: int, threshold: Fraction, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (left[i], right[i]) that collide in no earlier band, have fitting sizes and aren't dropped."""
    small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
    ok = small * threshold.denominator >= large * threshold.numerator
    left, right = left[ok], right[ok]
    if band:
        ok = ~(keys[left, :band] == keys[right, :band]).any(axis=1)
        left, right = left[ok], right[ok]
    match = np.zeros(len(left), np.int64)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        match += (sig[left, part] == sig[right, part]).sum(axis=1)
        ok = match >= need
        left, right, match = left[ok], right[ok], match[ok]
    return left, right


def tile_pairs(side: np.ndarray, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a tile, some at a time: all i < j, or each of side 0 with each of side 1."""
    if cross:
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        step = max(1, PAIRS_AT_ONCE // max(1, len(b)))
        for i in range(0, len(a), step):
            yield np.repeat(a[i : i + step], len(b)), np.tile(b, len(a[i : i + step]))
    else:
        m = len(side)
        step = max(1, PAIRS_AT_ONCE // max(1, m))
        for i in range(0, m, step):
            rows = np.arange(i, min(i + step, m))
            x, y = np.repeat(rows, m), np.tile(np.arange(m), len(rows))
            yield x[x < y], y[x < y]


def common_sizes(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The size of the intersection of each pair."""
    if len(left) <= 4 * len(sets):
        return np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right)), np.int64, len(left))
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = many[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    owner, out = owner[shared], np.zeros(len(left), np.int64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [first, first + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[lo:hi], column[lo:hi] - first] = 1
        out += (m @ m.T)[left, right].astype(np.int64)
    return out


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component."""
    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        low = np.minimum(a, b)
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each group; they come sorted by group."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for first, last in zip(edges, edges[1:]):
            if first == last:
                continue
            group = tuple(c[first] for c in cols)
            if held and group != now:
                yield pa.Table.from_batches(held)
                held = []
            now = group
            held.append(batch.slice(first, last - first))
    if held:
        yield pa.Table.from_batches(held)


def _signatures(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("row", "t1", "t2", "f1", "f2", "n")), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("jaccard_join")
        row = TaskContext.get().partitionId() << 33
        for part in slices(batches, text_col):
            data = texts(part, text_col)
            sets = distinct_sets(data, width)
            rows = np.arange(row, row + len(data))
            row += len(data)
            prints = [fingerprint(s) if len(s) else (int(r), -1) for s, r in zip(sets, rows)]  # a text without words is like no other
            own = [text_key(x) for x in data]
            keys: list = [None] * len(data)
            sig: list = [None] * len(data)
            full = [i for i, s in enumerate(sets) if len(s)]
            if full:
                values = minhashes([sets[i] for i in full])
                for i, k, v in zip(full, band_keys(values), short_values(values)):
                    keys[i], sig[i] = k, v.tobytes()
            longs = [rows, [k[0] for k in own], [k[1] for k in own], [p[0] for p in prints], [p[1] for p in prints], [len(s) for s in sets]]
            yield pa.RecordBatch.from_arrays([part.column(id_col), *(pa.array(c, pa.int64()) for c in longs), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def text_key(text: str) -> tuple[int, int]:
    """128 bits of a text, as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
    signed = lambda x: x - (1 << 64) * (x >> 63)
    return signed(h >> 64), signed(h & (1 << 64) - 1)


def _tiles(members: DataFrame, part: int) -> DataFrame:
    """Deal the members of each bucket (its size and, where they come along, the bytes of its sets in `members`) into parts, and a row to each tile that its part is in."""
    parts = F.ceil(F.col("bucket_size") / F.lit(float(part))).cast("int")
    if "bucket_bytes" in members.columns:
        by_bytes = F.ceil(F.col("bucket_bytes") / F.lit(float(PART_BYTES))).cast("int")
        parts = F.least(F.greatest(parts, by_bytes), F.col("bucket_size").cast("int"))
    out = members.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.withColumn("ti", F.least("own", "other")).withColumn("tj", F.greatest("own", "other")).withColumn("side", F.when(F.col("own") > F.col("other"), 1).otherwise(0)).drop("parts", "own", "other", "bucket_size", "bucket_bytes")


TILE = ["key", "ti", "tj"]


def _dealt(df: DataFrame) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *TILE).sortWithinPartitions(*TILE, "c")


def _surviving_pairs(tile: pa.Table, threshold: Fraction, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a tile's rows that stay."""
    ti, tj, band = (tile.column(x)[0].as_py() for x in ("ti", "tj", "band"))
    n, side = (tile.column(x).to_numpy() for x in ("n", "side"))
    sig = np.frombuffer(b"".join(tile.column("sig").to_pylist()), np.uint8).reshape(len(n), CHECKS)
    keys = tile.column("keys").combine_chunks()
    keys = np.asarray((keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys).flatten()).reshape(len(n), BANDS)
    found = [survivors(sig, keys, n, a, b, band, threshold, least) for a, b in tile_pairs(side, ti != tj)]
    none = np.zeros(0, np.int64)  # no pairs at all: no member of the tile's bucket lies in one of its two parts
    return np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)])


def _prune(least: list[int], threshold: Fraction) -> Callable:
    """The members of a tile that are in a pair that stays."""
    names = ["key", "band", "c", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _grouped(batches, TILE):
            if tile.num_rows < 2:
                continue
            left, right = _surviving_pairs(tile, threshold, least)
            some = tile.select(names).take(pa.array(np.union1d(left, right)))
            if some.num_rows:
                yield from some.combine_chunks().to_batches()

    return run


def _verify(least: list[int], threshold: Fraction) -> Callable:
    """For each member of a tile that has a link: its links, what they weigh, and a smaller member of its component."""
    names = ["c", "links", "linked_rows", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _grouped(batches, TILE):
            if tile.num_rows < 2:
                continue
            left, right = _surviving_pairs(tile, threshold, least)
            if not len(left):
                continue
            c, size, n = (tile.column(x).to_numpy() for x in ("c", "class_size", "n"))
            both = common_sizes([np.frombuffer(x, "<u8") for x in tile.column("set").to_pylist()], left, right)
            link = both * threshold.denominator >= (n[left] + n[right] - both) * threshold.numerator
            left, right = left[link], right[link]
            if not len(left):
                continue
            links = np.bincount(left, minlength=len(c)) + np.bincount(right, minlength=len(c))
            rows = np.bincount(left, weights=size[right], minlength=len(c)) + np.bincount(right, weights=size[left], minlength=len(c))
            root = local_roots(len(c), left, right)
            has = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (c[has], links[has], rows[has].astype(np.int64), c[root[has]])], names=names)

    return run


def components(edges: DataFrame) -> DataFrame:
    """u, root for each node of the edges (u, v) but the smallest of its component, which is the root.

    Alternating large and small stars; the edges are written after each round.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    seen = last = None
    while True:
        edges = materialise(edges, "edges")
        if last is not None:
            discard(last)
        last = edges
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select("u", F.col("v").alias("root"))
        seen = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = small.where("u != v").distinct()


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, part: int = PART) -> DataFrame:
    """Link documents by the similarity of their shingles.

    Returns a row per input row: the id, class_id (the smallest id with the same
    set of shingles), class_size, n_links (other classes that are similar),
    n_linked_docs (other documents that are: links weighted by class size, and
    the rest of the own class), group_id (the smallest id of the component of
    links), kept (the one row of its group that stays: its smallest id, the first read among equals) and t1, t2 (a
    hash of the text).  A null text or one without words is alone.  Texts of
    fewer than `width` words have one shingle.  Words are compared exactly.
    Repeated rows are in one class; a null id is larger than any other.
    Further columns are ignored; an empty table gives an empty result.
    """
    exact = Fraction(str(threshold))
    docs = materialise(_signatures(df, id_col, text_col, width), "signatures")
    order = F.struct(F.col("id").isNull().alias("null"), "id", "row")
    classes = docs.groupBy("f1", "f2").agg(F.min(order).alias("first"), F.min("row").alias("c"), F.count("*").alias("class_size"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    classes = materialise(classes, "classes")
    bands = classes.where("n > 0").select("c", F.posexplode("keys").alias("band", "key"))
    inside = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col("c")))
    buckets = bands.groupBy("key").agg(F.count("*").alias("bucket_size"), F.min("band").alias("band"), F.min("c").alias("low"), F.max("c").alias("high"), inside(1).alias("x1"), inside(2).alias("x2")).where("bucket_size > 1")
    # buckets with the same members in several bands: the first is enough
    buckets = buckets.groupBy("bucket_size", "low", "high", "x1", "x2").agg(F.min(F.struct("band", "key")).alias("b")).select("b.key", "bucket_size")
    least = least_matches(threshold, tolerance)
    members = bands.join(buckets, "key").join(classes.select("c", "n", "keys", "sig"), "c")
    stay = _dealt(_tiles(members, part)).mapInArrow(_prune(least, exact), "key long, band int, c long, n long")
    stay = materialise(stay.distinct(), "members")  # in proportion to the members, however many pairs there are
    needed = materialise(stay.select("c").distinct().join(classes.select("c", "class_size", "n", "keys", "sig", "f1", "f2", F.col("first.id").alias("id")), "c"), "needed")
    # texts aren't shuffled: a bitmap of the ids leaves nearly all others where they are, a semi-join the rest, and the sets meet their classes
    ids = needed.select("id").distinct()
    found = Bitmap(ids, F.col("id")).pick(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ids, "id")
    sets = found.select("text").mapInArrow(_sets(width), "f1 long, f2 long, set binary").join(needed.drop("id"), ["f1", "f2"]).drop("f1", "f2").dropDuplicates(["c"])
    sizes = stay.groupBy("key").agg(F.count("*").alias("bucket_size"), F.sum(F.col("n") * 8).alias("bucket_bytes"))
    checked = _dealt(_tiles(stay.drop("n").join(sizes, "key").join(sets, "c"), part)).mapInArrow(_verify(least, exact), "c long, links long, linked_rows long, root long")
    links = materialise(checked, "links")
    discard(stay, needed)
    counts = links.groupBy("c").agg(F.sum("links").alias("links"), F.sum("linked_rows").alias("linked_rows"))
    roots = components(links.select(F.col("c").alias("u"), F.col("root").alias("v"))).withColumnRenamed("u", "c")
    ours = classes.select("f1", "f2", "c", "first", "class_size").join(counts, "c", "left").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    heads = ours.where("links IS NOT NULL").groupBy("root").agg(F.min("first").alias("head"))
    ours = ours.join(heads, "root", "left").withColumn("head", F.coalesce("head", "first")).drop("c", "root")
    out = docs.select("id", "row", "t1", "t2", "f1", "f2").join(ours, ["f1", "f2"])
    links = F.coalesce("links", F.lit(0).cast("long"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("class_id"),
        "class_size",
        links.alias("n_links"),
        (F.coalesce("linked_rows", F.lit(0).cast("long")) + F.col("class_size") - 1).alias("n_linked_docs"),
        F.col("head.id").alias("group_id"),
        (F.col("row") == F.col("head.row")).alias("kept"),
        "t1",
        "t2",
    )


def _sets(width: int) -> Callable:
    """The set of each text and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = distinct_sets(texts(part, "text"), width)
            prints = [fingerprint(s) for s in sets]
            cols = [pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["f1", "f2", "set"])

    return run


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `df`, all columns, that `jaccard_join` keeps: one of each group."""
    t1, t2, k_id, k1, k2, n, times = fresh(df, "t1", "t2", "k_id", "k1", "k2", "n", "times")
    decided = materialise(jaccard_join(df, id_col, text_col, **options).select(F.col(id_col).alias(k_id), F.col("t1").alias(k1), F.col("t2").alias(k2), "kept"), "decided")
    # only rows whose id may be one of a dropped row are looked up: the others stay where they are
    doubtful, sure = Bitmap(decided.where("NOT kept"), F.col(k_id)).split(df, F.col(id_col))
    schema = T.StructType([*df.schema.fields, T.StructField(t1, T.LongType()), T.StructField(t2, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            own = [text_key(x) for x in texts(part, text_col)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([k[0] for k in own], pa.int64()), pa.array([k[1] for k in own], pa.int64())], names=schema.names)

    # of rows that repeat id and text some may stay (those without words): as many as are kept
    stay = decided.where("kept").groupBy(k_id, k1, k2).agg(F.count("*").alias(times))
    joined = doubtful.mapInArrow(run, schema).join(stay, F.col(id_col).eqNullSafe(F.col(k_id)) & (F.col(t1) == F.col(k1)) & (F.col(t2) == F.col(k2)))
    one = Window.partitionBy(id_col, t1, t2).orderBy(F.lit(0))
    return sure.unionByName(joined.withColumn(n, F.row_number().over(one)).where(F.col(n) <= F.col(times)).select(*df.columns))
