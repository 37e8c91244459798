"""Quality rules: counts of whole texts and a calibrated classifier.

The classifier is a logistic regression on hashed n-grams of bytes and of
words.  It learns from a bounded sample of labelled rows; its margins are turned
into probabilities on a part of the sample that it did not learn from, weighted
back to the shares that the labels have in the table.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import release, slices, sole, texts
from .hashed import byte_ngrams, fit_logistic, frequencies, linear, rows_of

BITS = 12
SAMPLE = 1500
THRESHOLD = 0.5
SLICE = 1 << 20, 256
WINDOW = 8
_BLANK = re.compile("[\x20\x09-\x0d]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
# Blanks to Python that are parts of words here.
_PYTHON_ONLY = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(text: str) -> list[str]:
    """The runs of [^\\x20\\x09-\\x0D]."""
    if _PYTHON_ONLY.search(text):
        return [w for w in _BLANK.split(text) if w]
    return text.split()


def repeated_words(ids: np.ndarray, doc: np.ndarray, docs: int, width: int = WINDOW) -> np.ndarray:
    """For each document, the words that lie in windows found twice or more in it.

    ids are the words of the documents in order, doc the document of each.
    A hash of the window shows which documents may have one twice; those are counted by the words themselves.
    """
    out = np.zeros(docs, np.int64)
    n = len(ids) - width + 1
    if n < 2:
        return out
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[k : n + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    inside = doc[:n] == doc[width - 1 :]
    key = (h * np.uint64(0xD6E8FEB86659FD93) + doc[:n].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))[inside]
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return out
    starts = np.flatnonzero(inside)
    for d in np.unique(doc[starts[np.isin(key, twice)]]).tolist():
        first, last = np.searchsorted(doc, [d, d + 1])
        own = np.ascontiguousarray(ids[first:last].astype(np.int64))
        rows = np.lib.stride_tricks.sliding_window_view(own, width)
        seen: dict[bytes, int] = {}
        same = np.fromiter((seen.setdefault(r.tobytes(), len(seen)) for r in rows), np.int64, len(rows))
        again = np.flatnonzero(np.bincount(same)[same] > 1)
        edge = np.zeros(len(own) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + width, -1)
        out[d] = int((np.cumsum(edge)[:-1] > 0).sum())
    return out


def tokenised(data: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; for all words in order a number, its document, and a hash for each number."""
    words = [words_of(x) for x in data]
    number: dict[str, int] = defaultdict(itertools.count().__next__)
    ids = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(words)), np.int64)
    doc = np.repeat(np.arange(len(data)), np.fromiter(map(len, words), np.int64, len(words)))
    hashes = np.fromiter((zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) for w in number), np.uint32, len(number))
    return words, ids, doc, hashes


def base_counts(data: list[str], words: list[list[str]], ids: np.ndarray, doc: np.ndarray) -> dict[str, np.ndarray]:
    dup = np.zeros(len(data), np.int64)
    for i, text in enumerate(data):
        lines = text.split("\n")
        if len(lines) > 1 and len(set(lines)) < len(lines):
            full = [x for x in lines if _BLANK.sub("", x)]
            dup[i] = len(full) - len(set(full))
    return {
        "n_words": np.fromiter(map(len, words), np.int64, len(words)),
        "word_chars": np.fromiter((sum(map(len, w)) for w in words), np.int64, len(words)),
        "n_symbols": np.fromiter((len(_SYMBOLS.findall(x)) for x in data), np.int64, len(data)),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(ids, doc, len(data)),
    }


def features(data: list[str], ids: np.ndarray, doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashed frequencies of 1-, 2- and 3-grams of bytes and 1- and 2-grams of words."""
    raw = [x.lower().encode("utf-8", "surrogatepass") for x in data]
    parts = [byte_ngrams(raw, n, BITS, n) for n in (1, 2, 3)]
    w = hashes[ids] if len(ids) else np.zeros(0, np.uint32)
    parts.append((doc, (w >> np.uint32(32 - BITS)).astype(np.int64)))
    pair = (w[:-1] * np.uint32(0x9E3779B1) + w[1:]) * np.uint32(0x85EBCA6B)
    inside = doc[:-1] == doc[1:]
    parts.append((doc[:-1][inside], (pair[inside] >> np.uint32(32 - BITS)).astype(np.int64)))
    chars = np.concatenate([p[0] for p in parts[:3]]), np.concatenate([p[1] for p in parts[:3]])
    both = np.concatenate([p[0] for p in parts[3:]]), np.concatenate([p[1] for p in parts[3:]])
    return np.hstack([frequencies(*chars, len(data), BITS), frequencies(*both, len(data), BITS)])


class Model:
    """Weights and the line that turns margins into log-odds."""

    def __init__(self, w: np.ndarray, slope: float, shift: float):
        self.w, self.slope, self.shift = w, slope, shift

    @classmethod
    def learn(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
        """Every fourth row is kept for the calibration, if both labels are in either part."""
        hold = np.arange(len(y)) % 4 == 3
        if len(np.unique(y[~hold])) < 2 or len(np.unique(y[hold])) < 2:
            hold = np.zeros(len(y), bool)
        learn, check = ~hold, hold if hold.any() else ~hold
        share = np.array([(y[learn] < 0).sum(), (y[learn] > 0).sum()])
        w = fit_logistic(x[learn], y[learn, None], 1 / share[(y[learn] > 0).astype(int)])
        return cls(w, *calibrate(linear(x[check], w)[:, 0].astype(np.float64), y[check], weight[check]))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * linear(x, self.w)[:, 0] + self.shift, -50, 50)))


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through softened labels, by Newton steps."""
    pos, neg = weight[y > 0].sum(), weight[y < 0].sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a = np.stack([margin, np.ones_like(margin)], axis=1)
    theta = np.array([1.0, np.log((pos + 1) / (neg + 1))])

    def loss(th: np.ndarray) -> float:
        z = a @ th
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 1e-3 * th @ th)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -50, 50)))
        slope = a.T @ (weight * (p - target)) + 2e-3 * theta
        bend = (a * (weight * p * (1 - p))[:, None]).T @ a + 2e-3 * np.eye(2)
        move, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-6 and loss(theta - size * move) > loss(theta):
            size /= 2
        theta = theta - size * move
        if np.abs(size * move).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Model | None:
    """Learn from at most `sample` rows of either label, those whose ids have the smallest hashes; None if a label is missing."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    key = F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(1 << 30))
    bound = F.when(F.col("y") == 1, (1 << 30) * min(1.0, (1.3 * sample + 40) / counts[1])).otherwise((1 << 30) * min(1.0, (1.3 * sample + 40) / counts[0]))
    picked = marked.withColumn("key", key).where(F.col("key") < bound)  # about 1.3 * sample rows of either label: small at any size
    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").join(F.broadcast(picked), "i")
    rows = rows.groupBy("i", "y", "key").agg(F.min("t").alias("t"))  # an id counts once, however often it is repeated

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole()
        for part in slices(batches, "t", *SLICE):
            data = texts(part, "t")
            _, ids, doc, hashes = tokenised(data)
            x = features(data, ids, doc, hashes).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("y"), part.column("key"), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "key", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole()
        got = sorted((tuple(r.values()) for batch in batches for r in batch.to_pylist()), key=lambda r: (r[1], r[0], r[2]))
        kept, seen = [], {0: 0, 1: 0}
        for r in got:
            if seen[r[0]] < sample:
                seen[r[0]] += 1
                kept.append(r)
        del got
        if not all(seen.values()):
            return
        y = np.array([1.0 if r[0] else -1.0 for r in kept], np.float32)
        weight = np.array([counts[r[0]] / seen[r[0]] for r in kept])
        cells = [r[2] for r in kept]
        del kept
        x = rows_of(cells)
        m = Model.learn(x, y, weight * len(y) / weight.sum())
        del x
        release()
        yield pa.RecordBatch.from_arrays([pa.array([m.w.tobytes()], pa.binary()), pa.array([m.slope]), pa.array([m.shift])], names=["w", "slope", "shift"])

    # the sample is bounded: one task learns from it, and the driver gets the weights alone
    learnt = rows.select("y", "key", "t").mapInArrow(run, "y int, key long, x binary").repartition(1).mapInArrow(train, "w binary, slope double, shift double").first()
    return None if learnt is None else Model(np.frombuffer(learnt["w"], np.float32).reshape(-1, 1), learnt["slope"], learnt["shift"])


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Counts, rules and the classifier's verdict for each whole text.

    Returns the id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, probability (of good quality) and kept.  base_failed: fewer
    than 20 words, or over 30 % of them in windows of 8 words that occur twice.  kept: not base_failed and probability >=
    threshold.  Null texts have no words and fail; labels other than 0 and 1 and labels of no
    document are ignored, of several labels of an id the larger counts; with only one label
    present the probability is null and the base rules decide.  Repeated rows are scored alike; further columns are ignored;
    an empty table gives an empty result.
    """
    model = fit(df, labels, id_col, text_col, label_col, sample)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names), T.StructField("base_failed", T.BooleanType()), T.StructField("probability", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole()
        for part in slices(batches, text_col, *SLICE):
            data = texts(part, text_col)
            words, ids, doc, hashes = tokenised(data)
            c = base_counts(data, words, ids, doc)
            failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
            if model is None:
                p, good = pa.nulls(len(data), pa.float64()), np.ones(len(data), bool)
            else:
                p = model.probability(features(data, ids, doc, hashes)).astype(np.float64)
                good = p >= threshold
            yield pa.RecordBatch.from_arrays([part.column(id_col), *(pa.array(c[n], pa.int64()) for n in names), pa.array(failed), pa.array(p, pa.float64()), pa.array(~failed & good)], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)
