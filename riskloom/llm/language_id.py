"""Language identification by error-correcting output codes.

Each language has a codeword of bits; a binary classifier on hashed n-grams
learns each bit.  A text gets the language whose codeword has the least total
loss under the classifiers' margins; where the second is nearly as good, the
text is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import crc32_mod, fresh, release, slices, sole, texts
from .hashed import LETTERS_ONLY, byte_ngrams, fit_logistic, frequencies, linear, rows_of

BITS = 12
ORDERS = (2, 3, 4)
SAMPLE, MOST_SAMPLE = 500, 6000
FOLDS, HELD_OUT = 4, 2
MARGIN = 0.1
SLICE = 1 << 20, 256
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def codewords(n: int) -> np.ndarray:
    """n x bits of -1 and 1: all splits of the languages in two for up to 7, else a random code far apart."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 7:
        columns = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range((1 << (n - 1)) - 1)]
        return np.array(columns, np.float32).T
    rng, best, far = np.random.default_rng(n), None, -1
    for _ in range(60):
        code = rng.choice([-1, 1], (n, int(np.ceil(10 * np.log2(n)))))
        distance = ((code[:, None] != code[None]).sum(axis=2) + 10_000 * np.eye(n, dtype=int)).min()
        if distance > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, distance
    return best.astype(np.float32)


def features(data: list[str]) -> np.ndarray:
    raw = [x.lower().encode("utf-8", "surrogatepass").translate(LETTERS_ONLY) for x in data]
    found = [byte_ngrams(raw, n, BITS, n) for n in ORDERS]
    return np.hstack([frequencies(doc, bins, len(data), BITS) for doc, bins in found])


class Model:
    """Languages, their codewords and the weights of a classifier a bit."""

    def __init__(self, languages: list[str], w: np.ndarray):
        self.languages, self.code, self.w = languages, codewords(len(languages)), w

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score in 0..1 and its lead over the second."""
        f = linear(x, self.w)
        loss = np.logaddexp(0, -self.code[None] * f[:, None]).sum(axis=2)  # texts x languages
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        order = np.sort(p, axis=1)
        best = p.argmax(axis=1)
        return best, order[:, -1], order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0)


def fit(df: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> Model | None:
    """Learn from rows that aren't held out: at most `sample` of a language and MOST_SAMPLE in all,
    those whose ids have the smallest hashes."""
    rows = df.where(crc32_mod(id_col, FOLDS) != HELD_OUT).where(F.col(lang_col).isNotNull() & (F.trim(F.col(text_col)) != "")).select(F.col(id_col).cast("string").alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct("i", 0.02).alias("n")).collect()}
    counts = {k: n for k, n in counts.items() if k != UNKNOWN}
    if not counts:
        return None
    each = max(1, min(sample, MOST_SAMPLE // len(counts)))
    key = F.pmod(F.xxhash64("i"), F.lit(1 << 30))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, (1 << 30) * min(1.0, (1.3 * each + 40) / n))))
    picked = rows.withColumn("key", key).where(F.col("key") < F.try_element_at(share, F.col("l")))
    picked = picked.groupBy("l", "i", "key").agg(F.min("t").alias("t"))  # an id counts once, however often it is repeated

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole()
        for part in slices(batches, "t", *SLICE):
            x = features(texts(part, "t")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("l"), part.column("key"), part.column("i"), pa.array([r.tobytes() for r in x], pa.binary())], names=["l", "key", "i", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole()
        got = sorted((tuple(r.values()) for batch in batches for r in batch.to_pylist()), key=lambda r: r[:4])
        kept, seen = [], dict.fromkeys(counts, 0)
        for r in got:
            if seen[r[0]] < each:
                seen[r[0]] += 1
                kept.append(r)
        del got
        if not kept:
            return
        languages = sorted({r[0] for r in kept})
        y = np.array([languages.index(r[0]) for r in kept])
        cells = [r[3] for r in kept]
        del kept
        x = rows_of(cells)
        share = np.bincount(y, minlength=len(languages)).astype(np.float32)
        w = fit_logistic(x, codewords(len(languages))[y], 1 / share[y])
        del x
        release()
        yield pa.RecordBatch.from_arrays([pa.array([languages], pa.list_(pa.string())), pa.array([w.tobytes()], pa.binary())], names=["languages", "w"])

    # the sample is bounded: one task learns from it, and the driver gets the weights alone
    learnt = picked.mapInArrow(run, "l string, key long, i string, x binary").repartition(1).mapInArrow(train, "languages array<string>, w binary").first()
    if learnt is None:
        return None
    return Model(list(learnt["languages"]), np.frombuffer(learnt["w"], np.float32).reshape(len(ORDERS) * (1 << BITS) + 1, -1))


def predict(df: DataFrame, model: Model | None, text_col: str, names: tuple[str, str, str], margin: float = MARGIN) -> DataFrame:
    """All columns and, under the names given, language, score and whether the text is ambiguous."""
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole()
        for part in slices(batches, text_col, *SLICE):
            data = texts(part, text_col)
            known = [model is not None and _LETTER.search(x) is not None for x in data]
            lang, score, unsure = [UNKNOWN] * len(data), [0.0] * len(data), [True] * len(data)
            rows = [i for i, k in enumerate(known) if k]
            if rows:
                best, p, lead = model.decode(features([data[i] for i in rows]))
                for i, b, s, gap in zip(rows, best.tolist(), p.tolist(), lead.tolist()):
                    lang[i], score[i], unsure[i] = model.languages[b], min(1.0, s), gap < margin
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names=schema.names)

    return df.mapInArrow(run, schema)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, margin: float = MARGIN) -> DataFrame:
    """Predict the language of each whole text from the text alone.

    Returns the id, held_out, lang_pred, score and ambiguous (the best language
    leads the second by less than `margin`).  Learning takes rows with a language
    whose crc32(id as text) mod 4 is not 2.  A null text or one without
    a letter is `und` with score 0 and ambiguous; so is each text if there is nothing to
    learn from.  Rows with a null id are neither learned from nor held out.
    Repeated rows get equal results; ties go to the first language by name;
    further columns are ignored; an empty table gives an empty result.
    """
    model = fit(df, id_col, text_col, lang_col, sample)
    names = ("lang_pred", "score", "ambiguous")
    out = predict(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model, "text", names, margin)
    return out.select(F.col("id").alias(id_col), F.coalesce(crc32_mod("id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), *names)


def accepted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, margin: float = MARGIN) -> DataFrame:
    """The rows, all columns, whose language is known and not ambiguous."""
    names = tuple(fresh(df, "lang_pred", "score", "ambiguous"))
    out = predict(df, fit(df, id_col, text_col, lang_col, sample), text_col, names, margin)
    return out.where((F.col(names[0]) != UNKNOWN) & ~F.col(names[2])).select(*df.columns)
