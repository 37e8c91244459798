"""Mixing sources to target weights by Poisson replication, in SQL functions alone.

A source with weight w, of n documents, is to be seen w * total / n times a
document on average.  A document's number of copies is the Poisson
distribution with that mean, inverted at a uniform number that a hash of the
seed and the document's id gives; so it depends on nothing else.  Each document
is exploded by its count and all rows are dealt out by a hash of id, copy and seed.

A mean over PART_MEAN is the sum of equal parts of at most that, each inverted at a number of
its own, which adds up to the same distribution; so no term underflows
and the work for a document grows as the copies that it gives.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, materialise

# Sources are broadcast with their rates up to this many and these bytes of names, both counted first; more are joined by shuffle.
BROADCAST_SOURCES, BROADCAST_BYTES = 20_000, 8 << 20
EXPONENT, SEED = 0.5, 42
PART_MEAN = 256.0
# A document with more copies than this is first exploded into ranges of copies that go to different tasks.
RANGE = 4096


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the parts, joined by '|'."""
    text = F.concat_ws("|", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_quantile(mean: Column, u: Column) -> Column:
    """How many k >= 0 have P(X <= k) <= u, for X Poisson with a mean of at most PART_MEAN.

    The walk goes 12 standard deviations beyond the mean, where what is left is less than u can resolve.
    """
    top = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("sum"), (first <= u).cast("int").alias("n"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k.cast("double")
        total = acc["sum"] + p
        return F.struct(p.alias("p"), total.alias("sum"), (acc["n"] + (total <= u).cast("int")).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["n"])


def poisson_copies(rate: Column, seed: int, name: Column) -> Column:
    """A Poisson number with mean `rate`, from the seed and a document's name."""
    parts = F.ceil(rate / PART_MEAN).cast("int")
    one = poisson_quantile(rate, uniform(F.lit(seed), name)).cast("long")
    each = lambda i: poisson_quantile(rate / parts, uniform(F.lit(seed), name, F.lit("part"), i)).cast("long")
    many = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0).cast("long"), lambda acc, i: acc + each(i))
    return F.when(parts <= 1, one).otherwise(many)


def source_rates(df: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, exponent: float = EXPONENT) -> DataFrame:
    """source, n, rate: what each source holds and how often its documents are to be seen.

    Without `weights` a source's weight is n ** exponent.  Only the ratios of weights count: they are
    made to sum to 1 over the sources that are there, and none but 0 becomes 0; a source without a weight gets 0.
    A weight that is negative, infinite or NaN raises ValueError.
    """
    n = materialise(df.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n")), "sources")  # one look at all rows
    if weights is None:
        raw = F.pow(F.col("n").cast("double"), F.lit(float(exponent)))
    else:
        if not all(0 <= w < math.inf for w in weights.values()):
            raise ValueError("weights must be finite numbers, 0 or more")
        most = max(weights.values(), default=0.0)
        given = F.create_map(*(F.lit(x) for k, w in weights.items() for x in (k, w / most if most else 0.0))) if weights else F.lit(None).cast("map<string,double>")
        raw = F.coalesce(F.try_element_at(given, F.coalesce(F.col("source").cast("string"), F.lit("null"))), F.lit(0.0))
    n = n.withColumn("w", raw)
    top = n.agg(F.sum("n").alias("all_n"), F.max("w").alias("top"))
    n = n.join(F.broadcast(top)).withColumn("w", F.when(F.col("top") > 0, F.col("w") / F.col("top")).otherwise(0.0))
    total = n.agg(F.sum(F.col("w").cast("decimal(38,20)")).cast("double").alias("all_w"))  # decimals: the sum has one value in any order
    rate = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * F.col("all_n") / F.col("n")).otherwise(0.0)
    return n.join(F.broadcast(total)).select("source", "n", rate.alias("rate"))


def mix_sources(df: DataFrame, weights: dict[str, float] | None = None, exponent: float = EXPONENT, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Replicate documents so that sources come to their target weights, in a random order.

    Returns all columns of `df` for each copy and copy (from 0), n_copies and
    shuffle_key, under names with underscores before them where `df` has them.
    Rows are dealt to partitions by a hash of shuffle_key and of the row, and sorted by shuffle_key
    there: a global shuffle that depends on the rows and the seed alone.  Rows that share an id get the
    same count; a row without an id goes by a hash of all its columns; a null source is a source of its own
    (its weight goes by the name 'null').  Texts of any length are whole; a rate of any size gives all its copies, those of one document
    in ranges of RANGE that go to different tasks.  An empty table gives an empty result.
    """
    copy, n_copies, shuffle_key, key, rate, name, row, first = fresh(df, "copy", "n_copies", "shuffle_key", "key", "rate", "name", "row", "first")
    rates = materialise(source_rates(df, source_col, weights, exponent), "rates").select(F.col("source").alias(key), F.col("rate").alias(rate))
    size = rates.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0)).alias("bytes"), F.coalesce(F.max(rate), F.lit(0.0)).alias("top")).first()
    same = F.col(source_col).eqNullSafe(F.col(key))
    drawn = df.withColumn(row, F.xxhash64(*(F.col(c).cast("string") if t.startswith("map") else F.col(c) for c, t in df.dtypes)))
    drawn = drawn.withColumn(name, F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("row "), F.col(row).cast("string"))))
    if size["n"] <= BROADCAST_SOURCES and size["bytes"] <= BROADCAST_BYTES:
        joined = drawn.join(F.broadcast(rates), same)
    else:  # more sources than may be broadcast: deal each over 64 parts, so that a large one is no single task
        part, other = fresh(drawn, "part", "other")
        salted = rates.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(63))))
        joined = drawn.withColumn(part, F.pmod(F.xxhash64(name, row), F.lit(64)).cast("int")).join(salted, same & (F.col(part) == F.col(other)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = joined.withColumn(n_copies, poisson_copies(F.col(rate), seed, F.col(name))).where(F.col(n_copies) > 0)
    kept = [F.col(c) for c in (*df.columns, n_copies, name, row)]
    zero = F.lit(0).cast("long")

    def copies(rows: DataFrame) -> DataFrame:
        return rows.withColumn(copy, F.explode(F.sequence(F.col(first), F.least(F.col(first) + (RANGE - 1), F.col(n_copies) - 1))))

    out = copies(counted.where(F.col(n_copies) <= RANGE).select(*kept, zero.alias(first)))
    if size["top"] + 12 * math.sqrt(size["top"]) + 20 > RANGE:  # else no document can have so many
        ranges = counted.where(F.col(n_copies) > RANGE).select(*kept, F.explode(F.sequence(zero, F.col(n_copies) - 1, F.lit(RANGE).cast("long"))).alias(first))
        out = out.unionByName(copies(ranges.repartition(parts, name, row, first)))
    out = out.withColumn(shuffle_key, uniform(F.lit(seed), F.lit("order"), F.col(name), F.col(copy)))
    out = out.repartition(parts, shuffle_key, row).sortWithinPartitions(shuffle_key)
    return out.select(*df.columns, F.col(copy).cast("int").alias(copy), F.col(n_copies).cast("int").alias(n_copies), shuffle_key)


# The definition for documents with ids and rates up to PART_MEAN.
QUERY_SQL = f"""
WITH n AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), {EXPONENT}) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / sum(w) OVER () * sum(n) OVER () / n AS rate FROM n),
k AS (SELECT source, rate, CAST(unnest(range(CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS BIGINT) AS k FROM r),
f AS (SELECT source, rate, k, sum(CASE WHEN k = 0 THEN 0 ELSE ln(CAST(greatest(k, 1) AS DOUBLE)) END) OVER (PARTITION BY source ORDER BY k) AS log_fact FROM k),
c AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - log_fact)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM f),
u AS (SELECT *, CAST(('0x' || substr(md5('{SEED}|' || CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
m AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, CAST((SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u) AS INTEGER) AS n_copies FROM u),
e AS (SELECT *, CAST(unnest(range(n_copies)) AS INTEGER) AS copy FROM m)
SELECT doc_id, text, lang, source, n_chars, copy, n_copies,
       CAST(('0x' || substr(md5('{SEED}|order|' || CAST(doc_id AS VARCHAR) || '|' || copy), 1, 13)) AS BIGINT) / 4503599627370496.0 AS shuffle_key
FROM e
"""
