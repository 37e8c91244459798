"""Removal of repeated passages by overlapping windows of three lines.

Each run of three consecutive lines is hashed (two independent 64-bit hashes).
The first occurrence of a window, by document id and position, stays; every
later one is removed, and the positions that removed windows cover are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Bitmap, fresh, materialise

WINDOW = 3


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _has_word(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def window_hashes(df: DataFrame, id_col: str, text_col: str, width: int = WINDOW, short: bool = False, skip_blank: bool = False) -> DataFrame:
    """id, pos, h1, h2 of each window; with `skip_blank` only of those that have a word in them.

    With `short`, a text of n < `width` lines has one window of them all, padded with nulls, at pos -n.
    """
    lines = F.col("lines")
    at = F.sequence(F.lit(0), F.greatest(F.size(lines) - width, F.lit(0)) if short else F.size(lines) - width)
    pos = (lambda i: F.when(F.size(lines) < width, -F.size(lines)).otherwise(i)) if short else lambda i: i
    key = lambda i: [F.get(lines, i + k) for k in range(width)]
    wins = F.transform(at, lambda i: F.struct(pos(i).alias("pos"), F.xxhash64(*key(i)).alias("h1"), F.xxhash64(F.lit("second"), *key(i)).alias("h2"), (F.greatest(*(_has_word(x) for x in key(i))) if skip_blank else F.lit(True)).alias("word")))
    return df.select(F.col(id_col).alias("id"), _lines(text_col).alias("lines")).where(F.size("lines") >= (1 if short else width)).select("id", F.explode(wins).alias("w")).select("id", "w.*").where("word").drop("word")


def covered_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, short: bool = False, skip_blank: bool = False) -> DataFrame:
    """id and covered, the sorted positions of the lines to remove; a row per document that has some."""
    hashes = window_hashes(df, id_col, text_col, width, short, skip_blank)
    first = hashes.groupBy("h1", "h2").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    later = hashes.join(first, ["h1", "h2"]).where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("pos") == F.col("first.pos"))))
    starts = later.groupBy("id").agg(F.collect_set("pos").alias("starts"))
    span = (lambda p: F.sequence(F.greatest(p, F.lit(0)), F.when(p < 0, -p - 1).otherwise(p + width - 1))) if short else lambda p: F.sequence(p, p + width - 1)
    return starts.select("id", F.array_sort(F.array_distinct(F.flatten(F.transform("starts", span)))).alias("covered"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, short: bool = False, skip_blank: bool = False) -> DataFrame:
    """All rows and columns, the text without the lines of repeated windows.

    Adds n_lines, n_removed and removed (the positions, from 0, in order) under names that
    may get underscores if `df` has them.  Lines are what newlines separate, compared
    exactly.  A text of fewer than `width` lines has no window and stays, unless
    `short` gives it one window of all its lines, so that later copies of the whole text go.
    Windows of blank lines count like any other, unless `skip_blank` leaves those without a word alone.  Texts of any
    length are whole: work grows as their lines.  Null texts have no window and stay null.  Rows that share an id are
    one document to the order: where they repeat a window at the same
    position, both keep it; removed positions hold for each of them.
    Windows that overlap their own earlier occurrence are removed as well.
    An empty table gives an empty result.
    """
    n_lines, n_removed, removed, key, covered, all_lines = fresh(df, "n_lines", "n_removed", "removed", "key", "covered", "all_lines")
    found = materialise(covered_lines(df, id_col, text_col, width, short, skip_blank).toDF(key, covered), "covered")
    # only documents that may lose lines are moved to meet their positions
    some, rest = Bitmap(found, F.col(key)).split(df, F.col(id_col))
    out = some.join(found, F.col(id_col).eqNullSafe(F.col(key)), "left").drop(key)
    out = out.unionByName(rest.withColumn(covered, F.lit(None).cast("array<int>"))).withColumn(all_lines, _lines(text_col))
    lines, gone = F.col(all_lines), F.col(covered)
    out = out.withColumn(removed, F.coalesce(F.filter(gone, lambda p: p < F.size(lines)), F.array().cast("array<int>")))
    out = out.withColumn(n_removed, F.size(removed).cast("long")).withColumn(n_lines, F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    out = out.withColumn(text_col, F.when(F.col(n_removed) == 0, F.col(text_col)).otherwise(kept))
    return out.select(*df.columns, n_lines, n_removed, removed)


QUERY_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, lines, CAST(unnest(range(len(lines))) AS INTEGER) AS pos FROM d WHERE text IS NOT NULL),
w AS (SELECT doc_id, pos, len(lines) AS n, lines[pos + 1] AS a, lines[pos + 2] AS b, lines[pos + 3] AS c FROM l WHERE pos = 0 OR pos + 3 <= len(lines)),
r AS (SELECT doc_id, pos, n, row_number() OVER (PARTITION BY a, b, c, least(n, 3) ORDER BY doc_id, pos) AS nth FROM w),
gone AS (SELECT DISTINCT doc_id, pos + k.k AS pos FROM r, (VALUES (0), (1), (2)) k(k) WHERE nth > 1 AND pos + k.k < n),
rest AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
         coalesce(string_agg(CASE WHEN gone.pos IS NULL THEN lines[l.pos + 1] END, chr(10) ORDER BY l.pos), '') AS cleaned
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(rest.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(rest.n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(rest.cleaned) END AS text_sha256
FROM d LEFT JOIN rest ON d.doc_id = rest.doc_id
"""
