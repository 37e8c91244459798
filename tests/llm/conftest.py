import random

import pytest
from pyspark.sql import types as T

# Names that operators use inside or return; tables may have them already.
CLASHES = ["kept", "keep_id", "sha", "row", "copy", "n_copies", "shuffle_key", "covered", "key", "n", "score", "lang_pred", "ambiguous", "group_id", "t1", "removed", "stay", "u", "cdf"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASHES)])


def words(rng, n, letters="abcdefghij"):
    return [" ".join("".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(8)) for _ in range(n)]


def rows():
    """Nulls in any column, empty and very long texts, equal texts, equal ids, repeated rows."""
    rng = random.Random(5)
    out = []
    for i in range(40):
        lang, letters = (("aa", "abcdefghij"), ("bb", "klmnopqrst"))[i % 2]
        out.append((i, "\n".join(words(rng, rng.randint(1, 9), letters)), lang, f"s{i % 3}", 1))
    base = out[3][1]
    out += [(100, base, "aa", "s0", 1), (101, base.replace(" ", " \t "), "aa", None, None), (102, " " + base, None, "s1", 1)]
    out += [(103, "", "aa", "s0", 0), (104, "", "bb", "s0", 0), (105, None, "bb", "s0", None), (106, " \n\t ", "bb", "s1", 3), (107, None, None, None, None)]
    out += [(108, base + " x", "bb", "s1", 1), (108, base + " x", "bb", "s1", 1), (108, "another text of the same id", "aa", "s1", 1), (None, base, "aa", "s2", 1), (None, None, "aa", "s2", 1)]
    out += [(109, " ".join(words(rng, 4000)), "aa", "s0", 1), (110, "z" * 70_000, "aa", "s0", 1), (111, "1234 5678 !!! $$$", "aa", "s1", 1), (112, "é漢字 😀 <|endoftext|> \x1c \x85  x ▁ ''s", "bb", "s1", 1)]
    return [(*r, *["x"] * len(CLASHES)) for r in out]


@pytest.fixture(scope="session")
def edge_rows():
    return rows()


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
