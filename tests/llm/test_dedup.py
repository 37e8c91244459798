"""Exact dedup, line dedup and the Jaccard join against brute force."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from riskloom.llm import common, exact_dedup, jaccard_join, line_dedup

RUN = re.compile("[\x20\x09-\x0d]+")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab  \t\n\x0b\x1c\x85é"))))
def test_normalised(text):
    assert exact_dedup.normalised(text) == RUN.sub(" ", text).encode()


def test_cut_points_cover_and_follow_content():
    rng = random.Random(1)
    data = bytes(rng.choices(range(97, 123), k=200_000))
    ends = exact_dedup.cut_points(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes[:-1].min() >= exact_dedup.LEAST and sizes.max() <= exact_dedup.MOST
    moved = exact_dedup.cut_points(b"some words before" + data)
    own = {data[a:b] for a, b in zip([0, *ends], ends)}
    other = {(b"some words before" + data)[a:b] for a, b in zip([0, *moved], moved)}
    assert len(own & other) > 0.9 * len(own)
    assert exact_dedup.cut_points(b"") == [] and exact_dedup.cut_points(b"x") == [1]


def test_long_texts_with_many_repeated_lines(spark):
    """Work grows as the lines, not as lines times removed lines."""
    text = "\n".join(f"line {i}" for i in range(60_000))
    got = line_dedup.dedup_lines(spark.createDataFrame([(1, text), (2, text + "\nlast")], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_removed, r.text) for r in got} == {1: (0, text), 2: (60_000, "last")}


def test_chunks_of_unique_documents_stay_when_the_bitmap_is_full(spark, monkeypatch):
    monkeypatch.setattr(common, "BITMAP_BITS", 6)
    moved = []
    real = exact_dedup._contents
    monkeypatch.setattr(exact_dedup, "_contents", lambda df, *a: real(moved.append(df.select("id").collect()) or df, *a))
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=300))) for i in range(400)]
    docs += [(1000 + i, docs[i][1]) for i in range(5)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.id for r in moved[0]) == [*range(5), *range(1000, 1005)]
    assert {r.doc_id for r in got.collect() if not r.kept} == set(range(1000, 1005))


@pytest.mark.parametrize("bits", [64, 2])  # with 2 bits nearly all chunk hashes have several contents
def test_exact_dedup(edge, edge_rows, empty, bits):
    got = exact_dedup.exact_dedup(edge, hash_bits=bits).collect()
    groups = defaultdict(list)
    for r in edge_rows:
        groups[RUN.sub(" ", r[1] or "")].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = min(ids, key=lambda i: (i is None, i or 0))
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    for sha in {r.text_sha256 for r in got}:
        stay = [r for r in got if r.text_sha256 == sha and r.kept]
        assert len(stay) == 1 and stay[0].doc_id == stay[0].keep_id
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_keep_first(edge, edge_rows):
    got = exact_dedup.keep_first(edge)
    assert got.columns == edge.columns
    texts = [RUN.sub(" ", r.text or "") for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({RUN.sub(" ", r[1] or "") for r in edge_rows})


def brute_lines(docs, skip_blank):
    """Rows with distinct ids in order; the positions to remove of each."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        lines = [] if text is None else text.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            win = tuple(lines[p : p + 3])
            if skip_blank and not RUN.sub("", "".join(win)):
                continue
            if win in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(win)
        out[i] = sorted(gone)
    return out


def test_line_dedup(spark, edge, empty):
    rng = random.Random(3)
    pool = [f"line {i} of the pool" for i in range(12)] + ["", " "]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 25))) if i % 17 else None) for i in range(150)]
    docs += [(200, "a\n\n\n\nb"), (201, "c\n\n \n\n\nd"), (202, "e\n\n\n\n\nf")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_lines(docs, True)
    assert {r.doc_id: r.removed for r in line_dedup.dedup_lines(df, skip_blank=True).collect()} == want != brute_lines(docs, False)
    want = brute_lines(docs, False)
    got = line_dedup.dedup_lines(df).collect()
    assert {r.doc_id: r.removed for r in got} == want
    for r, (i, text) in zip(sorted(got, key=lambda r: r.doc_id), sorted(docs)):
        lines = [] if text is None else text.split("\n")
        assert r.n_lines == len(lines) and r.n_removed == len(want[i])
        assert r.text == (None if text is None else "\n".join(x for p, x in enumerate(lines) if p not in want[i]))
    full = line_dedup.dedup_lines(edge)
    assert full.count() == edge.count() and full.columns[: len(edge.columns)] == edge.columns
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_short_texts(spark):
    """With `short`, later copies of a whole text of one or two lines go; parts of longer texts don't, nor, with `skip_blank`, texts without a word."""
    docs = [(1, "a b"), (2, "a b"), (3, "a b\nc"), (4, "a b\nc"), (5, "a b\nc\nd"), (6, "a b\n"), (7, " "), (8, " "), (9, ""), (10, None), (11, "a b\nc\nd"), (12, "\na b"), (2, "e\nf\ng\nh"), (None, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.n_lines): (r.text, r.removed) for r in line_dedup.dedup_lines(df, short=True, skip_blank=True).collect()}
    gone = {(2, 1): ("", [0]), (4, 2): ("", [0, 1]), (11, 3): ("", [0, 1, 2]), (2, 4): ("f\ng\nh", [0]), (None, 1): ("", [0])}
    assert got == {(i, 0 if t is None else t.count("\n") + 1): (t, []) for i, t in docs} | gone


@pytest.mark.parametrize("size", [30, 1000])
def test_unrelated_texts_match_by_chance_as_modelled(spark, size):
    """Texts of any length with no shingle in common agree in 1 of 256 short values, equal ones in all."""
    docs = [(i, " ".join(f"w{i}-{k}" for k in range(size))) for i in range(40)]
    rows = jaccard_join._signatures(spark.createDataFrame([*docs, (40, docs[0][1])], "id long, text string"), "id", "text", 5).collect()
    sig = {r.id: np.frombuffer(r.sig, np.uint8) for r in rows}
    assert (sig[0] == sig[40]).all()
    same = [(sig[i] == sig[j]).mean() for i in range(40) for j in range(i)]
    assert 0.5 / 256 < np.mean(same) < 2 / 256


def shingle_sets(texts):
    out = []
    for x in texts:
        w = [y for y in RUN.split(x or "") if y]
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_join(docs):
    """id -> class_id, class_size, n_links, n_linked_docs, group_id."""
    docs = sorted(docs)
    ids, sets = [d[0] for d in docs], shingle_sets([d[1] for d in docs])
    n = len(docs)
    same = [[bool(a) and a == b for b in sets] for a in sets]
    near = [[bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets]
    group = list(range(n))
    for _ in range(n):
        new = [min([group[i], *(group[j] for j in range(n) if near[i][j])]) for i in range(n)]
        if new == group:
            break
        group = new
    out = {}
    for i in range(n):
        own = [j for j in range(n) if j == i or same[i][j]]
        linked = [j for j in range(n) if near[i][j] and not same[i][j]]
        classes = {min(k for k in range(n) if same[j][k]) for j in linked}
        out[ids[i]] = (ids[min(own)], len(own), len(classes), len(linked) + len(own) - 1, ids[group[i]])
    return out


def near_docs():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    docs, i = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 9, 30, 120, 300]))]
        for _ in range(rng.choice([1, 1, 2, 5, 14])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 40])):
                text[rng.randrange(len(text))] = word()
            docs.append((i, (" " if i % 2 else "\n ").join(text)))
            i += 1
    return [*docs, (900, ""), (901, ""), (902, None), (903, " \t")]


@pytest.mark.parametrize("part", [1024, 3])  # with 3 most buckets are dealt over several tiles
def test_jaccard_join(spark, empty, part):
    docs = near_docs()
    got = jaccard_join.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), part=part).collect()
    assert {r.doc_id: (r.class_id, r.class_size, r.n_links, r.n_linked_docs, r.group_id) for r in got} == brute_join(docs)
    assert all(r.kept == (r.doc_id == r.group_id) for r in got)
    if part == 3:
        assert jaccard_join.jaccard_join(empty).count() == 0 and jaccard_join.keep_one(empty).count() == 0


def test_jaccard_edge_rows(edge):
    got = jaccard_join.jaccard_join(edge).collect()
    assert len(got) == edge.count()
    groups = defaultdict(list)
    for r in got:
        groups[r.group_id, r.doc_id if r.class_size == 1 and not r.n_links else None].append(r)
    assert sum(r.kept for r in got) == jaccard_join.keep_one(edge).count()
    rows = jaccard_join.keep_one(edge)
    assert rows.columns == edge.columns
    kept = Counter(r.text for r in rows.collect())
    assert kept[None] == 3 and kept[""] == 2  # texts without words are alone


def test_pruning_keeps_what_reaches_the_threshold():
    least = jaccard_join.least_matches(0.8, 1e-6)
    assert len(least) == 4 and all(0 < a < 16 * (k + 1) for k, a in enumerate(least)) and least == sorted(least)
    rng = np.random.default_rng(2)
    lost = tried = 0
    for _ in range(60):
        common, own = rng.integers(0, 2**63, 160), rng.integers(0, 2**63, 40)
        a, b = np.sort(np.concatenate([common, own[:20]])), np.sort(np.concatenate([common, own[20:]]))  # 0.8 exactly
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        values = jaccard_join.minhashes([a, b])
        keys, sig = jaccard_join.band_keys(values), jaccard_join.short_values(values)
        assert (keys[0] == keys[1]).any()
        left, _ = jaccard_join.survivors(sig, keys, np.array([180, 180]), np.array([0]), np.array([1]), 0, jaccard_join.Fraction("0.8"), least)
        lost, tried = lost + (len(left) == 0), tried + 1
    assert lost == 0 and tried == 60


def test_what_is_written_grows_with_the_members_not_the_pairs(spark, monkeypatch):
    """A group of n near copies has n * (n - 1) / 2 links; all are counted, none is written."""
    sizes = {}
    real = jaccard_join.materialise
    monkeypatch.setattr(jaccard_join, "materialise", lambda df, name: (table := real(df, name), sizes.setdefault(name, table))[0])
    base = [f"w{k}" for k in range(120)]
    for n in (100, 200):
        docs = [(i, " ".join([*base[:60], f"x{i}", *base[60:]])) for i in range(n)]
        sizes.clear()
        monkeypatch.setattr(jaccard_join, "discard", lambda *tables: None)
        got = jaccard_join.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), part=64).collect()
        assert {r.n_links for r in got} == {n - 1} and {r.group_id for r in got} == {0}
        assert sizes["members"].count() <= 24 * n and sizes["needed"].count() == n and sizes["links"].count() <= 24 * n * math.ceil(n / 64)


def test_parts_of_long_texts_have_fewer_members(spark, monkeypatch):
    """Links are the same however few sets a part may hold; the number of tiles grows with their bytes."""
    docs = near_docs()
    rows = []
    real = jaccard_join._dealt
    monkeypatch.setattr(jaccard_join, "_dealt", lambda df: (rows.append(df.count()), real(df))[1])
    for limit in (jaccard_join.PART_BYTES, 4096):
        monkeypatch.setattr(jaccard_join, "PART_BYTES", limit)
        got = jaccard_join.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert {r.doc_id: (r.class_id, r.class_size, r.n_links, r.n_linked_docs, r.group_id) for r in got} == brute_join(docs)
    assert rows[0] == rows[2] and rows[3] > rows[1]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_recall_on_documents(spark):
    """Ids divisible by 100 against all rows, by brute force over the shingles: no link is lost, none is made up."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.n_linked_docs for r in jaccard_join.jaccard_join(docs).collect() if r.doc_id % 100 == 0}
    rows = docs.collect()
    sets = shingle_sets([r.text for r in rows])
    asked = [(r.doc_id, s) for r, s in zip(rows, sets) if r.doc_id % 100 == 0]
    want = {i: sum(bool(a) and 5 * len(a & b) >= 4 * len(a | b) for b in sets) - bool(a) for i, a in asked}
    assert len(got) == len(want) >= 100 and got == want and sum(want.values()) > 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = list(range(500))
    for _ in range(500):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.u: r.root for r in jaccard_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges for x in e}
    assert got == {x: root[x] for x in nodes if root[x] != x}
