"""Language model, language identification, quality rules and mixing."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from riskloom.llm import hashed, language_id, lm_score, mixing, quality

SPLIT = re.compile("[\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def split(text):
    return [w for w in SPLIT.split(text or "") if w]


def crc(i):
    return None if i is None else zlib.crc32(str(i).encode())


def brute_lm(docs, order, prior):
    toks = [[*split(lower(t or "")), None] for _, t in docs]
    learn = [crc(i) is not None and crc(i) % 10 != 0 for i, _ in docs]
    c = Counter()
    for tk, ok in zip(toks, learn):
        if ok:
            c[("start",)] += 1
            s = ["start", *tk]
            for k in range(1, len(s)):
                for n in range(order):
                    if k - n >= 0:
                        c[(n, *s[k - n : k + 1])] += 1
    total = sum(v for k, v in c.items() if k[0] == 0)
    distinct = sum(1 for k in c if k[0] == 0)

    def p(w, g):
        if not g:
            return (c[(0, w)] + 0.1) / (total + 0.1 * (distinct + 1))
        seen = c[("start",)] if g == ("start",) else c[(len(g) - 1, *g)]
        return (c[(len(g), *g, w)] + prior * p(w, g[1:])) / (seen + prior)

    out = []
    for (i, _), tk in zip(docs, toks):
        s = ["start", *tk]
        score = sum(math.log10(p(s[k], tuple(s[max(0, k - order + 1) : k]))) for k in range(1, len(s)))
        base = sum(math.log10(p(w, ())) for w in tk)
        out.append((i, crc(i) is not None and crc(i) % 10 == 0, len(tk), sum(c[(0, w)] > 0 for w in tk), total, base, score))
    return out


@pytest.mark.parametrize("order, block, ranges", [(1, 1 << 24, 4096), (2, 20_000, 4096), (3, 50_000, 4096), (4, 3_000, 4096), (4, 3_000, 2), (2, 3_000, 1)])
def test_scores(edge, edge_rows, order, block, ranges):
    got = lm_score.lm_score(edge, order=order, prior=lm_score.PRIOR, block_bytes=block, most_ranges=ranges).collect()
    want = brute_lm([(r[0], r[1]) for r in edge_rows], order, lm_score.PRIOR)
    key = lambda r: (str(r[0]), r[2], r[5])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_registered_order_and_priors(spark):
    """The registered model uses contexts of three words, each length with its own prior."""
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choices("abcd", k=rng.randint(0, 30)))) for i in range(60)]
    toks = {i: ["start", *t.split(), None] for i, t in docs}
    c = Counter(tuple(s[k - n : k + 1]) for i, s in toks.items() if crc(i) % 10 for k in range(1, len(s)) for n in range(4) if k >= n)
    total, distinct = sum(v for g, v in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    c[("start",)] = sum(crc(i) % 10 != 0 for i in toks)

    def p(w, g):
        if not g:
            return (c[(w,)] + 0.1) / (total + 0.1 * (distinct + 1))
        prior = (8000.0, 500.0, 0.5)[len(g) - 1]
        return (c[(*g, w)] + prior * p(w, g[1:])) / (c[g] + prior)

    for r in lm_score.lm_score(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=400).collect():
        s = toks[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(p(s[k], tuple(s[max(0, k - 3) : k]))) for k in range(1, len(s))), rel=1e-9)


def test_probabilities_sum_to_one():
    texts = ["a b a c", "b a", "a a b"]
    b = lm_score.Block(texts, 3, 46)
    learn = np.ones(3, bool)
    counts = [b.counts(k, learn) for k in range(3)]
    total, distinct = int(counts[0].sum()), int((counts[0] > 0).sum())
    auto = lm_score.Automaton(b, counts, total, distinct, 3, 4.0)
    words = {k: b.gram[0][b.place[k]] if k else np.arange(b.v) for k in range(3)}
    arcs = {(s, w): p for k in range(3) for s, w, p in zip(auto.source[k].tolist(), words[k].tolist(), auto.logp[k].tolist()) if p == p}

    def log_p(state, word):
        out = 0.0
        while (state, word) not in arcs:
            out += auto.fail_weight[state]
            state = auto.fail[state]
        return out + arcs[state, word]

    for state in range(len(auto.fail)):
        seen = sum(10 ** log_p(state, w) for w in range(b.v) if counts[0][w] > 0)
        unseen = 0.1 / (total + 0.1 * (distinct + 1))
        while state:
            unseen *= 10 ** auto.fail_weight[state]
            state = auto.fail[state]
        assert seen + unseen == pytest.approx(1)
    source, target, logp = auto.source, auto.target, auto.logp
    # the traversal with a state at a time says the same as the one with resolved failure arcs
    next_state = {(s, w): t for k in range(3) for s, w, p, t in zip(source[k].tolist(), words[k].tolist(), logp[k].tolist(), target[k].tolist()) if p == p}
    for first, n, got in zip(b.first, b.sizes, auto.score()):
        state, want = auto.start, 0.0
        for w in b.gram[0][first : first + n].tolist():
            want += log_p(state, w)
            while (state, w) not in arcs:
                state = auto.fail[state]
            state = next_state[state, w]
        assert got == pytest.approx(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.sampled_from([40, 46, 64]))
def test_ranked(xs, bits):
    h = np.array([*xs, *xs[::2]], np.uint64)
    number, keys, place = lm_score.ranked(h, bits)
    own = h >> np.uint64(64 - bits)
    assert keys.tolist() == sorted(set(own.tolist())) and (keys[number] == own).all() and (own[place] == keys).all()


def test_messages_grow_with_the_input_and_unique_ngrams_stay_at_home(spark, monkeypatch):
    """With more buckets than ranges, twice the texts give at most 2.6 times the packed rows, and scores are those of one level; what only one block has isn't sent in the second round."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(200)) for _ in range(240)]
    sent = {}
    real = lm_score.materialise
    monkeypatch.setattr(lm_score, "materialise", lambda df, name: sent.setdefault(name, real(df, name)))
    monkeypatch.setattr(lm_score, "discard", lambda *tables: None)
    rows, scores = [], {}
    for n, ranges in ((120, 4), (240, 4), (240, 4096)):
        sent.clear()
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:n])], "doc_id long, text string").coalesce(1)
        got = {r.doc_id: r for r in lm_score.lm_score(docs, block_bytes=10_000, most_ranges=ranges).collect()}
        scores[ranges] = got
        if ranges == 4:
            assert {"words-sent", "words-teams", "ngrams-sent", "ngrams-teams"} <= set(sent)
            rows.append(sum(x.count() for name, x in sent.items()))
            blocks = sent["words-sent"].select("block").distinct().count()
            assert sent["words-sent"].groupBy("block", "ord").count().agg({"count": "max"}).first()[0] <= 4 and blocks > 8
            assert sent["words-teams"].select("block").distinct().count() > 1  # several teams
    assert rows[1] <= 2.6 * rows[0]  # a bucket more holds a row more of each team and length
    assert scores[4] == scores[4096]
    alone = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(300))) for i in range(40)], "doc_id long, text string").coalesce(1)
    sent.clear()
    lm_score.lm_score(alone, block_bytes=5_000).count()
    assert sent["words"].count() > 0 and sent["ngrams"].count() == 0


def test_lm_empty_and_unlearnt(spark, empty):
    assert lm_score.lm_score(empty).count() == 0
    held = next(i for i in range(1000) if crc(i) % 10 == 0)
    got = lm_score.lm_score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (got[0].train_tokens, got[0].n_known, got[0].score, got[0].base_score) == (0, 0, 0.0, 0.0)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50), st.integers(0, 60))
def test_packed_numbers(xs, shift):
    a = np.unique(np.array(xs, np.uint64) >> np.uint64(shift))
    assert (lm_score.unpack_keys(lm_score.pack_keys(a)) == a).all()
    assert (lm_score.unpack_numbers(lm_score.pack_numbers(a >> np.uint64(1))) == (a >> np.uint64(1)).astype(np.int64)).all()


def test_codewords():
    for n in range(2, 12):
        code = language_id.codewords(n)
        distance = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert len({tuple(c) for c in code.T}) > 1 or n == 2
        assert distance >= (2 ** (n - 2) if n <= 7 else code.shape[1] // 5)
    assert language_id.codewords(4).shape == (4, 7)


def test_language(spark, edge, edge_rows, empty):
    got = language_id.identify(edge).collect()
    assert len(got) == len(edge_rows)
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((r[0], crc(r[0]) is not None and crc(r[0]) % 4 == 2) for r in edge_rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for r in edge_rows[:40]:
        assert by[r[0]].lang_pred == r[2] and not by[r[0]].ambiguous and 0.5 < by[r[0]].score <= 1
    for i in (103, 105, 106, 107, 111):
        assert (by[i].lang_pred, by[i].score, by[i].ambiguous) == ("und", 0.0, True)
    kept = language_id.accepted(edge)
    assert kept.columns == edge.columns
    assert not {r.doc_id for r in kept.collect()} & {103, 104, 105, 106, 107, 111} and kept.count() >= 40
    assert language_id.identify(empty).count() == 0
    alone = edge.where("lang = 'aa'")
    assert {r.lang_pred for r in language_id.identify(alone).collect()} <= {"aa", "und"}
    none = language_id.identify(edge.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def test_labels_are_no_input(edge):
    plain = {(r.doc_id, r.score) for r in language_id.identify(edge).collect()}
    model = language_id.fit(edge, "doc_id", "text", "lang")
    blind = language_id.predict(edge.select("doc_id", "text"), model, "text", ("lang_pred", "score", "ambiguous"))
    assert {(r.doc_id, r.score) for r in blind.collect()} == plain


def brute_counts(text):
    words = split(text)
    wins = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    marked = {k + j for k in range(len(words) - 7) if wins[tuple(words[k : k + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(marked)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab  \n\t\x1c\x85#")), max_size=120), min_size=1, max_size=4))
def test_base_counts(data):
    words, ids, doc, _ = quality.tokenised(data)
    c = quality.base_counts(data, words, ids, doc)
    for i, text in enumerate(data):
        assert tuple(int(v[i]) for v in c.values()) == brute_counts(text)


def quality_docs():
    rng = random.Random(8)
    good, bad = "the of and to in is was for on with as by".split(), "$$$ ### %%% buy now free &&&".split()
    docs, labels = [], []
    for i in range(300):
        pool = good if i % 4 else bad
        docs.append((i, " ".join("".join(rng.choices("abcdef", k=4)) if rng.random() < 0.4 else rng.choice(pool) for _ in range(rng.randint(10, 90)))))
        if i % 3:
            labels.append((i, int(bool(i % 4)), 0))
    docs += [(1000, None), (1001, ""), (1002, "one two three four five six seven eight " * 9), (5, docs[5][1])]
    return docs, [*labels, (None, 1, 0), (7777, 0, 0), (4, 5, 0), (8, None, 0)]


def test_quality(spark, empty):
    docs, labels = quality_docs()
    df, lb = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality(df, lb).collect()
    assert len(got) == len(docs)
    text = dict(docs)
    for r in got:
        want = brute_counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed and r.probability >= quality.THRESHOLD)
    unseen = [r for r in got if r.doc_id < 300 and r.doc_id % 3 == 0]
    assert sum((r.probability >= 0.5) == bool(r.doc_id % 4) for r in unseen) > 0.95 * len(unseen)
    one = quality.quality(df, lb.where("quality = 1")).collect()
    assert {r.probability for r in one} == {None} and all(r.kept != r.base_failed for r in one)
    assert quality.quality(empty, lb).count() == 0 and quality.quality(df, lb.limit(0)).count() == len(docs)


def test_features_and_decoding_by_plain_loops():
    """Hashed frequencies and loss-weighted decoding against their definitions."""
    texts = ["ab ab c", "", "bca abca b"]
    x = language_id.features(texts)
    raw = [" " + t.lower() + " " for t in texts]
    for row, t in zip(x, raw):
        for k, n in enumerate(language_id.ORDERS):
            grams = Counter(t[i : i + n] for i in range(len(t) - n + 1))
            part = row[k << language_id.BITS : (k + 1) << language_id.BITS]
            assert sorted(v**2 for v in part[part > 0]) == pytest.approx(sorted(c / sum(grams.values()) for c in grams.values()), abs=1e-6)
    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b", "c"], rng.normal(size=(x.shape[1] + 1, 3)).astype(np.float32))
    best, score, lead = model.decode(x)
    for i in range(3):
        margins = x[i] @ model.w[:-1] + model.w[-1]
        loss = [sum(math.log1p(math.exp(-c * m)) for c, m in zip(model.code[j], margins)) for j in range(3)]
        p = [math.exp(-v) / sum(math.exp(-u) for u in loss) for v in loss]
        assert best[i] == int(np.argmin(loss)) and score[i] == pytest.approx(max(p), rel=1e-4)
        assert lead[i] == pytest.approx(sorted(p)[-1] - sorted(p)[-2], abs=1e-4)


def test_logistic_regression_is_at_its_least_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)).astype(np.float32)
    y = np.where(rng.random(200) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5, 0.0] + 0.3))), 1.0, -1.0).astype(np.float32)[:, None]
    weight = rng.random(200)
    w = hashed.fit_logistic(x, y, weight, ridge=1e-2, rounds=2000).astype(np.float64)
    share = weight / weight.sum()

    def loss(w):
        return (share * np.logaddexp(0, -y[:, 0] * (x @ w[:-1, 0] + w[-1, 0]))).sum() + 0.5e-2 * (w[:-1] ** 2).sum()

    for k in range(5):
        for step in (-0.02, 0.02):
            other = w.copy()
            other[k] += step
            assert loss(other) > loss(w)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_accuracy_on_documents_that_were_not_learned_from(spark):
    """Languages of held-out documents; qualities of documents whose labels were kept back."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    docs, labels = read("documents"), read("labels")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right, n = got.agg(F.sum(F.expr("CAST(lang = lang_pred AS INT)")), F.count("*")).first()
    assert n > 100 and right >= 0.95 * n
    back = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    seen = quality.quality(docs, labels.where(~back)).join(labels.where(back).select("doc_id", "quality"), "doc_id").where("quality IN (0, 1) AND probability IS NOT NULL")
    right, n = seen.agg(F.sum(F.expr("CAST((probability >= 0.5) = (quality = 1) AS INT)")), F.count("*")).first()
    assert n > 50 and right >= 0.9 * n


def test_quality_edge_rows(spark, edge, edge_rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = quality.quality(edge, labels).collect()
    key = lambda t: (str(t[0]), *t[1:])
    want = sorted(((r[0], *brute_counts(r[1])) for r in edge_rows), key=key)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == want
    assert all(r.kept == (not r.base_failed and r.probability >= 0.5) for r in got)


def test_calibration():
    rng = np.random.default_rng(0)
    margin = rng.normal(size=4000)
    y = np.where(rng.random(4000) < 1 / (1 + np.exp(-(2 * margin - 1))), 1.0, -1.0)
    slope, shift = quality.calibrate(margin, y, np.ones(4000))
    assert slope == pytest.approx(2, abs=0.2) and shift == pytest.approx(-1, abs=0.2)


def uniform(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def poisson_quantile(mean, u):
    k, p = 0, math.exp(-mean)
    total = p
    while total <= u:
        k += 1
        p *= mean / k
        total += p
    return k


def test_mixing(spark, edge, edge_rows, empty):
    got = mixing.mix_sources(edge)
    assert got.columns[: len(edge.columns)] == edge.columns
    n = Counter(r[3] for r in edge_rows)
    w = {s: math.sqrt(c) for s, c in n.items()}
    rate = {s: w[s] / sum(w.values()) * sum(n.values()) / c for s, c in n.items()}
    want = Counter()
    names = {r.text: f"row {r.h}" for r in edge.where("doc_id IS NULL").withColumn("h", F.xxhash64(*edge.columns)).collect()}
    for r in edge_rows:
        for _ in range(poisson_quantile(rate[r[3]], uniform(42, names[r[1]] if r[0] is None else r[0]))):
            want[(r[0], r[1])] += 1
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_meets_targets(spark):
    df = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN 'rare' ELSE 'rest' END AS source")
    got = mixing.mix_sources(df, weights={"hot": 0.2, "rare": 0.3, "none": 9.0, "rest": 0.5})
    count = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    total = sum(count.values())
    assert total == pytest.approx(30_000, rel=0.03)
    for s, share in (("hot", 0.2), ("rare", 0.3), ("rest", 0.5)):
        assert count[s] / total == pytest.approx(share, abs=0.015)
    only = mixing.mix_sources(df, weights={"hot": 1.0})
    assert {r["source"] for r in only.select("source").distinct().collect()} == {"hot"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_mixing_with_more_sources_than_are_broadcast(edge, monkeypatch):
    few = Counter((r.doc_id, r.text) for r in mixing.mix_sources(edge).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert Counter((r.doc_id, r.text) for r in mixing.mix_sources(edge).collect()) == few


def test_large_rates(spark):
    """A rate over PART_MEAN is a sum of parts; a document's many copies are all there, in many partitions."""
    df = spark.createDataFrame([(0, "one"), *((i, "rest") for i in range(1, 20_001))], "doc_id long, source string")
    got = mixing.mix_sources(df, weights={"one": 1, "rest": 1})
    rate = 20_001 / 2
    parts = math.ceil(rate / mixing.PART_MEAN)
    want = sum(poisson_quantile(rate / parts, uniform(42, 0, "part", i)) for i in range(1, parts + 1))
    one = got.where("source = 'one'")
    assert abs(want - rate) < 6 * math.sqrt(rate) and want > 2 * mixing.RANGE
    assert sorted(r["copy"] for r in one.collect()) == list(range(want)) and {r.n_copies for r in one.collect()} == {want}
    assert one.select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_only_ratios_of_weights_count(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a', 'b') AS source")
    key = ["doc_id", "copy"]
    many = [sorted(tuple(r) for r in mixing.mix_sources(df, weights={"a": 2 * f, "b": 3 * f, "absent": 1e9 * f}).select(*key).collect()) for f in (1e-9, 1.0, 2.0**40)]
    assert many[0] == many[1] == many[2] and len(many[0]) > 2500
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.mix_sources(df, weights={"a": bad})


def test_rows_without_ids_are_dealt_out(spark):
    df = spark.range(20_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'s' AS source", "CAST(id AS STRING) AS text")
    got = mixing.mix_sources(df)
    per = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per) == 4 and max(per) < 1.2 * min(per) and sum(per) == pytest.approx(20_000, rel=0.05)


def test_samples_stay_bounded_when_an_id_is_repeated(spark):
    """A third of the rows have one id: it may be learned from once at most."""
    docs, labels = quality_docs()
    hot = [(i, docs[i][1]) for i in range(300)] + [(1, docs[1][1])] * 3000
    df, lb = spark.createDataFrame(hot, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain = quality.fit(spark.createDataFrame(docs[:300], "doc_id long, text string"), lb, "doc_id", "text", "quality")
    same = quality.fit(df, lb, "doc_id", "text", "quality")
    assert np.allclose(plain.w, same.w) and (plain.slope, plain.shift) == pytest.approx((same.slope, same.shift))
    langs = df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    a = language_id.fit(langs.where("doc_id <> 1").unionByName(langs.where("doc_id = 1").limit(1)), "doc_id", "text", "lang")
    b = language_id.fit(langs, "doc_id", "text", "lang")
    assert a.languages == b.languages and np.allclose(a.w, b.w)
