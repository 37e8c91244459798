"""The pipeline stage by stage, and the registered queries."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from riskloom.llm import queries
from test_dedup import shingle_sets
from test_models import poisson_quantile, uniform
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, edge):
    """Each stage, on what its predecessor kept, against a version of its own that shares no code with the operators."""
    run = re.compile("[\x20\x09-\x0d]+")
    norm = lambda t: run.sub(" ", t or "")
    order = lambda r: (r.doc_id is None, r.doc_id or 0)
    docs = edge
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns, name
        rows, kept = docs.collect(), after.collect()
        before, now = Counter((r.doc_id, r.text) for r in rows), Counter((r.doc_id, r.text) for r in kept)
        if name == "language_id":  # two languages without a letter in common; what has no letter goes
            assert not now - before
            clean = {(r.doc_id, r.text) for r in rows if r.doc_id is not None and r.doc_id < 40}
            assert clean <= set(now) and not any(re.fullmatch(r"[\W\d_]*", r.text or "") for r in kept)
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for r in rows:
                groups[norm(r.text)].append(r)
            assert now == Counter((min(g, key=order).doc_id, min(g, key=order).text) for g in groups.values())
        elif name == "jaccard_join":
            sets = shingle_sets([r.text for r in rows])
            root = list(range(len(rows)))
            for _ in rows:
                for i in range(len(rows)):
                    for j in range(len(rows)):
                        if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                            root[i] = root[j] = min(root[i], root[j])
            assert now == Counter((g.doc_id, g.text) for g in (min((r for r, at in zip(rows, root) if at == k), key=order) for k in set(root)))
        else:
            n = Counter(r.source for r in rows)
            total = sum(math.sqrt(c) for c in n.values())
            want = Counter()
            for r in rows:
                if r.doc_id is not None:
                    want[r.doc_id, r.text] += poisson_quantile(math.sqrt(n[r.source]) / total * len(rows) / n[r.source], uniform(42, r.doc_id))
            assert Counter({k: c for k, c in now.items() if k[0] is not None}) == +want
        docs = spark.createDataFrame(kept, after.schema)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    parts, want = defaultdict(list), []
    for r in pieces:
        parts[r.doc_row].append((r.start, r.length, r.ids_crc32, r.doc_id))
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((str(r.doc_id), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    whole = [(str(p[0][3]), sum(x[1] for x in p)) for p in parts.values()]
    assert sorted(whole) == sorted(w[:2] for w in want)
    one = [(str(p[0][3]), p[0][1], p[0][2]) for p in parts.values() if len(p) == 1]
    assert not Counter(one) - Counter(want)


def test_empty(spark, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_run(spark):
    for name, run in queries.queries().items():
        assert run(spark, DATA).count() > 0, name
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert set(queries.oracle_sql()) <= set(queries.queries())
