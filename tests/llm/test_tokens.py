"""Token counts and packing against the libraries themselves."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from riskloom.llm import packing, token_counts
from tokenizers import Tokenizer

PIECE, WORD = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
SP, TK = sentencepiece.SentencePieceProcessor(model_file=PIECE), Tokenizer.from_file(WORD)
ODD = st.text(alphabet=st.sampled_from(list("abetion  \n\t▁éß漢😀\x00\x1c\x85\xa0 ,.'<>|s/")), max_size=60)
LATIN = st.text(alphabet=st.one_of(st.sampled_from(list("aeTN  \n..,,'sSÉßµª²_-<|")), st.characters(max_codepoint=255)), max_size=60)


@settings(max_examples=150, deadline=None)
@given(ODD)
def test_every_prefix_count_is_exact(text):
    table = token_counts.counter(PIECE).table(text)
    assert [len(SP.encode(text[:k])) for k in range(len(text) + 1)] == table.tolist()


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_word_ids_are_the_library_s(text):
    ids = np.frombuffer(packing.encoder(WORD).text(text), "<u4").tolist()
    assert ids == TK.encode(text, add_special_tokens=False).ids


@settings(max_examples=1500, deadline=None)
@given(LATIN)
def test_word_ids_of_latin_texts(text):
    ids = np.frombuffer(packing.encoder(WORD).text(text), "<u4").tolist()
    assert ids == TK.encode(text, add_special_tokens=False).ids


def test_special_strings():
    for text in ("<s> </s> <unk> <0x41>", "a<s>b"):
        assert int(token_counts.counter(PIECE).table(text)[-1]) == len(SP.encode(text))
    assert np.frombuffer(packing.encoder(WORD).text("<|ENDoftext|> x. <|endoftext|>"), "<u4").tolist() == TK.encode("<|ENDoftext|> x. <|endoftext|>", add_special_tokens=False).ids
    text = "a <|endoftext|>b<|startoftext|> It's DON'T we'll 'S"
    assert np.frombuffer(packing.encoder(WORD).text(text), "<u4").tolist() == TK.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.one_of(ODD, LATIN))
def test_ids_by_any_other_tokenizer(text):
    other = P.path("byte_bpe_50k.json")
    ids = np.frombuffer(packing.encoder(other).text(text), "<u4").tolist()
    assert not packing.encoder(other).by_words and packing.encoder(WORD).by_words
    assert ids == Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=40))
def test_pack_is_descending_cheapest_with_room(lengths):
    """What fits whole goes where a plain loop over all sequences puts it; ties by number."""
    size, total = 64, sum(lengths)
    room = [size] * (total // size) + [1 << k for k in range(6, -1, -1) if total % size >> k & 1]
    cost, where = [0.0] * len(room), {}
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fit = [at for at in range(len(room)) if room[at] >= lengths[k]]
        if fit:
            at = min(fit, key=lambda at: (cost[at], at))
            where[k], room[at] = at, room[at] - lengths[k]
            cost[at] += lengths[k] + lengths[k] ** 2 / size
    got = {k: at for k, start, n, at, _ in packing.pack(lengths, size) if n == lengths[k] and k in where}
    assert got == where


def test_counter_refuses_models_it_does_not_hold_for(monkeypatch):
    monkeypatch.setattr(token_counts, "_piece_types", lambda proto: [1] * SP.get_piece_size())
    with pytest.raises(ValueError, match="byte pieces"):
        token_counts.PrefixCounter(PIECE)


def test_counts_over_edge_rows(edge, edge_rows, empty):
    got = token_counts.token_counts(edge, PIECE, limit=50, keep_table=True).collect()
    assert len(got) == len(edge_rows)
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(SP.encode(r[1] or ""))) for r in edge_rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    for r in got:
        assert r.over_limit == (r.n_tokens > 50)
        assert r.prefix_counts[r.limit_chars] <= 50 and all(n > 50 for n in r.prefix_counts[r.limit_chars + 1 :])
    assert token_counts.token_counts(empty, PIECE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=60), st.sampled_from([16, 64]))
def test_pack_fills_sequences(lengths, size):
    pieces = packing.pack(lengths, size)
    by_item, by_seq = defaultdict(list), defaultdict(list)
    for k, start, n, at, offset in pieces:
        by_item[k].append((start, n))
        by_seq[at].append((offset, n))
    for k, n in enumerate(lengths):
        end = 0
        for start, m in sorted(by_item[k]):
            assert start == end and m > 0
            end += m
        assert end == n
    assert sorted(by_seq) == list(range(len(by_seq)))
    for parts in by_seq.values():
        end = 0
        for offset, m in sorted(parts):
            assert offset == end
            end += m
        assert end == size or end & (end - 1) == 0


def test_pack_balances_cost():
    rng = np.random.default_rng(0)
    lengths = rng.integers(20, 900, 600).tolist()
    cost = defaultdict(float)
    for _, _, n, at, _ in packing.pack(lengths, 4096):
        cost[at] += n + n * n / 4096
    full = [c for at, c in cost.items() if at < sum(lengths) // 4096]
    assert np.std(full) < 0.1 * np.mean(full)


@pytest.mark.parametrize("block", [1, 512])
def test_pieces_round_trip(edge, edge_rows, empty, block):
    got = packing.pack_documents(edge, WORD, size=256, with_ids=True, block_sequences=block).collect()
    rows = defaultdict(list)
    for r in got:
        rows[r.doc_row].append(r)
        raw = np.array(r.ids, "<u4").tobytes()
        assert zlib.crc32(raw) == r.ids_crc32 and len(r.ids) == r.length
    ids = []
    for parts in rows.values():
        parts.sort(key=lambda r: r.start)
        whole = [x for r in parts for x in r.ids]
        assert [r.start for r in parts] == np.cumsum([0, *(r.length for r in parts[:-1])]).tolist()
        assert all(r.doc_tokens == len(whole) for r in parts)
        ids.append((str(parts[0].doc_id), tuple(whole)))
    want = [(str(r[0]), (*TK.encode(r[1] or "", add_special_tokens=False).ids, 2)) for r in edge_rows]
    assert sorted(ids) == sorted(want)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist()
        end = sum(n for _, n in parts)
        assert end == 256 or end & (end - 1) == 0
    assert packing.pack_documents(empty, WORD).count() == 0
