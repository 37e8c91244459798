"""Exact token counts of every prefix of a text, by dynamic programming.

The tokenizer is a sentencepiece BPE model.  An encoding by ranked merges is
the one segmentation in which each neighbouring pair of pieces is what the
merges make of the pair's own characters; so the encoding of a prefix is that
of a shorter prefix plus one last piece.  `PrefixCounter` keeps, for each
prefix of a word, that last piece and the count, and never encodes a prefix
from its start again.  No piece of the vocabulary goes on beyond a blank, so the
counts of a text's prefixes are those of its words, shifted by running totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, types as T

from .common import CACHES, slices, sole, texts

BLANK = "▁"
CACHED_WORDS, CACHED_PAIRS, CACHED_LENGTH = 600_000, 1_000_000, 48
_NORMAL, _BYTE = 1, 6
# Strings that any of the usual normalisations would change.
PROBES = ["ﬁ", "①", "e\u0301", "é", "Ａ", "ABC", "\u00ad", "\u2028", "漢\U0001f600"]


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def _piece_types(proto: bytes) -> list[int]:
    """The type of each piece, from the model's protocol buffer (field 1, then field 3)."""
    out, at = [], 0
    while at < len(proto):
        key, at = _varint(proto, at)
        if key & 7 == 2:
            size, at = _varint(proto, at)
            if key >> 3 == 1:
                kind, inner, i = _NORMAL, proto[at : at + size], 0
                while i < size:
                    sub, i = _varint(inner, i)
                    if sub & 7 == 2:
                        n, i = _varint(inner, i)
                        i += n
                    elif sub & 7 == 5:
                        i += 4
                    else:
                        n, i = _varint(inner, i)
                        kind = n if sub >> 3 == 3 else kind
                out.append(kind)
            at += size
        elif key & 7 == 5:
            at += 4
        elif key & 7 == 1:
            at += 8
        else:
            _, at = _varint(proto, at)
    return out


class PrefixCounter(dict):
    """word -> little-endian uint32 counts, one for each prefix of blank + word.

    Words are what stands between blanks; further blanks before a word are
    part of its key.  It is a bounded cache: when full it starts afresh.
    """

    def __init__(self, model_file: str):
        super().__init__()
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        kinds = _piece_types(sp.serialized_model_proto())
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in range(sp.get_piece_size()) if kinds[i] == _NORMAL}
        if any(k == 4 for k in kinds) or any(BLANK in p.lstrip(BLANK) for p in self.rank):
            raise ValueError("the model has user-defined pieces or pieces that go on beyond a blank")
        if sp.encode_as_pieces("a  b ")[:1] != [BLANK + "a"] or "".join(sp.encode_as_pieces(" a  b ")) != f"{BLANK}{BLANK}a{BLANK}{BLANK}b{BLANK}":
            raise ValueError("the model normalises blanks")
        if sum(k == _BYTE for k in kinds) != 256 or any(sp.decode(sp.encode(x)) != x for x in PROBES):
            raise ValueError("the model has no byte pieces or normalises characters")
        self.tails = {p[i:] for p in self.rank for i in range(len(p))}
        self.newline = "\n" not in "".join(self.rank)
        self.pairs: dict = {}
        self.lines: dict = {}

    def merged(self, s: str) -> list[str]:
        """The pieces of a short string by ranked merges, leftmost first among equals."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        """Whether `right` follows `left` in an encoding; an empty `left` is the start."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def counts(self, s: str) -> bytes:
        """Counts of all prefixes of s (blanks as BLANK), from 1 character on."""
        rank, tails, fits = self.rank, self.tails, self.fits
        last, count = [""], [0]  # "" also stands for a character outside the vocabulary: nothing merges across it
        for j in range(1, len(s) + 1):
            i = j - 1
            while i >= 0 and (part := s[i:j]) in tails:
                if part in rank and fits(last[i], part):
                    last.append(part)
                    count.append(count[i] + 1)
                    break
                i -= 1
            else:
                last.append("")
                count.append(count[j - 1] + len(s[j - 1].encode("utf-8", "surrogatepass")))
        return np.array(count[1:], dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if self.newline and "\n" in word:  # "\n" is no part of a longer piece: each line's part stands alone
            head, *rest = word.split("\n")
            parts = [np.frombuffer(self[head], "<u4")]
            for line in rest:
                n = parts[-1][-1]
                parts.append(np.array([n + 1], "<u4"))
                if line:
                    if (known := self.lines.get(line)) is None:
                        if len(self.lines) > CACHED_WORDS // 4:
                            self.lines.clear()
                        known = self.lines[line] = self.counts(line)
                    parts.append(np.frombuffer(known, "<u4") + (n + 1))
            return np.concatenate(parts).astype("<u4").tobytes()
        known = self.counts(BLANK + word.replace(" ", BLANK))
        if len(word) <= CACHED_LENGTH:
            if len(self) > CACHED_WORDS:
                self.clear()
            self[word] = known
        return known

    def table(self, text: str) -> np.ndarray:
        """counts[k]: the exact number of tokens of the first k characters, k from 0 to len(text)."""
        if not text:
            return np.zeros(1, "<u4")
        words = text.replace(BLANK, " ").split(" ")
        if "" in words:
            held, joined = "", []
            for w in words[:-1]:
                if w:
                    joined.append(held + w)
                    held = ""
                else:
                    held += " "
            words = [*joined, held + words[-1]]
        parts = list(map(self.__getitem__, words))
        flat = np.frombuffer(b"".join(parts), "<u4").copy()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        ends = np.cumsum(sizes) - 1
        before = np.cumsum(flat[ends], dtype=np.uint32)
        flat[sizes[0] :] += np.repeat(before[:-1], sizes[1:])
        flat[0] = 0
        return flat


_COUNTERS: dict[str, PrefixCounter] = {}
CACHES["token_counts"] = _COUNTERS.clear


def counter(model_file: str) -> PrefixCounter:
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PrefixCounter(model_file)
    return _COUNTERS[model_file]


def longest_prefix(table: np.ndarray, budget: int) -> int:
    """The most characters that a text may keep so that they are `budget` tokens or fewer."""
    return int(np.flatnonzero(table <= budget)[-1])


def token_counts(df: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", keep_table: bool = False) -> DataFrame:
    """Exact token counts of whole texts and of all their prefixes.

    Returns a row per input row: the id, n_bytes (UTF-8), n_tokens, over_limit
    (n_tokens > limit) and limit_chars, the longest prefix in code points that
    is `limit` tokens or fewer.  With `keep_table` also prefix_counts, the
    count at every prefix from 0 characters on.  Null texts count as empty
    (0 tokens); repeated rows and repeated or null ids are each counted;
    columns besides the two are ignored, so their names can't clash; an empty
    table gives an empty result.  A text of any length is one table of four
    bytes a character.
    """
    schema = T.StructType(
        [T.StructField(id_col, df.schema[id_col].dataType)]
        + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("limit_chars", T.LongType())]
        + [T.StructField("prefix_counts", T.ArrayType(T.IntegerType()))] * keep_table
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("token_counts")
        known = counter(model_file)
        for part in slices(batches, text_col):
            n_tokens, chars, tables = [], [], []
            for text in texts(part, text_col):
                table = known.table(text)
                n_tokens.append(int(table[-1]))
                chars.append(len(text) if table[-1] <= limit else longest_prefix(table, limit))
                if keep_table:
                    tables.append(table.astype(np.int32))
            n_bytes = pc.cast(pc.fill_null(pc.binary_length(part.column(text_col)), 0), pa.int64())
            out = [part.column(id_col), n_bytes, pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(chars, pa.int64())]
            if keep_table:
                out.append(pa.array(tables, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])

    return df.select(id_col, text_col).mapInArrow(run, schema)
