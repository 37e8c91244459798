"""Cost-balanced packing of token sequences.

A training step's time on a sequence grows with its tokens and, through
attention, with the square of each document's tokens.  Documents are taken in
blocks of consecutive rows; within a block, pieces in descending order go to
the sequence that has cost least so far among those with room for them.  The
sequences of a block hold just its tokens: what fits nowhere whole is cut over
the remaining room.  A block ends at a full sequence (the cut document goes on
in the next one); the rest of a partition's last block goes to sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T
from tokenizers import Tokenizer

from .common import CACHES, slices, sole, texts

BLOCK_SEQUENCES = 512
CACHED_WORDS = 300_000
# Characters that Python splits at but the tokenizer keeps.
_KEPT_BLANKS = re.compile("[\x1c-\x1f]")
# For texts in Latin-1: lower case, its two further blanks as blanks; and full stops and commas as P, other symbols as S.
_LOWER = bytes(32 if i in (0x85, 0xA0) else ord(chr(i).lower()) for i in range(256))
_CLASS = bytes(ord("P") if chr(i) in ".," else 32 if chr(i).isspace() and not 0x1C <= i <= 0x1F else ord("w") if chr(i).isalnum() else ord("S") for i in range(256))


# The normaliser and pre-tokenizer, as the file has them, for which a text's ids are its words' ids.
KNOWN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


class WordEncoder(dict):
    """word -> its token ids as little-endian uint32 bytes; a bounded cache.

    For the tokenizer whose settings are below: it splits at blanks, and between letters and symbols,
    before anything else, and lowers the case, so that a text's ids are its words' ids in order.
    With any other settings each text is encoded whole by the library.
    When it is full its words step back to a second cache, from which those
    that come again return; what was in there goes.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        settings = json.loads(self.tokenizer.to_str())
        odd = any(t[k] for t in settings["added_tokens"] for k in ("normalized", "single_word", "lstrip", "rstrip"))
        self.by_words = (settings["normalizer"], settings["pre_tokenizer"]) == KNOWN and settings["model"]["type"] == "BPE" and not settings["model"]["dropout"] and not odd
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.older: dict[bytes | str, bytes] = {}

    def ids(self, s: str) -> bytes:
        return np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes | str) -> bytes:
        known = self.older.get(word)
        if known is None:
            known = self.ids(word.decode("latin-1") if isinstance(word, bytes) else word)
        if len(self) > CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        if len(word) < 64:
            self[word] = known
        return known

    def text(self, text: str) -> bytes:
        """The ids of a text."""
        if not self.by_words:
            return self.ids(text)
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            if _KEPT_BLANKS.search(text):
                return self.ids(text)
            return b"".join(map(self.__getitem__, text.split()))
        lower = raw.translate(_LOWER)
        if any(s in lower for s in self.specials):  # what is special goes by the letters as they are
            return self.ids(text)
        kinds = raw.translate(_CLASS)
        if not (b"PP" in kinds or b"PS" in kinds or b"SP" in kinds):  # else a run of symbols would be cut
            lower = lower.replace(b",", b" , ").replace(b".", b" . ")
        return b"".join(map(self.__getitem__, lower.split()))


_ENCODERS: dict[str, WordEncoder] = {}
CACHES["packing"] = _ENCODERS.clear


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def powers(n: int) -> list[int]:
    """The powers of two that sum to n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack(lengths: list[int], size: int, linear: float = 1.0, quadratic: float = 1.0) -> list[tuple[int, int, int, int, int]]:
    """Pack items of given lengths; returns (item, start, length, sequence, offset).

    The sequences hold `size` each, those of the rest powers of two; they
    are numbered from 0 and filled without gap.  cost(n) = linear * n +
    quadratic * n * n / size.  Equal lengths go in the order given.
    """
    total = sum(lengths)
    room = np.array([size] * (total // size) + powers(total % size), np.int64)
    cap, cost = room.copy(), np.zeros(len(room))
    out = []

    def put(item: int, start: int, n: int, at: int) -> None:
        out.append((item, start, n, at, int(cap[at] - room[at])))
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n / size

    rest = []
    free = 0  # sequences before this one are taken by whole parts of long items
    for k, n in enumerate(lengths):
        for start in range(0, n - n % size, size):
            put(k, start, size, free)
            free += 1
        if n % size:
            rest.append((n % size, k, n - n % size))
    left = []
    for n, k, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        costs = np.where(room >= n, cost, np.inf)
        at = int(costs.argmin()) if len(costs) else 0
        if len(costs) and costs[at] < np.inf:
            put(k, start, n, at)
        else:
            left.append((n, k, start))
    gaps = sorted(np.flatnonzero(room), key=lambda at: (cost[at], at))
    for n, k, start in left:
        while n:
            at = gaps[0]
            m = min(n, int(room[at]))
            put(k, start, m, at)
            n, start = n - m, start + m
            if not room[at]:
                gaps.pop(0)
    return out


def pack_documents(df: DataFrame, tokenizer_file: str, end_id: int = 2, size: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, block_sequences: int = BLOCK_SEQUENCES, linear: float = 1.0, quadratic: float = 1.0) -> DataFrame:
    """Tokenize whole texts with any file of the tokenizers library, end each with `end_id`, and pack them.

    Returns a row per piece: the id, start, length, ids_crc32 (of the piece's
    ids as little-endian unsigned 32-bit numbers), doc_tokens (with the end),
    sequence_id, offset, doc_row (a number of the input row, as ids can
    repeat) and, if asked for, the ids.  No shuffle: a block is consecutive rows of one
    partition, so memory is bounded by a block and the longest document.
    Null texts are empty (one piece: the end id); repeated rows and ids are
    packed as often as they occur; equal lengths go in input order; an empty
    table gives no pieces; columns besides the two, whatever their names, are ignored; a text of any length is cut, never dropped.  sequence_id
    and doc_row hold the partition in their upper 31 bits.
    """
    id_field = T.StructField(id_col, df.schema[id_col].dataType)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "doc_row"]
    schema = T.StructType([id_field, *(T.StructField(n, T.LongType()) for n in names)] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("packing")
        known, base = encoder(tokenizer_file), TaskContext.get().partitionId() << 33
        sequences = rows = held = 0
        block: list[tuple] = []  # (id, doc_row, first token here, ids from there on, doc_tokens)
        id_type = None

        def flush() -> pa.RecordBatch:
            nonlocal sequences
            pieces = pack([len(b[3]) >> 2 for b in block], size, linear, quadratic)
            cols: list[list] = [[] for _ in schema]
            for k, start, n, at, offset in pieces:
                i, row, first, ids, total = block[k]
                part = memoryview(ids)[4 * start : 4 * (start + n)]
                values = [i, first + start, n, zlib.crc32(part), total, base + sequences + at, offset, base + row]
                for c, v in zip(cols, [*values, np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else values):
                    c.append(v)
            sequences += max(p[3] for p in pieces) + 1
            kinds = [id_type] + [pa.int64()] * len(names) + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=schema.names)

        for part in slices(batches, text_col):
            id_type = part.column(id_col).type
            for i, text in zip(part.column(id_col).to_pylist(), texts(part, text_col)):
                ids = known.text(text) + end
                first, total = 0, len(ids) >> 2
                while held + total - first >= block_sequences * size:
                    n = block_sequences * size - held
                    block.append((i, rows, first, ids[4 * first : 4 * (first + n)], total))
                    yield flush()
                    block, held, first = [], 0, first + n
                if first < total:
                    block.append((i, rows, first, ids[4 * first :], total))
                    held += total - first
                rows += 1
        if block:
            yield flush()

    return df.select(id_col, text_col).mapInArrow(run, schema)
