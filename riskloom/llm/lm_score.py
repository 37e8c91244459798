"""Language-model scoring with a weighted backoff automaton.

The model is learned from n-gram counts of all training documents, with
Dirichlet smoothing: p(w | g) = (c(g w) + k p(w | g')) / (c(g) + k), where g'
is g without its first word and k depends on the length of g.  As an automaton each context that occurs is a
state, each n-gram that occurs an arc with its log-probability, and each state
has a failure arc to g' with weight log(k / (c(g) + k)).  A text is scored by
one traversal from left to right.

The model grows with the corpus, so no task holds it whole.  Consecutive rows of a partition make
a block of bounded size, which is kept compressed in the checkpoint folder.  A block counts its words and word pairs and
sends their hashes, sorted and packed, to buckets by hash range; a bucket adds
up and answers each block in the order asked: the corpus's count of what other blocks have as well,
nothing for what only this block has, whose own count is the corpus's.  Longer n-grams follow in a second round, but only those of
pairs that other blocks have: no other block can have the rest.  Where there are more than MOST_RANGES
buckets, blocks send to that many wider hash ranges instead; there teams of blocks add up what they sent, and teams
ask the buckets and hand the answers back, so that blocks' packed rows grow as blocks, and teams' rows as blocks
times buckets over 2 * MOST_RANGES.  With
these counts a block builds the part of the automaton that its texts can reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpointed, crc32_mod, discard, materialise, release, slices, sole

# Of orders 2, 3 and 4, and of priors for contexts of 1, 2 and 3 words, the best for documents with remainder 1 under a model of those with 2 to 9.
ORDER, PRIORS = 4, (8000.0, 500.0, 0.5)
# For any other order: the best at order 2.
PRIOR = 500.0
FOLDS, HELD_OUT = 10, 0
ADD = 0.1
BLOCK_BYTES = 8 << 20
# A block sends at most so many rows of n-grams of one length.
MOST_RANGES = 4096
# Of shuffles that have a partition for each so many bytes; a partition's groups are worked on one at a time, however many they are.
MOST_TASKS = 1 << 15
START, END = 0, 1
WORD_BITS = 64
# Hashes of n-grams have so many bits more than a number of all the corpus's tokens: one in 2 ** MARGIN_BITS shares its hash by chance, at any size.
MARGIN_BITS = 20


class _Numbers(dict):
    """word -> number from 2 on, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 2
        return n


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two, order kept."""
    h = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def ranked(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 64-bit hashes that are equal if their top `bits` bits are: a number for each, from 0 in hash
    order; those bits of each number; and one place of each number.

    Places are sorted along in the low bits of the hashes, which is much faster than sorting places by hashes.
    """
    n, cut = len(h), np.uint64(64 - bits)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = max(1, (n - 1).bit_length())
    mask = np.uint64((1 << low) - 1)
    packed = (h & ~mask) | np.arange(n, dtype=np.uint64)
    packed.sort()
    at = (packed & mask).astype(np.int64)
    key = h[at] >> cut
    if bits > 64 - low and (key[1:] < key[:-1]).any():  # hashes that differ only where the places stood
        at = np.argsort(h >> cut, kind="stable")
        key = h[at] >> cut
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    number = np.empty(n, np.int32)
    number[at] = np.cumsum(new, dtype=np.int32) - 1
    return number, key[new], at[new]


class Block:
    """The n-grams of a block's texts.

    gram[k][t] numbers the (k+1)-gram that ends at token t (-1: none), words in order of appearance, longer ones in hash
    order; keys[k] are their hashes, place[k] a token where each ends; by_hash lists the words in hash order.
    """

    def __init__(self, texts: list[str | None], order: int, bits: int):
        numbers = _Numbers()
        parts = []
        for x in texts:  # a text's words are numbered at once and let go
            words = ("" if x is None else x).encode("utf-8", "surrogatepass").lower().split()
            part = np.empty(len(words) + 1, np.int32)
            part[:-1] = list(map(numbers.__getitem__, words))
            part[-1] = END
            parts.append(part)
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.first = np.cumsum(self.sizes) - self.sizes
        w = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        del parts
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.v = len(numbers) + 2
        word_hash = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in numbers), np.uint64, len(numbers))
        word_hash = np.concatenate([np.array([1, 2], np.uint64), word_hash])
        self.by_hash = np.argsort(word_hash, kind="stable")
        self.at = (np.arange(len(w)) - np.repeat(self.first, self.sizes)).astype(np.int32)
        self.gram, self.keys, self.place = [w], [word_hash], [np.zeros(0, np.int64)]
        own = word_hash[w]
        h = own
        for k in range(1, order):
            before = np.roll(h, 1)
            before[self.at == 0] = word_hash[START]
            h = _mix(before, own)
            has = np.flatnonzero(self.at >= k - 1)
            number, keys, place = ranked(h[has], bits)
            g = np.full(len(w), -1, np.int32)
            g[has] = number
            self.gram.append(g)
            self.keys.append(keys)
            self.place.append(has[place])

    def counts(self, k: int, learn: np.ndarray) -> np.ndarray:
        """How often each (k+1)-gram ends in the documents to learn from."""
        g = self.gram[k][learn[self.doc]]
        return np.bincount(g[g >= 0], minlength=len(self.keys[k]))

    def maybe_shared(self, k: int, shared_pairs: np.ndarray) -> np.ndarray:
        """The (k+1)-grams all of whose word pairs are in other blocks too."""
        at, ok = self.place[k], np.ones(len(self.place[k]), bool)
        for step in range(k):
            ok &= shared_pairs[self.gram[1][at - step]]
        return np.flatnonzero(ok)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted different numbers (Elias-Fano): low bits as they are, the rest as gaps in unary, some 2 + log2(range / n) bits each."""
    n = len(keys)
    lo = int(keys[0])
    rel = keys - keys[0]
    low = max(0, (int(rel[-1]) // n).bit_length() - 1)
    high = (rel >> np.uint64(low)).astype(np.int64) + np.arange(n)
    marks = np.zeros(int(high[-1]) + 1, np.uint8)
    marks[high] = 1
    whole, rest = divmod(low, 8)
    raw = rel.astype("<u8").view(np.uint8).reshape(-1, 8)
    parts = [np.array([n, lo, len(marks)], "<u8").tobytes(), bytes([low]), np.packbits(marks).tobytes(), raw[:, :whole].tobytes()]
    if rest:
        parts.append(np.packbits((raw[:, whole, None] >> np.arange(rest, dtype=np.uint8)) & 1).tobytes())
    return b"".join(parts)


def unpack_keys(data: bytes) -> np.ndarray:
    n, lo, marks = (int(x) for x in np.frombuffer(data, "<u8", 3))
    low, at = data[24], 25
    whole, rest = divmod(low, 8)
    size = (marks + 7) // 8
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=marks)) - np.arange(n)
    at += size
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :whole] = np.frombuffer(data, np.uint8, n * whole, at).reshape(n, whole)
    if rest:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=at + n * whole), count=n * rest).reshape(n, rest)
        raw[:, whole] = bits @ (1 << np.arange(rest, dtype=np.uint8))
    return raw.view("<u8").ravel() + (high.astype(np.uint64) << np.uint64(low)) + np.uint64(lo)


def pack_numbers(x: np.ndarray) -> bytes:
    """Whole numbers in 1, 2, 4 or 8 bytes each, compressed; the first bytes say how many."""
    top = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    raw = x.astype(f"<u{width}").tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_numbers(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[1:9], "little")
    return np.frombuffer(pa.decompress(data[9:], size, codec="zstd", asbytes=True) if size else b"", f"<u{data[0]}").astype(np.int64)


BLOCKS = "block long, size long, docs long, rows binary"
SENT = "block long, bucket int, ord int, hashes binary, counts binary"
ANSWER = "block long, bucket int, ord int, counts binary, distinct long, total long"
_LONG, _INT, _BINARY = pa.int64(), pa.int32(), pa.binary()


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": _LONG, "int": _INT, "binary": _BINARY}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def _blocks(block_bytes: int):
    """Rows in blocks of about `block_bytes` of text, or one text each, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole()
        number, held, size = TaskContext.get().partitionId() << 33, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for part in held:
                    writer.write_batch(part)
            docs = sum(pc.sum(part.column("learn")).as_py() or 0 for part in held)
            yield from _table(BLOCKS, [(number, size, docs, sink.getvalue().to_pybytes())]).to_batches()

        for part in slices(batches, "text", block_bytes, 1 << 16):
            more = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and size + more > block_bytes:
                yield from out()
                number, held, size = number + 1, [], 0
            held.append(part)
            size += more
        if held:
            yield from out()

    return run


def _rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _bucket(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Ranges of equal width, so that order by key is order by bucket and key."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _messages(block: int, k: int, keys: np.ndarray, n: np.ndarray, bits: int, buckets: int) -> list[tuple]:
    """Sorted hashes and their counts, a row for each bucket; counts are doubled, and odd for what several blocks have."""
    bucket = _bucket(keys, bits, buckets)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    return [(block, int(bucket[a]), k, pack_keys(keys[a:b]), pack_numbers(n[a:b])) for a, b in zip(edges, [*edges[1:], len(keys)])]


def _first_round(order: int, bits: int, buckets: int):
    """Each block's words and word pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole()
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("rows")):
                rows = _rows(data.as_buffer())
                b = Block(rows.column("text").to_pylist(), min(order, 2), bits)
                learn = rows.column("learn").to_numpy()
                out = _messages(block, 0, b.keys[0][b.by_hash], 2 * b.counts(0, learn)[b.by_hash], WORD_BITS, buckets)
                if order > 1:
                    out += _messages(block, 1, b.keys[1], 2 * b.counts(1, learn), bits, buckets)
                yield from _table(SENT, out).to_batches()

    return run


def _answered(answers: pa.Table, k: int) -> np.ndarray:
    """The answers to a block's or a team's (k+1)-grams, in hash order."""
    mine = answers.filter(pc.equal(answers.column("ord"), k)).sort_by("part" if "part" in answers.column_names else "bucket")
    return np.concatenate([unpack_numbers(x) for x in mine.column("counts").to_pylist()] or [np.zeros(0, np.int64)])


def _known(b: Block, k: int, local: np.ndarray, answers: pa.Table, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corpus's counts of a block's (k+1)-grams, and which are in other blocks too."""
    got = _answered(answers, k)
    if len(got) != len(asked):
        raise RuntimeError(f"{len(got)} answers to {len(asked)} n-grams")
    count, shared = local.copy(), np.zeros(len(local), bool)
    shared[asked] = got > 0
    count[asked] = np.where(got > 0, got - 1, local[asked])
    return count, shared


def _second_round(order: int, bits: int, buckets: int):
    """The longer n-grams that other blocks may have."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        sole()
        out = []
        for i in range(blocks.num_rows):
            rows = _rows(blocks.column("rows")[i].as_buffer())
            b = Block(rows.column("text").to_pylist(), order, bits)
            learn = rows.column("learn").to_numpy()
            _, shared = _known(b, 1, b.counts(1, learn), answers, np.arange(len(b.keys[1])))
            for k in range(2, order):
                some = b.maybe_shared(k, shared)
                if len(some):
                    out += _messages(blocks.column("block")[i].as_py(), k, b.keys[k][some], 2 * b.counts(k, learn)[some], bits, buckets)
        return _table(SENT, out)

    return run


def _of_length(sent: pa.Table, k: int, bits: int) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """The rows of (k+1)-grams, where the hashes of each end, a number for each hash, from 0 in hash order, and the different hashes."""
    at = np.flatnonzero(sent.column("ord").to_numpy() == k).tolist()
    keys = [unpack_keys(sent.column("hashes")[i].as_py()) for i in at]
    ends = np.cumsum([len(x) for x in keys]).tolist()
    width = WORD_BITS if k == 0 else bits
    number, different, _ = ranked(np.concatenate(keys) << np.uint64(64 - width), width)
    return at, ends, number, different


def _sums(sent: pa.Table, at: list[int], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each different hash its count, and whether several blocks have it."""
    n = np.concatenate([unpack_numbers(sent.column("counts")[i].as_py()) for i in at])
    sums, many = np.bincount(number, weights=n >> 1).astype(np.int64), np.bincount(number, weights=1 + (n & 1)) > 1
    return sums, many


def _answer(bits: int):
    """Add up a bucket: for each hash of a block 1 + its count in the corpus, or 0 if no other block has it.

    `distinct` and `total` (of words seen in training) stand in its first row alone.
    """

    def run(sent: pa.Table) -> pa.Table:
        bucket, block, out = sent.column("bucket")[0].as_py(), sent.column("block").to_pylist(), []
        for k in np.unique(sent.column("ord").to_numpy()).tolist():
            at, ends, number, _ = _of_length(sent, k, bits)
            sums, many = _sums(sent, at, number)
            known, total = (int((sums > 0).sum()), int(sums.sum())) if k == 0 else (0, 0)
            reply = np.where(many, sums + 1, 0)[number]
            for j, (i, part) in enumerate(zip(at, np.split(reply, ends[:-1]))):
                out.append((block[i], bucket, k, pack_numbers(part), known if j == 0 else 0, total if j == 0 else 0))
        return _table(ANSWER, out)

    return run


def _merge(bits: int, buckets: int):
    """Add up what a team's blocks sent to a range, in rows as if the team were a block."""

    def run(sent: pa.Table) -> pa.Table:
        sole()
        team, out = sent.column("team")[0].as_py(), []
        for k in np.unique(sent.column("ord").to_numpy()).tolist():
            at, _, number, different = _of_length(sent, k, bits)
            sums, many = _sums(sent, at, number)
            out += _messages(team, k, different, 2 * sums + many, WORD_BITS if k == 0 else bits, buckets)
        return _table(SENT, out)

    return run


def _hand_back(bits: int):
    """The answers to a team's rows of a range, for each of its blocks in the order asked."""

    def run(sent: pa.Table, answers: pa.Table) -> pa.Table:
        sole()
        if not sent.num_rows:
            raise RuntimeError("answers to what nobody asked")
        bucket, block, out = sent.column("bucket")[0].as_py(), sent.column("block").to_pylist(), []
        words = [pc.sum(answers.column(c)).as_py() or 0 for c in ("distinct", "total")]
        for k in np.unique(sent.column("ord").to_numpy()).tolist():
            at, ends, number, different = _of_length(sent, k, bits)
            got = _answered(answers, k)
            if len(got) != len(different):
                raise RuntimeError(f"{len(got)} answers to {len(different)} n-grams")
            for i, part in zip(at, np.split(got[number], ends[:-1])):
                out.append((block[i], bucket, k, pack_numbers(part), *words))
                words = [0, 0]
        return _table(ANSWER, out)

    return run


def _add_up(sent: DataFrame, bits: int, buckets: int, ranges: int, teams: int, tasks: int, name: str) -> DataFrame:
    """The written answers to what blocks sent to `ranges` ranges; with as many buckets as ranges, ranges are the buckets."""
    in_buckets = lambda df: df.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_answer(bits), ANSWER)
    if ranges == buckets:
        return materialise(in_buckets(sent), name)
    sent = materialise(sent.withColumn("team", F.pmod(F.xxhash64("block"), F.lit(teams))), f"{name}-sent")
    mine = lambda df: df.repartition(tasks, "team", "bucket").groupBy("team", "bucket")
    answers = materialise(in_buckets(mine(sent).applyInArrow(_merge(bits, buckets), SENT)), f"{name}-teams")
    of_team = answers.select(F.col("block").alias("team"), F.floor(F.col("bucket") / (buckets // ranges)).cast("int").alias("bucket"), F.col("bucket").alias("part"), "ord", "counts", "distinct", "total")
    back = mine(sent).cogroup(mine(of_team)).applyInArrow(_hand_back(bits), ANSWER)
    out = materialise(back, name)
    for used in (sent, answers):
        discard(used)
    return out


def _priors(prior: float | Sequence[float], order: int) -> list[float]:
    """The prior of contexts of 1, 2, ... words."""
    priors = [float(prior)] * (order - 1) if isinstance(prior, (int, float)) else [float(x) for x in prior]
    if len(priors) != order - 1:
        raise ValueError(f"order {order} needs {order - 1} priors, not {len(priors)}")
    return priors


class Automaton:
    """States, arcs and failure arcs over a block's n-grams; state 0 is the empty context.

    The arcs of order k are the (k+1)-grams: arc g has the log-probability logp[k][g] (NaN: no arc) and leads to
    state target[k][g].  Words that don't occur in training have arcs from state 0 too,
    with the probability of a word not seen.  depth is the length of a state's context.
    """

    def __init__(self, b: Block, counts: list[np.ndarray], total: int, distinct: int, docs: int, prior: float | Sequence[float]):
        order, self.b = len(counts), b
        priors = _priors(prior, order)
        before = lambda k: b.gram[k - 1][b.place[k] - 1]
        # of each (k+1)-gram: itself without its last word, and without its first one, as k-grams
        head = [np.zeros(b.v, np.int32), *(np.where(b.at[b.place[k]] == 0, START, before(k)) if k == 1 else before(k) for k in range(1, order))]
        tail = [np.zeros(b.v, np.int32), *(b.gram[k - 1][b.place[k]] for k in range(1, order))]
        seen = []  # how often each is a context
        for k in range(order - 1):
            ends = b.gram[0][b.place[k]] == END if k else np.arange(b.v) == END
            seen.append(np.where(ends, 0, counts[k]))
            if k == 0:
                seen[0][START] = docs
        self.state, self.depth = [], [np.zeros(1, np.int8)]
        size = 1
        for k, c in enumerate(seen):
            self.state.append(np.where(c > 0, size - 1 + np.cumsum(c > 0), 0).astype(np.int32))
            size += int((c > 0).sum())
            self.depth.append(np.full(int((c > 0).sum()), k + 1, np.int8))
        self.depth = np.concatenate(self.depth)
        self.fail, self.fail_weight = np.zeros(size, np.int32), np.zeros(size)
        for k, c in enumerate(seen):
            has = c > 0
            self.fail_weight[self.state[k][has]] = np.log10(priors[k] / (c[has] + priors[k]))
            if k:
                self.fail[self.state[k][has]] = self.state[k - 1][tail[k][has]]
        p = [(counts[0] + ADD) / (total + ADD * (distinct + 1))]
        self.logp, self.target, self.source = [np.log10(p[0])], [self.state[0] if order > 1 else np.zeros(b.v, np.int32)], [np.zeros(b.v, np.int32)]
        for k in range(1, order):
            h, shorter = seen[k - 1][head[k]], p[k - 1][tail[k]]
            p.append(np.where(h > 0, (counts[k] + priors[k - 1] * shorter) / (h + priors[k - 1]), shorter))
            self.logp.append(np.where(counts[k] > 0, np.log10(p[k]), np.nan))
            own = self.state[k] if k < order - 1 else np.zeros(len(h), np.int32)
            self.target.append(np.where(own > 0, own, self.target[k - 1][tail[k]]))  # the longest end of it that is a state
            self.source.append(self.state[k - 1][head[k]])
        self.start = int(self.state[0][START]) if order > 1 else 0

    def resolved(self) -> tuple[np.ndarray, np.ndarray]:
        """For a state of each depth and each token: the log-probability by its arc, or its failure arcs' weights and then an arc's, and the depth reached."""
        b, order = self.b, len(self.logp)
        gain, depth = np.zeros((order, len(b.doc))), np.zeros((order, len(b.doc)), np.int8)
        for k in range(order):
            g = b.gram[k]
            at = np.flatnonzero(g >= 0)
            arc = g[at]
            gain[k, at], depth[k, at] = self.logp[k][arc], self.depth[self.target[k][arc]]
            if k:
                none = at[np.isnan(gain[k, at])]
                gain[k, none] = self.fail_weight[self.source[k][g[none]]] + gain[k - 1, none]
                depth[k, none] = depth[k - 1, none]
        return gain, depth

    def score(self) -> np.ndarray:
        """log10 probability of each text: all texts go one token to the right at a time, each with its state.

        A state is told by its depth and the tokens before, so the depth is what is carried.
        """
        b = self.b
        gain, depth = self.resolved()
        self.logp = self.target = self.source = self.state = []  # all that is needed of them is in there
        width = len(b.doc)
        gain, depth = gain.ravel(), depth.ravel()
        by = np.argsort(-b.sizes, kind="stable")
        first, sizes = b.first[by], b.sizes[by]
        total, state = np.zeros(len(by)), np.full(len(by), self.depth[self.start], np.int64)
        alive = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(by) else 0), side="left").tolist()
        for t, active in enumerate(alive):
            arc = state[:active] * width + (first[:active] + t)
            total[:active] += gain[arc]
            state[:active] = depth[arc]
        out = np.empty(len(by))
        out[by] = total
        return out


SCORES = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def _score(order: int, bits: int, total: int, distinct: int, docs: int, prior: float | Sequence[float], id_type: pa.DataType):
    kinds = [id_type, pa.bool_(), _LONG, _LONG, _LONG, pa.float64(), pa.float64()]

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        sole()
        parts = []
        for i in range(blocks.num_rows):
            rows = _rows(blocks.column("rows")[i].as_buffer())
            b = Block(rows.column("text").to_pylist(), order, bits)
            learn, n = rows.column("learn").to_numpy(), rows.num_rows
            counts, shared = [], None
            for k in range(order):
                asked = b.by_hash if k == 0 else np.arange(len(b.keys[1])) if k == 1 else b.maybe_shared(k, shared)
                count, found = _known(b, k, b.counts(k, learn), answers, asked)
                shared = found if k == 1 else shared
                counts.append(count)
            b.keys = []
            c = counts[0][b.gram[0]]
            base = np.bincount(b.doc, weights=np.log10((c + ADD) / (total + ADD * (distinct + 1))), minlength=n)
            known = np.bincount(b.doc, weights=c > 0, minlength=n).astype(np.int64)
            score = Automaton(b, counts, total, distinct, docs, prior).score()
            del counts, count, found, asked
            b.gram = []
            values = [rows.column("id").cast(id_type), rows.column("held_out"), pa.array(b.sizes, _LONG), pa.array(known, _LONG), pa.array([total] * n, _LONG), pa.array(base), pa.array(score)]
            parts.append(pa.table(values, names=["id", *SCORES]))
            del b, rows
            release()
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], t) for t in kinds], names=["id", *SCORES])

    return run


def lm_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, prior: float | Sequence[float] | None = None, block_bytes: int = BLOCK_BYTES, most_ranges: int = MOST_RANGES) -> DataFrame:
    """Score whole texts with a model of the documents whose crc32(id as text) mod 10 is not 0.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; an end follows each text and counts as a token.
    Returns the id, held_out, n_tokens, n_known, train_tokens, base_score
    (add-0.1 words) and score (the automaton's), both log10.  Null texts are
    empty: the end alone.  Rows with a null id are scored, but neither learned
    from nor held out.  Repeated rows count and score as often as they occur.
    Further columns are ignored; an empty table gives an empty result; with
    nothing to learn from, each token has probability 1 / 1.
    `prior` is one number, or one for contexts of each length from 1 to `order` - 1;
    by default PRIORS at the order they were chosen for, else PRIOR.
    Words count as equal if their 64-bit hashes are, longer n-grams if hashes of MARGIN_BITS bits more than
    a number of all tokens takes are.  Memory is that of a block and of a bucket, of
    `block_bytes` and twice as many bytes of text, or of the longest text.  A block sends at most `most_ranges` rows
    of n-grams of one length, whatever the corpus's size.
    """
    if prior is None:
        prior = PRIORS if order == ORDER else PRIOR
    _priors(prior, order)
    spark, part = df.sparkSession, crc32_mod("id", FOLDS)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("learn", F.coalesce(part != HELD_OUT, F.lit(False))).withColumn("held_out", F.coalesce(part == HELD_OUT, F.lit(False)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # dealt out once and kept that way, some blocks a task: no later step moves the texts again
    tasks = max(parts, min(math.ceil(size / (4 * block_bytes)), MOST_TASKS))
    blocks = checkpointed(rows.mapInArrow(_blocks(block_bytes), BLOCKS).repartition(tasks, "block"))
    sums = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.count("*").alias("n")).first()
    buckets = max(math.ceil(sums["size"] / (2 * block_bytes)), min(parts, math.ceil(sums["size"] / (1 << 20))), 1)
    ranges = min(buckets, most_ranges)
    buckets = ranges * math.ceil(buckets / ranges)  # so many in each range
    teams = max(1, math.ceil(sums["n"] / (2 * ranges)))
    bits = min(64, MARGIN_BITS + max(20, (sums["size"] // 4).bit_length()))
    add_up = lambda sent, name: _add_up(sent, bits, buckets, ranges, teams, tasks, name)
    answers = add_up(blocks.select("block", "rows").mapInArrow(_first_round(order, bits, ranges), SENT), "words")
    seen = answers.agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    of_block = lambda a: a.select("block", "bucket", "ord", "counts").groupBy("block")
    if order > 2:
        pairs = answers.where("ord = 1")
        sent = blocks.select("block", "rows").groupBy("block").cogroup(of_block(pairs)).applyInArrow(_second_round(order, bits, ranges), SENT)
        answers = answers.unionByName(add_up(sent, "ngrams"))
    id_field = df.schema[id_col]
    kinds = [T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField("id", id_field.dataType), *(T.StructField(n, t) for n, t in zip(SCORES, kinds))])
    run = _score(order, bits, int(seen["total"]), int(seen["distinct"]), int(sums["docs"]), prior, to_arrow_type(id_field.dataType))
    out = blocks.select("block", "rows").groupBy("block").cogroup(of_block(answers)).applyInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
