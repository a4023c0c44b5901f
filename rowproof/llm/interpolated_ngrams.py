"""Language-model scoring by deleted interpolation.

A word's probability after a context mixes the maximum-likelihood estimates of
the n-gram orders: at each order the estimate counts with a weight that depends
on how frequent the context is (a bucket: the power of two that its count
reaches), and the rest goes to the next shorter context, down to the same
probability for every known word and one unknown.  The weights are learned by
expectation-maximisation on counts held out: a tenth of the training texts
(chosen by their content, so that exact copies are held out together) is
deleted from the counts that the weights are learned against.  Texts are scored
with the counts of all training texts.

How it runs:

1. Texts are gathered in blocks of ``BLOCK`` bytes (``LEAST`` a token at least)
   and written in a short form: the block's words as 64-bit hashes, and the
   texts as numbers of those words.  Held-out texts go to blocks of their own.
2. Every block asks for its distinct n-grams: their keys, sorted, are cut into
   pieces by ranges of keys, with the counts in the block's training texts.  A
   frequent n-gram is one key in each block, whatever its count, so ranges stay
   even.
3. Each range of keys adds the counts up and answers every block in the order
   of its keys, so answers hold no keys.
4. Blocks meet their answers.  The held-out ones give events (the counts of an
   n-gram and its contexts, added up), from which the weights are learned, a
   small aggregation a round; then all are scored.

All n-grams of all training texts count; nothing is pruned.  Words and n-grams
are told apart by 64-bit keys: among 10^9 n-grams any two share one with a
probability of three in a hundred.  A range of keys, a block and its answers are
what a task holds; one text is never cut, so a text longer than a block is a
block of its own.  Of a block's tokens a task holds numbers of four bytes, and
the keys of one order; whatever else is computed for every token is computed
for ``SLICE`` of them at a time.

Defined results: null and empty texts, and texts of blanks, are one end.  A
null in ``training`` counts as false.  Without training texts every token is
equally likely (0).  Buckets without held-out events take the weight of the
next smaller bucket that has some, or one half.  Repeated rows are scored alike
and count as often as they occur; null ids are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, written

#: Longest n-grams of the model.
ORDER = 2
#: Bytes of text in a block; n-grams in a range of keys.
BLOCK, RANGE = 16 << 20, 1 << 20
#: Bytes that a token counts in a block at least; tokens of a block that are worked on at a time.
LEAST, SLICE = 4, 1 << 18
#: One training text in so many is held out to learn the weights.
DELETED = 10
#: Buckets of an order: contexts seen never, once, 2-3, 4-7 and so on.
BUCKETS = 48
#: Rounds of expectation-maximisation, and the change of a weight at which they end.
ROUNDS, SETTLED = 40, 1e-4
#: Largest weight, so that what is unseen keeps a probability.
MOST = 1 - 1e-6

END, START = np.uint64(xxhash.xxh64_intdigest(b"end", 1)), np.uint64(xxhash.xxh64_intdigest(b"start", 1))


def crushed(a: np.ndarray, width: int = 8) -> bytes:
    """Numbers of ``width`` bytes as compressed planes of bytes."""
    planes = np.ascontiguousarray(np.asarray(a, f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.ravel())


def restored(data: bytes, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def joined_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of n-grams from the keys of their beginnings and their last words."""
    x = (before ^ (before >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Numbers a block's words as they come; the end is number 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class Block:
    """The texts of a block: ids, whether each is a training text, their lengths
    in tokens, the keys of the block's words, and all tokens as numbers of these."""

    def __init__(self) -> None:
        self.words, self.ids, self.training, self.lengths, self.tokens, self.bytes = Words(), [], [], [], [], 0

    def add(self, row_id: int | None, text: bytes, training: bool) -> None:
        words = text.lower().split()  # bytes: A-Z and ASCII blanks only
        tokens = np.zeros(len(words) + 1, np.uint32)
        tokens[:-1] = np.fromiter(map(self.words.__getitem__, words), np.uint32, len(words))
        self.ids.append(row_id)
        self.training.append(training)
        self.lengths.append(len(tokens))
        self.tokens.append(tokens)
        self.bytes += max(len(text), LEAST * len(tokens)) + 64

    def row(self, block: int, held: bool) -> dict:
        keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.words), np.uint64, len(self.words))
        tokens = np.concatenate(self.tokens)
        count = np.bincount(tokens, minlength=len(keys) + 1)[1:]
        order = np.argsort(-count, kind="stable")  # frequent words get small numbers, which are short when compressed
        number = np.zeros(len(keys) + 1, np.uint32)
        number[order + 1] = np.arange(1, len(keys) + 1)
        return {
            "block": block, "held": held, "ids": self.ids, "training": self.training, "lengths": self.lengths,
            "words": crushed(np.r_[END, keys[order]]), "tokens": crushed(number[tokens], 4), "n": len(tokens),
        }


BLOCKS = pa.schema([("block", pa.int64()), ("held", pa.bool_()), ("ids", pa.list_(pa.int64())), ("training", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("tokens", pa.binary()), ("n", pa.int64())])
BLOCKS_DDL = "block long, held boolean, ids array<long>, training array<boolean>, lengths array<long>, words binary, tokens binary, n long"


def blocks(df: DataFrame, training: Column, id_col: str, text_col: str) -> DataFrame:
    """Texts in blocks, in short form (written)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_blocks = {False: Block(), True: Block()}

        def closed(held: bool) -> pa.RecordBatch:
            nonlocal number
            row, open_blocks[held], number = open_blocks[held].row(number, held), Block(), number + 1
            return pa.RecordBatch.from_pylist([row], BLOCKS)

        for b in batches:
            for row_id, text, trains in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = text or b""
                held = trains and xxhash.xxh64_intdigest(text, 2) % DELETED == 0
                open_blocks[held].add(row_id, text, trains)
                if open_blocks[held].bytes >= BLOCK:
                    yield closed(held)
        for held in (False, True):
            if open_blocks[held].ids:
                yield closed(held)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    return written(rows.mapInArrow(run, BLOCKS_DDL), "blocks")


def slices(n: int) -> Iterator[tuple[int, int]]:
    return ((a, min(a + SLICE, n)) for a in range(0, n, SLICE))


def numbered(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and every token's place among them; a sixteenth of the keys at a time."""
    top = np.asarray(gram, "<u8").view(np.uint8)[7::8] >> 4
    keys, at, n = [], np.empty(len(gram), np.uint32), 0
    for i in range(16):
        where = np.flatnonzero(top == i)
        part, place = np.unique(gram[where], return_inverse=True)
        at[where] = place + n
        keys.append(part)
        n += len(part)
    return np.concatenate(keys), at


@dataclass
class Grams:
    """The n-grams of a block: per order the sorted distinct keys, and for every token the place of its n-gram among them."""

    keys: list[np.ndarray]
    at: list[np.ndarray]
    first: np.ndarray  # place of each text's first token
    lengths: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, order: int) -> Grams:
        by_key = np.argsort(words)
        place = np.empty(len(words), np.uint32)
        place[by_key] = np.arange(len(words))
        first = np.cumsum(lengths) - lengths
        keys, at = [words[by_key]], [place[tokens]]
        gram = words[tokens] if order > 1 else None
        for _ in range(1, order):
            # an n-gram is the one before, a word shorter, and this word; from the end, so that the shorter ones are still there
            for a, b in reversed(list(slices(len(tokens)))):
                shorter = gram[a - 1 : b - 1].copy() if a else np.r_[START, gram[: b - 1]]
                shorter[first[slice(*np.searchsorted(first, (a, b)))] - a] = START
                gram[a:b] = joined_keys(shorter, words[tokens[a:b]])
            distinct, inverse = numbered(gram)
            keys.append(distinct)
            at.append(inverse)
        return cls(keys, at, first, lengths)


def grams_of(table: pa.Table, row: int, order: int) -> tuple[Grams, np.ndarray]:
    """A block's n-grams, and for each text whether it trains."""
    get = lambda c: table.column(c)[row].as_py()
    lengths = np.array(get("lengths"), np.int64)
    return Grams.of(restored(get("words")), restored(get("tokens"), 4), lengths, order), np.array(get("training"), bool)


PIECES_DDL = "shard int, block long, n int, held boolean, keys binary, counts binary"
ANSWERS = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("shard", pa.int32()), ("kept", pa.binary()), ("total", pa.binary()), ("tokens", pa.list_(pa.int64())), ("types", pa.list_(pa.int64()))])
ANSWERS_DDL = "block long, n int, shard int, kept binary, total binary, tokens array<long>, types array<long>"


def answers(short: DataFrame, order: int) -> DataFrame:
    """For every block, order and range of keys: the counts without the held-out texts and of
    all training texts, in the order of the block's keys.  Rows of block -1 have
    the tokens and types of a range of words."""
    n = short.agg(F.sum("n")).first()[0] or 0
    shards = max(8, -(-n * order // (2 * RANGE)))  # about half of the n-grams of a block are distinct
    bounds = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                grams, training = grams_of(b, row, order)
                block, held = b.column("block")[row].as_py(), b.column("held")[row].as_py()
                trains = np.repeat(training, grams.lengths)
                for k, (keys, at) in enumerate(zip(grams.keys, grams.at, strict=True), 1):
                    counts = np.bincount(at[trains], minlength=len(keys))
                    cut = np.r_[0, np.searchsorted(keys, bounds), len(keys)]
                    some = np.flatnonzero(np.diff(cut))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([k] * len(some), pa.int32()), pa.array([held] * len(some)),
                         pa.array([crushed(np.diff(keys[cut[i] : cut[i + 1]], prepend=np.uint64(0))) for i in some], pa.binary()), pa.array([crushed(counts[cut[i] : cut[i + 1]]) for i in some], pa.binary())],
                        ["shard", "block", "n", "held", "keys", "counts"],
                    )

    def answer(group: pa.Table) -> pa.Table:
        out, words = [], {"tokens": [0, 0], "types": [0, 0]}
        shard, of = group.column("shard")[0].as_py(), np.array(group.column("n").to_pylist())
        for k in np.unique(of).tolist():
            rows = group.take(np.flatnonzero(of == k))
            keys = [np.cumsum(restored(x), dtype=np.uint64) for x in rows.column("keys").to_pylist()]
            counts = [restored(x).astype(np.int64) for x in rows.column("counts").to_pylist()]
            held, size = np.array(rows.column("held").to_pylist(), bool), [len(x) for x in keys]
            every = np.concatenate(keys)
            by_key = np.argsort(every, kind="stable")
            new = np.r_[True, every[by_key][1:] != every[by_key][:-1]]
            inverse = np.empty(len(every), np.int64)
            inverse[by_key] = np.cumsum(new) - 1
            del every, by_key
            count, was_held = np.concatenate(counts), np.repeat(held, size)
            total = np.bincount(inverse, count).astype(np.int64)  # exact below 2^53
            kept = np.bincount(inverse[~was_held], count[~was_held], len(total)).astype(np.int64)
            if k == 1:
                words = {"tokens": [int(kept.sum()), int(total.sum())], "types": [int((kept > 0).sum()), int((total > 0).sum())]}
            ends = np.cumsum(size)
            for block, h, a, b in zip(rows.column("block").to_pylist(), held.tolist(), (ends - size).tolist(), ends.tolist(), strict=True):
                out.append({"block": block, "n": k, "shard": shard, "kept": crushed(kept[inverse[a:b]]) if h else None, "total": crushed(total[inverse[a:b]])})
        return pa.Table.from_pylist([*out, {"block": -1, "n": 0, "shard": shard, **words}], ANSWERS)

    pieces = short.drop("ids").mapInArrow(ask, PIECES_DDL)
    return written(pieces.groupBy("shard").applyInArrow(answer, ANSWERS_DDL), "answers")


@dataclass
class Slice:
    """Some tokens of a block: their texts, and per order the count of each token's n-gram and that of its context (order 1: none is given)."""

    text: np.ndarray
    counts: list[tuple[np.ndarray, np.ndarray | None]]


def counts_of(grams: Grams, told: pa.Table, column: str) -> Iterator[Slice]:
    """The tokens of a block with the counts that it was told."""
    of, shard, data = (told.column(c).to_pylist() for c in ("n", "shard", column))
    count = []
    for k in range(1, len(grams.keys) + 1):
        parts = sorted((s, d) for s, o, d in zip(shard, of, data, strict=True) if o == k)
        count.append(np.concatenate([restored(d) for _, d in parts]).view(np.int64))
    end = count[0][np.searchsorted(grams.keys[0], END)]  # texts: what begins follows their start
    for a, b in slices(len(grams.at[0])):
        i, j = np.searchsorted(grams.first, (a, b))
        begins = grams.first[i:j] - a
        text = np.zeros(b - a, np.int64)
        text[begins] = 1
        counts, before = [], None
        for k, at in enumerate(grams.at):
            here, context = count[k][at[a:b]], None
            if k:
                context = np.empty_like(here)
                context[0] = count[k - 1][grams.at[k - 1][a - 1]]
                context[1:] = before[:-1]
                context[begins] = end
            counts.append((here, context))
            before = here
        yield Slice(i - 1 + np.cumsum(text), counts)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the power of two reached."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))).astype(np.int64), 0)


def mixed(counts: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """Probability of every token."""
    p = np.full(len(counts[0][0]), 1 / (types + 1))
    for k, (here, context) in enumerate(counts, 1):
        context = np.full(len(here), tokens) if context is None else context
        w = np.where(context > 0, weights[k - 1][bucket(context)], 0.0)
        p = w * here / np.maximum(context, 1) + (1 - w) * p
    return p


@dataclass
class Model:
    order: int
    #: Tokens and types of the training texts.
    tokens: int
    types: int
    #: (order, bucket): how much the estimate of an order counts.
    weights: np.ndarray
    #: Rounds of expectation-maximisation that were made, and the held-out tokens they used.
    rounds: int
    events: int


def learned_weights(events: DataFrame, order: int, tokens: int, types: int) -> tuple[np.ndarray, int, int]:
    """Weights by expectation-maximisation; ``events`` has the columns c1..., h1... (the
    counts of an n-gram's orders and their contexts) and m, how often they occur."""
    h = lambda k: F.lit(tokens).cast("long") if k == 1 else F.col(f"h{k}")
    at = lambda k: F.when(h(k) > 0, F.length(F.conv(h(k).cast("string"), 10, 2))).otherwise(0).cast("int")
    table = events.select("m", *[at(k).alias(f"b{k}") for k in range(1, order + 1)], *[F.when(h(k) > 0, F.col(f"c{k}") / h(k)).otherwise(0.0).alias(f"p{k}") for k in range(1, order + 1)])
    table = written(table.groupBy(*table.columns[1:]).agg(F.sum("m").alias("m")), "events")
    seen = [[r.asDict() for r in table.groupBy(F.col(f"b{k}").alias("b")).agg(F.sum("m").alias("m")).collect()] for k in range(1, order + 1)]
    weights, rounds = np.full((order, BUCKETS), 0.5), 0
    weights[:, 0] = 0
    total = sum(r["m"] for r in seen[0])
    while total and rounds < ROUNDS:
        rounds += 1
        w = [F.element_at(F.array(*[F.lit(float(x)) for x in weights[k]]), F.col(f"b{k + 1}") + 1) for k in range(order)]
        level, part, below = F.lit(1.0 / (types + 1)), [], []
        for k in range(order):
            own = w[k] * F.col(f"p{k + 1}")
            level = own + (1 - w[k]) * level
            part.append(own)
            below.append(level)
        # the share of each token that its orders up to k account for, and of it the part of order k
        rows = table.select("m", *[F.col(f"b{k + 1}") for k in range(order)], *[part[k].alias(f"o{k}") for k in range(order)], *[below[k].alias(f"l{k}") for k in range(order)], *[(1 - w[k]).alias(f"r{k}") for k in range(order)])
        reach, sums = F.lit(1.0), []
        for k in reversed(range(order)):
            sums.append(F.struct(F.lit(k).alias("k"), F.col(f"b{k + 1}").alias("b"), (F.col("m") * reach * F.col(f"o{k}")).alias("own"), (F.col("m") * reach * F.col(f"l{k}")).alias("all")))
            reach = reach * F.col(f"r{k}")
        share = rows.select(F.explode(F.array(*sums)).alias("s"), F.col(f"l{order - 1}").alias("p"))
        got = share.groupBy("s.k", "s.b").agg(F.sum(F.col("s.own") / F.col("p")).alias("own"), F.sum(F.col("s.all") / F.col("p")).alias("all")).collect()
        new = weights.copy()
        for r in got:
            if r["b"] and r["all"]:
                new[r["k"], r["b"]] = round(min(MOST, r["own"] / r["all"]), 9)
        moved = np.abs(new - weights).max()
        weights = new
        if moved < SETTLED:
            break
    for k in range(order):
        have = {r["b"] for r in seen[k]}
        for b in range(1, BUCKETS):
            if b not in have:
                weights[k, b] = weights[k, b - 1] if b > 1 else 0.5
    return weights, rounds, int(total)


def fitted(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> tuple[Model, DataFrame, DataFrame]:
    """The model, and the blocks and answers that ``applied`` scores."""
    bound_batches(df.sparkSession)
    short = blocks(df, training, id_col, text_col)
    told = answers(short, order)
    sums = told.where("block = -1").agg(*[F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in ("tokens", "types") for i in (0, 1)]).first()
    names = [f"{c}{k}" for k in range(1, order + 1) for c in ("c", "h") if (c, k) != ("h", 1)]

    def events(short: pa.Table, told: pa.Table) -> pa.Table:
        out = [np.empty((0, len(names) + 1), np.int64)]
        if short.num_rows and told.num_rows:
            grams, _ = grams_of(short, 0, order)
            for some in counts_of(grams, told, "kept"):
                rows, m = np.unique(np.stack([c for pair in some.counts for c in pair if c is not None], 1), axis=0, return_counts=True)
                out.append(np.c_[rows, m])
        return pa.table([pa.chunked_array([pa.array(x[:, i]) for x in out]) for i in range(len(names) + 1)], [*names, "m"])

    held = short.where("held").groupBy("block").cogroup(told.where("kept is not null").groupBy("block"))
    found = held.applyInArrow(events, ", ".join(f"{c} long" for c in [*names, "m"]))
    weights, rounds, n = learned_weights(found.groupBy(*names).agg(F.sum("m").alias("m")), order, sums.tokens0 or 0, sums.types0 or 0)
    return Model(order, sums.tokens1 or 0, sums.types1 or 0, weights, rounds, n), short, told


SCORES = pa.schema([("id", pa.int64()), ("training", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def applied(model: Model, short: DataFrame, told: DataFrame) -> DataFrame:
    """(id, training, n_tokens, n_known, train_tokens, base_score, score) of every text."""

    def score(short: pa.Table, told: pa.Table) -> pa.Table:
        if not short.num_rows:
            return SCORES.empty_table()
        grams, training = grams_of(short, 0, model.order)
        known, base, own = np.zeros((3, len(training)))
        for some in counts_of(grams, told, "total"):
            p, c = mixed(some.counts, model.weights, model.tokens, model.types), some.counts[0][0]
            i, j = some.text[0], some.text[-1] + 1
            for total, x in ((known, c > 0), (base, np.log10((c + 1) / (model.tokens + model.types + 1))), (own, np.log10(p))):
                total[i:j] += np.bincount(some.text - i, x)
        n = pa.array(np.full(len(training), model.tokens), pa.int64())
        return pa.Table.from_arrays([pa.array(short.column("ids")[0].as_py(), pa.int64()), pa.array(training), pa.array(grams.lengths), pa.array(known.astype(np.int64)), n, pa.array(base), pa.array(own)], schema=SCORES)

    both = short.groupBy("block").cogroup(told.where("block >= 0").groupBy("block"))
    return both.applyInArrow(score, "id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scored(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Learn from the texts where ``training`` holds, and score every text."""
    model, short, told = fitted(df, training, id_col, text_col, order)
    return applied(model, short, told)
