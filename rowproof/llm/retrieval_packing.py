"""Lexical retrieval packing of documents into fixed-length token windows.

1. Every whole text is tokenised once.  Full windows of a long document are
   sequences of their own; what is left (less than a window) is packed.  The
   pass also counts, over all documents, in how many each token id occurs: at
   most one number per vocabulary entry.
2. A rest's token counts, weighted by the global inverse document frequencies,
   are projected to ``WIDTH`` numbers; its code is the nearest of ``CENTERS``
   centroids (fitted to at most ``SAMPLE`` rests, chosen by a hash) with
   ``BITS`` signs of what is left.  Codes in order are dealt to shards of about
   ``SHARD`` tokens, so similar rests meet; a code with more than that is split
   over as many shards as it needs by a hash.  The bounds follow from the counts
   of the codes alone: the same rows give the same shards in every run.
3. A shard builds a BM25 inverted index (terms: token ids; document counts:
   global).  Each window's seed queries it with its most informative terms; its
   best unused neighbours fill the window, whole where they fit; the best of
   those that don't fit is cut to fill the window to its last place, and its
   rest seeds the next one.  Where the ranking ends before the window is full,
   the seed's next terms are asked, and only when no unused document shares a
   term with the seed the next one in order is taken.  Only the last window of
   a buffer (at most ``BUFFER`` tokens) is padded.

Defined results: null and empty texts have the end id alone; repeated rows are
documents of their own; null ids are kept; pieces of one document are gapless
and cover it exactly; ``offset`` starts at 0 in each sequence without gaps.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, written

WINDOW = 2048
#: Tokens that a shard aims at, and that a buffer of one holds at most.
SHARD, BUFFER = 4_000_000, 8_000_000
#: Terms of a seed that one query has, ranked neighbours looked at in one go (more follow of both until the window is full); BM25's constants.
TERMS, TRIED, K1, B = 32, 48, 1.2, 0.75
#: Codes: numbers of a projection, centroids, rests that they are fitted to, and sign bits.
WIDTH, CENTERS, SAMPLE, BITS = 64, 256, 4096, 8
#: Texts of these characters alone are split alike by both tokenizer
#: libraries; any other text goes through the slower one.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ʯͰ-ͷΑ-ΡΣ-ώЀ-ҁ]*")

#: The end of the split pattern that needs a look-ahead, and the white space that can tell it from one white-space character at a time.
LOOK_AHEAD, RUNS = r"\s+(?!\S)|\s+", ("  ", " \n", "\n ", "\n\n\n", "\t", "\r")
#: Characters among which one should part words: the faster library's time grows by the square of a word.
BLOCK = 1000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tokens:
    """Token ids as the tokenizer file gives them.  The rank file holds the same
    vocabulary; its faster library is used where both provably agree.  The
    pattern's look-ahead only matters to runs of white space; texts without any
    are split by the rest of it, which needs no backtracking."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.runs, self.lone = (tiktoken.Encoding("packing", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (pattern, pattern.replace(LOOK_AHEAD, r"\s")))
        self.size = self.exact.get_vocab_size()
        self.kind = kind(self.size)

    def ids(self, text: str) -> np.ndarray:
        blocks = (text[i : i + BLOCK] for i in range(0, len(text) - BLOCK, BLOCK))
        if "<|" in text or not PLAIN.fullmatch(text) or any(b.isspace() or " " not in b and "\n" not in b for b in blocks):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, self.kind)
        fast = self.runs if any(x in text for x in RUNS) or text[-1:] == "\n" else self.lone
        return fast.encode_to_numpy(text).astype(self.kind)


@lru_cache(2)
def tokens(json_path: str, ranks_path: str, pattern: str) -> Tokens:
    return Tokens(json_path, ranks_path, pattern)


def kind(size: int) -> str:
    """Type of the ids of a vocabulary."""
    return "<u2" if size <= 1 << 16 else "<u4"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def counts(docs: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of every term of every document, in order."""
    doc = np.repeat(np.arange(len(docs), dtype=np.int64), [len(d) for d in docs])
    key = np.sort(doc * size + np.concatenate(docs)) if docs else doc
    first = np.flatnonzero(np.diff(key, prepend=-1))
    doc, term = np.divmod(key[first], size)
    return doc, term, np.diff(first, append=len(key))


def inverse(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log1p((n_docs - df + 0.5) / (df + 0.5))


def plane(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Weighted random directions of the terms."""
    sign = np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (len(df), WIDTH))
    return (sign * inverse(df, n_docs)[:, None]).astype(np.float32)


def projected(docs: list[np.ndarray], directions: np.ndarray) -> np.ndarray:
    """Unit projections of the documents' log counts; none is empty."""
    out = [np.zeros((0, WIDTH), np.float32)]
    for i in range(0, len(docs), 128):
        doc, term, tf = counts(docs[i : i + 128], len(directions))
        rows = directions[term] * (1 + np.log(tf, dtype=np.float32))[:, None]
        out.append(np.add.reduceat(rows, np.flatnonzero(np.diff(doc, prepend=-1)), axis=0))
    x = np.concatenate(out)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centers(x: np.ndarray) -> np.ndarray:
    """Centroids of the sample, neighbours of each other in order."""
    c = x[:: max(1, len(x) // CENTERS)][:CENTERS]
    for _ in range(6):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    axis = np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0]
    return c[np.argsort(c @ axis, kind="stable")]


def codes(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    near = (x @ c.T).argmax(1)
    return near << BITS | ((x - c[near])[:, :BITS] > 0) @ (1 << np.arange(BITS)[::-1])


def dealt(sizes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(code, first shard, number of shards) of each (code, tokens)."""
    out, shard, held = [], 0, 0
    for code, n in sorted(sizes):
        if held and held + n > SHARD:
            shard, held = shard + 1, 0
        k = max(1, -(-n // SHARD))
        out.append((code, shard, k))
        shard, held = (shard + k, 0) if k > 1 else (shard, held + n)
    return out


class Index:
    """BM25 inverted index over documents (id arrays)."""

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, n_docs: int, mean: float):
        self.n = len(docs)
        self.length = np.array([len(d) for d in docs], np.int64)
        doc, self.term, tf = counts(docs, len(df))
        w = inverse(df, n_docs)[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.length[doc] / max(mean, 1)))
        self.weight = w.astype(np.float32)
        order = np.argsort(self.term, kind="stable")
        self.post_doc, self.post_weight = doc[order], self.weight[order]
        self.first = np.searchsorted(self.term[order], np.arange(len(df) + 1))
        self.by_doc = np.searchsorted(doc, np.arange(self.n + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[np.ndarray]:
        """Unused documents that share a term with ``seed``, best first, in parts.
        A part is asked for when all before it are used."""
        a, b = self.by_doc[seed], self.by_doc[seed + 1]
        order = a + np.argsort(-self.weight[a:b], kind="stable")
        for i in range(0, len(order), TERMS):
            spans = [slice(self.first[t], self.first[t + 1]) for t in self.term[order[i : i + TERMS]]]
            doc, weight = np.concatenate([self.post_doc[s] for s in spans]), np.concatenate([self.post_weight[s] for s in spans])
            if len(doc) * 8 < self.n:
                found, at = np.unique(doc, return_inverse=True)
                score = np.bincount(at, weight)
            else:
                score = np.bincount(doc, weight, self.n)
                found = np.flatnonzero(score > 0)
                score = score[found]
            live = unused[found]
            found, score = found[live], score[live]
            if len(found) > TRIED:
                top = np.argpartition(-score, TRIED)
                # Equal scores at the border stay together, so that ties go by number.
                near = score >= score[top[:TRIED]].min()
                some, value = found[near], score[near]
                yield some[np.lexsort((some, -value))]
                found, score = found[~near], score[~near]
            if len(found):
                yield found[np.lexsort((found, -score))]


def pack(docs: list[np.ndarray], df: np.ndarray, n_docs: int, mean: float, window: int = WINDOW) -> Iterator[tuple]:
    """(doc number, start within its ids, length, sequence, offset) of each piece
    of ``docs`` (id arrays, in order)."""
    index = Index(docs, df, n_docs, mean)
    n, length = index.n, index.length
    unused, at, sequence = np.ones(n, bool), 0, 0
    carry: tuple[int, int] | None = None
    while True:
        while at < n and not unused[at]:
            at += 1
        if carry is None:
            if at == n:
                return
            carry = (at, 0)
            unused[at] = False
        seed, start = carry
        take = min(window, int(length[seed]) - start)
        yield seed, start, take, sequence, 0
        carry = (seed, start + take) if start + take < length[seed] else None
        room, offset = window - take, take
        for near in index.neighbours(seed, unused) if room else ():
            over = None
            for d in near.tolist():
                if length[d] <= room:
                    unused[d] = False
                    yield d, 0, int(length[d]), sequence, offset
                    room -= int(length[d])
                    offset += int(length[d])
                    if not room:
                        break
                elif over is None:
                    over = d
            if room and over is not None:  # cut the best of those that don't fit
                unused[over] = False
                yield over, 0, room, sequence, offset
                carry, room = (over, room), 0
            if not room:
                break
        while room:  # no document shares a term any more
            while at < n and not unused[at]:
                at += 1
            if at == n:
                break
            unused[at] = False
            take = min(room, int(length[at]))
            yield at, 0, take, sequence, offset
            room, offset = room - take, offset + take
            if take < length[at]:
                carry = (at, take)
        sequence += 1


def packed(df: DataFrame, json_path: str, ranks_path: str, pattern: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Pieces of all documents (see ``PIECES``)."""
    spark = df.sparkSession
    bound_batches(spark)

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(json_path, ranks_path, pattern)
        part, sequence, end = TaskContext.get().partitionId(), 0, np.array([end_id], t.kind)
        seen = np.zeros(t.size, np.int64)
        names = ["kind", "doc_id", "start", "length", "crc", "doc_tokens", "sequence_id", "ids"]
        types = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)
        for b in batches:
            rows = []
            all_ids = [np.append(t.ids(x or ""), end) for x in b.column(1).to_pylist()]
            for doc, ids in zip(b.column(0).to_pylist(), all_ids, strict=True):
                full = len(ids) // window * window
                for s in range(0, full, window):
                    rows.append((0, doc, s, window, crc(ids[s : s + window]), len(ids), 1 << 62 | part << 36 | sequence, None))
                    sequence += 1
                if full < len(ids):
                    rows.append((1, doc, full, len(ids) - full, 0, len(ids), 0, ids[full:].tobytes()))
            for k in range(0, len(all_ids), 512):
                seen += np.bincount(counts(all_ids[k : k + 512], t.size)[1], minlength=t.size)
            if rows:
                yield give(rows)
        yield give([(2, None, 0, 0, 0, 0, 0, zlib.compress(seen.tobytes(), 1))])

    done = written(
        df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
            tokenised, "kind int, doc_id long, start long, length long, crc long, doc_tokens long, sequence_id long, ids binary"
        ),
        "tokens",
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for b in batches:
            for x in b.column(0).to_pylist():
                one = np.frombuffer(zlib.decompress(x), np.int64)
                sums = one if sums is None else sums + one
        if sums is not None:
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], ["token", "n"])

    held = {r.token: r.n for r in done.where("kind = 2").select("ids").mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    known = np.zeros(1 + max(held, default=0), np.int64)
    known[list(held)] = list(held.values())  # at most one number per vocabulary entry
    rests = done.where("kind = 1").select("doc_id", "start", "doc_tokens", "length", "ids")
    total = rests.agg(F.count("*").alias("n"), F.sum("length").alias("s")).first()
    n_docs, mean = total.n, (total.s or 0) / max(1, total.n)
    whole = done.where("kind = 0").select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
    if not n_docs:
        return whole
    # ``known`` ends behind the last id that occurs, so the type of the ids comes from the vocabulary.
    ids_of = lambda size: lambda x: np.frombuffer(x, size).astype(np.int64)
    width = kind(tokens(json_path, ranks_path, pattern).size)
    # A hash thins the rests to a few times the sample before any are ranked.
    thin = F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(max(1, n_docs // (2 * SAMPLE)))) == 0
    sample = rests.where(thin).orderBy(F.xxhash64("ids"), "doc_id", "start").limit(SAMPLE).select("ids").collect()
    middle = centers(projected([ids_of(width)(r.ids) for r in sample], plane(known, n_docs)))
    shared = spark.sparkContext.broadcast((known, middle))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, c = shared.value
        directions = plane(df, n_docs)
        for b in batches:
            code = codes(projected([ids_of(width)(x) for x in b.column(4).to_pylist()], directions), c)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code, pa.int32())], [*b.schema.names, "code"])

    rests = written(rests.mapInArrow(coded, "doc_id long, start long, doc_tokens long, length long, ids binary, code int"), "rests")
    # At most CENTERS << BITS rows.
    shards = dealt([(r.code, r.n) for r in rests.groupBy("code").agg(F.sum("length").alias("n")).collect()])
    n_shards = 1 + max(first + k - 1 for _, first, k in shards)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, now, rows, held = 0, None, [], 0

        def out() -> pa.RecordBatch:
            nonlocal sequence, rows, held
            docs = [ids_of(width)(r[4]) for r in rows]
            got, last = [], -1
            for d, start, n, s, offset in pack(docs, shared.value[0], n_docs, mean, window):
                got.append((rows[d][1], rows[d][2] + start, n, crc(docs[d][start : start + n]), rows[d][3], now << 36 | sequence + s, offset))
                last = s
            sequence, rows, held = sequence + last + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if rows and (r[0] != now or held >= BUFFER):
                    yield out()
                if r[0] != now:
                    now, sequence = r[0], 0
                rows.append(r)
                held += len(r[4]) // int(width[2])
        if rows:
            yield out()

    place = spark.createDataFrame(shards, "code int, first long, k long")
    spread = rests.join(F.broadcast(place), "code").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("doc_id", "start", "ids"), F.col("k")))
    fill = spread.repartitionByRange(n_shards, "shard").sortWithinPartitions("shard", "code", "doc_id", "start", "ids")
    return whole.unionByName(fill.select("shard", "doc_id", "start", "doc_tokens", "ids").mapInArrow(filled, PIECES))
