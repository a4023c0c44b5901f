"""Near-duplicates at a similarity by wide SimHash fingerprints.

The similarity of two texts is that of their sets of word shingles (A-Z
lower-cased, five words by default).  At 0.8, two 64-bit fingerprints differ in
some ten bits, where no sphere separates random texts any more.  So here

1. a text's fingerprint has ``BITS`` bits, each the majority over its distinct
   shingles: the share of differing bits tells the angle between the two sets,
   and by it their similarity.  Texts within the radius are candidates: the
   number of bits expected at the similarity and six standard deviations, which
   also holds for texts of a few words;
2. a text's keys are its ``KEYS`` smallest shingle hashes.  Two texts of the
   similarity share eight in nine of them on average; fewer than ``SHARED`` of
   them are not expected of one pair in 100,000.  So two texts meet under one of
   the keys that are left when each sets its ``SHARED - 1`` most frequent ones
   aside: a passage that very many texts share brings together only those that
   consist of it for the most part;
3. equal fingerprints are merged first (partial aggregation); a key's texts are
   a shard, a larger one is split into blocks, and each pair of blocks is a task;
4. a shard is cut by spheres around vantage points as long as they separate it
   (a text within the radius of a sphere goes to both sides, so no pair is
   lost), and what is left is compared bit by bit.  A shard returns a spanning
   forest, never the pairs; forests are joined by distributed contraction;
5. candidates prove nothing, so the texts of each class that they make are
   compared by their sets of shingles: each with those of its class within the
   radius that no link joins with it yet.  A link is a similarity that was
   counted, and the classes are those of these links.  Large classes are split
   into blocks, and each pair of blocks is a task.

Recall is that of the candidates (over 0.999 at 0.8, by the distribution of the
bits; keys lose one pair in 100,000); no pair below the similarity is linked.

Defined results: null text, empty text and text without a word are equal to each
other; a text of fewer words than a shingle is one shingle; rows with null or
repeated ids are rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, connected_components, consecutive, written
from .simhash_vptree import hook

#: Bits of a fingerprint, keys of a text, and how many of them a linked text shares at least.
BITS, KEYS, SHARED = 1024, 24, 14
#: Texts of a block of a shard, and below which a part of it is compared bit by bit.
BLOCK, SMALL = 4096, 256
#: Deviations of the radius; texts and shingles of a block of a class whose sets are compared.
WIDE, COMPARED, COMPARED_SHINGLES = 6, 1024, 2_000_000

#: Odd multipliers, one for each 64 bits of a fingerprint.
MIX = np.random.default_rng(9).integers(1 << 62, 1 << 63, BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOW = np.uint64(0x0101010101010101)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words)] if len(words) <= size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64))


def majority(h: np.ndarray) -> bytes:
    """Fingerprint of a set of hashes; zero for none."""
    counts = np.zeros((8, BITS // 8), np.int64)
    for i in range(0, len(h), 255 * 64):
        x = h[i : i + 255 * 64, None] * MIX
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        for k in range(8):  # one bit of every byte at a time, up to 255 rows added in place
            sums = np.add.reduceat((x >> np.uint64(k)) & LOW, np.arange(0, len(x), 255), axis=0)
            counts[k] += sums.astype("<u8").view(np.uint8).reshape(len(sums), -1).sum(0, dtype=np.int64)
    bits = (2 * counts > len(h)).astype(np.uint8)
    return (bits << np.arange(8, dtype=np.uint8)[:, None]).sum(0, dtype=np.uint8).tobytes()


def radius_of(similarity: float) -> int:
    """Differing bits of two sets of one size that are so similar, and ``WIDE`` deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(BITS * p + WIDE * math.sqrt(BITS * p * (1 - p)))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def near_pairs(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within the radius; the first half of the words, whose bits
    cannot differ in more, goes first."""
    half = x.shape[1] // 2
    i, j = np.nonzero(np.bitwise_count(x[:, None, :half] ^ y[None, :, :half]).sum(-1, dtype=np.int64) <= radius)
    fits = apart(x[i], y[j]) <= radius
    return i[fits], j[fits]


def forest(fps: np.ndarray, radius: int) -> np.ndarray:
    """Root of each fingerprint (rows of words) in a forest of the links."""
    root, todo = np.arange(len(fps)), [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        if len(at) > SMALL:
            d = apart(fps[at], fps[at[len(at) // 2]])
            # All within half the radius of the vantage point are linked with each other.
            core = at[2 * d <= radius]
            root = hook(root, core[1:], core[:-1])
            for mu in (2 * radius, int(np.median(d))):
                inner, outer = at[d <= mu], at[d > mu - radius]
                if max(len(inner), len(outer)) < 0.95 * len(at):
                    todo += [inner, outer]
                    break
            else:
                for i in range(0, len(at), SMALL):
                    for j in range(i, len(at), SMALL):
                        a, b = at[i : i + SMALL], at[j : j + SMALL]
                        if len(np.unique(root[np.concatenate([a, b])])) > 1:
                            x, y = near_pairs(fps[a], fps[b], radius)
                            root = hook(root, a[x], b[y])
            continue
        x, y = near_pairs(fps[at], fps[at], radius)
        root = hook(root, at[x], at[y])
    return root


def sketches(df: DataFrame, row_col: str, text_col: str, size: int) -> DataFrame:
    """(row, fp binary, mark long, m int, keys array<long>) of every row; texts of one set of
    shingles have one fingerprint and one mark, m is the set's size."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [shingles(t, size) for t in b.column(1).to_pylist()]
            marks = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in each], np.uint64).view(np.int64)
            keys = [h[:KEYS].view(np.int64) for h in each]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([majority(h) for h in each], pa.binary()), pa.array(marks), pa.array([len(h) for h in each], pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["row", "fp", "mark", "m", "keys"])

    return df.select(F.col(row_col).alias("row"), F.col(text_col).alias("text")).mapInArrow(run, "row long, fp binary, mark long, m int, keys array<long>")


def joined_by(sets: list[np.ndarray], fps: np.ndarray, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links of the similarity that join all sets that such links join."""
    size, label, out = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    for i in range(len(sets)):
        others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        low, high = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
        others = others[low >= similarity * high - 1e-9]  # sets of other sizes are less similar
        for j in others[apart(fps[others], fps[i]) <= radius].tolist():
            if label[i] != label[j]:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if shared >= similarity * (size[i] + size[j] - shared) - 1e-9:
                    label[label == label[j]] = label[i]
                    out.append((i, j))
    return out


def compared(df: DataFrame, row_col: str, text_col: str, classes: DataFrame, size: int, similarity: float) -> DataFrame:
    """(u, v): links of the similarity among the texts of each of the ``classes`` (node, top, fp, m);
    a node is the row that has the text."""
    radius = radius_of(similarity)
    sizes = classes.groupBy("top").agg(F.ceil(F.greatest(F.count("*") / COMPARED, F.sum("m") / COMPARED_SHINGLES)).cast("int").alias("nb"))
    member = classes.join(sizes, "top").withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    member = member.select("node", "fp", "top", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    texts = member.join(df.select(F.col(row_col).alias("node"), F.col(text_col).alias("text")), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in consecutive(batches, ["top", "a", "b"]):
            node = group.column("node").to_numpy()
            fps = np.frombuffer(b"".join(group.column("fp").to_pylist()), np.uint64).reshape(len(node), -1)
            links = np.array(joined_by([shingles(t, size) for t in group.column("text").to_pylist()], fps, radius, similarity), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(node[links[:, 0]]), pa.array(node[links[:, 1]])], ["u", "v"])

    dealt = texts.repartition("top", "a", "b").sortWithinPartitions("top", "a", "b", "node")
    return dealt.select("top", "a", "b", "node", "fp", "text").mapInArrow(run, "u long, v long")


def similar(df: DataFrame, row_col: str, text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, class): equal for rows that links of the similarity join.  ``row_col``
    holds different longs."""
    radius = radius_of(similarity)
    rows = written(sketches(df, row_col, text_col, size), "sketches")
    nodes = written(rows.groupBy("fp", "mark", "m").agg(F.min("row").alias("node"), F.min("keys").alias("keys")), "nodes")
    said = nodes.select("node", F.size("keys").alias("m"), F.explode("keys").alias("key"))
    count = said.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # A text's keys from rare to frequent; those that only it has come first and find nobody.
    own = said.join(count, "key").groupBy("node", "m").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("held"))
    aside = F.ceil(F.col("m") * F.lit(SHARED / KEYS)).cast("int") - 1  # of m keys so many are set aside
    asked = own.select("node", F.explode(F.slice("held", 1, F.greatest(F.size("held") - aside, F.lit(0)))["key"]).alias("key"))
    asked = written(asked, "asked")
    sizes = asked.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    member = asked.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    # A block meets every block, itself included, once.
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    member = member.select("node", "key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    shards = member.join(nodes.select("node", "fp"), "node").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "node")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def links(parts: list) -> pa.RecordBatch:
            where, node, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
            cut = np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(where)], strict=True):
                if j - i == 2:
                    root = np.array([0, 0 if apart(fps[i], fps[i + 1]) <= radius else 1])
                else:
                    root = forest(fps[i:j], radius)
                linked = root != np.arange(j - i)
                u.append(node[i:j][linked])
                v.append(node[i:j][root[linked]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

        for b in batches:
            where = np.stack([b.column(k).to_numpy() for k in (1, 2, 3)], 1)
            fps = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint64).reshape(len(where), -1)
            node = b.column(0).to_numpy()
            # The last shard of a batch may go on in the next one.
            end = np.flatnonzero((where != where[-1]).any(1))
            k = int(end[-1]) + 1 if len(end) else 0
            if held and (k or (where[0] != held[-1][0][-1]).any()):
                first = int(np.argmax((where != held[-1][0][-1]).any(1))) if (where != held[-1][0][-1]).any() else len(where)
                held.append((where[:first], node[:first], fps[:first]))
                yield links(held)
                held, where, node, fps, k = [], where[first:], node[first:], fps[first:], max(0, k - first)
            if k:
                yield links([(where[:k], node[:k], fps[:k])])
            if len(where) > k:
                held.append((where[k:], node[k:], fps[k:]))
        if held:
            yield links(held)

    edges = shards.select("node", "key", "a", "b", "fp").mapInArrow(search, "u long, v long")
    candidates = connected_components(edges).withColumnRenamed("root", "top")
    candidates = written(nodes.select("node", "fp", "m").join(candidates, "node"), "candidates")
    roots = connected_components(compared(df, row_col, text_col, candidates, size, similarity)).withColumnsRenamed({"node": "n", "root": "top"})
    classes = nodes.select("fp", "mark", "node").join(roots, F.col("node") == F.col("n"), "left").select("fp", "mark", F.coalesce("top", "node").alias("class"))
    return rows.select("row", "fp", "mark").join(classes, ["fp", "mark"]).select("row", "class")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each class of ``df`` (columns unchanged): the one of the smallest
    id; a row with a null id stays only where its class has no other id.  Rows
    are told apart by a written number, so ids may be null or repeat."""
    number = "__rp_row" + "_" * max((len(c) for c in df.columns), default=0)  # longer than any name there is
    rows = written(df.withColumn(number, F.monotonically_increasing_id()), "rows")
    found = similar(rows, number, text_col, size, similarity).withColumnRenamed("row", number)
    order = F.struct(F.col(id_col).isNull(), F.col(id_col).cast("long"), F.col(number))
    first = found.join(rows.select(number, F.col(id_col)), number).groupBy("class").agg(F.min_by(number, order).alias(number))
    return rows.join(first.select(number), number, "left_semi").drop(number)
