"""SimHash near-duplicates by vantage-point trees in Hamming space.

1. Every whole text becomes one 64-bit fingerprint.
2. Equal fingerprints are merged first (partial aggregation), so a group of
   thousands of exact copies is one row from then on.
3. A vantage-point tree is built on the driver from a bounded sample
   (``SAMPLE`` fingerprints).  Its leaves are the shards; a shard of more than
   ``GROUP`` fingerprints is searched by pairs of blocks.  By the triangle
   inequality two fingerprints within ``radius`` bits of each other can only
   lie on different sides of a sphere if the inner one lies within ``radius``
   of it, so a fingerprint goes to the outer child also when it is that close
   to the boundary.  By induction every pair within the radius meets in a
   shard: the result is exact whatever the sample was.
4. Within a shard the same rule splits on, down to small blocks that are
   compared bit by bit.  A shard returns a spanning forest of its links, never
   the pairs, and the forests are joined by distributed star contraction.

Defined results: null text, empty text and text without a word have the
fingerprint zero and link with each other; null ids are kept and never become
a component's id unless it holds nothing else; repeated rows are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, connected_components, written

#: Fingerprints that the driver may hold to build the upper tree.
SAMPLE = 32_768
#: Distinct fingerprints that a shard should hold, and that a block of a larger one holds.
SHARD, GROUP = 20_000, 100_000
#: Fingerprints below which a block is compared bit by bit.
BLOCK = 256


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash: a bit is set if over half the shingle hashes have it."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    h = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64, len(parts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) of every row."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), fps], ["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def split_at(fps: np.ndarray) -> tuple[int, int] | None:
    """A vantage point and the largest inner distance; None where no sphere
    separates the given fingerprints."""
    best = None
    for v in fps[:: max(1, len(fps) // 3)][:4]:
        d = np.bitwise_count(fps ^ v)
        for mu in {int(np.median(d)), int(np.median(d)) - 1, int(d.max()) - 1}:
            inner = int((d <= mu).sum())
            if mu >= 0 and 0 < inner < len(fps):
                edge = int((d <= mu).sum() + (d > mu).sum() + ((d <= mu) & (d > mu - 2)).sum())
                worst = max(inner, len(fps) - inner) + edge
                if best is None or worst < best[0]:
                    best = (worst, int(v), mu)
    return best and best[1:]


def sides(fps: np.ndarray, vantage: int, mu: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.bitwise_count(fps ^ np.uint64(vantage)).astype(np.int64)
    return d <= mu, d > mu - radius


def build(sample: np.ndarray, leaf: int) -> list:
    """Upper tree as nested [vantage, mu, inner, outer] or a shard number."""
    count = iter(range(1 << 30))

    def grow(fps: np.ndarray):
        at = split_at(fps) if len(fps) > leaf else None
        if at is None:
            return next(count)
        inner = np.bitwise_count(fps ^ np.uint64(at[0])) <= at[1]
        return [at[0], at[1], grow(fps[inner]), grow(fps[~inner])]

    return grow(sample)


def shards_of(fps: np.ndarray, tree, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the shards they go to."""
    rows, shards, todo = [], [], [(tree, np.arange(len(fps)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            rows.append(at)
            shards.append(np.full(len(at), node))
            continue
        inner, outer = sides(fps[at], node[0], node[1], radius)
        todo += [(node[2], at[inner]), (node[3], at[outer])]
    return (np.concatenate(rows), np.concatenate(shards)) if rows else (np.zeros(0, int), np.zeros(0, int))


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the trees of ``a`` and ``b`` in the forest ``root``."""
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (new := root[root]).tobytes() != root.tobytes():
            root = new
    return root


def links_within(fps: np.ndarray, radius: int) -> np.ndarray:
    """Forest (index of each fingerprint's root) of the links among ``fps``."""
    root, todo = np.arange(len(fps)), [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        cut = split_at(fps[at]) if len(at) > BLOCK else None
        if cut:
            inner, outer = sides(fps[at], *cut, radius)
            if max(inner.sum(), outer.sum()) < 0.95 * len(at):
                todo += [at[inner], at[outer]]
                continue
        for i in range(0, len(at), BLOCK):  # blocks of rows: memory stays flat where nothing separates the rest
            x, y = np.nonzero(np.bitwise_count(fps[at[i : i + BLOCK], None] ^ fps[None, at]) <= radius)
            new = root[at[x + i]] != root[at[y]]
            root = hook(root, at[x + i][new], at[y][new])
    return root


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable by links of
    ``radius`` bits or fewer.  One row per input row."""
    spark = df.sparkSession
    docs = written(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    each = written(docs.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    n = each.count()
    share = max(1, -(-n // SAMPLE))
    sample = np.array([r.fp for r in each.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(share)) == 0).select("fp").limit(2 * SAMPLE).collect()], np.int64)
    tree = build(np.sort(sample).view(np.uint64), max(64, SHARD * len(sample) // max(1, n)))

    def route(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            fps = p["fp"].to_numpy(np.int64)
            rows, shards = shards_of(fps.view(np.uint64), tree, radius)
            yield pd.DataFrame({"shard": shards, "fp": fps[rows]})

    def search(p: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(p["fp"].to_numpy(np.int64))
        root = links_within(fps.view(np.uint64), radius)
        linked = root != np.arange(len(fps))
        return pd.DataFrame({"u": fps[linked], "v": fps[root[linked]]})

    routed = written(each.select("fp").mapInPandas(route, "shard long, fp long"), "routed")
    # The sample bounds the number of leaves, so a leaf may outgrow a task: it is
    # cut into blocks then, and every pair of blocks is a group of its own.
    sizes = routed.groupBy("shard").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("nb"))
    member = routed.join(F.broadcast(sizes), "shard").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))  # at most a row for each leaf of the sample's tree
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("shard", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "fp")
    edges = member.groupBy("shard", "a", "b").applyInPandas(search, "u long, v long")
    roots = connected_components(edges).withColumnsRenamed({"node": "fp", "root": "top"})
    joined = each.join(roots, "fp", "left").select("fp", "low", F.coalesce("top", "fp").alias("top"))
    lows = joined.groupBy("top").agg(F.min("low").alias("component"))
    classes = written(joined.join(lows, "top").select("fp", "component"), "classes")
    return docs.join(classes, "fp").select("id", "fp", "component")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of each class of ``df`` (columns unchanged): the one of the smallest
    id; a row with a null id stays only where its class has no other id.  Rows
    are told apart by a written number, so ids may be null or repeat."""
    number = "__rp_row" + "_" * max((len(c) for c in df.columns), default=0)  # longer than any name there is
    rows = written(df.withColumn(number, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, number, text_col, shingle, radius).select(F.col("id").alias(number), "component")
    order = F.struct(F.col(id_col).isNull(), F.col(id_col).cast("long"), F.col(number))
    first = found.join(rows.select(number, F.col(id_col)), number).groupBy("component").agg(F.min_by(number, order).alias(number))
    return rows.join(first.select(number), number, "left_semi").drop(number)
