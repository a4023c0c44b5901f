"""Embedding near-duplicates on a robust-pruned flat graph.

1. Equal vectors are merged first (partial aggregation): a vector that a third
   of all rows share is one node with a weight.
2. Centroids come from a bounded sample (``SAMPLE``).  Every node is a member of
   its ``OVERLAP`` nearest clusters, and asks its ``probes`` nearest ones.  A
   cluster beyond ``BLOCK`` members is split into blocks and its queries into
   slices of ``SLICE``; a task holds a block of members and a slice of queries.
3. Each shard builds a graph over its members: near candidates and random ones,
   pruned so that an edge stays only where no kept neighbour is clearly closer
   to its end.  The adjacency lists of a node's shards are united.
4. Each query searches its shards' parts of the united graph greedily from
   medoids (and from its own list where it is a member), then expands every
   neighbour that is in range until no new one shows.  Cosines are verified in
   double precision.  A link is counted in its end's home shard only, so counts
   add up, and each shard returns a spanning forest, never the pairs.
5. Recall is audited against brute force on a sample of queries over all nodes,
   by link and by query; below ``RECALL`` the search is repeated with twice the
   probes and beam.
6. Where ``ROUNDS`` searches don't reach it, as in dense groups that are cut into
   many clusters, every node is compared with all members of every cluster that
   can hold a vector in range (``exact_links``); nothing is left out then.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are their own component; vectors of different
length never link; repeated ids share their least component; ties cannot occur,
the threshold itself links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, connected_components, written

#: Bounds: vectors that centroids are fitted to, and centroids.
SAMPLE, CENTROIDS = 20_000, 4096
#: Members that a cluster aims at and that a block holds.
CLUSTER, BLOCK = 1000, 1500
#: Clusters that a node is a member of and that it asks at first.
OVERLAP, PROBES = 2, 3
#: Graph: near and random candidates, degree, reverse edges, and how much closer a kept neighbour must be.
NEAR, RANDOM, DEGREE, REVERSE, ALPHA = 32, 16, 20, 20, 1.2
#: Search: entry points, width of the beam, and queries side by side.
MEDOIDS, BEAM, QUERIES = 6, 16, 512
#: Queries of the audit, the recall asked for, and the graph searches before all is compared.
AUDIT, RECALL, ROUNDS = 64, 0.98, 3
#: Queries of one task.
SLICE = 20_000


def usable(v: Column) -> Column:
    """Whether a vector can link at all."""
    big = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(5)
    x = unit(sample)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(4):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-30), c)
    return c


def build_graph(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbours of each row of ``x`` (unit vectors), both ways."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    x = x.astype(np.float32)
    rng = np.random.default_rng(n)
    out: list[list[np.ndarray]] = [[] for _ in range(n)]
    heads, tails, gaps = [], [], []
    for a in range(0, n, 512):
        d = 2 - 2 * (x[a : a + 512] @ x.T)
        rows = np.arange(len(d))
        d[rows, rows + a] = np.inf
        near = np.argpartition(d, min(NEAR, n - 1) - 1, axis=1)[:, : min(NEAR, n - 1)]
        cand = np.hstack([near, rng.integers(0, n, (len(d), RANDOM))])
        dist = np.take_along_axis(d, cand, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
        alive = np.isfinite(dist)
        among = 2 - 2 * np.einsum("qid,qjd->qij", x[cand], x[cand], optimize=True)
        for _ in range(DEGREE):
            pick = alive.argmax(1)
            live = alive[rows, pick]
            if not live.any():
                break
            heads.append(rows[live] + a)
            tails.append(cand[rows, pick][live])
            gaps.append(dist[rows, pick][live])
            alive[rows, pick] = False
            alive &= ALPHA * ALPHA * among[rows, pick] > dist
    h, t, g = np.concatenate(heads), np.concatenate(tails), np.concatenate(gaps)
    for p, q, bound in ((h, t, DEGREE), (t, h, REVERSE)):
        order = np.lexsort((g, p))
        p, q = p[order], q[order]
        first = np.searchsorted(p, np.arange(n + 1))
        for i in range(n):
            out[i].append(q[first[i] : first[i + 1]][:bound])
    return [np.unique(np.concatenate(o)) for o in out]


def search_graph(q: np.ndarray, own: np.ndarray, x: np.ndarray, lists: list[np.ndarray], threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) pairs with a cosine of ``threshold`` or more.  ``own``: a
    query's place among the members, or -1."""
    n = len(x)
    width = max(1, max(map(len, lists)))
    adj = np.full((n, width), -1, np.int64)
    for i, nb in enumerate(lists):
        adj[i, : len(nb)] = nb
    x32 = x.astype(np.float32)
    # Medoids: the members nearest to the means of a few slices of the shard.
    axis = np.argsort(x32 @ x32.mean(0), kind="stable")
    entry = np.unique([part[(x32[part] @ x32[part].mean(0)).argmax()] for part in np.array_split(axis, min(MEDOIDS, n))])
    low = np.float32(threshold - 1e-4)
    pairs_q, pairs_m = [], []
    for a in range(0, len(q), QUERIES):
        qs, mine = q[a : a + QUERIES].astype(np.float32), own[a : a + QUERIES]
        k = len(qs)
        rows = np.arange(k)
        seen = np.zeros((k, n), bool)
        ids, sims, done = np.zeros((k, beam), np.int64), np.full((k, beam), -np.inf, np.float32), np.ones((k, beam), bool)
        first = np.repeat(entry[None], k, 0)
        first = np.hstack([first, np.where(mine >= 0, mine, entry[0])[:, None]])
        hits: list[np.ndarray] = []
        nb = first
        for _ in range(8 * beam):
            there = nb >= 0
            there &= ~seen[rows[:, None], np.maximum(nb, 0)]
            r, c = np.nonzero(there)
            m = nb[r, c]
            key, at = np.unique(r * n + m, return_index=True)
            r, c, m = r[at], c[at], m[at]
            seen[r, m] = True
            s = np.einsum("ij,ij->i", qs[r], x32[m])
            hits.append(key[s >= low])
            new = np.full(nb.shape, -np.inf, np.float32)
            new[r, c] = s
            all_sims, all_ids = np.hstack([sims, new]), np.hstack([ids, np.maximum(nb, 0)])
            all_done = np.hstack([done, ~np.isfinite(new)])
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims, ids, done = (np.take_along_axis(z, top, 1) for z in (all_sims, all_ids, all_done))
            open_ = np.where(done, -np.inf, sims)
            pick = open_.argmax(1)
            live = np.isfinite(open_[rows, pick])
            if not live.any():
                break
            done[rows, pick] = True
            nb = np.where(live[:, None], adj[ids[rows, pick]], -1)
        front = np.concatenate(hits)
        found = [front]
        while len(front):  # range expansion: neighbours of what is in range, until none is new
            step = []
            for b in range(0, len(front), 100_000):
                r, m = np.divmod(front[b : b + 100_000], n)
                nb = adj[m]
                there = (nb >= 0) & ~seen[r[:, None], np.maximum(nb, 0)]
                i, c = np.nonzero(there)
                key = np.unique(r[i] * n + nb[i, c])
                r, m = np.divmod(key, n)
                seen[r, m] = True
                step.append(key[np.einsum("ij,ij->i", qs[r], x32[m]) >= low])
            front = np.concatenate(step)
            found.append(front)
        r, m = np.divmod(np.concatenate(found), n)
        exact = np.einsum("ij,ij->i", q[a + r], x[m]) >= threshold
        pairs_q.append(a + r[exact])
        pairs_m.append(m[exact])
    return np.concatenate(pairs_q), np.concatenate(pairs_m)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node that each of ``n`` nodes reaches over the links ``a``-``b``."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (new := root[root]).tobytes() != root.tobytes():
            root = new
    return root


def fitted(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Centroids of each of the 16 most frequent lengths of vectors."""
    sizes = {r.d: r.n for r in nodes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(16).collect()}
    centers: dict[int, np.ndarray] = {}
    for d, n in sizes.items():
        share = max(1, n * len(sizes) // SAMPLE)
        some = nodes.where((F.size("v") == d) & (F.pmod(F.xxhash64("rep"), F.lit(share)) == 0)).select("v").limit(SAMPLE).collect()
        if some:
            centers[d] = centroids(np.array([r.v for r in some], np.float64), max(1, min(CENTROIDS, n // CLUSTER)))
    return centers


def near_links(nodes: DataFrame, threshold: float, probes: int, beam: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (rep, v, w) -> links per node (rep, n) and a forest of links (u, v)."""
    spark = nodes.sparkSession
    centers = fitted(nodes)

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            dim = p["v"].map(len).to_numpy()
            for d in np.unique(dim):
                q = p[dim == d]
                x = unit(np.stack(q["v"].to_numpy()))
                c = centers.get(int(d))
                k = 1 if c is None else min(probes, len(c))
                near = np.zeros((len(q), 1), int) if c is None else np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :k]
                for rank in range(k):
                    yield pd.DataFrame({"dim": int(d), "cluster": near[:, rank], "rank": rank, "rep": q["rep"], "w": q["w"], "v": q["v"]})

    asked = written(nodes.select("rep", "v", "w").mapInPandas(assign, f"dim int, cluster int, rank int, rep long, w long, v {nodes.schema['v'].dataType.simpleString()}"), "asked")
    inside = F.col("rank") < OVERLAP
    cut = asked.groupBy("dim", "cluster").agg(F.ceil(F.count_if(inside) / BLOCK).cast("int").alias("nb"), F.ceil(F.count("*") / SLICE).cast("int").alias("ns")).where("nb > 0")
    # At most CENTROIDS rows for each of at most 16 lengths, and one row for any other length.
    placed = asked.join(F.broadcast(cut), ["dim", "cluster"]).withColumns({"home": F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"), "own": F.pmod(F.xxhash64("rep", F.lit(3)), F.col("ns")).cast("int")})
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # A slice of a cluster's queries meets a block of its members in a task; members are there for every slice.
    queries = placed.withColumn("block", each("nb")).withColumn("slice", F.col("own")).withColumns({"member": inside & (F.col("block") == F.col("home")), "query": F.lit(True)})
    guests = placed.where(inside).withColumn("slice", each("ns")).where("slice <> own").withColumns({"block": F.col("home"), "member": F.lit(True), "query": F.lit(False)})
    spread = queries.unionByName(guests).drop("home", "own", "nb", "ns")
    keys = ["dim", "cluster", "block"]

    def build(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("rep")
        rep = p["rep"].to_numpy()
        lists = build_graph(unit(np.stack(p["v"].to_numpy())))
        return pd.DataFrame({"rep": rep, "nbs": [rep[nb] for nb in lists]})

    lists = spread.where("member and query").groupBy(*keys).applyInPandas(build, "rep long, nbs array<long>")
    united = written(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("nbs"))).alias("nbs")), "lists")

    def search(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["rep", "member"], ascending=[True, False])
        rep, member = p["rep"].to_numpy(), p["member"].to_numpy()
        vectors = unit(np.stack(p["v"].to_numpy()))
        names = rep[member]
        if not len(names):
            return pd.DataFrame({"rep": [], "n": [], "root": []})
        local = []
        for nbs in p["nbs"].to_numpy()[member]:
            at = np.minimum(np.searchsorted(names, nbs), len(names) - 1)
            local.append(at[names[at] == nbs])
        own = np.minimum(np.searchsorted(names, rep), len(names) - 1)
        own = np.where(names[own] == rep, own, -1)
        asks = np.flatnonzero(p["query"].to_numpy())
        if not len(asks):
            return pd.DataFrame({"rep": [], "n": [], "root": []})
        q, m = search_graph(vectors[asks], own[asks], vectors[member], local, threshold, beam)
        q = asks[q]
        other = rep[q] != names[m]
        q, m = q[other], m[other]
        home = (p["rank"].to_numpy()[member] == 0)[m]
        n = np.bincount(q[home], p["w"].to_numpy()[member][m][home], len(rep)).astype(np.int64)
        # The forest is over all ids of the shard, members and guests.
        ids = np.unique(rep)
        root = ids[forest(len(ids), np.searchsorted(ids, rep[q]), np.searchsorted(ids, names[m]))][np.searchsorted(ids, rep)]
        some = np.zeros(len(rep), bool)
        some[q] = True
        some |= root != rep
        return pd.DataFrame({"rep": rep[some], "n": n[some], "root": root[some]})

    found = written(spread.join(united, "rep", "left").groupBy(*keys, "slice").applyInPandas(search, "rep long, n long, root long"), "found")
    del spark
    return found.groupBy("rep").agg(F.sum("n").alias("n")), found.select(F.col("rep").alias("u"), F.col("root").alias("v"))


def askable(x: np.ndarray, c: np.ndarray, home: np.ndarray, radius: np.ndarray, apart: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a cluster can hold a vector within ``threshold`` of each row of ``x``.

    A member lies within its cluster's ``radius`` (an angle), so by the triangle
    inequality a row asks only clusters whose centre is at most that and the
    threshold's angle away.  A member is also no nearer to the row's home centre
    than to its own, so the row lies at most the threshold's chord from the
    plane between the two; ``apart`` has the distances of the centres."""
    slack = 1e-6
    cos = np.clip(x @ c.T, -1, 1)
    reach = np.arccos(np.clip(threshold, -1, 1))
    near = np.arccos(cos) <= radius[None] + reach + slack
    at = cos[np.arange(len(x)), home]
    chord = np.sqrt(max(0.0, 2 - 2 * threshold))
    return near & (at[:, None] - cos <= chord * apart[home] + slack)


def exact_links(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``near_links`` without a graph: all members of all clusters that can hold a
    link are compared, a block of members with a slice of queries in a task."""
    centers = fitted(nodes)
    kind = f"v {nodes.schema['v'].dataType.simpleString()}"

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            dim = p["v"].map(len).to_numpy()
            for d in np.unique(dim):
                q, c = p[dim == d], centers.get(int(d))
                cos = np.ones((len(q), 1)) if c is None else unit(np.stack(q["v"].to_numpy())) @ c.T
                home = cos.argmax(1)
                angle = np.arccos(np.clip(cos[np.arange(len(q)), home], -1, 1))
                yield pd.DataFrame({"dim": int(d), "cluster": home, "angle": angle, "rep": q["rep"], "w": q["w"], "v": q["v"]})

    homes = written(nodes.select("rep", "v", "w").mapInPandas(place, f"dim int, cluster int, angle double, rep long, w long, {kind}"), "homes")
    held = homes.groupBy("dim", "cluster").agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    radii = {d: np.full(len(c), -np.inf) for d, c in centers.items()}  # no member, no bound to meet
    for r in held.where(F.col("dim").isin(list(centers))).collect():
        radii[r.dim][r.cluster] = r.radius

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far = {d: np.sqrt(np.maximum((c * c).sum(1)[None] + (c * c).sum(1)[:, None] - 2 * (c @ c.T), 0)) for d, c in centers.items()}  # once a task
        for p in parts:
            dim = p["dim"].to_numpy()
            for d in np.unique(dim):
                q, c = p[dim == d], centers.get(int(d))
                if c is None:
                    yield q[["dim", "cluster", "rep", "v"]]
                    continue
                for i in range(0, len(q), 256):
                    some = q[i : i + 256]
                    row, cluster = np.nonzero(askable(unit(np.stack(some["v"].to_numpy())), c, some["cluster"].to_numpy(), radii[int(d)], far[int(d)], threshold))
                    for k in range(0, len(row), 4096):
                        hit = some.iloc[row[k : k + 4096]]
                        yield pd.DataFrame({"dim": int(d), "cluster": cluster[k : k + 4096], "rep": hit["rep"].to_numpy(), "v": hit["v"].to_numpy()})

    asks = homes.select("dim", "cluster", "rep", "v").mapInPandas(ask, f"dim int, cluster int, rep long, {kind}")
    asked = written(asks, "asked")
    slices = asked.groupBy("dim", "cluster").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("ns"))
    # At most CENTROIDS rows for each of at most 16 lengths, and one row for any other length.
    cut = written(held.select("dim", "cluster", "nb").join(slices, ["dim", "cluster"]), "cut")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hashed = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    keys = ["dim", "cluster", "block", "slice"]
    members = homes.select("dim", "cluster", "rep", "w", "v").join(F.broadcast(cut), ["dim", "cluster"]).withColumn("block", hashed("nb")).withColumn("slice", each("ns")).select(*keys, "rep", "w", "v")
    queries = asked.join(F.broadcast(cut), ["dim", "cluster"]).withColumn("slice", hashed("ns")).withColumn("block", each("nb")).select(*keys, "rep", "v")

    def compare(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(m):
            return pd.DataFrame({"rep": [], "n": [], "root": []})
        rep, other, w = q["rep"].to_numpy(), m["rep"].to_numpy(), m["w"].to_numpy()
        x = unit(np.stack(m["v"].to_numpy()))
        ids = np.unique(np.concatenate([rep, other]))
        mine, theirs = np.searchsorted(ids, rep), np.searchsorted(ids, other)
        n, ends = np.zeros(len(rep), np.int64), []
        for a in range(0, len(rep), QUERIES):
            hit = unit(np.stack(q["v"].iloc[a : a + QUERIES].to_numpy())) @ x.T >= threshold
            hit &= mine[a : a + QUERIES, None] != theirs[None]
            n[a : a + QUERIES] = hit @ w
            i, j = np.nonzero(hit)
            root = forest(len(ids), mine[a + i], theirs[j])
            moved = np.flatnonzero(root != np.arange(len(ids)))
            ends.append((moved, root[moved]))
        root = forest(len(ids), *map(np.concatenate, zip(*ends, strict=True)))
        # Every link is seen from both of its ends, but not in the same task: members are named, too.
        count = np.zeros(len(ids), np.int64)
        count[mine] = n
        some = (count > 0) | (root != np.arange(len(ids)))
        return pd.DataFrame({"rep": ids[some], "n": count[some], "root": ids[root[some]]})

    found = written(queries.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(compare, "rep long, n long, root long"), "found")
    return found.groupBy("rep").agg(F.sum("n").alias("n")), found.select(F.col("rep").alias("u"), F.col("root").alias("v"))


def audited(nodes: DataFrame, links: DataFrame, threshold: float) -> float:
    """Recall of the links of ``AUDIT`` nodes against brute force over all nodes:
    the lesser of the share of links and the mean share by node.  Half of the
    nodes are taken among those that have links."""
    by_hash = [F.xxhash64("rep", F.lit(11)), F.col("rep")]
    found = nodes.join(links, "rep", "left").select("rep", "v", F.coalesce("n", F.lit(0)).alias("n"))
    rows = {r.rep: r for some in (found.where("n > 0"), found) for r in some.orderBy(*by_hash).limit(AUDIT // 2).collect()}
    if not rows:
        return 1.0
    sample = [(r.rep, np.array(r.v, np.float64)) for r in rows.values()]

    def brute(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            dim = p["v"].map(len).to_numpy()
            for d in np.unique(dim):
                q = p[dim == d]
                x, rep, w = unit(np.stack(q["v"].to_numpy())), q["rep"].to_numpy(), q["w"].to_numpy()
                some = [(i, v) for i, v in sample if len(v) == d]
                if some:
                    hit = x @ unit(np.stack([v for _, v in some])).T >= threshold
                    hit &= rep[:, None] != np.array([i for i, _ in some])[None]
                    yield pd.DataFrame({"rep": [i for i, _ in some], "n": (hit * w[:, None]).sum(0)})

    true = {r.rep: r.n for r in nodes.select("rep", "v", "w").mapInPandas(brute, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n")).collect()}
    shares = [(min(rows[i].n, n), n) for i, n in true.items() if n]
    return min(sum(a for a, _ in shares) / sum(n for _, n in shares), sum(a / n for a, n in shares) / len(shares)) if shares else 1.0


def linked(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of every row."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).withColumn("ok", usable(F.col("v")))
    merged = rows.where("ok").groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("w"))
    nodes = written(merged.withColumn("rep", F.monotonically_increasing_id()), "nodes")
    probes, beam = PROBES, BEAM
    for _ in range(ROUNDS):
        links, edges = near_links(nodes, threshold, probes, beam)
        recall = audited(nodes, links, threshold)
        if recall >= RECALL:
            break
        probes, beam = 2 * probes, 2 * beam
    else:
        links, edges = exact_links(nodes, threshold)
        recall = audited(nodes, links, threshold)
    roots = connected_components(edges).withColumnsRenamed({"node": "rep", "root": "top"})
    known = nodes.join(links, "rep", "left").join(roots, "rep", "left").select("v", "low", "w", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top", "rep").alias("top"))
    lows = known.groupBy("top").agg(F.min("low").alias("component_id"))
    final = known.join(lows, "top").select("v", (F.col("n") + F.col("w") - 1).alias("n"), "component_id")
    out = rows.join(final.withColumn("ok", F.lit(True)), ["v", "ok"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"), F.lit(float(recall)).alias("audited_recall"))
