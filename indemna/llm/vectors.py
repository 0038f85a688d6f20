"""Near-duplicate embeddings: a robust-pruned flat graph over overlapping shards, and range search on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indemna.llm.common import join_in_parts, lists, settle
from indemna.llm.components import connected_components


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _ints(column: pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def robust_prune(x: np.ndarray, pools: np.ndarray, degree: int, alpha: float = 1.2) -> list[np.ndarray]:
    """Neighbours of each row of ``x`` among its pool, nearest first: a candidate goes as soon as it is
    ``alpha`` times nearer to a neighbour that was taken than to the row itself."""
    out = []
    for i in range(0, len(x), 128):
        pool = pools[i : i + 128]
        near = np.einsum("id,ijd->ij", x[i : i + 128], x[pool])
        near[pool == np.arange(i, i + len(pool))[:, None]] = -2
        order = np.argsort(-near, axis=1, kind="stable")
        pool, near = np.take_along_axis(pool, order, 1), np.take_along_axis(near, order, 1)
        between = np.einsum("ijd,ikd->ijk", x[pool], x[pool], optimize=True)
        alive, rows = near > -2, np.arange(len(pool))
        taken = np.full((len(pool), degree), -1)
        for j in range(degree):
            pick = alive.argmax(axis=1)
            some = alive[rows, pick]
            if not some.any():
                break
            taken[some, j] = pool[rows, pick][some]
            alive &= ~(alpha * (1 - between[rows, pick]) <= 1 - near)
            alive[rows, pick] = False
        out += [np.unique(t[t >= 0]) for t in taken]
    return out


def build_shard(x: np.ndarray, degree: int, pool: int, seed: int) -> list[np.ndarray]:
    """Adjacency lists of one shard: pruned pools of the nearest and some random rows, and their reverse edges."""
    n = len(x)
    rng = np.random.default_rng(seed)
    k = min(pool, n)
    if k < n:
        near = np.concatenate([np.argpartition(-(x[i : i + 512] @ x.T), k - 1, axis=1)[:, :k] for i in range(0, n, 512)])
    else:
        near = np.tile(np.arange(n), (n, 1))
    pools = np.concatenate([near, rng.integers(0, n, (n, min(16, n)))], axis=1)
    pools.sort(axis=1)
    twice = np.concatenate([np.zeros((n, 1), bool), pools[:, 1:] == pools[:, :-1]], axis=1)
    pools[twice] = np.broadcast_to(np.arange(n)[:, None], pools.shape)[twice]
    lists_ = robust_prune(x, pools, degree)
    a = np.repeat(np.arange(n), [len(y) for y in lists_])
    b = np.concatenate(lists_) if n else np.empty(0, int)
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = pairs // n, pairs % n
    sims = np.einsum("ij,ij->i", x[a], x[b])
    order = np.lexsort((-sims, a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    # A row that is near to very many keeps its nearest ones; the rest hang on the last of these as a chain, so
    # that what was linked stays reachable with few edges a row.
    over = np.flatnonzero(rank >= 2 * degree)
    chain = np.concatenate([b[over - 1] * n + b[over], b[over] * n + b[over - 1]])
    kept = rank < 2 * degree
    pairs = np.unique(np.concatenate([a[kept] * n + b[kept], chain]))
    a, b = pairs // n, pairs % n
    return np.split(b, np.searchsorted(a, np.arange(1, n)))


def range_search(x: np.ndarray, adjacent: np.ndarray, entries: np.ndarray, queries: np.ndarray, own: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the rows of ``x`` with a cosine of ``threshold`` or more that the search reaches.

    Every query walks greedily from the ``entries`` (the medoids) and from its own row, if it is in the
    graph, with a beam; then its range grows over the edges of what it has found in range.
    """
    m, n = len(queries), len(x)
    rows = np.arange(m)
    seen = np.zeros((m, n), bool)
    found: list[np.ndarray] = []

    def near(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        s = np.einsum("ij,ij->i", queries[q], x[v])
        found.append((q * n + v)[s >= threshold])
        return s

    start = np.concatenate([np.broadcast_to(entries, (m, len(entries))), own[:, None]], axis=1)
    ids = np.full((m, beam), -1)
    sims = np.full((m, beam), -np.inf)
    done = np.ones((m, beam), bool)
    for j, column in enumerate(start.T[:beam]):
        fresh = (column >= 0) & ~seen[rows, column]
        q, v = rows[fresh], column[fresh]
        seen[q, v] = True
        ids[q, j], sims[q, j], done[q, j] = v, near(q, v), False
    while True:
        pick = np.where(done, -np.inf, sims).argmax(axis=1)
        live = ~done[rows, pick]
        if not live.any():
            break
        done[rows, pick] = True
        nb = np.where(live[:, None], adjacent[ids[rows, pick]], -1)
        fresh = (nb >= 0) & ~seen[rows[:, None], nb]
        q, j = np.nonzero(fresh)
        seen[q, nb[q, j]] = True
        s = np.full(nb.shape, -np.inf)
        s[q, j] = near(q, nb[q, j])
        every = np.concatenate([sims, s], axis=1)
        best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
        sims = np.take_along_axis(every, best, 1)
        ids = np.take_along_axis(np.concatenate([ids, nb], axis=1), best, 1)
        done = np.take_along_axis(np.concatenate([done, ~fresh], axis=1), best, 1)
    front = np.concatenate(found)
    while len(front):
        nb = adjacent[front % n]
        q = np.broadcast_to((front // n)[:, None], nb.shape)[nb >= 0]
        pairs = np.unique(q * n + nb[nb >= 0])
        pairs = pairs[~seen.ravel()[pairs]]
        seen.ravel()[pairs] = True
        near(pairs // n, pairs % n)
        front = found[-1]
    pairs = np.concatenate(found)
    return pairs // n, pairs % n


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node reachable) that connect what the pairs connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _centroids(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means of the sample."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(8):
        own = (sample @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


#: Two hashes of an embedding, which stand for it.
_KEY = ("e1", "e2")


def _keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, e, e1, e2, usable): each row's embedding as doubles without negative zeros, and its hashes."""
    wide = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("e"))
    usable = F.col("vec_id").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    return rows.select("vec_id", "e", F.xxhash64("e").alias("e1"), F.xxhash64(F.lit(1), "e").alias("e2"), F.coalesce(usable, F.lit(False)).alias("usable"))


def _unit(rows: DataFrame) -> DataFrame:
    """(rep, least, copies, size, v, e1, e2): one row for each distinct usable embedding. rep is a number of its own, least
    the least vec_id that has it, v its unit vector as doubles."""
    reps = rows.where("usable").groupBy(*_KEY, "e").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for e in batch.column(0):
                v = np.array(e.values, np.float64)
                v = v / np.abs(v).max()
                out.append((v / np.linalg.norm(v)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([len(v) // 8 for v in out], pa.int32()), pa.array(out, pa.binary())], names=["least", "copies", *_KEY, "size", "v"])

    units = reps.select("e", "least", "copies", *_KEY).mapInArrow(run, "least long, copies long, e1 long, e2 long, size int, v binary")
    return units.withColumn("rep", F.monotonically_increasing_id())


def _links(units: DataFrame, centroids: np.ndarray, threshold: float, overlap: int, probes: int, shard_rows: int, degree: int, beam: int, pool: int, medoids: int, seed: int) -> DataFrame:
    """(a, b): edges that connect what the searches find linked."""
    spark = units.sparkSession
    overlap, probes = min(overlap, len(centroids)), min(probes, len(centroids))
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sims = _rows(batch.column(2)) @ shared.value.T
                cells = np.argsort(-sims, axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, lists(list(cells), pa.int32())], names=["rep", "copies", "v", "cells"])

    placed = settle(units.select("rep", "copies", "v").mapInArrow(assign, "rep long, copies long, v binary, cells array<int>"))
    built = placed.select("rep", "copies", "v", "cells", F.explode(F.slice("cells", 1, overlap)).alias("cell"))
    # Cells of more rows than a shard may have are built in blocks: at most one count a centroid reaches the driver.
    counts = built.groupBy("cell").count().toPandas()
    blocks = np.ones(len(centroids), np.int32)
    blocks[counts["cell"]] = np.maximum(1, -(-counts["count"] // shard_rows))
    of = F.element_at(F.array(*map(F.lit, blocks.tolist())), F.col("cell") + 1)
    built = built.withColumn("block", F.pmod(F.xxhash64("rep"), of).cast("int"))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rep = rows.column("rep").to_numpy()
        near = build_shard(_rows(rows.column("v")), degree, pool, seed)
        return pa.table({"rep": pa.array(rep), "near": lists([rep[y] for y in near], pa.int64())})

    shards = built.select("cell", "block", "rep", "v").groupBy("cell", "block").applyInArrow(build, "rep long, near array<long>")
    union = settle(shards.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))  # overlap lists of 2 * degree at most

    # Queries go to every block of the cells they probe, in chunks; a chunk gets a copy of the block's rows.
    asked = placed.select("rep", "v", "cells", F.explode("cells").alias("cell"))
    sizes = asked.groupBy("cell").count().toPandas()
    chunks = np.ones(len(centroids), np.int32)
    chunks[sizes["cell"]] = np.maximum(1, -(-sizes["count"] // shard_rows))
    into = F.element_at(F.array(*map(F.lit, chunks.tolist())), F.col("cell") + 1)
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(1)), into).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), of - 1)))
    graph = built.join(union, "rep").withColumn("chunk", F.explode(F.sequence(F.lit(0), into - 1)))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            rep, x = left.column("rep").to_numpy(), _rows(left.column("v"))
            order = np.argsort(rep)
            near = left.column("near").combine_chunks()
            flat = near.flatten().to_numpy()
            at = np.minimum(np.searchsorted(rep[order], flat), len(rep) - 1)
            local = np.where(rep[order][at] == flat, order[at], -1)
            lengths = np.diff(near.offsets.to_numpy())
            adjacent = np.full((len(rep), max(1, lengths.max())), -1)
            inside = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            adjacent[np.repeat(np.arange(len(rep)), lengths), inside] = local
            entries = np.unique((x @ _centroids(x, medoids, seed).T).argmax(axis=0))
            qrep, q = right.column("rep").to_numpy(), _rows(right.column("v"))
            spot = np.minimum(np.searchsorted(rep[order], qrep), len(rep) - 1)
            own = np.where(rep[order][spot] == qrep, order[spot], -1)
            for i in range(0, len(q), 256):
                qi, xi = range_search(x, adjacent, entries, q[i : i + 256], own[i : i + 256], threshold, max(beam, len(entries) + 1))
                u, v = _forest(qrep[qi + i], rep[xi])
                a.append(u)
                b.append(v)
        cat = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.int64())
        return pa.table({"a": cat(a), "b": cat(b)})

    by = ["cell", "block", "chunk"]
    graph = settle(graph.select(*by, "rep", "v", "near"))
    rows = graph.groupBy(*by).cogroup(asked.select(*by, "rep", "v").groupBy(*by))
    return settle(rows.applyInArrow(search, "a long, b long"))


def _counts(units: DataFrame, parts: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(rep, n): how many vectors of its component each vertex is linked with, from every cosine inside the components.

    Which side of a link the search came from, and in which cell, so makes no difference. Components of more than ``block_rows`` vertices
    are compared in pairs of blocks, others many in one task; no pair leaves a task, only counts do.
    """
    total = units.count()
    sizes = settle(parts.groupBy("component").agg(F.count("*").alias("n")))
    members = units.select("rep", "copies", "v").join(parts.withColumnRenamed("node", "rep"), "rep")
    members = join_in_parts(members, sizes.select("component", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")), ["component"], ["rep"], sizes, total)
    members = members.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    several = max(1, total // block_rows)
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(several))).otherwise(F.col("component"))
    members = members.select(group.alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "component", "own", "rep", "copies", "v")

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        component, own, rep, copies = (rows.column(c).to_numpy() for c in ("component", "own", "rep", "copies"))
        order = np.argsort(component, kind="stable")
        v = rows.column("v").take(pa.array(order))
        own, rep, copies = own[order], rep[order], copies[order]
        starts = np.unique(component[order], return_index=True)[1].tolist()
        n = np.zeros(len(rep), np.int64)
        for a, b in zip(starts, [*starts[1:], len(rep)], strict=True):
            x, blocks = _rows(v.slice(a, b - a)), own[a:b]
            one, two = np.flatnonzero(blocks == blocks[0]), np.flatnonzero(blocks != blocks[0])
            if len(two):
                near = x[one] @ x[two].T >= threshold
                n[a + one], n[a + two] = near @ copies[a + two], near.T @ copies[a + one]
            else:
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                n[a:b] = near @ copies[a:b]
        return pa.table({"rep": rep, "n": n})

    counted = members.groupBy("g", "i", "j").applyInArrow(count, "rep long, n long")
    return settle(counted.groupBy("rep").agg(F.sum("n").alias("n")))


def _audit(units: DataFrame, counted: DataFrame, threshold: float, rows: int, seed: int) -> float | None:
    """Share of the true links of ``rows`` vectors, chosen by hash, that were counted; null if they have none. All rows are compared with these. What
    is counted are true links, so equal numbers are equal sets."""
    chosen = units.orderBy(F.xxhash64("least", *_KEY, F.lit(seed)), "rep").limit(rows).toPandas()
    shared = units.sparkSession.sparkContext.broadcast((chosen["rep"].to_numpy(), np.array([np.frombuffer(v) for v in chosen["v"]])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, q = shared.value
        n = np.zeros(len(reps), np.int64)
        for batch in batches:
            if batch.num_rows:
                near = q @ _rows(batch.column(2)).T >= threshold
                near &= reps[:, None] != batch.column(0).to_numpy()[None, :]
                n += near @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(n)], names=["rep", "n"])

    true = units.select("rep", "copies", "v").mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    told = true.join(counted.withColumnRenamed("n", "have"), "rep", "left").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("have", F.lit(0)))).alias("have")).first()
    return told["have"] / told["n"] if told["n"] else None


def near_vectors(vectors: DataFrame, threshold: float = 0.9, cell_rows: int = 1200, shard_rows: int = 4000, overlap: int = 2, probes: int = 3, degree: int = 20, beam: int = 20, pool: int = 40, medoids: int = 16, sample_rows: int = 8192, max_cells: int = 1024, audit_rows: int = 256, block_rows: int = 2048, least_recall: float = 0.95, repeats: int = 2, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall) of every row of ``vectors`` (vec_id, embedding).

    Two vectors are linked if their cosine in doubles is ``threshold`` or more. Equal embeddings are one
    vertex with a number of copies. Centroids, fitted on ``sample_rows`` vertices, deal every vertex to its
    ``overlap`` nearest cells, built as shards of ``shard_rows`` at most; each shard is a graph pruned to
    ``degree`` neighbours, and a vertex's lists of all its shards are united. Every vertex is then searched
    for in its ``probes`` nearest cells by greedy range search from each shard's ``medoids``, which computes the
    cosine of each link it reports. Components are those of these links; n_links then counts both ends of every link inside a component, from all
    cosines there, so the work grows with the square of the unlike vectors of a component, like the links of one that is dense. All links of ``audit_rows`` vertices are found by brute force; below a share of ``least_recall``
    the search is repeated with twice the overlap and probes, ``repeats`` times at most; the share is told, whatever it is, and null where
    these vertices have no link. A caller who finds a share that is too low has to call again with more ``probes`` or ``repeats``. There are as many cells as make
    ``cell_rows`` rows each, ``max_cells`` at most; cells beyond ``shard_rows`` go on in blocks, all of which
    are searched, so no rows are left out at any size.

    Vectors that are null, empty or zero or hold null or non-finite components are linked with nothing;
    nor are vectors of different lengths, each of which makes an index of its own, one after the other. Rows that
    repeat a vec_id are rows of their own, linked with each other if they are alike; component_id is the least vec_id
    of all vectors that links reach from the row. A null vec_id gives null component_id and no links. Other columns are
    ignored; no rows give none.
    """
    keyed = _keyed(vectors)
    units = settle(_unit(keyed))
    sizes = [r["size"] for r in units.select("size").distinct().orderBy("size").collect()]
    links, counts, recalls = None, None, []
    for size in sizes:
        own = units.where(F.col("size") == size)
        n = own.count()
        sample = own.orderBy(F.xxhash64("least", *_KEY, F.lit(seed + 1)), "rep").limit(sample_rows).toPandas()
        centroids = _centroids(np.array([np.frombuffer(v) for v in sample["v"]]), max(1, min(max_cells, n * overlap // cell_rows)), seed)
        wide, deep = overlap, probes
        for again in range(repeats + 1):
            found = connected_components(_links(own, centroids, threshold, wide, deep, shard_rows, degree, beam, pool, medoids, seed), "a", "b")
            counted = _counts(own, found, threshold, block_rows)
            recall = _audit(own, counted, threshold, audit_rows, seed)
            if recall is None or recall >= least_recall or deep >= len(centroids) or again == repeats:
                break
            wide, deep = 2 * wide, 2 * deep
        links = found if links is None else links.unionAll(found)
        counts = counted if counts is None else counts.unionAll(counted)
        recalls += [] if recall is None else [recall]
    rows = keyed.select("vec_id", *[F.when(F.col("usable"), F.col(k)).alias(k) for k in _KEY])
    n_links = F.lit(0).cast("long")
    if links is None:
        rows = rows.select("vec_id", n_links.alias("n_links"), F.col("vec_id").alias("component_id"))
    else:
        told = units.select("rep", "least", "copies", *_KEY).join(counts, "rep", "left").join(links.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part_of", F.coalesce("component", "rep"))
        told = settle(told.select(*_KEY, "part_of", "least", (F.coalesce("n", n_links) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n")))
        least = told.groupBy("part_of").agg(F.min("least").alias("component_id"))
        named = told.join(least, "part_of").select(*_KEY, "n_links", "component_id")
        rows = join_in_parts(rows, named, list(_KEY), ["vec_id"], told.select(*_KEY, "n"), vectors.count(), "left")
        rows = rows.select("vec_id", F.coalesce("n_links", n_links).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))).withColumn("audited_recall", F.lit(min(recalls, default=None)).cast("double"))
