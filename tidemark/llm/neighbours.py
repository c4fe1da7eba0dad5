"""Approximate nearest neighbours: NN-descent builds a graph, queries search it greedily.

Equal vectors are one node, so copies never crowd a node's list. The graph
starts from blocks of vectors that share a near pivot; each round then joins
the neighbours (both ways) of every node with each other and keeps what is
nearer than the worst of a node's list. A query starts at its own node and
expands the nearest nodes that it has not yet expanded, until its beam holds
only expanded ones.

The graph is built from single-precision vectors around a common centre, so
few bytes travel and far-off origins cost no precision; what the search finds
is measured on the original doubles. List length, blocks and beam don't depend
on the number of nodes, so the work grows with it in proportion. Rounds end by the
lists' recall, measured on nodes compared with all vectors, or when nothing
changes. A sample of the queries is compared with all vectors as well; where too few
of their nearest were found the beam doubles, and after the last beam all
queries are compared with all vectors, in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

#: Neighbours in a node's list; on vectors without structure (64 independent dimensions) half as many lose a tenth of the recall.
K = 48
#: Links to a node that a round or a search follows, besides its own list.
REVERSE = 48
#: Orders that the vectors are cut into starting blocks by, and a block's rows, fewer where vectors are long.
TREES = 8
BLOCK = 4096
PIVOTS = 512
#: Bytes of vectors that a block or a set of pivots holds at most, and that are broadcast at most; beyond it joins go by shuffle.
VECTOR_BYTES, BROADCAST_BYTES = 32 << 20, 20 << 20
#: Lengths of vectors that get a centre and pivots of their own, commonest first; other lengths are ordered by a projection only.
DIMS = 16
#: Rounds and hops end as said below; running out of them is an error.
ROUNDS = 40
BEAMS = (64, 128, 256)
EXPAND = 24
MAX_HOPS = 200
TOP = 10
#: Nodes and queries compared with all vectors, and the share of their nearest to find: 0.9 and room for the sample's error.
CHECKED = 128
LEAST_RECALL = 0.93


def vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, dim and b (the doubles' bytes) of every row that takes part.

    Rows whose id or vector is null, whose vector is empty, all zero, or has a
    null or non-finite component take no part. Of several vectors under one id
    the one with the smallest bytes counts.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0))
    packed = rows.mapInPandas(_pack, "vec_id long, dim int, b binary")
    return packed.groupBy("vec_id").agg(F.min(F.struct("b", "dim")).alias("x")).select("vec_id", "x.dim", "x.b")


def _pack(parts):
    for pdf in parts:
        v = [np.asarray(x, dtype="<f8") + 0.0 for x in pdf["v"]]  # no negative zeros: equal vectors have equal bytes
        yield pd.DataFrame({"vec_id": pdf["vec_id"], "dim": np.array([len(x) for x in v], dtype=np.int32), "b": [x.tobytes() for x in v]})


def _matrix(b, dim: int) -> np.ndarray:
    """Vectors of ``dim`` components, of doubles or floats."""
    b = list(b)
    return np.frombuffer(b"".join(b), dtype="<f8" if len(b[0]) == 8 * dim else "<f4").reshape(len(b), dim)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances; the common centre goes first, as large terms would cancel."""
    centre = b.mean(0)
    a, b = a - centre, b - centre
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _sized(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


class _Narrow:
    """Vectors as floats around a centre; doubles as they are where their length has none."""

    def __init__(self, centres: dict[int, bytes]):
        self.centres = centres

    def __call__(self, parts):
        for pdf in parts:
            out = []
            for b, dim in zip(pdf["b"], pdf["dim"]):
                if dim in self.centres:
                    with np.errstate(over="ignore"):
                        x = (np.frombuffer(b, "<f8") - np.frombuffer(self.centres[dim], "<f8")).astype("<f4")
                    b = x.tobytes() if np.isfinite(x).all() else b
                out.append(b)
            yield pd.DataFrame({"node": pdf["node"], "dim": pdf["dim"], "x": out})


class _Cells:
    """For every tree the pivot nearest to each vector, and a random projection to order a cell by."""

    def __init__(self, pivots: list[dict[int, np.ndarray]]):
        self.pivots = pivots

    def __call__(self, parts):
        for pdf in parts:
            wide = pdf["x"].map(len)
            groups = [(dim, at, _matrix(pdf["x"].iloc[at], dim)) for (dim, _), at in pdf.groupby([pdf["dim"], wide]).indices.items()]
            for tree, pivots in enumerate(self.pivots):
                cell, along = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf))
                for dim, at, x in groups:
                    if dim in pivots:
                        cell[at] = _squares(x, pivots[dim].astype(x.dtype)).argmin(1)
                    along[at] = x @ np.random.default_rng([tree, int(dim)]).normal(size=dim)
                yield pd.DataFrame({"tree": tree, "node": pdf["node"], "dim": pdf["dim"], "x": pdf["x"], "cell": cell, "along": along})


def _mixed(x, dim: int) -> np.ndarray:
    """:func:`_matrix` of vectors that may be of either precision."""
    if len({len(v) for v in x}) == 1:
        return _matrix(x, dim)
    return np.stack([np.frombuffer(v, "<f8" if len(v) == 8 * dim else "<f4").astype(float) for v in x])


def _near(most: int):
    """A function that finds the ``most`` nearest others of each row of a block that are of its tree and length."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        node, near, dist = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.float32)]
        for (_, dim), own in pdf.groupby(["tree", "dim"]):
            nodes, x = own["node"].to_numpy(dtype=np.int64), _mixed(own["x"], int(dim))
            k = min(most, len(nodes) - 1)
            for at in range(0, len(nodes) if k else 0, 256):
                d = _squares(x[at : at + 256], x)
                d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
                best = np.argpartition(d, k - 1, axis=1)[:, :k]
                node.append(np.repeat(nodes[at : at + 256], k))
                near.append(nodes[best].ravel())
                dist.append(np.take_along_axis(d, best, 1).ravel().astype(np.float32))
        return pd.DataFrame({"node": np.concatenate(node), "nbr": np.concatenate(near), "d": np.concatenate(dist)})

    return one


def _top(edges: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("node").orderBy("d", "nbr")
    return edges.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def _narrowed(spark: SparkSession, nodes: DataFrame) -> tuple[DataFrame, list[int]]:
    """(node, dim, x): what the graph is built from, and the commonest lengths."""
    dims = [r["dim"] for r in nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(DIMS).collect() if 8 * r["dim"] * DIMS <= VECTOR_BYTES]
    centres = {r["dim"]: bytes(r["b"]) for r in nodes.where(F.col("dim").isin(dims)).groupBy("dim").agg(F.min_by("b", "node").alias("b")).collect()} if dims else {}
    return common.settle(spark, nodes.select("node", "dim", "b").mapInPandas(_Narrow(centres), "node long, dim int, x binary"), "nn-narrow"), dims


def _start(spark: SparkSession, small: DataFrame, dims: list[int], n: int, k: int) -> DataFrame:
    """The nearest within blocks: for every tree, rows in the order of their cell, cut by rank, however the rows lie in partitions."""
    trees = []
    for tree in range(TREES):
        trees.append({})
        for dim in dims:
            most = max(1, min(PIVOTS, n // 256 + 1, VECTOR_BYTES // (8 * dim * len(dims) * TREES)))
            rows = small.where(F.col("dim") == dim).orderBy(F.xxhash64(F.lit(tree), "node"), "node").select("x").limit(most).collect()
            trees[-1][dim] = _mixed([bytes(r["x"]) for r in rows], dim)
    longest = small.agg(F.max("dim")).first()[0] or 1
    block = max(16, min(BLOCK, VECTOR_BYTES // (8 * longest)))
    celled = small.mapInPandas(_Cells(trees), "tree int, node long, dim int, x binary, cell long, along double")
    order = ["tree", "dim", "cell", "along", "node"]
    placed = celled.repartitionByRange(max(1, n * TREES // (4 * BLOCK)), *order).sortWithinPartitions(*order).select("tree", "node", "dim", "x", F.monotonically_increasing_id().alias("at"))
    placed = common.settle(spark, placed, "nn-placed")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("first"))
    before = F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    counts = counts.select("p", "first", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = placed.join(F.broadcast(counts), part == F.col("p")).withColumn("block", F.floor((F.col("at") - F.col("first") + F.col("before")) / F.lit(block)))
    edges = ranked.select("block", "tree", "node", "dim", "x").groupBy("block").applyInPandas(_near(k), "node long, nbr long, d float")
    edges = edges.repartition("node").groupBy("node", "nbr").agg(F.min("d").alias("d"))
    made = common.settle(spark, _top(edges, k).withColumn("new", F.lit(True)), "nn-start")
    common.discard(spark, placed)
    return made


def _both_ways(graph: DataFrame) -> DataFrame:
    """(mid, member, new): every node's list and its up to ``REVERSE`` nearest other links to it, in one shuffle by mid."""
    own = graph.select(F.col("node").alias("mid"), F.col("nbr").alias("member"), "d", "new", F.lit(True).alias("own"))
    back = graph.select(F.col("nbr").alias("mid"), F.col("node").alias("member"), "d", "new", F.lit(False).alias("own"))
    rows = own.unionByName(back).repartition("mid").groupBy("mid", "member").agg(F.min("d").alias("d"), F.max("new").alias("new"), F.max("own").alias("own"))
    turn = Window.partitionBy("mid", "own").orderBy("d", "member")
    return rows.withColumn("r", F.row_number().over(turn)).where(F.col("own") | (F.col("r") <= REVERSE)).select("mid", "member", "new")


def _pairs(parts):
    """Of every node's neighbours, the pairs (one of them new) nearer than the worst of either's list."""
    rest = None
    for pdf in parts:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        mids = pdf["mid"].to_numpy()
        cuts = np.flatnonzero(np.diff(mids)) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        yield from _joined(pdf, [0, *cuts.tolist()])
        rest = pdf.iloc[last:]
    if rest is not None and len(rest):
        yield from _joined(rest, [0, len(rest)])


def _joined(pdf: pd.DataFrame, cuts: list[int]):
    node, x, dim = pdf["member"].to_numpy(), pdf["x"].to_numpy(), pdf["dim"].to_numpy()
    worst, new = pdf["worst"].to_numpy(), pdf["new"].to_numpy(dtype=bool)
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        fresh = new[lo:hi]
        if hi - lo < 2 or not fresh.any():
            continue
        v = _mixed(x[lo:hi], int(dim[lo]))
        d = _squares(v, v)
        use = (fresh[:, None] | fresh[None, :]) & (d < worst[lo:hi, None])
        np.fill_diagonal(use, False)
        i, j = np.nonzero(use)
        if len(i):
            out.append((node[lo + i], node[lo + j], d[i, j].astype(np.float32)))
    if out:
        yield pd.DataFrame({"node": np.concatenate([x[0] for x in out]), "nbr": np.concatenate([x[1] for x in out]), "d": np.concatenate([x[2] for x in out])})


def _bytes_of(df: DataFrame, vector: str, each: int = 64) -> int:
    return df.agg(F.sum(F.octet_length(vector) + F.lit(each))).first()[0] or 0


class _Exact:
    """Each query's ``top`` nearest other nodes among a task's rows."""

    def __init__(self, queries: list[tuple[int, int, bytes]], top: int):
        self.queries, self.top = queries, top

    def __call__(self, parts):
        near = {q: (np.empty(0), np.empty(0, dtype=np.int64)) for q, _, _ in self.queries}
        for pdf in parts:
            node = pdf["node"].to_numpy()
            for dim, at in pdf.groupby("dim").indices.items():
                x = _matrix(pdf["b"].iloc[at], dim)
                for q, own, b in self.queries:
                    if len(b) == 8 * dim:
                        d = np.sqrt(((x - np.frombuffer(b, dtype="<f8")) ** 2).sum(1))
                        other = node[at] != own
                        d, n = np.concatenate([near[q][0], d[other]]), np.concatenate([near[q][1], node[at][other]])
                        k = np.lexsort((n, d))[: self.top]
                        near[q] = d[k], n[k]
        rows = [(q, int(n), float(d)) for q, (ds, ns) in near.items() for d, n in zip(ds, ns)]
        yield pd.DataFrame(rows, columns=["query_id", "node", "d"]).astype({"query_id": "int64", "node": "int64", "d": "float64"})


def _compared(nodes: DataFrame, some: list, top: int) -> DataFrame:
    d = nodes.select("node", "dim", "b").mapInPandas(_Exact([(r["query_id"], r["node"], bytes(r["b"])) for r in some], top), "query_id long, node long, d double")
    w = Window.partitionBy("query_id").orderBy("d", "node")
    return d.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")


def _truth(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """(node, nbr): the ``TOP`` nearest of up to ``CHECKED`` nodes, by comparing with all."""
    some = nodes.orderBy(F.xxhash64("node"), "node").limit(CHECKED).select(F.col("node").alias("query_id"), "node", "b").collect()
    return common.settle(spark, _compared(nodes, some, TOP).select(F.col("query_id").alias("node"), F.col("node").alias("nbr")), "nn-truth")


def build(spark: SparkSession, nodes: DataFrame, k: int = K, settled_share: float = 0.002) -> DataFrame:
    """The neighbour graph (node, nbr, d squared) of ``nodes`` (node, dim, b).

    Rounds go on until the lists of ``CHECKED`` nodes, compared with all nodes,
    hold ``LEAST_RECALL`` of their nearest, or until nothing much changes any more.
    """
    n = nodes.count()
    truth = _truth(spark, nodes)
    total = truth.count()
    small, dims = _narrowed(spark, nodes)
    size = _bytes_of(small, "x")
    graph = _start(spark, small, dims, n, k)
    for turn in range(ROUNDS):
        worst = graph.groupBy("node").agg(F.max("d").alias("worst"), F.count(F.lit(1)).alias("c")).select("node", F.when(F.col("c") >= k, F.col("worst")).otherwise(F.lit(float("inf")).cast("float")).alias("worst"))
        known = small.join(_sized(worst, 32 * n), "node", "left").select(F.col("node").alias("member"), "dim", "x", F.coalesce("worst", F.lit(float("inf")).cast("float")).alias("worst"))
        mids = _both_ways(graph)
        # nothing new can come of a node whose neighbours are all old
        mids = mids.withColumn("any", F.max("new").over(Window.partitionBy("mid"))).where("any").drop("any")
        local = mids.join(_sized(known, size), "member").select("mid", "member", "new", "worst", "dim", "x")
        if size > BROADCAST_BYTES:
            local = local.repartition("mid")
        found = local.sortWithinPartitions("mid").mapInPandas(_pairs, "node long, nbr long, d float").withColumn("new", F.lit(True))
        # by node, which does for the list as well; a pair of the old list is not new
        merged = graph.withColumn("new", F.lit(False)).unionByName(found).repartition("node").groupBy("node", "nbr").agg(F.min("d").alias("d"), F.min("new").alias("new"))
        after = common.settle(spark, _top(merged, k), f"nn-{turn}")
        changed = after.where("new").count()
        common.discard(spark, graph)
        graph = after
        held = graph.join(F.broadcast(truth), ["node", "nbr"]).count()
        if held >= LEAST_RECALL * total or changed <= settled_share * k * n:
            common.discard(spark, small, truth)
            return graph.select("node", "nbr", "d")
    raise RuntimeError(f"the neighbour graph did not settle in {ROUNDS} rounds")


def _distances(parts):
    for pdf in parts:
        d = np.zeros(len(pdf))
        for dim, at in pdf.groupby("dim").indices.items():
            for lo in range(0, len(at), 2048):
                k = at[lo : lo + 2048]
                d[k] = np.sqrt(((_matrix(pdf["qb"].iloc[k], dim) - _matrix(pdf["b"].iloc[k], dim)) ** 2).sum(1))
        yield pd.DataFrame({"query_id": pdf["query_id"], "node": pdf["node"], "d": d})


def search(spark: SparkSession, nodes: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = BEAMS[0]) -> DataFrame:
    """(query_id, node, d): the nearest nodes found for each query (query_id, node, b)."""
    links = common.settle(spark, _both_ways(graph.withColumn("new", F.lit(False))).select(F.col("mid").alias("node"), F.col("member").alias("nbr")), "nn-links")
    q = _sized(queries.select("query_id", F.col("b").alias("qb")), _bytes_of(queries, "b"))
    held = _sized(nodes.select("node", "dim", "b"), _bytes_of(nodes, "b"))

    def measured(pairs: DataFrame) -> DataFrame:
        return pairs.join(held, "node").join(q, "query_id").select("query_id", "node", "dim", "qb", "b").mapInPandas(_distances, "query_id long, node long, d double")

    def ranked(rows: DataFrame) -> DataFrame:
        """The beam, and which of it is expanded next."""
        near = Window.partitionBy("query_id").orderBy("d", "node")
        turn = Window.partitionBy("query_id").orderBy("done", "d", "node")
        kept = rows.withColumn("r", F.row_number().over(near)).where(F.col("r") <= beam).drop("r")
        return kept.withColumn("go", ~F.col("done") & (F.row_number().over(turn) <= max(EXPAND, beam // 2)))

    state = common.settle(spark, queries.select("query_id", "node", F.lit(0.0).alias("d"), F.lit(False).alias("done"), F.lit(True).alias("go")), "nn-beam")
    for k in range(MAX_HOPS):
        reached = state.where("go").join(links, "node").select("query_id", F.col("nbr").alias("node"), F.lit(None).cast("double").alias("d"), F.lit(False).alias("done"))
        rows = state.select("query_id", "node", "d", (F.col("done") | F.col("go")).alias("done")).unionByName(reached)
        rows = common.settle(spark, rows.groupBy("query_id", "node").agg(F.max("d").alias("d"), F.max("done").alias("done")), f"nn-hop-{k}")
        fresh = measured(rows.where("d is null").select("query_id", "node")).withColumn("done", F.lit(False))
        after = common.settle(spark, ranked(rows.where("d is not null").unionByName(fresh)), f"nn-beam-{k}")
        common.discard(spark, state, rows)
        state = after
        if not state.where("go").limit(1).count():
            common.discard(spark, links)
            return state.select("query_id", "node", "d")
    raise RuntimeError(f"the search did not end in {MAX_HOPS} hops")


def exact(spark: SparkSession, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, node, far, c) of up to ``CHECKED`` queries: the distance of the last of the c <= ``TOP`` nearest nodes, by comparing with all."""
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CHECKED).select("query_id", "node", "b").collect()
    far = _compared(nodes, some, TOP).groupBy("query_id").agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("c"))
    return common.settle(spark, far.join(queries.select("query_id", "node"), "query_id"), "nn-exact")


def exact_search(spark: SparkSession, nodes: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, node, d): the ``top`` nearest other nodes of every query and its own, by comparing blocks of queries with all nodes."""
    blocks = _bytes_of(queries, "b") // (VECTOR_BYTES // 4) + 1
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = queries.select("query_id", "node", F.lit(0.0).alias("d"))
    for k in range(blocks):
        some = queries.where(block == k).select("query_id", "node", "b").collect()
        if some:
            found = found.unionByName(common.settle(spark, _compared(nodes, some, top), f"nn-all-{k}"))
    return found


def recall(found: DataFrame, checked: DataFrame) -> float:
    """The share of the nearest nodes of the queries of :func:`exact` that ``found`` (query_id, node, d) holds; 1 without any."""
    own = checked.select("query_id", F.col("node").alias("own"), "far", "c")
    near = found.join(F.broadcast(own), "query_id").where((F.col("node") != F.col("own")) & (F.col("d") <= F.col("far") * (1 + 1e-12)))
    hits = near.groupBy("query_id").agg(F.least(F.count(F.lit(1)), F.first("c")).alias("h")).agg(F.sum("h")).first()[0]
    total = checked.agg(F.sum("c")).first()[0]
    return (hits or 0) / total if total else 1.0


def found_by_search(spark: SparkSession, nodes: DataFrame, graph: DataFrame, queries: DataFrame) -> DataFrame:
    """:func:`search` with the first beam that finds ``LEAST_RECALL`` of the checked queries' nearest; :func:`exact_search` where none does."""
    checked = exact(spark, nodes, queries)
    for beam in BEAMS:
        found = search(spark, nodes, graph, queries, beam)
        if recall(found, checked) >= LEAST_RECALL:
            common.discard(spark, checked)
            return found
        common.discard(spark, found)
    return exact_search(spark, nodes, queries)


def nearest(spark: SparkSession, table: DataFrame, every: int = 100, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id and score of the ``top`` nearest found of every row whose id is divisible by ``every``.

    At least 0.9 of the true nearest are meant to be found; see :func:`found_by_search`.
    See :func:`vectors` for the rows that take part; vectors of different
    lengths are no candidates of each other. Ties go to the smaller vec_id.
    """
    rows = common.settle(spark, vectors(table), "nn-vectors")
    nodes = common.settle(spark, rows.groupBy("b", "dim").agg(F.min("vec_id").alias("node")).select("node", "dim", "b"), "nn-nodes")
    first = Window.partitionBy("b").orderBy("vec_id")
    # only the smallest ids of equal vectors can be among a query's nearest
    members = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= top + 1).select("vec_id", "b").join(nodes.select("node", "b"), "b").select("node", "vec_id")
    members = common.settle(spark, members, "nn-members")
    graph = build(spark, nodes)
    own = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "b").join(nodes.select("node", "b"), "b")
    own = common.settle(spark, own.select("query_id", "node", "b"), "nn-queries")
    found = found_by_search(spark, nodes, graph, own)
    ids = found.join(members, "node").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return ids.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", F.col("d").alias("score"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, common.table(spark, sf_dir, "embeddings"))
